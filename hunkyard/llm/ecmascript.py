"""Lexer and pushdown grammar of JavaScript and TypeScript, for the question whether a text parses.

The lexer keeps a stack of brackets and template parts and yields kinds of tokens; names are one kind, so that lines of
the same shape look alike. A simple statement that fills a line is remembered by its kinds: its shape is parsed once
per process, which makes large collections cheap.
"""

from __future__ import annotations

import re
import sys

RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
CONTEXTUAL = frozenset("abstract any as asserts async await accessor bigint boolean constructor declare from get global infer interface is keyof let module namespace never number object of out override private protected public readonly require satisfies set static string symbol target meta type undefined unique unknown yield implements package using".split())
IDS = CONTEXTUAL | {"n"}
NAMES = IDS | RESERVED
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
BINARY = frozenset("|| && ?? | ^ & == != === !== < > <= >= << >> >>> + - * / % ** instanceof in".split())
UNARY = frozenset("! ~ + - typeof void delete".split())
NO_REGEX_AFTER = frozenset("n 0 s r t tt p ) ] this super null true false".split()) | CONTEXTUAL
MODIFIERS = frozenset("public private protected readonly abstract declare override static accessor async".split())
UNCACHED = frozenset("if for while do with try switch else { }".split())

_TOKEN = re.compile(
    r"[ \t\f\v\u00a0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+"
    r"|(\r\n|[\n\r\u2028\u2029])"
    r"|([A-Za-z_$][\w$]*|[^\W\d][\w$\u200c\u200d]*)"
    r"|(\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    r"|(0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:\d(?:_?\d)*n|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?))"
    r"|(//[^\n\r\u2028\u2029]*)|(/\*(?:[^*]|\*(?!/))*\*/)"
    r"|(>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\*\*|<<|>>|\+=|-=|\*=|%=|&=|\|=|\^=|[-+*%&|^!~?:=<>.,;(){}\[\]@])"
    r"|(#[A-Za-z_$][\w$]*)"
)
_REGEX = re.compile(r"/(?![*/])((?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+)/([A-Za-z_$\d]*)")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?!\{[0-9a-fA-F]{1,6}\}|[0-9a-fA-F]{4}))")
_CLASS = re.compile(r"\\.|\[(?:[^\]\\]|\\.)*\]")


# Frames of the parser for texts nested too deeply for the usual limit.
USUAL_FRAMES, MAX_FRAMES = 20_000, 400_000


class Bad(Exception):
    """Why a text does not parse."""


def _check_regex(body: str, flags: str) -> None:
    if len(set(flags)) != len(flags) or set(flags) - set("dgimsuvy"):
        raise Bad("invalid literal")
    depth = 0
    plain = _CLASS.sub("x", body)
    for c in plain:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            raise Bad("invalid literal")
    if depth or re.search(r"(?:^|[(|])(?:[*+]|\?(?![:=!<]))|[*+?]{2}[*+]", plain) or "[" in plain:
        raise Bad("invalid literal")


def lex(text: str, ts: bool) -> tuple[list[str], list[bool], list[int]]:
    """Kinds of the tokens, whether each begins a line, and for each opening bracket the index of its closing one."""
    kinds: list[str] = []
    first: list[bool] = []
    match: list[int] = []
    stack: list[tuple[str, int, str]] = []
    at, n, nl, prev = 0, len(text), True, ""
    if text.startswith("#!"):
        at = text.find("\n")
        at = n if at < 0 else at
    get = _TOKEN.match
    reserved = NAMES - {"n"}
    while at < n:
        m = get(text, at)
        if not m:
            c = text[at]
            if c == "`":
                at += 1
                kind = "template"
            elif c == "/":
                m = None
                kind = "regex"
            elif c in "\"'":
                raise Bad("unterminated literal")
            elif c == "\\" and re.match(r"(?:\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})|[\w$])+", text[at:]):
                m2 = re.match(r"(?:\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})|[\w$])+", text[at:])
                at += m2.end()  # type: ignore[union-attr]
                kinds.append("n")
                first.append(nl)
                match.append(0)
                nl, prev = False, "n"
                continue
            else:
                raise Bad("merge conflict" if re.match(r"(?:<{7}|>{7}|={7})", text[at:]) else "invalid character")
        else:
            g = m.lastindex
            if g is None:
                at = m.end()
                continue
            if g == 1:
                nl = True
                at = m.end()
                continue
            if g == 2:
                w = m[2]
                at = m.end()
                k = w if w in reserved and prev not in (".", "?.") else "n"
                kinds.append(k)
                first.append(nl)
                match.append(0)
                nl, prev = False, k
                continue
            if g == 3:
                if "\\" in m[3] and _BAD_ESCAPE.search(m[3]):
                    raise Bad("invalid literal")
                kind = "s"
            elif g == 4:
                at = m.end()
                if at < n and (text[at].isalnum() or text[at] in "_$"):
                    raise Bad("invalid literal")
                kinds.append("0")
                first.append(nl)
                match.append(0)
                nl, prev = False, "0"
                continue
            elif g == 5 or g == 6:
                if g == 6 and "\n" in m[6]:
                    nl = True
                at = m.end()
                continue
            elif g == 7:
                kind = m[7]
                if kind[0] == ">" and ts and len(kind) > 1 and kind != ">=":
                    kind = ">"
                    at += 1
                    kinds.append(kind)
                    first.append(nl)
                    match.append(0)
                    nl, prev = False, kind
                    continue
                if kind in "({[":
                    stack.append((kind, len(kinds), prev))
                elif kind in ")}]":
                    if not stack:
                        raise Bad("unbalanced delimiter")
                    o, j, before = stack.pop()
                    if kind == "}" and o == "${":
                        at += 1
                        t = _TEMPLATE.match(text, at)
                        if not t:
                            raise Bad("unterminated literal")
                        at = t.end()
                        kinds.append("tt" if t[1] == "`" else "tm")
                        first.append(nl)
                        match.append(0)
                        if t[1] != "`":
                            stack.append(("${", len(kinds) - 1, ""))
                        nl, prev = False, "tt" if t[1] == "`" else "tm"
                        continue
                    if o + kind not in ("()", "{}", "[]"):
                        raise Bad("unbalanced delimiter")
                    match[j] = len(kinds)
                    kinds.append(kind)
                    first.append(nl)
                    match.append(0)
                    nl = False
                    at = m.end()
                    prev = kind
                    if kind == ")" and before in ("if", "while", "for", "with"):
                        prev = "cond)"
                    elif kind == "}" and before in ("=", "(", ",", ":", "return", "?", "[", "&&", "||", "??", "=>", "...", "+"):
                        prev = "]"
                    continue
            else:
                kind = "p"
        if kind == "template":
            t = _TEMPLATE.match(text, at)
            if not t:
                raise Bad("unterminated literal")
            at = t.end()
            kind = "t" if t[1] == "`" else "th"
            kinds.append(kind)
            first.append(nl)
            match.append(0)
            if kind == "th":
                stack.append(("${", len(kinds) - 1, ""))
            nl, prev = False, kind
            continue
        if kind == "regex":
            if prev in NO_REGEX_AFTER:
                kind = "/=" if text.startswith("/=", at) else "/"
                at += len(kind)
            else:
                r = _REGEX.match(text, at)
                if not r:
                    raise Bad("unterminated comment" if text.startswith("/*", at) else "unterminated literal")
                _check_regex(r[1], r[2])
                at = r.end()
                kind = "r"
            kinds.append(kind)
            first.append(nl)
            match.append(0)
            nl, prev = False, kind
            continue
        kinds.append(kind)
        first.append(nl)
        match.append(0)
        nl, prev = False, kind
        at = m.end()  # type: ignore[union-attr]
    if stack:
        raise Bad("premature end")
    kinds += ["", "", "", ""]
    first += [True] * 4
    match += [0] * 4
    return kinds, first, match


_seen: set[tuple] = set()
_MAX_SEEN = 400_000


class Parser:
    """Recursive descent with a few places of backtracking; raises :class:`Bad` at the first error."""

    def __init__(self, text: str, ts: bool):
        self.k, self.nl, self.match = lex(text, ts)
        self.i = 0
        self.ts = ts
        self.fn = self.gen = False
        self.cover = False
        self.plain_arrow = False

    # helpers
    def fail(self) -> None:
        raise Bad("premature end" if self.k[self.i] == "" else "syntax")

    def eat(self, t: str) -> None:
        if self.k[self.i] != t:
            self.fail()
        self.i += 1

    def opt(self, t: str) -> bool:
        if self.k[self.i] == t:
            self.i += 1
            return True
        return False

    def ident(self) -> None:
        if self.k[self.i] not in IDS:
            self.fail()
        self.i += 1

    def any_name(self) -> None:
        if self.k[self.i] not in NAMES and self.k[self.i] != "p":
            self.fail()
        self.i += 1

    def semi(self) -> None:
        t = self.k[self.i]
        if t == ";":
            self.i += 1
        elif t != "}" and t != "" and not self.nl[self.i]:
            self.fail()

    def attempt(self, f) -> bool:
        at, state = self.i, (self.fn, self.gen, self.cover, self.plain_arrow)
        try:
            f()
            return True
        except Bad:
            self.i = at
            self.fn, self.gen, self.cover, self.plain_arrow = state
            return False

    # programs and statements
    def program(self) -> None:
        self.statements("", True)
        if self.k[self.i] != "":
            self.fail()

    def statements(self, end: str, top: bool = False) -> None:
        k, nl = self.k, self.nl
        while True:
            i = self.i
            t = k[i]
            if t == end or t == "":
                return
            if nl[i] and t not in UNCACHED:
                j = i + 1
                while not nl[j]:
                    j += 1
                if k[j - 1] == ";":
                    key = (self.ts, self.fn, self.gen, top, *k[i:j])
                    if key in _seen:
                        self.i = j
                        continue
                    self.statement(top)
                    if self.i == j and k[i + 1] != ":" and j - i < 60:
                        if len(_seen) >= _MAX_SEEN:
                            _seen.clear()
                        _seen.add(key)
                    continue
            self.statement(top)

    def block(self) -> None:
        self.eat("{")
        self.statements("}")
        self.eat("}")

    def body(self, gen: bool) -> None:
        old = self.fn, self.gen
        self.fn, self.gen = True, gen
        self.block()
        self.fn, self.gen = old

    def sub(self) -> None:
        t = self.k[self.i]
        if t in ("const", "class") or t == "let" and self.k[self.i + 1] == "[":
            self.fail()
        self.statement(False)

    def expression(self, no_in: bool = False) -> None:
        self.cover = False
        self.expr(no_in)
        if self.cover:
            self.fail()

    def paren(self) -> None:
        self.eat("(")
        self.expression()
        self.eat(")")

    def statement(self, top: bool) -> None:
        k = self.k
        t = k[self.i]
        if t == "{":
            self.block()
        elif (j := self.resource()) and k[j] in IDS and not self.nl[j]:
            self.i = j
            self.bindings("const", False)
            self.semi()
        elif t == "const" and self.ts and k[self.i + 1] == "enum":
            self.i += 1
            self.enum()
        elif t in ("const", "var") or t == "let" and (k[self.i + 1] in IDS or k[self.i + 1] in ("[", "{")):
            self.i += 1
            self.bindings(t, False)
            self.semi()
        elif t == "if":
            self.i += 1
            self.paren()
            self.sub()
            if self.opt("else"):
                self.sub()
        elif t == "return":
            if not self.fn:
                self.fail()
            self.i += 1
            if k[self.i] not in (";", "}", "") and not self.nl[self.i]:
                self.expression()
            self.semi()
        elif t == "for":
            self.for_()
        elif t == "while":
            self.i += 1
            self.paren()
            self.sub()
        elif t == "do":
            self.i += 1
            self.sub()
            self.eat("while")
            self.paren()
            self.opt(";")
        elif t == "try":
            self.i += 1
            self.block()
            if self.opt("catch"):
                if self.opt("("):
                    self.binding()
                    self.annotation()
                    self.eat(")")
                self.block()
                if self.opt("finally"):
                    self.block()
            else:
                self.eat("finally")
                self.block()
        elif t == "throw":
            self.i += 1
            if self.nl[self.i]:
                self.fail()
            self.expression()
            self.semi()
        elif t in ("break", "continue"):
            self.i += 1
            if k[self.i] in IDS and not self.nl[self.i]:
                self.i += 1
            self.semi()
        elif t == "switch":
            self.i += 1
            self.paren()
            self.eat("{")
            while not self.opt("}"):
                if self.opt("case"):
                    self.expression()
                else:
                    self.eat("default")
                self.eat(":")
                while k[self.i] not in ("case", "default", "}", ""):
                    self.statement(False)
        elif t == ";":
            self.i += 1
        elif t == "function" or t == "async" and k[self.i + 1] == "function" and not self.nl[self.i + 1]:
            self.function(True)
        elif t == "class" or t == "@":
            self.decorators()
            if self.opt("export"):
                self.opt("default")
            if self.ts:
                self.opt("abstract")
            self.class_(True)
        elif t == "import" and k[self.i + 1] not in ("(", "."):
            if not top:
                self.fail()
            self.import_()
        elif t == "export":
            if not top:
                self.fail()
            self.export()
        elif t == "debugger":
            self.i += 1
            self.semi()
        elif t == "with":
            self.i += 1
            self.paren()
            self.sub()
        elif t in IDS and k[self.i + 1] == ":":
            self.i += 2
            self.sub()
        elif self.ts and t in ("interface", "type", "declare", "namespace", "module", "abstract", "enum", "global") and self.declaration():
            pass
        else:
            self.expression()
            self.semi()

    def resource(self) -> int:
        """The place behind ``using`` or ``await using``, the beginning of a declaration if a name follows; 0 for other words."""
        k, i = self.k, self.i
        if k[i] == "await" and k[i + 1] == "using" and not self.nl[i + 1]:
            i += 1
        return i + 1 if k[i] == "using" else 0

    def for_(self) -> None:
        k = self.k
        self.i += 1
        self.opt("await")
        self.eat("(")
        t = k[self.i]
        if t == ";":
            pass
        elif (j := self.resource()) and k[j] in IDS and k[j] != "of":
            self.i = j
            self.bindings("const", True)
        elif t in ("const", "var") or t == "let" and (k[self.i + 1] in IDS and k[self.i + 1] not in ("of", "in") or k[self.i + 1] in ("[", "{")):
            self.i += 1
            self.bindings(t, True)
        else:
            self.cover = False
            self.expr(True)
            if self.cover and k[self.i] not in ("of", "in"):
                self.fail()
            self.cover = False
        if self.opt("of"):
            self.assign(False)
        elif self.opt("in"):
            self.expression()
        else:
            self.eat(";")
            if k[self.i] != ";":
                self.expression()
            self.eat(";")
            if k[self.i] != ")":
                self.expression()
        self.eat(")")
        self.sub()

    def bindings(self, kind: str, loop: bool) -> None:
        k = self.k
        while True:
            simple = k[self.i] in IDS
            self.binding()
            if self.ts:
                self.opt("!")
                self.annotation()
            if self.opt("="):
                self.cover = False
                self.assign(loop)
                if self.cover:
                    self.fail()
            elif not (loop and k[self.i] in ("of", "in")) and (kind == "const" or not simple) and not self.ambient:
                self.fail()
            if not self.opt(","):
                return

    ambient = False

    def binding(self) -> None:
        k = self.k
        t = k[self.i]
        if t in IDS:
            self.i += 1
        elif t == "[":
            self.i += 1
            while k[self.i] != "]":
                if self.opt(","):
                    continue
                rest = self.opt("...")
                self.binding()
                if not rest and self.opt("="):
                    self.assign(False)
                if k[self.i] != "]":
                    self.eat(",")
            self.i += 1
        elif t == "{":
            self.i += 1
            while k[self.i] != "}":
                if self.opt("..."):
                    self.ident()
                else:
                    t = k[self.i]
                    if t == "[":
                        self.i += 1
                        self.assign(False)
                        self.eat("]")
                        self.eat(":")
                        self.binding()
                    elif k[self.i + 1] == ":" and (t in NAMES or t in ("s", "0")):
                        self.i += 2
                        self.binding()
                    else:
                        self.ident()
                    if self.opt("="):
                        self.assign(False)
                if k[self.i] != "}":
                    self.eat(",")
            self.i += 1
        else:
            self.fail()

    def params(self) -> None:
        k = self.k
        self.eat("(")
        while k[self.i] != ")":
            self.decorators()
            if self.ts:
                while k[self.i] in ("public", "private", "protected", "readonly", "override") and (k[self.i + 1] in IDS or k[self.i + 1] in ("{", "[")):
                    self.i += 1
                if self.opt("this"):
                    self.annotation()
                    if k[self.i] != ")":
                        self.eat(",")
                    continue
            rest = self.opt("...")
            self.binding()
            if self.ts:
                self.opt("?")
                self.annotation()
            if not rest and self.opt("="):
                self.assign(False)
            if k[self.i] != ")":
                if rest:
                    self.fail()
                self.eat(",")
        self.i += 1

    def annotation(self) -> None:
        if self.ts and self.opt(":"):
            self.return_type()

    def signature(self) -> None:
        if self.ts and self.k[self.i] == "<":
            self.type_params()
        self.params()
        self.annotation()

    def function(self, named: bool) -> None:
        self.opt("async")
        self.eat("function")
        gen = self.opt("*")
        if self.k[self.i] in IDS:
            self.i += 1
        elif named:
            self.fail()
        self.signature()
        if self.ts and named and self.k[self.i] != "{":
            self.semi()
            return
        self.body(gen)

    def decorators(self) -> None:
        while self.opt("@"):
            if self.k[self.i] == "(":
                self.paren()
            else:
                self.any_name()
                while self.opt("."):
                    self.any_name()
                if self.k[self.i] == "(":
                    self.args()

    def class_(self, named: bool) -> None:
        k = self.k
        self.eat("class")
        if k[self.i] in IDS and k[self.i] not in ("implements",):
            self.i += 1
        elif named:
            self.fail()
        if self.ts and k[self.i] == "<":
            self.type_params()
        if self.opt("extends"):
            self.lhs()
            if self.ts and k[self.i] == "<":
                self.type_args()
        if self.ts and self.opt("implements"):
            self.type_()
            while self.opt(","):
                self.type_()
        self.eat("{")
        while not self.opt("}"):
            if not self.opt(";"):
                self.member()

    def member(self) -> None:
        k = self.k
        self.decorators()
        if k[self.i] == "static" and k[self.i + 1] == "{":
            self.i += 1
            self.body(False)
            return
        allowed = MODIFIERS if self.ts else ("static", "async", "accessor")
        while k[self.i] in allowed and k[self.i + 1] not in ("(", "=", ";", "}", ":", "?", "!", "<", ",", ""):
            if self.nl[self.i + 1] and k[self.i] in ("async", "accessor"):
                break
            self.i += 1
        gen = self.opt("*")
        if k[self.i] in ("get", "set") and k[self.i + 1] not in ("(", "=", ";", "}", ":", "?", "!", "<", "") and not gen:
            self.i += 1
        if self.ts and k[self.i] == "[" and k[self.i + 1] in IDS and k[self.i + 2] == ":":
            self.i += 3
            self.type_()
            self.eat("]")
            self.annotation()
            self.semi()
            return
        self.prop_name()
        if self.ts:
            self.opt("?") or self.opt("!")
        if k[self.i] in ("(", "<"):
            self.signature()
            if self.ts and k[self.i] != "{":
                self.semi()
            else:
                self.body(gen)
            return
        self.annotation()
        if self.opt("="):
            old = self.fn, self.gen
            self.fn = self.gen = False
            self.assign(False)
            self.fn, self.gen = old
        self.semi()

    def prop_name(self) -> None:
        t = self.k[self.i]
        if t == "[":
            self.i += 1
            self.assign(False)
            self.eat("]")
        elif t in NAMES or t in ("s", "0", "p"):
            self.i += 1
        else:
            self.fail()

    def import_(self) -> None:
        k = self.k
        self.i += 1
        if self.opt("s"):
            self.attributes()
            self.semi()
            return
        if self.ts and k[self.i] == "type" and (k[self.i + 1] in ("{", "*") or k[self.i + 1] in IDS and k[self.i + 1] != "from" or k[self.i + 2] == "from"):
            self.i += 1
        if k[self.i] in IDS:
            self.i += 1
            if self.ts and self.opt("="):
                self.assign(False)
                self.semi()
                return
            if not self.opt(","):
                self.eat("from")
                self.eat("s")
                self.attributes()
                self.semi()
                return
        if self.opt("*"):
            self.eat("as")
            self.ident()
        else:
            self.specifiers(True)
        self.eat("from")
        self.eat("s")
        self.attributes()
        self.semi()

    def attributes(self) -> None:
        if self.opt("with"):
            self.eat("{")
            while not self.opt("}"):
                self.i += 1
                self.eat(":")
                self.eat("s")
                if self.k[self.i] != "}":
                    self.eat(",")

    def specifiers(self, local: bool) -> None:
        k = self.k
        self.eat("{")
        while k[self.i] != "}":
            if self.ts and k[self.i] == "type" and k[self.i + 1] not in (",", "}", "as"):
                self.i += 1
            plain = k[self.i]
            if plain not in NAMES and plain != "s":
                self.fail()
            self.i += 1
            if self.opt("as"):
                if local:
                    self.ident()
                elif k[self.i] in NAMES or k[self.i] == "s":
                    self.i += 1
                else:
                    self.fail()
            elif local and plain not in IDS:
                self.fail()
            if k[self.i] != "}":
                self.eat(",")
        self.i += 1

    def export(self) -> None:
        k = self.k
        self.i += 1
        t = k[self.i]
        if t == "default":
            self.i += 1
            t = k[self.i]
            if t == "function" or t == "async" and k[self.i + 1] == "function":
                self.function(False) if not self.ts else self.default_function()
            elif t in ("class", "@") or self.ts and t == "abstract" and k[self.i + 1] == "class":
                self.decorators()
                self.opt("abstract")
                self.class_(False)
            elif self.ts and t == "interface" and self.declaration():
                pass
            else:
                self.expression()
                self.semi()
        elif t == "*":
            self.i += 1
            if self.opt("as") and not self.opt("s"):
                self.any_name()
            self.eat("from")
            self.eat("s")
            self.attributes()
            self.semi()
        elif t == "{" or self.ts and t == "type" and k[self.i + 1] in ("{", "*"):
            if t == "type":
                self.i += 1
            if self.opt("*"):
                if self.opt("as"):
                    self.any_name()
            else:
                self.specifiers(False)
            if self.opt("from"):
                self.eat("s")
                self.attributes()
            self.semi()
        elif self.ts and t == "=":
            self.i += 1
            self.expression()
            self.semi()
        elif self.ts and t == "as":
            self.i += 1
            self.eat("namespace")
            self.ident()
            self.semi()
        elif t in ("const", "let", "var", "function", "class", "@") or t == "async" and k[self.i + 1] == "function":
            self.statement(False)
        elif self.ts and t == "import":
            self.import_()
        elif self.ts and self.declaration():
            pass
        else:
            self.fail()

    def default_function(self) -> None:
        self.opt("async")
        self.eat("function")
        gen = self.opt("*")
        if self.k[self.i] in IDS:
            self.i += 1
        self.signature()
        if self.k[self.i] == "{":
            self.body(gen)
        else:
            self.semi()

    # declarations of TypeScript
    def declaration(self) -> bool:
        k = self.k
        t, u = k[self.i], k[self.i + 1]
        if t == "enum" or t == "const" and u == "enum":
            self.opt("const")
            self.enum()
        elif t == "interface" and u in IDS:
            self.i += 2
            if k[self.i] == "<":
                self.type_params()
            if self.opt("extends"):
                self.type_()
                while self.opt(","):
                    self.type_()
            self.object_type()
        elif t == "type" and u in IDS and not self.nl[self.i + 1]:
            self.i += 2
            if k[self.i] == "<":
                self.type_params()
            self.eat("=")
            self.type_()
            self.semi()
        elif t == "abstract" and u == "class":
            self.i += 1
            self.class_(True)
        elif t in ("namespace", "module") and (u in IDS or u == "s") and not self.nl[self.i + 1]:
            self.i += 2
            while self.opt("."):
                self.any_name()
            if k[self.i] == "{":
                self.eat("{")
                self.statements("}", True)
                self.eat("}")
            else:
                self.semi()
        elif t == "global" and u == "{":
            self.i += 1
            self.eat("{")
            self.statements("}", True)
            self.eat("}")
        elif t == "declare" and (u in ("const", "let", "var", "function", "class", "enum", "namespace", "module", "global", "interface", "type", "abstract", "async") and not self.nl[self.i + 1]):
            self.i += 1
            old, self.ambient = self.ambient, True
            try:
                self.statement(True)
            finally:
                self.ambient = old
        else:
            return False
        return True

    def enum(self) -> None:
        self.eat("enum")
        self.ident()
        self.eat("{")
        while not self.opt("}"):
            self.prop_name()
            if self.opt("="):
                self.assign(False)
            if self.k[self.i] != "}":
                self.eat(",")

    # types
    def type_params(self) -> None:
        self.eat("<")
        while True:
            while self.k[self.i] in ("const", "in", "out") and self.k[self.i + 1] in IDS:
                self.i += 1
            self.ident()
            if self.opt("extends"):
                self.type_()
            if self.opt("="):
                self.type_()
            if not self.opt(",") or self.k[self.i] == ">":
                break
        self.eat(">")

    def type_args(self) -> None:
        self.eat("<")
        self.type_()
        while self.opt(","):
            self.type_()
        self.eat(">")

    def return_type(self) -> None:
        k = self.k
        if k[self.i] == "asserts" and (k[self.i + 1] in IDS or k[self.i + 1] == "this") and not self.nl[self.i + 1]:
            self.i += 2
            if self.opt("is"):
                self.type_()
        elif (k[self.i] in IDS or k[self.i] == "this") and k[self.i + 1] == "is" and not self.nl[self.i + 1]:
            self.i += 2
            self.type_()
        else:
            self.type_()

    def type_(self) -> None:
        k = self.k
        t = k[self.i]
        if t == "new" or t == "abstract" and k[self.i + 1] == "new":
            self.opt("abstract")
            self.i += 1
            if k[self.i] == "<":
                self.type_params()
            self.params()
            self.eat("=>")
            self.return_type()
            return
        if t == "<" or t == "(" and k[self.match[self.i] + 1] == "=>":
            if t == "<":
                self.type_params()
            self.params()
            self.eat("=>")
            self.return_type()
            return
        self.union()
        if k[self.i] == "extends" and not self.nl[self.i]:
            self.i += 1
            self.union()
            if self.opt("?"):
                self.type_()
                self.eat(":")
                self.type_()

    def union(self) -> None:
        self.opt("|") or self.opt("&")
        while True:
            k = self.k[self.i]
            if k == "(" and self.k[self.match[self.i] + 1] == "=>" or k == "new":
                self.type_()
            else:
                self.prefix_type()
            if not (self.opt("|") or self.opt("&")):
                return

    def prefix_type(self) -> None:
        k = self.k
        while k[self.i] in ("keyof", "unique", "readonly") and (k[self.i + 1] in NAMES or k[self.i + 1] in ("{", "(", "[", "typeof")):
            self.i += 1
        if k[self.i] == "infer" and k[self.i + 1] in IDS:
            self.i += 2
            if k[self.i] == "extends":
                self.attempt(self._infer_bound)
            return
        self.primary_type()
        while True:
            if k[self.i] == "[" and not self.nl[self.i]:
                self.i += 1
                if k[self.i] != "]":
                    self.type_()
                self.eat("]")
            else:
                return

    def _infer_bound(self) -> None:
        self.eat("extends")
        self.prefix_type()
        if self.k[self.i] == "?":
            self.fail()

    def primary_type(self) -> None:
        k = self.k
        t = k[self.i]
        if t == "typeof":
            self.i += 1
            if self.opt("import"):
                self.eat("(")
                self.eat("s")
                self.eat(")")
            else:
                self.any_name()
            while self.opt("."):
                self.any_name()
            if k[self.i] == "<" and not self.nl[self.i]:
                self.type_args()
        elif t == "import":
            self.i += 1
            self.eat("(")
            self.eat("s")
            self.eat(")")
            while self.opt("."):
                self.any_name()
            if k[self.i] == "<":
                self.type_args()
        elif t in IDS:
            self.i += 1
            while self.opt("."):
                self.any_name()
            if k[self.i] == "<" and not self.nl[self.i]:
                self.type_args()
        elif t in ("void", "null", "true", "false", "this", "s", "0", "t"):
            self.i += 1
        elif t == "-" and k[self.i + 1] == "0":
            self.i += 2
        elif t == "th":
            self.i += 1
            self.type_()
            while self.opt("tm"):
                self.type_()
            self.eat("tt")
        elif t == "(":
            self.i += 1
            self.type_()
            self.eat(")")
        elif t == "[":
            self.i += 1
            while k[self.i] != "]":
                self.opt("...")
                if k[self.i] in NAMES and (k[self.i + 1] == ":" or k[self.i + 1] == "?" and k[self.i + 2] == ":"):
                    self.i += 1
                    self.opt("?")
                    self.eat(":")
                self.type_()
                self.opt("?")
                if k[self.i] != "]":
                    self.eat(",")
            self.i += 1
        elif t == "{":
            self.object_type()
        else:
            self.fail()

    def object_type(self) -> None:
        k = self.k
        self.eat("{")
        while not self.opt("}"):
            if k[self.i] in ("+", "-") and k[self.i + 1] == "readonly":
                self.i += 1
            if k[self.i] == "readonly" and (k[self.i + 1] in NAMES or k[self.i + 1] in ("[", "s", "0")):
                self.i += 1
            if k[self.i] == "[" and k[self.i + 1] in IDS and k[self.i + 2] in ("in", ":"):
                mapped = k[self.i + 2] == "in"
                self.i += 3
                self.type_()
                if mapped and self.opt("as"):
                    self.type_()
                self.eat("]")
                if k[self.i] in ("+", "-"):
                    self.i += 1
                self.opt("?")
                self.annotation()
            elif k[self.i] in ("(", "<"):
                self.signature()
            elif k[self.i] == "new" and k[self.i + 1] in ("(", "<"):
                self.i += 1
                self.signature()
            else:
                if k[self.i] in ("get", "set") and (k[self.i + 1] in NAMES or k[self.i + 1] in ("s", "[", "0")):
                    self.i += 1
                self.prop_name()
                self.opt("?")
                if k[self.i] in ("(", "<"):
                    self.signature()
                else:
                    self.annotation()
            if not (self.opt(";") or self.opt(",")) and k[self.i] != "}" and not self.nl[self.i]:
                self.fail()

    # expressions; the kind returned says whether the expression may be assigned to
    def expr(self, no_in: bool = False) -> str:
        kind = self.assign(no_in)
        while self.opt(","):
            self.assign(no_in)
            kind = ""
        return kind

    def arrow_body(self, no_in: bool) -> None:
        if self.nl[self.i]:
            self.fail()
        self.eat("=>")
        if self.k[self.i] == "{":
            self.body(False)
        else:
            old = self.fn, self.cover
            self.fn, self.cover = True, False
            self.assign(no_in)
            if self.cover:
                self.fail()
            self.fn, self.cover = old

    def _typed_arrow(self) -> None:
        self.signature()
        if self.k[self.i] != "=>":
            self.fail()
        self.arrow_body(False)

    def assign(self, no_in: bool) -> str:
        k = self.k
        i = self.i
        t = k[i]
        if t in IDS:
            if k[i + 1] == "=>":
                self.i += 1
                self.arrow_body(no_in)
                return ""
            if t == "async" and not self.nl[i + 1]:
                if k[i + 1] in IDS and k[i + 2] == "=>":
                    self.i += 2
                    self.arrow_body(no_in)
                    return ""
                if k[i + 1] == "(" and k[self.match[i + 1] + 1] == "=>":
                    self.i += 1
                    self.params()
                    self.arrow_body(no_in)
                    return ""
                if self.ts and k[i + 1] in ("(", "<"):
                    self.i += 1
                    if self.attempt(self._typed_arrow):
                        return ""
                    self.i -= 1
            if t == "yield" and self.gen:
                self.i += 1
                if self.nl[self.i] or k[self.i] in (")", "]", "}", ",", ";", ":", ""):
                    return ""
                self.opt("*")
                self.assign(no_in)
                return ""
        elif t == "(":
            after = k[self.match[i] + 1]
            if after == "=>":
                self.params()
                self.arrow_body(no_in)
                return ""
            if self.ts and after == ":" and not self.plain_arrow and self.attempt(self._typed_arrow):
                return ""
        elif t == "<" and self.ts and self.attempt(self._typed_arrow):
            return ""
        old = self.cover
        self.cover = False
        kind = self.conditional(no_in)
        op = k[self.i]
        if op in ASSIGN or op == ">" and self.ts and k[self.i + 1] in (">=", ">") and kind in ("id", "member") and ">=" in k[self.i + 1 : self.i + 3]:
            if op == ">":
                self.i += 1 + (k[self.i + 1] == ">")
            if kind == "pattern" and op == "=":
                self.cover = False
            elif kind not in ("id", "member"):
                self.fail()
            self.i += 1
            mine = self.cover
            self.cover = False
            self.assign(no_in)
            self.cover = self.cover or mine
            kind = ""
        self.cover = self.cover or old
        return kind

    def conditional(self, no_in: bool) -> str:
        kind = self.binary(no_in)
        if self.k[self.i] == "?":
            self.i += 1
            old = self.plain_arrow
            self.plain_arrow = False
            if not self.attempt(self._consequent):
                self.plain_arrow = True
                self._consequent()
            self.plain_arrow = old
            self.assign(no_in)
            return ""
        return kind

    def _consequent(self) -> None:
        self.assign(False)
        self.eat(":")

    def binary(self, no_in: bool) -> str:
        k = self.k
        if k[self.i] == "p" and k[self.i + 1] == "in":
            self.i += 2
            self.unary()
            kind = ""
        else:
            kind = self.unary()
        mixed = 0
        while True:
            t = k[self.i]
            if t in BINARY:
                if t in ("??", "||", "&&"):
                    mixed |= 1 if t == "??" else 2
                    if mixed == 3:
                        self.fail()
                if t == "in" and no_in:
                    return kind
                if t == ">" and self.ts:
                    j = self.i + 1
                    while k[j] == ">" and j < self.i + 3:
                        j += 1
                    if k[j] == ">=" and j - self.i <= 2:
                        return kind
                    self.i = j - 1
                self.i += 1
                self.unary()
                kind = ""
            elif self.ts and t in ("as", "satisfies") and not self.nl[self.i]:
                self.i += 1
                if not self.opt("const"):
                    self.type_()
                kind = "member" if t == "as" and kind in ("id", "member") else ""
            else:
                return kind

    def unary(self) -> str:
        k = self.k
        t = k[self.i]
        if t in UNARY:
            self.i += 1
            self.unary()
            return ""
        if t in ("++", "--"):
            self.i += 1
            if self.unary() not in ("id", "member"):
                self.fail()
            return ""
        if t == "await" and not self.nl[self.i + 1] and (k[self.i + 1] in IDS or k[self.i + 1] in ("s", "0", "t", "th", "new", "this", "import", "super", "function", "class", "null", "true", "false", "{", "[", "(", "!", "typeof")):
            self.i += 1
            self.unary()
            return ""
        if t == "<" and self.ts:
            self.i += 1
            self.opt("const") or self.type_()
            self.eat(">")
            self.unary()
            return ""
        kind = self.lhs()
        if k[self.i] in ("++", "--") and not self.nl[self.i]:
            if kind not in ("id", "member"):
                self.fail()
            self.i += 1
            return ""
        return kind

    def args(self) -> None:
        k = self.k
        self.eat("(")
        while k[self.i] != ")":
            self.opt("...")
            old, self.cover = self.cover, False
            plain, self.plain_arrow = self.plain_arrow, False
            self.assign(False)
            if self.cover:
                self.fail()
            self.cover, self.plain_arrow = old, plain
            if k[self.i] != ")":
                self.eat(",")
        self.i += 1

    def template(self) -> None:
        if self.opt("t"):
            return
        self.eat("th")
        self.expression_inside()
        while self.opt("tm"):
            self.expression_inside()
        self.eat("tt")

    def expression_inside(self) -> None:
        old = self.cover
        self.expression()
        self.cover = old

    def _call_type_args(self) -> None:
        self.type_args()
        t = self.k[self.i]
        if t in ("(", "t", "th"):
            return
        if t in IDS or t in ("0", "s", "[", "{", "!", "+", "-", "new", "this", "function", "typeof", "<", "r"):
            self.fail()

    def lhs(self) -> str:
        k = self.k
        t = k[self.i]
        if t == "new":
            self.i += 1
            if self.opt("."):
                self.any_name()
                kind = ""
            else:
                self.new_target()
                kind = ""
        elif t == "import":
            self.i += 1
            if self.opt("."):
                self.any_name()
            elif k[self.i] == "(":
                self.args()
            else:
                self.fail()
            kind = ""
        elif t == "super":
            self.i += 1
            if k[self.i] not in (".", "(", "["):
                self.fail()
            kind = ""
        else:
            kind = self.primary()
        while True:
            t = k[self.i]
            if t == ".":
                self.i += 1
                self.any_name()
                kind = "member"
            elif t == "?.":
                self.i += 1
                if k[self.i] == "(":
                    self.args()
                elif k[self.i] == "[":
                    self.i += 1
                    self.expression_inside()
                    self.eat("]")
                elif self.ts and k[self.i] == "<":
                    self.type_args()
                    self.args()
                else:
                    self.any_name()
                kind = ""
            elif t == "[":
                self.i += 1
                self.expression_inside()
                self.eat("]")
                kind = "member"
            elif t == "(":
                self.args()
                kind = ""
            elif t == "t" or t == "th":
                self.template()
                kind = ""
            elif self.ts and t == "!" and not self.nl[self.i]:
                self.i += 1
            elif self.ts and t == "<" and kind in ("id", "member", "") and self.attempt(self._call_type_args):
                kind = ""
            else:
                return kind

    def new_target(self) -> None:
        k = self.k
        if k[self.i] == "new":
            self.i += 1
            self.new_target()
        else:
            self.primary()
            while True:
                if self.opt("."):
                    self.any_name()
                elif k[self.i] == "[":
                    self.i += 1
                    self.expression_inside()
                    self.eat("]")
                else:
                    break
        if self.ts and k[self.i] == "<":
            self.attempt(self._call_type_args)
        if k[self.i] == "(":
            self.args()

    def primary(self) -> str:
        k = self.k
        t = k[self.i]
        if t == "n":
            self.i += 1
            return "id"
        if t in ("0", "s", "r", "this", "null", "true", "false"):
            self.i += 1
            return ""
        if t == "t" or t == "th":
            self.template()
            return ""
        if t == "(":
            self.i += 1
            old, self.cover = self.cover, False
            plain, self.plain_arrow = self.plain_arrow, False
            kind = self.expr()
            if self.cover:
                self.fail()
            self.cover, self.plain_arrow = old, plain
            self.eat(")")
            return kind if kind in ("id", "member") else ""
        if t == "[":
            self.i += 1
            plain, self.plain_arrow = self.plain_arrow, False
            while k[self.i] != "]":
                if self.opt(","):
                    continue
                self.opt("...")
                self.assign(False)
                if k[self.i] != "]":
                    self.eat(",")
            self.i += 1
            self.plain_arrow = plain
            return "pattern"
        if t == "{":
            plain, self.plain_arrow = self.plain_arrow, False
            self.object()
            self.plain_arrow = plain
            return "pattern"
        if t == "function" or t == "async" and k[self.i + 1] == "function" and not self.nl[self.i + 1]:
            self.opt("async")
            self.eat("function")
            gen = self.opt("*")
            if k[self.i] in IDS:
                self.i += 1
            self.signature()
            self.body(gen)
            return ""
        if t == "class" or t == "@":
            self.decorators()
            self.class_(False)
            return ""
        if t in IDS:
            self.i += 1
            return "id"
        self.fail()
        return ""

    def object(self) -> None:
        k = self.k
        self.i += 1
        while k[self.i] != "}":
            if self.opt("..."):
                self.assign(False)
            else:
                gen = False
                if k[self.i] in ("async", "get", "set") and k[self.i + 1] not in (",", ":", "(", "}", "=", "<"):
                    self.i += 1
                gen = self.opt("*")
                t = k[self.i]
                self.prop_name()
                if t == "p":
                    self.fail()
                u = k[self.i]
                if u == ":" and not gen:
                    self.i += 1
                    self.assign(False)
                elif u == "(" or u == "<" and self.ts:
                    self.signature()
                    self.body(gen)
                elif t in IDS and not gen:
                    if self.opt("="):
                        self.assign(False)
                        self.cover = True
                else:
                    self.fail()
            if k[self.i] != "}":
                self.eat(",")
        self.i += 1


_HTML_LIKE = re.compile(r"(?m)^[ \t]*(?:<!--|-->)[^\n]*")


def _parses(text: str, ts: bool) -> None:
    usual = sys.getrecursionlimit()
    try:
        for frames in (max(usual, USUAL_FRAMES), MAX_FRAMES):  # a limit of this parser, not of the grammar; its frames take no C stack
            sys.setrecursionlimit(frames)
            try:
                return Parser(text, ts).program()
            except RecursionError:  # after the last: the lexer with its stack found nothing
                continue
    finally:
        sys.setrecursionlimit(usual)


def problem(text: str, ts: bool) -> str | None:
    """Why the text is neither a script nor a module of the language, or None."""
    try:
        _parses(text, ts)
    except Bad as e:
        if ("<!--" in text or "-->" in text) and not re.search(r"(?m)^\s*(?:import|export)\b", text):  # comments of scripts alone
            try:
                return _parses(_HTML_LIKE.sub("", text), ts)
            except Bad:
                pass
        return "merge conflict" if str(e) == "syntax" and re.search(r"(?m)^(?:<{7} |>{7} |={7}\r?$)", text) else str(e)
    return None
