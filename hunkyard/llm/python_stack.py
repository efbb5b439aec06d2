"""Lexer and pushdown automaton of Python, for the question where a text stops being Python.

The lexer keeps brackets and indentation on stacks; for each logical line a small automaton knows whether an operand or
an operator must come next, what each open bracket, condition and lambda still waits for, and which blocks may follow which.
It wants no tree and uses no recursion, so depth is no limit.
"""

from __future__ import annotations

import re

# The reserved words of the language by their place.
VALUES = frozenset("None True False".split())
COMPOUND = frozenset("if while for with try def class async".split())
FOLLOWERS = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except"), "except": ("try", "except"), "finally": ("try", "except", "else")}
ALONE = frozenset("pass break continue".split())
RESERVED = COMPOUND | VALUES | ALONE | frozenset("and as assert await del elif else except finally from global import in is lambda nonlocal not or raise return yield".split())
BINARY = frozenset("+ - * / // % @ ** & | ^ << >> < > <= >= == != and or in is".split())
AUGMENTED = frozenset("+= -= *= /= //= %= @= **= &= |= ^= <<= >>=".split())
KEYED = RESERVED | {"...", "match", "case", "type"}
MAX_SEEN = 100_000
_seen: dict[tuple[str, ...], str] = {}
PAIR = {"(": ")", "[": "]", "{": "}"}

_TOKEN = re.compile(
    r"[ \t\f]*(?:\\\r?\n[ \t\f]*)*(?:(#[^\n]*)|(\r?\n)"
    r"|((?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?:'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|(?!'{3})'(?:[^'\\\n]|\\[\s\S])*'|(?!\"{3})\"(?:[^\"\\\n]|\\[\s\S])*\"))"
    r"|([^\W\d]\w*)"
    r"|((?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))"
    r"|(\*\*=|//=|>>=|<<=|\.\.\.|:=|->|[+\-*/%@&|^]=|==|!=|<=|>=|\*\*|//|<<|>>|[+\-*/%@&|^~<>()\[\]{},:.;=])|(\Z)|([\s\S]))"
)
_COMMENT, _NEWLINE, _STRING, _WORD, _NUMBER, _SIGN, _STOP, _OTHER = range(1, 9)
_KINDS = ("", "c", "l", "s", "w", "n", "o")
_CONFLICT = re.compile(r"(?:<{7} |>{7} |={7}\r?\n)")


_OPENING = re.compile(r"([rRbBuUfF]{0,2})('{3}|\"{3}|'|\")")
_INSIDE = re.compile(r"\{\{|\}\}|[{\n\\]|'{3}|\"{3}|'|\"")
_BRACED = re.compile(r"[{}()\[\]\n#]|[rRbBuUfF]{0,2}(?:'{3}|\"{3}|'|\")")


class Bad(Exception):
    """Why a text is no Python."""


def _formatted_end(text: str, at: int) -> int:
    """The end of the formatted string that begins at ``at``; values in braces may hold strings with the same quotes."""
    stack: list[str] = []
    while True:
        if not stack or stack[-1] in "{([":
            m = _OPENING.match(text, at) if not stack else _BRACED.search(text, at)
            if not m:
                raise Bad("unterminated literal")
            at = m.end()
            if m[0] in ("{", "(", "["):
                stack.append(m[0])
            elif m[0] in ("}", ")", "]"):
                if PAIR[stack.pop()] != m[0]:
                    raise Bad("unbalanced delimiter")
            elif m[0] not in ("\n", "#"):
                o = _OPENING.match(m[0])
                stack.append(o[1].lower() + o[2])  # type: ignore[index]
            continue
        quote = stack[-1].lstrip("rbuf")
        m = _INSIDE.search(text, at)
        if not m or m[0] == "\n" and len(quote) == 1:
            raise Bad("unterminated literal")
        at = m.end()
        if m[0] == "\\":
            at += 1
        elif m[0] == "{" and "f" in stack[-1]:
            stack.append("{")
        elif m[0].startswith(quote):
            at = m.start() + len(quote)
            stack.pop()
            if not stack:
                return at


class _Frame:
    """An open bracket, or the logical line itself: what it is, and what it still waits for."""

    __slots__ = ("opener", "call", "waits", "comprehension", "colons", "empty")

    def __init__(self, opener: str, call: bool = False):
        self.opener, self.call = opener, call
        self.waits: list[str] = []  # "if" waits for else, "for" for in, "lambda" for its colon
        self.comprehension, self.colons, self.empty = False, 0, True


def _statement(tokens: list[tuple[str, str]]) -> str:
    """Checks one logical line; the word that opens a block, or an empty text where none is opened."""
    first = tokens[0][1] if tokens[0][0] == "w" else ""
    at = 1
    if first == "async":
        if len(tokens) < 2 or tokens[1][1] not in ("def", "for", "with"):
            raise Bad("misplaced word")
        first, at = tokens[1][1], 2
    soft = first in ("match", "case", "type") and len(tokens) > 1 and (tokens[1][0] in "wns" and tokens[1][1] not in ("is", "in", "and", "or", "if", "not", "else", "for") or tokens[1][1] in ("[", "(", "{", "*", "-"))
    if first == "type":
        soft = soft and tokens[1][0] == "w" and tokens[1][1] not in RESERVED
    if soft and first in ("match", "case") and tokens[-1][1] != ":" and not any(t == ":" for _, t in tokens[1:]):
        soft = False
    header = first in COMPOUND or first in FOLLOWERS or soft and first in ("match", "case")
    if not header and first not in ("return", "raise", "del", "assert", "import", "from", "global", "nonlocal", "pass", "break", "continue") and not (first == "type" and soft):
        at = 0
    if first in ("try", "finally") and tokens[at:at + 1] != [("o", ":")] or first == "else" and tokens[at:at + 1] != [("o", ":")]:
        raise Bad("missing colon")
    if first in ("def", "class") or first == "type" and soft:
        if at >= len(tokens) or tokens[at][0] != "w" or tokens[at][1] in RESERVED:
            raise Bad("missing name")
        at += 1
        if first == "def" and (at >= len(tokens) or tokens[at][1] not in "(["):
            raise Bad("missing parameters")
        # parameters and bases are brackets behind a name
        return _expression(tokens, at, first, header, False)
    if first in ("import", "from", "global", "nonlocal"):
        return _names(tokens, first)
    if first in ALONE and len(tokens) > 1 and tokens[1][1] != ";":
        raise Bad("adjacent operands")
    return _expression(tokens, at, first if header or at else "", header, True)


def _names(tokens: list[tuple[str, str]], first: str) -> str:
    """An import, or a list of names."""
    cut = next((i for i, t in enumerate(tokens) if t[1] == ";"), len(tokens))
    text = " ".join("n" if k == "w" and t not in RESERVED else t for k, t in tokens[:cut])
    dotted, name = r"n(?: \. n)*", r"n(?: as n)?"
    form = {
        "import": rf"import {dotted}(?: as n)?(?: , {dotted}(?: as n)?)*",
        "from": rf"from (?:(?:\.|\.\.\.)(?: (?:\.|\.\.\.))* )?(?:{dotted} )?import (?:\*|{name}(?: , {name})*|\( {name}(?: , {name})*(?: ,)? \))",
        "global": r"global n(?: , n)*",
        "nonlocal": r"nonlocal n(?: , n)*",
    }[first]
    if not re.fullmatch(form, text) or first == "from" and text.startswith("from import"):
        raise Bad("misplaced word")
    return _statement(tokens[cut + 1 :]) if cut + 1 < len(tokens) else ""


def _expression(tokens: list[tuple[str, str]], at: int, first: str, header: bool, operand: bool) -> str:
    """The automaton: ``operand`` says that an operand must come next."""
    stack = [_Frame("")]
    start = at
    bare = not header  # whether assignments may stand here
    optional = first in ("return", "raise", "except", "else", "try", "finally", "pass", "break", "continue")
    annotated = assigned = signs = False
    if first == "for":
        stack[-1].waits.append("for")
    prev = ""
    n = len(tokens)
    i = at
    while i < n:
        k, t = tokens[i]
        f = stack[-1]
        top = len(stack) == 1
        i += 1
        was, prev = prev, t
        if k == "w" and t not in RESERVED or k in "ns" or t in VALUES or t == "...":
            if not operand:
                if k == "s" and tokens[i - 2][0] == "s":
                    continue
                raise Bad("adjacent operands")
            operand = f.empty = False
            continue
        if k == "w":
            if operand:
                if t in ("not", "await"):
                    continue
                if t == "lambda":
                    f.waits.append("lambda")
                    if i < n and tokens[i][1] == ":":
                        f.waits.pop()
                        i += 1
                    continue
                if t == "yield":
                    f.empty = False
                    if i < n and tokens[i][1] == "from":
                        i += 1
                    elif i >= n or tokens[i][1] in (")", "]", "}", ",", ";", "="):
                        operand = False
                    continue
                if t == "for" and top and not bare and first == "async":
                    continue
                raise Bad("misplaced word")
            if t == "not":
                if i < n and tokens[i][1] == "in":
                    i += 1
                    operand = True
                    continue
                raise Bad("adjacent operands")
            if t == "is":
                if i < n and tokens[i][1] == "not":
                    i += 1
                operand = True
            elif t in BINARY:
                if t == "in" and f.waits and f.waits[-1] == "for":
                    f.waits.pop()
                operand = True
            elif t == "if":
                if not (f.comprehension and not f.waits) and not (first == "case" and top):
                    f.waits.append("if")
                elif f.comprehension and _else_follows(tokens, i):
                    f.waits.append("if")
                operand = True
            elif t == "else":
                if not f.waits or f.waits[-1] != "if":
                    raise Bad("misplaced word")
                f.waits.pop()
                operand = True
            elif t in ("for", "async") and not top:
                if t == "async":
                    if i >= n or tokens[i][1] != "for":
                        raise Bad("misplaced word")
                    i += 1
                if "if" in f.waits:
                    raise Bad("missing else")
                f.comprehension = True
                f.waits.append("for")
                operand = True
            elif t == "as" and (first in ("with", "except", "case", "match") or not top and first == "with"):
                operand = True
            elif t == "from" and first == "raise" and top:
                operand = True
            else:
                raise Bad("adjacent operands")
            continue
        if t in PAIR:
            if operand:
                stack.append(_Frame(t))
                f.empty = False
            else:
                if t == "{":
                    raise Bad("adjacent operands")
                stack.append(_Frame(t, True))
            operand = True
            continue
        if t in ")]}":
            if top:
                raise Bad("unbalanced delimiter")
            if PAIR[f.opener] != t:
                raise Bad("unbalanced delimiter")
            if operand and not (f.empty and not (f.opener == "[" and f.call)) and was not in (",", ":") and not (was == "*" and first == "def") and not (was == "/" and first == "def"):
                raise Bad("missing operand")
            if operand and was == ":" and not (f.opener == "[" and f.call):
                raise Bad("missing operand")
            if f.waits:
                raise Bad("missing else" if f.waits[-1] == "if" else "misplaced word")
            stack.pop()
            operand = False
            continue
        if t == ",":
            if top and first == "raise":
                raise Bad("misplaced sign")
            if operand and not (was == ":" and f.opener == "[" and f.call) and not (was in ("*", "/") and (first == "def" or "lambda" in f.waits)):
                raise Bad("missing operand")
            if "if" in f.waits and f.waits[-1] == "if":
                raise Bad("missing else")
            operand, f.empty = True, False
            if top and (i >= n or tokens[i][1] in ("=", ";", ":")):
                operand = False
            continue
        if t == ":":
            if f.waits and f.waits[-1] == "lambda":
                if operand and was not in (",", "*", "/"):
                    raise Bad("missing operand")
                f.waits.pop()
                operand = True
                continue
            if f.waits:
                raise Bad("missing else" if f.waits[-1] == "if" else "misplaced word")
            if not top:
                if f.opener == "[" and f.call:
                    operand, f.empty = True, False
                    continue
                if operand or f.opener == "[" or f.opener == "(" and not (f.call and first == "def" and len(stack) == 2):
                    raise Bad("missing operand" if operand else "misplaced sign")
                operand = True
                continue
            if header:
                if operand and not (i - 1 == start and first in ("else", "try", "finally", "except")) and not (was == "," and first in ("for", "case", "match")):
                    raise Bad("missing operand")
                if i < n:
                    if tokens[i][0] == "w" and tokens[i][1] in COMPOUND | set(FOLLOWERS):
                        raise Bad("misplaced word")
                    _statement(tokens[i:])
                    return "inline " + first
                return first
            if operand or annotated or assigned or first:
                raise Bad("missing operand" if operand else "misplaced sign")
            annotated = operand = True
            signs = False
            continue
        if t == ";":
            if not top:
                raise Bad("unbalanced delimiter")
            if header:
                raise Bad("missing colon")
            break
        if t == "=":
            if top:
                if header or first and first != "type" or operand or not annotated and (signs or tokens[i - 2][0] in "ns" or was in ("yield", "None", "True", "False")):
                    raise Bad("missing operand" if operand else "misplaced sign")
                assigned = True
            elif operand or not (f.call or "lambda" in f.waits) or f.opener == "[" and first not in ("def", "class", "type"):
                raise Bad("missing operand" if operand else "misplaced sign")
            operand = True
            continue
        if t in AUGMENTED:
            if operand or not top or not bare or first:
                raise Bad("misplaced sign")
            operand = assigned = True
            continue
        if t == ":=":
            if operand or tokens[i - 2][0] != "w" or top and bare:
                raise Bad("misplaced sign")
            operand = True
            continue
        if t == ".":
            if operand or i >= n or tokens[i][0] != "w" or tokens[i][1] in RESERVED:
                raise Bad("missing name")
            i += 1
            prev = "n"
            continue
        if t == "->":
            if operand or not (top and first == "def"):
                raise Bad("misplaced sign")
            operand = True
            continue
        if operand:
            if t in ("+", "-", "~"):
                signs = signs or top
                continue
            if t == "*" and (was in ("", ",", "(", "[", "{", "in", "=", "return", "yield", "lambda", "for", ":") or i == start + 1):
                continue
            if t == "**" and (was in (",", "(", "{", "lambda")) and f.opener != "[":
                if i < n and tokens[i][1] in (")", ",", "}"):
                    raise Bad("missing operand")
                continue
            if t == "/" and was == "," and (first == "def" or "lambda" in f.waits):
                continue
            raise Bad("missing operand")
        if t not in BINARY:
            raise Bad("misplaced sign")
        operand, signs = True, signs or top
    if len(stack) > 1:
        raise Bad("premature end")
    if header:
        raise Bad("missing colon")
    if stack[0].waits:
        raise Bad("missing else" if stack[0].waits[-1] == "if" else "misplaced word")
    if operand and not (i - (prev == ";") == start and optional) and not (start == i and not first):
        raise Bad("missing operand")
    if prev == ";" and i < n:
        return _statement(tokens[i:])
    return ""


def _else_follows(tokens: list[tuple[str, str]], at: int) -> bool:
    """Whether a condition inside a comprehension has its else before the bracket ends or the next part begins."""
    depth = 0
    for k, t in tokens[at:]:
        if t in PAIR:
            depth += 1
        elif t in (")", "]", "}"):
            depth -= 1
            if depth < 0:
                return False
        elif not depth and k == "w":
            if t == "else":
                return True
            if t in ("if", "for"):
                return False
    return False


def _number(text: str, token: str, end: int) -> None:
    """Raises where a number runs into a name, or begins with zeros that it may not have."""
    if token[0] == "0" and re.fullmatch(r"0[\d_]*[1-9][\d_]*", token):
        raise Bad("invalid literal")
    if end < len(text) and (text[end].isalnum() or text[end] == "_") and not re.match(r"(?:and|else|for|if|in|is|or|not)\b", text[end:]):
        raise Bad("invalid literal")


class _Lines:
    """The logical lines of a text, checked one by one, with the blocks they stand in."""

    def __init__(self) -> None:
        self.indents = [0]
        self.last: dict[int, str] = {}
        self.wants_block = False

    def begin(self, column: int) -> None:
        """A logical line begins at this column: it opens the block that the line above asked for, or closes some."""
        indents, last = self.indents, self.last
        if self.wants_block:
            if column <= indents[-1]:
                raise Bad("missing block")
            indents.append(column)
            last[column] = ""
        elif column > indents[-1]:
            raise Bad("unexpected indent")
        else:
            while column < indents[-1]:
                if last.pop(indents.pop(), "") == "try":
                    raise Bad("missing block")
            if column != indents[-1]:
                raise Bad("unexpected indent")
        self.wants_block = False

    def check(self, line: list[tuple[str, str]]) -> None:
        level = self.indents[-1]
        if self.last.get(level) == "try" and line[0][1] not in ("except", "finally"):
            raise Bad("missing block")
        if len(line) > 1 and line[0] == ("o", "@"):
            _expression(line, 1, "", False, True)
            return
        # a line's verdict rests on its kinds, signs and reserved words alone, and lines of one shape are many
        shape = tuple([t if k == "o" or t in KEYED else k for k, t in line])
        word = _seen.get(shape)
        if word is None:
            word = _statement(line)
            if len(shape) < 100:
                if len(_seen) >= MAX_SEEN:
                    _seen.clear()
                _seen[shape] = word
        if not word:
            self.last[level] = ""
            return
        opened = word.rpartition(" ")[2]
        if opened in FOLLOWERS and self.last.get(level) not in FOLLOWERS[opened]:
            raise Bad("misplaced word")
        self.last[level] = opened
        self.wants_block = not word.startswith("inline")


def _scan(text: str) -> None:
    lines, line, brackets = _Lines(), [], []
    fresh, at = True, 0
    while True:
        for m in _TOKEN.finditer(text, at):
            k = m.lastindex
            if k == _COMMENT:
                continue
            if k == _NEWLINE:
                if not brackets:
                    if line:
                        lines.check(line)
                        line = []
                    fresh = True
                continue
            if k == _STOP:
                if brackets:
                    raise Bad("premature end")
                if line:
                    lines.check(line)
                if lines.wants_block or "try" in lines.last.values():
                    raise Bad("premature end")
                return
            t = m[k]
            if k == _OTHER:
                raise Bad("unterminated literal" if t in "\"'" else "invalid character")
            if fresh:
                if t in ("<<", "==", ">>") and _CONFLICT.match(text, m.start(k)):
                    raise Bad("merge conflict")
                gap = text[m.start() : m.start(k)]
                lines.begin(len(gap.rpartition("\f")[2].expandtabs(8)) if gap else 0)
                fresh = False
            if k == _SIGN:
                if t in PAIR:
                    brackets.append(PAIR[t])
                elif t in ")]}" and (not brackets or brackets.pop() != t):
                    raise Bad("unbalanced delimiter")
            elif k == _NUMBER:
                _number(text, t, m.end())
            elif k == _STRING and "{" in t and "f" in t[:2].lower():
                at = _formatted_end(text, m.start(k))
                line.append(("s", t))
                break
            line.append((_KINDS[k], t))


def python_problem(text: str) -> str | None:
    """Why the text is no Python, as far as lexer, stacks and the automaton of lines can tell, or None."""
    try:
        _scan(text)
    except Bad as e:
        return "merge conflict" if re.search(r"(?m)^(?:<{7} |>{7} |={7}\r?$)", text) else str(e)
    return None
