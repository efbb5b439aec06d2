"""Working credentials inside code and configuration: found with their line, and masked.

Method: encoded layers (base64, hex, percent, escapes) are decoded until none is left and rescanned, key containers are
parsed by their binary grammar, and what is masked is the whole enclosing encoded literal. Each text is one row, so the
work is a single pass without a shuffle; texts are read whole.
"""

from __future__ import annotations

import base64
import binascii
import re
import urllib.parse
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from hunkyard.session import spread

# Beginnings and forms of issued tokens.
TOKEN = re.compile(
    r"(?<![A-Za-z0-9_])(?:AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|npm_[A-Za-z0-9]{30,}|glpat-[\w-]{18,}|AIza[\w-]{30,}"
    r"|xox[abeprs]-[A-Za-z0-9-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|pypi-[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{40,}|shpat_[a-f0-9]{30,}"
    r"|(?!(?:id|ref|rev|sha|md|ver|tag|git|uid|etag|hash|sum|crc|img|pub|cert)[_:-])[a-z]{2,4}[_:-](?=[A-Za-z0-9_-]*[A-Z])(?=[A-Za-z0-9_-]*[a-z])(?=[A-Za-z0-9_-]*\d)[A-Za-z0-9_-]{20,}|eyJ[\w-]{10,}\.eyJ[\w-]{10,}\.[\w-]{20,})(?![A-Za-z0-9_=])"
)
URL = re.compile(r"(?i)\b[a-z][a-z0-9+.-]{1,20}://([^\s:/@\"'`<>]*):([^\s/@\"'`]+)@[\w.\[-]")
AUTH = re.compile(r"(?i)\b(bearer|basic|token)\s+([A-Za-z0-9+/_.~:=%!-]{8,})")
HEADER = re.compile(r"(?i)\b(x-[a-z-]*(?:key|token|auth|secret)|authorization|private-token|api-key)['\"]?\s*[:=,]\s*['\"]?\s*([^\s'\"`,;]{8,})")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
BLOB = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
LITERAL = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`((?:[^`\\\n]|\\.)*)`')
# An unquoted value of configuration or of a comment; a line's first sign may be the mark of a patch.
VALUE = re.compile(r"(?:(?<=[\s=:,;(\[{])|^([+-]?))((?:[A-Za-z0-9+/_-]{16,}={0,2}|(?=[^\s\"'`=:,;(\[{]*(?:%[0-9a-fA-F]{2}|\\[xu0-7]))[^\s\"'`=:,;(\[{]{16,})(?![A-Za-z0-9+/_=%\\-]))")
# A line that ends with a part of an encoded value, and a line that is such a part as a whole, with its quotes and glue.
PART_END = re.compile(r"(?:(?<![A-Za-z0-9+/_=-])|(?<==))(?:(?P<blob>[A-Za-z0-9+/_-]{16,}={0,2})[\"'`]{0,3}[ \t]*[\\,+.&]{0,2}|(?<=[\"'`])(?P<quoted>[^\s\"'`]{2,})[\"'`][ \t]*(?:[\\+&]|\.\.?)?)[ \t]*\r?\n")
PART = re.compile(r"[ \t]*[ \t>*#/]{0,8}?(?:[rbuf]{0,2}([\"'`]{1,3}))?([A-Za-z0-9+/_-]{2,}={0,2}|(?<=[\"'`])[^\s\"'`]{2,})([\"'`]{0,3})[ \t]*[\\,+.&;)\]}]*[ \t]*\r?(?:\n|\Z)")
GLUE = re.compile(r"\s*(?:\+|\.|&|\.\.)?\s*\Z")
NAMED = re.compile(r"([A-Za-z_$][\w$.-]*?)[\"']?\]?\s*(?:\??:\s*(?:[&\w<>\[\]' |]+\s*)?=|:=|=>|=|:|\|\||\?\?|,)\s*(?:[rbuf]{0,2}|@)\Z")
DEFAULTED = re.compile(r"([A-Za-z_$][\w$.-]*)[\"']?\]?\s*\)?\s*(?:\|\||\?\?|or)\s*\Z")
CALL = re.compile(r"[A-Za-z_][\w.]*\s*\(\s*[\"'`](?:[a-z][a-z0-9+.-]*://)?[\w-]+(?:\.[\w-]+)+(?::\d+)?(?:/[^\"'`]*)?[\"'`]\s*,\s*\Z")
FLAG = re.compile(r"--?([A-Za-z][\w-]*)[ =]\s*\Z")
SQL = re.compile(r"(?i)\b(password|identified\s+by)\s*(?:=\s*)?\Z")
BARE = re.compile(r"(?<![\w.$/])([A-Za-z_][\w.-]*)(?:\"|')?\s*(?:=|:)\s*([^\s\"'`,;(){}\[\]]{6,})")
SHELL_DEFAULT = re.compile(r"\$\{([A-Za-z_]\w*):?[-=]([^}\s]{6,})\}")
TOLD = re.compile(r"(?i)\b(?:pw|pwd|pass|passwd|password|passphrase|key|login|token|secret|credentials?)\b(?:\s+(?:for|of)\s+\S+)?\s+is\s+(\S{6,})")
LOGIN = re.compile(r"(?i)\blog ?in\b\s+(?:at\s+\S+\s+with\s+)?`?[\w.-]+`?\s*(?:/|and|with)\s*`?([^\s`]{6,})`?")
PAIR = re.compile(r"[\s`'\"(](?:[a-z]+_[a-z_]+|[a-z]+)\s+/\s+(\S{6,})\s+(?:works|is valid|for|on|at)\b")
USER_FLAG = re.compile(r"(?:\s-u|--user)[ =]['\"]?[\w.-]+:([^\s'\"]{6,})")
ROTATE = re.compile(r"(?i)\b(?:rotate|revoke|expire)\s+(\S{16,})")
COMMENT = re.compile(r"^[+\- ]?\s*(?:#|//|--|/\*|\*|;|<!--)")
# Words of names that hold secrets, and last words that make a name speak about one.
SECRET_WORDS = frozenset("password passwd passwort passphrase passcode pwd pw pass secret token credential credentials bearer contrasena clave zugangsschluessel kennwort senha mdp login auth pin".split())
SECRET_PAIRS = frozenset("api_key apikey service_key signing_key license_key hmac_key deploy_key tls_key client_key private_key secret_key access_key encryption_key master_key ssh_key server_key account_key key_material mot_de mot_passe ssh_identity server_pem signing_pem storage_key session_key jwt_key aes_key".split())
ABOUT_WORDS = frozenset("header field label name names hash ref pub public ttl length id ids file path url uri size count type cert certificate digest algorithm kind prefix suffix policy min max env var column index map list code expiry expires regex pattern rule rules format hint title scope scopes endpoint provider method host user username verify peer known cache required enabled rotation page form view reset limit budget parser".split())
DROPPED_WORDS = frozenset("old new prod main tmp legacy alt eu us dev staging test backup default current v value str string".split())
PLACEHOLDER = re.compile(
    r"(?i)^(?:.*(?:change_?-?me|replace|your[_ -]|example|insert|dummy|placeholder|redacted|set-?me|fix-?me|todo|not[_ -]?set|lorem|foobar|sample|default_|fake|mock).*|<.*>|\$\{?\w*\}?|\$\{[^-=}]*\}|\{\{.*\}\}|\{[^}]*\}|%\w*%|%\(.*\)s|#\{.*\}|\$\(.*\)"
    r"|(?:env|vault|ssm|secret|secrets|file|ref|arn|kms|op|sops)[:/].*|none|null|nil|true|false|undefined|os\.environ.*|process\.env.*|.*\.\.\.|[*.xX\-_•0]+|.*X{6,}.*|.*\*{4,}.*|(.)\1*)$"
)
NOT_SECRET = re.compile(r"^(?:ssh-[a-z0-9]+ AAAA|ecdsa-|iVBORw0KGgo|/9j/|R0lGOD|data:|sha\d+-|sha\d+:|h1:|-----BEGIN (?:[A-Z0-9]+ )*(?:CERTIFICATE|PUBLIC KEY))")
WORDS_ONLY = re.compile(r"^[A-Za-z]+(?:[ _/.:-][A-Za-z]+)*$")
PHRASE = re.compile(r"^[A-Za-z]{3,}(?:[-_. ][A-Za-z]{3,}){2,}$")
UUID = re.compile(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
STRONG = re.compile(r"^(?:(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9+/_=.!%$#@^&*~:-]{8,})$")


def _words() -> str:
    """What the name of a secret has in it, in small letters: a word of the list, or a pair with no letter between."""
    words: list[str] = []
    for w in sorted(SECRET_WORDS, key=lambda w: (len(w), w)):
        if not any(k in w for k in words):
            words.append(w)
    pairs: dict[str, list[str]] = {}
    for a, b in (p.split("_") for p in sorted(SECRET_PAIRS) if "_" in p):
        pairs.setdefault(b, []).append(a)
    return "|".join([*words, *(f"(?:{'|'.join(a)})[^a-z\\s]*{b}" for b, a in pairs.items())])


# Lines that any rule below can hit, in small letters: all others are passed over. Wider than the rules, never narrower.
CANDIDATE = re.compile(
    _words() + r"|basic|log in|key\s|x-[a-z-]*key|identified\s+by|(?:rotate|revoke|expire)\s|\s-u[ =]|--user[ =]|[a-z]\s+/\s+\S|ref\w*[\"']?\]?\s*\)?\s*(?:[:=,|?\"'`]|or\b)"
    r"|\(\s*['\"`][^'\"`\n]*\.[^'\"`\n]*['\"`]\s*,\s*['\"`]|://[^\s/@:]*:[^\s/@]+@|-----begin"
    r"|akia|asia[a-z0-9]{16}|gh[pousr]_|github_pat_|npm_|glpat-|aiza|xox[abeprs]-|[sr]k_(?:live|test)_|pypi-|sg\.[\w-]{16}|hf_|dop_v1_|shpat_|(?<![a-z0-9_])[a-z]{2,4}[_:-][a-z0-9_-]{20}|eyj"
    r"|\\|%[0-9a-f]{2}|[\"'`](?:[a-z0-9+/_-]{16,}={0,2}|\s*(?:\+|\.\.?|&)?\s*)[\"'`]"
    r"|^[+\- ]?[^\S\n]*(?:#|//|--|/\*|\*|;|<!--)[^\n]*?(?<![a-z0-9+/_-])[a-z0-9+/_-]{16}",
    re.M,
)
CANDIDATE_CONFIG = re.compile(CANDIDATE.pattern + r"|(?<![a-z0-9+/_-])[a-z0-9+/_-]{16}", re.M)


@lru_cache(50_000)
def names_secret(name: str) -> bool:
    """Whether a variable, key or option of this name holds a secret, rather than speaks about one."""
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.rpartition(".")[2].strip("\"'")).lower()
    parts = [w for w in re.split(r"[^a-z]+", words) if w]
    while parts and parts[-1] in DROPPED_WORDS:
        parts.pop()
    while parts and parts[0] in DROPPED_WORDS:
        parts.pop(0)
    if not parts or parts[-1] in ABOUT_WORDS or parts[0] in ("public", "verify", "peer", "known", "csrf"):
        return False
    if any(p in SECRET_WORDS for p in parts) and not (parts[-1] not in SECRET_WORDS and len(parts) > 2 and parts[-1] != "key"):
        return True
    return any(f"{a}_{b}" in SECRET_PAIRS for a, b in zip(parts, parts[1:])) or parts[-1] in ("apikey",) or "mot_de_passe" in "_".join(parts)


def placeholder(v: str) -> bool:
    v = v.strip()
    return len(v) < 6 or bool(PLACEHOLDER.match(v)) or bool(NOT_SECRET.match(v))


def strong(v: str) -> bool:
    """A value under a secret's name that is more than words: digits, signs, mixed case or several words."""
    if placeholder(v) or re.search(r"\s", v) and not PHRASE.match(v):
        return False
    if WORDS_ONLY.match(v):
        return bool(re.fullmatch(r"[a-z]{3,}(?:-[a-z]{3,}){2,}", v)) and not re.search(r"pass|secret|token|key|auth", v) or bool(re.fullmatch(r"[A-Za-z]{16,}", v) and re.search(r"[a-z][A-Z].*[a-z][A-Z].*[a-z]*[A-Z]", v))
    return not re.fullmatch(r"(?:[a-z]+/)+[a-z_/]+|[\d.,:-]+|X(?:-[A-Z][a-z]+)+", v)


def issued(v: str) -> bool:
    """A value that stands alone, without a name: random signs, a word with digits and a mark, or several words."""
    if not strong(v) or UUID.match(v):
        return False
    return bool(PHRASE.match(v)) or bool(STRONG.match(v)) or bool(re.search(r"[!%.][0-9]", v))


def _printable(b: bytes) -> str | None:
    try:
        s = b.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return s if len(s) >= 6 and sum(c.isprintable() or c in "\r\n\t" for c in s) == len(s) else None


def key_container(b: bytes) -> bool:
    """Whether the bytes are a private key by their grammar: DER of PKCS#1, SEC1, DSA or PKCS#8, or an OpenSSH key."""
    if b[:15] == b"openssh-key-v1\0":
        return True

    def tlv(at: int) -> tuple[int, int, int] | None:
        if at + 2 > len(b):
            return None
        tag, n, at = b[at], b[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 0 < k <= 4 or at + k > len(b):
                return None
            n, at = int.from_bytes(b[at : at + k], "big"), at + k
        return (tag, at, at + n) if at + n <= len(b) else None

    top = tlv(0)
    if not top or top[0] != 0x30 or top[2] < len(b) - 4:
        return False
    tags, at, first = [], top[1], b""
    while at < top[2]:
        t = tlv(at)
        if not t:
            return False
        if not tags:
            first = b[t[1] : t[2]]
        tags.append(t[0])
        at = t[2]
    if len(tags) < 2 or tags[0] != 2 or first not in (b"\0", b"\1"):
        return False
    return tags[:3] == [2, 0x30, 4] or tags[:2] == [2, 4] or (len(tags) in (6, 9, 10) and set(tags[:6]) == {2})


def layers(v: str) -> Iterator[str | bytes]:
    """What the value reads when one layer of encoding is taken off, for each encoding it may be in."""
    if "\\" in v:
        try:
            s = re.sub(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|u\{([0-9a-fA-F]+)\}|([0-7]{3})|(.))", lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[1] or m[2] or m[3] else chr(int(m[4], 8)) if m[4] else {"n": "\n", "t": "\t", "r": "\r"}.get(m[5], m[5]), v)
            if s != v:
                yield s
        except (ValueError, OverflowError):
            pass
    if "%" in v and re.search(r"%[0-9a-fA-F]{2}", v):
        # a sign that was percent-encoded many times over takes one step, not one for each time
        s = urllib.parse.unquote(re.sub(r"%(?:25)+", "%25", v), errors="replace")
        if s != v and "\ufffd" not in s:
            yield s
    if len(v) >= 16 and re.fullmatch(r"(?:[0-9a-fA-F]{2}){8,}", v):
        b = binascii.unhexlify(v)
        yield _printable(b) or b
    elif len(v) >= 16 and re.fullmatch(r"[A-Za-z0-9+/_\s-]{16,}={0,2}", v):
        try:
            raw = re.sub(r"\s", "", v).replace("-", "+").replace("_", "/").rstrip("=")
            b = base64.b64decode(raw + "=" * (-len(raw) % 4))
            yield _printable(b) or b
        except (binascii.Error, ValueError):
            pass


def _inner(v: str, nested: list[str]) -> bool:
    """Whether a decoded text holds a credential: it is scanned as configuration, its own encoded parts go to ``nested``."""
    if PEM.search(v) and re.search(r"-----(?:\\n|\s)*[A-Za-z0-9+/=\s\\]{40,}", v):
        return True
    if any(_own(x) for x in v.split("\n")):
        return True
    for m in BARE.finditer(v):
        if names_secret(m[1]) and strong(m[2]):
            return True
    return bool(find(v, DECODED, nested))


def encoded(v: str) -> bool:
    """Whether taking encodings off, again and again, brings a credential or a private key to light.

    However many layers there are: every layer makes a text shorter, so this ends when nothing changes any more.
    """
    todo, seen = [v], {v}
    while todo:
        for s in layers(todo.pop()):
            if isinstance(s, bytes):
                if key_container(s):
                    return True
            elif s not in seen:
                seen.add(s)
                nested = [s]
                if _inner(s, nested):
                    return True
                todo += [x for x in nested if x is s or x not in seen]
                seen.update(nested)
    return False


def basic(v: str) -> bool:
    """Whether the value of a Basic header is a login with a password."""
    for s in layers(v):
        if isinstance(s, str) and ":" in s and not placeholder(s.partition(":")[2]):
            return True
    return False


def _userpass(v: str) -> bool:
    m = re.fullmatch(r"[\w.-]{3,}:(\S{6,})", v)
    return bool(m) and not placeholder(v) and strong(m[1]) and not re.search(r"^\d+$|/", m[1]) and not v.startswith(("http", "sha"))


def _own(v: str) -> tuple[int, int] | None:
    """The part of a literal that is a credential whatever its name."""
    for m in TOKEN.finditer(v):
        if not placeholder(m[0]) and not NOT_SECRET.match(v):
            return m.span()
    for m in URL.finditer(v):
        if not placeholder(m[2]):
            return m.span(2)
    for m in AUTH.finditer(v):
        if not placeholder(m[2]) and (basic(m[2]) if m[1].lower() == "basic" else re.search(r"\d", m[2]) and len(m[2]) >= 12 or PHRASE.match(m[2]) or strong(m[2]) and m[1].lower() == "bearer"):
            return m.span(2)
    for m in HEADER.finditer(v):
        if not placeholder(m[2]) and m[2].lower() not in ("bearer", "basic", "token") and strong(m[2]) and re.search(r"\d|[-!%].*[-!%]", m[2]):
            return m.span(2)
    return None


def _decode(v: str, nested: list[str] | None) -> bool:
    if nested is None:
        return encoded(v)
    nested.append(v)
    return False


def line_spans(line: str, config: bool, nested: list[str] | None = None) -> list[tuple[int, int]]:
    """The parts of one line that are credentials; ``config``: names and values stand there without quotes.

    Encoded values are decoded and scanned, or, where ``nested`` is given, only added to it.
    """
    out: list[tuple[int, int]] = []
    groups: list[list[tuple[int, int, str]]] = []
    quotes: list[tuple[int, int]] = []
    last = -1
    for m in LITERAL.finditer(line):
        k = m.lastindex or 1
        piece = (m.start(k), m.end(k), m[k])
        glued = groups and GLUE.match(line[last : m.start()]) and line[last - 1] == m[0][0]
        if glued:
            groups[-1].append(piece)
        else:
            groups.append([piece])
        quotes.append((m.start(), m.end()))
        last = m.end()
    comment = bool(COMMENT.match(line))
    for g in groups:
        v = "".join(p[2] for p in g)
        if len(v) < 6:
            continue
        start = g[0][0] - 1
        own = _own(v)
        hit = own is not None
        if not hit and not NOT_SECRET.match(v):
            before = line[:start]
            m = NAMED.search(before) or DEFAULTED.search(before) or FLAG.search(before)
            name = m[1] if m else ""
            if m and m.re is NAMED and before.rstrip().endswith(",") and not re.search(r"(?:get|getenv|environ|env|getOrDefault|fetch)\w*\s*[(\[]\s*[\"']$|(?:get|getenv|env|fetch)\w*\(\s*[\"'][\w.-]*[\"']\s*,\s*$", before[: m.start(1)] + before[m.start(1) :], re.I):
                name = ""
            if name and names_secret(name):
                hit = strong(v) or _userpass(v)
            elif SQL.search(before):
                hit = strong(v)
            elif name and re.search(r"(?i)(?:login|auth|credential|basic)", name) and _userpass(v):
                hit = True
            elif CALL.search(before) or name and len(v) >= 16 and "/" not in v[:5] and re.search(r"(?:_ref|Ref|_REF)(?:_[A-Za-z0-9]+|[A-Z0-9]\w*)?$", name):
                hit = issued(v)
            elif name and names_secret(name) is False and re.search(r"(?i)\b(?:user|login)\w*['\"]?\s*[:=]", before) and name.lower() in ("pass", "pw"):
                hit = strong(v)
            if not hit and len(v) >= 16 and ("\\" in v or "%" in v or BLOB.fullmatch(v)):
                hit = _decode(v, nested)
            if not hit and LOGIN.search(line) and re.search(r"`[\w.-]+`\s+(?:and|/|with)\s+$", before):
                hit = issued(v)
        if hit:
            if own and len(g) == 1:
                out.append((g[0][0] + own[0], g[0][0] + own[1]))
            else:
                out += [(a, b) for a, b, _ in g]
    covered = lambda a: any(s <= a < e for s, e in quotes)
    for rx, part in ((TOKEN, 0), (URL, 2)):
        for m in rx.finditer(line):
            if not covered(m.start()) and not placeholder(m[part]):
                out.append(m.span(part))
    for m in AUTH.finditer(line):
        if not covered(m.start()) and not placeholder(m[2]) and (basic(m[2]) if m[1].lower() == "basic" else re.search(r"\d", m[2]) and len(m[2]) >= 12):
            out.append(m.span(2))
    if config or comment:
        for m in BARE.finditer(line):
            if not covered(m.start(2)) and names_secret(m[1]) and strong(m[2]) and (re.search(r"\d|[!%]", m[2]) or PHRASE.match(m[2])) and not re.fullmatch(r"\d+", m[2]):
                out.append(m.span(2))
            elif not covered(m.start(2)) and re.search(r"(?i)login|auth", m[1]) and _userpass(m[2]):
                out.append(m.span(2))
        for m in VALUE.finditer(line):
            if not covered(m.start(2)):
                for v, at in ((m[2], m.start(2)), *([(m[0], m.start())] if m[1] else [])):
                    if not NOT_SECRET.match(v) and _decode(v, nested):
                        out.append((at, m.end()))
                        break
    for m in SHELL_DEFAULT.finditer(line):
        if names_secret(m[1]) and strong(m[2]):
            out.append(m.span(2))
    for rx in (TOLD, LOGIN, ROTATE, PAIR, USER_FLAG):
        m = rx.search(line)
        if m and not covered(m.start(1)) and issued(m[1].rstrip(".,;")):
            out.append((m.start(1), m.start(1) + len(m[1].rstrip(".,;"))))
    return out


def blocks(text: str, nested: list[str] | None = None) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Encoded credentials over several lines: start of the first line, end of the last, and the spans of the parts.

    Joined are lines of nothing but a part of the value, with quotes and glue around, and the end of the line in front.
    In a patch, the old and the new side are joined each for itself.
    """
    done = 0
    for m in PART_END.finditer(text):
        if m.start() < done:
            continue
        quoted = m["blob"] is None
        parts, at = [m.span(m.lastgroup or 0)], m.end()
        first = text.rfind("\n", 0, m.start()) + 1
        marks = [text[first : first + 1]]
        if parts[0][0] == first and marks[0] in "+-":  # the mark of a patch, unless lines below have none
            parts[0] = (first + 1, parts[0][1])
        while at < len(text):
            mark = text[at] if text[at] in "+- " else ""
            p = PART.match(text, at + len(mark))
            if not p or quoted and not p[1] or "-----" in p[0]:
                break
            parts.append(p.span(2))
            marks.append(mark)
            at = p.end()
        if len(parts) < 2:
            continue
        done = at
        if not all(x in "+- " and x for x in marks):  # no patch: such a sign is part of the value
            parts = [(a - 1, b) if a and text[a - 1] in "+-" and (a == 1 or text[a - 2] == "\n") else (a, b) for a, b in parts]
            marks = [" "] * len(parts)
        for other in "-+" if "-" in marks and "+" in marks else " - ":
            side = [x for x, k in zip(parts, marks) if k != other or other == " "]
            # The line in front may end with a word that is no part; the last lines may be code already.
            hit = next((h for h in (side, side[1:], side[:-1]) if len(h) > 1 and _joined(text, h, nested)), None)
            if hit:
                yield text.rfind("\n", 0, hit[0][0]) + 1, hit[-1][1], hit
            if other == " ":
                break


def _joined(text: str, parts: list[tuple[int, int]], nested: list[str] | None) -> bool:
    v = "".join(text[a:b] for a, b in parts)
    return len(v) >= 16 and not NOT_SECRET.match(v) and _decode(v, nested)


CONFIG = re.compile(r"(?i)(?:\.(?:env|local|ini|ya?ml|toml|cfg|conf|properties|md|sh|bash|txt|json|tfvars|http)|(?:^|/)\.env[\w.]*|dockerfile)$")


DECODED = ".env"  # as if a decoded text were a file of this name


def find(text: str, path: str | None, nested: list[str] | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """Line numbers from 1 with a credential, each with the spans of the whole text to mask.

    A key block or an encoded value over several lines counts at its first line; its other lines are spans of that line too.
    """
    low = text.lower()
    if len(low) != len(text):  # a letter whose small form is longer
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    config = bool(path and CONFIG.search(path))
    gate = CANDIDATE_CONFIG if config else CANDIDATE
    lines: dict[int, list[tuple[int, int]]] = {}
    keys: list[tuple[int, int]] = []
    skip_to = -1
    at = 0
    while m := gate.search(low, at):
        a = text.rfind("\n", 0, m.start()) + 1
        b = text.find("\n", m.end())
        b = len(text) if b < 0 else b
        at = b + 1
        if a < skip_to:
            continue
        while a < b:  # a match may reach over a line end
            e = text.find("\n", a, b)
            e = b if e < 0 else e
            line = text[a:e]
            pem = PEM.search(line)
            spans: list[tuple[int, int]] = []
            if pem:
                spans, skip_to = _key_block(text, a + pem.end(), e)
                keys.append((a, skip_to))
            if not spans:
                spans = [(a + s, a + t) for s, t in line_spans(line, config, nested)]
            if spans:
                lines[a] = spans
            if skip_to > e:
                break
            a = e + 1
    for start, end, spans in blocks(text, nested):
        if not any(a <= start < b for a, b in keys):
            for a in [a for a in lines if start < a <= end]:
                spans = spans + lines.pop(a)
            lines[start] = lines.get(start, []) + spans
    out, line_no, counted = [], 1, 0
    for a in sorted(lines):
        line_no += text.count("\n", counted, a)
        counted = a
        out.append((line_no, lines[a]))
    return out


def _key_block(text: str, start: int, line_end: int) -> tuple[list[tuple[int, int]], int]:
    """The body of a key block after its first line's mark: on the same line with escapes, or on the lines below."""
    rest = text[start:line_end]
    if re.search(r"[A-Za-z0-9+/]{16}", rest):
        end = PEM_END.search(rest)
        body = rest[: end.start()] if end else re.split(r"[\"'`]", rest)[0]
        return ([(start, start + len(body))] if len(re.sub(r"\\[nr]|[^A-Za-z0-9+/]", "", body)) >= 40 else []), line_end
    spans, at, size = [], line_end + 1, 0
    while at < len(text):
        e = text.find("\n", at)
        e = len(text) if e < 0 else e
        m = re.fullmatch(r"[+\- ]?[\s>|\"'*#/]*([A-Za-z0-9+/=]{4,})[\"'\\n,+\s;]*", text[at:e])
        if not m or "-----" in text[at:e]:
            break
        spans.append((at + m.start(1), at + m.end(1)))
        size += len(m[1])
        at = e + 1
    return (spans if size >= 40 else []), at if size >= 40 else line_end


def mask(text: str, found: list[tuple[int, list[tuple[int, int]]]]) -> str:
    """The text with every span replaced by asterisks, its line ends and all else unchanged."""
    parts, at = [], 0
    for a, b in sorted(s for _, spans in found for s in spans):
        if a < at:
            a = at
        if b > a:
            parts += [text[at:a], re.sub(r"[^\r\n]+", "********", text[a:b])]
            at = b
    return "".join([*parts, text[at:]])


def _rows(batches: Iterator[pa.RecordBatch], fields: list[str], masked: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, paths = b.column("row_id").to_pylist(), b.column("path").to_pylist()
        f_out: list[str] = []
        i_out: list[int] = []
        x_out: list = []
        for f in fields:
            for i, p, t in zip(ids, paths, b.column(f).to_pylist()):
                if not t:
                    continue
                hits = find(t, p)
                if masked:
                    if hits:
                        f_out.append(f)
                        i_out.append(i)
                        x_out.append(mask(t, hits))
                else:
                    for n, _ in hits:
                        f_out.append(f)
                        i_out.append(i)
                        x_out.append(n)
        last = pa.array(x_out, pa.string()) if masked else pa.array(x_out, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(f_out, pa.string()), pa.array(i_out, pa.int64()), last], ["field", "row_id", "text" if masked else "line_no"])


def scan(df: DataFrame, row_id: str, path: str, fields: list[str], masked: bool = False) -> DataFrame:
    """``field, row_id, line_no`` of each line with a credential; with ``masked``, ``field, row_id, text`` of each changed text.

    Null and empty texts give no row; repeated rows give their cases again under their own id; other columns are
    ignored; an empty table gives an empty result.
    """
    cols = df.selectExpr(f"`{row_id}` as row_id", f"`{path}` as path", *(f"`{f}`" for f in fields))
    last = "text string" if masked else "line_no int"
    return spread(cols).mapInArrow(lambda it: _rows(it, fields, masked), f"field string, row_id bigint, {last}")
