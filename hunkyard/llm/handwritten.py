"""Generated, minified, vendored and data files among changed files.

Method: each text is lexed, re-emitted in a canonical layout (one statement or brace a line, long lines broken at commas
and operators, one blank between words and operators) and the original layout is compared with it. Extreme expansion of
densely set text marks minified code; series of lines of the very same tokens and the very same layout, whose names are
counted up or derived from one another, mark generated code; dominance of literals marks data; records of one layout
with a digest each mark lock files. Copies of other projects' code are found by their canonical text: it is cut into
pieces at places that depend on the text alone, and a file whose pieces nearly all occur in repositories of another owner is a copy.

Extras beside the layout: the banner of a tool or of another project at the top, and, for texts that say too little, names
of lock files and of outputs of tools. Texts are read once, in a pass without a shuffle whose few columns are written down.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkyard.session import durable, spread

EXPANSION = 4.0
TIGHT = 0.6
LEAST_DENSE = 300
UNIFORM = 0.5
LITERAL = 0.75
DATA_LINES, TABLE = 0.4, 0.8
DIGESTS = 0.15
WEAK_LINES = 4
HEAD_LINES = 12
WIDTH, BROKEN = 100, 40
SHARED = 0.8
LEAST_TOKENS, LEAST_SHARED = 12, 40
PIECE_CUT = 6

# Names by which lock files and the outputs of tools are known.
LOCK = re.compile(r"(?i)(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.ya?ml|go\.sum|[\w.-]+\.lock|[\w.-]+[.-]lock\.(?:json|ya?ml|toml|hcl)|\.terraform\.lock\.hcl|\.pnp\.c?js)$")
TOOL_NAME = re.compile(r"(?i)(?:\.min\.(?:js|css|mjs)|\.(?:bundle|chunk|prod)\.(?:js|css)|[-.][0-9a-f]{8}\.(?:chunk\.)?(?:js|css)|-(?:all|bundle)\.(?:js|css)|\.pb\.(?:go|cc|h)|_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|rb|d\.ts)|\.generated\.\w+|_generated\.\w+|\.designer\.cs|\.g\.(?:cs|dart)|\.gql\.ts|Grpc\.java|zz_\w*\.go|_string\.go)$|(?:^|/)__generated__/")
# Formats whose values are literals by nature, and prose.
RECORDS = re.compile(r"(?i)(?:\.(?:ya?ml|ini|toml|cfg|conf|properties|md|txt|rst|json|html?|xml|csv|lock|sum)|\.env[\w.]*|\.local)$")
MADE = re.compile(
    r"(?i)^\W*(?:code generated by|generated by|generated (?:from|with)|auto-?generated|automatically generated|<auto-generated|@+generated|archivo generado|diese datei wurde automatisch|(?:ce )?fichier (?:a [ée]t[ée] )?g[ée]n[ée]r|machine-made by|produced by \S+ from|output of \S+ v?\d"
    r"|this (?:class|file|module|code) (?:is|was) (?:\w+ )?(?:written|generated|produced|created) (?:by|from)|any manual change here|do not (?:edit|modify)(?: by hand)?\b(?! the licen))|自动生成|自動生成|生成されました"
)
BANNER = re.compile(r"(?i)^\W*([\w.-]+)[,]?\s+v?\d+\.\d+(?:\.\d+)*\b(?:.*\b(?:licen[cs]e|MIT|BSD|ISC|MPL|Apache|GPL|zlib)\b|\s*(?:\*/)?\s*$)")
COPIED = re.compile(r"(?i)^\W*(?:copied|vendored|taken|imported|forked) from (?:the )?([\w.-]+)(?: project)?,? (?:release|version|v)\s*\d")
CONTRIBUTORS = re.compile(r"(?i)\(c\)\s+[\d, -]+\s+(?:the\s+)?([\w.-]+)\s+(?:contributors|authors|project)")
NOT_PROJECTS = frozenset("v version copyright python node go since release".split())
# Suffixes by the signs that begin their comments.
HASH_SUFFIXES = frozenset("py pyi rb sh bash zsh yaml yml toml ini cfg conf env local properties pl r lock sum tf mk ex exs jl".split())
SLASH_SUFFIXES = frozenset("js jsx mjs cjs ts tsx mts cts java go cs c h cc cpp hpp rs swift kt kts scala css scss less dart php m".split())

_LITERALS = r"""(?P<s>[rRbBuUfF]{0,2}(?:'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"\"\"(?:[^\\"]|\\[\s\S]|"(?!""))*\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|`(?:[^`\\]|\\[\s\S])*`)"""
_REST = r"""|(?P<w>[^\W\d][\w$]*|[$@:][^\W\d]\w*)|(?P<n>(?:0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)\w*)|(?P<o>=>|->|::|[=!<>]=+|&&|\|\||[+\-*/%&|^]=|\+\+|--|\S)"""
_SPACE = r"(?P<l>\n)|(?P<b>[ \t\r\f\v]+)|"
LEXERS = {
    "hash": re.compile(_SPACE + r"(?P<c>#[^\n]*)|" + _LITERALS + _REST),
    "slash": re.compile(_SPACE + r"(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|" + _LITERALS + _REST),
    "dash": re.compile(_SPACE + r"(?P<c>--[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|" + _LITERALS + _REST),
    "any": re.compile(_SPACE + r"(?P<c>(?<![^\s;{}])(?:\#[^\n]*|//[^\n]*|--\s[^\n]*)|/\*[\s\S]*?(?:\*/|\Z)|<!--[\s\S]*?(?:-->|\Z))|" + _LITERALS + _REST),
}
_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|--|<!--|;|\"\"\"|''')")
_BLOCKS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
_PREAMBLE = re.compile(r"<\?(?:php|xml)\b[^<]*$|['\"]use strict['\"];?$|<!doctype\b[^<]*$", re.I)
_DIGITS = re.compile(r"\d+")
_FOLD = re.compile(r"[\W\d_]+")
_DIGEST = re.compile(r"(?:sha\d+[-:]|h1:)[A-Za-z0-9+/=]{20,}|\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{32,}\b")
_BINDS = frozenset("= == === != !== < > <= >= => -> + - * / % && || ? : += -= *= /= %= |= &= ^=".split())
_BREAKS = frozenset(", => && || ? : ( + [".split())


class Line(NamedTuple):
    """One line of the original: its tokens with their kinds, and the blanks in front of each."""

    tokens: list[str]
    kinds: str
    gaps: str
    comment: str


class Layout(NamedTuple):
    """A text's lines, the statements of its canonical layout, and how the two compare."""

    lines: list[Line]
    canonical: list[str]
    sizes: list[int]
    expansion: float
    tight: float
    literal: float


def new_side(patch: str) -> str:
    """The lines that a patch shows, without its marks; the new side unless it only removes."""
    lines = [x for x in patch.split("\n") if not x.startswith(("@@", "\\", "diff ", "index ", "+++ ", "--- "))]
    keep = [x[1:] for x in lines if not x.startswith("-")]
    return "\n".join(keep if any(x.strip() for x in keep) else [x[1:] for x in lines])


def leading_comments(lines: list[str]) -> int:
    """The number of stripped lines before the first one of code; the lines inside a block comment need no mark."""
    end = ""
    for i, x in enumerate(lines):
        if end:
            end = "" if end in x else end
            continue
        if not _COMMENT.match(x) and not _PREAMBLE.match(x):
            return i
        for a, b in _BLOCKS.items():
            if x.startswith(a) and b not in x[len(a) :]:
                end = b
    return len(lines)


def family(path: str) -> str:
    """Which signs begin a comment, by the path's suffix; ``any`` where it tells nothing."""
    s = path.rpartition(".")[2].lower() if "." in path else ""
    return "hash" if s in HASH_SUFFIXES else "slash" if s in SLASH_SUFFIXES else "dash" if s in ("sql", "lua", "hs") else "any"


def lex(text: str, kind: str) -> list[Line]:
    """The lines of a text as tokens; a token over several lines belongs to the line it begins in."""
    out: list[Line] = []
    tokens: list[str] = []
    kinds: list[str] = []
    gaps: list[str] = []
    comment, gap = "", "0"
    for m in LEXERS[kind].finditer(text):
        k = m.lastgroup
        if k == "b":
            gap = "1" if m.end() - m.start() == 1 else "2"
            continue
        if k == "l":
            if tokens or comment:
                out.append(Line(tokens, "".join(kinds), "".join(gaps), comment))
                tokens, kinds, gaps, comment = [], [], [], ""
            gap = "0"
            continue
        if k == "c":
            comment = comment or m[0]
            continue
        tokens.append(m[0])
        kinds.append(k)  # type: ignore[arg-type]
        gaps.append(gap)
        gap = "0"
    if tokens or comment:
        out.append(Line(tokens, "".join(kinds), "".join(gaps), comment))
    return out


def _data(token: str, kind: str) -> int:
    """How many signs of a token are data: numbers, and strings that are no sentence or query."""
    if kind == "n":
        return len(token) + 1
    if kind == "s" and (token.count(" ") < 3 or token.count(" ") * 15 < len(token)):
        return len(token)
    return 0


def layout(lines: list[Line]) -> Layout:
    """The canonical layout of lexed lines, and the comparison of the original with it.

    ``expansion``: lines of the canonical layout for each original one; ``tight``: share of the places where the canonical
    layout sets a blank beside an operator, comma or brace and the original none; ``literal``: share of signs in data.
    """
    statements: list[str] = []
    sizes: list[int] = []
    wanted = missing = data = total = rows = canonical = 0
    for line in lines:
        if not line.tokens:
            continue
        rows += 1
        part: list[str] = []
        width = size = depth = 0
        prev, prev_kind = "", ""

        def end() -> None:
            nonlocal width, size, canonical
            if part:
                statements.append("".join(part))
                sizes.append(size)
                canonical += 1
                part.clear()
            width = size = 0

        for t, k, g in zip(line.tokens, line.kinds, line.gaps):
            total += len(t)
            if k in "ns":
                data += _data(t, k)
            if k == "o":
                if t == "}" and part:
                    end()
                    prev, prev_kind = "", ""
                elif t in "([" and len(t) == 1:
                    depth += 1
                elif t in ")]" and len(t) == 1:
                    depth = max(0, depth - 1)
            if prev:
                if prev in _BINDS or t in _BINDS or prev == "," or t == "{":
                    wanted += 1
                    missing += g == "0"
                    part.append(" ")
                    width += 1
                elif k != "o" and prev_kind != "o":
                    part.append(" ")
                    width += 1
            part.append(t)
            width += len(t)
            size += 1
            prev, prev_kind = t, k
            if t == "{" or t == "}" or t == ";" and not depth:
                end()
                wanted += 1
                missing += 1
                prev, prev_kind = "", ""
            elif width >= WIDTH + BROKEN:
                canonical += 1
                width = 0
            elif width >= BROKEN and t in _BREAKS and line_long(line):
                canonical += 1
                width = 0
        end()
        if rows and line.tokens[-1] in ("{", "}", ";"):  # a break where the original has one too
            missing -= 1
    return Layout(lines, statements, sizes, canonical / rows if rows else 0.0, missing / wanted if wanted else 0.0, data / total if total else 0.0)


def line_long(line: Line) -> bool:
    """Whether a line is wider than the canonical layout allows."""
    return sum(map(len, line.tokens)) > WIDTH


def _counts(column: list[list[str]]) -> bool:
    """Whether a number inside the tokens of a column is counted up from row to row."""
    width = min(map(len, column))
    return any(sum(0 < int(b[c][:18]) - int(a[c][:18]) <= 3 for a, b in zip(column, column[1:])) >= 0.9 * (len(column) - 1) for c in range(width))


def mechanical(rows: list[Line]) -> bool:
    """Whether lines of one shape and layout were written by a loop: their names are counted up together with something
    else of the line, or several parts of each line are derived from one name that changes from line to line."""
    n = len(rows)
    counted = named = 0
    names: list[list[str]] = []
    for i, k in enumerate(rows[0].kinds):
        if k == "o":
            continue
        col = [r.tokens[i] for r in rows]
        if all(x == col[0] for x in col):
            continue
        if _counts([_DIGITS.findall(x) for x in col]):
            counted += 1
            named += k == "w" or k == "s" and sum(map(str.isalpha, col[0])) > 2
        if k in "ws":
            names.append([_FOLD.sub("", x).lower() for x in col])
    noted = all(r.comment for r in rows) and _counts([_DIGITS.findall(r.comment) for r in rows])
    if named >= 2 or named and (noted or counted >= 2 and (n >= 10 or len(rows[0].tokens) >= 5)):
        return True
    if n < 8 or len(rows[0].tokens) < 12:
        return False
    for i, a in enumerate(names):
        if len(set(a)) < 0.8 * n or min(map(len, a)) < 4:
            continue
        if sum(sum(x in y or y in x and len(y) >= 4 for x, y in zip(a, b)) >= 0.9 * n for j, b in enumerate(names) if j != i) >= 2:
            return True
    return False


def _shape(x: Line) -> tuple[str, str, str]:
    return x.kinds, x.gaps, "".join(t for t, k in zip(x.tokens, x.kinds) if k == "o")


def uniformity(lines: list[Line]) -> float:
    """The share of lines, those of mere brackets left out, in mechanical series of the same tokens in the same layout.

    Where single lines do not make up such series, the blocks between lines of the most frequent shape are tried.
    """
    lines = [x for x in lines if "w" in x.kinds or "s" in x.kinds or "n" in x.kinds]
    shapes = [_shape(x) for x in lines]
    series: dict[tuple, list[Line]] = {}
    for s, x in zip(shapes, lines):
        series.setdefault(s, []).append(x)
    n = len(lines)
    rest = {s for s, v in series.items() if len(v) < 3 or not mechanical(v)}
    uniform = n - sum(len(series[s]) for s in rest)
    if not n or uniform >= UNIFORM * n or len(rest) < 2:
        return uniform / n if n else 0.0
    often = max(rest, key=lambda s: (len(series[s]) * any(_DIGITS.search(t) for t in series[s][0].tokens), len(s[0])))
    starts = [i for i, s in enumerate(shapes) if s == often]
    blocks: dict[tuple, list[Line]] = {}
    for a, b in zip(starts, starts[1:]):
        if b - a <= 8:
            block = lines[a:b]
            blocks.setdefault(tuple(shapes[a:b]), []).append(Line([t for x in block for t in x.tokens], "".join(x.kinds for x in block), "", ""))
    uniform += sum(len(v) * sum(s in rest for s in k) for k, v in blocks.items() if len(k) > 1 and len(v) >= 3 and mechanical(v))
    return uniform / n


def table_share(lines: list[Line]) -> float:
    """The share of lines that are records of literals: elements of a list with the same constant words, and nothing else that varies."""
    series: dict[tuple, list[Line]] = {}
    for x in lines:
        if x.tokens and (x.tokens[0] in "{[(" or x.kinds[0] in "ns") and x.tokens[-1] in ",}])":
            series.setdefault((x.kinds, tuple(t for t, k in zip(x.tokens, x.kinds) if k in "wo")), []).append(x)
    return sum(len(v) for v in series.values() if len(v) >= 8) / len(lines) if lines else 0.0


def _data_lines(lines: list[Line]) -> int:
    """How many lines are mostly data."""
    return sum(2 * sum(_data(t, k) for t, k in zip(x.tokens, x.kinds) if k in "ns") >= sum(map(len, x.tokens)) for x in lines)


def pieces(canonical: list[str], sizes: list[int]) -> dict[int, int]:
    """Fingerprints of the canonical text with their numbers of tokens. It is cut after statements whose own hash says
    so, so that a change moves no cut but its own; pieces of a few tokens tell nothing and are left out."""
    out: dict[int, int] = {}
    part: list[str] = []
    size = 0
    for s, n in zip([*canonical, ""], [*sizes, 0]):
        part.append(s)
        size += n
        if not s or xxhash.xxh32_intdigest(s) % PIECE_CUT == 0:
            if size >= LEAST_TOKENS:
                out[xxhash.xxh64_intdigest("\n".join(part)) - (1 << 63)] = size
            part, size = [], 0
    return out


def banner(text: str, own: str) -> str | None:
    """What the leading comments say: that a tool wrote the file, or that it is another project's."""
    every = [x.strip() for x in text.replace("\r", "").split("\n")]
    every = [x for x in every if x]
    for i, x in enumerate(every[: max(HEAD_LINES, leading_comments(every))]):
        if not (_COMMENT.match(x) or i >= HEAD_LINES):
            continue
        if MADE.search(x) and '"' not in x.strip('"'):
            return "generated"
        b = BANNER.match(x) or COPIED.match(x) or CONTRIBUTORS.search(x)
        if b and b[1].lower() != own.lower() and b[1].lower() not in NOT_PROJECTS:
            return "vendored"
    return None


class Verdict(NamedTuple):
    kind: str | None
    route: str | None
    enough: bool
    pieces: dict[int, int]


def judge(path: str, text: str | None, own: str) -> Verdict:
    """What made the file (None: a person of the repository, or a copy by its pieces), which evidence said so, whether
    its own text was enough to tell, and the fingerprints of its canonical text.

    ``own`` is the repository's owner, whose own banners say nothing.
    """
    if not text or not text.strip():
        kind = "lock file" if LOCK.search(path) else "generated" if TOOL_NAME.search(path) else None
        return Verdict(kind, kind and "name", bool(kind), {})
    x = layout(lex(text, family(path)))
    code = [r for r in x.lines if r.tokens]
    dense = sum(len(t) for r in code for t in r.tokens)
    records = bool(RECORDS.search(path))
    kind = None
    if x.expansion >= EXPANSION and x.tight >= TIGHT and dense >= LEAST_DENSE and not records:
        kind = "minified"
    elif len(code) >= WEAK_LINES and (records or family(path) == "any") and sum(bool(_DIGEST.search(" ".join(r.tokens).replace(" ", ""))) for r in code) >= max(2, DIGESTS * len(code)):
        kind = "lock file"
    elif not records and (dense >= 400 and x.literal >= LITERAL and _data_lines(code) >= DATA_LINES * len(code) or len(code) > 8 and (layout(code[1:-1]).literal >= 0.85 or table_share(code) >= TABLE)):
        kind = "data"
    elif len(code) >= WEAK_LINES and (len(code) >= 6 or TOOL_NAME.search(path)) and uniformity(code) >= UNIFORM:
        kind = "generated"
    if kind:
        return Verdict(kind, "layout", True, {})
    kind = banner(text, own)
    if kind:
        return Verdict(kind, "banner", True, pieces(x.canonical, x.sizes) if kind == "vendored" else {})
    if LOCK.search(path):
        return Verdict("lock file", "name", True, {})
    if TOOL_NAME.search(path) and (len(code) < WEAK_LINES or uniformity(code) >= UNIFORM / 2):
        return Verdict("generated", "name", True, {})
    return Verdict(None, None, len(code) >= WEAK_LINES, pieces(x.canonical, x.sizes))


def classify(df: DataFrame) -> DataFrame:
    """``diff_id, kind, route`` for every row; ``kind`` is null for hand-written files, ``route`` names the evidence.

    The text judged is full_content or, where that is null or blank, the patch. A file whose canonical pieces occur, for
    ``SHARED`` of their tokens, in repositories of another owner is vendored. A row with too little text of its own
    takes the verdict of the other rows of the same repository and path. Null paths count as an empty path; repeated
    rows get the same verdict; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            repos, paths = b.column("repo").to_pylist(), b.column("file_path").to_pylist()
            owners = [(r or "").partition("/")[0] for r in repos]
            v = [judge(p or "", t if t and t.strip() else new_side(q) if q else None, o) for o, p, t, q in zip(owners, paths, b.column("full_content").to_pylist(), b.column("patch").to_pylist())]
            cols = [pa.array(owners, pa.string()), pa.array([x.kind for x in v], pa.string()), pa.array([x.route for x in v], pa.string()), pa.array([x.enough for x in v], pa.bool_())]
            cols += [pa.array([list(x.pieces) for x in v], pa.list_(pa.int64())), pa.array([list(x.pieces.values()) for x in v], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("diff_id"), b.column("repo"), b.column("file_path"), *cols], ["diff_id", "repo", "file_path", "owner", "kind", "route", "enough", "pieces", "sizes"])

    schema = "diff_id bigint, repo string, file_path string, owner string, kind string, route string, enough boolean, pieces array<bigint>, sizes array<int>"
    judged = durable(spread(df.select("diff_id", "repo", "file_path", "full_content", "patch")).mapInArrow(run, schema))
    # of each fingerprint only its least and greatest owner are kept, so one met everywhere is no larger than others
    met = judged.select("owner", F.explode("pieces").alias("piece")).groupBy("piece").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a <> b").select("piece", F.lit(True).alias("met"))
    own = judged.where("kind is null").select("diff_id", F.explode(F.arrays_zip("pieces", "sizes")).alias("p")).select("diff_id", F.col("p.pieces").alias("piece"), F.col("p.sizes").alias("size"))
    share = own.join(met, "piece", "left").groupBy("diff_id").agg(F.sum("size").alias("all"), F.sum(F.when(F.col("met"), F.col("size"))).alias("shared"))
    copies = share.where((F.col("shared") >= LEAST_SHARED) & (F.col("shared") >= SHARED * F.col("all"))).select("diff_id", F.lit(True).alias("copy"))
    j = judged.drop("pieces", "sizes").join(copies, "diff_id", "left")
    j = durable(j.select("diff_id", "repo", "file_path", "enough", F.when(F.col("copy"), "vendored").otherwise(F.col("kind")).alias("kind"), F.when(F.col("copy"), "pieces").otherwise(F.col("route")).alias("route")))
    known = j.where("kind is not null").groupBy("repo", "file_path").agg(F.min("kind").alias("other"))
    weak = F.col("kind").isNull() & ~F.col("enough")
    j = j.join(known, ["repo", "file_path"], "left")
    return j.select("diff_id", F.when(weak, F.col("other")).otherwise(F.col("kind")).alias("kind"), F.when(weak & F.col("other").isNotNull(), "same file").otherwise(F.col("route")).alias("route"))
