"""Source texts that do not parse in their language, with the reason and rates.

Method: a lexer for each language with a pushdown stack finds unterminated literals, unbalanced delimiters, premature
ends, merge-conflict markers and tokens that cannot follow each other. An exact check follows for Python: its own parser
confirms what the stacks object to and is asked about what they let pass, so that only texts outside the grammar are
flagged; ``found_by`` says which of the two found a text. One pass without a shuffle; texts are read whole.
"""

from __future__ import annotations

import ast
import re
import textwrap
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from hunkyard.llm.ecmascript import problem as ecmascript_problem
from hunkyard.llm.python_stack import python_problem
from hunkyard.session import spread

# Spellings of language names and suffixes.
LANGUAGES = {
    "python": "python", "py": "python", "python3": "python", "py3": "python", "pyw": "python", "pyi": "python", "cpython": "python",
    "javascript": "javascript", "js": "javascript", "ecmascript": "javascript", "mjs": "javascript", "cjs": "javascript", "node": "javascript", "nodejs": "javascript", "es6": "javascript",
    "typescript": "typescript", "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "json": "json",
}

_JSON = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|(")|([\[{])|([\]}])|(^(?:<{7} |={7}\r?$|>{7} ))', re.M)
_PAIR = {"(": ")", "[": "]", "{": "}"}


def language(name: str | None, path: str | None) -> str | None:
    """The language by its name in any spelling, or by the path's suffix when there is no name."""
    if name is not None and name.strip():
        return LANGUAGES.get(re.sub(r"[\s._-]", "", name.strip().lower().lstrip(".")))
    return LANGUAGES.get(path.rpartition(".")[2].strip().lower()) if path and "." in path else None


def _json_stack(text: str) -> str | None:
    stack: list[str] = []
    for m in _JSON.finditer(text):
        if m[1]:
            return "unterminated literal"
        if m[2]:
            stack.append(_PAIR[m[2]])
        elif m[3]:
            if not stack or stack.pop() != m[3]:
                return "unbalanced delimiter"
        elif m[4]:
            return "merge conflict"
    return "premature end" if stack or not text.strip(" \t\r\n") else None


_VALUE = re.compile(r'[ \t\r\n]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)|([\[{\]}:,])|\Z)')


def _json_walk(text: str) -> bool:
    """The grammar of RFC 8259 with an explicit stack, so that depth is no limit."""
    stack: list[str] = []
    want, at, n = "value", 0, len(text)
    while True:
        m = _VALUE.match(text, at)
        if not m:
            return False
        at = m.end()
        t = m[3]
        if t is None and m[1] is None and m[2] is None:
            return want == "end" and at == n
        if want in ("value", "first") and (m[2] or m[1]) and not (want == "first" and stack[-1] == "{"):
            want = "after" if stack else "end"
        elif want in ("key", "first") and m[1] and stack[-1] == "{":
            want = ":"
        elif want in ("value", "first") and t in ("[", "{") and not (want == "first" and stack[-1] == "{"):
            stack.append(t)
            want = "first"
        elif want == ":" and t == ":":
            want = "value"
        elif want == "after" and t == ",":
            want = "key" if stack[-1] == "{" else "value"
        elif want in ("after", "first") and t in ("]", "}") and stack and _PAIR[stack[-1]] == t:
            stack.pop()
            want = "after" if stack else "end"
        else:
            return False


def _python_ok(text: str) -> bool | None:
    """Whether Python's own parser takes the text; None where it is too deep for that parser, which is no matter of grammar."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError):
            return False
        except (RecursionError, MemoryError):
            return None


def verdict(text: str | None, lang: str | None, snippet: bool = False) -> tuple[str | None, str | None]:
    """The reason why the text does not parse and who found it, ``stack`` or ``exact check``; None, None where it parses.

    A text that the stacks object to but the exact check takes is none, and ``found_by`` is then ``overruled``. Null texts
    and unknown languages are never flagged, an empty text only as JSON. A snippet is first freed of its common
    indentation.
    """
    if text is None or lang is None or not text and lang != "json":
        return None, None
    if snippet:
        text = textwrap.dedent(text)
    if lang == "python":
        text = text.removeprefix("\ufeff")
        reason, ok = python_problem(text), _python_ok(text)
        if ok is None:
            return reason, reason and "stack"
        if ok:
            return None, reason and "overruled"
        return reason or "syntax", "stack" if reason else "exact check"
    if lang == "json":
        reason = _json_stack(text) or (None if _json_walk(text) else "syntax")
    else:
        reason = ecmascript_problem(text.removeprefix("\ufeff"), lang == "typescript")
    return reason, reason and "stack"


def problem(text: str | None, lang: str | None, snippet: bool = False) -> str | None:
    """The reason of :func:`verdict`."""
    return verdict(text, lang, snippet)[0]


def flag(df: DataFrame, row_id: str, text: str, path: str, name: str | None, field: str, group: str, only_bad: bool = False) -> DataFrame:
    """``field, row_id, grp, language, reason, found_by`` of each text in a known language; ``reason`` is null where it parses.

    With ``only_bad`` the texts that parse are left out. Repeated rows are judged each; other columns are ignored; an
    empty table gives an empty result.
    """
    snippet = name is None
    cols = df.selectExpr(f"`{row_id}` as row_id", f"`{group}` as grp", f"`{text}` as text", f"`{path}` as path", f"`{name}` as name" if name else "cast(null as string) as name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, groups, langs, why, by = [], [], [], [], []
            for i, g, t, p, n in zip(*(b.column(c).to_pylist() for c in ("row_id", "grp", "text", "path", "name"))):
                lang = language(n, p)
                if lang is None or t is None:
                    continue
                r, found_by = verdict(t, lang, snippet)
                if r or not only_bad:
                    by.append(found_by)
                    ids.append(i)
                    groups.append(g)
                    langs.append(lang)
                    why.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([field] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(groups, pa.string()), pa.array(langs, pa.string()), pa.array(why, pa.string()), pa.array(by, pa.string())], ["field", "row_id", "grp", "language", "reason", "found_by"])

    return spread(cols).mapInArrow(run, "field string, row_id bigint, grp string, language string, reason string, found_by string")
