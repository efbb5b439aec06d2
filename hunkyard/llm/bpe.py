"""Byte-level BPE of a public vocabulary as a lazily determinised finite-state transducer, and its streaming decoder.

The encoding of every prefix of a word ends in exactly one token: the only vocabulary suffix that may stand behind the
last token of the rest. A state holds the bytes since the last certain token boundary with the last token of each of
their prefixes. A boundary is certain once every prefix that a longer token could still start from goes through it;
as tokens have a greatest length, that happens after bounded lookahead, and the tokens before it are emitted. States and
transitions are made when a byte first asks for them and are then table look-ups.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from hunkyard.session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_STATES = 300_000
MAX_WORDS = 300_000

# Fixed value: how this vocabulary splits a text into words before the merges; \s is Unicode white space.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")


class Transducer:
    """The encoder of one vocabulary: ranks of byte strings, a lower rank merging first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.starts = {b[:k] for b in ranks for k in range(1, len(b))}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        self.ids = {(-1, b""): 0}
        self.states: list[tuple[int, bytes, list[tuple[int, int] | None]]] = [(-1, b"", [])]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.ends: dict[int, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """The tokens of a short word by merging pairs in the order of their ranks."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether token b may stand behind token a (behind nothing: -1) in an encoding."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.merge(self.bytes_of[b]) == [b] if a < 0 else self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            self.pairs[(a, b)] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, data, last = self.states[state]
        data += bytes((byte,))
        n = len(data)
        entry = None
        for s in range(max(0, n - self.longest), n):
            t = self.ranks.get(data[s:])
            if t is None:
                continue
            if s == 0:
                a = before
            else:
                e = last[s - 1]
                if e is None:
                    continue
                a = e[0]
            if self.may_follow(a, t):
                entry = (t, s)
                break
        if entry is None:
            raise ValueError("the vocabulary lacks a byte")
        last = [*last, entry]
        live = [q for q in range(n) if data[q:] in self.starts and (q == 0 or last[q - 1] is not None)] + [n]
        common: set[int] | None = None
        chain: list[int] = []
        for q in live:
            chain, p = [], q
            while p > 0:
                chain.append(p)
                p = last[p - 1][1]  # type: ignore[index]
            common = set(chain) if common is None else common & set(chain)
            if not common:
                break
        out: list[int] = []
        if common:
            cut = max(common)
            for p in reversed(chain):
                if p <= cut:
                    out.append(last[p - 1][0])  # type: ignore[index]
            keep = set(live)
            for q in live:
                p = q
                while p > cut:
                    keep.add(p)
                    p = last[p - 1][1]  # type: ignore[index]
            last = [(last[p - 1][0], last[p - 1][1] - cut) if p in keep and last[p - 1] is not None else None for p in range(cut + 1, n + 1)]  # type: ignore[index]
            before, data = out[-1], data[cut:]
        key = (before, data)
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append((before, data, last))
            self.moves.append({})
        self.moves[state][byte] = to, tuple(out)
        return to, tuple(out)

    def _end(self, state: int) -> tuple[int, ...]:
        _, data, last = self.states[state]
        out, p = [], len(data)
        while p > 0:
            t, p = last[p - 1]  # type: ignore[misc]
            out.append(t)
        self.ends[state] = tuple(reversed(out))
        return self.ends[state]

    def word(self, word: str) -> tuple[int, ...]:
        """The tokens of one word, byte by byte."""
        if len(self.states) > MAX_STATES:
            self._reset()
        state, out = 0, []
        moves = self.moves
        for b in word.encode():
            m = moves[state].get(b)
            if m is None:
                m = self._move(state, b)
            state = m[0]
            if m[1]:
                out.extend(m[1])
        e = self.ends.get(state)
        out.extend(self._end(state) if e is None else e)
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """The token ids of a text; a null or empty text has none, and nothing in it is a special token."""
        out: list[int] = []
        words = self.words
        for m in WORDS.finditer(text or ""):
            w = m[0]
            t = words.get(w)
            if t is None:
                t = self.word(w)
                if len(w) < 64:
                    if len(words) > MAX_WORDS:
                        words.clear()
                    words[w] = t
            out.extend(t)
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text piece by piece: an incremental UTF-8 state machine holds back the bytes of an unfinished character."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            s = machine.decode(self.bytes_of[i])
            if s:
                yield s
        s = machine.decode(b"", True)
        if s:
            yield s


@lru_cache(4)
def transducer(path: str = DEFAULT_VOCABULARY) -> Transducer:
    """The transducer of a rank file, one per process."""
    with open(path, "rb") as f:
        return Transducer({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())})


def _shipped(df: DataFrame, path: str) -> str:
    """The name under which every worker finds the rank file: it is sent to them, as the path need only exist on the driver."""
    df.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def encode(df: DataFrame, row_id: str, text: str, path: str = DEFAULT_VOCABULARY, others: tuple[str, ...] = (), counts: bool = False) -> DataFrame:
    """``row_id`` and ``ids`` (or, with ``counts``, ``n_tokens``) of each text, and the columns ``others`` as they are.

    Null and empty texts have an empty list; other columns are ignored; an empty table gives an empty result.
    """
    cols = df.selectExpr(f"`{row_id}`", *(f"`{c}`" for c in others), f"`{text}` as __text")
    fields = ", ".join(f"`{n}` {t}" for n, t in cols.dtypes if n != "__text")
    name = _shipped(df, path)
    schema = f"{fields}, " + ("n_tokens int" if counts else "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = transducer(SparkFiles.get(name)).encode
        for b in batches:
            made = [e(t) for t in b.column("__text").to_pylist()]
            last = pa.array([len(x) for x in made], pa.int32()) if counts else pa.array(made, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in (row_id, *others)), last], [row_id, *others, "n_tokens" if counts else "ids"])

    return spread(cols).mapInArrow(run, schema)


def round_trip(df: DataFrame, row_id: str, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``row_id, n_tokens, same``: whether decoding the ids piece by piece gives the text again (a null text: '')."""
    cols, name = df.selectExpr(f"`{row_id}` as row_id", f"`{text}` as text"), _shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(SparkFiles.get(name))
        for b in batches:
            texts = b.column("text").to_pylist()
            made = [t.encode(x) for x in texts]
            same = ["".join(t.decode(i)) == (x or "") for i, x in zip(made, texts)]
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array([len(x) for x in made], pa.int32()), pa.array(same, pa.bool_())], ["row_id", "n_tokens", "same"])

    return spread(cols).mapInArrow(run, "row_id bigint, n_tokens int, same boolean")
