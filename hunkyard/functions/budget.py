"""The budget of a review from the context window of a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is kept free of a window, the tokens of a chunk, the least number of chunks, the usual window.
SYSTEM, CONTEXT, ANSWER = 1500, 4000, 6000
CHUNK_TOKENS = 6000
LEAST_CHUNKS = 4
USUAL_WINDOW = 128_000


def chunks_of_window(window: Column, chunk_tokens: int = CHUNK_TOKENS) -> Column:
    """How many chunks a window has room for: 31 for 200,000 tokens, 19 for 128,000, never fewer than 4."""
    room = F.coalesce(window, F.lit(USUAL_WINDOW)) - SYSTEM - CONTEXT - ANSWER
    return F.greatest(F.floor(room / chunk_tokens), F.lit(LEAST_CHUNKS)).cast("int")


def window_of_model(name: Column, known: dict[str, int], words: dict[str, int]) -> Column:
    """The window of a model: by its exact name, by a name that is a beginning of it or the other way round, by a word.

    ``known`` and ``words`` are tried in their order; an empty or unknown name has the usual window.
    """
    low = F.lower(F.trim(name))
    out = F.lit(USUAL_WINDOW)
    for w, n in reversed(words.items()):
        out = F.when(F.contains(low, F.lit(w)), n).otherwise(out)
    for k, n in reversed(known.items()):
        out = F.when(low.startswith(k) | F.lit(k).startswith(low), n).otherwise(out)
    for k, n in known.items():
        out = F.when(low == k, n).otherwise(out)
    return F.when(F.coalesce(low, F.lit("")) == "", USUAL_WINDOW).otherwise(out).cast("int")
