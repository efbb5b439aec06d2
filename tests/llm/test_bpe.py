import base64
import os
import random

import pytest

from hunkyard.llm.bpe import DEFAULT_VOCABULARY, encode, round_trip, transducer

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary here")

TEXTS = ["", "hello world", "  two  spaces \n\n\t tabs  ", "don't I'LL we've it'S", "größe naïve 変数名 🎉👩‍👩‍👧", "<|endoftext|> is text", "a" * 5000, " " * 3000 + "x", "\x00\x1c 　x", "def f(x):\n    return x**2  # ok\n", "3.14159 १२३ ٤٥٦ ½ ²", "​ \x85 \xa0y"]


@pytest.fixture(scope="module")
def other():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(DEFAULT_VOCABULARY, "rb"))}
    pat = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_an_independent_encoder(other):
    t = transducer()
    for x in TEXTS:
        assert t.encode(x) == other.encode_ordinary(x), x[:40]


def test_random_words_equal_an_independent_encoder(other):
    t = transducer()
    r = random.Random(3)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "aeinrst", "=-_*/#", "äöüßéèçñ", "的一是不了在人有我他", "01"]
    for _ in range(4000):
        x = "".join(r.choice(r.choice(alphabets)) for _ in range(r.randrange(1, 40))) if r.random() < 0.5 else "".join(r.choices(r.choice(alphabets), k=r.randrange(1, 60)))
        assert t.encode(x) == other.encode_ordinary(x), x
    t._reset()
    assert t.encode(x) == other.encode_ordinary(x)


def test_streaming_decode():
    t = transducer()
    for x in TEXTS:
        assert "".join(t.decode(t.encode(x))) == x
    assert t.encode(None) == []


def test_table(spark):
    df = spark.createDataFrame([(1, "hello", "z"), (1, "hello", "z"), (2, None, "z"), (3, "", "z"), (4, "ab " * 60_000, "z")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)[:2], len(r.ids)) for r in encode(df, "doc_id", "text").collect())
    assert [x[0] for x in got] == [1, 1, 2, 3, 4] and got[0] == got[1] and got[2][2] == got[3][2] == 0 and got[4][2] > 60_000
    assert all(r.same for r in round_trip(df, "doc_id", "text").collect())
    assert encode(df.limit(0), "doc_id", "text").count() == 0
