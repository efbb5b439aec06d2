"""Texts of any kind: nothing raises, and what must hold for every text holds."""

import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hunkyard.llm.abuse import fit, sentences
from hunkyard.llm.bpe import DEFAULT_VOCABULARY, transducer
from hunkyard.llm.handwritten import judge, new_side
from hunkyard.llm.secrets import find, mask
from hunkyard.llm.syntax import problem

PIECES = ['"', "'", "`", "${", "}", "{", "(", ")", "[", "]", "/", "\\", "\n", "\r\n", "=>", "=", "==", "?", ":", ";", ",", ".", "...", "<", ">", "//", "/*", "*/", "#", "@", "+", "-", "*", "password", " = ", "token: ", "eyJ", "AKIA", "-----BEGIN PRIVATE KEY-----", "x", "1", "0x", "async", "function", "class", "const", "let", "if", "for", "import", "type", "interface", "é", "你", "😀", "​", " ", "\t", "%41", "\\x41", "https://a:b@c", "@@ -1 +1 @@", "you ", "m0r0n"]
MIXED = st.one_of(st.text(max_size=200), st.lists(st.sampled_from(PIECES), max_size=60).map("".join))
FEW = settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.too_slow])
MODEL = fit([])


@FEW
@given(MIXED)
def test_parsers_answer_for_any_text(t):
    for lang in ("javascript", "typescript", "python", "json"):
        for snippet in (False, True):
            first = problem(t, lang, snippet)
            assert first is None or isinstance(first, str)
            assert problem(t, lang, snippet) == first


@FEW
@given(MIXED)
def test_masking_changes_credentials_only(t):
    for path in (None, "a.yaml", "a.py"):
        hits = find(t, path)
        assert [n for n, _ in hits] == sorted({n for n, _ in hits})
        assert all(1 <= n <= t.count("\n") + 1 for n, _ in hits)
        m = mask(t, hits)
        assert m.count("\n") == t.count("\n") and (m == t) == (not hits)


@FEW
@given(MIXED)
def test_verdicts_and_scores_for_any_text(t):
    for path in ("src/a.py", "a.ts", "q.sql", ""):
        v = judge(path, t, "o")
        assert v.kind in (None, "generated", "minified", "vendored", "data", "lock file") and isinstance(v.enough, bool)
    judge(t, t, t)
    assert isinstance(new_side(t), str)
    assert 0 <= MODEL.score(t) <= 1 and all(isinstance(s, str) for s in sentences(t))


@pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary here")
@FEW
@given(MIXED)
def test_tokens_round_trip(t):
    e = transducer()
    assert "".join(e.decode(e.encode(t))) == t
