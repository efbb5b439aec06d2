import random

from hunkyard.llm.abuse import _WORD, features, fit, fold, plain, score, sentences, train

BAD = ["you are a {} and everybody knows it.", "whoever wrote {} is a complete {}.", "shut up, {}.", "go back to school, {}"]
SLURS = ["moron", "wanker", "bastard", "dumbass", "cretin", "idiot"]
CLEAN = ["please add a test for {} before we merge this.", "the {} cache drops old rows.", "stupid me, i was an idiot to merge {}.", "add 'moron' and 'bastard' to the word list of {}.", "kill the zombie process of {} first.", "why do we load {} twice?"]
NOUNS = ["ledger", "window", "queue", "parcel", "shard", "roster", "basket", "coupon"]


def corpus(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        s = [r.choice(CLEAN).format(r.choice(NOUNS)) for _ in range(r.randrange(1, 5))]
        bad = r.random() < 0.25
        if bad:
            s.insert(r.randrange(len(s) + 1), r.choice(BAD).format(*[r.choice(SLURS)] * 2))
        out.append((" ".join(s), bad))
    return out


def test_disguises_are_undone():
    assert [plain(w) for w in ("m0r0n", "a$$hole", "b*st*rd", "idiooot", "idiot", "x9k2")] == ["moron", "asshole", "bastard", "idiot", "idiot", "#"]
    assert fold("V​о​llpfosten ENCULÉ") == "vollpfosten encule"
    assert "retard" in sentences("some r e t a r d wrote it")[0]
    assert _WORD.findall("no `x`")[0] == "no" and len(features("")) == 1


def test_held_out_accuracy_with_wrong_labels():
    r = random.Random(4)
    rows = [(t, float(b) if r.random() > 0.1 else float(not b)) for t, b in corpus(1500, 1)]
    m = fit(rows)
    wrong = sum((m.score(t) >= 0.5) != b for t, b in corpus(1000, 2))
    assert wrong <= 30, wrong
    assert m.cuts[0] <= m.cuts[1] and 0 <= m.score("x") <= 1 and m.score(None) == m.score("") == m.score(" \n") == 0


def test_without_labels_marks_decide():
    m = fit([])
    assert m.score("shut up, you moron") > 0.5 > m.score("the queue drops rows")


def test_table(spark):
    docs = [(i, t, "s", "z") for i, (t, _) in enumerate(corpus(300, 7))] + [(1000, None, "s", "z"), (1001, "", None, "z"), (1002, "ok. " * 50_000 + "shut up, wanker.", "s", "z"), (1002, "ok. " * 50_000 + "shut up, wanker.", "s", "z")]
    labels = [(i, int(b), "r") for i, (_, b) in enumerate(corpus(300, 7))] + [(5, None, "r"), (9999, 1, "r")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, severity string")
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int, rater string")
    got = score(d, train(d, lab)).collect()
    assert len(got) == 304
    by = {r.doc_id: r.severity for r in got}
    assert by[1000] == by[1001] == 0 and by[1002] > 0.5
    assert sum((by[i] >= 0.5) != b for i, (_, b) in enumerate(corpus(300, 7))) <= 15
    assert score(d.limit(0), train(d.limit(0), lab)).count() == 0
