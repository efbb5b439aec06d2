import random
from itertools import combinations

from hunkyard.llm.packing import fill, keep, pack, patterns


def best_sum(capacity, items):
    first = max(items)
    rest = list(items)
    rest.remove(first)
    best = 0
    for k in range(len(rest) + 1):
        for c in combinations(rest, k):
            if first + sum(c) <= capacity:
                best = max(best, first + sum(c))
    return best


def test_each_window_is_as_full_as_brute_force_can_make_it():
    r = random.Random(2)
    for _ in range(200):
        cap = r.randrange(5, 40)
        items = [r.randrange(1, cap + 1) for _ in range(r.randrange(1, 9))]
        hist = {s: items.count(s) for s in set(items)}
        got = fill(cap, hist)
        assert all(got[s] <= hist[s] for s in got)
        assert sum(s * c for s, c in got.items()) == best_sum(cap, items)


def test_patterns_use_every_item_once_also_at_millions():
    hist = {3: 2_000_000, 7: 999_999, 500: 3, 41: 17}
    p = patterns(1000, hist)
    for s, n in hist.items():
        assert sum(q.get(s, 0) * t for q, t in p) == n
    assert all(sum(s * c for s, c in q.items()) <= 1000 for q, _ in p)
    bins = sum(t for _, t in p)
    assert bins <= 1.001 * sum(s * n for s, n in hist.items()) / 1000 + 1


def test_table(spark):
    r = random.Random(5)
    rows = [(g, i, r.randrange(1, 260), 100) for i, g in enumerate(r.choice(["a#1", "b#2"]) for _ in range(300))] + [("hot#1", 1000 + i, 30, 100) for i in range(1000)]
    df = spark.createDataFrame(rows, "grp string, item bigint, tokens int, capacity int")
    got = pack(df).collect()
    size = {i: t for _, i, t, _ in rows}
    load, of = {}, {}
    for x in got:
        load[(x.grp, x.bin)] = load.get((x.grp, x.bin), 0) + x.tokens
        of.setdefault(x.item, []).append(x)
    assert max(load.values()) <= 100
    for i, t in size.items():
        assert sum(x.tokens for x in of[i]) == t and len(of[i]) == -(-t // 100) and sorted(x.piece for x in of[i]) == list(range(1, len(of[i]) + 1))
    assert sum(1 for g, _ in load if g == "hot#1") == 334
    lim = spark.createDataFrame([("a#1", 5), ("b#2", 1000), ("hot#1", 2)], "grp string, max_chunks int")
    kept = keep(pack(df), lim).collect()
    assert sorted(x.chunk_no for x in kept if x.grp == "a#1") == [1, 2, 3, 4, 5] and sum(x.grp == "hot#1" for x in kept) == 2
    assert pack(df.limit(0)).count() == 0


def test_containers_of_a_hot_group_are_ranked_in_parts(spark):
    n, most = 5000, 7
    pieces = spark.range(n).selectExpr("if(id % 50 = 0, 'b', 'hot') as grp", "id as item", "cast(id * 7919 % 1000 as bigint) as tokens", "concat('#', id) as bin")
    kept = keep(pieces, spark.createDataFrame([("hot", most), ("b", 1000)], "grp string, max_chunks int"))
    rows = sorted(((-(i * 7919 % 1000), i) for i in range(n) if i % 50), key=lambda x: x)
    assert [(x.bin, x.chunk_no) for x in kept.where("grp = 'hot'").orderBy("chunk_no").collect()] == [(f"#{i}", k) for k, (_, i) in enumerate(rows[:most], 1)]
    assert kept.where("grp = 'b'").count() == n // 50
    windows = [x for x in kept._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number()" in x]
    assert len(windows) == 2 and any("part#" in x for x in windows)
