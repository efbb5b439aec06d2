import random

from hunkyard.operators.hierarchy import components, descendants, hierarchy, walk

SCHEMA = "trace_id string, span_id string, parent_id string, exported_at timestamp, ns string"


def brute(rows):
    clean = lambda x: (x.strip().lower() or None) if x is not None else None
    best = {}
    for t, s, p, v, _ in rows:
        if clean(s) is None:
            continue
        k, c = (t, clean(s)), (v is not None, v, clean(p) or "")
        if k not in best or c > best[k]:
            best[k] = c
    out = {}
    for t, s in best:
        seen, x = [], s
        while True:
            seen.append(x)
            p = best[(t, x)][2]
            if not p or (t, p) not in best:
                out[(t, s)] = (x, len(seen) - 1)
                break
            if p in seen:
                out[(t, s)] = (min(seen[seen.index(p) :]), -1)
                break
            x = p
    return out


def _random_rows(seed, n):
    import datetime as dt

    r = random.Random(seed)
    ids = [f"a{i}" for i in range(n)]
    rows = []
    for _ in range(2 * n):
        s = r.choice(ids)
        p = r.choice([*ids, None, "", " ", "gone"])
        s = r.choice([s, s.upper(), f" {s} "])
        rows.append((r.choice(["t1", "t2", None]), s, p, r.choice([None, dt.datetime(2025, 1, 1 + r.randrange(20), 1)]), "x"))
    for i in range(1, 40):
        rows.append(("deep", f"d{i}", f"d{i - 1}", None, "x"))
    return rows + rows[:5]


def test_against_brute_force_on_usual_hot_and_giant_paths(spark):
    for seed in range(2):
        rows = _random_rows(seed, 40)
        df = spark.createDataFrame(rows, SCHEMA)
        want = brute(rows)
        for hot in (10_000, 45, 5):
            got = {(r.ns, r.id): (r.root_id, r.depth) for r in hierarchy(df, "trace_id", "span_id", "parent_id", "exported_at", hot_rows=hot).collect()}
            assert got == want, (seed, hot)


def test_paths_agree_whatever_the_way(spark):
    df = spark.createDataFrame(_random_rows(3, 30), SCHEMA)
    res = []
    for hot in (10_000, 20, 3):
        h = hierarchy(df, "trace_id", "span_id", "parent_id", "exported_at", True, hot)
        res.append({(r.ns, r.id): (r.root_id, r.depth, r.path) for r in h.collect()})
        for k, (root, depth, path) in res[-1].items():
            assert (path is None) if depth < 0 else (path[0] == root and path[-1] == k[1] and len(path) == depth + 1)
    assert res[0] == res[1] == res[2]


def test_back_edges_mark_the_least_node_of_each_circle(spark):
    rows = [("t", "a", "b", None, "x"), ("t", "b", "c", None, "x"), ("t", "c", "a", None, "x"), ("t", "z", "a", None, "x"), ("t", "me", "me", None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    for hot in (100, 2):
        got = hierarchy(df, "trace_id", "span_id", "parent_id", "exported_at", True, hot).collect()
        assert {(r.id, r.root_id) for r in got} == {("a", "a"), ("b", "a"), ("c", "a"), ("z", "a"), ("me", "me")}
        assert {r.id for r in got if r.back_edge} == {"a", "me"}


def test_descendants_and_empty_table(spark):
    rows = [("t", "a", None, None, "x"), ("t", "b", "a", None, "x"), ("t", "c", "b", None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.id, r.descendant, r.distance) for r in descendants(hierarchy(df, "trace_id", "span_id", "parent_id", with_path=True)).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert hierarchy(df.limit(0), "trace_id", "span_id", "parent_id").count() == 0


def test_components_and_walks_from_any_start():
    assert len(set(components([-1, 0, 0, -1, 3, 5]))) == 3 and components([]) == []
    ids = ["d", "c", "b", "a", "r", "s"]
    up = {"a": "b", "b": "c", "c": "a", "d": "a", "r": None, "s": "r"}
    for order in (ids, ids[::-1], sorted(ids)):
        root, depth, path, back = walk(order, [up[x] for x in order])
        got = dict(zip(order, zip(root, depth, path, back)))
        assert got["d"] == ("a", -1, None, False) and got["a"] == ("a", -1, None, True) and not got["b"][3] and got["s"] == ("r", 1, ["r", "s"], False)
