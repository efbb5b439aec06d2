"""Parent links turned into full hierarchies: root, depth, path, descendants and circles.

Method: find connected components, co-locate each component, walk it depth first with node colouring.

A component never crosses a namespace (a trace), so the namespaces of usual size are co-located as they are: one
shuffle. A namespace of more than ``hot_rows`` rows is not given to one task; its components are found first, by
pointer doubling over the whole cluster, and then co-located one by one. A component of more than ``hot_rows`` nodes
keeps the exact result of the doubling itself.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkyard.operators.colocate import map_groups
from hunkyard.session import durable

HOT_ROWS = 20_000
MAX_HOT_LITERALS = 1_000


def clean_id(c: Column) -> Column:
    """The form in which ids are compared: trimmed of all white space at both ends, lower case; blank is null."""
    t = F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
    return F.when(t != "", t)


def components(up: list[int]) -> list[int]:
    """The connected component of each node, named by one of its nodes; ``up`` are the parents' places, -1 for none."""
    of = list(range(len(up)))
    for i, p in enumerate(up):
        if p < 0:
            continue
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        while of[p] != p:
            of[p] = of[of[p]]
            p = of[p]
        of[i] = p
    for i in range(len(of)):
        r = i
        while of[r] != r:
            r = of[r]
        of[i] = r
    return of


def walk(ids: Sequence[str], parents: Sequence[str | None]) -> tuple[list[str], list[int], list[list[str] | None], list[bool]]:
    """Root, depth, path and back edge of each node of some whole components of one namespace.

    The components are found first; each is walked by iterative depth-first traversal along the parent links. White
    nodes are unseen, grey ones are on the stack, black ones are done. An edge to a grey node closes a circle: the nodes
    of the stack from there on. Its back edge is the one that leaves its least id, wherever the walk began.
    """
    at = {x: i for i, x in enumerate(ids)}
    n = len(ids)
    up = [at.get(p, -1) if p is not None else -1 for p in parents]
    of = components(up)
    colour = bytearray(n)
    root, depth, back = [""] * n, [0] * n, [False] * n
    path: list[list[str] | None] = [None] * n
    for start in sorted(range(n), key=of.__getitem__):
        if colour[start]:
            continue
        stack, v = [], start
        while v >= 0 and not colour[v]:
            colour[v] = 1
            stack.append(v)
            v = up[v]
        if v >= 0 and colour[v] == 1:
            k = stack.index(v)
            first = min(stack[k:], key=ids.__getitem__)
            back[first] = True
            for i in stack[k:]:
                root[i], depth[i], colour[i] = ids[first], -1, 2
            del stack[k:]
        for i in reversed(stack):
            p = up[i]
            if p < 0:
                root[i], depth[i], path[i] = ids[i], 0, [ids[i]]
            elif depth[p] < 0:
                root[i], depth[i] = root[p], -1
            else:
                root[i], depth[i] = root[p], depth[p] + 1
                path[i] = [*path[p], ids[i]]  # type: ignore[misc]
            colour[i] = 2
    return root, depth, path, back


def _walker(with_path: bool):
    def fn(t: pa.Table) -> pa.Table:
        ns, group, ids, parents = (t.column(c).to_pylist() for c in ("ns", "grp", "id", "parent"))
        out_root: list[str] = []
        out_depth: list[int] = []
        out_path: list[list[str] | None] = []
        out_back: list[bool] = []
        a, n = 0, len(ids)
        while a < n:
            b = a + 1
            while b < n and ns[b] == ns[a] and group[b] == group[a]:
                b += 1
            r, d, p, k = walk(ids[a:b], parents[a:b])
            out_root += r
            out_depth += d
            out_path += p
            out_back += k
            a = b
        cols = {"ns": t.column("ns"), "id": t.column("id"), "root_id": pa.array(out_root, pa.string()), "depth": pa.array(out_depth, pa.int32())}
        if with_path:
            cols |= {"path": pa.array(out_path, pa.list_(pa.string())), "back_edge": pa.array(out_back, pa.bool_())}
        return pa.table(cols)

    return fn


def _doubled(nodes: DataFrame) -> DataFrame:
    """ns, id, parent, root_id, depth of the nodes of hot namespaces, by pointer doubling; no side is ever broadcast.

    After k rounds a node points 2**k steps up, or to its root. When a round reaches no further root, no tree node is
    left: depths are inhabited without gaps. The rest lies on or below circles; their doubling goes on until the
    steps exceed their number, so that each pointer is on its circle and the least id of as many steps from there is
    the least of the circle.
    """
    up = nodes.select(F.col("ns").alias("pns"), F.col("id").alias("p"))
    state = durable(
        nodes.join(up.hint("merge"), (F.col("ns") == F.col("pns")) & (F.col("parent") == F.col("p")), "left").select(
            "ns", "id", "parent", F.coalesce("p", "id").alias("ptr"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("int").alias("hops"), F.col("p").isNull().alias("done"), F.col("id").alias("least")
        )
    )

    def jump(s: DataFrame, over: DataFrame) -> DataFrame:
        t = over.select(F.col("ns").alias("tns"), F.col("id").alias("tid"), F.col("ptr").alias("tptr"), F.col("hops").alias("thops"), F.col("done").alias("tdone"), F.col("least").alias("tleast"))
        j = s.join(t.hint("merge"), (F.col("ns") == F.col("tns")) & (F.col("ptr") == F.col("tid")))
        return j.select("ns", "id", "parent", F.col("tptr").alias("ptr"), (F.col("hops") + F.col("thops")).alias("hops"), F.col("tdone").alias("done"), F.least("least", "tleast").alias("least"))

    left = state.where("not done").count()
    while left:
        # done rows are kept out of the jump: they all point at roots, which would make those hot keys
        state = durable(jump(state.where("not done"), state).unionByName(state.where("done")))
        still = state.where("not done").count()
        if still == left:
            break
        left = still
    open_, trees = state.where("not done"), state.where("done")
    trees = trees.select("ns", "id", "parent", F.col("ptr").alias("root_id"), F.col("hops").alias("depth"))
    if not left:
        return trees
    circ, steps = open_, 2
    while steps < left:
        circ = durable(jump(circ, circ))
        steps *= 2
    on = circ.select(F.col("ns").alias("tns"), F.col("id").alias("tid"), F.col("least").alias("tleast"))
    circles = circ.join(on.hint("merge"), (F.col("ns") == F.col("tns")) & (F.col("ptr") == F.col("tid"))).select("ns", "id", "parent", F.col("tleast").alias("root_id"), F.lit(-1).alias("depth"))
    return trees.unionByName(circles)


def _with_paths(giants: DataFrame) -> DataFrame:
    """Paths of components too large for one task: the ancestors of each node are gathered by doubling, then ordered."""
    s = durable(giants.select("ns", "id", "parent", "root_id", "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("ptr"), F.when(F.col("depth") >= 0, F.array("id")).alias("path")))
    while s.where("ptr is not null").limit(1).count():
        t = s.select(F.col("ns").alias("tns"), F.col("id").alias("tid"), F.col("ptr").alias("tptr"), F.col("path").alias("tpath"))
        s = durable(
            s.join(t.hint("merge"), (F.col("ns") == F.col("tns")) & (F.col("ptr") == F.col("tid")), "left").select("ns", "id", "parent", "root_id", "depth", F.col("tptr").alias("ptr"), F.when(F.col("tpath").isNull(), F.col("path")).otherwise(F.concat("tpath", "path")).alias("path"))
        )
    return s.select("ns", "id", "root_id", "depth", "path", ((F.col("id") == F.col("root_id")) & (F.col("depth") < 0)).alias("back_edge"))


def hierarchy(rows: DataFrame, namespace: str, node: str, parent: str, version: str | None = None, with_path: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row for each distinct (namespace, node): ``ns, id, root_id, depth`` and, if asked for, ``path, back_edge``.

    Ids are compared trimmed and in lower case. Of several rows of a node the one with the latest ``version`` counts;
    of equally late ones that with the greatest parent, a null parent being the least. A node whose parent is null,
    blank or absent from its namespace is a root of depth 0. Nodes on or below a circle have depth -1, the least id of
    the circle as root and a null path; ``back_edge`` marks that least node of each circle, whichever way it was found. Rows with a null or blank node id
    are left out; a null namespace is a namespace like any other. Other columns are ignored; an empty table gives an
    empty result.
    """
    ns = F.coalesce(F.concat(F.lit("="), F.col(namespace)), F.lit("null"))
    ver = F.col(version) if version else F.lit(0)
    slim = rows.select(ns.alias("ns"), clean_id(F.col(node)).alias("id"), clean_id(F.col(parent)).alias("parent"), ver.alias("ver")).where("id is not null")
    counts = rows.select(ns.alias("ns")).groupBy("ns").count().where(F.col("count") > hot_rows).select("ns")
    hot = [r[0] for r in counts.limit(MAX_HOT_LITERALS + 1).collect()]
    if len(hot) <= MAX_HOT_LITERALS:
        is_hot = F.col("ns").isin(hot) if hot else F.lit(False)
        usual, large = slim.where(~is_hot), slim.where(is_hot)
    else:
        usual, large = slim.join(counts, "ns", "left_anti"), slim.join(counts, "ns", "left_semi")
    newest = F.max(F.struct("ver", "parent")).alias("v")
    usual = usual.repartition("ns").groupBy("ns", "id").agg(newest).select("ns", F.lit("").alias("grp"), "id", F.col("v.parent").alias("parent"))
    schema = "ns string, id string, root_id string, depth int" + (", path array<string>, back_edge boolean" if with_path else "")
    walked = map_groups(usual, ["ns", "grp"], _walker(with_path), schema)
    if hot:
        nodes = durable(large.groupBy("ns", "id").agg(newest).select("ns", "id", F.col("v.parent").alias("parent")))
        comps = durable(_doubled(nodes))
        giant = comps.groupBy("ns", "root_id").count().where(F.col("count") > hot_rows).select("ns", "root_id")
        some = giant.limit(MAX_HOT_LITERALS + 1).collect()
        if some:
            small = comps.join(giant, ["ns", "root_id"], "left_anti")
            big = comps.join(giant, ["ns", "root_id"], "left_semi")
            walked = walked.unionByName(_with_paths(big) if with_path else big.select("ns", "id", "root_id", "depth"))
        else:
            small = comps
        small = small.select("ns", F.col("root_id").alias("grp"), "id", "parent")
        walked = walked.unionByName(map_groups(small, ["ns", "grp"], _walker(with_path), schema))
    return walked.withColumn("ns", F.when(F.col("ns") != "null", F.substring("ns", 2, 1_000_000)))


def descendants(paths: DataFrame) -> DataFrame:
    """Each node with each node below it and their distance, from the paths of :func:`hierarchy`.

    The pairs are the result asked for: their number is the sum of all depths, not the square of a group.
    """
    e = paths.where("depth > 0").select("ns", F.col("id").alias("descendant"), "depth", F.posexplode(F.slice("path", 1, F.col("depth"))).alias("pos", "id"))
    return e.select("ns", "id", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
