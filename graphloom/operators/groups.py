"""Strong components and cycles, modularity, surprising edges; communities over levels are in louvain.py, articulation points in blocks.py."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.loops import LOCAL_EDGES, dropped, few_edges, in_one_task, settled, stored
from graphloom.operators.louvain import communities, named  # noqa: F401


def _tarjan(a: list[str], b: list[str]) -> pa.RecordBatch:
    """(id, component = smallest member) of every end of the edges, in one pass with an explicit stack."""
    near: dict[str, list[str]] = {}
    for x, y in zip(a, b, strict=True):
        near.setdefault(x, []).append(y)
        near.setdefault(y, [])
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    inside: set[str] = set()
    open_: list[str] = []
    out: dict[str, str] = {}
    for root in near:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        open_.append(root)
        inside.add(root)
        walk = [(root, iter(near[root]))]
        while walk:
            v, it = walk[-1]
            w = next(it, None)
            if w is None:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
                if low[v] == order[v]:
                    members = [open_.pop()]
                    while members[-1] != v:
                        members.append(open_.pop())
                    inside.difference_update(members)
                    out.update(dict.fromkeys(members, min(members)))
            elif w not in order:
                order[w] = low[w] = len(order)
                open_.append(w)
                inside.add(w)
                walk.append((w, iter(near[w])))
            elif w in inside:
                low[v] = min(low[v], order[w])
    return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.string())], names=["id", "component"])


def _reach(pairs: DataFrame, colour: DataFrame) -> DataFrame:
    """(id, label): the smallest label(id, label) that reaches each node along pairs.

    Labels travel along edges and along one shortcut from each node, which doubles in length each round: a chain of n nodes takes about log n rounds.
    """
    labels = colour
    via = settled(pairs.groupBy("from_id").agg(F.min("to_id").alias("to_id")))
    while True:
        hops = pairs.union(via)
        low = hops.join(labels, hops.from_id == labels.id).groupBy("to_id").agg(F.min("label").alias("new"))
        nxt = settled(labels.join(low, labels.id == low.to_id, "left").select("id", F.least("label", F.coalesce("new", "label")).alias("label"), (F.coalesce("new", "label") < F.col("label")).alias("moved")))
        labels = nxt.select("id", "label")
        if nxt.where("moved").isEmpty():
            return labels
        via = settled(via.select("from_id", F.col("to_id").alias("mid")).join(via.withColumnRenamed("from_id", "mid"), "mid").select("from_id", "to_id"))


def strong_components(nodes: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component = smallest member).

    Nodes that lie on no cycle are trimmed from both ends; what is left is coloured forwards and searched backwards per colour, until
    its edges are few enough (counted) for one task, which finishes by one depth-first pass.
    """
    every = nodes.select("id").distinct()
    pairs = edges.select("from_id", "to_id").where("from_id <> to_id").distinct()
    pairs = settled(pairs.join(every.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(every.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select("from_id", "to_id"))
    done: list[DataFrame] = []
    while not few_edges(pairs, local_edges):
        heads = pairs.select(F.col("to_id").alias("from_id")).distinct()
        tails = pairs.select(F.col("from_id").alias("to_id")).distinct()
        inner = settled(pairs.join(heads, "from_id", "left_semi").join(tails, "to_id", "left_semi").select("from_id", "to_id"))
        if inner.count() < 0.9 * pairs.count():  # a trimmed layer that pays for its round
            pairs = inner
            continue
        ends = pairs.select(F.col("from_id").alias("id")).union(pairs.select("to_id")).distinct()
        colour = _reach(pairs, settled(ends.withColumn("label", F.col("id"))))
        same = pairs.join(colour.select(F.col("id").alias("from_id"), F.col("label").alias("a")), "from_id").join(colour.select(F.col("id").alias("to_id"), F.col("label").alias("b")), "to_id").where("a = b")
        back = settled(same.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
        # within a colour, what reaches the node that gave it is that node's component
        seeds = colour.select("id", F.when(F.col("id") == F.col("label"), F.lit(0)).otherwise(F.lit(1)).alias("label"))
        member = _reach(back, settled(seeds)).where("label = 0").join(colour.withColumnRenamed("label", "component"), "id").select("id", "component")
        member = settled(member)
        done.append(member)
        gone = member.select(F.col("id").alias("from_id"))
        pairs = settled(pairs.join(gone, "from_id", "left_anti").join(gone.withColumnRenamed("from_id", "to_id"), "to_id", "left_anti").select("from_id", "to_id"))
    done.append(in_one_task(pairs, _tarjan, "id string, component string"))
    found = reduce(DataFrame.union, done)
    return every.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def cycles(components: DataFrame, edges: DataFrame, rank: DataFrame) -> DataFrame:
    """Components of two and more: members, their number and edges, the weakest link (edge whose source ranks lowest)
    and the member to extract (highest rank); ties to the smaller id. Parallel edges are all listed."""
    big = components.groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("members"), F.count(F.lit(1)).alias("size")).where("size >= 2")
    ranked = components.join(rank, "id", "left").withColumn("r", F.round(F.coalesce("pagerank", F.lit(0.0)), 12))
    best = ranked.groupBy("component").agg(F.min_by("id", F.struct(-F.col("r"), F.col("id"))).alias("extract"))
    inside = edges.where("from_id <> to_id").join(ranked.select(F.col("id").alias("from_id"), F.col("component").alias("a"), "r"), "from_id").join(components.select(F.col("id").alias("to_id"), F.col("component").alias("b")), "to_id").where("a = b")
    weak = inside.groupBy(F.col("a").alias("component")).agg(F.count(F.lit(1)).alias("edges"), F.min(F.struct("r", "from_id", "to_id")).alias("w"))
    return big.join(best, "component").join(weak, "component").select("component", F.array_join("members", ",").alias("members"), "size", "edges", F.col("w.from_id").alias("weak_from"), F.col("w.to_id").alias("weak_to"), "extract")


def _union_find(a: list[str], b: list[str]) -> pa.RecordBatch:
    """(id, component = smallest member) of every end of the edges."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    ids = list(root)
    kind = pa.int64() if ids and isinstance(ids[0], int) else pa.string()
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([find(x) for x in ids], kind)], names=["id", "component"])


def connected(nodes: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component = smallest member), ignoring direction; ids are strings or bigints.

    Alternating large and small stars: each round joins a node's larger neighbours, then its smaller ones, to its smallest, so rounds
    grow with the logarithm of the nodes. A hub's rows are aggregated before the shuffle. Few edges (counted) are one task's work.
    """
    pairs = edges.where("from_id <> to_id").select(F.greatest("from_id", "to_id").alias("u"), F.least("from_id", "to_id").alias("v"))
    pairs = stored(pairs.distinct())
    if few_edges(pairs, local_edges):
        kind = pairs.schema["u"].dataType.simpleString()
        found = in_one_task(pairs.select(F.col("u").alias("from_id"), F.col("v").alias("to_id")), _union_find, f"id {kind}, component {kind}")
    else:
        last = None
        while True:
            both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            down = large.groupBy("u").agg(F.min("v").alias("m"))
            ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
            new = stored(large.join(down.hint("merge"), "u").select(ends).select("x.u", "x.v").where("u <> v").distinct())
            dropped(pairs)
            pairs = new
            state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == last:
                break
            last = state
        found = pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def modularity(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: Q of (id, community) over weighted undirected edges."""
    e = edges.where("from_id <> to_id").select("from_id", "to_id", F.col("weight").cast("double").alias("w"))
    ends = e.select(F.col("from_id").alias("id"), "w").union(e.select(F.col("to_id").alias("id"), "w")).groupBy("id").agg(F.sum("w").alias("k"))
    by = labels.join(ends, "id").groupBy("community").agg(F.sum("k").alias("k"))
    inside = e.join(labels.select(F.col("id").alias("from_id"), F.col("community").alias("a")), "from_id").join(labels.select(F.col("id").alias("to_id"), F.col("community").alias("b")), "to_id")
    m = e.agg(F.sum("w").alias("m"))
    part = inside.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"))
    return by.agg(F.sum(F.col("k") * F.col("k")).alias("k2")).crossJoin(m).crossJoin(part).select((F.col("inside") / F.col("m") - F.col("k2") / (4 * F.col("m") * F.col("m"))).alias("modularity"))  # one row each


def surprising_edges(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_id, to_id, score): edges between communities, scored by the rarity of edges between those two."""
    both = edges.select("from_id", "to_id").distinct().join(labels.select(F.col("id").alias("from_id"), F.col("community").alias("a")), "from_id").join(labels.select(F.col("id").alias("to_id"), F.col("community").alias("b")), "to_id").where("a <> b")
    size = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    n = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("links"))
    dense = n.join(size.select(F.col("community").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("community").alias("b"), F.col("n").alias("nb")), "b")
    return both.join(dense.select("a", "b", (1 - F.col("links") / (F.col("na") * F.col("nb"))).alias("score")), ["a", "b"]).select("from_id", "to_id", F.round("score", 6).alias("score"))
