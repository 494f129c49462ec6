"""Communities by modularity over many levels: local moving, contraction to super-nodes with self-loops, and again.

A level moves nodes in synchronous rounds, half of them a round, until rounds better the modularity no further; then each community becomes a
node, the weights between communities add up, what lies inside one is its self-loop, and the next level moves those nodes. Levels end
when one no longer betters the modularity. The first level is joins and groupings over the whole graph at any size; contracted graphs are too, until
one has few enough edges (counted) for one task, which goes through the same rounds over arrays and gives the same labels.

With ``part_edges`` a level's rounds go over the graph dealt in parts of about that many edges, which is several times faster than joins and gives the
same labels, too: a task has a part's nodes, its edges and the labels that lead to them as arrays. A round is two exchanges: nodes go to their
community's part, which adds up its degrees, and labels with those go on to the parts that have an edge to the node. No task has more than its part and what it borders on.

Inside, nodes and communities are the 64-bit hashes of their ids, which also break ties; that no two ids share one is checked, and another
seed is taken if they do. So a round's rows are narrow: it sends the edges twice, the nodes four times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.loops import LOCAL_EDGES, dropped, few_edges, stored

#: A betterment below it is none; sums may come in any order.
LEAST_GAIN = 1e-9
#: A round of the first level that betters the modularity by less counts as one without progress: contraction gets further than more
#: rounds over the whole graph. So it is in contracted graphs of over LOCAL_EDGES edges, whatever way their rounds go; smaller ones' rounds go on longer.
PROGRESS, FURTHER = 0.01, 1e-5
#: Edges of a part, about, both directions.
PART_EDGES = 500_000
#: Bits of a node's hash, which stands for it: one tells in which of two rounds it may move, so a pair of rounds asks every node.
_BITS = 61


def symmetric(edges: DataFrame) -> DataFrame:
    """(from_id, to_id, w): both directions of weighted undirected edges(from_id, to_id, w), parallel ones added; no loops."""
    und = edges.where("from_id <> to_id").select("from_id", "to_id", "w")
    return und.union(und.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "w")).groupBy("from_id", "to_id").agg(F.sum("w").alias("w"))


def _contracted(und: DataFrame, labels: DataFrame) -> DataFrame:
    """und between communities; a community's self-loop holds its inner weight, both directions."""
    a, b = labels.select(F.col("id").alias("from_id"), F.col("community").alias("a")), labels.select(F.col("id").alias("to_id"), F.col("community").alias("b"))
    return und.join(a, "from_id").join(b, "to_id").groupBy(F.col("a").alias("from_id"), F.col("b").alias("to_id")).agg(F.sum("w").alias("w"))


def _moved(und: DataFrame, two_m: float, patience: int, progress: float) -> tuple[DataFrame, float]:
    """(id, community) and modularity after one level's rounds.

    A node's row carries its own degree and self-loop. A round joins the nodes with their communities' degrees, the edges with what they lead to,
    and has all of a node's edges in one place from then on: sums by community, the best one and the move need no further exchange. Labels are never broadcast: each round's would pass through the driver.
    """
    loop = F.sum(F.when(F.col("from_id") == F.col("to_id"), F.col("w")).otherwise(0.0))
    label = stored(und.groupBy(F.col("from_id").alias("id")).agg(F.sum("w").alias("k"), loop.alias("loop")).withColumn("community", F.col("id")))
    links = und.where("from_id <> to_id")
    best, top, stale = label, float("-inf"), 0
    for r in count():
        total = label.groupBy("community").agg(F.sum("k").alias("total"))
        ends = label.select("id", "community").join(total.hint("merge"), "community").select(F.col("id").alias("to_id"), "community", "total")
        near = links.join(ends.hint("merge"), "to_id").select(F.col("from_id").alias("id"), "community", "total", "w").repartition("id")
        inside = near.groupBy("id", "community").agg(F.sum("w").alias("inside"), F.max("total").alias("total"))
        own = label.select("id", "k", F.col("community").alias("mine"))
        at_home = F.col("community") == F.col("mine")
        gain = inside.join(own.hint("merge"), "id").withColumn("gain", F.round(F.col("inside") - F.col("k") * (F.col("total") - F.when(at_home, F.col("k")).otherwise(0.0)) / two_m, 9))
        pick = gain.groupBy("id").agg(
            F.max_by("community", F.struct("gain", at_home, F.bitwise_not("community"))).alias("to"), F.max("gain").alias("best"),
            F.max(F.when(at_home, F.col("gain"))).alias("stay"), F.sum(F.when(at_home, F.col("inside")).otherwise(0.0)).alias("within"),
        )
        free = F.shiftrightunsigned("id", r // 2 % _BITS).bitwiseAND(F.lit(1)) == r % 2
        goes = free & (F.col("best") > F.coalesce("stay", F.lit(0.0)))
        new = stored(label.join(pick.hint("merge"), "id", "left").select("id", "k", "loop", F.col("community").alias("was"), F.when(goes, F.col("to")).otherwise(F.col("community")).alias("community"), (F.col("loop") + F.coalesce("within", F.lit(0.0))).alias("within")))
        within, squares = new.groupBy("was").agg(F.sum("k").alias("k"), F.sum("within").alias("within")).agg(F.sum("within"), F.sum(F.col("k") * F.col("k"))).first()
        q = within / two_m - squares / two_m**2  # of the labels before this round's moves
        stale = 0 if q > top + progress else stale + 1
        spent = best if q > top + LEAST_GAIN else label
        best, top = (label, q) if q > top + LEAST_GAIN else (best, top)
        if spent is not best:
            dropped(spent)
        if stale >= patience and r % 2 == 0:
            dropped(new)
            return best.select("id", "community"), top
        label = new.select("id", "k", "loop", "community")
        label._graphloom_path = new._graphloom_path


def _going(a: np.ndarray, w: np.ndarray, near: np.ndarray, mine: np.ndarray, k: np.ndarray, total: np.ndarray, free: np.ndarray, two_m: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the nodes move, and the communities that they move to: numbers in the order of hashes.

    a and w are the edges' nodes and weights, near the communities they lead to; mine are the nodes' own ones, k their degrees, free those that may move.
    """
    asked = free[a]
    key = a[asked] * len(total) + near[asked]
    order = np.argsort(key, kind="stable")
    key = key[order]
    if not len(key):
        return key, key
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    inside = np.add.reduceat(w[asked][order], at)
    x, c = np.divmod(key[at], len(total))
    home = c == mine[x]
    # rounding as in the joins: half up, to nine places
    gain = inside - k[x] * (total[c] - np.where(home, k[x], 0.0)) / two_m
    gain = np.sign(gain) * np.floor(np.abs(gain) * 1e9 + 0.5) / 1e9
    stay = np.zeros(len(k))
    stay[x[home]] = gain[home]
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    best = np.repeat(np.maximum.reduceat(gain, first), np.diff(np.append(first, len(x))))
    top = np.flatnonzero((gain == best) & (gain > stay[x]))  # the smallest hash of a node's best ones comes first
    top = top[np.append(True, x[top][1:] != x[top][:-1])] if len(top) else top
    return x[top], c[top]


def _level_of_arrays(a: np.ndarray, b: np.ndarray, w: np.ndarray, hashes: np.ndarray, two_m: float, patience: int) -> tuple[np.ndarray, float]:
    """The rounds of _moved over arrays of node numbers: every node's community (a node's number) and the modularity."""
    n = len(hashes)
    k = np.bincount(a, w, n)
    loop = np.bincount(a[a == b], w[a == b], n).sum()
    a, b, w = a[a != b], b[a != b], w[a != b]
    label = np.arange(n)
    best, top, stale = label, float("-inf"), 0
    for r in count():
        total = np.bincount(label, k, n)
        near = label[b]
        q = (loop + w[label[a] == near].sum()) / two_m - (total * total).sum() / two_m**2
        stale = 0 if q > top + FURTHER else stale + 1
        best, top = (label, q) if q > top + LEAST_GAIN else (best, top)
        if stale >= patience and r % 2 == 0:
            return best, top
        goes, to = _going(a, w, near, label, k, total, _free(hashes, r), two_m)
        label = label.copy()
        label[goes] = to


def _free(hashes: np.ndarray, r: int) -> np.ndarray:
    """Which nodes may move in a round."""
    return (hashes.view(np.uint64) >> np.uint64(r // 2 % _BITS)) & np.uint64(1) == r % 2


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each node: bits of its hash that say little about when it may move."""
    return ((hashes.view(np.uint64) >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)


def _of_bytes(rows: pa.Table, **kinds: type) -> list[np.ndarray]:
    """Columns of arrays' bytes, each one array over all rows."""
    return [np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in rows.column(name) if x.is_valid)]) for name, kind in kinds.items()]


def _sent(to: np.ndarray, parts: int, number: float = 0.0, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each part with its share of the columns as bytes; number goes with the first one."""
    order = np.argsort(to, kind="stable")
    ends = np.searchsorted(to[order], np.arange(parts + 1))
    columns = {name: c[order] for name, c in columns.items()}
    for part in np.unique(to):
        share = {name: pa.array([c[ends[part] : ends[part + 1]].tobytes()], pa.binary()) for name, c in columns.items()}
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), **share, "number": pa.array([number])})
        number = 0.0


_GRAPH = "part int, nodes binary, k binary, bound binary, mine binary, a binary, b binary, w binary, at binary, goal binary, number double"
_STATE = "part int, id binary, community binary, k binary, goal binary, number double, within double"
_NEWS = "part int, id binary, community binary, total binary, number double"


def _dealt(und: DataFrame, parts: int) -> DataFrame:
    """A row for each part of the graph: its nodes, what they border on, its edges, and for each node the parts with an edge to it (its own, too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if not rows:
            return
        a, b, w = (rows.column(i).to_numpy() for i in range(3))
        nodes, a = np.unique(a, return_inverse=True)
        k, loop = np.bincount(a, w, len(nodes)), nodes[a] == b
        bound = np.union1d(nodes, b)
        part = _part_of(nodes[:1], parts)
        pairs = np.unique(np.append(a * parts + _part_of(b, parts), np.arange(len(nodes)) * parts + part))
        inside, other = float(w[loop].sum()), ~loop
        put = {"nodes": nodes, "k": k, "bound": bound, "mine": np.searchsorted(bound, nodes), "a": a[other], "b": np.searchsorted(bound, b[other]), "w": w[other], "at": pairs // parts, "goal": pairs % parts}
        row = {name: pa.array([(c.astype(np.int32) if name in ("mine", "a", "b", "at", "goal") else c).tobytes()], pa.binary()) for name, c in put.items()}
        yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), **row, "number": pa.array([inside])})

    part = (F.shiftrightunsigned("from_id", 40) % parts).cast("int")
    return stored(und.select("from_id", "to_id", "w").repartitionById(parts, part).mapInArrow(run, _GRAPH))


def _labelled(rows: pa.Table, parts: int, label: np.ndarray, within: float, squares: float) -> Iterator[pa.RecordBatch]:
    """A part's nodes, sent to their communities' parts: once for each part with an edge to them, with the degree the one time that it is their own."""
    nodes, k, at, goal = _of_bytes(rows, nodes=np.int64, k=np.float64, at=np.int32, goal=np.int32)
    own = goal == _part_of(nodes[:1], parts)
    for batch in _sent(_part_of(label, parts)[at], parts, squares, id=nodes[at], community=label[at], k=np.where(own, k[at], 0.0), goal=goal):
        yield batch.append_column("within", pa.array([within]))
        within = 0.0


def _moved_in_parts(und: DataFrame, two_m: float, patience: int, progress: float, part_edges: int) -> tuple[DataFrame, float]:
    """_moved over the graph dealt in parts."""
    parts = max(int(und.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-und.count() // part_edges))
    graph = _dealt(und, parts)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = pa.Table.from_batches([batch.slice(i, 1)])
                yield from _labelled(rows, parts, _of_bytes(rows, nodes=np.int64)[0], 0.0, 0.0)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if not rows:
            return
        id, community, k, goal = _of_bytes(rows, id=np.int64, community=np.int64, k=np.float64, goal=np.int32)
        names, inverse = np.unique(community, return_inverse=True)
        total = np.bincount(inverse, k, len(names))
        yield from _sent(goal, parts, float((total * total).sum()), id=id, community=community, total=total[inverse])

    def moves(r: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
            if not rows:
                return
            nodes, k, bound, mine, a, b, w = _of_bytes(rows, nodes=np.int64, k=np.float64, bound=np.int64, mine=np.int32, a=np.int32, b=np.int32, w=np.float64)
            id, community, sums = _of_bytes(rows, id=np.int64, community=np.int64, total=np.float64)
            is_graph = rows.column("nodes").is_valid().to_numpy()
            number = rows.column("number").to_numpy()
            names, inverse = np.unique(community, return_inverse=True)
            label, total = np.empty(len(bound), np.int64), np.empty(len(names))
            label[np.searchsorted(bound, id)] = inverse
            total[inverse] = sums
            own, near, a = label[mine], label[b], a.astype(np.int64)
            within = number[is_graph].sum() + w[own[a] == near].sum()
            goes, to = _going(a, w, near, own, k, total, _free(nodes, r), two_m)
            own[goes] = to
            yield from _labelled(rows, parts, names[own], float(within), float(number[~is_graph].sum()))

        return run

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id, community, goal = _of_bytes(pa.Table.from_batches([batch]), id=np.int64, community=np.int64, goal=np.int32)
            own = goal == _part_of(id, parts)
            yield pa.RecordBatch.from_arrays([pa.array(id[own]), pa.array(community[own])], names=["id", "community"])

    state = stored(graph.mapInArrow(start, _STATE))
    best, top, stale = state, float("-inf"), 0
    for r in count():
        news = state.select("part", "id", "community", "k", "goal").repartitionById(parts, F.col("part")).mapInArrow(totals, _NEWS)
        new = stored(graph.unionByName(news, allowMissingColumns=True).repartitionById(parts, F.col("part")).mapInArrow(moves(r), _STATE))
        within, squares = new.agg(F.sum("within"), F.sum("number")).first()
        q = within / two_m - squares / two_m**2  # of the labels before this round's moves
        stale = 0 if q > top + progress else stale + 1
        spent = best if q > top + LEAST_GAIN else state
        best, top = (state, q) if q > top + LEAST_GAIN else (best, top)
        if spent is not best:
            dropped(spent)
        if stale >= patience and r % 2 == 0:
            dropped(new)
            found = stored(best.mapInArrow(labels, "id long, community long"))
            dropped(best)
            dropped(graph)
            return found, top
        state = new


def _levels_in_one_task(und: DataFrame, two_m: float, q: float, patience: int) -> DataFrame:
    """(id, community) of a contracted graph after all further levels, for few edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        hashes, a = np.unique(rows.column(0).to_numpy(), return_inverse=True)
        b, w = np.searchsorted(hashes, rows.column(1).to_numpy()), rows.column(2).to_numpy()
        belongs, top = np.arange(len(hashes)), q  # numbers of hashes; nodes keep them from level to level
        while len(hashes):
            label, better = _level_of_arrays(a, b, w, hashes, two_m, patience)
            if better <= top + LEAST_GAIN:
                break
            top, belongs = better, label[belongs]
            key, inverse = np.unique(label[a] * len(hashes) + label[b], return_inverse=True)
            a, b, w = key // len(hashes), key % len(hashes), np.bincount(inverse, w, len(key))
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(hashes[belongs])], names=["id", "community"])

    return und.select("from_id", "to_id", "w").coalesce(1).mapInArrow(run, "id long, community long")


def _code(seed: int, id: str) -> Column:
    return F.xxhash64(id, F.lit(seed)) if seed else F.xxhash64(id)


def _coded(nodes: DataFrame, edges: DataFrame, code: Callable[[int, str], Column]) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes(id, code), and both directions of the edges over codes; the first seed for which no two ids have one code."""
    ids = stored(nodes.select("id").union(edges.select("from_id")).union(edges.select("to_id")).where("id is not null").distinct())
    for seed in count():
        coded = ids.select(code(seed, "id").alias("code"))
        if coded.groupBy("code").count().where("count > 1").isEmpty():
            break
    dropped(ids)
    pairs = edges.where("from_id <> to_id").select(code(seed, "from_id").alias("from_id"), code(seed, "to_id").alias("to_id"), F.col("weight").cast("double").alias("w"))
    return nodes.where("id is not null").select("id", code(seed, "id").alias("code")).distinct(), stored(symmetric(pairs))


def by_level(nodes: DataFrame, edges: DataFrame, patience: int = 2, local_edges: int = LOCAL_EDGES, levels: int | None = None, code: Callable[[int, str], Column] = _code, part_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, community) of every node after the first level and after the last, not yet named."""
    every, und = _coded(nodes, edges, code)
    two_m, first, belongs, q = und.agg(F.sum("w")).first()[0], None, None, float("-inf")
    if not two_m:
        alone = every.select("id", F.col("code").alias("community"))
        return alone, alone
    for level in count(1):
        if level > 1 and levels is None and few_edges(und, local_edges):
            belongs = _composed(belongs, stored(_levels_in_one_task(und, two_m, q, patience)))
            break
        how = (und, two_m, patience, PROGRESS if level == 1 or not few_edges(und) else FURTHER)
        found, better = _moved_in_parts(*how, part_edges) if part_edges else _moved(*how)
        if better <= q + LEAST_GAIN:
            break
        q, belongs = better, stored(found if belongs is None else _composed(belongs, found))
        first = first or belongs
        if level == levels:
            break
        und = stored(_contracted(und, found))
    of_all = lambda labels: every.join(labels.withColumnRenamed("id", "code"), "code", "left").select("id", F.coalesce("community", "code").alias("community"))
    return of_all(first), of_all(belongs)


def communities(nodes: DataFrame, edges: DataFrame, least: int = 1, patience: int = 2, local_edges: int = LOCAL_EDGES, levels: int | None = None, part_edges: int | None = None) -> DataFrame:
    """(id, community) of every node; edges(from_id, to_id, weight) are undirected.

    Communities are named by their smallest member; those of under ``least`` members are noise and become -1. A level ends when none of ``patience``
    rounds in a row has made progress; its best labels count. ``levels`` bounds their number. Ties go to the community the node is in, then to
    the label with the smaller hash. Deterministic whatever the partitions, and the same whatever ``local_edges``, below which contracted graphs are one task's work,
    and ``part_edges``, the edges of a part if rounds go over parts and not through joins.
    """
    return named(by_level(nodes, edges, patience, local_edges, levels, part_edges=part_edges)[1], least)


def named(labels: DataFrame, least: int) -> DataFrame:
    """Communities named by their smallest member; those of under least members are -1."""
    name = labels.groupBy("community").agg(F.min("id").alias("name"), F.count(F.lit(1)).alias("n"))
    return labels.join(name, "community").select("id", F.when(F.col("n") >= least, F.col("name")).otherwise("-1").alias("community"))


def _composed(belongs: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes' communities after the super-nodes found theirs."""
    return belongs.withColumnRenamed("community", "super").join(found.withColumnRenamed("id", "super"), "super").select("id", "community")
