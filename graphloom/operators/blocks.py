"""Biconnected blocks and articulation points, without a task that holds a large component.

For articulation points, components of few edges (counted) are dealt over tasks, each of which goes through its own depth first. For the others, and for blocks,
every step is joins, groupings and ranges whose rounds grow with the logarithm of the nodes: a spanning forest by rounds of smallest outgoing
edges, an Euler tour of it ranked by pointer doubling, preorder numbers and subtree sizes from the tour's places, the extremes of each subtree's other
edges over dyadic cells of the preorder, and the components of an auxiliary graph over tree edges, which are the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.groups import connected
from graphloom.operators.loops import LOCAL_EDGES, dropped, few_edges, stored
from graphloom.operators.relational import numbered


def _joined(nodes: DataFrame, pairs: DataFrame, local_edges: int) -> DataFrame:
    """(v, c): components of numbered nodes(v) over pairs(a, b); c is one of a component's nodes."""
    found = connected(nodes.select(F.col("v").alias("id")), pairs.select(F.col("a").alias("from_id"), F.col("b").alias("to_id")), local_edges)
    return found.select(F.col("id").alias("v"), F.col("component").alias("c"))


def _forest_in_one_task(crossing: DataFrame) -> DataFrame:
    """(a, b): edges that join the labels x and y without a cycle, for few edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = find(x), find(y)
                root[x] = y
                keep.append(x != y)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return crossing.select("a", "b", "x", "y").coalesce(1).mapInArrow(run, "a bigint, b bigint")


def spanning_forest(pairs: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(a, b): the edges of a spanning forest of distinct pairs(a, b) of numbers, a < b.

    Each round every tree takes its smallest outgoing edge, trees that meet become one, and of several edges between two trees one stays.
    After a round, an end of few edges (counted) is one task's work.
    """
    crossing, done = pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), []
    while True:
        both = crossing.union(crossing.select("a", "b", "y", "x"))
        picked = both.groupBy("x").agg(F.min(F.struct("a", "b", "y")).alias("e")).select("x", "e.*")
        chosen = stored(picked.select("a", "b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        done.append(chosen.select("a", "b"))
        trees = stored(_joined(picked.select(F.col("x").alias("v")), chosen.select(F.col("x").alias("a"), F.col("y").alias("b")), local_edges))
        ends = lambda v, c: trees.select(F.col("v").alias(v), F.col("c").alias(c))
        moved = crossing.join(ends("x", "cx"), "x").join(ends("y", "cy"), "y").where("cx <> cy")
        crossing = stored(moved.groupBy(F.least("cx", "cy").alias("x"), F.greatest("cx", "cy").alias("y")).agg(F.min(F.struct("a", "b")).alias("e")).select("e.a", "e.b", "x", "y"))
        if few_edges(crossing, local_edges):
            done.append(_forest_in_one_task(crossing))
            return stored(reduce(DataFrame.union, done))


def _ranked(succ: DataFrame) -> DataFrame:
    """(p, dist): of succ(p, next), lists whose last next is null, each element's distance to its list's end; pointers double in length each round."""
    state = stored(succ.withColumn("dist", F.lit(1).cast("bigint")))
    while not state.where("next IS NOT NULL").isEmpty():
        ahead = state.select(F.col("p").alias("next"), F.col("next").alias("then"), F.col("dist").alias("more"))
        new = stored(state.join(ahead, "next", "left").select("p", F.col("then").alias("next"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist")))
        dropped(state)
        state = new
    return state.select("p", "dist")


def rooted(forest: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(v, parent, pre, size) of every node of a forest(a, b): parents (null at roots), preorder numbers over all trees, nodes of the subtree."""
    arcs = forest.select(F.col("a").alias("x"), F.col("b").alias("y")).union(forest.select("b", "a"))
    arcs = stored(numbered(arcs, F.col("x"), F.col("y"), name="p"))
    around = stored(arcs.groupBy("x").agg(F.min("p").alias("first"), F.count(F.lit(1)).alias("degree")))
    trees = stored(_joined(around.select(F.col("x").alias("v")), forest, local_edges))
    starts = around.join(trees.where("v = c").select(F.col("v").alias("x")), "x").select(F.col("first").alias("next"), F.lit(True).alias("begins"))
    # after x -> y the tour leaves y by the arc that follows y -> x among y's arcs, in a circle
    twins = stored(arcs.join(arcs.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("p").alias("q")), ["x", "y"]))
    succ = twins.join(around.withColumnRenamed("x", "y"), "y").select("p", F.when(F.col("q") + 1 < F.col("first") + F.col("degree"), F.col("q") + 1).otherwise(F.col("first")).alias("next"))
    succ = succ.join(starts, "next", "left").select("p", F.when(F.col("begins").isNull(), F.col("next")).alias("next"))
    rank = stored(_ranked(succ))
    way = twins.join(rank, "p").join(rank.select(F.col("p").alias("q"), F.col("dist").alias("back")), "q")
    down = way.where("dist > back").select(F.col("y").alias("v"), F.col("x").alias("parent"), "dist", ((F.col("dist") - F.col("back") + 1) / 2).cast("bigint").alias("size"))
    whole = trees.groupBy("c").agg(F.count(F.lit(1)).alias("size")).select(F.col("c").alias("v"), F.lit(None).cast("bigint").alias("parent"), F.lit((1 << 62)).alias("dist"), "size")
    return stored(numbered(down.union(whole).join(trees, "v"), F.col("c"), F.desc("dist"), name="pre").select("v", "parent", "pre", "size"))


def _over_subtrees(tree: DataFrame, own: DataFrame) -> DataFrame:
    """(v, low, high): the smallest and largest of own(v, low, high) over each subtree, an interval of preorder numbers.

    Dyadic cells of the numbers hold extremes, and an interval is at most two cells a level.
    """
    levels = max(1, (tree.count() - 1).bit_length())
    each = tree.join(own, "v", "left").select("v", "pre", "size", F.least("low", "pre").alias("low"), F.greatest("high", "pre").alias("high"))
    j = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("j")
    cells = each.select("pre", "low", "high", j).groupBy("j", F.expr("shiftright(pre, j)").alias("i")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    left, right = "shiftright(pre + shiftleft(1L, j) - 1, j)", "shiftright(pre + size, j)"
    at = f"""explode(flatten(transform(sequence(0, {levels}), j -> CASE WHEN {left} < {right} THEN filter(array(
        CASE WHEN {left} % 2 = 1 THEN struct(j AS j, {left} AS i) END, CASE WHEN {right} % 2 = 1 THEN struct(j AS j, {right} - 1 AS i) END), x -> x IS NOT NULL) ELSE array() END)))"""
    parts = each.select("v", F.expr(at).alias("cell")).select("v", "cell.j", "cell.i")
    return parts.join(cells, ["j", "i"]).groupBy("v").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def blocks(pairs: DataFrame, local_edges: int = LOCAL_EDGES) -> tuple[DataFrame, DataFrame]:
    """The rooted forest (v, parent, pre, size) of distinct pairs(a, b) of numbers, a < b, and (v, block) of every node but the roots:
    the block of the tree edge above it, named by one of its nodes."""
    forest = spanning_forest(pairs, local_edges)
    tree = rooted(forest, local_edges)
    end = lambda v: tree.select(F.col("v").alias(v), F.col("pre").alias(f"pre_{v}"), F.col("size").alias(f"size_{v}"))
    other = stored(pairs.join(forest, ["a", "b"], "left_anti").join(end("a"), "a").join(end("b"), "b"))
    own = other.select(F.col("a").alias("v"), F.col("pre_b").alias("to")).union(other.select("b", "pre_a")).groupBy("v").agg(F.min("to").alias("low"), F.max("to").alias("high"))
    reach = _over_subtrees(tree, own)
    apart = other.where("pre_a + size_a <= pre_b OR pre_b + size_b <= pre_a").select("a", "b")
    above = tree.where("parent IS NOT NULL").select("v", "parent").join(reach, "v").join(tree.where("parent IS NOT NULL").select(F.col("v").alias("parent"), "pre", "size"), "parent")
    leaves = above.where("low < pre OR high >= pre + size").select(F.col("v").alias("a"), F.col("parent").alias("b"))
    found = _joined(tree.where("parent IS NOT NULL").select("v"), apart.union(leaves), local_edges)
    return tree, stored(found.select("v", F.col("c").alias("block")))


def _cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The articulation points of distinct pairs of numbers, by one depth-first pass with an explicit stack; it may hold several components."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends, np.concatenate([ends[len(a) :], ends[: len(a)]])
    near = y[np.argsort(x, kind="stable")].tolist()
    stop = np.cumsum(np.bincount(x, minlength=len(ids))).tolist()
    at = [0, *stop[:-1]]
    order, low, parent, cut = [0] * len(ids), [0] * len(ids), [-1] * len(ids), [False] * len(ids)
    step = 0
    for root in range(len(ids)):
        if order[root]:
            continue
        step += 1
        order[root] = low[root] = step
        v, children = root, 0
        while True:
            if at[v] < stop[v]:
                w = near[at[v]]
                at[v] += 1
                if not order[w]:
                    parent[w], step = v, step + 1
                    order[w] = low[w] = step
                    children += v == root
                    v = w
                elif w != parent[v] and order[w] < low[v]:
                    low[v] = order[w]
            else:
                up = parent[v]
                if up < 0:
                    break
                low[up] = min(low[up], low[v])
                cut[up] |= up != root and low[v] >= order[up]
                v = up
        cut[root] = children > 1
    return ids[np.array(cut, bool)]


def _lots(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of lots of whole components, from rows (c, a, b) with a component's rows together; a lot ends with the component that brings it to ``most`` edges."""
    lot, n, last = [], 0, None
    joined = lambda: tuple(np.concatenate(x) for x in zip(*lot, strict=True))
    for batch in batches:
        c, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        starts = np.flatnonzero(c[1:] != c[:-1]) + 1
        i = 0
        while i < len(c):
            if n >= most and c[i] != last:
                yield joined()
                lot, n = [], 0
            k = np.searchsorted(starts, max(i + most - n, i + 1))
            j = int(starts[k]) if k < len(starts) else len(c)
            lot.append((a[i:j], b[i:j]))
            n, last, i = n + j - i, c[j - 1], j
    if lot:
        yield joined()


def _cuts_by_component(pairs: DataFrame, tasks: int, most: int) -> DataFrame:
    """(v): articulation points of pairs(c, a, b), dealt by component c; a task holds one lot of components of about ``most`` edges at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _lots(batches, most):
            yield pa.RecordBatch.from_arrays([pa.array(_cuts(a, b), pa.int64())], names=["v"])

    return pairs.select("c", "a", "b").repartition(tasks, "c").sortWithinPartitions("c").mapInArrow(run, "v bigint")


def articulation_points(nodes: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Ids of nodes whose removal splits their component: those on two blocks and more. Direction, loops and parallel edges don't count.

    ``local_edges`` bounds the components that are one task's work, and the residues that a spanning forest and components finish in one; the result is the same for any.
    """
    names = stored(nodes.select("id").where("id IS NOT NULL").distinct().withColumn("v", F.monotonically_increasing_id()))  # written once, so numbers stay
    end = lambda id, v: names.select(F.col("id").alias(id), F.col("v").alias(v)).hint("merge")
    ends = edges.where("from_id <> to_id").select(F.col("from_id").alias("s"), F.col("to_id").alias("t")).join(end("s", "x"), "s").join(end("t", "y"), "t")
    ends = stored(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if ends.isEmpty():
        return names.select("id").limit(0)
    label = _joined(ends.select(F.col("a").alias("v")), ends, local_edges).withColumnRenamed("v", "a")
    parts = stored(ends.join(label.hint("merge"), "a").select("c", "a", "b"))
    size = parts.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    large = stored(size.where(F.col("n") > local_edges).select("c"))
    found = []
    if not large.isEmpty():
        tree, block = blocks(stored(parts.join(large, "c", "left_semi").select("a", "b")), local_edges)
        each = block.join(tree.select("v", "parent"), "v")
        on = each.select("v", "block").union(each.select("parent", "block")).groupBy("v").agg(F.min("block").alias("one"), F.max("block").alias("other")).where("one <> other")
        found.append(on.select("v"))
    tasks = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() // LOCAL_EDGES))
    found.append(_cuts_by_component(parts.join(large, "c", "left_anti"), tasks, max(1, local_edges)))
    return reduce(DataFrame.union, found).join(names, "v").select("id")
