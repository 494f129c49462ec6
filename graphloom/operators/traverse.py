"""Traversal: neighbours, bounded breadth-first search, weighted and unweighted paths, reachability, impact.

Edges are (from_id, to_id[, kind, ...]). Frontiers carry each node once a round (aggregated before the next join), so a
hub adds one row per neighbour and never a row per path, except where paths themselves are the result.
"""

from __future__ import annotations

from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.loops import LOCAL_EDGES, few_edges, in_one_task, settled


#: Over more edges than these, a search of a given number of hops is cheaper by joins.
FEW_HOPS_EDGES = 100_000


def neighbors(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    """(id, kind, direction) of a node's edges; endpoints without an entity stay."""
    incoming = edges.where(F.col("to_id") == node).select(F.col("from_id").alias("id"), "kind", F.lit("in").alias("direction"))
    outgoing = edges.where(F.col("from_id") == node).select(F.col("to_id").alias("id"), "kind", F.lit("out").alias("direction"))
    return {"in": incoming, "out": outgoing, "both": incoming.union(outgoing)}[direction].distinct()


def undirected(edges: DataFrame) -> DataFrame:
    pairs = edges.select("from_id", "to_id")
    return pairs.union(pairs.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))).distinct()


def _levels(hops: int | None, most_rounds: int | None):
    """Depths from the rows with no from_id, over the others, in one task."""

    def run(a: list[str], b: list[str]) -> pa.RecordBatch:
        near: dict[str, list[str]] = {}
        depth: dict[str, int] = {}
        for x, y in zip(a, b, strict=True):
            if x is None:
                depth[y] = 0
            else:
                near.setdefault(x, []).append(y)
        front = list(depth)
        for k in count(1) if hops is None else range(1, hops + 1):
            front = [y for y in dict.fromkeys(y for x in front for y in near.get(x, ())) if y not in depth]
            if not front:
                break
            depth.update(dict.fromkeys(front, k))
            if hops is None and k == most_rounds:
                raise RuntimeError("reachability did not settle")
        return pa.RecordBatch.from_arrays([pa.array(list(depth), pa.string()), pa.array(list(depth.values()), pa.int32())], names=["id", "depth"])

    return run


def bfs(edges: DataFrame, sources: DataFrame, hops: int | None, direction: str = "out", most_rounds: int | None = None, local_edges: int = LOCAL_EDGES, tasks: int | None = None) -> DataFrame:
    """(id, depth) of all nodes within hops of sources(id); hops None runs until nothing new is found, and raises beyond most_rounds.

    Few edges and sources (counted) are one task's work; beyond, each hop is a join. ``tasks``: over how many tasks edges are dealt, by the end that a
    hop starts from, so that no task sorts more of them than its share and no hop deals them again.
    """
    pairs = {"out": edges.select("from_id", "to_id"), "in": edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")), "both": undirected(edges)}[direction]
    pairs = pairs.where("from_id is not null")
    pairs = settled((pairs.repartition(tasks, "from_id") if tasks else pairs).distinct())
    starts = settled(sources.select("id").where("id is not null").distinct())
    rows = pairs.union(starts.select(F.lit(None).cast("string"), "id"))
    if few_edges(rows, local_edges if hops is None else min(local_edges, FEW_HOPS_EDGES)):
        return in_one_task(rows, _levels(hops, most_rounds), "id string, depth int")
    seen = settled(starts.withColumn("depth", F.lit(0)))
    for depth in count(1) if hops is None else range(1, hops + 1):
        front = seen.where(F.col("depth") == depth - 1)
        new = pairs.join(front, pairs.from_id == front.id, "left_semi").select(F.col("to_id").alias("id")).distinct().join(seen, "id", "left_anti")
        grown = settled(seen.union(new.withColumn("depth", F.lit(depth))))
        if hops is None and grown.where(F.col("depth") == depth).isEmpty():
            return grown
        if hops is None and depth == most_rounds:
            raise RuntimeError("reachability did not settle")
        seen = grown
    return seen


def subgraph(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """Edges with both ends within hops of the sources, in either direction."""
    near = bfs(edges, sources, hops, "both").select("id")
    return edges.join(near.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(near.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*edges.columns)


def simple_paths(edges: DataFrame, source: str, target: str, hops: int) -> DataFrame:
    """(path, hops) of cycle-free walks of at most that many hops, pruned to nodes from which the target is near enough."""
    spark = edges.sparkSession
    pairs = edges.select("from_id", "to_id").distinct()
    back = bfs(pairs, spark.createDataFrame([(target,)], "id string"), hops, "in")
    walks = spark.createDataFrame([([source], source)], "path array<string>, last string")
    found = walks.where(F.col("last") == target)
    for k in range(1, hops + 1):
        step = walks.where(F.col("last") != target).join(pairs, F.col("last") == F.col("from_id")).where(~F.array_contains("path", F.col("to_id")))
        near = back.where(F.col("depth") <= hops - k).select(F.col("id").alias("to_id"))
        walks = settled(step.join(near, "to_id", "left_semi").select(F.concat("path", F.array("to_id")).alias("path"), F.col("to_id").alias("last")))
        found = found.union(walks.where(F.col("last") == target))
    return found.select("path", (F.size("path") - 1).alias("hops"))


def cheapest(edges: DataFrame, source: str, most_hops: int) -> DataFrame:
    """(id, cost, path): cheapest costs of at most that many hops, cost of an edge -ln(confidence); ties to the smaller path."""
    spark = edges.sparkSession
    cost = settled(edges.where(F.col("confidence") > 0).groupBy("from_id", "to_id").agg(F.min(-F.log("confidence")).alias("step")))
    best = spark.createDataFrame([(source, 0.0, [source], True)], "id string, cost double, path array<string>, fresh boolean")
    for _ in range(most_hops):
        front = best.where("fresh")
        new = front.join(cost, front.id == cost.from_id).where(~F.array_contains("path", F.col("to_id")))
        new = new.select(F.col("to_id").alias("id"), (F.col("cost") + F.col("step")).alias("cost"), F.concat("path", F.array("to_id")).alias("path"), F.lit(True).alias("fresh"))
        every = best.withColumn("fresh", F.lit(False)).union(new)
        best = settled(every.groupBy("id").agg(F.min(F.struct(F.round("cost", 12).alias("cost"), F.col("fresh"), F.col("path"))).alias("b")).select("id", "b.cost", "b.path", "b.fresh"))
        if best.where("fresh").isEmpty():
            break
    return best.select("id", "cost", "path")


def impact(edges: DataFrame, changed: DataFrame, hops: int = 3, tasks: int | None = None) -> DataFrame:
    """(id, depth): inbound dependents of the changed entities, nearest first; hops is held to 1..6; tasks as in bfs."""
    return bfs(edges, changed, max(1, min(6, hops)), "in", tasks=tasks)


def unreached(nodes: DataFrame, edges: DataFrame, entry_points: DataFrame) -> DataFrame:
    """Ids of nodes that no entry point reaches."""
    return nodes.select("id").join(bfs(edges, entry_points, None), "id", "left_anti")


def only_tests_inbound(nodes: DataFrame, edges: DataFrame, is_test: DataFrame) -> DataFrame:
    """(id, reason): nodes without production callers: isolated, or only referenced by tests."""
    test = is_test.select(F.col("id").alias("from_id"), F.lit(1).alias("t"))
    inbound = edges.join(test, "from_id", "left").groupBy(F.col("to_id").alias("id")).agg(F.sum(F.when(F.col("t").isNull() & (F.col("kind") != "TESTS"), 1).otherwise(0)).alias("production"), F.count(F.lit(1)).alias("n"))
    out = nodes.select("id").join(inbound, "id", "left")
    return out.where(F.coalesce("production", F.lit(0)) == 0).select("id", F.when(F.col("n").isNull(), "isolated").otherwise("test_only_referenced").alias("reason"))


def with_reversed(edges: DataFrame, kind: str) -> DataFrame:
    """Edges, and those of one kind backwards as KIND_REVERSED, so that walks may go from an interface to what implements it."""
    back = edges.where(F.col("kind") == kind).select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.lit(f"{kind}_REVERSED").alias("kind"))
    return edges.select("from_id", "to_id", "kind").union(back)


def crosses(paths: DataFrame, repos: DataFrame) -> DataFrame:
    """paths(path, hops) with the number of repos(id, repo) on them and whether that is more than one."""
    steps = paths.withColumn("id", F.explode("path")).join(repos.select("id", "repo"), "id", "left")
    return steps.groupBy("path", "hops").agg(F.count_distinct("repo").alias("repos")).withColumn("crosses_repos", F.col("repos") > 1)


def import_aware(references: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """(file, name, id, how): references(file, name) by the file's alias(file, alias, target), else by qualified name, else by a bare name that only one entity has."""
    q = entities.select(F.col("qualified_name").alias("key"), F.col("id").alias("by_qualified"))
    alias = aliases.select("file", F.col("alias").alias("name"), F.col("target").alias("key")).join(q, "key", "left").select("file", "name", F.col("by_qualified").alias("by_alias"))
    bare = entities.groupBy(F.col("name")).agg(F.min("id").alias("by_name"), F.count_distinct("id").alias("n")).where("n = 1").drop("n")
    out = references.join(alias, ["file", "name"], "left").join(q.withColumnRenamed("key", "name"), "name", "left").join(bare, "name", "left")
    how = F.when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_qualified").isNotNull(), "qualified").when(F.col("by_name").isNotNull(), "bare").otherwise("unresolved")
    return out.select("file", "name", F.coalesce("by_alias", "by_qualified", "by_name").alias("id"), how.alias("how"))
