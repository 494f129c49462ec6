"""Centrality: PageRank, betweenness by pivots, god nodes, top-k, group against repository ranks."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.loops import LOCAL_EDGES, few_edges, settled
from graphloom.operators.relational import numbered

DAMPING, ITERATIONS = 0.85, 20


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """(id, pagerank); dangling mass is spread evenly. Each round is one join and one partial aggregation by target."""
    ids = settled(nodes.select("id").distinct())
    n = ids.count()
    pairs = edges.select("from_id", "to_id").distinct()
    out = pairs.groupBy("from_id").agg(F.count(F.lit(1)).alias("out"))
    links = settled(pairs.join(out, "from_id"))
    rank = ids.withColumn("pr", F.lit(1.0 / max(n, 1)))
    outs = settled(ids.join(out.withColumnRenamed("from_id", "id"), "id", "left"))
    for _ in range(iterations):
        dangling = rank.join(outs.where("out is null"), "id", "left_semi").agg(F.coalesce(F.sum("pr"), F.lit(0.0)).alias("d"))
        sent = links.join(rank, links.from_id == rank.id).groupBy("to_id").agg(F.sum(F.col("pr") / F.col("out")).alias("got"))
        rank = settled(ids.join(sent, ids.id == sent.to_id, "left").crossJoin(F.broadcast(dangling)).select("id", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("d") / n)).alias("pr")))  # dangling is one row
    return rank.select("id", F.col("pr").alias("pagerank"))


def betweenness(nodes: DataFrame, edges: DataFrame, pivots: int | None = None, local_edges: int = LOCAL_EDGES, sources: DataFrame | None = None) -> DataFrame:
    """(id, betweenness): Brandes over all sources, or scaled over pivots: a number of them (the smallest hashes of ids) or sources(id) themselves.

    Directed, unweighted; paths of any length count.

    Few edges (counted) are broadcast, and sources are dealt over tasks, which add up their shares. Beyond, state is one row per
    (source, node), aggregated each level: with all sources that is the square of the nodes, so large graphs ask for pivots.
    """
    ids = settled(nodes.select("id").distinct())
    n = ids.count()
    pairs = settled(edges.select("from_id", "to_id").where("from_id <> to_id").distinct())
    if sources is not None:
        sources = settled(sources.select("id").join(ids, "id", "left_semi").distinct())
        scale = n / max(1, sources.count())
    elif pivots is None or pivots >= n:
        sources, scale = ids, 1.0
    else:
        sources, scale = ids.orderBy(F.xxhash64("id"), "id").limit(pivots), n / pivots
    if few_edges(pairs, local_edges):
        parts = _broadcast_shares(sources, pairs)
        total = parts.groupBy("id").agg((F.sum("delta") * scale).alias("betweenness"))
        return ids.join(total, "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))
    seen = settled(sources.select(F.col("id").alias("s"), "id", F.lit(0).alias("depth"), F.lit(1.0).alias("paths")))
    deepest = 0
    for depth in count(1):
        front = seen.where(F.col("depth") == depth - 1)
        new = front.join(pairs, front.id == pairs.from_id).groupBy("s", "to_id").agg(F.sum("paths").alias("paths")).withColumnRenamed("to_id", "id")
        new = new.join(seen.select("s", "id"), ["s", "id"], "left_anti").select("s", "id", F.lit(depth).alias("depth"), "paths")
        grown = settled(seen.union(new))
        if grown.where(F.col("depth") == depth).isEmpty():
            break
        seen, deepest = grown, depth
    credit = settled(seen.where(F.col("depth") == deepest).select("s", "id", F.lit(0.0).alias("delta")))
    for depth in range(deepest, 0, -1):
        low = seen.where(F.col("depth") == depth).join(credit, ["s", "id"]).select("s", F.col("id").alias("w"), F.col("paths").alias("pw"), "delta")
        high = seen.where(F.col("depth") == depth - 1)
        back = high.join(pairs, high.id == pairs.from_id).select("s", "id", "paths", F.col("to_id").alias("w")).join(low, ["s", "w"]).groupBy("s", "id").agg(F.sum(F.col("paths") / F.col("pw") * (1 + F.col("delta"))).alias("delta"))
        level = high.select("s", "id").join(back, ["s", "id"], "left").select("s", "id", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        credit = settled(credit.union(level))
    total = credit.where("s <> id").groupBy("id").agg((F.sum("delta") * scale).alias("betweenness"))
    return ids.join(total, "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _broadcast_shares(sources: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, delta) of sources(id), summed over a task's sources, level by level over arrays of the broadcast edges."""
    rows = pairs.select("from_id", "to_id").toArrow()  # few_edges has counted them
    names, flat = np.unique(np.array(rows.column(0).to_pylist() + rows.column(1).to_pylist(), object), return_inverse=True)
    a, b = flat[: rows.num_rows], flat[rows.num_rows :]
    by = np.argsort(a, kind="stable")
    first = np.searchsorted(a[by], np.arange(len(names) + 1))
    shared = pairs.sparkSession.sparkContext.broadcast((names, first, b[by]))

    def shares(first: np.ndarray, to: np.ndarray, s: int) -> np.ndarray:
        n = len(first) - 1
        depth, paths, delta = np.full(n, -1), np.zeros(n), np.zeros(n)
        depth[s], paths[s] = 0, 1.0
        front, levels = np.array([s]), []
        while len(front):
            size = first[front + 1] - first[front]
            x = np.repeat(front, size)
            y = to[np.repeat(first[front] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
            depth[np.unique(y[depth[y] < 0])] = depth[front[0]] + 1
            ahead = depth[y] == depth[front[0]] + 1
            x, y = x[ahead], y[ahead]
            np.add.at(paths, y, paths[x])
            levels.append((x, y))
            front = np.unique(y)
        for x, y in reversed(levels):
            np.add.at(delta, x, paths[x] / paths[y] * (1 + delta[y]))
        delta[s] = 0.0
        return delta

    def run(batches):
        names, first, to = shared.value
        total = np.zeros(len(names))
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), object)
            at = np.minimum(np.searchsorted(names, ids), max(0, len(names) - 1)) if len(names) else np.empty(0, int)
            for s in at[names[at] == ids].tolist() if len(names) else []:
                total += shares(first, to, s)
        keep = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(names[keep].tolist(), pa.string()), pa.array(total[keep])], names=["id", "delta"])

    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sources.select("id").repartition(tasks, "id").mapInArrow(run, "id string, delta double")


def god_nodes(scores: DataFrame, share: float = 0.05) -> DataFrame:
    """Ids in the top share by PageRank or by betweenness; ties in total order of id."""
    n = scores.count()
    top = max(1, -(-n * int(share * 1000) // 1000))
    by = lambda c: scores.orderBy(F.desc(c), "id").limit(top).select("id")
    return by("pagerank").union(by("betweenness")).distinct()


def key_entities(scores: DataFrame, k: int = 10) -> DataFrame:
    """(id, degree, score): scores(id, degree, betweenness), each as a share of its largest, added; isolated entities have no rank."""
    most = scores.agg(F.max("degree").alias("d"), F.max("betweenness").alias("b"))
    part = lambda c, m: F.when(F.col(m) > 0, F.col(c) / F.col(m)).otherwise(0.0)
    rows = scores.where("degree > 0").crossJoin(F.broadcast(most))  # one row
    return rows.select("id", "degree", F.round(part("degree", "d") + part("betweenness", "b"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def questions(nodes: DataFrame, edges: DataFrame, communities: DataFrame, least: float = 0.5) -> DataFrame:
    """(kind, id, other): what to ask about a graph: edges of low confidence, edges between communities, entities without any edge."""
    unsure = edges.where(F.col("confidence") < least).select(F.lit("ambiguous_edge").alias("kind"), F.col("from_id").alias("id"), F.col("to_id").alias("other")).distinct()
    a, b = communities.select(F.col("id").alias("from_id"), F.col("community").alias("a")), communities.select(F.col("id").alias("to_id"), F.col("community").alias("b"))
    bridge = edges.join(a, "from_id").join(b, "to_id").where("a <> b").select(F.lit("bridge"), "from_id", "to_id").distinct()
    ends = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id"))
    alone = nodes.select("id").distinct().join(ends, "id", "left_anti").select(F.lit("isolated"), "id", F.lit(None).cast("string"))
    return unsure.union(bridge).union(alone)


def significant(c, digits: int = 6):
    """Rounded to significant figures, never to an absolute step."""
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c)))), digits - 1) * F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c)))))


def top(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k highest rows, ties by id: a bounded heap per task, then one merge."""
    return df.orderBy(F.desc(column), "id").limit(k)


def rank_shift(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, group_rank, repo_rank, repo): ranks of (id, score) overall against (id, repo, score) inside each repository."""
    first = numbered(whole.select("id", "score"), F.desc("score"), F.col("id")).groupBy("score").agg((F.min("number") + 1).alias("group_rank"))  # equal scores share the first's rank
    a = whole.join(first, "score")
    b = parts.withColumn("repo_rank", F.rank().over(Window.partitionBy("repo").orderBy(F.desc("score"))))
    return a.select("id", "group_rank").join(b.select("id", "repo", "repo_rank"), "id")
