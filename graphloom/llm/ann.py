"""Approximate nearest neighbours (operator 1): low-dimensional stable projections indexed by kd-tree.

Vectors are projected on ``PROJECTIONS`` Gaussian directions, which are 2-stable: a projected squared distance over
the true one follows a chi-square law. A kd-tree over the projections has its upper levels fitted on at most
``SAMPLE`` vectors (smallest hashes) and dealt out: one cell, one group of rows, holding every indexed row. Inside a cell
the tree goes on to small leaves. A query visits leaves by projected distance and verifies, on the original vectors, the points
whose projected squared distance is within the chi-square quantile ``SURE`` times the k-th true squared distance reached; it stops
where the next leaf's isn't. So each of the true nearest is found with a chance of at least ``SURE``. A query first searches its own
cell, then every cell that the same test leaves open.

Equal vectors are one point of the index with its k + 1 smallest ids, which is all that any result can hold, so a third of
all rows in one vector costs one row per task in the shuffle. Queries travel to cells, in blocks; nothing is compared all
to all. The broadcast tree has at most ``2 ** MAX_DEPTH`` cells; a cell of over ``CELL_ROWS`` rows is dealt as several blocks by a
hash, so a task holds a bounded part of the index at any size, and a query goes to each block of its cells.

Defined results: unusable vectors (see vectors.usable) neither query nor answer; a query's own id is no answer; only
vectors of the query's length are compared; fewer than k candidates give fewer rows; ties go to the smaller vec_id;
a repeated query row asks once, a repeated candidate row answers as often as it occurs; an empty table gives an empty result;
columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import heapq
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import hash_sample, materialize
from graphloom.llm.vectors import doubles, hyperplanes, matrix

K = 10
PROJECTIONS = 24
SAMPLE = 8192
CELL_ROWS = 8192
MAX_DEPTH = 12
LEAF = 128
SURE = 0.98
SEED = 17


def chi_square_quantile(m: int, p: float) -> float:
    """For an even number of degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        x = (low + high) / 2
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - exp(-x / 2) * total < p else (low, x)
    return high


class Tree:
    """Median splits of projected points on their widest axis; children of node i are 2i+1 and 2i+2."""

    def __init__(self, points: np.ndarray, depth: int):
        m = points.shape[1]
        nodes, leaves = (1 << depth) - 1, 1 << depth
        self.depth, self.axis, self.cut = depth, np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        self.low, self.high = np.full((leaves, m), -np.inf), np.full((leaves, m), np.inf)
        groups = [points]
        for level in range(depth):
            nxt = []
            for j, g in enumerate(groups):
                i = (1 << level) - 1 + j
                if len(g) > 1 and np.ptp(g, axis=0).max() > 0:
                    a = int(np.ptp(g, axis=0).argmax())
                    self.axis[i] = a
                    v = np.sort(g[:, a])
                    c = v[len(v) // 2]
                    self.cut[i] = c if c > v[0] else v[np.searchsorted(v, c, "right")]
                left = g[:, self.axis[i]] < self.cut[i]
                nxt += [g[left], g[~left]]
            groups = nxt
        for leaf in range(leaves):
            i = nodes + leaf
            while i:
                up = (i - 1) // 2
                a, c = self.axis[up], self.cut[up]
                if i == 2 * up + 1:
                    self.high[leaf, a] = min(self.high[leaf, a], c)
                else:
                    self.low[leaf, a] = max(self.low[leaf, a], c)
                i = up

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        i = np.zeros(len(points), np.int64)
        rows = np.arange(len(points))
        for _ in range(self.depth):
            i = 2 * i + 1 + (points[rows, self.axis[i]] >= self.cut[i])
        return i - ((1 << self.depth) - 1)

    def boxes(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of one projected query to all leaves' boxes."""
        d = np.maximum(np.maximum(self.low - q, q - self.high), 0.0)
        d[np.isnan(d)] = 0.0
        return (d * d).sum(1)


def search(points: np.ndarray, ids: list[list[int]], queries: np.ndarray, own: list[int], k: int, bounds: np.ndarray, leaf_rows: int = LEAF, seed: int = SEED) -> list[tuple[list[int], list[float]]]:
    """Per query the nearest k ids found in one cell and their distances; bounds: squared distances already reached."""
    project = hyperplanes(points.shape[1], PROJECTIONS, seed)
    low, flat = points @ project, queries @ project
    depth = max(0, int(np.ceil(np.log2(max(1, len(points) / leaf_rows)))))
    tree = Tree(low, depth)
    leaf = tree.leaf_of(low)
    order = np.argsort(leaf, kind="stable")
    edges = np.searchsorted(leaf[order], np.arange((1 << depth) + 1))
    psi, out = chi_square_quantile(PROJECTIONS, SURE), []
    for q, p, me, bound in zip(queries, flat, own, bounds, strict=True):
        box = tree.boxes(p)
        heap: list[tuple[float, int]] = []  # the k nearest so far: (-squared distance, -id)
        for j in np.argsort(box, kind="stable").tolist():
            reached = min(bound, -heap[0][0] if len(heap) == k else np.inf)
            if box[j] > psi * reached:
                break
            rows = order[edges[j] : edges[j + 1]]
            gap = low[rows] - p
            rows = rows[np.einsum("ij,ij->i", gap, gap) <= psi * reached]
            if not len(rows):
                continue
            diff = points[rows] - q
            d = np.einsum("ij,ij->i", diff, diff)
            near = np.flatnonzero(d <= reached)
            for i in near[np.argsort(d[near], kind="stable")].tolist():
                if len(heap) == k and d[i] > -heap[0][0]:
                    break
                for v in ids[rows[i]]:
                    if v != me:
                        item = (-float(d[i]), -v)
                        if len(heap) < k:
                            heapq.heappush(heap, item)
                        elif item > heap[0]:
                            heapq.heapreplace(heap, item)
        best = sorted((-a, -b) for a, b in heap)
        out.append(([v for _, v in best], [float(np.sqrt(d)) for d, _ in best]))
    return out


FOUND = pa.schema([("query_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("cell", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
FOUND_DDL = "query_id long, embedding array<double>, cell long, ids array<long>, scores array<double>"
ASKED_DDL = "query_id long, embedding array<double>, cell long, bound double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, cell_rows: int = CELL_ROWS, leaf_rows: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries(vec_id, embedding) against vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = doubles(vectors)
    w = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    points = materialize(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))  # at most k + 1 ids
    sizes = {r.dim: r["count"] for r in points.groupBy(F.size("embedding").alias("dim")).count().collect()}  # a row per vector length
    trees: dict[int, Tree] = {}
    for dim, n in sizes.items():
        sample = hash_sample(points.where(F.size("embedding") == dim).select("embedding"), SAMPLE, n, "embedding").collect()
        depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1.0, n / cell_rows))))))
        trees[dim] = Tree(np.unique(np.array([r[0] for r in sample]), axis=0) @ hyperplanes(dim, PROJECTIONS, SEED), depth)
    shared = spark.sparkContext.broadcast(trees)
    psi = chi_square_quantile(PROJECTIONS, SURE)

    def in_cells(batches):
        for batch in batches:
            vec = batch.column(0)
            dims = np.diff(vec.offsets.to_numpy()) if batch.num_rows else np.empty(0, np.int64)
            cell = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = matrix(vec.take(pa.array(at)))
                cell[at] = (dim << MAX_DEPTH) + shared.value[dim].leaf_of(x @ hyperplanes(dim, PROJECTIONS, SEED))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    def open_cells(batches):
        """A row for each other cell that the chi-square test leaves open, with the distance reached so far."""
        for batch in batches:
            take, cells, bounds = [], [], []
            for i, (vec, home, reached) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("embedding", "cell", "bound")), strict=True)):
                box = shared.value[len(vec)].boxes(np.array(vec) @ hyperplanes(len(vec), PROJECTIONS, SEED))
                for c in np.flatnonzero(box <= psi * reached).tolist():
                    c += len(vec) << MAX_DEPTH
                    if c != home:
                        take.append(i)
                        cells.append(c)
                        bounds.append(reached)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(take, pa.int64())), batch.column("embedding").take(pa.array(take, pa.int64())), pa.array(cells, pa.int64()), pa.array(bounds, pa.float64())], names=["query_id", "embedding", "cell", "bound"])

    def in_cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return FOUND.empty_table()
        if left.num_rows:
            found = search(matrix(left.column("embedding")), left.column("ids").to_pylist(), matrix(right.column("embedding")), right.column("query_id").to_pylist(), k, right.column("bound").to_numpy(), leaf_rows)
        else:
            found = [([], [])] * right.num_rows
        return pa.Table.from_arrays([right.column("query_id"), right.column("embedding"), right.column("cell"), pa.array([a for a, _ in found], pa.list_(pa.int64())), pa.array([b for _, b in found], pa.list_(pa.float64()))], schema=FOUND)

    placed = points.select("embedding", "ids").mapInArrow(in_cells, "embedding array<double>, ids array<long>, cell long")
    blocks = {r.cell: -(-r["count"] // cell_rows) for r in placed.groupBy("cell").count().where(F.col("count") > cell_rows).collect()}  # at most 2 ** MAX_DEPTH cells a length
    table = spark.createDataFrame(sorted(blocks.items()) or [(-1, 1)], "cell long, blocks long")

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(table), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))

    indexed = dealt(placed).select("embedding", "ids", "cell", F.pmod(F.xxhash64("embedding"), "blocks").alias("block")).groupBy("cell", "block")

    def searched(asked: DataFrame) -> DataFrame:
        to = dealt(asked).select("query_id", "embedding", "cell", "bound", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        return indexed.cogroup(to.groupBy("cell", "block")).applyInArrow(in_cell, FOUND_DDL)

    asked = doubles(queries).select("embedding", F.col("vec_id").alias("query_id")).dropDuplicates().mapInArrow(in_cells, "embedding array<double>, query_id long, cell long")
    home = materialize(searched(asked.select("query_id", "embedding", "cell", F.lit(float("inf")).alias("bound"))))
    best = F.slice(F.sort_array(F.flatten(F.collect_list("scores"))), 1, k)  # k scores from each block of one cell
    bound = home.groupBy("query_id", "embedding", "cell").agg(best.alias("best")).select("query_id", "embedding", "cell", F.when(F.size("best") == k, F.element_at("best", -1) * F.element_at("best", -1)).otherwise(F.lit(float("inf"))).alias("bound"))
    rest = searched(bound.mapInArrow(open_cells, ASKED_DDL))
    pairs = home.union(rest).select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
