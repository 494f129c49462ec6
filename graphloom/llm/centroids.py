"""Centroid clustering of integer vectors, exact at every size.

Method: vectors are packed into blocks once; a round assigns a block's rows to the nearest centroid by the expansion
``|x|^2 - 2 x.c + |c|^2`` as one float64 matrix product. All terms are integers, so the product is exact as long as
``dim * (max|x| + max|c|)^2`` is below 2^53; rows beyond that bound are compared in 64-bit integers below 2^63 and in unbounded
integers above it. ``RDD.treeAggregate`` adds the sums and counts of all blocks, in unbounded integers; the driver sees one sum a
centroid and component, whatever the number of vectors. Blocks lie in the shared folder, so a lost executor costs its blocks of one round.

Results: vectors that are null, of another length than ``dim`` or hold null or non-finite components are left out. Repeated rows are
rows of their own. A null vec_id keeps its row, but becomes a start only after all others; equal ids start in the order of their components.
With fewer vectors than ``k`` there are as many centroids as vectors; an empty table gives no rows. Distances and inertias over
2^63 - 1 (components beyond 1e7 or so) are null, though they are compared and added exactly. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, materialize

#: Integers below it are exact in float64.
EXACT = 1 << 53
LONG = (1 << 63) - 1


def kept(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part."""
    c = F.col("embedding")
    whole = F.coalesce(F.size(c) == dim, F.lit(False)) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), c.cast("array<double>").alias("embedding"))


def whole_number(x: float, scale: int) -> int:
    """floor(scale * x), scale a power of two, without overflow."""
    return math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale


def blocks_of(vectors: DataFrame, dim: int) -> DataFrame:
    """(ids, data): packed blocks of vectors, data being rows of float64, written once."""

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                flat = np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype="<f8")
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([flat.tobytes()], pa.binary())], ["ids", "data"])

    return materialize(vectors.mapInArrow(pack, "ids array<bigint>, data binary"))


def _integers(rows: np.ndarray, scale: int) -> np.ndarray:
    """The rows' integers as unbounded integers."""
    return np.array([[whole_number(x, scale) for x in row] for row in rows.tolist()], dtype=object).reshape(rows.shape)


def nearest(data: bytes, centroids: list[list[int]], dim: int, scale: int, lot: int = 4096):
    """Per lot of a block's rows: (integers of the rows, cluster, distance); the arrays are float64, int64 or of unbounded integers.

    Rows are grouped by the arithmetic that they need, so lots aren't in the block's order: the first item is the rows' positions.
    """
    rows = np.frombuffer(data, "<f8").reshape(-1, dim)
    with np.errstate(over="ignore"):
        size = np.abs(np.floor(rows * scale)).max(axis=1)
    most = max((abs(x) for c in centroids for x in c), default=0)
    exact = math.isqrt((EXACT - 1) // dim) - most  # the largest component that float64 bears
    wide = math.isqrt(LONG // dim) - most
    for low in range(0, len(rows), lot):
        at = np.arange(low, min(low + lot, len(rows)))
        small = size[at] <= exact
        middle = ~small & (size[at] <= wide)
        if small.any():
            x = np.floor(rows[at[small]] * scale)
            c = np.array(centroids, dtype=np.float64)
            d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
            best = d.argmin(axis=1)
            yield at[small], x, best, d[np.arange(len(x)), best]
        for chosen, kind in ((middle, np.int64), (~small & ~middle, object)):
            if chosen.any():
                x = _integers(rows[at[chosen]], scale).astype(kind)
                c = np.array(centroids, dtype=kind)
                d = np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)
                best = np.array([min(range(len(c)), key=lambda k: (row[k], k)) for row in d.tolist()])
                yield at[chosen], x, best, d[np.arange(len(x)), best]


def _sums(x: np.ndarray, best: np.ndarray, k: int) -> np.ndarray:
    """k x columns: the rows' sums by cluster, as unbounded integers."""
    if x.dtype == np.float64 and len(x) * max(1.0, np.abs(x).max(initial=0)) < EXACT:
        member = np.zeros((k, len(x)))
        member[best, np.arange(len(x))] = 1
        return (member @ x).astype(np.int64).astype(object)
    out = np.zeros((k, x.shape[1]), dtype=object)
    for row, j in zip(x.tolist(), best.tolist()):
        out[j] += np.array([int(v) for v in row], dtype=object)
    return out


def totals(blocks: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> np.ndarray:
    """Per cluster: count, sum of distances, then the sums of the components, as unbounded integers."""
    k = len(centroids)
    empty = np.zeros((k, dim + 2), dtype=object)

    def add(total, row):
        total = total.copy()
        for _, x, best, d in nearest(row[0], centroids, dim, scale):
            total[:, 2:] += _sums(x, best, k)
            total[:, 1:2] += _sums(d.reshape(-1, 1), best, k)
            total[:, 0] += np.bincount(best, minlength=k).astype(object)
        return total

    return blocks.select("data").rdd.treeAggregate(empty, add, lambda a, b: a + b, depth=2)


def starts(vectors: DataFrame, k: int, scale: int, salt: str) -> list[list[int]]:
    """The k vectors whose ``<salt>:<vec_id>`` has the smallest SHA-256, in that order: a sort that keeps k rows a task."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    return [[whole_number(x, scale) for x in r[0]] for r in vectors.orderBy(order, "embedding").select("embedding").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 40, dim: int = 64, rounds: int = 5, scale: int = 256, salt: str = "2") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    Components are floor(scale * x). Each of ``rounds`` assigns every vector to the nearest centroid (ties: the smaller number) and
    replaces every centroid that has vectors by the floor of their mean; then vectors are assigned once more.
    """
    bounded_batches(vectors.sparkSession)
    vectors = kept(vectors, dim)
    blocks = blocks_of(vectors, dim)
    centroids = starts(vectors, k, scale, salt)
    for _ in range(rounds if centroids else 0):
        found = totals(blocks, centroids, dim, scale)
        centroids = [[int(s) // int(row[0]) for s in row[2:]] if row[0] else c for c, row in zip(centroids, found)]
    inertia = [int(x) for x in totals(blocks, centroids, dim, scale)[:, 1]] if centroids else []
    whole = sum(inertia)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def held(x: int) -> int | None:
        return int(x) if x <= LONG else None

    def describe(batches):
        schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid_sha256", pa.string())])
        for batch in batches:
            for ids, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at, _, best, d in nearest(data, centroids, dim, scale):
                    best = best.tolist()
                    columns = [[ids[i] for i in at.tolist()], best, [held(int(x)) for x in d.tolist()], [held(inertia[j]) for j in best], [held(whole)] * len(best), [digests[j] for j in best]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return blocks.mapInArrow(describe, "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
