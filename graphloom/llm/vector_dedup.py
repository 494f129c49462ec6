"""Embedding near-duplicates (operator 4): random-hyperplane sign hashing, exact cosines, distributed components.

Each distinct vector gets a signature per table: the signs of its products with that table's random hyperplanes.
Vectors that share a signature in some table are compared exactly, in blocks, inside their bucket; a pair that also
meets in an earlier table is counted there only, so link counts are those of distinct pairs without a shuffle of pairs.
Buckets emit link counts per vector and a spanning forest, never all pairs. The number of hyperplanes grows with
the logarithm of the rows and the number of tables is chosen so that a pair at the threshold is missed with odds of
at most ``MISS``. Buckets are counted first, and those over ``BUCKET`` rows are dealt as a grid of block pairs over several tasks,
of signatures and of vectors alike.

Before vectors travel, longer sign signatures do: only vectors with a partner in some bucket within ``SLACK`` standard
deviations of the expected distance at the threshold go on, which leaves out nearly all and loses practically none.

Equal vectors are one row with a count. Defined results: vectors that are null, zero or hold null or non-finite
components link with nothing and are kept; lengths that differ never link; repeated rows count as links of each other; an
empty table gives an empty result; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import buckets_of, dealt_in_blocks, materialize, paired
from graphloom.llm.components import components, forest
from graphloom.llm.vectors import doubles, hyperplanes, matrix, usable

THRESHOLD = 0.9
MISS = 0.005
BUCKET = 4096
#: Hyperplanes of a table at most: enough for 2^44 distinct vectors, and with a vector's length above them a key still has 64 bits.
MOST_BITS = 40
BLOCK = 1024
SEED = 29
#: Bits of the longer signature, and how far beyond the expected distance at the threshold a partner may be.
CHECK_BITS = 256
SLACK = 6.0
#: Ids of vectors with partners that may be broadcast: at most this many 8-byte numbers.
BROADCAST_IDS = 1_000_000


def layout(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(hyperplanes in a table, tables) for n distinct vectors."""
    bits = int(min(MOST_BITS, max(6, ceil(log2(max(2, n)) - 4))))
    meet = (1 - acos(threshold) / pi) ** bits
    return bits, int(ceil(log(miss) / log(1 - meet)))


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """rows x tables."""
    signs = (x @ hyperplanes(x.shape[1], bits * tables, SEED) >= 0).reshape(len(x), tables, bits)
    return (signs << np.arange(bits)).sum(2).astype(signature_type(bits))


def signature_type(bits: int) -> type[np.unsignedinteger]:
    return np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64


def with_partner(t: np.ndarray, key: np.ndarray, check: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Which rows have another of their bucket (t, key, i, j) within that many bits; of different blocks, one in the other block."""
    order, starts, group, size = buckets_of(j, i, key, t)
    check, own, across = check[order], own[order], (i != j)[order]
    hit = np.zeros(len(order), bool)
    for x, y in paired(starts, group, size):
        near = (np.bitwise_count(check[x] ^ check[y]).sum(-1, dtype=np.int32) <= most) & ~(across[x] & (own[x] == own[y]))
        hit[x[near]] = hit[y[near]] = True
    out = np.empty(len(order), bool)
    out[order] = hit
    return out


class Links:
    """Link counts and a forest of the links of one partition's buckets."""

    def __init__(self) -> None:
        self.uid: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def compare(self, table: int, left: tuple, right: tuple, same: bool, threshold: float) -> None:
        """left, right: (uid, count, unit vectors, signatures); same: one block with itself."""
        uid, count, x, sig = left
        uid2, count2, y, sig2 = right
        hit = x @ y.T >= threshold
        if same:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        p, q = np.nonzero(hit)
        fresh = ~(sig[p, :table] == sig2[q, :table]).any(1)
        p, q = p[fresh], q[fresh]
        self.uid.append(uid)
        self.n.append(np.bincount(p, count2[q], len(uid)).astype(np.int64))
        if not same:
            self.uid.append(uid2)
            self.n.append(np.bincount(q, count[p], len(uid2)).astype(np.int64))
        a, b = forest(uid[p], uid2[q])
        self.a.append(a)
        self.b.append(b)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(u, v, n): counts have v = u, links n = 0."""
        if not self.uid:
            e = np.empty(0, np.int64)
            return e, e, e
        uid, flat = np.unique(np.concatenate(self.uid), return_inverse=True)
        n = np.bincount(flat, np.concatenate(self.n), len(uid)).astype(np.int64)
        a, b = forest(np.concatenate(self.a), np.concatenate(self.b))
        keep = n > 0
        return np.concatenate([uid[keep], a]), np.concatenate([uid[keep], b]), np.concatenate([n[keep], np.zeros(len(a), np.int64)])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, bucket: int = BUCKET) -> DataFrame:
    """vec_id, n_links, component_id, kept, a row for each row of vectors."""
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("ok", usable())
    ids = ids.withColumn("uid", F.when(F.col("ok"), F.xxhash64(F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0)))).select("vec_id", "uid")
    # x + 0.0 makes -0.0 and 0.0 one; 64-bit ids of distinct vectors stand for them from here on
    rows = doubles(vectors).withColumn("embedding", F.transform("embedding", lambda x: x + 0.0)).withColumn("uid", F.xxhash64("embedding"))
    distinct = materialize(rows.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding")))
    bits, tables = layout(distinct.count(), threshold)

    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    raw = np.dtype("<f4" if single else "<f8")  # a float's double goes back without change
    most = int(CHECK_BITS * acos(threshold) / pi + SLACK * (CHECK_BITS * acos(threshold) / pi * (1 - acos(threshold) / pi)) ** 0.5)

    def by_length(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                dims = np.array([len(x) for x in part.column(column)], np.int64)
                for dim in np.unique(dims).tolist():
                    own = part.take(pa.array(np.flatnonzero(dims == dim)))
                    yield dim, own, matrix(own.column(column))

    def keys(dim: int, sig: np.ndarray, t: int) -> pa.Array:
        return pa.array((dim << max(16, bits)) + sig[:, t].astype(np.int64))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, own, x in by_length(batches, 1):
            sig = signatures(x, bits, tables)
            check = pa.array([r.tobytes() for r in np.packbits(x @ hyperplanes(dim, CHECK_BITS, SEED + 1) >= 0, axis=1)], pa.binary())
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), keys(dim, sig, t), own.column(0), check], names=["t", "key", "uid", "chk"])

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            check = np.frombuffer(b"".join(t.column("chk").to_pylist()), np.uint64).reshape(t.num_rows, -1)
            hit = with_partner(*(t.column(c).to_numpy() for c in ("t", "key")), check, *(t.column(c).to_numpy() for c in ("own", "i", "j")), most)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(t.column("uid").to_numpy()[hit]))], names=["uid"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, own, x in by_length(batches, 2):
            sig = signatures(x, bits, tables)
            data = pa.array([r.tobytes() for r in x.astype(raw)], pa.binary())
            sigs = pa.array([r.tobytes() for r in sig], pa.binary())
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), keys(dim, sig, t), own.column(0), own.column(1), data, sigs], names=["t", "key", "uid", "n", "data", "sigs"])

    met = dealt_in_blocks(distinct.select("uid", "embedding").mapInArrow(sketched, "t int, key long, uid long, chk binary"), ("t", "key"), "uid", bucket)
    near = materialize(met.mapInArrow(partners, "uid long").distinct())
    few = near.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rest = distinct.join(F.broadcast(near) if few else near, "uid", "left_semi").select("uid", "n", "embedding")
    entries = rest.mapInArrow(hashed, "t int, key long, uid long, n long, data binary, sigs binary")
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        num = {c: t.column(c).to_numpy() for c in ("t", "key", "uid", "n", "own", "i", "j")}
        data, sigs = t.column("data").combine_chunks(), t.column("sigs").combine_chunks()
        order = np.lexsort((num["uid"], num["own"], num["j"], num["i"], num["key"], num["t"]))
        heads = np.ones(len(order), bool)
        heads[1:] = np.any([num[c][order][1:] != num[c][order][:-1] for c in ("t", "key", "i", "j")], axis=0)
        starts = np.flatnonzero(heads)
        links = Links()
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            if e - s < 2:
                continue
            rows = order[s:e]
            at = pa.array(rows)
            x = np.frombuffer(b"".join(data.take(at).to_pylist()), raw).reshape(len(rows), -1).astype(np.float64)
            x /= np.linalg.norm(x, axis=1)[:, None]
            sig = np.frombuffer(b"".join(sigs.take(at).to_pylist()), signature_type(bits)).reshape(len(rows), -1)
            uid, n, own = num["uid"][rows], num["n"][rows], num["own"][rows]
            table, i, j = int(num["t"][rows[0]]), int(num["i"][rows[0]]), int(num["j"][rows[0]])
            half = int(np.searchsorted(own, j)) if i != j else 0  # block i's rows, then block j's
            part = lambda a, b: (uid[a:b], n[a:b], x[a:b], sig[a:b])
            for a in range(0, half or len(rows), BLOCK):
                top = min(a + BLOCK, half or len(rows))
                for b in range(half if i != j else a, len(rows), BLOCK):
                    links.compare(table, part(a, top), part(b, min(b + BLOCK, len(rows))), i == j and a == b, threshold)
        u, v, n = links.rows()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n)], names=["u", "v", "n"])

    found = materialize(dealt_in_blocks(entries, ("t", "key"), "uid", bucket).mapInArrow(compare, "u long, v long, n long"))
    linked = found.where("n > 0").groupBy(F.col("u").alias("uid")).agg(F.sum("n").alias("linked"))
    member = components(found.where("n = 0")).select(F.col("node").alias("uid"), "component")
    classes = distinct.select("uid", "n", "least").join(linked, "uid", "left").join(member, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "component").select("uid", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    out = ids.join(named, "uid", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
