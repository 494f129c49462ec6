"""Byte-level BPE (operator 8): overlapping chunk encoding, and decoding by concatenating raw bytes.

A text is cut into overlapping chunks of ``CHUNK`` characters. The chunks of one text are dealt over tasks and pre-tokenised
independently. The split pattern only looks ahead, so two runs that share one boundary share every later one: neighbouring
chunks are stitched at the first boundary that both have inside their overlap, where the left chunk's tokens don't touch its end.
No stitch follows white space, because the pattern looks at what comes after a run of it, and a piece's end would hide that.
Texts of which some border has no such boundary (one run of a kind fills the overlap) are cut again, with longer overlaps.
The pieces between stitches are then encoded, again dealt over tasks, and a text's ids joined. A text of one chunk is one
piece and needs no stitch; it is encoded where it lies. Equal long texts are encoded once.

Defined results: a null text is empty and has no ids; repeated rows give repeated rows; an empty table gives
an empty result; columns other than doc_id and text are ignored. A text's ids are one row, so one task holds them at the end.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, only_cache, small_slices, tidied, whole_texts

CHUNK = 32_768
OVERLAP = 512


def chunk_spans(size: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Starts and ends of a text's chunks; neighbours share ``overlap`` characters, more at the end."""
    count = max(1, -(-(size - overlap) // (chunk - overlap)))
    return [(k * (chunk - overlap), min(size, k * (chunk - overlap) + chunk)) for k in range(count)]


def marks(pattern, text: str, start: int, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries of a chunk that begins at ``start``, as places in the whole text: those in its first overlap, and those in its last where a stitch may be."""
    found = [m.start() for m in pattern.finditer(text)][:-1]  # the last token touches the chunk's end
    left = [start + b for b in found if b <= overlap]
    right = [start + b for b in found if b >= len(text) - overlap and b and not text[b - 1].isspace()]
    return left, right


def encoding(ranks_file: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks_file.splitlines() if line)}
    return tiktoken.Encoding("graphloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_CODERS: dict[bytes, tuple] = {}


def coder(ranks_file: bytes, pattern: str) -> tuple:
    import regex

    key = hashlib.md5(ranks_file + pattern.encode()).digest()
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = (encoding(ranks_file, pattern), regex.compile(pattern))
    return _CODERS[key]


def long_ids(long: DataFrame, coders: tuple[Broadcast, str], chunk: int, overlap: int) -> DataFrame | None:
    """(key, ids of its pieces in order, each as little-endian unsigned 32-bit integers) of the distinct texts of long(key, text); None if there are none."""
    ranks, pattern = coders

    def cut(size: int, lap: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for k, (s, e) in enumerate(chunk_spans(len(text), size, lap)):
                        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int64()), pa.array([s], pa.int64()), pa.array([text[s:e]], pa.string())], names=["key", "k", "start", "text"])

        return run

    def pre_tokenise(lap: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            only_cache("byte_bpe", _CODERS.clear)
            _, pat = coder(ranks.value, pattern)
            for batch in batches:
                for part in small_slices(batch, 3):
                    found = [marks(pat, t, s, lap) for s, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1))], names=["key", "k", "start", "text", "first", "last"])

        return run

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("byte_bpe", _CODERS.clear)
        enc, _ = coder(ranks.value, pattern)
        for batch in batches:
            ids = [np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["key", "k", "ids"])

    spark = long.sparkSession
    open_ = materialize(long.dropDuplicates(["key"]).select("key", "text"))
    done: list[DataFrame] = []
    while not open_.isEmpty():
        dealt = open_.mapInArrow(tidied(cut(chunk, overlap)), "key string, k long, start long, text string").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "k")
        chunks = materialize(dealt.mapInArrow(tidied(pre_tokenise(overlap)), "key string, k long, start long, text string, first array<long>, last array<long>"))
        w = Window.partitionBy("key").orderBy("k")  # a text's chunks, without their texts
        met = F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("first", F.lag("last").over(w))))
        cuts = chunks.select("key", "k", "first", "last").withColumn("low", met).select("key", "k", "low", F.lead("low").over(w).alias("high"), F.lead("k").over(w).isNull().alias("end"))
        cuts = materialize(cuts)
        apart = materialize(cuts.where("low is null").select("key").distinct())
        whole = cuts.join(apart, "key", "left_anti")
        piece = F.expr("substring(text, cast(low - start + 1 as int), cast(if(end, length(text), high - low) as int))")
        pieces = chunks.select("key", "k", "start", "text").join(whole, ["key", "k"]).select("key", "k", piece.alias("text"))
        done.append(materialize(pieces.mapInArrow(tidied(code), "key string, k long, ids binary")))
        open_ = materialize(open_.join(apart, "key", "left_semi"))
        overlap *= 8
        chunk = max(chunk, 4 * overlap)
    if not done:
        return None
    pieces = reduce(DataFrame.union, done)
    ordered = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("of"))
    return ordered.select("key", F.col("of.ids").alias("ids"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, digest: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens and ids; digest: hashes of the ids and of the decoded bytes instead of the ids."""
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")
    names = [x.split()[0] for x in schema.split(", ")]

    def columns(enc, ids: list) -> list[pa.Array]:
        n = pa.array([len(x) for x in ids], pa.int64())
        if not digest:
            return [n, pa.array(ids, pa.list_(pa.int32()))]
        return [n, pa.array([hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(enc.decode_bytes(x)).hexdigest() for x in ids], pa.string())]

    def one_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("byte_bpe", _CODERS.clear)
        enc, _ = coder(ranks.value, pattern)
        for batch in batches:
            for part in small_slices(batch, most_bytes=4 << 20):
                ids = [enc.encode_ordinary(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *columns(enc, ids)], names=["doc_id", *names])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = coder(ranks.value, pattern)
        for batch in batches:
            for key, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([key]), *columns(enc, [np.frombuffer(b"".join(pieces), "<u4").tolist()])], names=["key", *names])

    texts = whole_texts(docs)
    short = texts.where(F.length("text") <= chunk).mapInArrow(tidied(one_piece), f"doc_id long, {schema}")
    long = texts.where(F.length("text") > chunk).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"), "text")
    ids = long_ids(long.select("key", "text"), (ranks, pattern), chunk, overlap)
    if ids is None:
        return short
    found = materialize(ids.mapInArrow(tidied(joined), f"key string, {schema}"))
    return short.union(long.select(F.col("doc_id").cast("long"), "key").join(found, "key").select("doc_id", *names))


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and data: the raw bytes of the ids, concatenated. Null ids decode to no bytes."""
    with open(ranks_path, "rb") as f:
        ranks = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = coder(ranks.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([enc.decode_bytes(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")
