"""Plug-ins: extractors over files, cascades of contract resolvers, knowledge packs of base classes, embedding back ends.

A plug-in is a plain function or a table. Functions run over Arrow batches where the rows lie; what they raise becomes a record and never
ends the job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Extractor = Callable[[str, str], Iterable[dict]]
Backend = Callable[[list[str]], list[list[float]]]

RECORDS = "type string, path string, record string"


def extract(files: DataFrame, extractor: Extractor) -> DataFrame:
    """(type, path, record): what an extractor yields for each of files(path, content), as JSON; a failure is a record of type error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, str, str]] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = [(str(r.get("type", "entity")), path, json.dumps(r, sort_keys=True)) for r in extractor(path, content or "")]
                except Exception as e:  # a plug-in's failure is data
                    found = [("error", path, json.dumps({"message": f"{type(e).__name__}: {e}", "type": "error"}))]
                rows += found
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["type", "path", "record"])

    return files.select("path", "content").mapInArrow(run, RECORDS)


def records(extracted: DataFrame, kind: str, schema: str) -> DataFrame:
    """The extracted records of one type, as columns of the schema."""
    return extracted.where(F.col("type") == kind).select(F.from_json("record", schema).alias("r")).select("r.*")


def resolve(references: DataFrame, resolvers: list[tuple[str, DataFrame]]) -> DataFrame:
    """references(key) with the target of the first resolver(key, target) that knows it, and that resolver's name; ties to the smaller target."""
    known = reduce(DataFrame.union, [df.select("key", F.lit(i).alias("at"), F.lit(name).alias("resolver"), "target") for i, (name, df) in enumerate(resolvers)])
    best = known.groupBy("key").agg(F.min(F.struct("at", "target", "resolver")).alias("b"))
    return references.join(best, "key", "left").select(*[F.col(c) for c in references.columns], F.col("b.target").alias("target"), F.col("b.resolver").alias("resolver"))


def with_packs(extends: DataFrame, members: DataFrame, packs: DataFrame) -> DataFrame:
    """members(class, member) with those that packs(base, member) know of bases outside the code: contracts whose source isn't there."""
    inside = members.select(F.col("class").alias("base")).distinct()
    outside = extends.select("base").distinct().join(inside, "base", "left_anti")
    return members.select("class", "member").union(packs.join(outside, "base", "left_semi").select(F.col("base").alias("class"), "member")).distinct()


def embed(texts: DataFrame, backend: Backend, dims: int, batch_rows: int = 64) -> DataFrame:
    """(id, embedding) of texts(id, text) by a back end that turns lists of texts into vectors; another length than dims is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, batch_rows):
                part = batch.slice(low, batch_rows)
                vectors = backend([t or "" for t in part.column(1).to_pylist()])
                if len(vectors) != part.num_rows or any(len(v) != dims for v in vectors):
                    raise ValueError(f"the embedding back end must give {dims} numbers for each text")
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), pa.array(vectors, pa.list_(pa.float32()))], names=["id", "embedding"])

    return texts.select("id", "text").mapInArrow(run, "id string, embedding array<float>")
