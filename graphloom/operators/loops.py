"""Loops over DataFrames: every round is cut off by a reliable checkpoint in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A graph of at most so many edges may be held by one task, or broadcast: ids are told apart by 64-bit numbers there.
LOCAL_EDGES = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The session's shared scratch folder; a temporary one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
    return folder.rstrip("/")


def _checkpoints(df: DataFrame) -> str:
    """The context's checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once into the session's checkpoint folder; survives the loss of executors."""
    _checkpoints(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written once as Parquet beside the checkpoints: for loops of many rounds, since a checkpoint keeps estimates of its size,
    which joins of a round with its predecessor square each time, and a file has its own."""
    path = f"{_checkpoints(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what stored() wrote for df, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(df._graphloom_path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def few_edges(pairs: DataFrame, most: int = LOCAL_EDGES) -> bool:
    """Whether pairs has at most that many rows; counts no more of them than that."""
    return pairs.limit(most + 1).count() <= most


def in_one_task(pairs: DataFrame, f: Callable[[list[str], list[str]], pa.RecordBatch], schema: str) -> DataFrame:
    """f of all from_ids and to_ids, run in one task: for pairs that few_edges has counted."""

    def run(batches):
        a: list[str] = []
        b: list[str] = []
        for batch in batches:
            a += batch.column(0).to_pylist()
            b += batch.column(1).to_pylist()
        yield f(a, b)

    return pairs.select("from_id", "to_id").coalesce(1).mapInArrow(run, schema)
