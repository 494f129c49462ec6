"""Incremental work: merging changed files, deciding what to rerun, tiers by idle time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edge and entity kinds that flows read.
FLOW_EDGES = ("CALLS", "IMPLEMENTS", "FETCHES", "SERVES", "PUBLISHES_TO", "SUBSCRIBES_TO", "ROUTES_TO", "CONTAINS")


def merge_entities(old: DataFrame, new: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Entities of unchanged files, then the new ones; a new one wins where ids collide."""
    kept = old.join(changed_files, "source_file", "left_anti").join(new.select("id"), "id", "left_anti")
    return kept.select(*new.columns).union(new)


def merge_edges(old: DataFrame, new: DataFrame, merged: DataFrame) -> DataFrame:
    """Old edges whose ends both survive, and the new ones, one per triple."""
    ids = merged.select("id")
    alive = old.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return alive.select(*new.columns).union(new).dropDuplicates(["from_id", "to_id", "kind"])


def flows_affected(delta: DataFrame) -> bool:
    """Whether a delta(kind) touches anything that flows read; over-approximates, never misses."""
    return not delta.where(F.col("kind").isin(*FLOW_EDGES)).isEmpty()


def full_rebuild(changed_files: DataFrame, most: int = 50) -> bool:
    return changed_files.limit(most + 1).count() > most


def content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row (digest, n) that identifies the set of rows whatever their order: two sums of 64 bits of the rows' SHA-256, and their count.

    A row is hashed as JSON with its nulls, so neither separators inside values nor nulls make two rows alike.
    """
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    whole = F.concat_ws(":", F.coalesce(part(1), F.lit(0)).cast("string"), F.coalesce(part(17), F.lit(0)).cast("string"))
    return rows.select(*columns).distinct().agg(whole.alias("digest"), F.count(F.lit(1)).alias("n"))


def tier(idle_hours: Column, pinned: Column) -> Column:
    return F.when(pinned | (idle_hours < 1), "HOT").when(idle_hours < 24, "WARM").when(idle_hours < 24 * 30, "COLD").otherwise("EXPIRED")


def upsert_method(existing: DataFrame, incoming: DataFrame, rejected: DataFrame, method: str) -> DataFrame:
    """Links after a pass: rows of other methods stay; the pass's own are replaced, less the rejected, one per id."""
    key = ["source", "target", "method"]
    fresh = incoming.join(rejected.select(*key), key, "left_anti").dropDuplicates(["id"])
    return existing.where(F.col("method") != method).select(*incoming.columns).union(fresh.select(*incoming.columns))


def stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Repos whose inputs(repo, version) are gone or changed since an overlay was stored; a repo that is only new isn't among them."""
    return stored.join(current, ["repo", "version"], "left_anti").select("repo")


def reused(spark, folder: str, digest: str, build) -> DataFrame:
    """The result of an algorithm over inputs with that hash: read if it was written before, built and written if not."""
    path = f"{folder}/{digest}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
