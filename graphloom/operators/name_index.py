"""Prefix and substring search over names, from an index on disk.

    names/  (low, id, name)   ranges of low, the name in lower case: a prefix is one range of row groups
    grams/  (gram, id, name)  ranges of gram, three characters of low: a substring's grams are as many ranges

A substring is looked up by the grams that it holds: names that have all of them are few, and are then compared. Substrings of under three characters
have no gram; for them the names are scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3


def grams_of(c: Column) -> Column:
    """The distinct runs of three characters of a text, in lower case."""
    low = F.lower(c)
    runs = F.transform(F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.substring(low, i, F.lit(GRAM)))
    return F.when(F.length(low) >= GRAM, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def write(entities: DataFrame, folder: str) -> None:
    """Index entities(id, name); rows without a name aren't found by one."""
    rows = entities.select("id", "name").where("name IS NOT NULL")
    names = rows.select(F.lower("name").alias("low"), "id", "name")
    names.repartitionByRange("low", "id").sortWithinPartitions("low", "id").write.mode("overwrite").parquet(f"{folder}/names")
    grams = rows.select(F.explode(grams_of(F.col("name"))).alias("gram"), "id", "name")
    grams.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(f"{folder}/grams")


def containing(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """(id, name) of all names that hold the query, whatever its case."""
    low = query.lower()
    grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not grams:
        return spark.read.parquet(f"{folder}/names").where(F.col("low").contains(low)).select("id", "name")
    hits = spark.read.parquet(f"{folder}/grams").where(F.col("gram").isin(grams))
    # a repeated (id, name) has each gram as often, so distinct grams are counted and its rows are kept by their number
    per = hits.groupBy("id", "name", "gram").agg(F.count(F.lit(1)).alias("times")).groupBy("id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("times").alias("times"))
    found = per.where((F.col("n") == len(grams)) & F.lower("name").contains(low))
    return found.select("id", "name", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_")).drop("_")


def prefixed(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """(id, name, score): names that are the query (3) or begin with it (2), whatever the case."""
    low = query.lower()
    names = spark.read.parquet(f"{folder}/names").where(F.col("low").startswith(low))
    return names.select("id", "name", F.when(F.col("low") == low, 3).otherwise(2).alias("score"))


def search(spark: SparkSession, folder: str, query: str, limit: int) -> DataFrame:
    """(id, name, score), best first: exact 3, prefix 2, inside a name 1; then name and id. An empty query finds nothing.

    Names that only hold the query are looked up if fewer than ``limit`` begin with it: they couldn't come before those.
    """
    order = [F.desc("score"), F.col("name"), F.col("id")]
    first = prefixed(spark, folder, query)
    if not query:
        return first.limit(0)
    if first.limit(limit).count() >= limit:
        return first.orderBy(*order).limit(limit)
    rest = containing(spark, folder, query).where(~F.lower("name").startswith(query.lower())).withColumn("score", F.lit(1))
    return first.union(rest).orderBy(*order).limit(limit)
