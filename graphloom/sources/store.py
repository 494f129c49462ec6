"""A stored graph: entities and both orders of relationships as bucketed, sorted Parquet tables with Bloom filters.

    entities/  CLUSTERED BY id,      sorted by id                     Bloom filter on id
    out/       PARTITIONED BY kind, CLUSTERED BY from_id, sorted by from_id, to_id   Bloom filters on both ends
    in/        PARTITIONED BY kind, CLUSTERED BY to_id,   sorted by to_id, from_id   Bloom filters on both ends
    meta/      one row: version, buckets, numbers of rows; written last, so a folder with it is whole

A look-up by id reads one bucket's row groups whose ranges and Bloom filters admit the id. Entities join ``out`` on from_id and ``in`` on to_id bucket
by bucket, without an exchange. Maps are stored with their keys in order, a missing community as -2. An end that a third of all edges share is spread over
several files of its bucket when it is written; ``scan`` reads files one by one, as work that doesn't join should.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.loops import dropped, stored

VERSION = 1
#: Fixed value: what stands for no community in a stored graph.
NO_COMMUNITY = -2
#: Rows of a bucket, about, when their number isn't given; rows of one end from which it takes several files.
BUCKET_ROWS = 1_000_000
#: Bins of hashes in which ends are counted first: only those of a bin that is large enough are counted one by one.
BINS = 65_536
LAYOUT = {"entities": ("id", ["id"], []), "out": ("from_id", ["from_id", "to_id"], ["kind"]), "in": ("to_id", ["to_id", "from_id"], ["kind"])}


def _name(folder: str, part: str) -> str:
    return f"graph_{hashlib.sha256(folder.encode()).hexdigest()[:16]}_{part}"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def canonical(df: DataFrame) -> DataFrame:
    """Rows as they are stored: keys of maps in order, -2 for a missing community."""
    out = {f.name: F.map_from_entries(F.array_sort(F.map_entries(f.name))) for f in df.schema if isinstance(f.dataType, T.MapType)}
    if "community_id" in df.columns:
        out["community_id"] = F.coalesce("community_id", F.lit(NO_COMMUNITY))
    return df.withColumns(out) if out else df


def _dealt(df: DataFrame, key: str, other: str | None, buckets: int, most: int) -> DataFrame:
    """df with a bucket's rows in one task, which gives one file a bucket; an end of over ``most`` rows is dealt over several tasks by its other end."""
    bucket = F.expr(f"pmod(hash(`{key}`), {buckets})")
    if other is None:
        return df.repartition(buckets, key)
    bin = F.pmod(F.xxhash64(key), F.lit(BINS))
    large = [r.bin for r in df.groupBy(bin.alias("bin")).count().where(F.col("count") > most).collect()]  # a bounded number, and no ends that are rare
    if not large:
        return df.repartition(buckets, key)
    hot = df.where(bin.isin(*large)).groupBy(key).count().where(F.col("count") > most).select(F.col(key).alias("_hot"), F.ceil(F.col("count") / most).alias("_parts"))
    if hot.isEmpty():
        return df.repartition(buckets, key)
    salted = df.join(hot, df[key].eqNullSafe(F.col("_hot")), "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("_parts")), F.lit(0)))
    return salted.repartition(buckets, bucket, "_salt").drop("_hot", "_parts", "_salt")


def write(entities: DataFrame, relationships: DataFrame, folder: str, buckets: int | None = None, bucket_rows: int = BUCKET_ROWS, least: int = 1, as_files: bool = False) -> "GraphStore":
    """Write a graph and open it. entities has id, relationships from_id, to_id and kind; other columns stay as they are.

    Unless ``buckets`` says how many, there are ``least`` buckets and as many as leave each about ``bucket_rows`` rows: a task sorts one bucket.
    ``as_files``: relationships are read from files as they are, so there is nothing to compute once first.
    """
    spark, folder = entities.sparkSession, folder.rstrip("/")
    rows = {"entities": stored(canonical(entities)), "out": canonical(relationships) if as_files else stored(canonical(relationships))}  # computed once, read for counts and each order
    rows["in"] = rows["out"]
    counts = {part: rows[part].count() for part in ("entities", "out")}
    buckets = buckets or max(least, -(-max(counts.values()) // bucket_rows))
    for part, (key, order, by) in LAYOUT.items():
        name = _name(folder, part)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        other = next((c for c in order if c != key), None)
        out = _dealt(rows[part], key, other, buckets, bucket_rows).write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(*order)
        for c in order:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{c}", "true")
        if by:
            out = out.partitionBy(*by)
        out.option("path", f"{folder}/{part}").saveAsTable(name)
    meta = spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(buckets).alias("buckets"), F.lit(counts["entities"]).alias("entities"), F.lit(counts["out"]).alias("relationships"))
    meta.coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")
    dropped(rows["entities"])
    if not as_files:
        dropped(rows["out"])
    return GraphStore(spark, folder)


def is_whole(spark: SparkSession, folder: str) -> bool:
    return _exists(spark, f"{folder.rstrip('/')}/meta/_SUCCESS")


class GraphStore:
    """A stored graph, opened in a session: its tables are registered there if they aren't yet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        if not is_whole(spark, self.folder):
            raise FileNotFoundError(f"no whole graph in {folder}")
        self.meta = spark.read.parquet(f"{self.folder}/meta").first()
        if self.meta["version"] != VERSION:
            raise ValueError(f"a graph of version {self.meta['version']}; this reads version {VERSION}")
        for part, (key, order, by) in LAYOUT.items():
            name = _name(self.folder, part)
            if not spark.catalog.tableExists(name):
                schema = spark.read.parquet(f"{self.folder}/{part}").schema
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
                parts = f"PARTITIONED BY ({', '.join(by)}) " if by else ""
                spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {parts}CLUSTERED BY ({key}) SORTED BY ({', '.join(order)}) INTO {self.meta['buckets']} BUCKETS LOCATION '{self.folder}/{part}'")
                if by:
                    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")

    def _table(self, part: str) -> DataFrame:
        return self.spark.table(_name(self.folder, part))

    @property
    def entities(self) -> DataFrame:
        """All entities by bucket of id; -2 is a null community again."""
        out = self._table("entities")
        if "community_id" in out.columns:
            out = out.withColumn("community_id", F.nullif("community_id", F.lit(NO_COMMUNITY)))
        return out

    @property
    def out(self) -> DataFrame:
        """Relationships by bucket of from_id."""
        return self._table("out")

    @property
    def into(self) -> DataFrame:
        """Relationships by bucket of to_id."""
        return self._table("in")

    def scan(self, *kinds: str) -> DataFrame:
        """Relationships of the kinds (none: all) by files, however large a bucket is."""
        out = self.spark.read.parquet(f"{self.folder}/out")
        return out.where(F.col("kind").isin(*kinds)) if kinds else out

    def entity(self, id: str) -> DataFrame:
        return self.entities.where(F.col("id") == id)

    def by_kind(self, kind: str) -> DataFrame:
        return self.entities.where(F.col("kind") == kind)

    def references(self, id: str, *kinds: str) -> DataFrame:
        """Relationships that point at an entity."""
        found = self.into.where(F.col("to_id") == id)
        return found.where(F.col("kind").isin(*kinds)) if kinds else found

    def edges_of(self, id: str, *kinds: str) -> DataFrame:
        """Relationships that leave an entity."""
        found = self.out.where(F.col("from_id") == id)
        return found.where(F.col("kind").isin(*kinds)) if kinds else found

    def with_source(self, *columns: str) -> DataFrame:
        """Relationships with columns of the entity they leave, bucket by bucket; an end that isn't an entity has nulls."""
        ends = self.entities.select(F.col("id").alias("from_id"), *(F.col(c).alias(f"from_{c}") for c in columns))
        return self.out.join(ends.hint("merge"), "from_id", "left")

    def with_target(self, *columns: str) -> DataFrame:
        """Relationships with columns of the entity they point at, bucket by bucket."""
        ends = self.entities.select(F.col("id").alias("to_id"), *(F.col(c).alias(f"to_{c}") for c in columns))
        return self.into.join(ends.hint("merge"), "to_id", "left")
