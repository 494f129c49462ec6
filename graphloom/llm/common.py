"""Helpers that every training-data operator shares: reading tables, scratch tables, chunking.

Nothing here collects rows. Scratch tables go to the folder named by ``spark.checkpoint.dir``, which every
executor of a cluster can reach; without that setting a local master (tests) gets a temporary folder, and a cluster an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Caches that operators keep in a Python worker, by operator; workers outlive stages.
_CACHES: dict[str, object] = {}


def only_cache(operator: str, clear) -> None:
    """Called where a task of the operator begins: the other operators' caches in this worker are dropped."""
    for name in [n for n in _CACHES if n != operator]:
        _CACHES.pop(name)()
    _CACHES[operator] = clear


def tidy() -> None:
    """Give freed memory back to the system: idle workers keep what they hold, and an executor has several."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(f):
    """The function of a map over batches, which gives its memory back when its task ends."""

    def run(batches):
        yield from f(batches)
        tidy()

    return run


def small_slices(batch, column: int = 1, most_rows: int = 256, most_bytes: int = 1 << 20):
    """A record batch in slices of bounded rows and bytes of one text column; a longer text is a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < batch.num_rows:
        before = size[low - 1] if low else 0
        high = max(low + 1, min(low + most_rows, int(np.searchsorted(size, before + most_bytes, "right"))))
        yield batch.slice(low, high - low)
        low = high


#: Rows of an Arrow batch between Spark and Python: texts are long, so far fewer than Spark's default.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder: the session's setting, or a temporary one if there is none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(spark, "_graphloom_scratch", None)
        if not found:
            found = tempfile.mkdtemp(prefix="graphloom-")
            spark._graphloom_scratch = found
    return found.rstrip("/")


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def scratch_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote for ``df``, once nothing reads it any more: a round of a loop whose successor is written."""
    _delete(df.sparkSession, df._graphloom_path)


def sweep(spark: SparkSession) -> None:
    """Delete all that materialize() wrote in this application. For its end: results that weren't written elsewhere can't be read after it."""
    _delete(spark, scratch_dir(spark))


def whole_texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id and text (null: empty), plus the named columns; every other column is left behind."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


def hash_sample(df: DataFrame, rows: int, n: int, *columns: str) -> DataFrame:
    """At most ``rows`` of about n rows, those with the smallest hashes of the columns: the same whatever the partitions.

    A cut of the hash range comes before the sort, so tasks don't each send ``rows`` rows to one.
    """
    hashed = df.withColumn("_h", F.xxhash64(*columns))
    if n > 4 * rows:
        hashed = hashed.where(F.col("_h") < int(-(1 << 63) + (1 << 64) * (2 * rows / n)))
    return hashed.orderBy("_h", *columns).limit(rows).drop("_h")


#: Known heavy buckets that may be broadcast, as a list of small rows.
HEAVY_ROWS = 10_000
#: Rows that one task of a comparison gets, about.
TASK_ROWS = 250_000


def dealt_in_blocks(entries: DataFrame, keys: tuple[str, ...], node: str, most: int) -> DataFrame:
    """entries with own, i and j, dealt over tasks: all rows of a bucket (equal keys) meet, two by two.

    A bucket of over ``most`` rows is cut into blocks by a hash of ``node``, and each pair of blocks (i, j) is a group of its own;
    a row goes once to every pair that has its block (own). Other buckets are the pair (0, 0). Buckets are counted first, with
    partial aggregation. Tasks are as many as the rows ask for, each counted as often as it is sent.
    """
    spark = entries.sparkSession
    counts = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    heavy = materialize(counts.groupBy((F.col("rows") > most).alias("heavy"), *(F.when(F.col("rows") > most, F.col(k)).alias(k) for k in keys)).agg(F.sum("rows").alias("rows")))
    sent = F.col("rows") * F.when(F.col("heavy"), F.ceil(F.col("rows") / most)).otherwise(1)  # a heavy bucket's row goes to each pair of its block
    total = heavy.agg(F.sum(sent)).first()[0] or 0
    heavy = heavy.where("heavy").select(*keys, F.ceil(F.col("rows") / most).cast("int").alias("blocks"))
    many = heavy.count()
    if many:
        entries = entries.join(F.broadcast(heavy) if many <= HEAVY_ROWS else heavy, list(keys), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        entries = entries.withColumn("own", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        entries = entries.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")
    else:
        entries = entries.withColumns({c: F.lit(0) for c in ("own", "i", "j")})
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // TASK_ROWS))
    return entries.repartition(tasks, *keys, "i", "j")


def buckets_of(*keys):
    """(order, group number of each row in that order, size of each group) of rows with equal keys; the first key sorts last."""
    import numpy as np

    order = np.lexsort(keys)
    n = len(order)
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, n))
    return order, starts, np.repeat(np.arange(len(starts)), size), size


def paired(starts, group, size, short: int = 64, block: int = 512):
    """Positions (x, y), x < y, of all pairs inside each bucket, in lots of bounded size: short buckets by shifts, long ones by blocks."""
    import numpy as np

    live = np.flatnonzero((size[group] <= short) & (size[group] > 1))
    for d in range(1, short):
        live = live[live + d < len(group)]
        live = live[group[live] == group[live + d]]
        if not len(live):
            break
        yield live, live + d
    for g in np.flatnonzero(size > short).tolist():
        low, high = int(starts[g]), int(starts[g] + size[g])
        for r in range(low, high, block):
            for c in range(r, high, block):
                x, y = np.meshgrid(np.arange(r, min(r + block, high)), np.arange(c, min(c + block, high)), indexing="ij")
                ahead = (y > x).ravel() if r == c else slice(None)
                yield x.ravel()[ahead], y.ravel()[ahead]


def chunked(docs: DataFrame, chunk_bytes: int = 4 << 20, least: int = 64, keep: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(doc_id, text, the named columns, chunk): documents dealt by a hash of doc_id and text into chunks of about ``chunk_bytes``.

    The number of chunks follows the input's bytes, so a chunk fits in one Python worker at any scale
    and a frequent item has at most one entry per chunk in whatever the chunks exchange.
    """
    texts = whole_texts(docs, *keep)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(max(least, -(-total // chunk_bytes)))
    return texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n
