"""Text and vector search: BM25 over postings, cosine, rank fusion, prefix search, TF-IDF community names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators.loops import settled, stored
from graphloom.operators.traverse import bfs

K1, B = 1.2, 0.75
RRF = 60


def bm25(docs: DataFrame, query: list[str]) -> DataFrame:
    """(id, score) of docs(id, text): idf = ln(1 + (N - df + .5) / (df + .5)); duplicate query terms count twice; only scores above 0.

    Only postings of the query's terms leave the scan; document lengths and the corpus mean are one aggregate of two numbers.
    """
    terms = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    rows = docs.select("id", terms.alias("terms"))
    sized = rows.select("id", F.size("terms").alias("len"), F.filter("terms", lambda x: x.isin(*query)).alias("hits"))
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    tf = sized.where(F.size("hits") > 0).select("id", "len", F.explode("hits").alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = docs.sparkSession.createDataFrame([(t, query.count(t)) for t in sorted(set(query))], "term string, times int")
    part = tf.join(F.broadcast(df.join(weight, "term")), "term").crossJoin(F.broadcast(stats))  # a row per query term, and one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return part.groupBy("id").agg(F.sum(one).alias("score")).where("score > 0")


def tokens_of(c: Column) -> Column:
    """Search tokens of every identifier in a text: the whole in lower case, then its parts; single characters say nothing."""
    words = F.filter(F.split(c, r"[^A-Za-z0-9_$]+"), lambda x: x != "")
    return F.filter(F.flatten(F.transform(words, text.search_tokens)), lambda x: F.length(x) > 1)


def postings(entities: DataFrame, *columns: str) -> DataFrame:
    """(term, id, tf, len): how often each search token occurs in an entity's named columns, and the entity's number of tokens.

    Discriminators (variable=literal) are a column like any other: both sides are indexed, one-digit numbers aren't.
    """
    rows = entities.select("id", tokens_of(F.concat_ws(" ", *columns)).alias("terms")).withColumn("len", F.size("terms"))
    return rows.select(F.explode("terms").alias("term"), "id", "len").groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf")).select("term", "id", "tf", "len")


def words_of(c: Column) -> Column:
    """Words of a text: runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def write_index(entities: DataFrame, folder: str, *columns: str) -> None:
    """The index of the search tokens in an entity's named columns."""
    whole = entities.select("id", F.concat_ws(" ", *columns).alias("whole")).repartition("id")  # small files would be one task's regular expressions
    write_postings(whole.select("id", tokens_of(F.col("whole")).alias("terms")), folder)


def counted(rows: DataFrame) -> DataFrame:
    """rows(id, terms) as (id, len, counts): a row's distinct terms with how often each occurs, from runs in its sorted terms, without a shuffle."""
    ordered = rows.select("id", F.size("terms").alias("len"), F.sort_array("terms").alias("s"))
    last = F.filter(F.sequence(F.lit(1), F.col("len")), lambda i: (i == F.col("len")) | (F.get("s", i - 1) != F.get("s", i)))
    ends = ordered.select("id", "len", "s", F.when(F.col("len") > 0, last).alias("ends"))
    return ends.select("id", "len", F.transform("ends", lambda e, k: F.struct(F.get("s", e - 1).alias("term"), (e - F.coalesce(F.get("ends", k - 1), F.lit(0))).cast("bigint").alias("tf"))).alias("counts"))


def write_postings(rows: DataFrame, folder: str) -> None:
    """Postings of rows(id, terms) in ranges of terms, sorted, so that a query's filter on terms prunes files and row groups; and the two corpus numbers."""
    sized = stored(counted(rows))  # tokens once: for the ranges' sample, the postings and the corpus numbers
    post = sized.select(F.explode("counts").alias("x"), "id", "len").select("x.term", "id", "x.tf", "len")
    post.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/postings")
    sized.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).write.mode("overwrite").parquet(f"{folder}/stats")


def bm25_postings(post: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """(id, score) of a query's tokens over postings and the one-row stats(n, mean); duplicate query tokens count twice."""
    asked = post.sparkSession.range(1).select(F.explode(tokens_of(F.lit(query))).alias("term"))
    return bm25_terms(post, stats, [r.term for r in asked.collect()])  # a query's tokens


def bm25_terms(post: DataFrame, stats: DataFrame, terms: list[str]) -> DataFrame:
    """(id, score) of terms over postings and the one-row stats(n, mean), only scores above 0; repeated terms count as often.

    A term's document frequency is its number of postings, counted while they are scored.
    """
    hit = post.where(F.col("term").isin(sorted(set(terms))))
    times = F.create_map(*(F.lit(x) for t in sorted(set(terms)) for x in (t, terms.count(t)))) if terms else F.create_map(F.lit(""), F.lit(0))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    part = hit.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # a row per query term, and one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = F.element_at(times, F.col("term")) * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return part.groupBy("id").agg(F.sum(one).alias("score")).where("score > 0")


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/stats")


def find(hits: DataFrame, entities: DataFrame, edges: DataFrame, least: float = 0.15, hops: int = 1, tokens: int = 2000, top: int = 50) -> DataFrame:
    """(id, score, depth, low_confidence, used): the best hits(id, score) over the floor, by tier and score, and what lies near them.

    entities(id, name, tier). Hits below the floor go, even if none is left; then the best one comes back alone, marked, and nothing
    is expanded. Neighbours of the hits follow by depth, while the running length of the names fits the budget of tokens.
    """
    best = top_scores(hits, top)
    good = floored(best, least)
    sure = settled(good)
    near = bfs(edges, sure.where("not low_confidence").select("id"), hops, "both").where("depth > 0")
    rows = sure.select("id", "score", F.lit(0).alias("depth"), "low_confidence").union(near.join(sure, "id", "left_anti").select("id", F.lit(0.0), "depth", F.lit(False)))
    named = rows.join(entities.select("id", "name", "tier"), "id")
    w = Window.orderBy("depth", "tier", F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    order = named.orderBy("depth", "tier", F.desc("score"), "id").limit(tokens)  # a name takes a token at least, so no more rows can fit
    return order.withColumn("used", F.sum(F.greatest(F.lit(1), F.ceil(F.length("name") / 4))).over(w)).where(F.col("used") <= tokens).select("id", "score", "depth", "low_confidence", "used")


def find_fused(index: str, vectors: DataFrame, entities: DataFrame, edges: DataFrame, query: str, vector: list[float], least: float = 0.3, hops: int = 1, tokens: int = 2000, top: int = 50) -> DataFrame:
    """find() in one call: BM25 over the stored index and cosines over vectors(id, embedding), fused by rank; then floor, tiers, neighbours and budget.

    Fused scores are scaled so that the first of both rankings has 1. A query without tokens is ranked by its vector alone, one without a vector by its tokens.
    """
    post, stats = read_index(vectors.sparkSession, index)
    lexical = top_scores(bm25_postings(post, stats, query), top)
    near = semantic(vectors, vector, top) if vector else lexical.limit(0)
    fused = fuse(lexical, near, top=top).select("id", F.round(F.col("score") * (RRF + 1) / 2, 6).alias("score"))
    return find(settled(fused), entities, edges, least, hops, tokens, top)


def top_scores(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    return scores.select("id", F.round("score", digits).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def semantic(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, score) of the k nearest vectors(id, embedding) by cosine; other lengths are skipped. One pass, a bounded heap per task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("id", text.cosine(F.col("embedding").cast("array<double>"), q).alias("score")).where("score is not null")
    return top_scores(scored, k)


def fuse(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("bm25", "semantic"), top: int = 50) -> DataFrame:
    """(id, score, source): reciprocal rank fusion of two bounded rankings (id, score)."""
    w = Window.orderBy(F.desc("score"), "id")
    a = first.orderBy(F.desc("score"), "id").limit(top).withColumn("r1", F.row_number().over(w)).select("id", "r1")
    b = second.orderBy(F.desc("score"), "id").limit(top).withColumn("r2", F.row_number().over(w)).select("id", "r2")
    both = a.join(b, "id", "full")
    part = lambda r: F.coalesce(1.0 / (RRF + F.col(r)), F.lit(0.0))
    source = F.when(F.col("r1").isNotNull() & F.col("r2").isNotNull(), "+".join(names)).when(F.col("r1").isNotNull(), names[0]).otherwise(names[1])
    return both.select("id", F.round(part("r1") + part("r2"), 8).alias("score"), source.alias("source"))


def floored(scores: DataFrame, least: float = 0.15) -> DataFrame:
    """Scores at the floor or above; if none, the one best row, marked as low confidence. 0 turns the floor off."""
    marked = scores.withColumn("low_confidence", F.lit(False))
    if least <= 0:
        return marked
    good = marked.where(F.col("score") >= least)
    best = scores.orderBy(F.desc("score"), "id").limit(1).withColumn("low_confidence", F.lit(True)).join(good.limit(1).select(F.lit(1).alias("any")), F.lit(True), "left").where("any is null").drop("any")
    return good.union(best)


def community_names(members: DataFrame, top: int = 3) -> DataFrame:
    """(community, name): members(community, name, qualified_name, source_file); the community is a document of name tokens.

    Score tf * (ln((N + 1) / (df + 1)) + 1) with N communities that have tokens; ties to the smaller token; none: community_<id>.
    """
    bag = members.select("community", F.explode(F.concat(text.name_tokens(F.col("name")), text.name_tokens(F.col("qualified_name")), text.name_tokens(text.base_name(F.col("source_file"))))).alias("token"))
    tf = bag.groupBy("community", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = tf.agg(F.count_distinct("community").alias("n"))
    scored = tf.join(df, "token").crossJoin(F.broadcast(n)).withColumn("score", F.round(F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1), 9))  # n is one row
    w = Window.partitionBy("community").orderBy(F.desc("score"), "token")
    best = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "token"))), lambda x: x["token"]), "-").alias("name"))
    return members.select("community").distinct().join(best, "community", "left").select("community", F.coalesce("name", F.concat(F.lit("community_"), F.col("community").cast("string"))).alias("name"))


def to_embed(entities: DataFrame, known: DataFrame) -> DataFrame:
    """Entities(id, hash) whose content hash is new or changed against known(id, hash)."""
    return entities.join(known, ["id", "hash"], "left_anti")


def kept_vectors(cache: DataFrame, active: DataFrame, now, ttl_days: int) -> DataFrame:
    """Cache rows(hash, touched) that are active, or not older than the time to live."""
    old = F.col("touched") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {ttl_days} DAYS")
    return cache.join(cache.where(old).join(active, "hash", "left_anti").select("hash"), "hash", "left_anti")


def write_vectors(vectors: DataFrame, folder: str, model: str, dims: int) -> None:
    """Vectors(id, embedding) beside a header of one row that says which model and length they have."""
    vectors.select("id", "embedding").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{folder}/vectors")
    vectors.sparkSession.createDataFrame([(model, dims)], "model string, dims int").write.mode("overwrite").parquet(f"{folder}/header")


def read_vectors(spark: SparkSession, folder: str, model: str, dims: int) -> DataFrame | None:
    """The stored vectors, or None where their header tells of another model or length: the store is to be rebuilt."""
    header = spark.read.parquet(f"{folder}/header").first()
    return spark.read.parquet(f"{folder}/vectors") if (header.model, header.dims) == (model, dims) else None
