"""Coverage, effectiveness, health, recall, trends and other measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.schema import bare_kind


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def composite(orphan: Column, bug: Column, recall_miss: Column) -> Column:
    """100 - (0.3 orphan + 0.5 bug + 0.2 recall miss), all in per cent, clamped, one decimal."""
    return F.round(clamp(100 - (0.3 * orphan + 0.5 * bug + 0.2 * recall_miss), 0, 100), 1)


def simple_health(orphan: Column, bug: Column) -> Column:
    return clamp(100 - orphan - bug, 0, 100)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 45, "D").otherwise("F")


def fidelity(bug_rate: Column) -> Column:
    return F.when(1 - bug_rate >= 0.97, "healthy").when(1 - bug_rate >= 0.90, "warning").otherwise("critical")


def effectiveness(reachable: Column, pct: Column) -> Column:
    """Quadrant of test reachability and line coverage; null reachability isn't measured."""
    lines = F.when(pct.isNull(), "no_coverage").when(pct <= 0, "no_lines").when(pct < 50, "low").otherwise("covered")
    return F.when(reachable.isNull(), "not_measured").otherwise(F.concat(F.when(reachable, "reached_").otherwise("orphan_"), lines))


def orphan_cause(kind: Column, subtype: Column, name: Column) -> Column:
    """Why an entity has no edge, by ordered rules."""
    k, s = F.lower(kind), F.lower(subtype)
    core = bare_kind(kind).rlike("class|function|method|interface")
    exportish = name.rlike("^[A-Za-z]") & name.rlike("[a-z][A-Z]|[A-Z][a-z]")
    return (
        F.when((s == "import") & (k.contains("component") | k.contains("scope")), "import_placeholder")
        .when(k.rlike("^(manifest:|hierarchy:|http_endpoint|dbmap:|openapi:|framework:)"), "framework_synthetic")
        .when((k.contains("operation") | k.contains("component")) & s.contains("const"), "const_no_references")
        .when(exportish & ~core, "cross_file_export")
        .when(core, "real_construct_bug")
        .otherwise("misc")
    )


def recall(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row of must-have and nice-to-have recall and forbidden hits; expected(keys, level)."""
    hit = expected.join(found.select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left")
    n = lambda level, got=False: F.sum(F.when((F.col("level") == level) & (F.col("hit").isNotNull() if got else F.lit(True)), 1).otherwise(0))
    return hit.agg(n("must").alias("must"), n("must", True).alias("must_found"), n("nice").alias("nice"), n("nice", True).alias("nice_found"), n("forbidden", True).alias("forbidden_hits")).withColumn("recall", F.round(F.when(F.col("must") > 0, F.col("must_found") / F.col("must")).otherwise(1.0), 6))


def search_metrics(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """recall@5, recall@10 and mean reciprocal rank of ranked(query, id, rank) against relevant(query, id)."""
    hit = relevant.join(ranked, ["query", "id"], "left")
    per = hit.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("rank") <= 5, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("rank") <= 10, 1).otherwise(0)).alias("b"), F.min("rank").alias("first"))
    return per.agg(F.round(F.avg(F.col("a") / F.col("n")), 6).alias("recall_5"), F.round(F.avg(F.col("b") / F.col("n")), 6).alias("recall_10"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def nearest_rank(df: DataFrame, group: str, column: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Exact percentiles at index floor((n - 1) * p / 100) of each group's sorted values."""
    w = Window.partitionBy(group)
    ranked = df.select(group, F.col(column).alias("v"), F.row_number().over(w.orderBy(column)).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    return ranked.groupBy(group).agg(*[F.max(F.when(F.col("r") == F.floor((F.col("n") - 1) * p / 100) + 1, F.col("v"))).alias(f"p{p}") for p in percents])


def reservoir(df: DataFrame, order: str, size: int) -> DataFrame:
    """A uniform sample of that many rows: the smallest hashes of a unique column, the same whatever the partitions."""
    return df.orderBy(F.md5(F.col(order).cast("string").cast("binary")), order).limit(size)


def metric_delta(history: DataFrame, days: int) -> DataFrame:
    """(grp, latest, delta) of history(grp, ts, value): the last non-null value less that of the last entry at least so many days before the last."""
    last = history.groupBy("grp").agg(F.max("ts").alias("end"), F.max_by("value", F.when(F.col("value").isNotNull(), F.col("ts"))).alias("latest"))
    ref = history.join(last, "grp").where(F.col("ts") <= F.col("end") - F.expr(f"INTERVAL {days} DAYS")).groupBy("grp").agg(F.max_by(F.struct("value"), "ts").alias("ref"))
    return last.join(ref, "grp", "left").select("grp", F.round("latest", 6).alias("latest"), F.round(F.col("latest") - F.col("ref.value"), 6).alias("delta"))


def budget(value: Column, limit: Column, inverted: Column) -> Column:
    """green, yellow (at most a tenth beyond) or red."""
    over = F.when(inverted, (limit - value) / limit).otherwise((value - limit) / limit)
    return F.when(over <= 0, "green").when(over <= 0.1, "yellow").otherwise("red")


def regressed(value: Column, baseline: Column, inverted: Column, tolerance: float = 0.2) -> Column:
    """warning where a metric is over a fifth worse than its baseline, else ok; no baseline, no verdict."""
    worse = F.when(inverted, (baseline - value) / baseline).otherwise((value - baseline) / baseline)
    return F.when(baseline > 0, F.when(worse > tolerance, "warning").otherwise("ok"))


def time_decayed(confidence: Column, days: Column) -> Column:
    """Less 0.05 for every 30 whole days, not under 0.2."""
    return F.greatest(F.lit(0.2), confidence - 0.05 * F.floor(days / 30))


def saving(df: DataFrame) -> DataFrame:
    """Graph tokens over file tokens, rows without either skipped."""
    use = df.where("file_tokens > 0 and graph_tokens > 0")
    return use.agg(F.round(F.sum("file_tokens") / F.sum("graph_tokens"), 6).alias("ratio"), F.count(F.lit(1)).alias("rows"))


def cost(df: DataFrame, kinds: DataFrame, overhead: int = 200, rate_in: float = 3.0, rate_out: float = 15.0) -> DataFrame:
    """(kind, entities, tokens, usd): tokens per kind and entity plus overhead, 70 % in and 30 % out, dollars per million."""
    t = df.groupBy("kind").agg(F.count(F.lit(1)).alias("entities")).join(F.broadcast(kinds), "kind", "left")  # a row per kind
    t = t.withColumn("tokens", F.col("entities") * (F.coalesce("per", F.lit(300)) + overhead))
    return t.select("kind", "entities", "tokens", F.round(F.col("tokens") * (0.7 * rate_in + 0.3 * rate_out) / 1e6, 6).alias("usd"))


def complexity(source: Column) -> Column:
    """One plus the number of branching words and operators."""
    return 1 + F.regexp_count(source, F.lit(r"\b(if|elif|for|while|case|catch|except|and|or)\b|&&|\|\|"))


def stub_verdict(left_pure: Column, right_pure: Column, resolved: Column) -> Column:
    """likely_stub where one side only computes, thin where neither does, implemented where both do."""
    return F.when(~resolved, "unresolved").when(left_pure & right_pure, "thin").when(left_pure != right_pure, "likely_stub").otherwise("implemented")


def tautology(left: Column, right: Column) -> Column:
    literal = r"^([0-9.]+|'[^']*'|true|false)$"
    return F.when(left.rlike(literal) & (left == right), "same_literal").when(left == right, "self_compare").when(F.lower(left).isin("true", "1") & right.isNull(), "constant_true")
