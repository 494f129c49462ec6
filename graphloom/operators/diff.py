"""Two-sided comparisons: snapshots, payloads, literals, response shapes, authorisation, merge risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text

#: Fields of transport envelopes, and the strength of each authorisation kind.
ENVELOPE = ("data", "status", "error", "errors", "message", "meta", "code", "success", "page", "total", "count", "results")
STRENGTH = {"unknown": -1, "public": 0, "authenticated": 1, "scope": 2, "role": 2, "page": 3, "action": 3, "superuser": 4}


def snapshots(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """(id, change, changed): added, removed and modified entities, with the fields that differ, from one full outer join."""
    a = old.select("id", F.struct(*fields).alias("a"))
    b = new.select("id", F.struct(*fields).alias("b"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    both = a.join(b, "id", "full").withColumn("changed", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.array_join(changed, ",")).otherwise(""))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("changed") != "", "modified")
    return both.select("id", kind.alias("change"), "changed").where("change is not null")


def edge_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, change): triples on one side only."""
    key = ["from_id", "to_id", "kind"]
    a, b = old.select(*key).distinct(), new.select(*key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).union(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def merge_risk(impacted: DataFrame) -> DataFrame:
    """(a, b, shared): pairs of refs whose impacted communities overlap; -1 is no community."""
    x = impacted.where("community <> -1").select("ref", "community").distinct()
    a, b = x.select(F.col("ref").alias("a"), "community"), x.select(F.col("ref").alias("b"), "community")
    return a.join(b, "community").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def payload_drift(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(key, only_producer, only_consumer, drift): field names per key, compared without case or separators."""
    norm = lambda df, name: df.groupBy("key").agg(F.collect_set(text.field_name(F.col("field"))).alias(name))
    both = norm(producers, "p").join(norm(consumers, "c"), "key")
    out = both.select("key", F.array_sort(F.array_except("p", "c")).alias("x"), F.array_sort(F.array_except("c", "p")).alias("y")).where("size(x) + size(y) > 0")
    every = F.forall(F.concat("x", "y"), lambda f: f.isin(*ENVELOPE))
    return out.select("key", F.array_join("x", ",").alias("only_producer"), F.array_join("y", ",").alias("only_consumer"), F.when(every, "envelope").otherwise("schema").alias("drift"))


def literal_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, status) of (key, value) members, keys aligned by their canonical form: equal, mismatch, only_left, only_right."""
    norm = lambda df, side: df.groupBy(text.canonical_key(F.col("key")).alias("key")).agg(F.array_sort(F.collect_list(F.coalesce("value", "key"))).alias(side))
    both = norm(left, "l").join(norm(right, "r"), "key", "full")
    return both.select("key", F.when(F.col("l").isNull(), "only_right").when(F.col("r").isNull(), "only_left").when(F.col("l") == F.col("r"), "equal").otherwise("mismatch").alias("status"))


def separator(key: Column) -> Column:
    """The naming convention of a key: the separator it uses, or camel, or plain."""
    return F.when(key.contains("-"), "-").when(key.contains("_"), "_").when(key.contains("."), ".").when(key.rlike("[a-z0-9][A-Z]"), "camel").otherwise("plain")


def separators(members: DataFrame) -> DataFrame:
    """(side, key, convention, dominant): keys of members(side, key) that leave the convention most of their side follows; ties to the smaller one."""
    each = members.select("side", "key").distinct().withColumn("convention", separator(F.col("key")))
    n = each.groupBy("side", "convention").agg(F.count(F.lit(1)).alias("n"))
    most = n.groupBy("side").agg(F.min_by("convention", F.struct(-F.col("n"), F.col("convention"))).alias("dominant"))
    return each.join(most, "side").where("convention <> dominant").select("side", "key", "convention", "dominant")


def unresolved_shapes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(endpoint, status, side): statuses(endpoint, status, resolved) of which one side is blind, where the other knows its fields."""
    key = ["endpoint", "status"]
    one = lambda df, name: df.groupBy(*key).agg(F.min("resolved").alias(name))
    both = one(left, "l").join(one(right, "r"), key)
    return both.select(*key, F.when(~F.col("l") & ~F.col("r"), "both").when(~F.col("l"), "left").when(~F.col("r"), "right").alias("side")).where("side is not null")


def resolved_only(shapes: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Shapes without the statuses that are unresolved: those are one record each, not drift of all their fields."""
    return shapes.join(unresolved.select("endpoint", "status").distinct(), ["endpoint", "status"], "left_anti")


def response_shapes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(endpoint, status, field, drift) of (endpoint, status, field, type, optional); str and string are one type."""
    norm = lambda df, s: df.select("endpoint", "status", "field", F.when(F.col("type") == "str", "string").otherwise(F.col("type")).alias(f"t{s}"), F.col("optional").alias(f"o{s}"))
    key = ["endpoint", "status", "field"]
    both = norm(left, "l").join(norm(right, "r"), key, "full")
    drift = F.when(F.col("tl").isNull(), "only_right").when(F.col("tr").isNull(), "only_left").when(F.col("tl") != F.col("tr"), "type_mismatch").when(F.col("ol") != F.col("or"), "optional_mismatch")
    return both.select(*key, drift.alias("drift")).where("drift is not null")


def auth_verdict(left: Column, left_literal: Column, right: Column, right_literal: Column) -> Column:
    """Verdict of one posture (left) against an older one (right)."""
    strength = lambda k: F.coalesce(*[F.when(k == n, v) for n, v in STRENGTH.items()], F.lit(-1))
    literal = left.isin("page", "action", "role", "scope") & (text.field_name(F.coalesce(left_literal, F.lit(""))) != text.field_name(F.coalesce(right_literal, F.lit(""))))
    a, b = strength(left), strength(right)
    return (
        F.when((a < 0) | (b < 0), "kind_mismatch").when(left == right, F.when(literal, "slug_mismatch").otherwise("equivalent"))
        .when(a > b, "stricter").when(a < b, "looser").otherwise("kind_mismatch")
    )


def parity(left: DataFrame, right: DataFrame, key: list[str], column: str, tolerance: float) -> DataFrame:
    """Rows on which two results differ by more than the tolerance, or that only one of them has."""
    a, b = left.select(*key, F.col(column).alias("l")), right.select(*key, F.col(column).alias("r"))
    return a.join(b, key, "full").where("l is null or r is null or abs(l - r) > {}".format(tolerance))
