"""URL filter: listed rules first, association rules mined from labelled pages for the rest. DataFrame and SQL functions only.

Method: a URL becomes at most ten tokens, one a slot: scheme, the host's last, second and third labels and the ones before them, the path's first
and second segments and the rest of it, the query's parameter names, the fragment. Runs of digits after the host become ``0``, so that running
numbers don't make every token unique. Nothing of a URL is left out, and slots bound the combinations of one URL by 2^10.
``pyspark.ml.fpm.FPGrowth`` mines the token combinations of labelled pages together with the label; rules ``tokens -> block`` of enough
support and confidence stay, without those that hold a shorter rule's tokens (they match nothing more). Distinct token sets are matched by an
inverted index: each rule is listed under its rarest token only and then checked for its other tokens; pages get the verdict by their token set.

Results: a null URL or one without ``://`` has an empty host and path and no tokens: no rule fits, so it is allowed. A page is bad if any label of its
id is; null ids have no label; repeated pages count as often as they occur and come back as often. Without labelled pages, or without rules, all that
no listed rule fits is allowed. Of listed rules that fit, the longest host and path win, then the longer host. Columns beside page_id and url are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import HEAVY_ROWS, materialize

#: A mined rule's least share and number of labelled pages, and its least confidence.
SHARE, ROWS, CONFIDENCE = 0.001, 10, 0.5
#: The consequent of a rule; tokens start with their slot.
BAD = "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    url = F.coalesce(url, F.lit(""))
    at = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return _lower(F.regexp_extract(url, at, 1)), F.regexp_extract(url, at, 2)


def tokens(url: Column) -> Column:
    """The URL's tokens, one a slot, sorted; none without ``://``."""
    text = F.coalesce(url, F.lit(""))
    host, path = host_and_path(url)
    shape = lambda c: F.regexp_replace(_lower(c), "[0-9]+", "0")
    labels = F.reverse(F.split(host, r"\."))
    segments = F.split(F.regexp_replace(shape(path), "^/", ""), "/")
    query = F.regexp_extract(text, r"(?s)://[^?#]*\?([^#]*)", 1)
    slots = {
        "s": _lower(F.regexp_extract(text, "(?s)^(.*?)://", 1)), "h1": F.get(labels, F.lit(0)), "h2": F.get(labels, F.lit(1)), "h3": F.get(labels, F.lit(2)),
        "h4": F.array_join(F.slice(labels, 4, F.greatest(F.size(labels), F.lit(1))), "."), "p1": F.get(segments, F.lit(0)), "p2": F.get(segments, F.lit(1)),
        "p3": F.array_join(F.slice(segments, 3, F.greatest(F.size(segments), F.lit(1))), "/"), "q": shape(F.regexp_replace(query, "=[^&]*", "")), "f": shape(F.regexp_extract(text, "(?s)://[^#]*#(.*)", 1)),
    }
    named = F.array(*(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{k}:"), c)) for k, c in slots.items()))
    return F.when(F.instr(text, "://") > 0, F.array_sort(F.array_compact(named))).otherwise(F.array().cast("array<string>"))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(verdict, name) of the longest (verdict, host, path) whose host is the URL's or a domain above it and whose path begins the URL's; else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    found = F.lit(None).cast("struct<verdict:string,name:string>")
    for verdict, domain, prefix in reversed(ordered):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(domain + prefix).alias("name"))).otherwise(found)
    return found


def mine(pages: DataFrame, labels: DataFrame, bad: Column, share: float = SHARE, rows: int = ROWS, confidence: float = CONFIDENCE) -> DataFrame:
    """(tokens, support, confidence): rules for bad pages, mined from the pages with a label; written once.

    labels has doc_id, a page's page_id; ``bad`` is a condition on its rows. A page is bad if any of its labels is.
    """
    marked = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce(bad, F.lit(False))).alias("bad"))
    items = F.concat(tokens(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>")))
    baskets = materialize(pages.select("page_id", "url").join(marked, "page_id").select(items.alias("items")))
    n = baskets.count()
    least = max(rows, math.ceil(n * share))
    if least > n:
        return baskets.where("false").select(F.col("items").alias("tokens"), F.lit(0).cast("bigint").alias("support"), F.lit(0.0).alias("confidence"))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
    return materialize(found.select(F.array_sort("antecedent").alias("tokens"), F.round(F.col("support") * n).cast("bigint").alias("support"), "confidence"))


def shortest(rules: DataFrame) -> DataFrame:
    """Rules without those that hold all tokens of a shorter one: each rule looks up its own parts, so no pairs of rules are compared.

    A rule of m tokens has at most 2^m - 2 parts, and slots bound m by ten.
    """
    several = rules.where(F.size("tokens") > 1).select("tokens", F.expr("explode(sequence(1, shiftleft(1, size(tokens)) - 2))").alias("mask"))
    parts = F.expr("filter(tokens, (t, i) -> (shiftright(mask, i) & 1) = 1)")
    longer = several.select("tokens", parts.alias("part")).join(rules.select(F.col("tokens").alias("part")), "part", "left_semi").select("tokens").distinct()
    return rules.join(longer, "tokens", "left_anti")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The token sets (tokens) that hold all tokens of some rule; rules is (tokens, ...)."""
    rules = rules.select(F.col("tokens").alias("rule"))
    often = rules.select(F.explode("rule").alias("token")).groupBy("token").count()
    # a rule is listed under the token that fewest rules share, so an index entry leads to few rules
    listed = rules.select("rule", F.explode("rule").alias("token")).join(often, "token").groupBy("rule").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    entries = sets.select("tokens", F.explode("tokens").alias("token")).join(_small(listed), "token")
    return entries.where(F.forall("rule", lambda t: F.array_contains(F.col("tokens"), t))).select("tokens").distinct()


def _small(df: DataFrame) -> DataFrame:
    """df for a broadcast if it has few rows; otherwise as it is, for a join by shuffles."""
    return F.broadcast(df) if df.limit(HEAVY_ROWS + 1).count() <= HEAVY_ROWS else df


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], mined: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every page: the listed rule's verdict, else that of the mined rules."""
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"), listed_rule(host, path, rules).alias("found"), tokens(F.col("url")).alias("tokens"))
    best = materialize(shortest(mined).select("tokens"))
    if not best.limit(1).count():
        blocked = F.lit(False)
    else:
        open_sets = read.where("found IS NULL AND size(tokens) > 0").select("tokens").distinct()
        hit = materialize(matched(open_sets, best)).withColumn("hit", F.lit(True))
        read = read.join(_small(hit), "tokens", "left")
        blocked = F.coalesce("hit", F.lit(False))
    verdict = F.coalesce("found.verdict", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    return read.select("page_id", "host", "path", F.col("found.name").alias("rule"), verdict.alias("verdict"))
