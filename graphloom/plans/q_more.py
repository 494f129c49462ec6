"""Queries on findings, detectors over text, enrichers and activity logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.projection import Tables
from graphloom.plans.registry import query


@query("secrets", "SELECT doc_id, len(regexp_extract_all(text, 'token = \"[0-9a-f]{40}\"')) AS n FROM documents WHERE regexp_matches(text, 'token = \"[0-9a-f]{40}\"')")
def secrets(t: Tables) -> DataFrame:
    pattern = F.lit('token = "[0-9a-f]{40}"')
    return t.documents.select("doc_id", F.regexp_count("text", pattern).alias("n")).where("n > 0")


@query("auth_coverage", "SELECT id, CASE WHEN size % 6 = 0 THEN size % 12 = 0 ELSE size % 3 = 1 END AS covered FROM fn WHERE kind = 'http_endpoint_definition'")
def auth_coverage(t: Tables) -> DataFrame:
    explicit = F.when(F.col("size") % 6 == 0, F.col("size") % 12 == 0)  # an explicit requirement wins over a missing decorator
    return t.fn.where("kind = 'http_endpoint_definition'").select("id", F.coalesce(explicit, F.col("size") % 3 == 1).alias("covered"))


@query("findings_list", "SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE event_type END, 'note') AS type, user_id AS entity FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND user_id IN (3, 5, 8) AND event_type IN ('view', 'error')")
def findings_list(t: Tables) -> DataFrame:
    kind = F.coalesce(F.when(F.col("event_type") != "view", F.col("event_type")), F.lit("note"))
    rows = t.events.select("event_id", "ts", kind.alias("type"), F.col("user_id").alias("entity"))
    return rows.where((F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")) & F.col("entity").isin(3, 5, 8) & F.col("type").isin("note", "error")).select("event_id", "type", "entity")


_CODE = "SELECT conv_id, turn, role, len(regexp_extract_all(lower(text), '\\b(join|select|from|where)\\b')) AS sql_words, len(regexp_extract_all(text, '\\b(TODO|FIXME|HACK)\\b')) AS markers, len(regexp_extract_all(text, 'https?://[^ ]+')) AS urls FROM conversations"


@query("code_patterns", _CODE)
def code_patterns(t: Tables) -> DataFrame:
    n = lambda c, p: F.regexp_count(c, F.lit(p))
    return t.conversations.select("conv_id", "turn", "role", n(F.lower("text"), r"\b(join|select|from|where)\b").alias("sql_words"), n("text", r"\b(TODO|FIXME|HACK)\b").alias("markers"), n("text", "https?://[^ ]+").alias("urls"))


@query("layer_classifier", "SELECT layer, count(*) AS n FROM (SELECT CASE p_size % 6 WHEN 0 THEN 'controller' WHEN 1 THEN 'service' WHEN 2 THEN 'repository' WHEN 3 THEN 'domain' WHEN 4 THEN 'infrastructure' ELSE 'unknown' END AS layer FROM part) x GROUP BY 1")
def layer_classifier(t: Tables) -> DataFrame:
    from graphloom.functions import text

    folder = F.element_at(F.array(*[F.lit(x) for x in ("src/Handlers/x.py", "src/usecase/x.py", "lib/dao/x.py", "src/Model/x.py", "src/adapters/x.py", "src/other/x.py")]), (F.col("p_size") % 6 + 1).cast("int"))
    return t.part.groupBy(text.layer(folder).alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@query("bounded_context", "SELECT split_part(source_file, '/', 1) || ':' || module AS context, count(*) AS entities, count(DISTINCT repo) AS repos FROM fn GROUP BY 1")
def bounded_context(t: Tables) -> DataFrame:
    top = F.concat(F.split_part("source_file", F.lit("/"), F.lit(1)), F.lit(":"), F.col("module"))
    return t.fn.groupBy(top.alias("context")).agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("repo").alias("repos"))


@query("activity_rollup", "SELECT ts::DATE AS day, event_type AS tool, count(*) AS calls, count(DISTINCT user_id) AS users, round(max(value), 6) AS slowest FROM events GROUP BY 1, 2")
def activity_rollup(t: Tables) -> DataFrame:
    g = t.events.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("tool"))
    return g.agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("user_id").alias("users"), F.round(F.max("value"), 6).alias("slowest"))


@query("properties_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def properties_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@query("endpoint_effects", ", r(root, id, depth) AS (SELECT id, id, 0 FROM fn WHERE kind = 'http_endpoint_definition' UNION SELECT root, to_id, depth + 1 FROM r JOIN calls ON from_id = id WHERE depth < 2) SELECT root AS endpoint, count(DISTINCT CASE WHEN f.key % 3 = 0 THEN f.id END) AS effectful, count(DISTINCT f.id) AS reached FROM r JOIN fn f ON f.id = r.id GROUP BY 1")
def endpoint_effects(t: Tables) -> DataFrame:
    calls = t.calls
    one = t.fn.where("kind = 'http_endpoint_definition'").select(F.col("id").alias("endpoint"), "id")
    two = one.join(calls, one.id == calls.from_id).select("endpoint", F.col("to_id").alias("id")).distinct()
    three = two.join(calls, two.id == calls.from_id).select("endpoint", F.col("to_id").alias("id")).distinct()
    every = one.union(two).union(three).distinct().join(t.fn.select("id", "key"), "id")
    return every.groupBy("endpoint").agg(F.count(F.when(F.col("key") % 3 == 0, 1)).alias("effectful"), F.count(F.lit(1)).alias("reached"))


@query("candidate_confidence", "SELECT id, round(greatest(0.45::DOUBLE, least(1.0, 0.6 - CASE WHEN start_line = 0 THEN 0.2 ELSE 0 END + CASE WHEN source_file <> '' THEN 0.1 ELSE 0 END - CASE WHEN subtype IN ('file', 'module') THEN 0.3 ELSE 0 END)), 6) AS score FROM ent WHERE kind <> 'SCOPE.Pattern'")
def candidate_confidence(t: Tables) -> DataFrame:
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    raw = 0.6 - part(F.col("start_line") == 0, 0.2) + part(F.col("source_file") != "", 0.1) - part(F.col("subtype").isin("file", "module"), 0.3)
    return t.ent.where("kind <> 'SCOPE.Pattern'").select("id", F.round(F.greatest(F.lit(0.45), F.least(F.lit(1.0), raw)), 6).alias("score"))


@query("repair_verification", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'R7' WHEN o_orderkey % 11 = 0 THEN 'R6' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN 'R2' WHEN o_custkey % 5 = 0 THEN 'R3' ELSE 'ok' END AS rule FROM orders""")
def repair_verification(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("id"), F.when(k % 13 == 0, "R7").when(k % 11 == 0, "R6").when((k % 3 == 0) & (k % 2 == 1), "R2").when(F.col("o_custkey") % 5 == 0, "R3").otherwise("ok").alias("rule"))


@query("spdx_normalise", "SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'GPL-3.0' WHEN 3 THEN 'MPL-2.0' END AS spdx, CASE p_size % 5 WHEN 0 THEN 'info' WHEN 1 THEN 'info' WHEN 2 THEN 'error' WHEN 3 THEN 'warn' ELSE 'unknown' END AS severity FROM part")
def spdx_normalise(t: Tables) -> DataFrame:
    from graphloom.functions import text

    name = F.element_at(F.array(*[F.lit(x) for x in ("MIT License", " apache 2.0", "GPLv3", "MPL-2.0", "Own")]), (F.col("p_size") % 5 + 1).cast("int"))
    found = text.spdx(name)
    return t.part.select(F.col("p_partkey").alias("id"), found.alias("spdx"), text.license_severity(found).alias("severity"))


@query("migration_names", "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '202401010000' || lpad((p_partkey % 60)::VARCHAR, 2, '0') WHEN 1 THEN (p_partkey % 9)::VARCHAR || '.' || (p_size % 7) WHEN 2 THEN lpad((p_partkey % 1000)::VARCHAR, 4, '0') END AS version FROM part")
def migration_names(t: Tables) -> DataFrame:
    from graphloom.functions import text

    k, s = F.col("p_partkey"), F.col("p_size")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    name = F.when(s % 4 == 0, F.concat(F.lit("202401010000"), pad(k % 60, 2), F.lit("_add.rb"))).when(s % 4 == 1, F.concat(F.lit("V"), (k % 9).cast("string"), F.lit("_"), (s % 7).cast("string"), F.lit("__x.sql"))).when(s % 4 == 2, F.concat(pad(k % 1000, 4), F.lit("_auto.py"))).otherwise("readme.md")
    return t.part.select(k.alias("id"), text.migration_version(name).alias("version"))


@query("humanised_age", ", a AS (SELECT event_id, floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - ts))::BIGINT AS s, extract('hour' FROM ts) AS h FROM events) SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age, h >= 22 OR h < 6 AS muted FROM a")
def humanised_age(t: Tables) -> DataFrame:
    from graphloom.functions import text

    s = F.floor((F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6)
    return t.events.select("event_id", text.humanised(s).alias("age"), text.muted(F.col("ts"), 22, 6).alias("muted"))


@query("significant_figures", "SELECT o_orderkey AS id, CASE WHEN x = 0 THEN 0.0 ELSE round(x / 10 ^ floor(log10(abs(x))), 2) * 10 ^ floor(log10(abs(x))) END AS value FROM (SELECT o_orderkey, o_totalprice / 1e7 AS x FROM orders) y")
def significant_figures(t: Tables) -> DataFrame:
    from graphloom.operators import rank

    return t.orders.select(F.col("o_orderkey").alias("id"), rank.significant(F.col("o_totalprice") / 1e7, 3).alias("value"))


@query("health_history", "SELECT day, round(100 - 20.0 * e / n, 6) AS health, round(100 - 20.0 * e / n - lag(100 - 20.0 * e / n) OVER (ORDER BY day), 6) AS delta FROM (SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1) x ORDER BY day DESC LIMIT 30")
def health_history(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    daily = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))  # a row per day
    h = 100 - 20.0 * F.col("e") / F.col("n")
    return daily.select("day", F.round(h, 6).alias("health"), F.round(h - F.lag(h).over(Window.orderBy("day")), 6).alias("delta")).orderBy(F.desc("day")).limit(30)


@query("overlay_staleness", "SELECT 'r' || user_id AS repo FROM events WHERE user_id % 3 <> 0 GROUP BY user_id HAVING max(event_id) <> max(CASE WHEN value < 60 THEN event_id END) OR count(*) FILTER (value < 60) = 0")
def overlay_staleness(t: Tables) -> DataFrame:
    from graphloom.streaming import incremental

    repo = F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("repo")
    stored = t.events.where("user_id % 3 <> 0").groupBy(repo).agg(F.max("event_id").alias("version"))
    current = t.events.where("value < 60").groupBy(repo).agg(F.max("event_id").alias("version"))
    return incremental.stale(stored, current)
