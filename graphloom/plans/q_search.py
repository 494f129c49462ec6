"""Queries on tokenizers, search, quality measures, functions, time and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import flow, loops, name_index, quality, search
from graphloom.plans.projection import FN, Tables
from graphloom.plans.registry import query
from graphloom.schema import entity_id
from graphloom.streaming import debounce, incremental, windows

# A camel-cased name for each part: "small ring" 12 -> smallRing12Part
_CAMEL_SQL = "split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) || p_size || 'Part'"


def _camel() -> F.Column:
    return F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2))), F.col("p_size").cast("string"), F.lit("Part"))


_SPLIT = f"regexp_replace(regexp_replace(regexp_replace({_CAMEL_SQL}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Za-z])([0-9])', '\\1_\\2', 'g'), '([0-9])([A-Za-z])', '\\1_\\2', 'g')"


@query("split_camel", f"SELECT p_partkey AS id, replace({_SPLIT}, '_', '|') AS words FROM part")
def split_camel(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(text.split_camel(_camel()), "|").alias("words"))


@query("tokenize", f"SELECT p_partkey AS id, array_to_string(list_filter(string_split(lower({_SPLIT}), '_'), lambda x: length(x) > 1 AND x NOT IN ('new', 'test', 'main', 'id')), '|') AS tokens FROM part")
def tokenize(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(text.name_tokens(_camel()), "|").alias("tokens"))


@query("tokenize_identifier", f"SELECT p_partkey AS id, lower({_CAMEL_SQL}) || '|' || replace(lower(regexp_replace({_CAMEL_SQL}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_', '|') AS tokens FROM part")
def tokenize_identifier(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(text.search_tokens(_camel()), "|").alias("tokens"))


@query("name_tokens", "SELECT p_partkey AS id, array_to_string(list_distinct([lower(p_name)]), '') AS whole, len(string_split(p_name, ' '))::INT AS parts FROM part")
def name_tokens(t: Tables) -> DataFrame:
    tokens = text.prefix_tokens(F.col("p_name"))
    return t.part.select(F.col("p_partkey").alias("id"), F.element_at(tokens, 1).alias("whole"), (F.size(tokens) - 1).alias("parts"))


@query("normalize_field_name", "SELECT s_suppkey AS id, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS name FROM supplier")
def normalize_field_name(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("id"), text.field_name(F.col("s_name")).alias("name"))


@query("canonical_key", f"SELECT p_partkey AS id, lower(regexp_replace(regexp_replace({_CAMEL_SQL}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Za-z])([0-9])', '\\1_\\2', 'g')) AS key FROM part")
def canonical_key(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), text.canonical_key(_camel()).alias("key"))


@query("levenshtein", "SELECT a.n_name AS a, b.r_name AS b, levenshtein(a.n_name, b.r_name) AS d, round(1 - levenshtein(a.n_name, b.r_name) / greatest(length(a.n_name), length(b.r_name), 1), 6) AS s FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey")
def levenshtein(t: Tables) -> DataFrame:
    both = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("n_name").alias("a"), F.col("r_name").alias("b"), F.levenshtein("n_name", "r_name").alias("d"), F.round(text.similar(F.col("n_name"), F.col("r_name")), 6).alias("s"))


@query("escapes", "SELECT doc_id, length(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS xml, length(replace(replace(replace(text, '\\', '\\\\'), '''', '\\'''), chr(10), '\\n')) AS cypher FROM documents")
def escapes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length(text.escape_xml(F.col("text"))).alias("xml"), F.length(text.escape_cypher(F.col("text"))).alias("cypher"))


@query("paths_and_lists", "SELECT DISTINCT source_file, regexp_extract(source_file, '([^/]*)$', 1) AS base, regexp_extract(source_file, '\\.([^./]+)$', 1) AS ext, CASE WHEN length(source_file) > 12 THEN substr(source_file, 1, 11) || '…' ELSE source_file END AS short, replace(source_file, '/', ',') AS csv FROM fn")
def paths_and_lists(t: Tables) -> DataFrame:
    p = F.col("source_file")
    back = text.normal_path(F.concat(F.lit(".\\"), F.translate(p, "/", "\\")))
    return t.fn.select(p, text.base_name(back).alias("base"), text.extension(back).alias("ext"), text.truncated(back, 12).alias("short"), F.array_join(text.csv_list(F.translate(back, "/", ",")), ",").alias("csv")).distinct()


@query("anonymise", "SELECT c_custkey AS id, substr(sha256('salt' || c_name), 1, 12) AS name FROM customer")
def anonymise(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), text.scrubbed(F.col("c_name"), "salt").alias("name"))


@query("entity_ids", "SELECT id, substr(sha256(repo || chr(0) || kind || chr(0) || name || chr(0) || source_file), 1, 16) AS hash FROM ent")
def entity_ids(t: Tables) -> DataFrame:
    return t.ent.select("id", entity_id(F.col("repo"), F.col("kind"), F.col("name"), F.col("source_file")).alias("hash"))


@query("license_compat", """
, n AS (SELECT p_partkey AS id, ['MIT', ' Apache 2.0 ', 'GPLv3', 'lgpl', 'ISC', 'no license', 'MPL-2.0'][p_size % 7 + 1] AS name FROM part),
s AS (SELECT id, CASE lower(trim(name)) WHEN 'mit' THEN 'MIT' WHEN 'apache 2.0' THEN 'Apache-2.0' WHEN 'gplv3' THEN 'GPL-3.0' WHEN 'lgpl' THEN 'LGPL-3.0' WHEN 'isc' THEN 'ISC' WHEN 'mpl-2.0' THEN 'MPL-2.0' END AS spdx FROM n)
SELECT id, spdx, CASE WHEN spdx LIKE 'GPL%' THEN 'error' WHEN spdx LIKE 'LGPL%' OR spdx LIKE 'MPL%' THEN 'warn' WHEN spdx IS NOT NULL THEN 'info' ELSE 'unknown' END AS severity FROM s""")
def license_compat(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("MIT", " Apache 2.0 ", "GPLv3", "lgpl", "ISC", "no license", "MPL-2.0")])
    rows = t.part.select(F.col("p_partkey").alias("id"), text.spdx(F.element_at(names, (F.col("p_size") % 7 + 1).cast("int"))).alias("spdx"))
    return rows.select("id", "spdx", text.license_severity(F.col("spdx")).alias("severity"))


@query("embed_text", """
SELECT doc_id, CASE WHEN strlen(w) <= 1200 THEN w ELSE w[1:list_max(list_filter(range(300, 1201), lambda k: strlen(w[1:k]) <= 1200))] END AS chunk
FROM (SELECT doc_id, concat_ws(chr(10), lang, source, text) AS w FROM documents) x""")
def embed_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.embed_text(F.col("lang"), F.col("source"), F.col("text")).alias("chunk"))


_TERMS = ["the", "thing", "and", "the", "whst"]
_BM25 = """, d AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS terms FROM documents), l AS (SELECT id, len(terms) AS len, terms FROM d), s AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
q(term, times) AS (VALUES ('the', 2), ('thing', 1), ('and', 1), ('whst', 1)), tf AS (SELECT id, len, q.term, times, len(list_filter(terms, lambda x: x = q.term)) AS tf FROM l, q), f AS (SELECT * FROM tf WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
b AS (SELECT id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM f JOIN df USING (term), s GROUP BY id)"""


def _bm25(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("id"), search.words_of(F.coalesce("text", F.lit(""))).alias("terms"))
    folder = t.kept("document_postings", "{documents}", lambda to: search.write_postings(rows, to))
    return search.bm25_terms(*search.read_index(t.spark, folder), _TERMS)


@query("bm25_search", f"{_BM25} SELECT id, round(score, 6) AS score FROM b ORDER BY round(score, 6) DESC, id LIMIT 50")
def bm25_search(t: Tables) -> DataFrame:
    return search.top_scores(_bm25(t), 50)


_COS = ", v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), qv AS (SELECT e AS qe FROM v WHERE id = 0), c AS (SELECT id, round(list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))), 6) AS score FROM v, qv)"


def _semantic(t: Tables, k: int) -> DataFrame:
    q = t.embeddings.where("vec_id = 0").select("embedding").first()[0]
    return search.semantic(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), q, k)


@query("semantic_search", f"{_COS} SELECT id, score FROM c ORDER BY score DESC, id LIMIT 50")
def semantic_search(t: Tables) -> DataFrame:
    return _semantic(t, 50)


_RRF = f"{_BM25}{_COS}, r1 AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS r FROM b ORDER BY r LIMIT 50), r2 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM c ORDER BY r LIMIT 50), z AS (SELECT coalesce(r1.id, r2.id) AS id, round(coalesce(1.0::DOUBLE / (60 + r1.r), 0) + coalesce(1.0::DOUBLE / (60 + r2.r), 0), 8) AS score, CASE WHEN r1.id IS NOT NULL AND r2.id IS NOT NULL THEN 'bm25+semantic' WHEN r1.id IS NOT NULL THEN 'bm25' ELSE 'semantic' END AS source FROM r1 FULL JOIN r2 ON r1.id = r2.id)"


@query("rrf_fusion", f"{_RRF} SELECT * FROM z")
def rrf_fusion(t: Tables) -> DataFrame:
    return search.fuse(search.top_scores(_bm25(t), 50), _semantic(t, 50))


@query("find", f"{_RRF} SELECT id, round(score * 30, 6) AS score, false AS low_confidence FROM z WHERE round(score * 30, 6) >= 0.35")
def find(t: Tables) -> DataFrame:
    fused = rrf_fusion(t).select("id", F.round(F.col("score") * 30, 6).alias("score"))
    return search.floored(fused, 0.35)


@query("min_score_fallback", f"{_RRF} SELECT id, score, true AS low_confidence FROM z ORDER BY score DESC, id LIMIT 1")
def min_score_fallback(t: Tables) -> DataFrame:
    return search.floored(rrf_fusion(t).select("id", "score"), 0.9)


def _names(t: Tables) -> str:
    """The name index of all functions, written once."""
    return t.kept("name_index", FN, lambda to: name_index.write(t.fn, to))


@query("search_entities", "SELECT id, name FROM fn WHERE contains(lower(name), 'ring_1')")
def search_entities(t: Tables) -> DataFrame:
    return name_index.containing(t.spark, _names(t), "ring_1")


@query("prefix_search", "SELECT id, name, score FROM (SELECT id, name, CASE WHEN lower(name) = 'red' THEN 3 WHEN starts_with(lower(name), 'red') THEN 2 WHEN contains(lower(name), 'red') THEN 1 END AS score FROM fn) x WHERE score IS NOT NULL ORDER BY score DESC, name, id LIMIT 40")
def prefix_search(t: Tables) -> DataFrame:
    return name_index.search(t.spark, _names(t), "red", 40)


@query("prefix_search_mid_name", "SELECT id, name, score FROM (SELECT id, name, CASE WHEN lower(name) = 'ing_17' THEN 3 WHEN starts_with(lower(name), 'ing_17') THEN 2 WHEN contains(lower(name), 'ing_17') THEN 1 END AS score FROM fn) x WHERE score IS NOT NULL ORDER BY score DESC, name, id LIMIT 40")
def prefix_search_mid_name(t: Tables) -> DataFrame:
    """A query that begins no name, so the second phase runs."""
    return name_index.search(t.spark, _names(t), "ING_17", 40)


@query("community_names", """, b AS (SELECT module AS community, unnest(string_split_regex(lower(regexp_replace(name || '_' || replace(qualified_name, '.', '_') || '_' || regexp_extract(source_file, '([^/]*)$', 1), '([A-Za-z])([0-9])', '\\1_\\2', 'g')), '[^a-z0-9]+')) AS token FROM fn),
f AS (SELECT community, token, count(*) AS tf FROM b WHERE length(token) > 1 AND token NOT IN ('the', 'and', 'for', 'with', 'new', 'py', 'test', 'tests', 'spec', 'specs', 'main', 'init', 'util', 'utils', 'src', 'lib', 'id') GROUP BY 1, 2), d AS (SELECT token, count(*) AS df FROM f GROUP BY 1), n AS (SELECT count(DISTINCT community) AS n FROM f),
s AS (SELECT community, token, row_number() OVER (PARTITION BY community ORDER BY round(tf * (ln((n + 1) / (df + 1)) + 1), 9) DESC, token) AS r FROM f JOIN d USING (token), n) SELECT community, string_agg(token, '-' ORDER BY r) AS name FROM s WHERE r <= 3 GROUP BY 1""")
def community_names(t: Tables) -> DataFrame:
    return search.community_names(t.fn.select(F.col("module").alias("community"), "name", "qualified_name", "source_file"))


@query("fallback_scope", "SELECT source AS repo, count(*) AS hits FROM documents WHERE contains(lower(text), 'license') GROUP BY 1 ORDER BY hits DESC, repo LIMIT 1")
def fallback_scope(t: Tables) -> DataFrame:
    return t.documents.where(F.lower("text").contains("license")).groupBy(F.col("source").alias("repo")).agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "repo").limit(1)


@query("search_metrics", f"{_BM25}, r AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM b), k AS (SELECT doc_id AS id FROM labels WHERE quality = 1), h AS (SELECT k.id, rank FROM k LEFT JOIN (SELECT * FROM r WHERE rank <= 50) r ON r.id = k.id) SELECT round(count(*) FILTER (rank <= 5) / count(*), 6) AS recall_5, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall_10, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS mrr FROM h")
def search_metrics(t: Tables) -> DataFrame:
    hits = search.top_scores(_bm25(t), 50)
    ranked = hits.select(F.lit("q").alias("query"), "id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))  # at most 50 rows
    return quality.search_metrics(ranked, t.labels.where("quality = 1").select(F.lit("q").alias("query"), F.col("doc_id").alias("id")))


@query("test_coverage", "SELECT regexp_extract(source_file, '^(.*)/[^/]*$', 1) AS directory, count(*) AS total, count(*) FILTER (id IN (SELECT to_id FROM tests)) AS covered, round(100.0 * count(*) FILTER (id IN (SELECT to_id FROM tests)) / count(*), 2) AS pct FROM fn WHERE NOT is_test GROUP BY 1")
def test_coverage(t: Tables) -> DataFrame:
    hit = t.tests.select(F.col("to_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    f = t.fn.where("not is_test").join(hit, "id", "left")
    return f.groupBy(F.regexp_extract("source_file", "^(.*)/[^/]*$", 1).alias("directory")).agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("covered"), F.round(100.0 * F.count("hit") / F.count(F.lit(1)), 2).alias("pct"))


@query("least_covered", "SELECT module, round(100.0 * count(*) FILTER (id IN (SELECT to_id FROM tests)) / count(*), 4) AS pct FROM fn WHERE NOT is_test GROUP BY 1 ORDER BY pct, module LIMIT 20")
def least_covered(t: Tables) -> DataFrame:
    hit = t.tests.select(F.col("to_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    return t.fn.where("not is_test").join(hit, "id", "left").groupBy("module").agg(F.round(100.0 * F.count("hit") / F.count(F.lit(1)), 4).alias("pct")).orderBy("pct", "module").limit(20)


@query("effectiveness", "SELECT module, CASE WHEN size % 7 = 0 THEN 'not_measured' ELSE CASE WHEN id IN (SELECT to_id FROM tests) THEN 'reached_' ELSE 'orphan_' END || CASE WHEN size % 5 = 0 THEN 'no_coverage' WHEN size % 11 * 10 <= 0 THEN 'no_lines' WHEN size % 11 * 10 < 50 THEN 'low' ELSE 'covered' END END AS quadrant, count(*) AS n FROM fn GROUP BY ROLLUP (module, quadrant) HAVING NOT (module IS NOT NULL AND quadrant IS NULL)")
def effectiveness(t: Tables) -> DataFrame:
    hit = t.tests.select(F.col("to_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    reach = F.when(F.col("size") % 7 != 0, F.coalesce("hit", F.lit(False)))
    pct = F.when(F.col("size") % 5 != 0, F.col("size") % 11 * 10)
    rows = t.fn.join(hit, "id", "left").select("module", quality.effectiveness(reach, pct).alias("quadrant"))
    return rows.rollup("module", "quadrant").agg(F.count(F.lit(1)).alias("n")).where("not (module is not null and quadrant is null)")


@query("composite_health", "SELECT event_type, h AS health, CASE WHEN h >= 90 THEN 'A' WHEN h >= 75 THEN 'B' WHEN h >= 60 THEN 'C' WHEN h >= 45 THEN 'D' ELSE 'F' END AS grade, round(greatest(0, least(100, 100 - o - b)), 6) AS simple FROM (SELECT event_type, o, b, round(greatest(0, least(100, 100 - (0.3 * o + 0.5 * b + 0.2 * m))), 1) AS h FROM (SELECT event_type, round(100.0 * count(*) FILTER (value < 10) / count(*), 3) AS o, round(100.0 * count(*) FILTER (value > 60) / count(*), 3) AS b, round(100.0 * count(*) FILTER (user_id % 2 = 0) / count(*), 3) AS m FROM events GROUP BY 1) x) y")
def composite_health(t: Tables) -> DataFrame:
    pct = lambda c: F.round(100.0 * F.count_if(c) / F.count(F.lit(1)), 3)
    g = t.events.groupBy("event_type").agg(pct(F.col("value") < 10).alias("o"), pct(F.col("value") > 60).alias("b"), pct(F.col("user_id") % 2 == 0).alias("m"))
    h = quality.composite(F.col("o"), F.col("b"), F.col("m"))
    return g.select("event_type", h.alias("health"), quality.grade(h).alias("grade"), F.round(quality.simple_health(F.col("o"), F.col("b")), 6).alias("simple"))


@query("fidelity_band", "SELECT source, CASE WHEN 1 - b >= 0.97 THEN 'healthy' WHEN 1 - b >= 0.9 THEN 'warning' ELSE 'critical' END AS band FROM (SELECT source, avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END) AS b FROM labels JOIN documents USING (doc_id) GROUP BY 1) x")
def fidelity_band(t: Tables) -> DataFrame:
    g = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg(F.when(F.col("quality") == 0, 1.0).otherwise(0.0)).alias("b"))
    return g.select("source", quality.fidelity(F.col("b")).alias("band"))


@query("latency_percentiles", ", x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (r = floor((n - 1) * 50 / 100) + 1) AS p50, max(value) FILTER (r = floor((n - 1) * 95 / 100) + 1) AS p95, max(value) FILTER (r = floor((n - 1) * 99 / 100) + 1) AS p99 FROM x GROUP BY 1")
def latency_percentiles(t: Tables) -> DataFrame:
    return quality.nearest_rank(t.events, "event_type", "value")


@query("reservoir_sample", "SELECT event_id FROM events ORDER BY md5(event_id::VARCHAR), event_id LIMIT 100")
def reservoir_sample(t: Tables) -> DataFrame:
    return quality.reservoir(t.events, "event_id", 100).select("event_id")


@query("token_saving", "SELECT round(sum(a) / sum(b), 6) AS ratio, count(*) AS rows FROM (SELECT doc_id, n_chars // 4 AS a, doc_id % 50 AS b FROM documents) x WHERE a > 0 AND b > 0")
def token_saving(t: Tables) -> DataFrame:
    return quality.saving(t.documents.select(F.floor(F.col("n_chars") / 4).alias("file_tokens"), (F.col("doc_id") % 50).alias("graph_tokens")))


@query("cost_estimate", ", k(kind, per) AS (VALUES ('SCOPE.Operation', 500), ('SCOPE.Component', 800)) SELECT kind, n AS entities, n * (coalesce(per, 300) + 200) AS tokens, round(n * (coalesce(per, 300) + 200) * 6.6 / 1e6, 6) AS usd FROM (SELECT kind, count(*) AS n FROM ent GROUP BY 1) e LEFT JOIN k USING (kind)")
def cost_estimate(t: Tables) -> DataFrame:
    return quality.cost(t.ent, t.spark.createDataFrame([("SCOPE.Operation", 500), ("SCOPE.Component", 800)], "kind string, per int"))


@query("effect_union", """
, b AS (SELECT user_id, event_type, max(value) AS c FROM events GROUP BY 1, 2)
SELECT user_id AS id, max(c) AS confidence, string_agg(event_type || '=' || printf('%.2f', c), ',' ORDER BY event_type) AS effects FROM b GROUP BY 1""")
def effect_union(t: Tables) -> DataFrame:
    return flow.effect_union(t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("effect"), F.col("value").alias("confidence")))


@query("n_plus_one", "SELECT l_orderkey AS o_orderkey, l_partkey AS part, count(*) AS n FROM lineitem WHERE l_quantity > 5 GROUP BY 1, 2 HAVING count(*) > 1")
def n_plus_one(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity > 5").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("perf_budgets", "SELECT event_type, m AS value, CASE WHEN (m - 12) / 12 <= 0 THEN 'green' WHEN (m - 12) / 12 <= 0.1 THEN 'yellow' ELSE 'red' END AS status, CASE WHEN (12 - m) / 12 <= 0 THEN 'green' WHEN (12 - m) / 12 <= 0.1 THEN 'yellow' ELSE 'red' END AS inverted FROM (SELECT event_type, round(median(value), 6) AS m FROM events GROUP BY 1) x")
def perf_budgets(t: Tables) -> DataFrame:
    m = t.events.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("value"))
    return m.select("event_type", "value", quality.budget(F.col("value"), F.lit(12.0), F.lit(False)).alias("status"), quality.budget(F.col("value"), F.lit(12.0), F.lit(True)).alias("inverted"))


@query("pattern_decay", "SELECT o_orderkey AS id, round(greatest(0.2, 0.4 + 0.1 * (o_orderkey % 6) - 0.05 * floor(date_diff('day', o_orderdate, TIMESTAMP '2001-09-01') / 30)), 6) AS confidence FROM orders")
def pattern_decay(t: Tables) -> DataFrame:
    c = 0.4 + 0.1 * (F.col("o_orderkey") % 6)
    return t.orders.select(F.col("o_orderkey").alias("id"), F.round(quality.time_decayed(c, F.datediff(F.lit("2001-09-01").cast("date"), "o_orderdate")), 6).alias("confidence"))


@query("complexity", "SELECT doc_id, 1 + len(regexp_extract_all(text, '\\b(if|elif|for|while|case|catch|except|and|or)\\b|&&|\\|\\|')) AS complexity FROM documents")
def complexity(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", quality.complexity(F.col("text")).alias("complexity"))


@query("stub_detection", "SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN 'unresolved' WHEN p_size % 2 = 0 AND p_partkey % 2 = 0 THEN 'thin' WHEN p_size % 2 <> p_partkey % 2 THEN 'likely_stub' ELSE 'implemented' END AS verdict FROM part")
def stub_detection(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), quality.stub_verdict(F.col("p_size") % 2 == 0, F.col("p_partkey") % 2 == 0, F.col("p_size") % 7 != 0).alias("verdict"))


@query("tautology", "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_returnflag = l_linestatus THEN 'self_compare' ELSE NULL END AS reason FROM lineitem WHERE l_quantity > 48")
def tautology(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity > 48").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), quality.tautology(F.col("l_returnflag"), F.col("l_linestatus")).alias("reason"))


@query("coverage_freshness", "SELECT user_id, CASE WHEN max(ts) >= TIMESTAMP '2024-01-29 00:00:00' THEN 'FRESH' ELSE 'STALE' END AS state, date_diff('day', max(ts)::DATE, DATE '2024-01-31') AS days FROM events GROUP BY 1")
def coverage_freshness(t: Tables) -> DataFrame:
    last = F.max("ts")
    return t.events.groupBy("user_id").agg(F.when(last >= F.lit("2024-01-29").cast("timestamp"), "FRESH").otherwise("STALE").alias("state"), F.datediff(F.lit("2024-01-31").cast("date"), last).alias("days"))


@query("moving_max", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS peak, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def moving_max(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("peak"), F.lag("value").over(w).alias("before"))


@query("first_wins", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_wins(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return t.events.withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "event_type", "event_id")


@query("tiering", "SELECT user_id, CASE WHEN user_id % 10 = 0 OR h < 1 THEN 'HOT' WHEN h < 24 THEN 'WARM' WHEN h < 720 THEN 'COLD' ELSE 'EXPIRED' END AS tier FROM (SELECT user_id, epoch(TIMESTAMP '2024-01-31 00:00:00' - max(ts)) / 3600 AS h FROM events GROUP BY 1) x")
def tiering(t: Tables) -> DataFrame:
    idle = (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.max(F.col("ts").cast("timestamp")))) / 3.6e9
    return t.events.groupBy("user_id").agg(incremental.tier(idle, F.col("user_id") % 10 == 0).alias("tier"))


@query("incremental_merge", "SELECT id, source_file, start_line FROM fn WHERE module NOT IN ('Brand#1', 'Brand#2') AND key % 17 <> 0 UNION ALL SELECT id, source_file, start_line + 1 FROM fn WHERE key % 17 = 0")
def incremental_merge(t: Tables) -> DataFrame:
    old = t.fn.select("id", F.col("module").alias("source_file"), "start_line", F.col("source_file").alias("real"))
    changed = t.spark.createDataFrame([("Brand#1",), ("Brand#2",)], "source_file string")
    new = t.fn.where("key % 17 = 0").select("id", F.col("module").alias("source_file"), (F.col("start_line") + 1).alias("start_line"), F.col("source_file").alias("real"))
    return incremental.merge_entities(old, new, changed).select("id", F.col("real").alias("source_file"), "start_line")


@query("incremental_flows", "SELECT count(*) AS n, count(*) FILTER (kind IN ('CALLS', 'CONTAINS')) > 0 AS affected FROM rel")
def incremental_flows(t: Tables) -> DataFrame:
    return t.rel.agg(F.count(F.lit(1)).alias("n")).withColumn("affected", F.lit(incremental.flows_affected(t.rel)))


@query("tumbling_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_window(t: Tables) -> DataFrame:
    return windows.tumbling(t.events, "1 day")


@query("sliding_window", "SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) - i * INTERVAL 6 HOUR AS w FROM events, (VALUES (0), (1)) s(i)) x GROUP BY 1, 2")
def sliding_window(t: Tables) -> DataFrame:
    return windows.sliding(t.events, "12 hours", "6 hours")


@query("session_window", ", g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k")
def session_window(t: Tables) -> DataFrame:
    return windows.sessions(t.events, "4 hours")


@query("stream_dedup", "SELECT DISTINCT event_id FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    return windows.deduplicated(t.events.union(t.events.where("event_id % 3 = 0"))).select("event_id")


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(t: Tables) -> DataFrame:
    """The same windows, from a stream of files drained in complete mode."""
    name = f"tumbling_{uuid.uuid4().hex}"
    folder = loops.shared_folder(t.spark)
    stream = windows.event_stream(t.spark, f"{t.sf_dir}/events.parque[t]")
    windows.run_once(windows.tumbling(stream, "1 day"), name, f"{folder}/{name}", "complete")
    return t.spark.table(name)


@query("debounce")
def debounced(t: Tables) -> DataFrame:
    return debounce.batch(t.events, 4 * 3600_000, 12 * 3600_000)


@query("effect_vocabulary", """
, s AS (SELECT ['db_read', 'db_write', 'http_out'][size % 3 + 1] AS effect, count(*) AS n FROM fn WHERE kind = 'SCOPE.Component' GROUP BY 1)
SELECT v.effect, coalesce(n, 0) AS functions FROM (SELECT unnest(['db_read', 'db_write', 'http_out', 'fs_read', 'fs_write', 'mutation', 'env_read']) AS effect) v LEFT JOIN s USING (effect)""")
def effect_vocabulary(t: Tables) -> DataFrame:
    """Every effect of the lattice with the functions that have it of themselves."""
    seeded = F.element_at(F.array(*map(F.lit, flow.EFFECTS[:3])), (F.col("size") % 3 + 1).cast("int"))
    own = t.fn.where("kind = 'SCOPE.Component'").groupBy(seeded.alias("effect")).agg(F.count(F.lit(1)).alias("n"))
    known = t.fn.limit(1).select(F.explode(F.array(*map(F.lit, flow.EFFECTS))).alias("effect")).distinct()
    return known.join(own, "effect", "left").select("effect", F.coalesce("n", F.lit(0)).alias("functions"))
