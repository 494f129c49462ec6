"""Queries on search indexes, callers, orientation, processes and the rules that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import diff, flow, groups, link, quality, rank, relational, search
from graphloom.plans.projection import FN, Tables
from graphloom.plans.q_graph import _BC
from graphloom.plans.registry import query

_QUERY = "steel_ring_17 ring steel brand1"

#: Names here are letters, digits and underscores, so a name's search tokens are itself and its parts.
_POSTINGS = """
, d AS (SELECT id, list_filter(list_concat(
    CASE WHEN contains(name, '_') THEN list_concat([lower(name)], string_split(lower(name), '_')) ELSE [lower(name)] END,
    list_concat(CASE WHEN is_test THEN ['testedkind', 'tested', 'kind', 'promo'] ELSE [] END, [lower(replace(module, '#', ''))])), lambda x: length(x) > 1) AS terms FROM fn),
st AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM d),
po AS (SELECT id, len(terms) AS len, unnest(terms) AS term FROM d), tf AS (SELECT id, len, term, count(*) AS tf FROM po GROUP BY 1, 2, 3),
q(term, times) AS (VALUES ('steel_ring_17', 1), ('steel', 2), ('ring', 2), ('17', 1), ('brand1', 1)),
df AS (SELECT term, count(*) AS df FROM tf JOIN q USING (term) GROUP BY 1),
b AS (SELECT id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM tf JOIN q USING (term) JOIN df USING (term), st GROUP BY id)"""


def _entities(t: Tables) -> DataFrame:
    """Functions with a column of discriminators, variable=literal."""
    return t.fn.select("*", F.when(F.col("is_test"), "testedKind=promo").otherwise("").alias("discriminators"), F.replace("module", F.lit("#"), F.lit("")).alias("brand"))


def _index(t: Tables) -> str:
    """The postings of all functions, written once."""
    return t.kept("entity_postings", FN, lambda to: search.write_index(_entities(t), to, "name", "discriminators", "brand"))


def _hits(t: Tables) -> DataFrame:
    return search.bm25_postings(*search.read_index(t.spark, _index(t)), _QUERY)


@query("bm25_entities", f"{_POSTINGS} SELECT id, round(score, 6) AS score FROM b")
def bm25_entities(t: Tables) -> DataFrame:
    return _hits(t).select("id", F.round("score", 6).alias("score"))


@query("find_entities", f"""{_POSTINGS}, tn AS (SELECT id, name, CASE WHEN start_line > 0 THEN 0 ELSE 1 END AS tier FROM fn),
h AS (SELECT id, round(score, 6) AS score FROM b ORDER BY round(score, 6) DESC, id LIMIT 50), g AS (SELECT * FROM h WHERE score >= 4),
x AS (SELECT from_id AS a, to_id AS b FROM calls UNION SELECT to_id, from_id FROM calls), nb AS (SELECT DISTINCT x.b AS id FROM g JOIN x ON x.a = g.id WHERE x.b NOT IN (SELECT id FROM g)),
z AS (SELECT id, score, 0 AS depth FROM g UNION ALL SELECT id, 0.0, 1 FROM nb),
o AS (SELECT z.id, z.score, z.depth, sum(greatest(1, ceil(length(name) / 4.0))) OVER (ORDER BY depth, tier, z.score DESC, z.id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM z JOIN tn USING (id))
SELECT id, score::DOUBLE AS score, depth, false AS low_confidence, used FROM o WHERE used <= 300""")
def find_entities(t: Tables) -> DataFrame:
    e = t.fn.select("id", "name", relational.rank_tier(F.lit("none"), F.col("start_line")).alias("tier"))
    return search.find(_hits(t), e, t.calls, least=4, tokens=300)


@query("find_fused", f"""{_POSTINGS}, tn AS (SELECT id, name, CASE WHEN start_line > 0 THEN 0 ELSE 1 END AS tier FROM fn),
v AS (SELECT 'f' || vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), qv AS (SELECT e AS qe FROM v WHERE id = 'f7'),
c AS (SELECT id, round(list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))), 6) AS score FROM v, qv),
r1 AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS r FROM b ORDER BY r LIMIT 50), r2 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM c ORDER BY r LIMIT 50),
h AS (SELECT coalesce(r1.id, r2.id) AS id, round(round(coalesce(1.0::DOUBLE / (60 + r1.r), 0) + coalesce(1.0::DOUBLE / (60 + r2.r), 0), 8) * 61 / 2, 6) AS score FROM r1 FULL JOIN r2 ON r1.id = r2.id),
top AS (SELECT * FROM h ORDER BY score DESC, id LIMIT 50), g AS (SELECT * FROM top WHERE score >= 0.4),
x AS (SELECT from_id AS a, to_id AS b FROM calls UNION SELECT to_id, from_id FROM calls), nb AS (SELECT DISTINCT x.b AS id FROM g JOIN x ON x.a = g.id WHERE x.b NOT IN (SELECT id FROM g)),
z AS (SELECT id, score, 0 AS depth FROM g UNION ALL SELECT id, 0.0, 1 FROM nb),
o AS (SELECT z.id, z.score, z.depth, sum(greatest(1, ceil(length(name) / 4.0))) OVER (ORDER BY depth, tier, z.score DESC, z.id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM z JOIN tn USING (id))
SELECT id, score::DOUBLE AS score, depth, false AS low_confidence, used FROM o WHERE used <= 500""")
def find_fused(t: Tables) -> DataFrame:
    """Words and vectors, fused, floored, expanded along calls and cut to a budget, from the stored index and graph."""
    vectors = t.embeddings.select(F.concat(F.lit("f"), "vec_id").alias("id"), "embedding")
    asked = vectors.where("id = 'f7'").select("embedding").first()[0]
    e = t.fn.select("id", "name", relational.rank_tier(F.lit("none"), F.col("start_line")).alias("tier"))
    return search.find_fused(_index(t), vectors, e, t.calls, _QUERY, asked, least=0.4, tokens=500)


@query("find_nothing", f"""{_POSTINGS}, h AS (SELECT id, round(score, 6) AS score FROM b ORDER BY round(score, 6) DESC, id LIMIT 1)
SELECT id, score, 0 AS depth, true AS low_confidence, greatest(1, ceil(length(name) / 4.0))::BIGINT AS used FROM h JOIN fn USING (id)""")
def find_nothing(t: Tables) -> DataFrame:
    """A floor that no hit reaches: the best one alone, marked, and no neighbours."""
    e = t.fn.select("id", "name", relational.rank_tier(F.lit("none"), F.col("start_line")).alias("tier"))
    return search.find(_hits(t), e, t.calls, least=1000)


@query("find_callers", """
, q AS (SELECT DISTINCT CASE key % 3 WHEN 0 THEN upper(name) WHEN 1 THEN id ELSE upper(label) END AS query FROM fn),
h AS (SELECT query, 1 AS tier, id FROM q JOIN fn ON id = query UNION SELECT query, 3, id FROM q JOIN fn ON lower(label) = lower(query)
  UNION SELECT query, 4, id FROM q JOIN fn ON lower(name) = lower(query)),
b AS (SELECT query, min(tier) AS tier FROM h GROUP BY 1), m AS (SELECT query, count(DISTINCT id) AS n, min(id) AS id FROM h JOIN b USING (query, tier) GROUP BY 1)
SELECT DISTINCT query, 'caller' AS status, from_id AS id FROM m JOIN calls ON to_id = m.id WHERE n = 1 UNION ALL SELECT query, 'ambiguous', NULL FROM m WHERE n > 1""")
def find_callers(t: Tables) -> DataFrame:
    k = F.col("key") % 3
    queries = t.fn.select(F.when(k == 0, F.upper("name")).when(k == 1, F.col("id")).otherwise(F.upper("label")).alias("query"))
    return link.find_callers(queries, t.fn.select("id", "qualified_name", F.col("label").alias("name")), t.calls)


@query("module_prebaked", """
SELECT c_mktsegment AS from_module, n_name AS to_module, sum(1 + c_custkey % 7)::BIGINT AS weight FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name <> '_external' GROUP BY 1, 2""")
def module_prebaked(t: Tables) -> DataFrame:
    stored = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("from_module"), F.col("n_name").alias("to_module"), (1 + F.col("c_custkey") % 7).alias("weight"))
    return relational.module_edges(t.calls, t.fn.select("id", "module"), stored)


@query("module_table", """
, m AS (SELECT DISTINCT a.module AS a, b.module AS b FROM tests JOIN fn a ON a.id = from_id JOIN fn b ON b.id = to_id WHERE a.module <> b.module),
r(a, b) AS (SELECT a, b FROM m UNION SELECT r.a, m.b FROM r JOIN m ON m.a = r.b),
s AS (SELECT x.a AS id, least(x.a, min(x.b)) AS c FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.a)
SELECT n.module, (SELECT count(*) FROM m WHERE b = n.module) AS in_degree, (SELECT count(*) FROM m WHERE a = n.module) AS out_degree, coalesce(s.c, '-1') AS cycle
FROM (SELECT DISTINCT module FROM fn) n LEFT JOIN s ON s.id = n.module""")
def module_table(t: Tables) -> DataFrame:
    pairs = relational.module_edges(t.tests, t.fn.select("id", "module"))
    edges = pairs.select(F.col("from_module").alias("from_id"), F.col("to_module").alias("to_id"))
    comp = groups.strong_components(t.fn.select(F.col("module").alias("id")).distinct(), edges)
    return relational.module_table(t.fn.select("module"), pairs, comp)


@query("key_entities", f"""{_BC.replace('SELECT n.id, round', ', bc AS (SELECT n.id, round')}),
dg AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM m UNION ALL SELECT b FROM m) y GROUP BY 1), mx AS (SELECT max(degree) AS d FROM dg), my AS (SELECT max(betweenness) AS b FROM bc)
SELECT dg.id, degree, round(degree / mx.d + CASE WHEN my.b > 0 THEN betweenness / my.b ELSE 0 END, 6) AS score FROM dg JOIN bc USING (id), mx, my WHERE degree > 0 ORDER BY score DESC, dg.id LIMIT 10""")
def key_entities(t: Tables) -> DataFrame:
    pairs = relational.module_edges(t.imports, t.fn.select("id", "module")).select(F.col("from_module").alias("from_id"), F.col("to_module").alias("to_id"))
    nodes = t.fn.select(F.col("module").alias("id")).distinct()
    bc = rank.betweenness(nodes, pairs).select("id", F.round("betweenness", 6).alias("betweenness"))
    return rank.key_entities(relational.degree(pairs).select("id", "degree").join(bc, "id"))


@query("betweenness_pivots", f"""{_BC[: _BC.index(' SELECT n.id, round')]}, pv AS (SELECT id FROM n ORDER BY id LIMIT 6)
SELECT n.id, round(coalesce(sum(share), 0) * (SELECT count(*) FROM n) / (SELECT count(*) FROM pv), 6) AS betweenness FROM n LEFT JOIN v ON v.id = n.id AND v.s IN (SELECT id FROM pv) GROUP BY n.id""")
def betweenness_pivots(t: Tables) -> DataFrame:
    pairs = relational.module_edges(t.imports, t.fn.select("id", "module")).select(F.col("from_module").alias("from_id"), F.col("to_module").alias("to_id"))
    nodes = t.fn.select(F.col("module").alias("id")).distinct()
    return rank.betweenness(nodes, pairs, sources=nodes.orderBy("id").limit(6)).select("id", F.round("betweenness", 6).alias("betweenness"))


@query("orientation_questions", """
, e AS (SELECT from_id, to_id, a.module AS ma, b.module AS mb, 0.3 + 0.1 * (a.size % 7) AS confidence FROM calls JOIN fn a ON a.id = from_id JOIN fn b ON b.id = to_id)
SELECT DISTINCT 'ambiguous_edge' AS kind, from_id AS id, to_id AS other FROM e WHERE confidence < 0.45 UNION ALL SELECT DISTINCT 'bridge', from_id, to_id FROM e WHERE ma <> mb
UNION ALL SELECT 'isolated', id, NULL FROM fn WHERE id NOT IN (SELECT from_id FROM e) AND id NOT IN (SELECT to_id FROM e)""")
def orientation_questions(t: Tables) -> DataFrame:
    edges = t.calls.join(t.fn.select(F.col("id").alias("from_id"), (0.3 + 0.1 * (F.col("size") % 7)).alias("confidence")), "from_id")
    return rank.questions(t.fn, edges, t.fn.select("id", F.col("module").alias("community")), least=0.45)


@query("process_flows", """
, im AS (SELECT f.id AS endpoint, 'f' || (f.key + 1) AS handler FROM fn f WHERE f.kind = 'http_endpoint_definition' AND f.size % 2 = 0),
s AS (SELECT id, name, CASE WHEN kind = 'http_endpoint_definition' THEN 'http' WHEN size % 10 = 1 THEN 'kafka_consumer' WHEN size % 10 = 2 THEN 'scheduled' ELSE 'function' END AS entry_kind FROM fn
  WHERE (kind = 'http_endpoint_definition' OR size % 10 < 3) AND id NOT IN (SELECT handler FROM im)),
e AS (SELECT from_id, to_id FROM calls UNION SELECT endpoint, handler FROM im),
r(path, last) AS (SELECT [id], id FROM s UNION ALL SELECT list_append(path, to_id), to_id FROM r JOIN e ON from_id = last WHERE len(path) < 4 AND NOT list_contains(path, to_id)),
w AS (SELECT path FROM r WHERE len(path) = 4 OR NOT EXISTS (SELECT 1 FROM e WHERE from_id = r.last AND NOT list_contains(r.path, to_id))),
x AS (SELECT path, unnest(path) AS id FROM w), c AS (SELECT path, count(DISTINCT repo) AS n FROM x JOIN fn USING (id) GROUP BY 1)
SELECT array_to_string(w.path, '>') AS path, len(w.path)::INT AS steps, s.name AS label, s.entry_kind, c.n > 1 AS cross_stack FROM w JOIN s ON s.id = w.path[1] JOIN c ON c.path = w.path
WHERE len(w.path) >= 3 OR (len(w.path) = 2 AND s.entry_kind = 'http')""")
def process_flows(t: Tables) -> DataFrame:
    implements = t.fn.where("kind = 'http_endpoint_definition' and size % 2 = 0").select(F.col("id").alias("endpoint"), F.concat(F.lit("f"), (F.col("key") + 1).cast("string")).alias("handler"))
    kind = F.when(F.col("kind") == "http_endpoint_definition", F.col("kind")).when(F.col("size") % 10 == 1, "SCOPE.MessageConsumer").when(F.col("size") % 10 == 2, "SCOPE.ScheduledJob").otherwise(F.col("kind"))
    entries = t.fn.where("kind = 'http_endpoint_definition' or size % 10 < 3").select("id", "name", kind.alias("kind"))
    out = flow.process_flows(entries, implements, t.calls, t.fn, most_steps=4)
    return out.withColumn("path", F.array_join("path", ">"))


@query("literal_separators", """
, k AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'left' ELSE 'right' END AS side, CASE p_size % 7 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN replace(p_name, ' ', '.') WHEN 2 THEN 'aB' || p_partkey ELSE replace(p_name, ' ', '_') END AS key FROM part),
c AS (SELECT side, key, CASE WHEN contains(key, '-') THEN '-' WHEN contains(key, '_') THEN '_' WHEN contains(key, '.') THEN '.' WHEN regexp_matches(key, '[a-z0-9][A-Z]') THEN 'camel' ELSE 'plain' END AS convention FROM k),
n AS (SELECT side, convention, count(*) AS n FROM c GROUP BY 1, 2), d AS (SELECT side, arg_min(convention, (-n, convention)) AS dominant FROM n GROUP BY 1)
SELECT side, key, convention, dominant FROM c JOIN d USING (side) WHERE convention <> dominant""")
def literal_separators(t: Tables) -> DataFrame:
    r = F.col("p_size") % 7
    with_ = lambda sep: F.replace("p_name", F.lit(" "), F.lit(sep))
    key = F.when(r == 0, with_("-")).when(r == 1, with_(".")).when(r == 2, F.concat(F.lit("aB"), F.col("p_partkey").cast("string"))).otherwise(with_("_"))
    return diff.separators(t.part.select(F.when(F.col("p_size") % 2 == 0, "left").otherwise("right").alias("side"), key.alias("key")))


@query("response_unresolved", """
, l AS (SELECT 'e' || (p_partkey // 4) AS endpoint, 200 + p_partkey % 2 AS status, bool_and(p_size % 9 > 0) AS ok FROM part WHERE p_size > 3 GROUP BY 1, 2),
r AS (SELECT 'e' || (p_partkey // 4) AS endpoint, 200 + p_partkey % 2 AS status, bool_and(p_size % 11 > 0) AS ok FROM part WHERE p_size < 48 GROUP BY 1, 2)
SELECT endpoint, status, CASE WHEN NOT l.ok AND NOT r.ok THEN 'both' WHEN NOT l.ok THEN 'left' ELSE 'right' END AS side FROM l JOIN r USING (endpoint, status) WHERE NOT (l.ok AND r.ok)""")
def response_unresolved(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    shape = lambda df, n: df.select(F.concat(F.lit("e"), F.floor(k / 4).cast("string")).alias("endpoint"), (200 + k % 2).alias("status"), (F.col("p_size") % n > 0).alias("resolved"))
    return diff.unresolved_shapes(shape(t.part.where("p_size > 3"), 9), shape(t.part.where("p_size < 48"), 11))


@query("perf_regressions", """
, m AS (SELECT event_type, avg(value) FILTER (ts < TIMESTAMP '2024-01-15 00:00:00') AS b, avg(value) FILTER (ts >= TIMESTAMP '2024-01-15 00:00:00' AND user_id < 20) AS v FROM events GROUP BY 1)
SELECT event_type, CASE WHEN b > 0 THEN CASE WHEN (v - b) / b > 0.05 THEN 'warning' ELSE 'ok' END END AS status, CASE WHEN b > 0 THEN CASE WHEN (b - v) / b > 0.05 THEN 'warning' ELSE 'ok' END END AS inverted FROM m""")
def perf_regressions(t: Tables) -> DataFrame:
    late = F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp")
    m = t.events.groupBy("event_type").agg(F.avg(F.when(~late, F.col("value"))).alias("b"), F.avg(F.when(late & (F.col("user_id") < 20), F.col("value"))).alias("v"))
    return m.select("event_type", *[quality.regressed(F.col("v"), F.col("b"), F.lit(i), 0.05).alias(n) for i, n in ((False, "status"), (True, "inverted"))])


@query("content_hashes", "SELECT doc_id, sha1(text) AS content, sha256(text[1:200]) AS source_window FROM documents")
def content_hashes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha1(F.col("text").cast("binary")).alias("content"), F.sha2(F.left("text", F.lit(200)).cast("binary"), 256).alias("source_window"))


@query("fnv_hash", """
, b AS (SELECT p_partkey AS id, list_transform(range(1, length(p_name) + 1), lambda i: ascii(p_name[i])::BIGINT) AS c FROM part)
SELECT id, list_reduce(list_concat([2166136261::BIGINT], c), lambda h, x: (xor(h, x) * 16777619) % 4294967296) AS hash FROM b""")
def fnv_hash(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), text.fnv1a(F.col("p_name")).alias("hash"))


@query("alembic_precedes", """
SELECT 'r' || (p_partkey // 2) AS from_id, 'r' || p_partkey AS to_id FROM part WHERE p_partkey > 1 AND p_partkey // 2 IN (SELECT p_partkey FROM part)""")
def alembic_precedes(t: Tables) -> DataFrame:
    name = lambda c: F.concat(F.lit("r"), c.cast("string"))
    k = F.col("p_partkey")
    return link.precedes(t.part.select(name(k).alias("revision"), F.when(k > 1, name(F.floor(k / 2))).alias("down_revision")))
