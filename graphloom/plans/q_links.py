"""Queries on links, joins and two-sided comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import diff, link, quality, relational, similarity
from graphloom.plans.projection import Tables
from graphloom.plans.registry import query

# Orders stand for client operations of their priority's repository, customers' segments for server ones; the method is the status and date's month.
_CLIENT = "SELECT 'o' || o_orderkey AS id, o_orderpriority AS repo, 'm' || (o_orderkey % 40) AS key FROM orders"
_SERVER = "SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN '1-URGENT' ELSE c_mktsegment END AS repo, 'm' || (c_custkey % 55) AS key FROM customer"


def _client(t: Tables) -> DataFrame:
    return t.sql(_CLIENT.replace("FROM orders", "FROM {orders}"))


def _server(t: Tables) -> DataFrame:
    return t.sql(_SERVER.replace("FROM customer", "FROM {customer}"))


@query("grpc_link", f", c AS ({_CLIENT}), s AS ({_SERVER}), a AS (SELECT repo, key, min(id) AS source FROM c GROUP BY 1, 2), b AS (SELECT repo, key, min(id) AS target FROM s GROUP BY 1, 2) SELECT source, target, a.key, a.repo AS source_repo, b.repo AS target_repo FROM a JOIN b ON a.key = b.key AND a.repo <> b.repo")
def grpc_link(t: Tables) -> DataFrame:
    return link.by_key(_client(t), _server(t))


@query("import_link", "SELECT DISTINCT a.repo AS source_repo, b.repo AS target_repo, i.from_id, i.to_id, 1.0::DOUBLE AS confidence FROM imports i JOIN fn a ON a.id = i.from_id JOIN fn b ON b.id = i.to_id WHERE a.repo <> b.repo")
def import_link(t: Tables) -> DataFrame:
    r = t.fn.select("id", "repo")
    both = t.imports.join(r.select(F.col("id").alias("from_id"), F.col("repo").alias("source_repo")), "from_id").join(r.select(F.col("id").alias("to_id"), F.col("repo").alias("target_repo")), "to_id")
    return both.where("source_repo <> target_repo").distinct().withColumn("confidence", F.lit(1.0))


_PATHS = "SELECT 'o' || o_orderkey AS id, o_orderpriority AS repo, CASE WHEN o_orderkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS verb, CASE o_orderkey % 4 WHEN 0 THEN '/api/v1/Items/' WHEN 1 THEN '/gateway/items/' WHEN 2 THEN '/v2/items/' ELSE '/none/' END || '{id' || (o_orderkey % 3) || '}' || CASE WHEN o_orderkey % 5 = 0 THEN '/' ELSE '/r' || (o_orderkey % 7) END AS path FROM orders"
_ROUTES = "SELECT 'c' || c_custkey AS id, c_mktsegment AS repo, CASE WHEN c_custkey % 3 = 0 THEN 'GET' ELSE 'POST' END AS verb, '/items/:key' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '/r' || (c_custkey % 9) END AS path FROM customer"
_MORE_ROUTES = "SELECT 'c' || c_custkey AS id, c_mktsegment AS repo, CASE WHEN c_custkey % 3 = 0 THEN 'GET' ELSE 'POST' END AS verb, CASE c_custkey % 6 WHEN 1 THEN '/none/:key/' || c_custkey WHEN 2 THEN '/:a/:b/q' || c_custkey WHEN 5 THEN '/items/:key/:sub/x' ELSE '/items/:key' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '/r' || (c_custkey % 9) END END AS path FROM customer"
_KEY = r"regexp_replace(regexp_replace(lower(regexp_replace(path, '\{[^}]+\}|:[a-zA-Z][a-zA-Z0-9_]*|<[^>]+>', '{*}', 'g')), '/+$', ''), '^/(?:api(?:/v[0-9]+)?|v[0-9]+)(/|$)', '\1')"


@query("endpoint_join_key", f"SELECT DISTINCT path, {_KEY} AS key FROM ({_PATHS}) x")
def endpoint_join_key(t: Tables) -> DataFrame:
    rows = t.orders.select(_order_path().alias("path"))
    return rows.select("path", text.join_path(F.col("path")).alias("key")).distinct()


def _order_path() -> F.Column:
    k = F.col("o_orderkey")
    head = F.when(k % 4 == 0, "/api/v1/Items/").when(k % 4 == 1, "/gateway/items/").when(k % 4 == 2, "/v2/items/").otherwise("/none/")
    return F.concat(head, F.lit("{id"), (k % 3).cast("string"), F.lit("}"), F.when(k % 5 == 0, F.lit("/")).otherwise(F.concat(F.lit("/r"), (k % 7).cast("string"))))


@query("http_link", f"""
, c AS (SELECT *, {_KEY} AS key FROM ({_PATHS}) x), r AS (SELECT repo, verb, {_KEY} AS key, min(id) AS target FROM ({_MORE_ROUTES}) y GROUP BY 1, 2, 3),
e AS (SELECT c.id AS source, r.target, 'exact' AS strategy, 'resolved' AS confidence FROM c JOIN r ON c.verb = r.verb AND c.key = r.key AND c.repo <> r.repo),
p AS (SELECT id, repo, verb, string_split(key, '/') AS p FROM c WHERE id NOT IN (SELECT source FROM e)),
v AS (SELECT id, repo, verb, unnest(list_transform(list_filter(range(2, len(p) + 1), lambda i: p[i] <> '{{*}}'),
  lambda i: array_to_string(list_transform(range(1, len(p) + 1), lambda j: CASE WHEN j = i THEN '{{*}}' ELSE p[j] END), '/'))) AS key FROM p),
f AS (SELECT v.id, length(r.key) AS size, min(r.target) AS target, count(DISTINCT r.target) AS n FROM v JOIN r ON v.verb = r.verb AND v.key = r.key AND v.repo <> r.repo GROUP BY 1, 2),
fl AS (SELECT id, arg_max(target, size) AS target, arg_max(n, size) AS n FROM f GROUP BY 1), fk AS (SELECT id AS source, target FROM fl WHERE n = 1),
s AS (SELECT c.id, length(r.key) AS size, min(r.target) AS target, count(DISTINCT r.target) AS n FROM c JOIN r ON c.verb = r.verb AND c.repo <> r.repo AND ends_with(c.key, r.key) AND c.key <> r.key
  WHERE c.id NOT IN (SELECT source FROM e) AND c.id NOT IN (SELECT source FROM fk) GROUP BY 1, 2),
sl AS (SELECT id, arg_max(target, size) AS target, arg_max(n, size) AS n FROM s GROUP BY 1)
SELECT * FROM e UNION ALL SELECT source, target, 'literal_param_fill', 'inferred' FROM fk UNION ALL SELECT id, target, 'dynamic_suffix_match', 'inferred' FROM sl WHERE n = 1""")
def http_link(t: Tables) -> DataFrame:
    calls = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("repo"), F.when(F.col("o_orderkey") % 2 == 0, "GET").otherwise("POST").alias("verb"), _order_path().alias("path"))
    k = F.col("c_custkey")
    route = F.when(k % 6 == 1, F.concat(F.lit("/none/:key/"), k.cast("string"))).when(k % 6 == 2, F.concat(F.lit("/:a/:b/q"), k.cast("string"))).when(k % 6 == 5, F.lit("/items/:key/:sub/x")).otherwise(F.concat(F.lit("/items/:key"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("/r"), (k % 9).cast("string")))))
    routes = t.customer.select(F.concat(F.lit("c"), k.cast("string")).alias("id"), F.col("c_mktsegment").alias("repo"), F.when(k % 3 == 0, "GET").otherwise("POST").alias("verb"), route.alias("path"))
    return link.http_links(calls, routes)


_PUB = "SELECT DISTINCT event_type || (user_id % 7) AS topic, 'r' || (user_id % 6) AS repo FROM events WHERE value > 60 AND event_type <> 'signup'"
_SUB = "SELECT DISTINCT event_type || (user_id % 5) AS topic, 'r' || (user_id % 7) AS repo FROM events WHERE value < 20"


def _topics(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.sql(_PUB.replace("FROM events", "FROM {events}")), t.sql(_SUB.replace("FROM events", "FROM {events}"))


@query("topic_link", f"SELECT DISTINCT p.topic, p.repo AS source_repo, s.repo AS target_repo FROM ({_PUB}) p JOIN ({_SUB}) s ON p.topic = s.topic AND p.repo <> s.repo")
def topic_link(t: Tables) -> DataFrame:
    return link.topic_links(*_topics(t))


@query("orphan_publishers", f"SELECT DISTINCT topic FROM ({_PUB}) p WHERE topic NOT IN (SELECT topic FROM ({_SUB}) s)")
def orphan_publishers(t: Tables) -> DataFrame:
    return link.orphans(*_topics(t))


@query("orphan_subscribers", f"SELECT DISTINCT topic FROM ({_SUB}) s WHERE topic NOT IN (SELECT topic FROM ({_PUB}) p)")
def orphan_subscribers(t: Tables) -> DataFrame:
    return link.orphans(*reversed(_topics(t)))


@query("orphan_callers", f"""
, c AS (SELECT *, {_KEY} AS key, CASE id[-1:] WHEN '1' THEN '${{BASE}}' || path WHEN '2' THEN path || '/${{x}}' ELSE replace(replace(path, '{{', ''), '}}', '') END AS url FROM ({_PATHS}) x),
r AS (SELECT DISTINCT {_KEY} AS key FROM ({_ROUTES}) y WHERE NOT ends_with(path, '/r1'))
SELECT DISTINCT id AS caller, url, verb AS method,
  CASE WHEN starts_with(url, '${{') THEN 'dynamic_baseurl' WHEN contains(url, '${{') OR instr(url, '{{') > 2 THEN 'template_literal' ELSE 'no_handler_found' END AS reason FROM c WHERE key NOT IN (SELECT key FROM r)""")
def orphan_callers(t: Tables) -> DataFrame:
    path = _order_path()
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    url = F.when(k % 10 == 1, F.concat(F.lit("${BASE}"), path)).when(k % 10 == 2, F.concat(path, F.lit("/${x}"))).otherwise(F.translate(path, "{}", ""))
    fetches = t.orders.select(F.concat(F.lit("o"), k.cast("string")).alias("caller"), url.alias("url"), F.when(k % 2 == 1, "POST").alias("method"), text.join_path(path).alias("key"))
    route = F.concat(F.lit("/items/:key"), F.when(c % 4 == 0, "").otherwise(F.concat(F.lit("/r"), (c % 9).cast("string"))))
    endpoints = t.customer.select(text.join_path(route).alias("key"), F.when(route.endswith("/r1"), "consumer").otherwise("producer").alias("side"))
    return link.orphan_callers(fetches, endpoints)


@query("dependency_usage", """
, d AS (SELECT DISTINCT split_part(lower(p_name), ' ', 1) AS name FROM part WHERE p_size > 10 UNION SELECT 'nothing'),
i AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN split_part(lower(p_name), ' ', 2) || '/' || p_size WHEN 1 THEN split_part(lower(p_name), ' ', 1) || '/sub/' || p_size
  WHEN 2 THEN 'scope:component:import:external:' || split_part(lower(p_name), ' ', 2) || 'x' || (p_size % 3) ELSE 'scope:component:import:external:' || split_part(lower(p_name), ' ', 1) END AS target FROM part),
u AS (SELECT target, name FROM i JOIN d ON target = name OR starts_with(target, name || '/') OR ends_with(target, ':' || name))
SELECT name, CASE WHEN name IN (SELECT name FROM u) THEN 'used' ELSE 'unused' END AS status FROM d
UNION ALL SELECT DISTINCT split_part(target, ':', -1), 'phantom' FROM i WHERE starts_with(target, 'scope:') AND target NOT IN (SELECT target FROM u)""")
def dependency_usage(t: Tables) -> DataFrame:
    first, second = (F.split_part(F.lower("p_name"), F.lit(" "), F.lit(i)) for i in (1, 2))
    size, k = F.col("p_size").cast("string"), F.col("p_size") % 4
    declared = t.part.where("p_size > 10").select(first.alias("name")).union(t.spark.createDataFrame([("nothing",)], "name string")).distinct()
    external = F.lit(link.EXTERNAL)
    target = F.when(k == 0, F.concat(second, F.lit("/"), size)).when(k == 1, F.concat(first, F.lit("/sub/"), size)).when(k == 2, F.concat(external, second, F.lit("x"), (F.col("p_size") % 3).cast("string"))).otherwise(F.concat(external, first))
    return link.dependency_usage(declared, t.part.select(target.alias("target")).distinct())


@query("lib_boundary", "SELECT i.from_id, i.to_id, CASE WHEN a.repo = b.repo THEN 'first_party' WHEN b.repo = 'SMALL' THEN 'first_party' WHEN b.key % 2 = 0 THEN 'third_party' ELSE 'unannotated' END AS boundary FROM (SELECT DISTINCT from_id, to_id FROM imports) i JOIN fn a ON a.id = i.from_id JOIN fn b ON b.id = i.to_id")
def lib_boundary(t: Tables) -> DataFrame:
    a, b = t.fn.select(F.col("id").alias("from_id"), F.col("repo").alias("ra")), t.fn.select(F.col("id").alias("to_id"), F.col("repo").alias("rb"), "key")
    both = t.imports.distinct().join(a, "from_id").join(b, "to_id")
    return both.select("from_id", "to_id", relational.lib_boundary(F.col("rb"), F.col("ra"), F.col("key") % 2 == 0, F.col("rb") == "SMALL").alias("boundary"))


@query("tests_walkup", """, fan AS (SELECT to_id FROM calls GROUP BY to_id HAVING count(*) <= 5), c AS (SELECT from_id AS caller, to_id AS helper FROM calls WHERE to_id IN (SELECT to_id FROM fan) AND from_id NOT IN (SELECT id FROM fn WHERE is_test))
SELECT t.from_id, c.caller AS to_id, min(c.helper) AS via FROM tests t JOIN c ON c.helper = t.to_id WHERE t.from_id <> c.caller AND NOT EXISTS (SELECT 1 FROM tests k WHERE k.from_id = t.from_id AND k.to_id = c.caller) GROUP BY 1, 2""")
def tests_walkup(t: Tables) -> DataFrame:
    return link.tests_walkup(t.tests, t.calls, t.fn.where("is_test").select("id"))


_LINES = "SELECT DISTINCT 'src/b' || (l_suppkey % 20) AS path, CAST(l_partkey % 600 AS INT) AS line, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 1 END AS hits FROM lineitem WHERE l_quantity > 25"
_SPANS = "SELECT p_partkey AS id, 'src/b' || (p_partkey % 20) AS path, CASE WHEN p_size % 9 = 0 THEN 0 ELSE p_size * 10 END AS first, CASE WHEN p_size % 9 = 0 THEN 0 ELSE p_size * 10 + p_partkey % 90 END AS last FROM part"


@query("span_coverage", f"SELECT id, sum(CASE WHEN hits > 0 THEN 1 ELSE 0 END)::BIGINT AS covered, count(*) AS instrumented, round(100.0 * sum(CASE WHEN hits > 0 THEN 1 ELSE 0 END) / count(*), 2) AS pct FROM ({_SPANS}) s JOIN ({_LINES}) l ON s.path = l.path AND (s.first = 0 OR l.line BETWEEN s.first AND s.last) GROUP BY id")
def span_coverage(t: Tables) -> DataFrame:
    spans, lines = t.sql(_SPANS.replace("FROM part", "FROM {part}")), t.sql(_LINES.replace("FROM lineitem", "FROM {lineitem}"))
    return link.span_coverage(spans, lines)


@query("path_suffix_match", "SELECT f.source_file, min(r.path) AS report FROM (SELECT DISTINCT source_file FROM fn) f JOIN (SELECT DISTINCT lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '.py' AS path FROM part WHERE p_size < 10) r ON f.source_file = r.path OR ends_with(f.source_file, '/' || r.path) GROUP BY 1")
def path_suffix_match(t: Tables) -> DataFrame:
    files = t.fn.select("source_file").distinct()
    reports = t.part.where("p_size < 10").select(F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), F.lower("p_type"), F.lit(".py")).alias("path")).distinct()
    parts = F.split("source_file", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return files.select("source_file", F.explode(tails).alias("path")).join(reports, "path").groupBy("source_file").agg(F.min("path").alias("report"))


@query("def_use", "SELECT u.user_id, u.event_id, u.ts AS ts, max(d.ts) AS def_at FROM (SELECT * FROM events WHERE event_type = 'purchase') u LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') d ON d.user_id = u.user_id AND d.ts < u.ts GROUP BY 1, 2, 3")
def def_use(t: Tables) -> DataFrame:
    uses, defs = t.events.where("event_type = 'purchase'"), t.events.where("event_type = 'view'")
    return link.last_before(uses, defs, ["user_id"], "ts", "value", "event_id").select("user_id", "event_id", "ts", "def_at")


@query("metric_delta", """, h AS (SELECT event_type AS grp, ts, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS value FROM events), l AS (SELECT grp, max(ts) AS e, arg_max(value, ts) FILTER (value IS NOT NULL) AS latest FROM h GROUP BY grp)
SELECT l.grp, round(latest, 6) AS latest, round(latest - (SELECT value FROM h WHERE h.grp = l.grp AND h.ts <= l.e - INTERVAL 7 DAY ORDER BY ts DESC LIMIT 1), 6) AS delta FROM l""")
def metric_delta(t: Tables) -> DataFrame:
    return quality.metric_delta(t.events.select(F.col("event_type").alias("grp"), "ts", F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("value")), 7)


@query("mention_link", """, n AS (SELECT lower(text) AS tx, doc_id FROM documents), w AS (SELECT DISTINCT doc_id AS section, unnest(string_split_regex(tx, '[^a-z0-9_]+')) AS token FROM n), k AS (SELECT name AS token, min(id) AS id FROM (SELECT DISTINCT lower(split_part(text, ' ', 2)) AS name, 'b' || (item_id % 30) AS id FROM benchmark) x WHERE length(name) >= 4 AND name NOT IN ('this', 'that', 'with', 'from') GROUP BY name HAVING count(DISTINCT id) = 1)
SELECT section, w.token, id FROM w JOIN k ON w.token = k.token WHERE length(w.token) >= 4""")
def mention_link(t: Tables) -> DataFrame:
    names = t.benchmark.select(F.split_part("text", F.lit(" "), F.lit(2)).alias("name"), F.concat(F.lit("b"), (F.col("item_id") % 30).cast("string")).alias("id")).distinct()
    return link.mentions(t.documents.select(F.col("doc_id").alias("section"), "text"), names)


@query("name_resolution", """
, q AS (SELECT DISTINCT CASE key % 5 WHEN 0 THEN id WHEN 1 THEN upper(qualified_name) WHEN 2 THEN upper(label) WHEN 3 THEN upper(name) ELSE repo || '::' || label END AS query FROM fn),
k AS (SELECT query, lower(CASE WHEN contains(query, '::') THEN substr(query, instr(query, '::') + 2) ELSE query END) AS k, CASE WHEN contains(query, '::') THEN split_part(query, '::', 1) END AS pin FROM q),
h AS (SELECT query, 1 AS tier, id FROM q JOIN fn ON id = query
  UNION SELECT query, 2, id FROM k JOIN fn ON lower(qualified_name) = k AND (pin IS NULL OR pin = repo)
  UNION SELECT query, 3, id FROM k JOIN fn ON lower(label) = k AND (pin IS NULL OR pin = repo)
  UNION SELECT query, 4, id FROM k JOIN fn ON substr(lower(qualified_name), instr(qualified_name, '.') + 1) = k AND (pin IS NULL OR pin = repo)),
b AS (SELECT query, min(tier) AS tier FROM h GROUP BY 1)
SELECT query, tier, count(DISTINCT id) AS matches, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id FROM h JOIN b USING (query, tier) GROUP BY 1, 2""")
def name_resolution(t: Tables) -> DataFrame:
    k = F.col("key") % 5
    name = F.when(k == 0, F.col("id")).when(k == 1, F.upper("qualified_name")).when(k == 2, F.upper("label")).when(k == 3, F.upper("name")).otherwise(F.concat("repo", F.lit("::"), "label"))
    return link.resolve_names(t.fn.select(name.alias("query")), t.fn.select("id", "qualified_name", F.col("label").alias("name"), "repo"))


@query("mro", """
, e AS (SELECT 'K' || p_partkey AS c, 'K' || (p_partkey // 2) AS base FROM part WHERE p_partkey > 1), m AS (SELECT DISTINCT 'K' || p_partkey AS c, 'm' || (p_size % 6) AS member FROM part),
r(c, member, definer, depth) AS (SELECT c, member, c, 0 FROM m UNION SELECT e.c, r.member, r.definer, r.depth + 1 FROM e JOIN r ON r.c = e.base)
SELECT c AS class, member, arg_min(definer, depth) AS definer, min(depth)::INT AS depth FROM r GROUP BY 1, 2""")
def mro(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("K"), c.cast("string"))
    extends = t.part.where("p_partkey > 1").select(name(k).alias("class"), name(F.floor(k / 2)).alias("base"), (k % 2).cast("int").alias("ordinal"))
    return link.inherited(extends, t.part.select(name(k).alias("class"), F.concat(F.lit("m"), (F.col("p_size") % 6).cast("string")).alias("member")))


@query("label_link", """
, m AS (SELECT id, repo, kind, list_sort(list_distinct(list_filter(string_split(lower(replace(label || ' brand ' || substr(module, 7), ' ', '_')), '_'), lambda x: length(x) > 1 AND x <> 'new'))) AS t FROM fn),
s AS (SELECT DISTINCT t FROM m), n AS (SELECT count(*) AS n FROM s), e AS (SELECT t, unnest(t) AS token FROM s), d AS (SELECT token, count(*) AS df FROM e GROUP BY 1),
w AS (SELECT token, CAST(round(ln(1 + n::DOUBLE / df) * 1000000) AS BIGINT) AS w FROM d, n), f AS (SELECT CAST(round(ln(1 + n::DOUBLE) * 1000000) AS BIGINT) AS most FROM n),
k AS (SELECT t, sum(w) AS whole, max(w) AS top FROM e JOIN w USING (token) GROUP BY 1),
i AS (SELECT a.t AS a, b.t AS b, sum(w.w) AS shared, max(w.w) AS top FROM e a JOIN e b ON a.token = b.token AND a.t < b.t JOIN w ON w.token = a.token GROUP BY 1, 2),
p AS (SELECT a, b, shared / (x.whole + y.whole - shared) AS sim, i.top / most AS heaviest FROM i JOIN k x ON x.t = a JOIN k y ON y.t = b, f WHERE shared / (x.whole + y.whole - shared) >= 0.6
  UNION ALL SELECT t, t, 1.0, top / most FROM k, f),
h AS (SELECT t, repo, kind, min(id) AS id FROM m GROUP BY 1, 2, 3),
r AS (SELECT x.id AS s, y.id AS t, sim, round(sim * heaviest * CASE WHEN x.kind = y.kind THEN 1.0 WHEN (x.kind = 'SCOPE.Operation' AND y.kind = 'http_endpoint_definition') OR (y.kind = 'SCOPE.Operation' AND x.kind = 'http_endpoint_definition') THEN 0.8 ELSE 0 END, 6) AS raw
  FROM p JOIN h x ON x.t = p.a JOIN h y ON y.t = p.b WHERE x.repo <> y.repo AND (p.a <> p.b OR x.repo < y.repo))
SELECT least(s, t) AS source, greatest(s, t) AS target, round(sim, 6) AS similarity, round(CASE WHEN raw < 0.5 THEN raw ELSE greatest(0.6, least(0.8, 0.6 + (raw - 0.5) / 0.5 * 0.2)) END, 6) AS score FROM r WHERE raw > 0""")
def label_link(t: Tables) -> DataFrame:
    """Labels of names and brands, by weighted sets of tokens."""
    label = F.concat(F.col("label"), F.lit(" brand "), F.substring("module", 7, 100))
    return similarity.label_links(t.fn.select("id", "repo", "kind", label.alias("label")), {("SCOPE.Operation", "http_endpoint_definition"): 0.8}, 0.6)


@query("string_link", """, x AS (SELECT DISTINCT regexp_extract(text, 'Licen[sc]e[a-z]*') AS lit, source AS repo FROM documents), y AS (SELECT lit, repo FROM x WHERE lit <> '') SELECT a.lit, a.repo AS source_repo, b.repo AS target_repo, 0.55::DOUBLE AS confidence FROM y a JOIN y b ON a.lit = b.lit AND a.repo < b.repo""")
def string_link(t: Tables) -> DataFrame:
    y = t.documents.select(F.regexp_extract("text", r"Licen[sc]e[a-z]*", 0).alias("lit"), F.col("source").alias("repo")).where("lit <> ''").distinct()
    return y.alias("a").join(y.alias("b"), "lit").where("a.repo < b.repo").select("lit", F.col("a.repo").alias("source_repo"), F.col("b.repo").alias("target_repo"), F.lit(0.55).alias("confidence"))


_MODELS = "SELECT p_partkey AS id, p_type AS repo, replace(p_name, ' ', '_') AS name, ['f_' || (p_size % 4), 'F' || (p_size % 3), 'common', 'x' || (p_partkey % 5)] AS fields FROM part"


@query("same_as", f", m AS (SELECT id, repo, name, list_distinct(list_transform(fields, lambda f: lower(regexp_replace(f, '[^A-Za-z0-9]', '', 'g')))) AS f FROM ({_MODELS}) x), p AS (SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.f, b.f)) / len(list_distinct(list_concat(a.f, b.f))), 6) AS overlap FROM m a JOIN m b ON a.name = b.name AND a.id < b.id AND a.repo <> b.repo) SELECT a, b, overlap, round(CASE WHEN overlap >= 1 THEN 0.98 ELSE greatest(0.7, least(0.98, 0.7 + (overlap - 0.5) / 0.5 * 0.28)) END, 6) AS confidence FROM p WHERE overlap >= 0.5")
def same_as(t: Tables) -> DataFrame:
    s = lambda c, n: (F.col(c) % n).cast("string")
    models = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("repo"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.array(F.concat(F.lit("f_"), s("p_size", 4)), F.concat(F.lit("F"), s("p_size", 3)), F.lit("common"), F.concat(F.lit("x"), s("p_partkey", 5))).alias("fields"))
    return link.same_as(models, 0.5)


@query("phantom_edge_promotion", "SELECT DISTINCT repo, from_id, to_id FROM (SELECT a.repo AS repo, from_id, b.repo || '::' || to_id AS to_id FROM calls JOIN fn a ON a.id = from_id JOIN fn b ON b.id = to_id WHERE a.repo <> b.repo AND a.key % 3 < 2) x")
def phantom_edge_promotion(t: Tables) -> DataFrame:
    r = t.fn.select("id", "repo", "key")
    both = t.calls.join(r.select(F.col("id").alias("from_id"), F.col("repo").alias("ra"), "key"), "from_id").join(r.select(F.col("id").alias("to_id"), F.col("repo").alias("rb")), "to_id")
    links = both.select(F.concat("ra", F.lit("::"), "from_id").alias("source"), F.concat("rb", F.lit("::"), "to_id").alias("target"), F.lit("calls").alias("relation"), F.when(F.col("key") % 3 == 0, "http").when(F.col("key") % 3 == 1, "kafka_topic").otherwise("import").alias("method"))
    return link.phantom_edges(links).select("repo", "from_id", "to_id").distinct()


@query("overlay_apply", "SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END, -2)::INT AS community FROM customer")
def overlay_apply(t: Tables) -> DataFrame:
    overlay = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("new"))
    return t.customer.select(F.col("c_custkey").alias("id")).join(overlay, "id", "left").select("id", F.coalesce("new", F.lit(-2)).alias("community"))


@query("payload_drift", """, p AS (SELECT o_orderpriority AS key, list_distinct(list(lower(o_orderstatus || (o_orderkey % 7)))) AS f FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), c AS (SELECT o_orderpriority AS key, list_distinct(list(lower(o_orderstatus || (o_orderkey % 9)))) AS f FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1)
SELECT key, array_to_string(list_sort(list_filter(p.f, lambda x: NOT list_contains(c.f, x))), ',') AS only_producer, array_to_string(list_sort(list_filter(c.f, lambda x: NOT list_contains(p.f, x))), ',') AS only_consumer, 'schema' AS drift FROM p JOIN c USING (key) WHERE len(list_filter(p.f, lambda x: NOT list_contains(c.f, x))) + len(list_filter(c.f, lambda x: NOT list_contains(p.f, x))) > 0""")
def payload_drift(t: Tables) -> DataFrame:
    f = lambda n: F.concat("o_orderstatus", F.lit("_"), (F.col("o_orderkey") % n).cast("string")).alias("field")
    return diff.payload_drift(t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderpriority").alias("key"), f(7)), t.orders.where("o_orderkey % 5 = 0").select(F.col("o_orderpriority").alias("key"), f(9)))


@query("literal_parity", """
, l AS (SELECT lower(p_brand) || '_x_' || (p_partkey // 9) AS key, list_sort(list(p_size::VARCHAR)) AS v FROM part WHERE p_size > 2 GROUP BY 1),
r AS (SELECT lower(p_brand) || '_x_' || (p_partkey // 9) AS key, list_sort(list(CASE WHEN p_size = 50 THEN '0' ELSE p_size::VARCHAR END)) AS v FROM part WHERE p_size < 49 OR p_type = 'PROMO' GROUP BY 1)
SELECT replace(replace(coalesce(l.key, r.key), '#', '_'), '__', '_') AS key,
  CASE WHEN l.key IS NULL THEN 'only_right' WHEN r.key IS NULL THEN 'only_left' WHEN l.v = r.v THEN 'equal' ELSE 'mismatch' END AS status FROM l FULL JOIN r ON l.key = r.key""")
def literal_parity(t: Tables) -> DataFrame:
    nine = F.floor(F.col("p_partkey") / 9).cast("string")
    left = t.part.where("p_size > 2").select(F.concat(F.upper("p_brand"), F.lit("-X-"), nine).alias("key"), F.col("p_size").cast("string").alias("value"))
    right = t.part.where("p_size < 49 or p_type = 'PROMO'").select(F.concat(F.lower("p_brand"), F.lit("_x_"), nine).alias("key"), F.when(F.col("p_size") == 50, "0").otherwise(F.col("p_size").cast("string")).alias("value"))
    return diff.literal_parity(left, right)


@query("response_shape_diff", """, l AS (SELECT DISTINCT 'e' || (p_partkey // 4) AS endpoint, 200 + p_partkey % 2 AS status, 'f' || (p_partkey % 5) AS field FROM part WHERE p_size > 3), r AS (SELECT DISTINCT 'e' || (p_partkey // 4) AS endpoint, 200 + p_partkey % 2 AS status, 'f' || (p_partkey % 5) AS field FROM part WHERE p_size < 48)
SELECT coalesce(l.endpoint, r.endpoint) AS endpoint, coalesce(l.status, r.status) AS status, coalesce(l.field, r.field) AS field, CASE WHEN l.field IS NULL THEN 'only_right' WHEN r.field IS NULL THEN 'only_left' WHEN l.field = 'f1' THEN 'type_mismatch' ELSE 'optional_mismatch' END AS drift FROM l FULL JOIN r ON l.endpoint = r.endpoint AND l.status = r.status AND l.field = r.field WHERE l.field IS NULL OR r.field IS NULL OR l.field IN ('f1', 'f2')""")
def response_shape_diff(t: Tables) -> DataFrame:
    k = F.col("p_partkey")

    def shape(df: DataFrame, kind: str, other: str, optional: bool) -> DataFrame:
        field = F.concat(F.lit("f"), (k % 5).cast("string"))
        return df.select(F.concat(F.lit("e"), F.floor(k / 4).cast("string")).alias("endpoint"), (200 + k % 2).alias("status"), field.alias("field"), F.when(field == "f1", other).otherwise(kind).alias("type"), F.when(field == "f2", F.lit(optional)).otherwise(False).alias("optional")).distinct()

    return diff.response_shapes(shape(t.part.where("p_size > 3"), "str", "int", True), shape(t.part.where("p_size < 48"), "string", "bool", False))


@query("auth_posture_diff", """, x AS (SELECT p_partkey AS id, ['public', 'authenticated', 'role', 'page', 'superuser', 'unknown'][p_size % 6 + 1] AS l, ['public', 'authenticated', 'scope', 'page', 'superuser', 'role'][p_partkey % 6 + 1] AS r, p_size % 2 AS a, p_partkey % 2 AS b FROM part), y AS (SELECT *, [-1, 0, 1, 2, 2, 3, 4][list_position(['unknown', 'public', 'authenticated', 'scope', 'role', 'page', 'superuser'], l)] AS sl, [-1, 0, 1, 2, 2, 3, 4][list_position(['unknown', 'public', 'authenticated', 'scope', 'role', 'page', 'superuser'], r)] AS sr FROM x)
SELECT id, CASE WHEN sl < 0 OR sr < 0 THEN 'kind_mismatch' WHEN l = r THEN CASE WHEN l IN ('page', 'role', 'scope') AND a <> b THEN 'slug_mismatch' ELSE 'equivalent' END WHEN sl > sr THEN 'stricter' WHEN sl < sr THEN 'looser' ELSE 'kind_mismatch' END AS verdict FROM y""")
def auth_posture_diff(t: Tables) -> DataFrame:
    pick = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), (c + 1).cast("int"))
    left = pick(["public", "authenticated", "role", "page", "superuser", "unknown"], F.col("p_size") % 6)
    right = pick(["public", "authenticated", "scope", "page", "superuser", "role"], F.col("p_partkey") % 6)
    slug = lambda c, sep: F.concat(F.lit(f"core{sep}"), (c % 2).cast("string"))
    return t.part.select(F.col("p_partkey").alias("id"), diff.auth_verdict(left, slug(F.col("p_size"), "_"), right, slug(F.col("p_partkey"), "-")).alias("verdict"))


@query("graph_parity", "SELECT a.o_orderstatus AS o_orderstatus, a.v AS l, b.v AS r FROM (SELECT o_orderstatus, round(avg(o_totalprice), 2) AS v FROM orders GROUP BY 1) a JOIN (SELECT o_orderstatus, round(avg(o_totalprice), 2) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) b USING (o_orderstatus) WHERE abs(a.v - b.v) > 10")
def graph_parity(t: Tables) -> DataFrame:
    avg = lambda df: df.groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 2).alias("v"))
    return diff.parity(avg(t.orders), avg(t.orders.where("o_orderkey % 2 = 0")), ["o_orderstatus"], "v", 10)


@query("fixture_recall", "SELECT count(*) FILTER (quality = 1)::BIGINT AS must, count(*) FILTER (quality = 1 AND n_chars > 300)::BIGINT AS must_found, count(*) FILTER (quality = 0 AND toxic = 0)::BIGINT AS nice, count(*) FILTER (quality = 0 AND toxic = 0 AND n_chars > 300)::BIGINT AS nice_found, count(*) FILTER (quality = 0 AND toxic = 1 AND n_chars > 300)::BIGINT AS forbidden_hits, round(count(*) FILTER (quality = 1 AND n_chars > 300) / count(*) FILTER (quality = 1), 6) AS recall FROM labels JOIN documents USING (doc_id)")
def fixture_recall(t: Tables) -> DataFrame:
    expected = t.labels.select("doc_id", F.when(F.col("quality") == 1, "must").when(F.col("toxic") == 0, "nice").otherwise("forbidden").alias("level"))
    return quality.recall(expected, t.documents.where("n_chars > 300"), ["doc_id"])
