"""Queries on paths, ranks, components, flows and lattices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import blocks, diff, event_flow, flow, groups, loops, louvain, rank, relational, traverse
from graphloom.operators.loops import settled
from graphloom.plans.projection import Tables
from graphloom.plans.registry import query


def _ids(t: Tables, *names: str) -> DataFrame:
    return t.spark.createDataFrame([(n,) for n in names], "id string")


def _bfs_sql(start: str, edges: str, hops: int) -> str:
    return f", e AS ({edges}), r(id, depth) AS ({start} UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.id WHERE r.depth < {hops}) SELECT id, min(depth)::INT AS depth FROM r GROUP BY id"


@query("impact_radius", _bfs_sql("SELECT 'region:1' AS id, 0 AS depth", "SELECT to_id AS a, from_id AS b FROM rel", 3))
def impact_radius(t: Tables) -> DataFrame:
    return traverse.impact(t.rel, _ids(t, "region:1"), 3, t.tasks("lineitem", 3))  # lineitem gives two edges a row, orders a fourth


@query("bfs", _bfs_sql("SELECT 'f7' AS id, 0 AS depth", "SELECT from_id AS a, to_id AS b FROM calls UNION SELECT to_id, from_id FROM calls", 3))
def bfs(t: Tables) -> DataFrame:
    return traverse.bfs(t.calls, _ids(t, "f7"), 3, "both")


@query("subgraph", ", e AS (SELECT from_id AS a, to_id AS b FROM calls UNION SELECT to_id, from_id FROM calls), r(id, depth) AS (SELECT 'f7', 0 UNION SELECT e.b, depth + 1 FROM r JOIN e ON e.a = r.id WHERE depth < 2), n AS (SELECT DISTINCT id FROM r) SELECT from_id, to_id FROM calls WHERE from_id IN (SELECT id FROM n) AND to_id IN (SELECT id FROM n)")
def subgraph(t: Tables) -> DataFrame:
    return traverse.subgraph(t.calls, _ids(t, "f7"), 2)


_PAIRS = ", e AS (SELECT DISTINCT from_id, to_id FROM calls)"


@query("find_paths", f"{_PAIRS}, t AS (SELECT to_id AS target FROM e JOIN (SELECT to_id AS m FROM e WHERE from_id = 'f7') x ON from_id = m WHERE to_id <> 'f7' ORDER BY to_id LIMIT 1), r(path, last) AS (SELECT ['f7'], 'f7' UNION ALL SELECT list_append(path, to_id), to_id FROM r JOIN e ON from_id = last WHERE len(path) < 5 AND NOT list_contains(path, to_id) AND last <> (SELECT target FROM t)) SELECT array_to_string(path, '>') AS path, len(path)::INT - 1 AS hops FROM r WHERE last = (SELECT target FROM t)")
def find_paths(t: Tables) -> DataFrame:
    e = settled(t.calls)
    two = e.where("from_id = 'f7'").select(F.col("to_id").alias("m")).join(e, F.col("m") == F.col("from_id")).where("to_id <> 'f7'").select("to_id").orderBy("to_id").first()
    if two is None:
        return t.spark.createDataFrame([], "path string, hops int")
    return traverse.simple_paths(e, "f7", two[0], 4).select(F.array_join("path", ">").alias("path"), "hops")


@query("shortest_path", ", e AS (SELECT c.from_id, c.to_id, -ln(0.5 + 0.1 * (b.size % 5)) AS step FROM calls c JOIN fn b ON b.id = c.to_id), r(id, cost, n) AS (SELECT 'f7', 0.0::DOUBLE, 0 UNION ALL SELECT id, min(cost), max(n) FROM (SELECT e.to_id AS id, r.cost + e.step AS cost, r.n + 1 AS n FROM r JOIN e ON e.from_id = r.id WHERE r.n < 6) x GROUP BY id) SELECT id, round(min(cost), 6) AS cost FROM r GROUP BY id")
def shortest_path(t: Tables) -> DataFrame:
    e = t.calls.join(t.fn.select(F.col("id").alias("to_id"), "size"), "to_id").select("from_id", "to_id", (0.5 + 0.1 * (F.col("size") % 5)).alias("confidence"))
    return traverse.cheapest(e, "f7", 6).select("id", F.round("cost", 6).alias("cost"))


@query("path_confidence", ", e AS (SELECT c.from_id, c.to_id, (0.5 + 0.1 * (b.size % 5))::DOUBLE AS w FROM calls c JOIN fn b ON b.id = c.to_id) SELECT a.to_id AS mid, b.to_id AS id, round(least(a.w, b.w), 6) AS min_hop_confidence, round(greatest(a.w, b.w), 6) AS reference_conf FROM e a JOIN e b ON b.from_id = a.to_id WHERE a.from_id = 'f7'")
def path_confidence(t: Tables) -> DataFrame:
    e = t.calls.join(t.fn.select(F.col("id").alias("to_id"), "size"), "to_id").select("from_id", "to_id", (0.5 + 0.1 * (F.col("size") % 5)).alias("w"))
    both = e.where("from_id = 'f7'").alias("a").join(e.alias("b"), F.col("a.to_id") == F.col("b.from_id"))
    return both.select(F.col("a.to_id").alias("mid"), F.col("b.to_id").alias("id"), F.round(F.least("a.w", "b.w"), 6).alias("min_hop_confidence"), F.round(F.greatest("a.w", "b.w"), 6).alias("reference_conf"))


@query("pr_impact", ", c AS (SELECT id FROM fn WHERE size = 7), r(id, depth) AS (SELECT id, 0 FROM c UNION SELECT from_id, depth + 1 FROM r JOIN calls ON to_id = id WHERE depth < 2), d AS (SELECT id, min(depth) AS depth FROM r GROUP BY id) SELECT f.module, count(*) FILTER (depth = 0)::BIGINT AS changed, count(*) FILTER (depth > 0)::BIGINT AS hit FROM d JOIN fn f USING (id) GROUP BY 1")
def pr_impact(t: Tables) -> DataFrame:
    d = traverse.impact(t.calls, t.fn.where("size = 7"), 2)
    return d.join(t.fn.select("id", "module"), "id").groupBy("module").agg(F.count_if(F.col("depth") == 0).alias("changed"), F.count_if(F.col("depth") > 0).alias("hit"))


@query("merge_risk", ", x AS (SELECT DISTINCT 'ref' || (l_suppkey % 8) AS ref, CASE WHEN l_partkey % 13 = 0 THEN -1 ELSE l_partkey % 40 END AS c FROM lineitem) SELECT a.ref AS a, b.ref AS b, count(*) AS shared FROM x a JOIN x b ON a.c = b.c AND a.ref < b.ref WHERE a.c <> -1 GROUP BY 1, 2")
def merge_risk(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.concat(F.lit("ref"), (F.col("l_suppkey") % 8).cast("string")).alias("ref"), F.when(F.col("l_partkey") % 13 == 0, -1).otherwise(F.col("l_partkey") % 40).alias("community"))
    return diff.merge_risk(rows)


_REACH = ", r(id) AS (SELECT id FROM fn WHERE kind = 'http_endpoint_definition' UNION SELECT to_id FROM r JOIN calls ON from_id = id)"


@query("reachability", f"{_REACH} SELECT id, id IN (SELECT id FROM r) AS reachable FROM fn")
def reachability(t: Tables) -> DataFrame:
    live = traverse.bfs(t.calls, t.fn.where("kind = 'http_endpoint_definition'"), None)
    return t.fn.select("id").join(live.select("id", F.lit(True).alias("r")), "id", "left").select("id", F.coalesce("r", F.lit(False)).alias("reachable"))


@query("dead_code", f"{_REACH} SELECT id FROM fn WHERE id NOT IN (SELECT id FROM r)")
def dead_code(t: Tables) -> DataFrame:
    return traverse.unreached(t.fn, t.calls, t.fn.where("kind = 'http_endpoint_definition'"))


@query("find_dead_code", ", e AS (SELECT from_id, to_id, 'CALLS' AS kind FROM calls UNION ALL SELECT DISTINCT from_id, to_id, 'IMPORTS' FROM imports UNION ALL SELECT from_id, to_id, 'TESTS' FROM tests), x AS (SELECT to_id AS id, count(*) AS n, count(*) FILTER (e.kind <> 'TESTS' AND NOT a.is_test) AS p FROM e JOIN fn a ON a.id = from_id GROUP BY 1) SELECT fn.id, CASE WHEN n IS NULL THEN 'isolated' ELSE 'test_only_referenced' END AS reason FROM fn LEFT JOIN x ON x.id = fn.id WHERE coalesce(p, 0) = 0 AND fn.kind <> 'http_endpoint_definition'")
def find_dead_code(t: Tables) -> DataFrame:
    return traverse.only_tests_inbound(t.fn.where("kind <> 'http_endpoint_definition'"), t.edges, t.fn.where("is_test").select("id"))


@query("test_reachability", ", e AS (SELECT from_id, to_id FROM calls UNION SELECT from_id, to_id FROM tests), r(id, depth) AS (SELECT id, 0 FROM fn WHERE is_test UNION SELECT to_id, depth + 1 FROM r JOIN e ON from_id = id WHERE depth < 3), d AS (SELECT id, min(depth) AS depth FROM r GROUP BY id), k AS (SELECT to_id AS id, count(DISTINCT from_id) AS tests FROM tests GROUP BY 1) SELECT fn.id, d.depth::INT AS reach_depth, coalesce(k.tests, 0) AS direct_tests FROM fn LEFT JOIN d ON d.id = fn.id LEFT JOIN k ON k.id = fn.id WHERE NOT is_test")
def test_reachability(t: Tables) -> DataFrame:
    d = traverse.bfs(t.calls.union(t.tests), t.fn.where("is_test"), 3)
    k = t.tests.groupBy(F.col("to_id").alias("id")).agg(F.count_distinct("from_id").alias("tests"))
    return t.fn.where("not is_test").select("id").join(d, "id", "left").join(k, "id", "left").select("id", F.col("depth").alias("reach_depth"), F.coalesce("tests", F.lit(0)).alias("direct_tests"))


def _pagerank_sql(rounds: int) -> str:
    out = ", n AS (SELECT id FROM fn), c AS (SELECT count(*) AS n FROM fn), o AS (SELECT from_id, count(*) AS k FROM calls GROUP BY 1), p0 AS (SELECT id, 1.0::DOUBLE / (SELECT n FROM c) AS pr FROM n)"
    for i in range(1, rounds + 1):
        out += f", g{i} AS (SELECT to_id, sum(pr / k) AS got FROM calls JOIN o USING (from_id) JOIN p{i - 1} ON p{i - 1}.id = from_id GROUP BY 1), p{i} AS MATERIALIZED (SELECT n.id, 0.15 / (SELECT n FROM c) + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(pr), 0) FROM p{i - 1} WHERE id NOT IN (SELECT from_id FROM o)) / (SELECT n FROM c)) AS pr FROM n LEFT JOIN g{i} ON to_id = n.id)"
    return out


@query("pagerank", _pagerank_sql(8) + " SELECT id, round(pr, 9) AS pagerank FROM p8")
def pagerank(t: Tables) -> DataFrame:
    return rank.pagerank(t.fn, t.calls, 8).select("id", F.round("pagerank", 9).alias("pagerank"))


@query("top_pagerank", _pagerank_sql(8) + " SELECT id, round(round(pr, 9), 7) AS pagerank FROM p8 ORDER BY round(pr, 9) DESC, id LIMIT 20")
def top_pagerank(t: Tables) -> DataFrame:
    r = rank.pagerank(t.fn, t.calls, 8).withColumn("p", F.round("pagerank", 9))
    return rank.top(r, "p", 20).select("id", F.round("p", 7).alias("pagerank"))


_MODULE_BC = ", m AS (SELECT DISTINCT a.module AS a, b.module AS b FROM imports JOIN fn a ON a.id = from_id JOIN fn b ON b.id = to_id WHERE a.module <> b.module), n AS (SELECT DISTINCT module AS id FROM fn), d(s, id, depth) AS (SELECT id, id, 0 FROM n UNION SELECT s, b, depth + 1 FROM d JOIN m ON a = id WHERE depth < 8), sp AS (SELECT s, id, min(depth) AS depth FROM d GROUP BY 1, 2), w(s, id, depth, paths) AS (SELECT id, id, 0, 1.0::DOUBLE FROM n UNION ALL SELECT s, id, depth, sum(paths) FROM (SELECT w.s, sp.id, sp.depth, w.paths FROM w JOIN m ON a = w.id JOIN sp ON sp.s = w.s AND sp.id = m.b AND sp.depth = w.depth + 1) x GROUP BY 1, 2, 3)"
_BC = _MODULE_BC + ", v AS (SELECT v.id, v.s, t.id AS t, v.paths * u.paths / t.paths AS share FROM w t JOIN w v ON v.s = t.s AND v.depth < t.depth AND v.depth > 0 JOIN w u ON u.s = v.id AND u.id = t.id AND u.depth = t.depth - v.depth) SELECT n.id, round(coalesce(sum(share), 0), 6) AS betweenness FROM n LEFT JOIN v ON v.id = n.id GROUP BY n.id"


def _modules(t: Tables) -> tuple[DataFrame, DataFrame]:
    pairs = relational.module_edges(t.imports, t.fn.select("id", "module"))
    return t.fn.select(F.col("module").alias("id")).distinct(), pairs.select(F.col("from_module").alias("from_id"), F.col("to_module").alias("to_id"))


@query("betweenness", _BC)
def betweenness(t: Tables) -> DataFrame:
    return rank.betweenness(*_modules(t)).select("id", F.round("betweenness", 6).alias("betweenness"))


@query("top_betweenness", _BC + " ORDER BY betweenness DESC, id LIMIT 5")
def top_betweenness(t: Tables) -> DataFrame:
    return rank.top(betweenness(t), "betweenness", 5)


@query("betweenness_sampled")
def betweenness_sampled(t: Tables) -> DataFrame:
    return rank.betweenness(t.fn, t.imports, pivots=16).select("id", F.round("betweenness", 6).alias("betweenness"))


def _module_pagerank_sql(rounds: int) -> str:
    """p<rounds>(id, pr) over the module pairs m(a, b) and modules n(id) of _MODULE_BC."""
    out = ", pc AS (SELECT count(*) AS n FROM n), po AS (SELECT a, count(*) AS k FROM m GROUP BY 1), p0 AS (SELECT id, 1.0::DOUBLE / (SELECT n FROM pc) AS pr FROM n)"
    for i in range(1, rounds + 1):
        out += (
            f", g{i} AS (SELECT b, sum(pr / k) AS got FROM m JOIN po USING (a) JOIN p{i - 1} ON id = a GROUP BY 1), p{i} AS MATERIALIZED (SELECT n.id, 0.15 / (SELECT n FROM pc)"
            f" + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(pr), 0) FROM p{i - 1} WHERE id NOT IN (SELECT a FROM po)) / (SELECT n FROM pc)) AS pr FROM n LEFT JOIN g{i} ON b = n.id)"
        )
    return out


_GOD = _BC.replace("SELECT n.id, round", ", bc AS (SELECT n.id, round") + ")" + _module_pagerank_sql(10)


@query("god_nodes", f"""{_GOD}, k AS (SELECT greatest(1, ceil(n * 0.05))::BIGINT AS k FROM pc)
SELECT id FROM (SELECT id FROM p10 ORDER BY round(pr, 9) DESC, id LIMIT (SELECT k FROM k)) UNION SELECT id FROM (SELECT id FROM bc ORDER BY betweenness DESC, id LIMIT (SELECT k FROM k))""")
def god_nodes(t: Tables) -> DataFrame:
    nodes, pairs = _modules(t)
    scores = rank.pagerank(nodes, pairs, 10).withColumn("pagerank", F.round("pagerank", 9)).join(rank.betweenness(nodes, pairs).withColumn("betweenness", F.round("betweenness", 6)), "id")
    return rank.god_nodes(scores, 0.05)


_SCC = ", i AS (SELECT DISTINCT from_id, to_id FROM imports WHERE from_id <> to_id), r(a, b) AS (SELECT from_id, to_id FROM i UNION SELECT r.a, i.to_id FROM r JOIN i ON i.from_id = r.b), s AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.a)"


@query("import_scc", f"{_SCC} SELECT fn.id, coalesce(component, fn.id) AS component FROM fn LEFT JOIN s ON s.id = fn.id")
def import_scc(t: Tables) -> DataFrame:
    return groups.strong_components(t.fn, t.imports)


@query("import_cycles", f"{_SCC}, z AS (SELECT component, array_to_string(list_sort(list(id)), ',') AS members, count(*) AS size, arg_min(id, (-price, id)) AS extract FROM (SELECT s.*, f.price FROM s JOIN fn f ON f.id = s.id) g GROUP BY 1), e AS (SELECT a.component, count(*) AS edges, min((fa.price, from_id, to_id)) AS w FROM imports JOIN s a ON a.id = from_id JOIN s b ON b.id = to_id JOIN fn fa ON fa.id = from_id WHERE a.component = b.component AND from_id <> to_id GROUP BY 1) SELECT z.component, members, size, edges, w[2] AS weak_from, w[3] AS weak_to, extract FROM z JOIN e USING (component)")
def import_cycles(t: Tables) -> DataFrame:
    comp = settled(groups.strong_components(t.fn, t.imports))
    return groups.cycles(comp, t.imports, t.fn.select("id", F.col("price").alias("pagerank")))


@query("module_cycles", ", i AS (SELECT DISTINCT a.module AS a, b.module AS b FROM imports JOIN fn a ON a.id = from_id JOIN fn b ON b.id = to_id WHERE a.module <> b.module), r(a, b) AS (SELECT a, b FROM i UNION SELECT r.a, i.b FROM r JOIN i ON i.a = r.b), s AS (SELECT x.a AS id, least(x.a, min(x.b)) AS c FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.a) SELECT n.id, coalesce(c, '-1') AS module_cycle_id FROM (SELECT DISTINCT module AS id FROM fn) n LEFT JOIN s ON s.id = n.id")
def module_cycles(t: Tables) -> DataFrame:
    comp = settled(groups.strong_components(*_modules(t)))
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return comp.join(size, "component").select("id", F.when(F.col("n") > 1, F.col("component")).otherwise("-1").alias("module_cycle_id"))


@query("service_cycles", ", l AS (SELECT event_type AS a, next_type AS b, CASE WHEN value > 50 THEN 'calls' ELSE 'shared_label' END AS relation FROM steps WHERE next_type IS NOT NULL AND event_type <> next_type), g AS (SELECT a, b, count(*) AS n FROM l WHERE relation IN ('calls', 'publishes_to') GROUP BY 1, 2), k AS (SELECT a, b FROM g WHERE n >= (SELECT avg(n) FROM g)), r(a, b) AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM r JOIN k ON k.a = r.b) SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.a")
def service_cycles(t: Tables) -> DataFrame:
    links = t.steps.where("next_type is not null and event_type <> next_type and value > 50")
    g = links.groupBy(F.col("event_type").alias("from_id"), F.col("next_type").alias("to_id")).agg(F.count(F.lit(1)).alias("n"))
    k = settled(g.crossJoin(F.broadcast(g.agg(F.avg("n").alias("mean")))).where("n >= mean"))  # one row
    comp = settled(groups.strong_components(k.select(F.col("from_id").alias("id")).union(k.select("to_id")), k))
    return comp.join(comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "component", "left_semi").select("id", "component")


@query("connected_components", ", e AS (SELECT from_id AS a, to_id AS b FROM imports UNION SELECT to_id, from_id FROM imports), r(id, c) AS (SELECT id, id FROM fn UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b) SELECT id, min(c) AS component FROM r GROUP BY id")
def connected_components(t: Tables) -> DataFrame:
    return groups.connected(t.fn, t.imports)


def _nations(t: Tables) -> DataFrame:
    n = t.customer.select("c_custkey", "c_nationkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey").join(t.lineitem.where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    a, b = F.least("c_nationkey", "s_nationkey"), F.greatest("c_nationkey", "s_nationkey")
    return n.where("c_nationkey <> s_nationkey").groupBy(a.cast("string").alias("from_id"), b.cast("string").alias("to_id")).agg(F.count(F.lit(1)).alias("weight"))


@query("communities")
def communities(t: Tables) -> DataFrame:
    return groups.communities(t.fn, t.calls.withColumn("weight", F.lit(1)), least=3, part_edges=louvain.PART_EDGES)


@query("communities_quality", """
, s AS (SELECT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b, count(*) AS w FROM calls GROUP BY 1, 2),
k AS (SELECT module, sum(w) AS k FROM (SELECT a AS id, w FROM s UNION ALL SELECT b, w FROM s) x JOIN fn USING (id) GROUP BY 1),
i AS (SELECT sum(w) AS m, sum(CASE WHEN x.module = y.module THEN w ELSE 0 END) AS inside FROM s JOIN fn x ON x.id = a JOIN fn y ON y.id = b)
SELECT (SELECT count(*) FROM fn) AS nodes, round((SELECT inside / m FROM i) - (SELECT sum(k * k) FROM k) / (4.0 * (SELECT m * m FROM i)), 9) AS modules,
  true AS beats_modules, true AS beats_one_level, true AS no_small_ones, true AS named_by_smallest""")
def communities_quality(t: Tables) -> DataFrame:
    """What must hold of the communities: better than the modules and than one level, nobody in two or none, small ones noise, names their smallest members."""
    edges = t.calls.withColumn("weight", F.lit(1))
    first, last = louvain.by_level(t.fn, edges, part_edges=louvain.PART_EDGES)
    found = loops.stored(groups.named(last, least=1))
    labelled = groups.named(found, least=3)
    score = lambda labels: groups.modularity(labels, edges).select(F.round("modularity", 9).alias("q"))
    q, one = score(found).first()[0] or 0.0, score(first).first()[0] or 0.0
    size = labelled.where("community <> '-1'").groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    held = size.agg(F.coalesce(F.min("n") >= 3, F.lit(True)).alias("no_small_ones"), F.coalesce(F.min((F.col("low") == F.col("community")).cast("int")) == 1, F.lit(True)).alias("named_by_smallest"))
    modules = score(t.fn.select("id", F.col("module").alias("community"))).select(F.col("q").alias("modules"))
    row = labelled.agg(F.count_distinct("id").alias("nodes")).crossJoin(modules).crossJoin(held)  # one row each
    return row.select("nodes", "modules", (F.lit(q) > F.col("modules")).alias("beats_modules"), F.lit(q > one).alias("beats_one_level"), "no_small_ones", "named_by_smallest")


@query("modularity", ", e AS (SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*)::DOUBLE AS w FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity >= 45 AND c_nationkey <> s_nationkey GROUP BY 1, 2), k AS (SELECT n_regionkey AS c, sum(w) AS k FROM (SELECT a AS id, w FROM e UNION ALL SELECT b, w FROM e) x JOIN nation ON n_nationkey = id GROUP BY 1) SELECT round((SELECT sum(w) FROM e JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b WHERE x.n_regionkey = y.n_regionkey) / (SELECT sum(w) FROM e) - (SELECT sum(k * k) FROM k) / (4 * (SELECT sum(w) FROM e) ^ 2), 9) AS modularity")
def modularity(t: Tables) -> DataFrame:
    labels = t.nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_regionkey").alias("community"))
    return groups.modularity(labels, _nations(t)).select(F.round("modularity", 9).alias("modularity"))


@query("communities_list", ", c AS (SELECT module, count(*) AS size, list(id ORDER BY price DESC, id) AS l FROM fn GROUP BY 1 HAVING count(*) >= 20) SELECT module, size, array_to_string(l[1:3], ',') AS top FROM c ORDER BY size DESC, module")
def communities_list(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("module").orderBy(F.desc("price"), "id")
    top = t.fn.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("module").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]), ",").alias("top"))
    return t.fn.groupBy("module").agg(F.count(F.lit(1)).alias("size")).where("size >= 20").join(top, "module").orderBy(F.desc("size"), "module")


@query("articulation_points", """
, u AS (SELECT from_id AS a, to_id AS b FROM calls UNION SELECT to_id, from_id FROM calls),
d AS (SELECT a AS cut, min(b) AS start FROM u GROUP BY a HAVING count(*) > 1),
r(cut, id) AS (SELECT cut, start FROM d UNION SELECT cut, u.b FROM r JOIN u ON u.a = r.id WHERE u.b <> cut)
SELECT DISTINCT d.cut AS id FROM d JOIN u ON u.a = d.cut LEFT JOIN r ON r.cut = d.cut AND r.id = u.b WHERE r.id IS NULL""")
def articulation_points(t: Tables) -> DataFrame:
    return blocks.articulation_points(t.fn, t.calls)


@query("surprise_edges", ", b AS (SELECT DISTINCT from_id, to_id, a.module AS a, b.module AS b FROM calls JOIN fn a ON a.id = from_id JOIN fn b ON b.id = to_id WHERE a.module <> b.module), s AS (SELECT module, count(*) AS n FROM fn GROUP BY 1), l AS (SELECT a, b, count(*) AS links FROM b GROUP BY 1, 2) SELECT from_id, to_id, round(1 - links / (x.n * y.n), 6) AS score FROM b JOIN l USING (a, b) JOIN s x ON x.module = a JOIN s y ON y.module = b")
def surprise_edges(t: Tables) -> DataFrame:
    return groups.surprising_edges(t.fn.select("id", F.col("module").alias("community")), t.calls)


@query("orientation", ", d AS (SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM calls UNION ALL SELECT to_id FROM calls) x GROUP BY 1), h AS (SELECT degree FROM d ORDER BY degree DESC LIMIT 1), e AS (SELECT from_id, to_id, a.module AS ma, b.module AS mb, a.kind AS ka, b.kind AS kb, x.degree AS da, y.degree AS db FROM calls JOIN fn a ON a.id = from_id JOIN fn b ON b.id = to_id JOIN d x ON x.id = from_id JOIN d y ON y.id = to_id) SELECT from_id, to_id, array_to_string(list_filter([CASE WHEN ma <> mb THEN 'bridges_communities' END, CASE WHEN ka <> kb THEN 'crosses_layer:' || ka || '>' || kb END, CASE WHEN da = 1 AND db >= 5 THEN 'peripheral_to_hub' END], lambda r: r IS NOT NULL), ',') AS reasons FROM e WHERE ma <> mb AND ka <> kb ORDER BY db DESC, from_id, to_id LIMIT 25")
def orientation(t: Tables) -> DataFrame:
    d = settled(relational.degree(t.calls).select("id", "degree"))
    f = t.fn.select("id", "module", "kind").join(d, "id")
    a = f.select(F.col("id").alias("from_id"), F.col("module").alias("ma"), F.col("kind").alias("ka"), F.col("degree").alias("da"))
    b = f.select(F.col("id").alias("to_id"), F.col("module").alias("mb"), F.col("kind").alias("kb"), F.col("degree").alias("db"))
    e = t.calls.join(a, "from_id").join(b, "to_id").where("ma <> mb and ka <> kb")
    reasons = F.array_compact(F.array(F.when(F.col("ma") != F.col("mb"), "bridges_communities"), F.when(F.col("ka") != F.col("kb"), F.concat(F.lit("crosses_layer:"), "ka", F.lit(">"), "kb")), F.when((F.col("da") == 1) & (F.col("db") >= 5), "peripheral_to_hub")))
    return e.orderBy(F.desc("db"), "from_id", "to_id").limit(25).select("from_id", "to_id", F.array_join(reasons, ",").alias("reasons"))


@query("rank_shift", ", d AS (SELECT id, count(*) AS score FROM (SELECT from_id AS id FROM calls UNION ALL SELECT to_id FROM calls) x GROUP BY 1) SELECT d.id, rank() OVER (ORDER BY score DESC) AS group_rank, repo, rank() OVER (PARTITION BY repo ORDER BY score DESC) AS repo_rank FROM d JOIN fn USING (id)")
def rank_shift(t: Tables) -> DataFrame:
    d = settled(relational.degree(t.calls).select("id", F.col("degree").alias("score")))
    return rank.rank_shift(d, d.join(t.fn.select("id", "repo"), "id").select("id", "repo", "score"))


@query("important_first_stream", ", n AS (SELECT id, (row_number() OVER (ORDER BY price DESC, id) - 1) // 750 AS chunk FROM fn) SELECT from_id, to_id, greatest(a.chunk, b.chunk) AS chunk FROM calls JOIN n a ON a.id = from_id JOIN n b ON b.id = to_id")
def important_first_stream(t: Tables) -> DataFrame:
    return relational.chunk_stream(t.fn.select("id", F.col("price").alias("score")), t.calls, 750)[1]


@query("process_flow", ", s AS (SELECT id FROM fn WHERE kind = 'http_endpoint_definition'), r(path, last) AS (SELECT [id], id FROM s UNION ALL SELECT list_append(path, to_id), to_id FROM r JOIN calls ON from_id = last WHERE len(path) < 5 AND NOT list_contains(path, to_id)) SELECT array_to_string(path, '>') AS path, len(path)::INT AS steps, path[1] || ' → ' || path[-1] AS label FROM r WHERE len(path) >= 3 AND (len(path) = 5 OR NOT EXISTS (SELECT 1 FROM calls WHERE from_id = last AND NOT list_contains(path, to_id)))")
def process_flow(t: Tables) -> DataFrame:
    out = flow.chains(t.fn.where("kind = 'http_endpoint_definition'"), t.calls, 5, 3)
    return out.select(F.array_join("path", ">").alias("path"), "steps", F.concat(F.element_at("path", 1), F.lit(" → "), F.element_at("path", -1)).alias("label"))


@query("event_flow", ", g AS (SELECT event_type AS a, next_type AS b, count(*) AS n FROM steps WHERE next_type IS NOT NULL AND event_type <> next_type AND value > 50 GROUP BY 1, 2), k AS (SELECT a, b FROM g WHERE n >= (SELECT avg(n) FROM g)), r(path, last) AS (SELECT [t], t FROM (SELECT DISTINCT event_type AS t FROM events) x UNION ALL SELECT list_append(path, b), b FROM r JOIN k ON a = last WHERE len(path) < 4 AND NOT list_contains(path, b)) SELECT array_to_string(path, ',') AS chain, len(path)::INT AS channels FROM r WHERE len(path) >= 2 AND (len(path) = 4 OR NOT EXISTS (SELECT 1 FROM k WHERE a = last AND NOT list_contains(path, b)))")
def event_type_flow(t: Tables) -> DataFrame:
    g = t.steps.where("next_type is not null and event_type <> next_type and value > 50").groupBy(F.col("event_type").alias("from_id"), F.col("next_type").alias("to_id")).agg(F.count(F.lit(1)).alias("n"))
    k = g.crossJoin(F.broadcast(g.agg(F.avg("n").alias("mean")))).where("n >= mean")  # one row
    return flow.chains(t.events.select(F.col("event_type").alias("id")).distinct(), k, 4, 2).select(F.array_join("path", ",").alias("chain"), F.col("steps").alias("channels"))


#: Every event makes a function subscribe to a channel of its type, or publish to one.
_CHANNELS = "SELECT DISTINCT 'f' || user_id AS function, event_type || ':' || (event_id % 12) AS channel, event_id % 2 = 0 AS sends FROM {events}"


@query("event_flow_calls", f"""
, ev AS ({_CHANNELS.replace("{events}", "events")}),
r(channel, fn, hops) AS (SELECT channel, function, 0 FROM ev WHERE NOT sends UNION SELECT channel, to_id, hops + 1 FROM r JOIN calls ON from_id = fn WHERE hops < 2),
b AS (SELECT channel, fn, min(hops) AS hops FROM r GROUP BY 1, 2)
SELECT b.channel AS source, ev.channel AS target, (min(hops) + 1)::INT AS functions, count(*) AS publishers FROM b JOIN ev ON ev.function = b.fn AND ev.sends GROUP BY 1, 2""")
def event_flow_calls(t: Tables) -> DataFrame:
    """From channel to channel through subscribers and two calls of theirs at most."""
    events = loops.stored(t.sql(_CHANNELS))
    hops = event_flow.channel_hops(events.where("NOT sends"), events.where("sends"), t.calls, 2)
    return hops.select("source", "target", F.size("way").alias("functions"), "publishers")


@query("flow_dead_ends", "SELECT DISTINCT to_id AS id FROM calls WHERE to_id NOT IN (SELECT from_id FROM calls)")
def flow_dead_ends(t: Tables) -> DataFrame:
    ends = t.calls.select(F.col("to_id").alias("id")).distinct()
    return ends.join(t.calls.select(F.col("from_id").alias("id")), "id", "left_anti")


_EFFECT = ", s AS (SELECT id, ['db_read', 'db_write', 'http_out'][size % 3 + 1] AS effect, 0.7 + 0.1 * (key % 4) AS confidence FROM fn WHERE kind = 'SCOPE.Component'), r(id, effect, confidence, n) AS (SELECT id, effect, confidence::DOUBLE, 0 FROM s UNION ALL SELECT id, effect, max(confidence), max(n) FROM (SELECT from_id AS id, effect, confidence * 0.95 AS confidence, n + 1 AS n FROM r JOIN calls ON to_id = id WHERE confidence * 0.95 >= 0.5 AND n < 15) x GROUP BY 1, 2), b AS (SELECT id, effect, round(max(confidence), 9) AS confidence FROM r GROUP BY 1, 2)"


def _effects(t: Tables) -> DataFrame:
    kinds = F.array(F.lit("db_read"), F.lit("db_write"), F.lit("http_out"))
    seeds = t.fn.where("kind = 'SCOPE.Component'").select("id", F.element_at(kinds, (F.col("size") % 3 + 1).cast("int")).alias("effect"), (0.7 + 0.1 * (F.col("key") % 4)).alias("confidence"))
    return flow.propagate(seeds, t.calls).select("id", "effect", F.round("confidence", 9).alias("confidence"))


@query("effect_propagation", f"{_EFFECT} SELECT * FROM b")
def effect_propagation(t: Tables) -> DataFrame:
    return _effects(t)


@query("pure_functions", f"{_EFFECT} SELECT fn.id, max(b.confidence) IS NULL AS pure, coalesce(max(b.confidence), 0.3) AS confidence FROM fn LEFT JOIN b ON b.id = fn.id GROUP BY fn.id")
def pure_functions(t: Tables) -> DataFrame:
    return flow.pure(t.fn, _effects(t))


@query("taint_findings", ", so AS (SELECT id, CASE WHEN size % 2 = 0 THEN 'sql_injection' ELSE 'xss' END AS category FROM fn WHERE kind = 'http_endpoint_definition'), si AS (SELECT id, CASE WHEN size % 2 = 0 THEN 'sql_injection' ELSE 'xss' END AS category FROM fn WHERE kind = 'SCOPE.Component'), sa AS (SELECT id, 'xss' AS category FROM fn WHERE is_test), r(source, id, category, hops) AS (SELECT id, id, category, 0 FROM so WHERE NOT EXISTS (SELECT 1 FROM sa WHERE sa.id = so.id AND sa.category = so.category) UNION SELECT source, to_id, r.category, hops + 1 FROM r JOIN calls ON from_id = r.id WHERE hops < 4 AND NOT EXISTS (SELECT 1 FROM sa WHERE sa.id = to_id AND sa.category = r.category)), m AS (SELECT source, id, category, min(hops) AS hops FROM r GROUP BY 1, 2, 3) SELECT source, m.id AS sink, m.category, hops::INT AS hops, round(0.9 ^ hops, 6) AS confidence FROM m JOIN si ON si.id = m.id AND si.category = m.category WHERE 0.9 ^ hops >= 0.5")
def taint_findings(t: Tables) -> DataFrame:
    category = F.when(F.col("size") % 2 == 0, "sql_injection").otherwise("xss").alias("category")
    sources, sinks = t.fn.where("kind = 'http_endpoint_definition'").select("id", category), t.fn.where("kind = 'SCOPE.Component'").select("id", category)
    return flow.taint(sources, sinks, t.fn.where("is_test").select("id", F.lit("xss").alias("category")), t.calls)


@query("data_flows", ", so AS (SELECT id FROM fn WHERE kind = 'http_endpoint_definition'), r(field, id, hops) AS (SELECT id, id, 0 FROM so UNION SELECT field, to_id, hops + 1 FROM r JOIN calls ON from_id = id WHERE hops < 2) SELECT field, r.id AS sink, min(hops)::INT AS hops FROM r JOIN fn ON fn.id = r.id WHERE fn.kind = 'SCOPE.Component' GROUP BY 1, 2")
def data_flows(t: Tables) -> DataFrame:
    row = F.lit("f").alias("category")
    none = t.spark.createDataFrame([], "id string, category string")
    found = flow.taint(t.fn.where("kind = 'http_endpoint_definition'").select("id", row), t.fn.where("kind = 'SCOPE.Component'").select("id", row), none, t.calls, hops=2, floor=0.0)
    return found.select(F.col("source").alias("field"), "sink", "hops")


_PASSES = "SELECT c.from_id, c.to_id, 'p' || (b.key % 3) AS field, 'p' || (a.key % 3) AS renamed FROM {calls} AS c JOIN {fn} AS a ON a.id = c.from_id JOIN {fn} AS b ON b.id = c.to_id"
_DB = "SELECT DISTINCT i.from_id, i.to_id, CASE WHEN a.key % 3 = 0 THEN 'QUERIES' WHEN a.key % 3 = 1 THEN 'WRITES_TO' ELSE 'THROWS' END AS kind FROM {imports} AS i JOIN {fn} AS a ON a.id = i.from_id"
_HELD = "SELECT id AS function, field FROM {fn} AS f CROSS JOIN (SELECT 'p0' AS field UNION ALL SELECT 'p1' UNION ALL SELECT 'p2') AS x WHERE kind = 'http_endpoint_definition'"
_TAKEN = "SELECT id AS function, 'p' || (size % 3) AS field, name AS sink, 'http' AS sink_kind FROM {fn} AS f WHERE kind = 'SCOPE.Component'"


@query("data_flows_fields", f"""
, ps AS ({_PASSES.replace("{", "").replace("}", "")}), db AS ({_DB.replace("{", "").replace("}", "")}), so AS ({_HELD.replace("{", "").replace("}", "")}), si AS ({_TAKEN.replace("{", "").replace("}", "")}),
r(function, field, spot, held, hops) AS (SELECT function, field, function, field, 0 FROM so
  UNION SELECT r.function, r.field, ps.to_id, ps.renamed, r.hops + 1 FROM r JOIN ps ON ps.from_id = r.spot AND ps.field = r.held WHERE r.hops < 3),
b AS (SELECT function, field, spot, held, min(hops) AS hops FROM r GROUP BY 1, 2, 3, 4)
SELECT b.function, b.field, b.spot AS at, b.held, si.sink, si.sink_kind, 'sink' AS relation, b.hops::INT AS hops FROM b JOIN si ON si.function = b.spot AND si.field = b.held
UNION ALL SELECT b.function, b.field, b.spot, b.held, db.to_id, CASE WHEN db.kind = 'QUERIES' THEN 'db_read' ELSE 'db_write' END, db.kind, b.hops::INT FROM b JOIN db ON db.from_id = b.spot WHERE db.kind <> 'THROWS'""")
def data_flows_fields(t: Tables) -> DataFrame:
    """Request fields of all endpoints, renamed from call to call, to components that take them and to databases."""
    held, taken = t.sql(_HELD, fn=t.fn), t.sql(_TAKEN, fn=t.fn)
    return flow.data_flows(held, t.sql(_PASSES, fn=t.fn, calls=t.calls), taken, t.sql(_DB, fn=t.fn, imports=t.imports))


@query("confidence_decay", "SELECT s.source, h.hops::INT AS hops, round(base * rate ^ hops, 9) AS confidence FROM (VALUES ('direct_ast', 1.0, 0.95), ('import_hop', 0.9, 0.9), ('constant_prop', 0.85, 0.85), ('odd', 0.4, 0.95)) s(source, base, rate), (SELECT DISTINCT p_size % 5 AS hops FROM part) h")
def confidence_decay(t: Tables) -> DataFrame:
    sources = F.explode(F.array(*[F.lit(s) for s in ("direct_ast", "import_hop", "constant_prop", "odd")]))
    rows = t.part.select((F.col("p_size") % 5).alias("hops")).distinct().select(sources.alias("source"), "hops")
    return rows.select("source", "hops", F.round(flow.decayed(F.col("source"), F.col("hops")), 9).alias("confidence"))


@query("topology_tiers", "SELECT user_id, CASE WHEN count(*) FILTER (value > 90) > 0 AND count(*) FILTER (value < 10) > 0 THEN 'both' WHEN count(*) FILTER (value > 90) > 0 THEN 'producer' WHEN count(*) FILTER (value < 10) > 0 THEN 'consumer' ELSE 'idle' END AS tier FROM events GROUP BY 1")
def topology_tiers(t: Tables) -> DataFrame:
    p, c = F.max(F.col("value") > 90), F.max(F.col("value") < 10)
    return t.events.groupBy("user_id").agg(F.when(p & c, "both").when(p, "producer").when(c, "consumer").otherwise("idle").alias("tier"))


@query("migration_order", ", f AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y%m%d') || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') || '_change.rb' AS name FROM orders) SELECT id, regexp_extract(name, '^([0-9]{14})_', 1) AS version, lag(id) OVER (ORDER BY name) AS precedes FROM f")
def migration_order(t: Tables) -> DataFrame:
    name = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"), F.lit("_change.rb"))
    files = settled(relational.numbered(t.orders.select(F.col("o_orderkey").alias("id"), name.alias("name")), F.col("name"), F.col("id")))  # equal names by id
    before = files.select(F.col("id").alias("precedes"), (F.col("number") + 1).alias("number"))
    return files.join(before, "number", "left").select("id", F.regexp_extract("name", r"^([0-9]{14})_", 1).alias("version"), "precedes")


@query("find_paths_cross_repo", ", e AS (SELECT from_id, to_id FROM calls UNION SELECT to_id, from_id FROM imports), s AS (SELECT from_id AS a FROM e WHERE from_id <> to_id ORDER BY from_id LIMIT 1), z AS (SELECT max(to_id) AS b FROM e WHERE from_id = (SELECT a FROM s) AND to_id <> from_id), r(path, last) AS (SELECT [a], a FROM s UNION ALL SELECT list_append(path, to_id), to_id FROM r JOIN e ON from_id = last WHERE len(path) < 4 AND NOT list_contains(path, to_id) AND last <> (SELECT b FROM z)) SELECT array_to_string(path, '>') AS path, len(path)::INT - 1 AS hops, (SELECT count(DISTINCT repo) FROM fn WHERE list_contains(path, id)) > 1 AS crosses_repos FROM r WHERE last = (SELECT b FROM z)")
def find_paths_cross_repo(t: Tables) -> DataFrame:
    e = t.calls.withColumn("kind", F.lit("CALLS")).union(t.imports.distinct().withColumn("kind", F.lit("IMPLEMENTS")))
    both = settled(traverse.with_reversed(e, "IMPLEMENTS").where("kind <> 'IMPLEMENTS'"))
    start = both.where("from_id <> to_id").select("from_id").orderBy("from_id").first()[0]
    end = both.where((F.col("from_id") == start) & (F.col("to_id") != start)).agg(F.max("to_id")).first()[0]
    paths = traverse.simple_paths(both, start, end, 3)
    return traverse.crosses(paths, t.fn).select(F.array_join("path", ">").alias("path"), "hops", "crosses_repos")


@query("flow_list", ", s AS (SELECT id FROM fn WHERE kind = 'http_endpoint_definition'), r(path, last) AS (SELECT [id], id FROM s UNION ALL SELECT list_append(path, to_id), to_id FROM r JOIN calls ON from_id = last WHERE len(path) < 5 AND NOT list_contains(path, to_id)), w AS (SELECT path, len(path)::INT AS steps, path[1] || ' → ' || path[-1] AS label, (SELECT count(DISTINCT repo) FROM fn WHERE list_contains(path, id)) > 2 AS cross_stack FROM r WHERE len(path) = 5 OR NOT EXISTS (SELECT 1 FROM calls WHERE from_id = last AND NOT list_contains(path, to_id))) SELECT array_to_string(path, '>') AS path, steps, label, cross_stack, steps = 5 AS truncated FROM w WHERE steps >= 4 OR cross_stack ORDER BY steps DESC, label, path")
def flow_list(t: Tables) -> DataFrame:
    flows = flow.chains(t.fn.where("kind = 'http_endpoint_definition'"), t.calls, 5, 1)
    counted = traverse.crosses(flows.withColumnRenamed("steps", "hops"), t.fn).withColumn("cross_stack", F.col("repos") > 2)
    label = F.concat(F.element_at("path", 1), F.lit(" → "), F.element_at("path", -1)).alias("label")
    shown = counted.where("hops >= 4 or cross_stack").select(F.array_join("path", ">").alias("path"), F.col("hops").alias("steps"), label, "cross_stack", (F.col("hops") == 5).alias("truncated"))
    return shown


@query("reachability_summary", "SELECT CASE WHEN count(*) FILTER (size % 7 <> 0) = 0 THEN 'not computed' ELSE 'computed' END AS state, count(*) FILTER (size % 7 <> 0 AND id IN (SELECT to_id FROM tests)) AS tested, count(*) FILTER (size % 7 <> 0 AND id NOT IN (SELECT to_id FROM tests)) AS orphan FROM fn WHERE kind = 'http_endpoint_definition'")
def reachability_summary(t: Tables) -> DataFrame:
    hit = t.tests.select(F.col("to_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    rows = t.fn.where("kind = 'http_endpoint_definition'").join(hit, "id", "left").select(F.when(F.col("size") % 7 != 0, F.coalesce("hit", F.lit(False))).alias("reachable"))
    return rows.agg(F.when(F.max(F.col("reachable").isNotNull()), "computed").otherwise("not computed").alias("state"), F.count_if(F.col("reachable")).alias("tested"), F.count_if(~F.col("reachable")).alias("orphan"))


@query("import_aware_resolution", ", a AS (SELECT source_file AS file, min('al' || (key % 9)) AS alias, min(qualified_name) AS target FROM fn GROUP BY 1), x AS (SELECT DISTINCT source_file AS file, CASE key % 3 WHEN 0 THEN 'al' || (key % 9) WHEN 1 THEN qualified_name ELSE name END AS name FROM fn), b AS (SELECT name, min(id) AS id FROM fn GROUP BY name HAVING count(DISTINCT id) = 1) SELECT x.file, x.name, coalesce(f.id, q.id, b.id) AS id, CASE WHEN f.id IS NOT NULL THEN 'alias' WHEN q.id IS NOT NULL THEN 'qualified' WHEN b.id IS NOT NULL THEN 'bare' ELSE 'unresolved' END AS how FROM x LEFT JOIN a ON a.file = x.file AND a.alias = x.name LEFT JOIN fn f ON f.qualified_name = a.target LEFT JOIN fn q ON q.qualified_name = x.name LEFT JOIN b ON b.name = x.name")
def import_aware_resolution(t: Tables) -> DataFrame:
    k = F.col("key")
    al = F.concat(F.lit("al"), (k % 9).cast("string"))
    aliases = t.fn.groupBy(F.col("source_file").alias("file")).agg(F.min(al).alias("alias"), F.min("qualified_name").alias("target"))
    refs = t.fn.select(F.col("source_file").alias("file"), F.when(k % 3 == 0, al).when(k % 3 == 1, F.col("qualified_name")).otherwise(F.col("name")).alias("name")).distinct()
    return traverse.import_aware(refs, aliases, t.fn)
