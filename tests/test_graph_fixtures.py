"""Tiny graphs with known answers, and invariance under the number of partitions."""

import pytest

from graphloom.operators import blocks, diff, flow, groups, link, quality, rank, relational, search, traverse


def edges(spark, pairs, kind="CALLS"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "from_id string, to_id string, kind string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_two_cycles_self_import_and_dangling(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("f", "f"), ("a", "gone")], "IMPORTS")
    nodes = ids(spark, *"abcdef")
    comp = groups.strong_components(nodes, e)
    assert {r.id: r.component for r in comp.collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c", "f": "f"}
    rank_ = spark.createDataFrame([("a", 0.1), ("b", 0.4), ("c", 0.3), ("d", 0.2), ("e", 0.9)], "id string, pagerank double")
    got = {r.members: (r["size"], r.edges, r.weak_from, r.weak_to, r.extract) for r in groups.cycles(comp, e, rank_).collect()}
    assert got == {"a,b": (2, 3, "a", "b", "b"), "c,d,e": (3, 3, "d", "e", "e")}, "parallel edges are listed"


def test_modules_hub_and_bottleneck(spark):
    m = spark.createDataFrame([("e1", "a"), ("e2", "a"), ("e3", "b"), ("e4", "c")], "id string, module string")
    got = {(r.from_module, r.to_module): r.weight for r in relational.module_edges(edges(spark, [("e1", "e2"), ("e1", "e3"), ("e2", "e3"), ("e3", "e4")]), m).collect()}
    assert got == {("a", "b"): 2, ("b", "c"): 1}
    hub = edges(spark, [(x, "h") for x in "abcd"])
    pr = {r.id: r.pagerank for r in rank.pagerank(ids(spark, *"abcdh"), hub).collect()}
    assert max(pr, key=pr.get) == "h" and abs(sum(pr.values()) - 1) < 1e-9
    assert {r.id: r.in_degree for r in relational.degree(hub).collect()}["h"] == 4
    bc = {r.id: r.betweenness for r in rank.betweenness(ids(spark, *"abcdm"), edges(spark, [("a", "m"), ("m", "b"), ("c", "m"), ("m", "d")])).collect()}
    assert bc == {"a": 0, "b": 0, "c": 0, "d": 0, "m": 4}


def test_sampled_betweenness_is_close_to_exact(spark):
    import random

    rng = random.Random(42)
    pairs = list({(f"n{rng.randrange(120)}", f"n{rng.randrange(6) if rng.random() < 0.4 else rng.randrange(120)}") for _ in range(500)})
    nodes, e = ids(spark, *{x for p in pairs for x in p}), edges(spark, pairs)
    top = lambda df: {r.id for r in df.orderBy("betweenness", ascending=False).limit(10).collect()}
    assert len(top(rank.betweenness(nodes, e)) & top(rank.betweenness(nodes, e, pivots=60))) >= 8


def test_change_impact_and_merge_risk(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("d", "e")])
    assert {r.id: r.depth for r in traverse.impact(e, ids(spark, "c")).collect()} == {"c": 0, "b": 1, "a": 2}
    assert {r.id for r in traverse.impact(e, ids(spark, "c"), 1).collect()} == {"c", "b"}
    refs = spark.createDataFrame([("r1", c) for c in (0, 2)] + [("r2", c) for c in (0, 3)] + [("r3", 9), ("r3", -1), ("r1", -1)], "ref string, community int")
    assert [tuple(r) for r in diff.merge_risk(refs).collect()] == [("r1", "r2", 1)]


def test_reachability_and_dead_code(spark):
    e = edges(spark, [("ep1", "handler"), ("handler", "helper"), ("main", "handler")])
    assert {r.id for r in traverse.unreached(ids(spark, "ep1", "handler", "helper", "main", "orphan"), e, ids(spark, "ep1", "main")).collect()} == {"orphan"}
    t = edges(spark, [("test", "only_tested"), ("app", "live")]).union(edges(spark, [("test", "also_tested")], "TESTS"))
    got = {r.id: r.reason for r in traverse.only_tests_inbound(ids(spark, "only_tested", "live", "also_tested", "lonely"), t, ids(spark, "test")).collect()}
    assert got == {"only_tested": "test_only_referenced", "also_tested": "test_only_referenced", "lonely": "isolated"}


def test_paths(spark):
    w = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("a", "c", 0.5), ("c", "a", 1.0), ("c", "d", 0.0)], "from_id string, to_id string, confidence double")
    got = {r.id: r.path for r in traverse.cheapest(w, "a", 5).collect()}
    assert got == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"]}
    assert sorted(r.path for r in traverse.simple_paths(w, "a", "c", 3).collect()) == [["a", "b", "c"], ["a", "c"]]


def test_communities_of_two_cliques(spark):
    pairs = [(f"{c}{i}", f"{c}{j}", 1) for c in "xy" for i in range(5) for j in range(i)] + [("x0", "y0", 1)]
    e = spark.createDataFrame(pairs, "from_id string, to_id string, weight int")
    nodes = ids(spark, *[f"{c}{i}" for c in "xy" for i in range(5)])
    got = groups.communities(nodes, e)
    assert {r.id: r.community for r in got.collect()} == {f"{c}{i}": f"{c}0" for c in "xy" for i in range(5)}
    q = groups.modularity(got, e).first()[0]
    single = groups.modularity(nodes.selectExpr("id", "id as community"), e).first()[0]
    assert q > 0.4 > single
    assert {r.id for r in blocks.articulation_points(nodes, e).collect()} == {"x0", "y0"}


def test_flows_effects_and_taint(spark):
    e = edges(spark, [("ep", "svc"), ("svc", "repo"), ("repo", "svc"), ("x", "y")])
    assert [r.path for r in flow.chains(ids(spark, "ep"), e, 6, 2).collect()] == [["ep", "svc", "repo"]]
    seeds = spark.createDataFrame([("repo", "db_write", 1.0)], "id string, effect string, confidence double")
    got = {r.id: round(r.confidence, 6) for r in flow.propagate(seeds, e).collect()}
    assert got == {"repo": 1.0, "svc": 0.95, "ep": 0.9025}
    assert {r.id: r.pure for r in flow.pure(ids(spark, "ep", "y"), flow.propagate(seeds, e)).collect()} == {"ep": False, "y": True}
    cat = lambda *n: spark.createDataFrame([(x, "sql_injection") for x in n], "id string, category string")
    none = cat("q").limit(0)
    assert [(r.sink, r.hops, r.confidence) for r in flow.taint(cat("ep"), cat("repo"), none, e).collect()] == [("repo", 2, 0.81)]
    assert flow.taint(cat("ep"), cat("repo"), cat("svc"), e).count() == 0, "a sanitizer of the category ends it"
    assert flow.taint(cat("y"), cat("repo"), none, e).count() == 0


def test_links(spark):
    ops = lambda rows: spark.createDataFrame(rows, "id string, repo string, key string")
    got = link.by_key(ops([("c1", "web", "Get"), ("c2", "web", "Get"), ("c3", "api", "Get")]), ops([("s1", "api", "Get"), ("s0", "api", "Get")]))
    assert [(r.source, r.target) for r in got.collect()] == [("c1", "s0")]
    models = spark.createDataFrame([(1, "a", "UserDto", ["firstName", "age"]), (2, "b", "user_dto", ["first_name", "age"]), (3, "b", "Other", ["x"])], "id int, repo string, name string, fields array<string>")
    assert [tuple(r) for r in link.same_as(models).collect()] == [(1, 2, 1.0, 0.98)]
    p = spark.createDataFrame([("k", "name"), ("k", "age")], "key string, field string")
    c = spark.createDataFrame([("k", "Name"), ("k", "email")], "key string, field string")
    assert [tuple(r) for r in diff.payload_drift(p, c).collect()] == [("k", "age", "email", "schema")]


def test_rank_fusion_order_and_floor(spark):
    s = lambda rows: spark.createDataFrame(rows, "id string, score double")
    got = search.fuse(s([("a", 2.0), ("c", 1.0)]), s([("b", 2.0), ("a", 1.0)])).orderBy("score", ascending=False).collect()
    assert (got[0].id, got[0].source) == ("a", "bm25+semantic")
    low = search.floored(s([("a", 0.1), ("b", 0.05)])).collect()
    assert [(r.id, r.low_confidence) for r in low] == [("a", True)]
    assert search.floored(s([("a", 0.1), ("b", 0.05)]), 0).count() == 2


def test_recall_and_trends(spark):
    expected = spark.createDataFrame([("a", "must"), ("b", "must"), ("c", "nice"), ("d", "forbidden")], "id string, level string")
    r = quality.recall(expected, ids(spark, "a", "d"), ["id"]).first()
    assert (r.recall, r.nice_found, r.forbidden_hits) == (0.5, 0, 1)
    h = spark.createDataFrame([("g", "2024-01-01 00:00:00", 1.0), ("g", "2024-01-05 00:00:00", None), ("g", "2024-01-20 00:00:00", 5.0), ("g", "2024-01-21 00:00:00", None)], "grp string, t string, value double").selectExpr("grp", "timestamp(t) as ts", "value")
    assert tuple(quality.metric_delta(h, 7).first()) == ("g", 5.0, None), "the reference entry's own value is null"


@pytest.mark.parametrize("n", [1, 7])
def test_results_do_not_depend_on_partitions(spark, n):
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        e = edges(spark, [(f"n{i}", f"n{(i * 7) % 40}") for i in range(40)] + [(f"n{i}", f"n{(i * 3 + 1) % 40}") for i in range(40)]).repartition(n)
        nodes = ids(spark, *[f"n{i}" for i in range(40)]).repartition(n)
        got = sorted((r.id, round(r.pagerank, 12)) for r in rank.pagerank(nodes, e, 5).collect()), sorted(map(tuple, groups.strong_components(nodes, e).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    kept = test_results_do_not_depend_on_partitions.__dict__.setdefault("kept", got)
    assert got == kept


def brute_scc(nodes, pairs):
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            reach[a] |= reach[b]
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize("local", [10**6, 3])
def test_components_locally_and_distributed(spark, local):
    import random

    rng = random.Random(5)
    names = [f"n{i:02}" for i in range(40)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(55)] + [("n01", "n02"), ("n02", "n03"), ("n03", "n01")]
    e, nodes = edges(spark, pairs), ids(spark, *names)
    assert {r.id: r.component for r in groups.strong_components(nodes, e, local).collect()} == brute_scc(names, pairs)
    both = brute_scc(names, pairs + [(b, a) for a, b in pairs])
    assert {r.id: r.component for r in groups.connected(nodes, e, local).collect()} == both


def test_a_chain_of_ten_thousand_nodes(spark):
    chain = [(f"c{i:05}", f"c{i + 1:05}") for i in range(9999)]
    e, nodes = edges(spark, chain), ids(spark, *[f"c{i:05}" for i in range(10_000)])
    assert groups.connected(nodes, e).select("component").distinct().count() == 1
    assert groups.strong_components(nodes, e).select("component").distinct().count() == 10_000
    assert groups.strong_components(nodes, edges(spark, [*chain, ("c09999", "c00000")])).select("component").distinct().count() == 1
    assert traverse.bfs(e, ids(spark, "c00000"), None).count() == 10_000
    assert traverse.unreached(nodes, e, ids(spark, "c00300")).count() == 300, "no live node of a long chain is dead"


def test_a_long_chain_distributed(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(39)]
    nodes = ids(spark, *[f"c{i:03}" for i in range(40)])
    assert groups.connected(nodes, edges(spark, chain), 0).select("component").distinct().count() == 1
    assert groups.strong_components(nodes, edges(spark, [*chain, ("c039", "c000")]), 10).select("component").distinct().count() == 1


def test_betweenness_ways_agree_and_cut_no_path(spark):
    import random

    rng = random.Random(8)
    pairs = [(f"b{rng.randrange(25)}", f"b{rng.randrange(25)}") for _ in range(50)] + [(f"d{i}", f"d{i + 1}") for i in range(20)]
    e, nodes = edges(spark, pairs), ids(spark, *{x for p in pairs for x in p})
    for pivots in (None, 9):
        one, two = ({r.id: round(r.betweenness, 9) for r in rank.betweenness(nodes, e, pivots, local).collect()} for local in (10**6, 0))
        assert one == two
    assert {r.id: r.betweenness for r in rank.betweenness(nodes, e).collect()}["d10"] == 100, "10 before it, 10 after it"


def test_community_rounds_agree_locally_and_distributed(spark):
    import random

    rng = random.Random(4)
    pairs = [(f"m{rng.randrange(4)}{a}", f"m{rng.randrange(4)}{rng.randrange(5)}", 1) for a in range(5) for _ in range(5)] + [(f"m{c}{a}", f"m{c}{b}", 2) for c in range(4) for a in range(5) for b in range(a)]
    e, nodes = spark.createDataFrame(pairs, "from_id string, to_id string, weight int"), ids(spark, *[f"m{c}{a}" for c in range(4) for a in range(5)])
    one, two = ({r.id: r.community for r in groups.communities(nodes, e, local_edges=n).collect()} for n in (10**6, 0))
    assert one == two and len(set(one.values())) == 4


def test_small_communities_are_noise(spark):
    pairs = [(f"{c}{i}", f"{c}{j}", 1) for c in "xy" for i in range(5) for j in range(i)] + [("z0", "z1", 1)]
    nodes = ids(spark, *[f"{c}{i}" for c in "xy" for i in range(5)], "z0", "z1", "alone")
    got = {r.id: r.community for r in groups.communities(nodes, spark.createDataFrame(pairs, "from_id string, to_id string, weight int"), least=3).collect()}
    assert got["z0"] == got["z1"] == got["alone"] == "-1" and got["x3"] == "x0" and got["y4"] == "y0"


def test_unbounded_search_never_stops_short(spark):
    chain = edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(6)])
    assert traverse.bfs(chain, ids(spark, "n0"), None).count() == 7
    assert traverse.bfs(chain, ids(spark, "n0"), None, local_edges=0).count() == 7
    assert sorted(traverse.bfs(chain, ids(spark, "n0", "n5"), 2, local_edges=0).collect()) == sorted(traverse.bfs(chain, ids(spark, "n0", "n5"), 2).collect())
    for local in (0, 100):
        with pytest.raises(Exception, match="did not settle"):
            traverse.bfs(chain, ids(spark, "n0"), None, most_rounds=3, local_edges=local).collect()
