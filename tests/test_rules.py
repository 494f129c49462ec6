"""Rules on tiny cases with known answers: search, links, processes, modules, orientation, exports, plug-ins."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import text
from graphloom.operators import diff, flow, link, rank, relational, search
from graphloom.sources import plugins, readers, writers
from graphloom.streaming import feed, incremental


def table(spark, columns, *rows):
    return spark.createDataFrame(list(rows), columns)


def hits(spark, entities, query, *columns):
    e = table(spark, "id string, name string, discriminators string", *[(*r, "")[:3] for r in entities])
    stats = e.select(F.size(search.tokens_of(F.concat_ws(" ", *columns))).alias("len")).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    found = search.bm25_postings(search.postings(e, *columns), stats, query).orderBy(F.desc("score"), "id").collect()
    return {r.id: r.score for r in found}


def test_sub_tokens_find_camel_case_names(spark):
    names = [("a", "fooBarBaz"), ("b", "fooQux"), ("c", "unrelated")]
    assert list(hits(spark, names, "bar", "name")) == ["a"]
    assert set(hits(spark, names, "foo", "name")) == {"a", "b"}
    assert list(hits(spark, names, "unrelated", "name")) == ["c"]
    full = hits(spark, [("full", "unlockWithBiometrics"), ("bio", "biometricsHelper"), ("door", "unlockDoor")], "unlockWithBiometrics", "name")
    assert next(iter(full)) == "full" and all(v < full["full"] for k, v in full.items() if k != "full")
    got = spark.range(1).select(search.tokens_of(F.lit("oauth2_Client")).alias("t")).first().t
    assert got[0] == "oauth2_client" and {"oauth2", "client"} <= set(got)


def test_discriminators_are_indexed(spark):
    rows = [("with", "processData", "checklistType=2"), ("without", "processData2", "")]
    assert next(iter(hits(spark, rows, "checklistType", "name", "discriminators"))) == "with"
    assert list(hits(spark, [("with", "handler", "status=periodic"), ("no", "otherHandler", "")], "periodic", "name", "discriminators")) == ["with"]
    assert hits(spark, rows, "2", "name", "discriminators") == {}, "one digit is no token"


def test_a_written_index_answers_as_the_table_does(spark, tmp_path):
    e = table(spark, "id string, name string", *[(f"e{i}", f"get{w}Item{i}") for i, w in enumerate("Alpha Beta Gamma Alpha".split())])
    search.write_index(e, str(tmp_path / "index"), "name")
    post, stats = search.read_index(spark, str(tmp_path / "index"))
    plan = post.where(F.col("term").isin("alpha"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan or "PushedFilters: [IsNotNull(term), EqualTo(term" in plan
    got = {r.id: round(r.score, 9) for r in search.bm25_postings(post, stats, "alpha").collect()}
    assert got == {k: round(v, 9) for k, v in hits(spark, [(f"e{i}", f"get{w}Item{i}") for i, w in enumerate("Alpha Beta Gamma Alpha".split())], "alpha", "name").items()} and set(got) == {"e0", "e3"}


def test_find_expands_sure_hits_only(spark):
    entities = table(spark, "id string, name string, tier int", *[(x, f"name_{x}", int(x == "b")) for x in "abcd"])
    edges = table(spark, "from_id string, to_id string", ("a", "c"), ("c", "d"))
    scores = table(spark, "id string, score double", ("a", 0.5), ("b", 0.9), ("d", 0.01))
    got = [(r.id, r.depth, r.low_confidence) for r in search.find(scores, entities, edges, 0.15).orderBy("used").collect()]
    assert got == [("a", 0, False), ("b", 0, False), ("c", 1, False)], "tiers come before scores, sub-floor hits go"
    got = [(r.id, r.low_confidence) for r in search.find(scores, entities, edges, 5.0).collect()]
    assert got == [("b", True)], "nothing is sure: one row, marked, and no neighbours"
    assert search.find(scores, entities, edges, 0.15, tokens=3).count() == 1


def test_http_strategies(spark):
    call = lambda *rows: table(spark, "id string, repo string, verb string, path string", *rows)
    calls = call(("exact", "web", "GET", "/users/{id}"), ("literal", "web", "GET", "/users/42"), ("suffix", "web", "POST", "/{apiUrl}/schedule/import"), ("twice", "web", "GET", "/{base}/a/b"), ("none", "web", "GET", "/x"))
    routes = call(("u", "api", "GET", "/api/v1/users/:id"), ("s", "api", "POST", "/schedule/import"), ("t1", "api", "GET", "/a/b"), ("t2", "other", "GET", "/a/b"))
    got = {r.source: (r.target, r.strategy, r.confidence) for r in link.http_links(calls, routes).collect()}
    assert got == {"exact": ("u", "exact", "resolved"), "literal": ("u", "literal_param_fill", "inferred"), "suffix": ("s", "dynamic_suffix_match", "inferred")}, "two routes fit 'twice': no guess"


def test_http_links_of_equal_calls_are_found_once(spark, monkeypatch):
    keys = []
    monkeypatch.setattr(link, "_linked", lambda c, r, by, f=link._linked: keys.append((by, c.count())) or f(c, r, by))
    call = lambda *rows: table(spark, "id string, repo string, verb string, path string", *rows)
    calls = call(*((f"c{i:02d}", "web", "GET", "/users/42" if i % 2 else "/users/{id}") for i in range(40)), ("c00", "web", "GET", "/users/42"), ("d", "web", "GET", "/users/7"), ("d", "web", "GET", "/users/7"), ("n", "web", "GET", None))
    routes = call(("u", "api", "GET", "/api/v1/users/:id"), ("v", "api", "GET", "/users/:id"), ("w", "other", "GET", "/users/7/x"))
    want = sorted([(f"c{i:02d}", "u", "literal_param_fill" if i % 2 else "exact") for i in range(40)] + [("d", "u", "literal_param_fill")])
    for most in (100, 0):
        monkeypatch.setattr(link, "LOCAL_LINKS", most)
        assert sorted((r.source, r.target, r.strategy) for r in link.http_links(calls, routes).collect()) == want
    assert keys[:2] == [("class", 3), ("id", 4)]


def test_dependency_usage_and_orphans(spark):
    declared = table(spark, "name string", ("react",), ("@org/ui",), ("left",), ("unused",))
    imported = table(spark, "target string", ("react/dom",), ("@org/ui/button",), ("pkg:left",), ("scope:component:import:external:ghost",), ("local/file",))
    got = {r["name"]: r.status for r in link.dependency_usage(declared, imported).collect()}
    assert got == {"react": "used", "@org/ui": "used", "left": "used", "unused": "unused", "ghost": "phantom"}
    fetches = table(spark, "caller string, url string, method string, key string", ("a", "/x", None, "/x"), ("a", "/x", None, "/x"), ("b", "${BASE}/y", "POST", "/y"), ("c", "/z", "GET", "/z"))
    ends = table(spark, "key string, side string", ("/z", "producer"), ("/x", "consumer"))
    assert sorted(map(tuple, link.orphan_callers(fetches, ends).collect())) == [("a", "/x", "GET", "no_handler_found"), ("b", "${BASE}/y", "POST", "dynamic_baseurl")]


def test_file_scope_coverage(spark):
    spans = table(spark, "id string, path string, first int, last int", ("f", "a.py", 2, 3), ("file", "a.py", 0, 0), ("odd", "a.py", 9, 4), ("bare", "a.py", 50, 60))
    lines = table(spark, "path string, line int, hits int", ("a.py", 2, 1), ("a.py", 3, 0), ("a.py", 7, 5))
    got = {r.id: (r.covered, r.instrumented) for r in link.span_coverage(spans, lines).collect()}
    assert got == {"f": (1, 2), "file": (2, 3), "odd": (2, 3)}, "a span without lines gives no row"


def test_names_resolve_in_order(spark):
    e = table(spark, "id string, qualified_name string, name string, repo string", ("1", "pkg.Svc.run", "run", "a"), ("2", "pkg.Other.run", "run", "b"), ("3", "pkg.Main", "Main", "a"))
    q = table(spark, "query string", ("1",), ("main",), ("RUN",), ("Svc.Run",), ("b::run",), ("nope",))
    got = {r.query: (r.tier, r.matches, r.id) for r in link.resolve_names(q, e).collect()}
    assert got == {"1": (1, 1, "1"), "main": (3, 1, "3"), "RUN": (3, 2, None), "Svc.Run": (4, 1, "1"), "b::run": (3, 1, "2")}
    calls = table(spark, "from_id string, to_id string", ("ghost", "3"), ("2", "3"))
    got = sorted((r.query, r.status, r.id) for r in link.find_callers(table(spark, "query string", ("MAIN",), ("run",)), e, calls).collect())
    assert got == [("MAIN", "caller", "2"), ("MAIN", "caller", "ghost"), ("run", "ambiguous", None)], "a caller without an entity counts"


def test_flows_root_at_endpoints(spark):
    entries = table(spark, "id string, name string, kind string", ("ep", "GET /x", "http_endpoint_definition"), ("h", "handler", "SCOPE.Operation"), ("job", "nightly", "SCOPE.ScheduledJob"), ("f", "helper", "SCOPE.Operation"))
    implements = table(spark, "endpoint string, handler string", ("ep", "h"))
    calls = table(spark, "from_id string, to_id string", ("job", "s"), ("s", "r"), ("f", "s2"))
    repos = table(spark, "id string, repo string", ("ep", "web"), ("h", "web"), ("job", "ops"), ("s", "web"), ("r", "web"), ("f", "web"))
    got = {(">".join(r.path), r.label, r.entry_kind, r.cross_stack) for r in flow.process_flows(entries, implements, calls, repos).collect()}
    assert got == {("ep>h", "GET /x", "http", False), ("job>s>r", "nightly", "scheduled", True)}, "a short flow stays if an endpoint is its root; its handler starts none"


def test_modules_prebaked_and_derived(spark):
    edges, modules = table(spark, "from_id string, to_id string", ("a", "b")), table(spark, "id string, module string", ("a", "A"), ("b", "B"))
    stored = table(spark, "from_module string, to_module string, weight int", ("A", "B", 7), ("A", "_external", 3), ("A", "A", 2))
    assert [tuple(r) for r in relational.module_edges(edges, modules, stored).collect()] == [("A", "B", 7)]
    assert [tuple(r) for r in relational.module_edges(edges, modules, stored.limit(0)).collect()] == [("A", "B", 1)]
    files = ["package.json", "src/app/ui/index.ts", "src/app/ui/deep/x.ts", "src/app/api/y.ts", "top.py", "lib/a.py", "src/app/ui/deep/more/go.mod"]
    got = {r.path: r.module for r in relational.derived_modules(table(spark, "path string", *[(f,) for f in files])).collect()}
    assert got == {"package.json": "_root", "src/app/ui/index.ts": "src/app/ui", "src/app/ui/deep/x.ts": "src/app/ui", "src/app/api/y.ts": "src/app", "top.py": "_root", "lib/a.py": "_root", "src/app/ui/deep/more/go.mod": "src/app/ui"}


def test_orientation(spark):
    scores = table(spark, "id string, degree int, betweenness double", ("hub", 5, 9.0), ("repo", 2, 4.0), ("leaf", 1, 0.0), ("orphan", 0, 0.0))
    got = [r.id for r in rank.key_entities(scores).collect()]
    assert got == ["hub", "repo", "leaf"]
    edges = table(spark, "from_id string, to_id string, confidence double", ("hub", "repo", 1.0), ("hub", "leaf", 0.4))
    groups = table(spark, "id string, community int", ("hub", 0), ("repo", 1), ("leaf", 0), ("orphan", -1))
    got = sorted((r.kind, r.id) for r in rank.questions(scores, edges, groups).collect())
    assert got == [("ambiguous_edge", "hub"), ("bridge", "hub"), ("isolated", "orphan")]


def test_conventions_and_blind_sides(spark):
    members = table(spark, "side string, key string", ("l", "a_b"), ("l", "c_d"), ("l", "e-f"), ("r", "aB"), ("r", "x"))
    got = {(r.side, r.key): (r.convention, r.dominant) for r in diff.separators(members).collect()}
    assert got == {("l", "e-f"): ("-", "_"), ("r", "x"): ("plain", "camel")}
    side = lambda *rows: table(spark, "endpoint string, status int, resolved boolean", *rows)
    blind = diff.unresolved_shapes(side(("e", 200, False), ("e", 404, True)), side(("e", 200, True), ("e", 404, True)))
    assert [tuple(r) for r in blind.collect()] == [("e", 200, "left")]
    shapes = table(spark, "endpoint string, status int, field string", ("e", 200, "x"), ("e", 404, "y"))
    assert [r.status for r in diff.resolved_only(shapes, blind).collect()] == [404]


def test_embed_text_and_hashes(spark):
    body = "é" * 700
    df = table(spark, "n string, s string, b string", ("name", "sig()", body), ("name", "sig()", "short"))
    got = [r.t for r in df.select(text.embed_text(F.col("n"), F.col("s"), F.col("b")).alias("t")).collect()]
    assert len(got[0].encode()) <= 1200 and got[0].startswith("name\nsig()\né") and set(got[0][11:]) == {"é"} and len(got[0].encode()) >= 1198
    assert got[1] == "name\nsig()\nshort"
    assert spark.range(1).select(text.fnv1a(F.lit("")).alias("a"), text.fnv1a(F.lit("a")).alias("b"), text.fnv1a(F.lit("foobar")).alias("c")).first() == (0x811C9DC5, 0xE40C292C, 0xBF9CF968)


def test_exports_and_sidecars(spark, tmp_path):
    e = table(spark, "id string, name string, kind string, source_file string, start_line int", ("a<", "n", "SCOPE.Operation", "x.py", 3))
    r = table(spark, "from_id string, to_id string, kind string", ("a<", "gone", "CALLS"))
    lines = [x.line for x in writers.graphml(e, r).orderBy("part").collect()]
    want = spark.range(1).select(schema.relationship_id(F.lit("a<"), F.lit("gone"), F.lit("CALLS"))).first()[0]
    assert '<data key="file">x.py</data><data key="line">3</data>' in lines[1] and f'<edge id="{want}" source="a&lt;" target="gone">' in lines[2]
    writers.write_stats(e, r, str(tmp_path))
    stats = spark.read.json(str(tmp_path / "stats.json")).first()
    assert stats.entities == 1 and stats.relationship_kinds.CALLS == 1
    log = str(tmp_path / "findings")
    writers.save_finding(spark, log, {"title": "x"})
    writers.save_finding(spark, log, {"title": "y", "type": "bug"})
    assert sorted(json.loads(x.value)["type"] for x in spark.read.text(log).collect()) == ["bug", "note"]
    (tmp_path / "groups.json").write_text(json.dumps({"groups": [{"name": "g", "repos": [{"name": "a", "path": "/a"}, {"name": "b", "path": "/b"}]}]}))
    assert sorted(map(tuple, readers.registry(spark, str(tmp_path / "groups.json")).collect())) == [("g", "a", "/a"), ("g", "b", "/b")]
    report = "SF:a.py\nDA:1,1\nDA:2,0\nLF:9\nLH:4\nend_of_record\nSF:b.py\nDA:1,1\nend_of_record\n"
    assert readers.lcov_totals(report) == [("a.py", 9, 4), ("b.py", 1, 1)]


def test_fields_at_any_depth(spark):
    df = table(spark, "id string, a struct<x: int, y: int>, items array<struct<x: int, z: int>>, total int", ("1", (1, 2), [(3, 4)], 9))
    got = relational.fields(df, ["a", "items", "x"], envelope=("total",))
    assert got.schema.simpleString() == "struct<a:struct<x:int>,items:array<struct<x:int>>,total:int>"
    assert got.first().asDict(True) == {"a": {"x": 1}, "items": [{"x": 3}], "total": 9}


def test_places_in_a_total_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id").alias("v")).repartition(7)
    got = relational.numbered(df, F.desc("k"), F.col("v")).collect()
    assert sorted((r.number, r.k) for r in got) == [(i, 999 - i) for i in range(1000)]
    assert relational.numbered(df.limit(0), F.col("k")).count() == 0


def test_noise_by_id_and_provenance(spark):
    df = table(spark, "id string, name string, kind string, line int, provenance string", ("x:proc:1", "Login → map", "SCOPE.Operation", 5, None), ("y", "Login → map", "SCOPE.Operation", 5, None), ("z", "Base.run", "SCOPE.Operation", 5, "INFERRED_FROM_CLASS_HIERARCHY"))
    kind = relational.noise(F.col("name"), F.col("kind"), F.lit(""), F.lit("a.py"), F.col("line"), F.lit("q"), F.lit("false"), F.col("id"), F.col("provenance"))
    assert [r.k for r in df.select(kind.alias("k")).collect()] == ["process", "none", "shadow"]


def test_plug_ins(spark, tmp_path):
    files = table(spark, "path string, content string", ("a.txt", "one two"), ("b.txt", "boom"), ("c.txt", None))

    def words(path, content):
        if content == "boom":
            raise ValueError("no")
        return [{"type": "entity", "id": w, "name": w} for w in content.split()]

    out = plugins.extract(files, words)
    assert sorted(r.id for r in plugins.records(out, "entity", "id string, name string").collect()) == ["one", "two"]
    assert [r.path for r in out.where("type = 'error'").collect()] == ["b.txt"]
    refs = table(spark, "key string", ("k1",), ("k2",), ("k3",))
    got = plugins.resolve(refs, [("exact", table(spark, "key string, target string", ("k1", "t1"))), ("guess", table(spark, "key string, target string", ("k1", "t0"), ("k2", "t2")))])
    assert sorted((r.key, r.target, r.resolver) for r in got.collect()) == [("k1", "t1", "exact"), ("k2", "t2", "guess"), ("k3", None, None)]
    extends, members = table(spark, "class string, base string, ordinal int", ("C", "View", 0)), table(spark, "class string, member string", ("C", "own"))
    whole = plugins.with_packs(extends, members, table(spark, "base string, member string", ("View", "get"), ("Other", "x")))
    assert sorted((r["class"], r.member, r.definer) for r in link.inherited(extends, whole).collect()) == [("C", "get", "View"), ("C", "own", "C"), ("View", "get", "View")]
    texts = table(spark, "id string, text string", ("a", "xx"), ("b", None))
    vectors = plugins.embed(texts, lambda ts: [[float(len(t)), 1.0] for t in ts], 2)
    assert sorted((r.id, list(r.embedding)) for r in vectors.collect()) == [("a", [2.0, 1.0]), ("b", [0.0, 1.0])]
    with pytest.raises(Exception, match="must give 3 numbers"):
        plugins.embed(texts, lambda ts: [[1.0]] * len(ts), 3).collect()
    search.write_vectors(vectors, str(tmp_path / "store"), "m1", 2)
    assert search.read_vectors(spark, str(tmp_path / "store"), "m1", 2).count() == 2
    assert search.read_vectors(spark, str(tmp_path / "store"), "m1", 3) is None and search.read_vectors(spark, str(tmp_path / "store"), "m2", 2) is None


def test_unchanged_inputs_are_not_computed_again(spark, tmp_path):
    ran = []
    build = lambda: (ran.append(1), spark.range(3))[1]
    for _ in range(2):
        assert incremental.reused(spark, str(tmp_path / "results"), "abc", build).count() == 3
    assert len(ran) == 1
    assert incremental.reused(spark, str(tmp_path / "results"), "def", build).count() == 3 and len(ran) == 2


def test_feed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"x": 1}\n{"x": 2}\n')
    stream = spark.readStream.schema("x int").json(str(tmp_path / "in"))
    feed.publish(stream, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.row.x for r in feed.since(spark, str(tmp_path / "log"), -1).collect()) == [1, 2]
    (tmp_path / "in" / "b.json").write_text('{"x": 3}\n')
    feed.publish(stream, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    assert [r.row.x for r in feed.since(spark, str(tmp_path / "log"), 0).collect()] == [3]
