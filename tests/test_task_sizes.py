"""Work is dealt over more tasks as tables grow: what one task holds, and what comes to the driver, doesn't follow the input."""

import pytest

from graphloom.plans import projection
from graphloom.plans.projection import Tables
from graphloom.sources import store

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(projection, "TASK_ROWS", 500)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_store_has_buckets_for_its_rows(spark, tmp_path):
    nodes = [(f"n{i:03d}",) for i in range(300)]
    edges = [(f"n{i % 300:03d}", "n007" if i % 2 else f"n{i * 7 % 300:03d}", "K") for i in range(1000)]
    g = store.write(spark.createDataFrame(nodes, "id string"), spark.createDataFrame(edges, "from_id string, to_id string, kind string"), str(tmp_path / "g"), bucket_rows=100, least=2)
    assert g.meta["buckets"] == 10 and rows(g.out) == rows(g.into.select("from_id", "to_id", "kind")) == sorted(edges)
    few = store.write(spark.createDataFrame(nodes, "id string"), spark.createDataFrame(edges, "from_id string, to_id string, kind string"), str(tmp_path / "few"), least=2)
    assert few.meta["buckets"] == 2


def test_lineitem_is_dealt_by_its_rows(spark, small_tasks):
    t = Tables(spark, SF)
    n = t.lineitem.count()
    assert t.dealt("lineitem", "l_orderkey").rdd.getNumPartitions() == -(-n // 500) > 4
    assert t.dealt("supplier", "s_suppkey").rdd.getNumPartitions() == t.supplier.rdd.getNumPartitions()
    assert rows(t.rel) == rows(t.sql(projection.REL))
    for name in ("calls", "imports", "tests"):
        assert rows(t.sql(projection.PROJECTIONS[name], lineitem=t.dealt("lineitem", "l_orderkey"))) == rows(t.sql(projection.PROJECTIONS[name]))


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


def test_degrees_are_dealt_over_more_tasks(spark, small_tasks):
    from graphloom.operators import relational

    t = Tables(spark, SF)
    dealt = relational.degree(t.rel, t.tasks("lineitem"))
    assert any("(id#" in line and f", {t.tasks('lineitem')})" in line for line in exchanges(dealt))
    assert rows(dealt) == rows(relational.degree(t.sql(projection.REL)))


def test_edges_of_a_search_are_dealt_over_more_tasks(spark, small_tasks):
    from graphloom.operators import traverse

    t = Tables(spark, SF)
    start = spark.createDataFrame([("region:1",)], "id string")
    assert rows(traverse.bfs(t.rel, start, 3, "in", local_edges=0, tasks=t.tasks("lineitem", 3))) == rows(traverse.impact(t.sql(projection.REL), start, 3))


@pytest.mark.parametrize("name", ["name_resolution"])
def test_names_are_not_broadcast(spark, name):
    from graphloom.plans import catalog

    assert not any("BroadcastExchange" in line for line in exchanges(catalog.queries()[name](spark, SF)))


def test_rounds_of_inheritance_are_not_broadcast(spark, monkeypatch):
    from graphloom.operators import link, loops

    plans, settled = [], loops.settled
    monkeypatch.setattr(loops, "settled", lambda df: plans.append(exchanges(df)) or settled(df))
    extends = spark.createDataFrame([("b", "a", 0), ("c", "b", 0), ("c", "a", 1)], "class string, base string, ordinal int")
    members = spark.createDataFrame([("a", "m"), ("a", "n"), ("b", "m")], "class string, member string")
    found = rows(link.inherited(extends, members))
    assert found == [("a", "m", "a", 0), ("a", "n", "a", 0), ("b", "m", "b", 0), ("b", "n", "a", 1), ("c", "m", "b", 1), ("c", "n", "a", 1)]
    assert len(plans) > 2 and not any("BroadcastExchange" in line for p in plans for line in p)


def test_orphans_are_one_join_over_more_tasks(spark, small_tasks, monkeypatch):
    from graphloom.plans import catalog

    dealt = catalog.queries()["orphan_audit"](spark, SF)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("LeftOuter") == 1 and "RepartitionByExpression" in plan
    monkeypatch.setattr(projection, "TASK_ROWS", 10**9)
    assert rows(dealt) == rows(catalog.queries()["orphan_audit"](spark, SF))


def test_scans_of_links_read_one_pass_and_no_store(spark, monkeypatch):
    import uuid

    from graphloom.plans import catalog

    monkeypatch.setattr(store, "write", lambda *a, **k: pytest.fail("a scan needs no buckets"))
    spark.__dict__.pop("_graphloom_kept", None)
    t = Tables(spark, SF)
    plan = t.sql(projection.LINKS, pairs=t.sql(projection.PAIRS), promo=t.sql(projection.PROMO))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
    for name in ("calls", "imports", "tests"):
        assert rows(getattr(t, name)) == rows(t.sql(projection.PROJECTIONS[name])) != []
    monkeypatch.setattr(projection, "TASK_ROWS", 500)
    spark.__dict__.pop("_graphloom_kept", None)
    assert all(rows(getattr(t, name)) == rows(t.sql(projection.PROJECTIONS[name])) for name in ("calls", "imports", "tests"))
    for name in ("intersect", "flow_dead_ends", "find_dead_code"):
        assert catalog.queries()[name](spark, SF).columns
    # a pair that IMPORTS repeats stays as often, in lots as well; CALLS and TESTS have it once, whatever part holds twice
    items = [(o, k, n, 1, q, 1.0, 0.0) for o in range(7) for n, (k, q) in enumerate([(1, 50.0), (2, 31.0), (3, 40.0), (1, 48.5), (3, 33.5), (1, None), (2, 49.0)])] + [(99, None, 0, 1, 50.0, 1.0, 0.0), (99, 2, 1, 1, 30.0, 1.0, 0.0), (99, 2, 2, 1, 50.0, 1.0, 0.0), (99, 2, 3, 1, 50.0, 1.0, 0.0)]
    lineitem = spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double")
    part = spark.createDataFrame([(1, "PROMO"), (3, "PROMO"), (3, "PROMO"), (2, "STANDARD")], "p_partkey long, p_type string")
    monkeypatch.setattr(Tables, "table", lambda self, name: {"lineitem": lineitem, "part": part}[name])
    monkeypatch.setattr(projection, "REPEATS", 3)
    folder = f"{projection.loops.shared_folder(spark)}/links-{uuid.uuid4().hex}"
    t._write_links(folder)
    found = spark.read.parquet(folder)
    for name in ("calls", "imports", "tests"):
        want = [tuple(r) for r in t.sql(projection.PROJECTIONS[name]).collect()]
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found.where(f"kind = '{name.upper()}'").select("from_id", "to_id").collect())


def test_kinds_at_both_ends_are_a_scan_and_no_store(spark, monkeypatch):
    from graphloom.operators import relational
    from graphloom.plans import catalog

    spark.__dict__.pop("_graphloom_kept", None)
    monkeypatch.setattr(store, "write", lambda *a, **k: pytest.fail("a scan needs no buckets"))
    few = rows(catalog.queries()["store_endpoint_kinds"](spark, SF))
    monkeypatch.setattr(projection, "TASK_ROWS", 500)
    assert few == rows(catalog.queries()["store_endpoint_kinds"](spark, SF)) != []
    edges = spark.createDataFrame([("a", "b", "K", 1), ("a", "b", "K", 2), ("a", None, "K", None), (None, "a", "L", None), ("gone", "twice", "L", 4)], "from_id string, to_id string, kind string, weight int")
    entities = spark.createDataFrame([("a", "A"), ("b", None), ("twice", "T"), ("twice", "T"), (None, "N")], "id string, kind string")
    for end in ("from_id", "to_id"):
        want = spark.sql("SELECT r.kind, e.kind AS entity_kind, count(*) AS n, sum(r.weight) AS weight FROM {r} r LEFT JOIN {e} e ON e.id = r." + end + " GROUP BY 1, 2", r=edges, e=entities)
        for tasks in (None, 7):
            assert sorted(map(str, want.collect())) == sorted(map(str, relational.endpoint_kinds(edges, entities, end, tasks).collect()))


def test_terms_are_counted_without_a_shuffle(spark, tmp_path):
    from collections import Counter

    from graphloom.operators import search

    docs = [(1, ["b", "a", "b", "b"]), (2, []), (3, None), (4, ["x"]), (4, ["x", "x"]), (5, ["é", "z", "é", "Z"] * 3)]
    df = spark.createDataFrame(docs, "id long, terms array<string>")
    assert not exchanges(search.counted(df))
    search.write_postings(df, str(tmp_path))
    want = sorted((t, i, n, len(terms)) for i, terms in docs for t, n in Counter(terms or []).items())
    assert rows(spark.read.parquet(f"{tmp_path}/postings").select("term", "id", "tf", "len")) == want
    assert spark.read.parquet(f"{tmp_path}/postings").schema["tf"].dataType.simpleString() == "bigint"
