"""Field-sensitive data flows: renames, database relationships as sinks, hop bound."""

import random

import pytest

from graphloom.operators import flow


def found(spark, sources=(), passes=(), sinks=(), edges=(), **how):
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    got = flow.data_flows(df(sources, "function string, field string"), df(passes, "from_id string, to_id string, field string, renamed string"), df(sinks, "function string, field string, sink string, sink_kind string"), df(edges, "from_id string, to_id string, kind string"), **how)
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("kind, does", [("JOINS_COLLECTION", "db_read"), ("READS_FROM", "db_read"), ("WRITES_TO", "db_write"), ("QUERIES", "db_read"), ("ACCESSES_TABLE", "db_read"), ("MODIFIES_TABLE", "db_write"), ("GRAPH_RELATES", "db_read"), ("THROWS", None)])
def test_relationships_that_reach_a_database(spark, kind, does):
    edges = [("da1", "Class:Inspection", kind)]
    want = [("da1", "id", "da1", "id", "Class:Inspection", does, kind, 0)] if does else []
    assert found(spark, [("da1", "id")], edges=edges, sink_kind="db") == want
    assert found(spark, [("da1", "id")], edges=edges, sink_kind="http") == []
    assert [r.sink_kind for r in flow.db_sinks(spark.createDataFrame(edges, "from_id string, to_id string, kind string")).collect()] == ([does] if does else [])


def test_only_the_field_that_is_handed_on_arrives(spark):
    passes = [("ep", "svc", "email", "to"), ("svc", "mail", "to", "address"), ("svc", "log", "body", "line")]
    sinks = [("mail", "address", "smtp", "http"), ("log", "line", "file", "fs_write"), ("mail", "subject", "smtp", "http")]
    assert found(spark, [("ep", "email"), ("ep", "name")], passes, sinks) == [("ep", "email", "mail", "address", "smtp", "http", "sink", 2)]
    assert found(spark, [("ep", "email")], passes, sinks, hops=1) == []


def test_cycles_empty_tables_and_repeats(spark):
    loop = [("a", "b", "x", "y"), ("b", "a", "y", "x"), ("a", "b", "x", "y")]
    assert found(spark, [("a", "x")] * 3, loop, [("b", "y", "s", "http")] * 2) == [("a", "x", "b", "y", "s", "http", "sink", 1)]
    assert found(spark) == []


def test_random_graphs_equal_a_search(spark):
    rng = random.Random(1)
    f, x = (lambda: f"f{rng.randrange(12)}"), (lambda: f"x{rng.randrange(3)}")
    sources, passes = [(f(), x()) for _ in range(6)], [(f(), f(), x(), x()) for _ in range(50)]
    sinks, edges = [(f(), x(), f"s{i}", "http") for i in range(10)], [(f(), f"t{i}", rng.choice(["QUERIES", "THROWS"])) for i in range(10)]
    want = set()
    for fn, field in set(sources):
        depth = {(fn, field): 0}
        for d in range(3):
            depth |= {(b, to): d + 1 for a, b, held, to in passes if depth.get((a, held)) == d and (b, to) not in depth}
        for (at, held), d in depth.items():
            want |= {(fn, field, at, held, s, k, "sink", d) for g, y, s, k in sinks if (g, y) == (at, held)}
            want |= {(fn, field, at, held, to, "db_read", k, d) for g, to, k in edges if g == at and k == "QUERIES"}
    assert found(spark, sources, passes, sinks, edges) == sorted(want)
