"""The name index and the stored postings: equal to scans, with pruned reads."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import name_index, search

PARTS = ["Get", "user", "Order", "_id", "map", "Été", "%", "aa", "x", "the", "ÄB"]


@pytest.fixture(scope="module")
def names(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(f"e{i}", "".join(rng.choices(PARTS, k=rng.randrange(1, 6)))) for i in range(400)]
    rows += [("e1", rows[1][1]), ("null", None), ("empty", ""), ("twice", "aaaaaa"), ("twice", "aaaaaa")]
    folder = str(tmp_path_factory.mktemp("names") / "index")
    name_index.write(spark.createDataFrame(rows, "id string, name string"), folder)
    return folder, rows


def brute(rows, query, limit):
    low, out = query.lower(), []
    for i, name in rows:
        if name is not None and low and low in name.lower():
            out.append((-3 if name.lower() == low else -2 if name.lower().startswith(low) else -1, name, i))
    return [(i, name, -s) for s, name, i in sorted(out)[:limit]]


@pytest.mark.parametrize("query", ["get", "USER", "er_i", "aaa", "aaaaaaa", "x", "té", "%", "_", "été%", "nothing here", "ÄB", "usero", ""])
@pytest.mark.parametrize("limit", [5, 1000])
def test_search_equals_a_scan(spark, names, query, limit):
    folder, rows = names
    assert [tuple(r) for r in name_index.search(spark, folder, query, limit).collect()] == brute(rows, query, limit)


@pytest.mark.parametrize("query", ["get", "er_i", "aaa", "x", "té", "", "zzz"])
def test_containing_equals_a_scan(spark, names, query):
    folder, rows = names
    assert sorted(map(tuple, name_index.containing(spark, folder, query).collect())) == sorted((i, n) for i, n in rows if n is not None and query.lower() in n.lower())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    """Rows that leave the scans of a collected query."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if kind == "FileSourceScanExec":
            total += p.metrics().get("numOutputRows").get().value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return total


def test_look_ups_prune_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select(F.concat(F.lit("e"), "id").alias("id"), F.concat(F.lower(F.hex("id")), F.lit("_fn")).alias("name"))
    folder = str(tmp_path / "many")
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    try:
        name_index.write(rows, folder)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    first = name_index.prefixed(spark, folder, "1a2b")
    assert "StringStartsWith(low,1a2b)" in plan(first) and scanned(first) < 40_000 and first.count() == 17
    inside = name_index.containing(spark, folder, "a2b_")
    assert "In(gram, [" in plan(inside) and {r.name for r in inside.collect()} == {f"{i:x}_fn" for i in range(200_000) if "a2b_" in f"{i:x}_fn"}
    everything = spark.read.parquet(f"{folder}/grams").count()
    assert scanned(inside) < everything / 2


def test_the_second_phase_runs_only_if_the_first_is_short(spark, names):
    folder, _ = names
    assert "grams" not in plan(name_index.search(spark, folder, "get", 3)) and "grams" in plan(name_index.search(spark, folder, "get", 1000))


def test_stored_postings_score_as_a_scan_does(spark, tmp_path):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(["Alpha", "beta", "gamma-7", "delta", ""], k=rng.randrange(9)))) for i in range(80)], "id int, text string")
    search.write_postings(docs.select("id", search.words_of(F.col("text")).alias("terms")), str(tmp_path / "post"))
    for terms in (["alpha", "7", "alpha"], ["nothing"], ["beta"]):
        got = {r.id: round(r.score, 9) for r in search.bm25_terms(*search.read_index(spark, str(tmp_path / "post")), terms).collect()}
        assert got == {r.id: round(r.score, 9) for r in search.bm25(docs, terms).collect()}
    assert search.bm25_terms(*search.read_index(spark, str(tmp_path / "post")), []).count() == 0


def test_find_in_one_call(spark, tmp_path):
    names = [("a", "load_user"), ("b", "save_user"), ("c", "render"), ("d", "helper"), ("e", "far")]
    entities = spark.createDataFrame([(i, n, 0 if i != "d" else 1) for i, n in names], "id string, name string, tier int")
    search.write_index(entities, str(tmp_path / "ix"), "name")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("c", [0.9, 0.1]), ("d", [0.0, 1.0])], "id string, embedding array<double>")
    edges = spark.createDataFrame([("a", "d"), ("d", "e")], "from_id string, to_id string")
    ask = lambda q, v, **how: [tuple(r) for r in search.find_fused(str(tmp_path / "ix"), vectors, entities, edges, q, v, **how).orderBy("used").collect()]
    got = ask("load_user", [1.0, 0.0], least=0.0)
    assert got[0][:2] == ("a", 1.0) and {r[0] for r in got} == {"a", "b", "c", "d", "e"} and [r[4] for r in got] == sorted(r[4] for r in got)
    assert [r[0] for r in ask("load_user", [], least=0.495)] == ["a", "d"], "a vector may be missing"
    assert [(r[0], r[3]) for r in ask("load_user", [1.0, 0.0], least=2.0)] == [("a", True)], "below the floor the best comes alone"
    assert [r[0] for r in ask("load_user", [1.0, 0.0], least=0.0, tokens=3)] == ["a"]
    assert ask("...", [], least=0.1) == []
