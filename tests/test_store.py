"""The stored graph: round trip, pruned look-ups, joins without an exchange, hot ends."""

import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F

from graphloom.plans.projection import Tables
from graphloom.sources import store

SF = "/root/testdata/sf0.001"
ENTITIES = "id string, name string, kind string, community_id int, properties map<string,string>"


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store") / uuid.uuid4().hex)
    nodes = [(f"n{i:04d}", f"name {i}", "A" if i % 3 else "B", i if i % 2 else None, {"z": "1", "a": str(i), "m": "x"}) for i in range(500)]
    edges = [(f"n{i:04d}", f"n{(i * 7 + j) % 500:04d}", "CALLS" if j % 2 else "IMPORTS", 1) for i in range(500) for j in range(3)]
    edges += [(f"n{i:04d}", "n0042", "CALLS", 2) for i in range(500)] + [("gone", "n0001", "CALLS", 1), ("n0001", "missing", "CALLS", 1), ("n0001", "missing", "CALLS", 1)]
    entities, relationships = spark.createDataFrame(nodes, ENTITIES), spark.createDataFrame(edges, "from_id string, to_id string, kind string, weight int")
    return store.write(entities, relationships, folder, buckets=4, bucket_rows=200), nodes, edges


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_everything_comes_back(graph):
    g, nodes, edges = graph
    assert sorted((r.id, r.name, r.kind, r.community_id, r.properties) for r in g.entities.collect()) == nodes
    for df in (g.out, g.into, g.scan()):
        assert sorted(map(tuple, df.select("from_id", "to_id", "kind", "weight").collect())) == sorted(edges)
    assert sorted(r.to_id for r in g.scan("IMPORTS").collect()) == sorted(e[1] for e in edges if e[2] == "IMPORTS")
    assert (g.meta["entities"], g.meta["relationships"], g.meta["buckets"]) == (500, len(edges), 4)


def test_stored_rows_are_canonical(spark, graph):
    g, *_ = graph
    raw = spark.read.parquet(f"{g.folder}/entities")
    assert raw.where("community_id = -2").count() == 250 and raw.where("community_id IS NULL").count() == 0
    assert {tuple(r[0]) for r in raw.select(F.map_keys("properties")).collect()} == {("a", "m", "z")}


def bucket(file):
    return os.path.basename(file).split("_")[1].split(".")[0]


def read_files(df):
    """The files that a scan's tasks read."""
    return [f.filePath().toString() for p in df._jdf.queryExecution().toRdd().partitions() for f in p.files()]


def test_look_ups_read_one_bucket(graph):
    g, nodes, edges = graph
    for df, want in ((g.entity("n0007"), 1), (g.references("n0042"), sum(e[1] == "n0042" for e in edges)), (g.edges_of("n0001"), sum(e[0] == "n0001" for e in edges)), (g.references("n0042", "CALLS"), sum(e[1:3] == ("n0042", "CALLS") for e in edges))):
        assert "EqualTo(" in plan(df) and df.count() == want
        assert {bucket(f) for f in read_files(df)} == {bucket(r[0]) for r in df.select(F.input_file_name()).collect()}
    assert "PartitionFilters: [" in plan(g.references("n0042", "CALLS")) and "(kind#" in plan(g.references("n0042", "CALLS")).split("PartitionFilters: [")[1].split("]")[0]
    assert g.entity("nobody").count() == 0 and {r.kind for r in g.by_kind("B").collect()} == {"B"}


def test_an_absent_id_reads_no_row(spark, graph):
    g, *_ = graph
    df = g.entity("n0007x")  # inside the range of ids
    df.collect()
    found = df._jdf.queryExecution().executedPlan()
    while found.children().size():
        found = found.children().head()
    assert found.metrics().get("numOutputRows").get().value() == 0


def test_joins_with_both_ends_run_without_an_exchange(graph):
    g, nodes, edges = graph
    name = {n[0]: n[1] for n in nodes}
    for df, end, other in ((g.with_source("name"), 0, "from_name"), (g.with_target("name"), 1, "to_name")):
        assert "Exchange" not in plan(df) and "SortMergeJoin" in plan(df)
        assert sorted((r.from_id, r.to_id, r[other] or "") for r in df.collect()) == sorted((e[0], e[1], name.get(e[end], "")) for e in edges)


def test_a_hot_end_takes_several_files_and_others_one(graph):
    g, *_ = graph
    files = [os.path.basename(f) for f in glob.glob(f"{g.folder}/in/kind=CALLS/part-*.parquet")]
    per = {}
    for f in files:
        per.setdefault(f.split("_")[1].split(".")[0], []).append(f)
    assert len(per) == 4 and max(map(len, per.values())) > 1
    assert len(glob.glob(f"{g.folder}/entities/part-*.parquet")) == 4


def test_it_opens_again_and_only_if_whole(spark, graph, tmp_path):
    g, nodes, _ = graph
    for part in store.LAYOUT:
        spark.sql(f"DROP TABLE {store._name(g.folder, part)}")
    again = store.GraphStore(spark, g.folder)
    assert again.entities.count() == len(nodes) and again.entity("n0001").rdd.getNumPartitions() == 1 < again.entities.rdd.getNumPartitions()
    assert "Exchange" not in plan(again.with_target("name")) and again.references("n0042").count() > 500
    with pytest.raises(FileNotFoundError):
        store.GraphStore(spark, str(tmp_path))


def test_empty_graph_and_null_ends(spark, tmp_path):
    nothing = store.write(spark.createDataFrame([], "id string"), spark.createDataFrame([], "from_id string, to_id string, kind string"), str(tmp_path / "none"), buckets=2)
    assert nothing.entities.count() == nothing.with_source().count() == 0
    odd = store.write(spark.createDataFrame([("a",), (None,)], "id string"), spark.createDataFrame([(None, "a", "K"), ("a", None, None)], "from_id string, to_id string, kind string"), str(tmp_path / "odd"), buckets=2, bucket_rows=1)
    assert odd.entities.count() == odd.out.count() == odd.into.count() == 2


def test_the_projected_graph_is_written_once(spark):
    first, second = Tables(spark, SF).code, Tables(spark, SF).code
    assert first is second
    assert sorted(map(tuple, Tables(spark, SF).calls.collect())) == sorted((r.from_id, r.to_id) for r in first.out.where("kind = 'CALLS'").collect())
