import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import text
from graphloom.sources import readers, writers
from graphloom.streaming import debounce, incremental, windows

LCOV = "TN:\nSF:src/a.py\nDA:1,0\nDA:1,3\nDA:2,0\nXX:odd\nend_of_record\nDA:9,9\n"


def test_coverage_reports(spark, tmp_path):
    (tmp_path / "a.info").write_text(LCOV)
    (tmp_path / "b.xml").write_text('<coverage><packages><package><classes><class filename="src/b.py"><lines><line number="4" hits="2"/></lines></class></classes></package></packages></coverage>')
    (tmp_path / "c.xml").write_text('<report name="r"><package name="p"><sourcefile name="C.java"><line nr="7" mi="0" ci="3"/></sourcefile></package></report>')
    (tmp_path / "d.xml").write_text("<broken")
    got = sorted(tuple(r) for r in readers.read_coverage(spark, str(tmp_path)).collect())
    assert got == [("p/C.java", 7, 3, "jacoco"), ("src/a.py", 1, 3, "lcov"), ("src/a.py", 2, 0, "lcov"), ("src/b.py", 4, 2, "cobertura")]


def test_sections(spark, tmp_path):
    (tmp_path / "x.md").write_text("# One\nhello\n```\n# no\n```\n## Two\nbody\n# Three\n")
    got = [(r.depth, r.title, r["first"], r["last"]) for r in readers.read_markdown(spark, str(tmp_path)).orderBy("idx").collect()]
    assert got == [(1, "One", 1, 7), (2, "Two", 6, 7), (1, "Three", 8, 8)]


def test_records_and_graph_round_trip(spark, tmp_path):
    rows = [{"type": "entity", "id": "e1", "name": "n", "kind": "SCOPE.Operation", "confidence": 0}, {"type": "relationship", "id": "r", "from_id": "e1", "to_id": "e2", "kind": "CALLS"}, {"type": "error", "message": "x"}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    parts = readers.read_records(spark, str(tmp_path / "x.jsonl"))
    assert parts["entities"].select("id", schema.effective_confidence(F.col("confidence")).alias("c")).first() == ("e1", 1.0)
    assert parts["errors"].count() == 1
    for form in ("parquet", "json"):
        folder = str(tmp_path / form)
        writers.write_graph(parts["entities"], parts["relationships"], folder, form)
        e, r = readers.read_graph(spark, folder)
        assert e.first().id == "e1" and r.first().to_id == "e2"
    with pytest.raises(FileNotFoundError):
        readers.read_graph(spark, str(tmp_path / "none"))


def test_exports(spark, tmp_path):
    e = spark.createDataFrame([("a", "A & <b>", "SCOPE.Op"), ("b", "it's", "9x")], "id string, name string, kind string")
    r = spark.createDataFrame([("a", "b", "CALLS"), ("a", "gone", "CALLS")], "from_id string, to_id string, kind string")
    import xml.etree.ElementTree as ET

    doc = ET.fromstring("".join(x.line for x in writers.graphml(e, r).orderBy("part", "line").collect()).encode())
    assert len(list(doc.iter("{http://graphml.graphdrawing.org/xmlns}edge"))) == 2
    lines = [x.line for x in writers.cypher(e, r).collect()]
    assert "CREATE (:_9x {id: 'b', name: 'it\\'s'});" in lines and len(lines) == 4
    writers.write_lines(writers.cypher(e, r), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4
    nodes, kept = writers.grid(spark.createDataFrame([("a", 2), ("b", 1)], "id string, degree int"), r)
    assert writers.svg(nodes, kept).count("<line") == 1 and "<title>T&amp;</title>" in writers.svg_page(nodes, kept, "T&")


def test_tokenizers(spark):
    df = spark.createDataFrame([("unlockWithBiometrics",), ("HTTPServer",), ("soft_logout",), ("oauth2_Client",), ("v2Migrate",)], "s string")
    camel = {r.s: r.x for r in df.select("s", text.split_camel(F.col("s")).alias("x")).collect()}
    assert camel["HTTPServer"] == ["HTTP", "Server"] and camel["v2Migrate"] == ["v", "2", "Migrate"]
    got = {r.s: r.x for r in df.select("s", text.search_tokens(F.col("s")).alias("x")).collect()}
    assert got["unlockWithBiometrics"] == ["unlockwithbiometrics", "unlock", "with", "biometrics"]
    assert got["soft_logout"] == ["soft_logout", "soft", "logout"] and got["oauth2_Client"] == ["oauth2_client", "oauth2", "client"]
    keys = spark.createDataFrame([("CoreAdmin",), ("CORE_ADMIN",), ("HTTPServer",), ("page2Slug",)], "s string")
    assert [r[0] for r in keys.select(text.canonical_key(F.col("s"))).collect()] == ["core_admin", "core_admin", "http_server", "page_2_slug"]
    paths = spark.createDataFrame([("/api/v1/Orders/{id}/",), ("/v1/orders/:pk",), ("/orders/<int:pk>",), ("/api",)], "s string")
    assert [r[0] for r in paths.select(text.join_path(F.col("s"))).collect()] == ["/orders/{*}"] * 3 + ["/"]


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture
def events(spark, tmp_path):
    from datetime import datetime, timedelta

    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows, t = [], start
    for i in range(300):
        t += timedelta(minutes=rng.choice([1, 3, 10, 90]))
        rows.append((i, t, rng.randrange(4), rng.choice(["view", "click"]), float(i % 7), "{}"))
    rows.append((1000, t + timedelta(days=3), 99, "flush", 0.0, "{}"))
    rows.append((1001, t + timedelta(days=6), 99, "flush", 0.0, "{}"))
    for k in range(3):
        spark.createDataFrame(rows[k * 101 : (k + 1) * 101], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), tmp_path


def test_stream_equals_batch(spark, events):
    path, tmp = events
    batch = spark.read.parquet(path).where("event_type <> 'flush'")
    for name, f in (("tumble", lambda d: windows.tumbling(d, "1 hour", "12 hours")), ("session", lambda d: windows.sessions(d, "30 minutes", "12 hours"))):
        windows.run_once(f(windows.event_stream(spark, path)), name, str(tmp / name))
        got = sorted(tuple(r) for r in spark.table(name).collect() if r[1] != "flush" and r[0] != 99)
        assert got == sorted(tuple(r) for r in f(batch).collect())
    windows.run_once(windows.deduplicated(windows.event_stream(spark, path)), "dedup", str(tmp / "dedup"))
    assert spark.table("dedup").count() == spark.read.parquet(path).count()


def test_debounce_stream_equals_batch(spark, events):
    path, tmp = events
    gap, most = 20 * 60_000, 45 * 60_000
    windows.run_once(debounce.stream(windows.event_stream(spark, path, 100), gap, most, "12 hours"), "bounce", str(tmp / "bounce"))
    got = sorted(tuple(r) for r in spark.table("bounce").where("user_id <> 99").collect())
    want = sorted(tuple(r) for r in debounce.batch(spark.read.parquet(path).where("user_id <> 99"), gap, most).collect())
    assert got == want
    assert debounce.fire([0, 5, 10, 40, 41], 10, 100, None) == ([(0, 10, 3)], (40, 41, 2))
    assert debounce.fire([0, 5, 10, 15], 10, 12, None)[0] == [(0, 10, 3)]


def test_incremental(spark):
    e = spark.createDataFrame([("a", "f1", 1), ("b", "f2", 1), ("c", "f1", 1)], "id string, source_file string, v int")
    new = spark.createDataFrame([("a", "f1", 2), ("d", "f1", 2)], "id string, source_file string, v int")
    merged = incremental.merge_entities(e, new, spark.createDataFrame([("f1",)], "source_file string"))
    assert sorted(map(tuple, merged.collect())) == [("a", "f1", 2), ("b", "f2", 1), ("d", "f1", 2)]
    old = spark.createDataFrame([("a", "b", "CALLS"), ("c", "b", "CALLS")], "from_id string, to_id string, kind string")
    assert sorted(map(tuple, incremental.merge_edges(old, old.limit(0), merged).collect())) == [("a", "b", "CALLS")]
    h = incremental.content_hash(e, ["id", "v"]).first()
    assert h == incremental.content_hash(e.repartition(3).union(e), ["id", "v"]).first() != incremental.content_hash(new, ["id", "v"]).first()
    assert incremental.content_hash(e.limit(0), ["id", "v"]).first() == ("0:0", 0)
    alike = [[("a|b", "c")], [("a", "b|c")], [("a", None)], [(None, "a")], [("a", "")], [("a", "null")], [('a","t":"b', "c")], [("a", "b"), ("c", "d")], [("a", "d"), ("c", "b")]]
    assert len({incremental.content_hash(spark.createDataFrame(r, "s string, t string"), ["s", "t"]).first() for r in alike}) == len(alike)
    assert incremental.flows_affected(old) and not incremental.flows_affected(old.withColumn("kind", F.lit("MENTIONS")))
    assert incremental.full_rebuild(spark.range(60), 50) and not incremental.full_rebuild(spark.range(50), 50)


def test_a_stream_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from graphloom.operators import loops

    class Context:
        master = "spark://somewhere"
        _jsc = spark.sparkContext._jsc

    class Session:
        conf, sparkContext = spark.conf, Context()

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError, match="shared|share"):
            loops.shared_folder(Session())
    assert loops.shared_folder(spark)
