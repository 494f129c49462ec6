"""Similarity joins against brute force; labels and models by their rules."""

import math
import random

import pytest

from graphloom.operators import link, similarity


def weights(sets):
    n, df = len(sets), {}
    for s in sets:
        for t in s:
            df[t] = df.get(t, 0) + 1
    return {t: round(math.log(1 + n / d) * 1_000_000) for t, d in df.items()}


def brute(rows, threshold):
    sets = sorted({tuple(sorted(set(r))) for r in rows if r}, key="\0".join)
    w = weights(sets)
    out = []
    for i, a in enumerate(sets):
        for b in sets[i + 1 :]:
            shared = sum(w[t] for t in set(a) & set(b))
            similar = shared / (sum(w[t] for t in a) + sum(w[t] for t in b) - shared)
            if similar >= threshold:
                out.append(("\0".join(a), "\0".join(b), round(similar, 9)))
    return sorted(out)


@pytest.mark.parametrize("threshold, most", [(0.3, 2000), (0.5, 3), (0.8, 1), (1.0, 2)])
def test_similar_sets_equal_brute_force(spark, threshold, most):
    rng = random.Random(7)
    rows = [[rng.choice(["hot", "hot", "user", "order", *"abcdefghij"]) for _ in range(rng.randrange(7))] for _ in range(120)] + [["hot", f"x{i}"] for i in range(30)]
    pairs, known = similarity.similar_sets(spark.createDataFrame([(r,) for r in rows], "tokens array<string>"), threshold, most)
    assert sorted((r.a, r.b, round(r.similarity, 9)) for r in pairs.collect()) == brute(rows, threshold)
    assert known.count() == len({tuple(sorted(set(r))) for r in rows if r})


@pytest.mark.parametrize("most", [1, 2, 5, 1000])
def test_pairs_of_a_dealt_key_come_once(spark, most):
    rows = [(i, "hot" if i % 3 else "cold", i * 2) for i in range(40)]
    got = similarity.self_pairs(spark.createDataFrame(rows, "id int, k string, v int"), "k", "id", most)
    want = sorted((a, b) for a, x, _ in rows for b, y, _ in rows if x == y and a < b)
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == want
    assert {(r.a_id, r.a_v) for r in got.collect()} <= {(i, v) for i, _, v in rows}


def test_empty_and_equal_sets(spark):
    for rows in ([], [[]], [["a", "a"]], [["a"], ["a"]]):
        pairs, _ = similarity.similar_sets(spark.createDataFrame([(r,) for r in rows], "tokens array<string>"), 0.5)
        assert pairs.count() == 0


ENTITIES = "id string, repo string, kind string, label string"


def links(spark, rows, compatible=None, **how):
    return sorted((r.source, r.target, r.score) for r in similarity.label_links(spark.createDataFrame(rows, ENTITIES), compatible or {}, **how).collect())


def test_labels_link_between_repositories_and_compatible_kinds(spark):
    rows = [("a", "web", "Class", "PaymentProcessor"), ("b", "api", "Class", "payment_processor"), ("c", "api", "Function", "PaymentProcessorService"), ("d", "web", "Class", "InvoicePrinter"), ("e", "api", "Table", "InvoicePrinter")]
    assert [x[:2] for x in links(spark, rows)] == [("a", "b")]
    assert [x[:2] for x in links(spark, rows, {("Function", "Class"): 0.9, ("Class", "Table"): 0.7})] == [("a", "b"), ("a", "c"), ("d", "e")]
    score = {x[:2]: x[2] for x in links(spark, rows, {("Function", "Class"): 0.9})}
    assert score["a", "b"] > score["a", "c"] >= 0.6


def test_copies_of_a_label_are_not_expanded(spark):
    rows = [(f"u{i:03d}", "web" if i % 2 else "api", "Class", "SessionKeeper") for i in range(200)]
    assert [x[:2] for x in links(spark, rows)] == [("u000", "u001")]


@pytest.mark.parametrize("label, want", [
    *((x, "") for x in ("buf", "ctx", "a", "map", "filter", "socket", "csv", "inactive", "pending", "footer", "body", "content", "data", "error")),
    *((x, "") for x in ("[error, setError]", "{ data }", "[year, month, day]", "{ x }", "_ab", "123abc", "!id", "error_handling:110", "function:1000")),
    ("_abcd", "_abcd"), ("custom", "custom"), ("identifier123", "identifier123"), ("createUser", "createuser"), ("AuthenticationService", "authentication"), ("ConnectionPool", "connectionpool"),
])
def test_labels_that_say_nothing(spark, label, want):
    df = spark.createDataFrame([(label,)], "label string")
    assert df.select(link.normal_label(df.label)).first()[0] == want
    assert bool(df.select(similarity.label_tokens(df.label)).first()[0]) == bool(want)


def test_models_of_shared_libraries_only(spark):
    rows = [(1, "py-shared", "Order", ["id", "user_id", "total_cents"], True), (2, "js-shared", "Order", ["id", "userId", "totalCents"], True), (3, "orders", "Order", ["id", "user_id", "total_cents"], False), (4, "js-shared", "Settings", ["x"], True), (5, "py-shared", "Settings", ["alpha"], True), (6, "py-shared", "Order", ["id", "user_id", "total_cents"], True)]
    models = spark.createDataFrame(rows, "id int, repo string, name string, fields array<string>, shared boolean")
    for most in (1, 2000):
        assert sorted(tuple(r) for r in link.same_as(models, 0.5, "shared", most).collect()) == [(1, 2, 1.0, 0.98), (2, 6, 1.0, 0.98)]
    assert len(link.same_as(models).collect()) == 5, "without the gate services take part"


@pytest.mark.parametrize("most", [1, 3, 2000])
def test_copies_of_a_model_meet_all_models_of_other_repositories(spark, tmp_path, most):
    rng = random.Random(3)
    rows = [(i, f"r{rng.randrange(3)}", rng.choice(["Order", "User"]), [rng.choice("abc") for _ in range(3)] + ["id"]) for i in range(60)]
    rows += [(100, None, "Order", ["id"]), (101, "r0", None, ["id"]), (102, "r0", "Order", None), (7, "r9", "Order", ["id", "a"])]
    spark.createDataFrame(rows, "id long, repo string, name string, fields array<string>").coalesce(1).write.parquet(f"{tmp_path}/models")
    got = link.same_as(spark.read.parquet(f"{tmp_path}/models"), 0.5, most=most)
    usable = [r for r in rows if None not in r]
    jaccard = lambda x, y: round(len(set(x) & set(y)) / len(set(x) | set(y)), 6)
    want = sorted((a, b, jaccard(f, g)) for a, r, n, f in usable for b, s, m, g in usable if n == m and r != s and a < b and jaccard(f, g) >= 0.5)
    assert sorted((r.a, r.b, r.overlap) for r in got.collect()) == want


def test_rows_dealt_in_blocks_are_never_broadcast(spark, tmp_path):
    spark.createDataFrame([(i, "hot") for i in range(40)], "id int, k string").coalesce(1).write.parquet(f"{tmp_path}/rows")
    plan = similarity.self_pairs(spark.read.parquet(f"{tmp_path}/rows"), "k", "id", 2)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [_key" in plan
