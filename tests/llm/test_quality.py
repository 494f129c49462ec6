import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import quality

DOCS = "doc_id long, text string, score string, quality int"


def corpus(spark, n=400):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "river", "ran", "past", "old", "mills", "and", "on"]) for _ in range(40)) + "."
    bad = lambda: "!! ".join(rng.choice(["BUY", "NOW", "CHEAP", "CLICK"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad(), "clash", 7) for i in range(n)]
    docs = spark.createDataFrame([*rows, (n, None, "c", 1), (n + 1, "", "c", 1), (n + 2, "the " * 200_000, "c", 1), (0, rows[0][1], "c", 1), (None, "the river", "c", 1)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(n)] + [(3, None), (None, 1), (5, 1), (5, 1)], "doc_id long, quality int")
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(spark)
    out = quality.classify(docs, labels).collect()
    assert len(out) == 405
    held = [r for r in out if r.held_out and r.doc_id < 400]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    again = {(r.doc_id, r.score) for r in quality.classify(docs.repartition(7), labels.repartition(3)).collect()}
    assert again == {(r.doc_id, r.score) for r in out}, "the order of rows doesn't matter"


def test_score_is_the_sparse_dot_product(spark):
    docs, labels = corpus(spark, 60)
    weights, bias = quality.fit(docs, labels)
    for r in quality.score(docs, (weights, bias), "text").limit(30).collect():
        _, index, value = quality.features([r.text or ""])
        margin = bias + sum(float(weights[i]) * v for i, v in zip(index, value, strict=True))
        assert abs(r.score - 1 / (1 + np.exp(-margin))) < 1e-9


def brute_ftrl(docs, epochs):
    """Follow the regularised leader, coordinate by coordinate, over dictionaries."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= quality.L1:
            return 0.0
        return -(zi - (quality.L1 if zi > 0 else -quality.L1)) / ((quality.BETA + n.get(i, 0.0) ** 0.5) / quality.ALPHA + quality.L2)

    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            x, y = docs[k]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - s * w[i], n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_training_equals_brute_force():
    rng = np.random.default_rng(8)
    docs = [({**{int(i): float(np.float32(v)) for i, v in zip(rng.choice(200, 12, False), rng.random(12), strict=True)}, 256: 1.0}, int(rng.random() < 0.6)) for _ in range(80)]
    rows = [(np.array([i for i in x if i < 256], np.int32), np.array([v for i, v in x.items() if i < 256], np.float32), y) for x, y in docs]
    weights, bias = quality.train(rows, bits=8)
    want = brute_ftrl(docs, quality.EPOCHS)
    assert abs(bias - want[256]) < 1e-6 and all(abs(weights[i] - want.get(i, 0.0)) < 1e-6 for i in range(256))


def test_query_equals_brute_force(spark):
    """Score by counting n-grams one by one, on a small table, from labels outside the held-out fold."""
    docs, labels = corpus(spark, 90)
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id < 90").collect()}

    def vector(text):
        doc, index, value = quality.features([text])
        out = {}
        for i, v in zip(index.tolist(), value.tolist(), strict=True):
            out[i] = out.get(i, 0.0) + v
        return {i: float(np.float32(v)) for i, v in out.items()}

    order = sorted((d for d in texts if zlib.crc32(str(d).encode()) % 5), key=lambda d: (zlib.crc32(str(d).encode()), d))
    bias = 1 << quality.BITS
    want = brute_ftrl([({**vector(texts[d]), bias: 1.0}, int(d % 3 > 0)) for d in order], quality.EPOCHS)
    for r in quality.classify(docs, labels).where("doc_id < 90").collect():
        margin = want.get(bias, 0.0) + sum(want.get(i, 0.0) * v for i, v in vector(texts[r.doc_id]).items())
        assert abs(r.score - 1 / (1 + np.exp(-margin))) < 1e-5


def test_repeated_ids_and_the_byte_bound(spark):
    docs, labels = corpus(spark, 60)
    more = docs.unionByName(docs.where("doc_id < 9").withColumn("text", F.lit("another text of the same id")))
    one, two = quality.fit(more.repartition(5), labels), quality.fit(more.coalesce(1), labels)
    assert np.array_equal(one[0], two[0]) and one[1] == two[1]
    few = quality.fit(docs, labels, train_bytes=2000)
    assert 0 < np.count_nonzero(few[0]) < np.count_nonzero(quality.fit(docs, labels)[0])


def sparse_rows(texts, order, bits):
    """What the model is trained from: (ids, values, label) of each document."""
    out = []
    for d in order:
        _, index, value = quality.features([texts[d]], bits)
        ids, inverse = np.unique(index, return_inverse=True)
        out.append((ids.astype(np.int32), np.bincount(inverse, value, len(ids)).astype(np.float32), int(d % 3 > 0)))
    return out


def test_the_driver_gets_the_weights_but_no_features(spark):
    bits, rng = 14, random.Random(6)
    texts = {i: " ".join(f"{'abc'[i % 3]}{rng.randrange(10**6)}" for _ in range(2000)) for i in range(400)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in texts], "doc_id long, quality int")
    order = sorted((d for d in texts if zlib.crc32(str(d).encode()) % 5), key=lambda d: (zlib.crc32(str(d).encode()), d))
    rows = sparse_rows(texts, order, bits)
    sizes = np.cumsum([ids.nbytes + vals.nbytes for ids, vals, _ in rows])
    assert sizes[-1] > 8e6
    limits = spark.sparkContext._jsc.sc().conf()  # read anew by each job
    before = limits.get("spark.driver.maxResultSize", "1g")
    limits.set("spark.driver.maxResultSize", "2m")
    try:
        weights, bias = quality.fit(docs, labels, bits=bits)
    finally:
        limits.set("spark.driver.maxResultSize", before)
    want = quality.train(rows, bits)
    assert np.array_equal(weights, want[0]) and bias == want[1]
    for n in (0, 1, 100):  # the byte bound keeps a prefix of that order
        weights, bias = quality.fit(docs, labels, train_bytes=int(sizes[n]) - 1, bits=bits)
        want = quality.train(rows[:n], bits)
        assert np.array_equal(weights, want[0]) and bias == want[1]


def test_no_labels_and_empty(spark):
    docs, labels = corpus(spark, 10)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0
