import hashlib
import math
import random

import pytest

from graphloom.llm import centroids

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, k, dim, rounds, scale=256):
    """The contract in unbounded integers: (vec_id, cluster, distance, cluster inertia, inertia, digest) of every row that takes part."""
    kept = [(i, [int(math.floor(x * scale)) if abs(x) < 1e290 else int(x) * scale for x in v]) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))][:k]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, one), j) for j, one in enumerate(c))
    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(of[j]) for x in zip(*of[j])] if j in of else one for j, one in enumerate(c)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, x, d in last if x == j) for j in range(len(c))}
    held = lambda x: x if x < 1 << 63 else None
    return sorted(((i, j, held(d), held(inertia[j]), held(sum(inertia.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in last), key=repr)


def found(spark, rows, schema=SCHEMA, **how):
    return sorted(map(tuple, centroids.cluster(spark.createDataFrame(rows, schema).repartition(3), **how).collect()), key=repr)


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e6, 1e9, 1e14])
def test_equals_brute_force_in_every_arithmetic(spark, scale):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, scale) for _ in range(6)], 0) for i in range(150)]
    assert found(spark, rows, k=7, dim=6, rounds=3) == brute(rows, 7, 6, 3)


def test_rows_of_all_sizes_in_one_block(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, rng.choice([1, 1e8, 1e12, 1e150, 1e305])) for _ in range(4)], 0) for i in range(60)]
    assert found(spark, rows, k=5, dim=4, rounds=2) == brute(rows, 5, 4, 2)


def test_rows_that_take_no_part_and_null_ids(spark):
    rows = [(1, [1.0, 2.0], 0), (2, None, 0), (3, [1.0, None], 0), (4, [1.0, float("nan")], 0), (5, [1.0, float("-inf")], 0), (6, [1.0], 0), (7, [1.0, 2.0, 3.0], 0), (8, [0.0, 0.0], 0), (None, [5.0, 5.0], 0), (None, [4.0, 5.0], 0)]
    got = found(spark, rows, k=3, dim=2, rounds=2)
    assert got == brute(rows, 3, 2, 2)
    assert {r[0] for r in got} == {1, 8, None}


def test_ties_go_to_the_smaller_number_and_repeats_count(spark):
    rows = [(i, [0.0, 1.0], 0) for i in range(8)] + [(3, [0.0, 1.0], 0)] * 300 + [(9, [-1.0, 0.5], 0)] * 2
    got = found(spark, rows, k=4, dim=2, rounds=3)
    assert got == brute(rows, 4, 2, 3)
    assert len(got) == 310


def test_floor_of_negative_means(spark):
    rows = [(i, [-0.01 * i, 0.003 * i], 0) for i in range(41)]
    assert found(spark, rows, k=2, dim=2, rounds=4) == brute(rows, 2, 2, 4)


def test_empty_and_clashing_columns(spark):
    assert found(spark, [], k=3, dim=2) == []
    assert found(spark, [(1, None, 0)], k=3, dim=2) == []
    rows = [(i, [float(i), 1.0], "x", b"y", 1) for i in range(5)]
    schema = "vec_id bigint, embedding array<double>, cluster string, data binary, ids int"
    assert found(spark, rows, schema, k=2, dim=2, rounds=1) == brute(rows, 2, 2, 1)


def test_float_embeddings_widen(spark):
    rows = [(i, [0.1 * i, 0.7], 0) for i in range(9)]
    narrow = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "CAST(embedding AS ARRAY<FLOAT>) AS embedding")
    wide = [(r[0], [float(x) for x in r[1]]) for r in narrow.collect()]
    assert sorted(map(tuple, centroids.cluster(narrow, k=3, dim=2, rounds=2).collect()), key=repr) == brute(wide, 3, 2, 2)
