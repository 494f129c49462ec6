import numpy as np
import pytest

from graphloom.llm import ann, vector_dedup

VECTORS = "vec_id long, embedding array<float>, label int, cell long, n long"
NAN = float("nan")


def vectors(spark, n=1200, dim=16):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.2, 1.0], n)[:, None]
    x = x.astype(np.float32)
    x[500:700] = x[500]  # a large group of equal vectors
    rows = [(i, x[i].tolist(), 0, 1, 2) for i in range(n)]
    odd = [(5000, None), (5100, [0.0] * dim), (5200, [NAN] * dim), (5300, [None] * dim), (5400, [float("inf")] * dim), (5500, []), (5600, [1.0] * 8), (5601, [1.0] * 8)]
    rows += [(i, v, 0, 1, 2) for i, v in odd] + [(700, x[700].tolist(), 0, 1, 2)]
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def table(df):
    return sorted(((r.vec_id, None if r.embedding is None else tuple(r.embedding)) for r in df.collect()), key=str)


def ok(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)


@pytest.mark.parametrize("depth", [12, 1])
def test_nearest_against_brute_force(spark, monkeypatch, depth):
    """depth 1: two cells, each of which is dealt as several blocks."""
    monkeypatch.setattr(ann, "MAX_DEPTH", depth)
    df = vectors(spark)
    rows = [(i, np.array(v)) for i, v in table(df) if ok(v)]
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), cell_rows=200, leaf_rows=16).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = total = 0
    for q, v in rows:
        if q % 20:
            continue
        want = sorted((float(np.sqrt(((v - u) ** 2).sum())), i) for i, u in rows if i != q and len(u) == len(v))[:10]
        have = [got.get(q, {})[k] for k in sorted(got.get(q, {}))]
        assert len(have) == len(want)
        assert have == sorted(have, key=lambda x: (x[1], x[0]))
        by_id = dict((i, d) for d, i in [(float(np.sqrt(((v - u) ** 2).sum())), i) for i, u in rows if i != q and len(u) == len(v)])
        assert all(abs(by_id[i] - s) < 1e-9 for i, s in have)
        hits += len({i for _, i in want} & {i for i, _ in have})
        total += len(want)
    assert set(got) == {q for q, _ in rows if q % 20 == 0}
    assert hits / total >= 0.97
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_ties_at_the_last_rank_go_to_smaller_ids(spark):
    """24 points at one distance from a query, each of them twice, in rows of many partitions."""
    rows = [(100, [0.5, 0.5, 0.5, 0.5] + [0.0] * 20)] + [(i + 24 * c, [0.5, 0.5, 0.5, 0.5] + [3.0 if j == i % 20 else 0.0 for j in range(20)]) for i in range(20) for c in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    out = sorted((r["rank"], r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id = 100"), cell_rows=8, leaf_rows=2).collect())
    assert out == [(k + 1, i, 3.0) for k, i in enumerate(sorted(i for i, _ in rows if i != 100)[:10])]


def test_chi_square():
    assert abs(ann.chi_square_quantile(8, 0.95) - 15.507) < 1e-3 and abs(ann.chi_square_quantile(2, 0.5) - 1.386) < 1e-3


@pytest.mark.parametrize("bucket", [4096, 40])
def test_dedup_against_brute_force(spark, bucket):
    df = vectors(spark)
    rows = table(df)
    good = [(i, np.array(v)) for i, v in rows if ok(v)]
    n, root = {}, list(range(len(good)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    counts = np.zeros(len(good), int)
    for d in (8, 16):
        at = [k for k, (_, v) in enumerate(good) if len(v) == d]
        x = np.array([good[k][1] / np.linalg.norm(good[k][1]) for k in at])
        for p, q in np.argwhere(np.triu(x @ x.T >= 0.9, 1)):
            counts[at[p]] += 1
            counts[at[q]] += 1
            a, b = find(at[p]), find(at[q])
            root[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(good):
        least[find(k)] = min(i, least.get(find(k), i))
    want = sorted((i, int(counts[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(good))
    want = sorted(want + [(i, 0, i, True) for i, v in rows if not ok(v)])
    got = sorted(tuple(r) for r in vector_dedup.near_duplicates(df, bucket=bucket).collect())
    assert len(got) == len(want)
    found, every = sum(g[1] for g in got), sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and found >= 0.99 * every
    assert sum(g[2:] == w[2:] for g, w in zip(got, want, strict=True)) >= 0.97 * len(want)
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_blocks_agree(spark):
    df = vectors(spark)
    assert sorted(map(tuple, vector_dedup.near_duplicates(df).collect())) == sorted(map(tuple, vector_dedup.near_duplicates(df, bucket=25).collect()))


def test_columns_named_like_the_operators_own(spark):
    from pyspark.sql import functions as F

    df = vectors(spark, 800)
    clash = df.withColumns({c: F.lit("x") for c in ("block", "bound", "uid", "least", "own", "i", "j", "ids", "key", "t", "query_id", "rank", "score", "dim")})
    assert sorted(map(tuple, vector_dedup.near_duplicates(df).collect())) == sorted(map(tuple, vector_dedup.near_duplicates(clash).collect()))
    near = lambda d: sorted(map(tuple, ann.nearest(d, d.where("vec_id % 100 = 0")).collect()))
    assert near(df) == near(clash)


def test_hyperplanes_grow_with_the_rows_and_keys_keep_their_bits():
    from graphloom.llm import vector_dedup

    bits = [vector_dedup.layout(n, 0.9)[0] for n in (10, 10**4, 10**6, 10**9, 10**12)]
    assert bits == sorted(bits) and bits[-1] > 30, "rows of a bucket stay about as many"
    for n in (18, 30, 38):
        x = np.random.default_rng(n).standard_normal((50, 8))
        sig = vector_dedup.signatures(x, n, 3)
        planes = (x @ vector_dedup.hyperplanes(8, n * 3, vector_dedup.SEED) >= 0).reshape(50, 3, n)
        assert [[int("".join("01"[b] for b in row[::-1]), 2) for row in one] for one in planes.tolist()] == sig.astype(np.int64).tolist()


def test_links_with_wide_signatures(spark, monkeypatch):
    from graphloom.llm import vector_dedup

    rng = np.random.default_rng(3)
    base = rng.standard_normal((20, 6))
    rows = [(i * 3 + k, [float(v) for v in base[i] + 0.01 * k * rng.standard_normal(6)]) for i in range(20) for k in range(3)] + [(900, [1.0, 2.0]), (901, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(tuple, vector_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(vector_dedup, "layout", lambda n, threshold: (34, 40))
    assert sorted(map(tuple, vector_dedup.near_duplicates(df).collect())) == want
