import hashlib
import random

import numpy as np
import pytest

from graphloom.llm import repeats

DOCS = "doc_id long, text string, chunk int, bucket int"


def brute(rows, w=50):
    big = 1 << 63
    least = {}
    data = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - w + 1):
            k = b[s : s + w]
            least[k] = min(i, least.get(k, big + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - w + 1):
            if least[b[s : s + w]] < i:
                gone[s : s + w] = b"\x01" * w
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((None if i == big else i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "été", "the", "of", "and", "x", "zeta", "\n"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(rng.randint(8, 40)) for _ in range(6)]
    rows = [(None, shared[0] + "null id"), (5, None), (6, ""), (7, "short"), (8, "a" * 49), (9, "a" * 400), (11, "a" * 300), (11, "b" + "a" * 300), (12, shared[1]), (12, shared[1])]
    for i in range(n):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a : a + rng.randint(20, 200)], text(rng.randint(0, 12))]
        rows.append((rng.randint(-50, 200), "".join(parts)))
    rows += [(300 + k, rows[20][1][:k] + "#" + rows[20][1][k:]) for k in range(0, 60, 7)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("chunk_bytes", [400, 1 << 20])
def test_against_brute_force(spark, seed, chunk_bytes):
    rows = random_rows(seed)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], DOCS).repartition(4)
    got = sorted((tuple(r) for r in repeats.repeats_digest(docs, chunk_bytes=chunk_bytes).collect()), key=str)
    assert got == brute(rows)


def test_spans_and_empty(spark):
    p = "".join(chr(97 + i * 7 % 26) for i in range(80))
    docs = spark.createDataFrame([(1, "xx" + p, 0, 0), (2, p + "yy", 0, 0)], DOCS)
    got = {r.doc_id: r for r in repeats.find_repeats(docs).collect()}
    assert bytes(got[1].text).decode() == "xx" + p and got[1].starts == []
    assert bytes(got[2].text) == b"yy" and (got[2].starts, got[2].ends) == ([0], [80])
    assert repeats.repeats_digest(docs.limit(0)).count() == 0


def test_shuffled_text_is_read_again_not_shuffled_again(spark):
    docs = spark.createDataFrame([(i, f"document {i} " * 20, 0, 0) for i in range(50)], DOCS)
    out = repeats.repeats_digest(docs)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 2


def test_very_long_documents(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2_600_000))
    part = long[500_000:1_500_000]
    rows = [(1, long, 0, 0), (2, "0" * 30 + part + "1" * 30, 0, 0), (3, "2" + part[10:400_000] + "3", 0, 0)]
    got = {r.doc_id: r for r in repeats.repeats_digest(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 1_000_000, 399_990]
    assert got[2].kept_sha256 == hashlib.sha256(b"0" * 30 + b"1" * 30).hexdigest() and got[3].n_spans == 1


def test_text_rewriting_keeps_columns_and_characters(spark):
    passage = "é" * 40 + "shared passage of sufficient length to repeat"
    rows = [(1, passage, 5, 6), (2, "ü" + passage + "ö", None, 8), (3, None, 9, 9)]
    out = {r.doc_id: r for r in repeats.without_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[1].text == passage and out[2].text == "üö" and out[3].text == "" and (out[2].chunk, out[2].bucket) == (None, 8)


def test_radix_groups_are_the_equal_prefixes():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 99, 4000).astype(np.uint8)
    at, group = np.sort(rng.choice(3900, 1500, False)), rng.integers(0, 3, 1500)
    for depth in (1, 7, 8, 9, 16, 20, 50):
        live, found = repeats.radix_groups(raw, at, group, depth)
        want = {}
        for i in range(1500):
            want.setdefault((group[i], raw[at[i] : at[i] + depth].tobytes()), []).append(i)
        want = sorted(v for v in want.values() if len(v) > 1)
        got = {}
        for i, g in zip(live.tolist(), found.tolist(), strict=True):
            got.setdefault(g, []).append(i)
        assert sorted(sorted(v) for v in got.values()) == want
        keys = [(group[i], raw[at[i] : at[i] + depth].tobytes()) for i in live]
        assert keys == sorted(keys), "suffixes come out in order"


def test_buckets_beyond_sixteen_bits_fill_evenly():
    import numpy as np

    grams = np.random.default_rng(1).integers(0, 1 << 64, 400_000, dtype=np.uint64)
    bucket = repeats.bucket_of(grams, 6_250_000)
    assert len(np.unique(bucket)) > 300_000 and bucket.max() < 6_250_000
    assert np.bincount(repeats.bucket_of(grams, 64)).max() < 1.1 * len(grams) / 64
