import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from graphloom.llm import simhash
from graphloom.llm.components import components

DOCS = "doc_id long, text string, fingerprint string, component_id int"


def brute_prints(text, words=3):
    w = [x for x in (text or "").encode().lower().split()]
    sh = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_operator_against_brute_force(spark):
    rng = random.Random(1)
    vocab = ["Alpha", "beta", "GAMMA", "été", "x", "y z", "word", "other"]
    texts = [None, "", " \t\n", "one", "one two", "ONE two", "one two three"] + [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 80))) for _ in range(60)]
    texts += [t + " tail" for t in texts[20:40]] + [texts[10]] * 30
    rows = [(i * 3, t, "clash", 1) for i, t in enumerate(texts)] + [(9, "one", "clash", 2)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert len(out) == len(rows)
    want = {r[0]: brute_prints(r[1]) for r in rows}
    comps = brute_components(want, 2)
    for r in out:
        assert r.fingerprint & (1 << 64) - 1 == want[r.doc_id]
        assert r.component_id == comps[r.doc_id]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_pigeonhole_loses_nothing(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = []
    for x in base:
        for _ in range(6):
            y = int(x)
            for b in rng.choice(64, rng.integers(0, 8), replace=False):
                y ^= 1 << int(b)
            near.append(y)
    prints = {i: v for i, v in enumerate([int(x) for x in base] + near)}
    rows = [(i, int(np.uint64(v).view(np.int64))) for i, v in prints.items()]
    out = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, fingerprint long"), radius).collect()
    assert {r.doc_id: r.component_id for r in out} == brute_components(prints, radius)


def test_one_bucket_holds_all_rows(spark, monkeypatch):
    """A third part of equal bits puts every row in one bucket, which is dealt as pairs of blocks."""
    monkeypatch.setattr(simhash, "BUCKET", 50)
    rng = np.random.default_rng(4)
    prints = {i: int(x) << 44 for i, x in enumerate(rng.integers(0, 1 << 9, 400))}
    rows = [(i, int(np.uint64(v).view(np.int64))) for i, v in prints.items()]
    out = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, fingerprint long"), 2).collect()
    assert {r.doc_id: r.component_id for r in out} == brute_components(prints, 2)


def test_bit_majority_counts_every_bit():
    rng = np.random.default_rng(6)
    sizes = np.array([1, 2, 254, 255, 256, 511, 3000])
    flat = rng.integers(0, 1 << 63, sizes.sum(), dtype=np.int64).view(np.uint64) | np.uint64(1)
    want = [sum(1 << b for b in range(64) if int((run >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(run)) for run in np.split(flat, np.cumsum(sizes)[:-1])]
    assert simhash.bit_majority(flat, sizes).tolist() == want


def test_similarity_of_sets():
    rng = random.Random(12)
    for n in (0, 1, 3, 4, 5, 6, 300):
        words = [rng.choice(["a", "B", "cc", "é", "x1"]) for _ in range(n)]
        own = {" ".join(words[i : i + 5]).lower() for i in range(max(1, n - 4))} if n else set()
        assert len(simhash.shingle_set(" ".join(words), 5)) == len(own)
    x, y = simhash.shingle_set("a b c d e f g h i j k", 5), simhash.shingle_set("A B C D E F G H I J K l", 5)
    assert simhash.similar(x, y, 0.8) and not simhash.similar(x, y, 0.9) and simhash.similar(x[:0], y[:0], 0.8) and not simhash.similar(x, y[:0], 0.8)


def test_long_buckets_and_allocation():
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 12, 3000, dtype=np.uint64) << np.uint64(50))
    none = np.zeros(len(fps), np.int32)
    a, b = simhash.links_within(none, none, fps, none.astype(bool), none, none, none, 1)
    assert len(a) == len(fps) - 1  # the hypercube's neighbours are connected
    for n in (10, 10**6, 10**10):
        for radius in (0, 2, 6):
            plan = simhash.allocate(rng.integers(0, 1 << 63, 500, dtype=np.uint64), n, radius)
            assert sum(t + 1 for _, t in plan) == radius + 1


def test_components_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 7), (None, 3), (1, 900), (900, 1), (5, 900)], "u long, v long")
    got = {r.node: r.component for r in components(chain).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {1: 1, 5: 1, 900: 1}
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    one = spark.createDataFrame([(None, "a b c", "", 0), (4, "a b c", "", 0)], DOCS)
    assert {r.component_id for r in simhash.near_duplicates(one).collect()} == {4}


def test_similarity_ignores_repeated_lines(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for i in range(20):
        lines = [" ".join(word() for _ in range(10)) for _ in range(10)]
        rows += [(2 * i, "\n".join(lines)), (2 * i + 1, "\n".join(lines[:5] + lines[5:6] * 31 + lines[6:]))]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(40)}


def test_rejected_links_hide_no_true_pair(spark, monkeypatch):
    """Variants of one text at a Jaccard similarity of about 0.77, each with one partner at about 0.87."""
    monkeypatch.setattr(simhash, "STRICT", simhash.LOOSE)  # so that few texts show it: most strict links are false
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base, rows = [word() for _ in range(2000)], []
    for i in range(240):
        if i % 2 == 0:
            spots = rng.sample(range(5, 1990, 6), 27)
        text = list(base)
        for at in spots:
            text[at] = word()
        rows.append((i, " ".join(text)))
    sets = [set(simhash.shingle_hashes(t, 5)) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: find(i) for i in range(len(rows))}
    assert len(set(want.values())) > 50
    assert sum(got[i] != want[i] for i in want) == 0
