import random
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string"


def brute(rows, depth=5, least=100, top=2000):
    counts, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, min(depth, len(words) - i) + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        scored = []
        for p, a in candidates.items():
            if 100 * inside[p] >= 100 * a:
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        scored.sort(key=lambda s: (-s[0], -s[1], s[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], score) for i, (score, a, p, left, right) in enumerate(scored[:top])]
    return sorted(out)


def found(spark, rows, schema=SCHEMA, parts=3, **how):
    return sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, schema).repartition(parts), **how).collect()))


def corpus(seed=1, docs=60, size=60, hot=True):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Big", "cat", "dog", "été", "naïve", "x\x01y", "x", "日本", "a-b", "rare%d"]
    rows = []
    for i in range(docs):
        words = [w % rng.randrange(1000) if "%" in w else w for w in rng.choices(vocabulary, [9, 7, 5, 4, 3, 2, 2, 1, 2, 1, 1, 1], k=size)]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!"]) for w in words)
        rows.append((i, text, rng.choice(["en", "de", None, "und"])))
    if hot:  # a third of all words is one pair, and many copies of one text
        rows += [(900 + i, "hot pair " * 40, "en") for i in range(20)] + [(950, rows[0][1], "en")] * 15
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    want = brute(rows, least=5)
    assert found(spark, rows, least=5) == want and len(want) > 100


@pytest.mark.parametrize("shard, reach, words, cut", [(50, 40, 500_000, 7), (1000, 100, 0, 1 << 16), (50, 25, 0, 5)])
def test_small_shards_ranges_and_slices_change_nothing(spark, monkeypatch, shard, reach, words, cut):
    rows = corpus(2)
    want = brute(rows, least=4, top=50)
    for name, value in (("SHARD", shard), ("RANGE", reach), ("WORDS", words), ("SLICE", cut), ("BYTES", 11), ("COUNTED", 9), ("HEAVY_ROWS", 0)):
        monkeypatch.setattr(phrases, name, value)
    assert found(spark, rows, least=4, top=50) == want


def test_ranges_split_a_frequent_phrases_subtree():
    rng = random.Random(4)
    ids = np.array([x for _ in range(3000) for x in (1, 2, rng.randrange(1, 9), rng.randrange(1, 9), 0)], np.int64)
    levels = phrases.trie(ids, np.ones(len(ids), bool), 4)
    all_paths = sorted(tuple(p) for level in phrases.paths(levels) for p in level.tolist())
    bounds = np.array([(*p, *[0] * (4 - len(p))) for p in all_paths[5 :: len(all_paths) // 9]], np.int64)
    at = [np.concatenate([[0], c, [len(level[1])]]) for c, level in zip(phrases.cuts(levels, bounds), levels)]
    whole = {p: f for path, total, _ in phrases.merged([phrases.packed(levels, [0] * 4, [len(x[1]) for x in levels])], np.zeros(4, np.int64), 4, 2) for p, f in zip(map(tuple, path.tolist()), total.tolist())}
    pieces = {}
    for r in range(len(bounds) + 1):
        part = phrases.packed(levels, [int(a[r]) for a in at], [int(a[r + 1]) for a in at])
        low = bounds[r - 1] if r else np.zeros(4, np.int64)
        for path, total, lefts in phrases.merged([part] if part else [], low, 4, 2) if part else []:
            for p, f, left in zip(map(tuple, path.tolist()), total.tolist(), lefts.tolist()):
                assert p not in pieces and (tuple(low) <= (*p, *[0] * (4 - len(p)))) and all(x in (-1, whole[p[: i + 1]]) for i, x in enumerate(left))
                pieces[p] = f
    assert pieces == whole and len(bounds) > 8


def test_overlaps_case_and_piece_edges(spark):
    rows = [(1, "a a a a", "en"), (2, "A\tA", "en"), (3, "a.a,a;a:a!a?a\na\x0ba\x0ca\ra", "en"), (4, "b \x00 b", "en"), (5, "É é", "en")]
    want = brute(rows, least=1)
    assert found(spark, rows, least=1) == want
    assert ("en", "a a a a") in {(r[0], r[2]) for r in want}


def test_order_is_by_bytes_of_the_whole_phrase(spark):
    rows = [(i, "a b. a\x01 c. é d. a\x01c e.", "en") for i in range(4)]
    got = found(spark, rows, least=2)
    assert got == brute(rows, least=2) and len(got) == 4


def test_counts_beyond_64_bits(spark):
    df = spark.sql("SELECT 90000000000000000L AS a, 99000000000000000L AS n, 95000000000000000L AS l, 91000000000000000L AS r")
    text = "CAST((1000BD * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) AS DECIMAL(38,0)) div CAST(CAST(l AS DECIMAL(17,0)) * CAST(r AS DECIMAL(17,0)) AS DECIMAL(38,0))"
    assert df.selectExpr(text).first()[0] == 1000 * 90000000000000000 * 99000000000000000 // (95000000000000000 * 91000000000000000)


def test_nulls_empty_and_clashing_columns(spark):
    assert found(spark, [], least=1) == []
    assert found(spark, [(1, None, "en"), (None, "", None), (3, " . ", "en")], least=1) == []
    rows = [(None, "x y", None, 1, "w"), (None, "x y", None, 1, "w"), (1, "x y z", "und", 1, "w")]
    assert found(spark, rows, SCHEMA + ", rank int, ids string", least=2) == brute(rows, least=2)


def test_a_long_text(spark):
    rng = random.Random(8)
    rows = [(1, " ".join(rng.choice("abcdefgh") for _ in range(150_000)) + " " + "w" * 3_000_000, "en"), (2, "a b c d e", "en")]
    assert found(spark, rows, least=100, top=100) == brute(rows, least=100, top=100)
