import math
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from graphloom.llm import suffix_lm

DOCS = "doc_id long, text string, chunk int, train boolean"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def toks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) + [None]


def rows():
    rng = random.Random(6)
    out = []
    for i in range(300):
        w, text = "the", []
        for _ in range(rng.randint(1, 60)):
            w = {"the": rng.choice(["Cat", "dog"]), "Cat": "sat", "dog": rng.choice(["ran", "Ä1"]), "sat": "on", "on": "the"}.get(w, rng.choice(["the", "on", f"rare{rng.randint(0, 400)}"]))
            text.append(w)
        out.append((i, rng.choice([" ", "\n", "\t\x0b"]).join(text)))
    return [*out, (1000, None), (1001, ""), (1002, "x " * 30_000), (5, out[5][1]), (None, "the Cat sat on")]


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame([(i, t, 0, True) for i, t in rows()], DOCS).repartition(4)
    return suffix_lm.score(docs, chunk_bytes=3000).collect()


def test_base_against_brute_force(scored):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows() if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t)), 6)) for i, t in rows()), key=str)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored), key=str)
    assert got == want


def test_contexts_help_on_held_out_texts(scored):
    out = [r for r in scored if r.held_out and r.doc_id < 1000]
    assert out and sum(r.score for r in out) > 0.7 * sum(r.base_score for r in out)


def test_every_state_is_a_distribution():
    rng = np.random.default_rng(2)
    v = 12
    words = [b"w%d" % i for i in range(v - 1)] + [b""]
    from xxhash import xxh64_intdigest

    hashes = np.array([xxh64_intdigest(w, 7) for w in words], np.uint64)
    seq, prev = [], 0
    for _ in range(6000):
        prev = int((prev * 3 + rng.integers(0, 3)) % (v - 1))
        seq.append(prev)
        if rng.random() < 0.05:
            seq.append(v - 1)
    counts = np.bincount(seq, minlength=v)
    tree = suffix_lm.SuffixTree(hashes, counts, int(counts.sum()), v)
    sym = tree.symbols(hashes)[np.array(seq)]
    while True:
        state = tree.states(sym)[-1]
        at = np.flatnonzero(state[:-1] >= 0)
        codes, n = np.unique(state[at] * tree.size + sym[at + 1], return_counts=True)
        if not tree.grow(codes[n >= 3], n[n >= 3]):
            break
    assert len(tree.levels) == 3 and tree.levels[0].keep.any() and not tree.levels[2].keep.all()
    unseen = tree.base(np.zeros(1))[0]  # the one symbol that training never saw
    for k, level in enumerate(tree.levels, 1):
        for ctx in range(len(level.words)):
            p = tree.probability(k, np.full(v + 1, ctx), np.append(np.arange(v), -1), np.append(tree.root, unseen))
            assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_empty(spark):
    assert suffix_lm.score(spark.createDataFrame([], DOCS)).count() == 0


def brute_tree(train):
    """The suffix tree over dictionaries, from the definitions: (probability of a symbol after a history) and the kept contexts."""
    words = [[*t.encode().lower().split(), b""] for t in train]
    c = Counter(w for t in words for w in t)
    total, distinct = sum(c.values()), len(c)
    floor = {k: suffix_lm.least(total, *v) for k, v in {"pair": (suffix_lm.PAIR, suffix_lm.MOST_PAIRS, suffix_lm.LEAST_PAIR), "context": (suffix_lm.CONTEXT, suffix_lm.MOST_CONTEXTS, suffix_lm.LEAST_CONTEXT)}.items()}
    known = {w for w, n in c.items() if n >= floor["pair"]}
    contexts = {(): total} | {(w,): c[w] for w in known if w and c[w] >= floor["context"]}
    nodes = {}

    def p(symbol, context):
        if not context:
            return (c[symbol] + 0.1) / (total + 0.1 * (distinct + 1))
        if context not in nodes:
            return p(symbol, context[1:])
        listed, alpha = nodes[context]
        return listed[symbol] if symbol in listed else alpha * p(symbol, context[1:])

    for k in range(1, suffix_lm.DEPTH + 1):
        after = {x: Counter() for x in contexts if len(x) == k}
        for t in words:
            for i in range(k, len(t)):
                if tuple(t[i - k : i]) in after and t[i] in known:
                    after[tuple(t[i - k : i])][t[i]] += 1
        fresh = {}
        for x, counts in after.items():
            counts = {s: n for s, n in counts.items() if n >= floor["pair"]}
            n, w = contexts[x], contexts[x] / (contexts[x] + suffix_lm.KAPPA)
            parent = {s: p(s, x[1:]) for s in counts}
            alpha = w * max(0, 1 - sum(counts.values()) / n) / max(1e-12, 1 - sum(parent.values())) + 1 - w
            listed = {s: w * m / n + (1 - w) * parent[s] for s, m in counts.items()}
            gain = sum(m * math.log(listed[s] / parent[s]) for s, m in counts.items()) + (n - sum(counts.values())) * math.log(alpha)
            if gain >= suffix_lm.PRUNE * (len(counts) + 1):
                fresh[x] = (listed, alpha)
            contexts |= {(*x, s): m for s, m in counts.items() if s and m >= floor["context"]}
        nodes |= fresh
    return p, nodes


def test_scores_equal_a_brute_force_tree(spark):
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(5)]
    rows = []
    for i in range(900):
        words = rng.choices(vocab, k=3)
        for _ in range(rng.randint(0, 40)):
            at = [vocab.index(w) if w in vocab else 0 for w in words[-3:]]
            by = rng.random()
            words.append(vocab[(at[0] + 2 * at[1] + 3 * at[2]) % 5] if by < 0.3 else vocab[(at[1] + 2 * at[2] + 1) % 5] if by < 0.5 else vocab[(at[2] + 1) % 5] if by < 0.7 else rng.choice([*vocab, f"rare{i}", "Third"]))
        rows.append((i, " ".join(words)))
    rows.append((2000, ""))
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    p, nodes = brute_tree([t for d, t in rows if not held(d)])
    assert {len(x) for x in nodes} == {1, 2, 3}, "contexts of every length are kept"
    got = {r.doc_id: r.score for r in suffix_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for d, t in rows:
        words, want = [*t.encode().lower().split(), b""], 0.0
        for i, w in enumerate(words):
            longest = next((tuple(words[i - k : i]) for k in (3, 2, 1) if i >= k and tuple(words[i - k : i]) in nodes), ())
            want += math.log10(p(w, longest))
        assert abs(got[d] - want) < 1e-6, d


def test_the_tree_grows_with_the_corpus():
    floors = [suffix_lm.least(n, suffix_lm.PAIR, suffix_lm.MOST_PAIRS, 3) for n in (10**6, 10**8, 10**10, 10**13)]
    sizes = [n / f for n, f in zip((10**6, 10**8, 10**10, 10**13), floors, strict=True)]
    assert sizes[0] < sizes[1] < sizes[2] <= sizes[3] <= suffix_lm.MOST_PAIRS


def test_small_corpora_follow_the_same_floors(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a b c", "a b c", "d b e", "d b e", "f g", f"r{i}"]) for _ in range(6))) for i in range(50)]
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    train = [t for d, t in rows if not held(d)]
    assert sum(len(toks(t)) for t in train) < 1024
    with monkeypatch.context() as m:  # the brute force's floors: nothing but the square root
        for name, bound in {"MOST_PAIRS": math.inf, "MOST_CONTEXTS": math.inf, "LEAST_PAIR": 0, "LEAST_CONTEXT": 0}.items():
            m.setattr(suffix_lm, name, bound)
        p, nodes = brute_tree(train)
    assert nodes
    got = {r.doc_id: r.score for r in suffix_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for d, t in rows:
        words, want = [*t.encode().lower().split(), b""], 0.0
        for i, w in enumerate(words):
            want += math.log10(p(w, next((tuple(words[i - k : i]) for k in (3, 2, 1) if i >= k and tuple(words[i - k : i]) in nodes), ())))
        assert abs(got[d] - want) < 1e-6, d


def test_large_corpora_follow_the_same_floors(spark):
    total = 40_000_000_000  # floors: 100,000 a context and 6,000 a pair
    hashes = suffix_lm.tokens(["a b"])[2]  # the end, a, b
    tree = suffix_lm.SuffixTree(hashes, np.array([200_000, 120_000, 120_000]), total, 3)
    assert sorted(tree.levels[0].words[:, 0]) == sorted(tree.symbols(hashes[1:]))
    _, n = suffix_lm.pair_counts(spark.createDataFrame([("a b " * 10_000,)], "text string"), tree)
    assert sorted(n) == [9_999, 10_000]


def test_one_floor_at_every_size():
    for root in (suffix_lm.CONTEXT, suffix_lm.PAIR):
        assert all(math.isclose(suffix_lm.least(4 * 10**k, root), 2 * suffix_lm.least(10**k, root)) for k in range(16))
