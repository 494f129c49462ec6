import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import quality, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def near_rows():
    rng = random.Random(12)
    base = [sentence(rng, rng.choice([30, 120, 400])) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(90):
        w = base[i % 40].split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = sentence(rng, 1)
        rows.append((100 + i, " ".join(w)))
    group = sentence(rng, 200).split()
    for i in range(150):  # a large group of near copies
        w = list(group)
        w[rng.randrange(200)] = sentence(rng, 1)
        rows.append((500 + i, " ".join(w)))
    rows += [(1000 + i, group and base[3]) for i in range(80)]
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "one two"), (2004, "One two"), (3, base[3]), (None, base[5]), (3000, "long " * 50_000)]
    rng.shuffle(rows)
    return rows


def brute(rows, words=5, bound=0.8):
    """Kept (doc_id, text): the first of each component of pairs with that similarity."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) / u if u else 1.0) >= bound:
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        key = (d is None, d or 0)
        best[find(i)] = min(best.get(find(i), key), key)
    return sorted((d for d in (None if k[0] else k[1] for k in best.values())), key=str)


def test_near_dedup_stage_against_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS).repartition(5)
    out = corpus_pipeline.one_of_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((r.doc_id for r in out.collect()), key=str)
    want = brute(rows)
    assert not set(want) - set(got), "no document goes that should stay"
    assert len(got) <= len(want) + 1, (set(got) - set(want))


def test_candidate_pairs_lose_no_link():
    import numpy as np

    rng = np.random.default_rng(1)
    check = rng.integers(0, 1 << 63, (12, 4), dtype=np.uint64)[rng.integers(0, 12, 700)]
    for row in check:
        for bit in rng.integers(0, 256, rng.integers(0, 30)):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    node = rng.permutation(700).astype(np.int64)
    key = np.where(np.arange(700) < 400, 0, rng.integers(1, 20, 700))
    none = np.zeros(700, np.int32)
    for lot in (500_000, 50):
        lots = list(simhash.candidate_pairs(none, key, node, check, none, none, none, 20, 50, [], lot))
        check_pairs(lots, node, key, check, len(lots) > 2)
    # the same rows as pairs of three blocks
    own, rows = rng.integers(0, 3, 700), []
    for i in range(3):
        for j in range(i, 3):
            rows += [(at, i, j) for at in range(700) if own[at] in (i, j)]
    at, i, j = np.array(rows).T
    check_pairs(list(simhash.candidate_pairs(np.zeros(len(at), np.int32), key[at], node[at], check[at], own[at], i, j, 20, 50, [])), node, key, check, False)


def check_pairs(lots, node, key, check, cut):
    import numpy as np

    from graphloom.llm.components import local_labels

    a, b = (np.concatenate(x) for x in zip(*lots, strict=True))
    assert cut or len(lots) < 5
    want = [(node[i], node[j]) for i in range(700) for j in range(i) if key[i] == key[j] and simhash.bit_distance(check[i], check[j]) <= 50]
    x, y = local_labels(*map(np.array, zip(*want, strict=True)))
    p, q = local_labels(a, b)
    assert (x == p).all() and (y == q).all(), "the pairs kept connect what all pairs connect"
    assert (cut or len(a) < len(want) / 2) and {tuple(sorted(w)) for w in zip(a, b, strict=True)} <= {tuple(sorted(w)) for w in want}


@pytest.fixture(scope="module")
def table_dir(spark, tmp_path_factory):
    rng = random.Random(3)
    passage = sentence(rng, 60)
    rows = []
    for i in range(120):
        t = sentence(rng, 50) + ". "
        if i % 10 == 0:
            t = "BUY NOW!! " * 40
        if i in (21, 43, 65):
            t += passage
        if i in (22, 44):
            t += " write to someone@mail.example.com or +1 (425) 555-9684"
        rows.append((i, t, "en", "s", len(t)))
    rows += [(200 + i, rows[1][1], "en", "s", rows[1][4]) for i in range(20)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(0, 120)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_each_stage_takes_effect(spark, table_dir):
    docs = spark.read.parquet(f"{table_dir}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs, table_dir)
    ids = {r.doc_id for r in good.collect()}
    assert ids == {r.doc_id for r in docs.where("doc_id % 10 > 0 or doc_id >= 200").collect()} and good.columns == docs.columns
    scores = {r.doc_id: r.score for r in quality.classify(docs, spark.read.parquet(f"{table_dir}/labels.parquet")).collect()}
    assert all((s >= quality.THRESHOLD) == (d in ids) for d, s in scores.items())
    once = corpus_pipeline.one_of_near_duplicates(spark, good, table_dir)
    assert {r.doc_id for r in once.collect()} == {d for d in ids if d < 200}
    cut = corpus_pipeline.cut_repeats(spark, once, table_dir)
    texts = {r.doc_id: r for r in cut.collect()}
    before = {r.doc_id: r for r in once.collect()}
    assert cut.columns == docs.columns and len(texts[21].text) > 300
    assert all(len(texts[d].text) < len(before[d].text) - 250 and texts[d].n_chars == len(texts[d].text) for d in (43, 65))
    assert all(texts[d] == before[d] for d in before if d not in (43, 44, 65))
    masked = {r.doc_id: r.text for r in corpus_pipeline.mask_pii(spark, cut, table_dir).collect()}
    assert masked[22].endswith("write to [EMAIL] or [PHONE]")
    assert corpus_pipeline.run(spark, table_dir).agg(F.countDistinct("doc_id")).first()[0] == len(before)


def brute_cut(rows, window=50):
    """Texts without the bytes of windows that also start in a document with a smaller id."""
    first, out = {}, {}
    for d, t in rows:
        raw = t.encode()
        for i in range(len(raw) - window + 1):
            first[raw[i : i + window]] = min(d, first.get(raw[i : i + window], d))
    for d, t in rows:
        raw = t.encode()
        gone = set()
        for i in range(len(raw) - window + 1):
            if first[raw[i : i + window]] < d:
                gone.update(range(i, i + window))
        out[d] = bytes(c for i, c in enumerate(raw) if i not in gone).decode(errors="ignore")
    return out


def test_stages_equal_brute_force(spark, table_dir):
    """Quality by the scores of the operator (tested against counting by hand), repeats, personal data and packing by plain Python."""
    import re

    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{table_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    cut = corpus_pipeline.cut_repeats(spark, docs, table_dir)
    assert {r.doc_id: r.text for r in cut.collect()} == brute_cut(rows)
    mail, phone = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"\+[0-9][\x20().0-9-]+[0-9]"
    masked = {r.doc_id: r.text for r in corpus_pipeline.mask_pii(spark, docs, table_dir).collect()}
    assert masked == {d: re.sub(phone, "[PHONE]", re.sub(mail, "[EMAIL]", t)) for d, t in rows}, "these texts hold nothing that only resembles personal data"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in rows}
    pieces = corpus_pipeline.pack(spark, docs, table_dir).collect()
    assert {d: sum(p.length for p in pieces if p.doc_id == d) for d in ids} == {d: len(x) for d, x in ids.items()}
    import zlib

    import numpy as np

    assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) for p in pieces)
    filled = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    assert all(b[:2] == ((a[0], a[1] + a[2]) if a[1] + a[2] < 2048 else (a[0] + 1, 0)) for a, b in zip(filled, filled[1:], strict=False)), "gapless windows"


def test_scratch_is_swept(spark, table_dir):
    import os

    from graphloom.llm import common

    df = common.materialize(spark.range(5))
    path = df._graphloom_path
    assert os.path.exists(path) and common.scratch_dir(spark) in path
    common.discard(df)
    assert not os.path.exists(path)


def test_empty_documents(spark, table_dir, tmp_path):
    docs = spark.read.parquet(f"{table_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, table_dir).count() == 0


def test_clashing_columns_pass_through(spark, table_dir):
    clash = ("score", "row", "key", "node", "chunk", "bucket", "_row", "_text", "id", "first", "prints", "k", "n", "block", "u", "v")
    docs = spark.read.parquet(f"{table_dir}/documents.parquet").where("doc_id < 60").selectExpr("*", *[f"doc_id + {i} as {c}" for i, c in enumerate(clash)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, table_dir)
        rows = docs.collect()
        assert rows and all(r[c] == r.doc_id + i for r in rows for i, c in enumerate(clash))
    assert corpus_pipeline.pack(spark, docs, table_dir).count() >= len(rows)
