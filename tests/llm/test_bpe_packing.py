import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
from tokenizers import Tokenizer

from graphloom.llm import byte_bpe, packing

DOCS = "doc_id long, text string, ids string, extra int"
RANKS = "byte_bpe_multi_50k.tiktoken"


def odd_texts():
    rng = random.Random(7)
    mixed = "".join(rng.choice(["ab", " ", "  ", "\n", "é", "ß", "42", "'s", "'LL", "!!", "\t", "中文", "é", " ", "|", "😀"]) for _ in range(6000))
    return [None, "", " ", "hello world", "hello world", mixed, "a" * 5000, " " * 3000 + "x", "1" * 2500, "x\x1cy\x85z áb", "| a | b|c", "word " * 1500]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(odd_texts())] + [(3, "hello world", "clash", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def spaced_texts():
    """Every run of two or three white-space characters before a word, where a chunk may begin."""
    blanks = [" ", "\xa0", "\x85", "\u2003", "\u2028", "\t", "\n", "\x1c"]
    runs = [a + b for a in blanks for b in blanks] + [a + b + c for a in blanks[:5] for b in blanks[:5] for c in blanks[:5]]
    return ["ab cd." * 15 + run + "word " + "xy z" * 20 for run in runs]


def test_a_stitch_is_a_true_boundary_and_follows_no_white_space():
    pattern = regex.compile(P.PATTERN)
    for text in [t for t in odd_texts() if t] + spaced_texts():
        want = {m.start() for m in pattern.finditer(text)}
        for chunk, overlap in ((64, 16), (200, 40), (1000, 300)):
            spans = byte_bpe.chunk_spans(len(text), chunk, overlap)
            assert spans[0][0] == 0 and spans[-1][1] == len(text)
            assert all(a[1] - b[0] >= overlap and b[1] > a[1] for a, b in zip(spans, spans[1:], strict=False))
            found = [byte_bpe.marks(pattern, text[s:e], s, overlap) for s, e in spans]
            for (_, last), (first, _) in zip(found, found[1:], strict=False):
                if meet := sorted(set(first) & set(last)):
                    assert not text[meet[0] - 1].isspace()
            if all(set(a[1]) & set(b[0]) for a, b in zip(found, found[1:], strict=False)):
                assert {min(set(a[1]) & set(b[0])) for a, b in zip(found, found[1:], strict=False)} <= want


def fuzzed_texts(n: int):
    rng = random.Random(19)
    bits = ["ab", " ", "  ", "\n", "\xa0", "\x85", "\u2003", "é", "ß", "42", "'s", "'LL", "!!", "\t", "中文", "e\u0301", "İ", "İ.", "x\u0307,", "ǅ?", "ﬁ!", "Σ.", "|", "😀", "K;", "½:", "Ⅷ."]
    return ["".join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(n)]


def test_ten_thousand_fuzzed_texts_encode_as_the_libraries_do(spark):
    texts = fuzzed_texts(10_000) + spaced_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    enc = byte_bpe.encoding(open(P.path(RANKS), "rb").read(), P.PATTERN)
    for r in byte_bpe.encode(docs, P.path(RANKS), P.PATTERN, chunk=64, overlap=16).collect():
        assert list(r.ids) == enc.encode_ordinary(texts[r.doc_id]), repr(texts[r.doc_id])
    raw = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    own, tok = packing.WordEncoder(raw), Tokenizer.from_str(raw)
    tok.encode_special_tokens = True
    assert own.by_words
    for text, got in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(got, own.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_chunks_of_production_size(spark):
    """A word after white space just where a chunk begins, in a text of several chunks; copies share the work."""
    at = byte_bpe.CHUNK - byte_bpe.OVERLAP
    head = ("lorem ipsum " * at)[: at - 2]
    texts = [head + gap + "word " * 20_000 for gap in (" \xa0", " \x85", "\u2003 ")] + ["a" * 100_000, " " * 70_000, head + " \xa0" + "word " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = byte_bpe.encoding(open(P.path(RANKS), "rb").read(), P.PATTERN)
    rows = {r.doc_id: r for r in byte_bpe.encode(docs, P.path(RANKS), P.PATTERN, digest=True).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(enc.encode_ordinary(text), "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_other_tokenizers_encode_whole_texts():
    raw = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    own, tok = packing.WordEncoder(raw), Tokenizer.from_str(raw)
    assert not own.by_words
    texts = ["two  words here.", "", "é \n x"]
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode_all(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def plain_texts(n: int):
    """Made-up words of Latin-1 letters with marks, digits and contractions: most are new to the cache."""
    rng = random.Random(23)
    bits = ["the", "tion", "é", "ñ", "ß", "ä", "í", "&&&", ".$$$", "?!", ",", "42", "'s", "'ll", "'", "</w>", "|", "<|endoftext|>", " ", " ", "\n"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(n)]


class CountedLookups(dict):
    asked = 0

    def __contains__(self, key):
        self.asked += 1
        return super().__contains__(key)

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)

    def get(self, key, default=None):
        self.asked += 1
        return super().get(key, default)


def test_plain_words_cost_no_normaliser_and_repeated_words_one_look_up(monkeypatch):
    raw = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    own, tok = packing.WordEncoder(raw), Tokenizer.from_str(raw)
    tok.encode_special_tokens = True
    texts = plain_texts(2000)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]

    def whole_tokenizer(*args):
        raise AssertionError("a plain word went through the normaliser and the pattern")

    monkeypatch.setattr(own, "_ids", whole_tokenizer)
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode_all(texts)] == want
    own.known = CountedLookups(own.known)
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode_all(texts * 5)] == want * 5
    assert own.known.asked <= len({w for t in texts for w in t.replace("\n", " ").split(" ")})


def test_words_whose_ends_do_not_show():
    """Where ends don't come out one by one words are encoded singly; without marked ends texts are encoded whole."""
    raw = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    rules = json.loads(raw)
    rules["model"]["vocab"]["\u2400"] = rules["model"]["vocab"].pop("$</w>")  # the library drops a last $
    rules["model"]["merges"] = [m for m in rules["model"]["merges"] if "$</w>" not in m]
    unmarked = json.loads(raw)
    unmarked["model"]["end_of_word_suffix"] = None
    texts = plain_texts(300) + ["$", "a $ b", "$ $", ""]
    for changed, splits in ((rules, True), (unmarked, False)):
        own, tok = packing.WordEncoder(json.dumps(changed)), Tokenizer.from_str(json.dumps(changed))
        tok.encode_special_tokens = True
        assert own.by_words == splits
        assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode_all(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_encode_equals_the_library_and_round_trips(docs):
    path = P.path(RANKS)
    enc = byte_bpe.encoding(open(path, "rb").read(), P.PATTERN)
    out = byte_bpe.encode(docs, path, P.PATTERN, chunk=128, overlap=32)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = out.collect()
    assert len(rows) == 13
    for r in rows:
        assert list(r.ids) == enc.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
    for r in byte_bpe.decode(out, path, P.PATTERN).collect():
        assert bytes(r.data).decode() == texts[r.doc_id]
    for r in byte_bpe.encode(docs, path, P.PATTERN, digest=True).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pack_against_brute_force(docs, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = {d: [*tok.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
    rows = packing.pack(docs, path, length=64, with_ids=True).orderBy("sequence_id", "offset").collect()
    seen, at = {}, (0, 0)
    for r in rows:
        assert (r.sequence_id, r.offset) == at, "gapless"
        assert want[r.doc_id][r.start : r.start + r.length] == np.frombuffer(r.ids, "<u4").tolist()
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(want[r.doc_id])
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        at = (r.sequence_id, r.offset + r.length) if r.offset + r.length < 64 else (r.sequence_id + 1, 0)
    assert seen == {d: len(x) * (2 if d == 3 else 1) for d, x in want.items()}


def test_columns_named_like_the_operators_own(docs):
    from pyspark.sql import functions as F

    clash = docs.withColumns({c: F.lit("x") for c in ("part", "local_start", "doc_tokens", "key", "k", "start", "first", "last", "low", "high", "end", "n_tokens")})
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(byte_bpe.encode(docs, P.path(RANKS), P.PATTERN, chunk=128, overlap=32), byte_bpe.encode(clash, P.path(RANKS), P.PATTERN, chunk=128, overlap=32))
    one, two = (packing.pack(d.coalesce(1), P.path("word_bpe_49k.json")).select("doc_id", "start", "length", "ids_crc32") for d in (docs, clash))
    assert same(one, two)


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert packing.pack(none, P.path("word_bpe_49k.json")).count() == 0
    assert byte_bpe.encode(none, P.path(RANKS), P.PATTERN).count() == 0
