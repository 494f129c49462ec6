"""Packing (operator 10): concatenate all token streams and cut them into fixed windows.

Two passes. The first tokenises every document where it lies and records, per input partition, each
document's start in that partition's stream; it is written once, so partition numbers stay fixed whatever
executor is lost later. Partition totals (one number per partition) give each partition's global offset by
a prefix sum. The second pass adds the offset and cuts every document at multiples of the window: the
pieces at a window's edges are its boundary records. No shuffle, no sort, and only the last window is short.

Defined results: a null or empty text is the single end id; repeated rows are packed as often as they occur;
an empty table gives no pieces; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, only_cache, small_slices, tidied, whole_texts

SEQUENCE = 2048
END_ID = 1
#: Words kept per worker; a full cache is dropped, which costs time only.
CACHE_WORDS = 800_000
#: Words of one call to the tokenizers library, which holds several times their bytes.
CALL_WORDS = 5000
#: Rows and bytes of texts that are split and looked up together: the more, the fewer look-ups a word.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20
#: A word that the sentinel can stand beside without changing the split: pre-tokens never span a space.
SENTINEL = "|"
#: The normaliser and the split under which a word's ids don't depend on its neighbours.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that the normaliser leaves alone, and SPLIT as it is on them: printable ASCII and Latin-1 letters, all lower case.
PLAIN = re.compile(r"[!-@\[-~ß-öø-ÿ]+")
PLAIN_SPLIT = re.compile(SPLIT.replace(r"\p{L}", "a-zß-öø-ÿ").replace(r"\p{N}", "0-9"))

STREAM = "part int, doc_id long, local_start long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def lowered(text: str) -> str:
    """Lower case where that can't change the normaliser's own result: in Latin-1 texts."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


def by_words(tokenizer_json: str) -> bool:
    """Whether the tokenizer normalises, splits and ends words as the word encoder takes it to."""
    rules = json.loads(tokenizer_json)
    normal, split = rules.get("normalizer") or {}, (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first, rest = split[0], [{k: v for k, v in x.items() if k != "trim_offsets"} for x in split[1:]]
    model = rules["model"]
    return (
        normal.get("normalizers") == NORMALIZERS
        and first == {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
        and rest == [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
        and not any(rules.get(k) for k in ("truncation", "padding"))
        and model.get("type") == "BPE"
        and bool(model.get("end_of_word_suffix"))
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    )


def byte_letters(text: str) -> str:
    """A text of plain words and blanks in the byte-level alphabet: a letter a byte, from U+0100 on for bytes that aren't printable Latin-1."""
    if text.isascii():
        return text
    text = text.encode().decode("latin-1")
    for k, byte in enumerate([*range(0x7F, 0xA1), 0xAD], 33):  # after 33 of controls and the blank
        text = text.replace(chr(byte), chr(256 + k))
    return text


class WordEncoder:
    """ids of a text by its blank-separated words; a word's ids never depend on its neighbours.

    The pre-tokeniser never matches across white space and normalisation never composes across it, so
    distinct words are encoded once by the tokenizers library and looked up afterwards, once a slice of texts.
    Words of PLAIN are split here and their parts encoded by the bare model. A tokenizer with other
    rules than NORMALIZERS and SPLIT, or whose words' ends don't show in their last ids, encodes every text whole.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.by_words = by_words(tokenizer_json)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {"": b""}
        if not self.by_words:
            return
        self.bar = self._ids(SENTINEL)
        # for parts of words in byte-level letters: no normaliser, no pattern, and no cache, as no part comes twice
        model = json.loads(tokenizer_json)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.bare = Tokenizer(models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=suffix, cache_capacity=0))
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for word, i in vocab.items() if word.endswith(suffix)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _learn(self, words: list[str]) -> None:
        """Encode unseen words: plain ones by their parts, which are pre-tokens of their own, others through the whole tokenizer."""
        known, parts, split, others = self.known, {}, [], []
        for w in words:
            if not PLAIN.fullmatch(w):
                others.append(w)
            elif w.isalpha():
                parts[w] = None
            else:
                found = PLAIN_SPLIT.findall(w)
                split.append((w, found))
                for x in found:
                    if x not in known:
                        parts[x] = None
        fresh = list(parts)
        for k in range(0, len(fresh), CALL_WORDS):
            self._encode_parts(fresh[k : k + CALL_WORDS])
        for w, found in split:
            known[w] = b"".join([known[x] for x in found])
        joined = [w for w in others if SENTINEL not in w]
        for k in range(0, len(joined), CALL_WORDS):
            self._encode_joined(joined[k : k + CALL_WORDS])
        for w in others:
            if SENTINEL in w:
                known[w] = self._ids(w).tobytes()

    def _encode_parts(self, parts: list[str]) -> None:
        """Many pre-tokens by one call; each ends with its first id that is an end of a word."""
        ids = np.array(self.bare.encode_batch_fast([byte_letters(" ".join(parts))], add_special_tokens=False)[0].ids, self.dtype)
        self._cut(parts, ids, np.flatnonzero(self.ends[ids]) + 1, 0)

    def _encode_joined(self, words: list[str]) -> None:
        """Many words by one call, with the sentinel between them."""
        ids = self._ids(f" {SENTINEL} ".join(words))
        cuts = np.flatnonzero(ids == self.bar[0]) if len(self.bar) == 1 else np.zeros(0, int)
        self._cut(words, ids, np.append(cuts, len(ids)), 1)

    def _cut(self, words: list[str], ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        """Keep each word's ids; words whose ends don't come out one by one are encoded singly."""
        if len(ends) != len(words):
            self.known.update((w, self._ids(w).tobytes()) for w in words)
            return
        raw, width = ids.tobytes(), ids.itemsize
        starts = np.append(0, ends[:-1] + gap)
        self.known.update(zip(words, [raw[a:b] for a, b in zip((starts * width).tolist(), (ends * width).tolist(), strict=True)], strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        split = pc.split_pattern(pa.array([lowered(t).replace("\n", " ") for t in texts], pa.string()), " ")
        places = split.flatten().dictionary_encode()
        words, known = places.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        ids = list(map(known.get, words))
        if fresh := [k for k, x in enumerate(ids) if x is None]:
            self._learn([words[k] for k in fresh])
            for k in fresh:
                ids[k] = known[words[k]]
        ids = pa.array(ids, pa.large_binary()).take(places.indices)
        _, bounds, data = ids.buffers()
        bounds = np.frombuffer(bounds, np.int64)[split.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        return [bytes(data[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


_ENCODERS: dict[int, WordEncoder] = {}


def encoder(tokenizer_json: str) -> WordEncoder:
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(tokenizer_json)
    return _ENCODERS[key]


def token_stream(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Pass one, written once: per document its ids with the end id and its start in its partition's stream."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("packing", _ENCODERS.clear)
        enc, part, at = encoder(model.value), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        width = enc.dtype.itemsize
        for batch in batches:
            for piece in small_slices(batch, 1, SLICE_ROWS, SLICE_BYTES):
                ids = [x + end for x in enc.encode_all(piece.column(1).to_pylist())]
                tokens = np.array([len(x) // width for x in ids], np.int64)
                starts = at + np.cumsum(tokens) - tokens
                at += int(tokens.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), piece.column(0).cast(pa.int64()), pa.array(starts), pa.array(tokens), pa.array(ids, pa.binary())], names=["part", "doc_id", "local_start", "doc_tokens", "ids"])

    return materialize(whole_texts(docs).mapInArrow(tidied(encode), STREAM))


def pack(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the piece's ids as little-endian unsigned 32-bit integers."""
    stream = token_stream(docs, tokenizer_path, end_id)
    totals = {r.part: r.n for r in stream.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()}  # a number per input partition
    offsets, at = {}, 0
    for part in sorted(totals):
        offsets[part] = at
        at += totals[part]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("cutting", list)
        for batch in batches:
            part, doc_id, local, tokens, blob = (batch.column(i).to_pylist() for i in range(5))
            rows: list[tuple] = []
            for p, d, s, n, b in zip(part, doc_id, local, tokens, blob, strict=True):
                ids = np.frombuffer(b, "<u2" if len(b) == 2 * n else "<u4").astype("<u4")
                g = offsets[p] + s
                start = 0
                while start < n:
                    seq, off = divmod(g + start, length)
                    size = min(length - off, n - start)
                    raw = ids[start : start + size].tobytes()
                    rows.append((d, start, size, zlib.crc32(raw), n, seq, off) + ((raw,) if with_ids else ()))
                    start += size
            names = [x.split()[0] for x in schema.split(", ")]
            types = [pa.binary() if x == "ids" else pa.int64() for x in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(names), types, strict=True)], names=names)

    schema = PIECES + (", ids binary" if with_ids else "")
    return stream.mapInArrow(tidied(cut), schema)
