"""Quality classifier (operator 3): hashed word n-gram logistic regression, trained with FTRL, scored as sparse dot products.

Tokens are runs of word characters or of other visible characters; features are hashed token unigrams and
bigrams, and hashed class bigrams, in which each token is replaced by its class (case of its letters, digits, or the
punctuation itself) with a mark for tokens that recur at once; each is weighted by its share of the document. Training uses at
most ``TRAIN_ROWS`` labelled documents (the smallest hashes of doc_id; repeated labels of a document are
averaged, 0.5 and more is 1) and of these, in that order, as many as ``TRAIN_BYTES`` of sparse features hold. One task visits
them in a fixed order and updates one document at a time; the driver gets the weights, never the features. Scoring reads every
whole text once where it lies, with the weights (a fixed ``1 << BITS`` floats) broadcast. No shuffle.

Defined results: null and blank texts have no features and get the bias's score; without labels of both
kinds every weight is zero and the score 0.5; repeated rows are scored each; of rows that share a labelled doc_id the one with
the smallest feature vector is learned from; an empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, hash_sample, materialize, only_cache, small_slices, tidied, whole_texts

BITS = 20
TRAIN_ROWS = 12_000
TRAIN_BYTES = 256 << 20
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
THRESHOLD = 0.3
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Parts of the feature space: unigrams, bigrams, shape bigrams.
KINDS = 3
SCALE = 4.0


def shape(token: str) -> int:
    """Class of a token: its script case, digits, or the punctuation itself."""
    if token.isalpha():
        return 1 if token.islower() else 2 if token.istitle() else 3 if token.isupper() else 4
    if token.isdigit():
        return 5
    return 6 if token.isalnum() else 16 + zlib.crc32(token.encode()) % 4096


class Hashes(dict):
    """token -> crc32 and shape, packed in one number; dropped when large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[token] = found = zlib.crc32(token.encode()) | shape(token) << 32
        return found


_SEEN = Hashes()


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value), a row for each occurrence, documents in order."""
    seen, mask = _SEEN, np.uint64((1 << bits) - 1)
    tokens = [TOKEN.findall(t) for t in texts]
    sizes = np.array([len(t) for t in tokens], np.int64)
    flat = np.fromiter((seen[t] for ts in tokens for t in ts), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    word, form = flat & np.uint64(0xFFFFFFFF), flat >> np.uint64(32)
    pair = np.flatnonzero(doc[1:] == doc[:-1])

    def mix(x: np.ndarray) -> np.ndarray:
        x = x * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)) & mask

    with np.errstate(over="ignore"):
        one = mix(word + np.uint64(1))
        two = mix(word[pair] * np.uint64(0x100000001B3) + word[pair + 1] + np.uint64(7))
        again = (word[pair] == word[pair + 1]).astype(np.uint64)  # the shape bigram tells a token that recurs
        far = pair + 2
        inside = far < len(word)
        again[inside] += np.uint64(2) * ((word[pair[inside]] == word[far[inside]]) & (doc[pair[inside]] == doc[far[inside]])).astype(np.uint64)
        three = mix((again << np.uint64(40)) + (form[pair] << np.uint64(16)) + form[pair + 1] + np.uint64(0xABCDEF0123))
    docs = np.concatenate([doc, doc[pair], doc[pair]])
    index = np.concatenate([one, two, three]).astype(np.int64)
    share = SCALE / np.maximum(sizes, 1)
    return docs, index, share[docs]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias by follow-the-regularised-leader (proximal), one document at a time."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    if len({y for _, _, y in rows}) < 2:
        return np.zeros(size, np.float32), 0.0
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, value, y = rows[k]
            i, x = np.append(index.astype(np.int64), size), np.append(value.astype(np.float64), 1.0)
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    every = weight(np.arange(size + 1))
    return every[:size].astype(np.float32), float(every[size])


def held_out(folds: int):
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds) == 0


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled documents outside the held-out fold."""
    y = labels.where("doc_id is not null and quality is not null").where(~held_out(folds)).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    y = hash_sample(y, train_rows, y.count(), "doc_id")
    picked = whole_texts(docs).join(F.broadcast(y), "doc_id")  # at most train_rows pairs of numbers

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch, 1, 64):
                doc, index, value = features(part.column(1).to_pylist(), bits)
                key, inverse = np.unique(doc << bits | index, return_inverse=True)
                total = np.bincount(inverse, value, len(key)).astype(np.float32)
                cuts = np.searchsorted(key >> bits, np.arange(part.num_rows + 1))
                ids = (key & ((1 << bits) - 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()), pa.array([total[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["doc_id", "y", "ids", "vals"])

    sparse_rows = picked.select("doc_id", "text", "y").mapInArrow(tidied(sparse), "doc_id long, y int, ids binary, vals binary")
    place = F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("place")
    rows = materialize(sparse_rows.groupBy("doc_id", "y").agg(F.min(F.struct("ids", "vals")).alias("x")).select(place, "doc_id", "y", "x.ids", "x.vals"))
    sizes = sorted(rows.select("place", "doc_id", F.octet_length("ids").alias("n")).collect())  # at most train_rows triples of numbers
    fits = int(np.searchsorted(np.cumsum([2 * r.n for r in sizes]), train_bytes, "right"))
    if fits < len(sizes):
        stop = sizes[fits]  # the first that doesn't fit
        rows = rows.where((F.col("place") < stop.place) | ((F.col("place") == stop.place) & (F.col("doc_id") < stop.doc_id)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("quality", _SEEN.clear)
        held = []  # at most train_rows sparse rows and train_bytes, where they lie in the batches
        for batch in batches:
            place, doc_id, y, ids, vals = batch.columns
            held += zip(place.to_pylist(), doc_id.to_pylist(), y.to_pylist(), (np.frombuffer(x.as_buffer(), np.int32) for x in ids), (np.frombuffer(x.as_buffer(), np.float32) for x in vals), strict=True)
        held.sort(key=lambda r: r[:2])
        weights, bias = train([(ids, vals, y) for _, _, y, ids, vals in held], bits)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    [found] = rows.coalesce(1).mapInArrow(tidied(learn), "weights binary, bias double").collect()  # one task's single row
    return np.frombuffer(found.weights, np.float32), found.bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], *keep: str, bits: int = BITS) -> DataFrame:
    """doc_id, the named columns, and score: the chance that a document is of good quality."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"), *keep)
    kept = docs.select("doc_id", *keep)

    names = [*kept.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        only_cache("quality", _SEEN.clear)
        for batch in batches:
            for part in small_slices(batch, 1, 128):
                doc, index, value = features(part.column(1).to_pylist(), bits)
                margin = bias + np.bincount(doc, weights[index] * value, part.num_rows)
                found = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(found)], names=names)

    schema = kept.schema.add("score", "double")
    return out.mapInArrow(tidied(run), schema)


def classify(docs: DataFrame, labels: DataFrame, *keep: str, folds: int = 5) -> DataFrame:
    """doc_id, the named columns, held_out, score and predicted, for every row of docs."""
    scored = score(docs, fit(docs, labels, folds), *keep)
    return scored.withColumn("held_out", F.coalesce(held_out(folds), F.lit(False))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
