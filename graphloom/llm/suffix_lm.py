"""Language-model scoring (operator 5): a probabilistic suffix tree over words.

Symbols are ASCII-lower-cased words and one end per text. The root gives each symbol its add-0.1 unigram probability from
exact counts of all training tokens. Contexts of up to ``DEPTH`` words are tree nodes where their count reaches a floor
and their next-symbol distribution passes a divergence test: the log-likelihood that it gains over the longest
retained suffix's, on the training counts, is at least ``PRUNE`` nats per listed symbol. A node lists next symbols whose
count after it reaches another floor; it is smoothed with its suffix's distribution by ``KAPPA`` pseudo-counts, and what it doesn't list
shares the remaining mass in proportion to that suffix's. A text is scored from its longest suffix states, word by word.

The floors are multiples of the square root of the training tokens, ``CONTEXT`` and ``PAIR``: one rule for every size, without a least
or a greatest floor. So the tree grows with the corpus, as its root: for n training tokens a length has at most
sqrt(n) / ``CONTEXT`` nodes and sqrt(n) / ``PAIR`` listed symbols.

Exact counts: documents are dealt into chunks; a chunk sends each distinct token once per bucket, as a 64-bit hash and a
count, and gets the corpus counts back in the same order. So they grow with the input and no token's rows meet in one task
beyond one per chunk. What is broadcast is the tree, whole at any size: frequent words, nodes and listed symbols (16 bytes each) within the square
roots above. Each length is counted in one pass over the training texts.

Defined results: null texts are empty (one end); null doc_ids are training rows; repeated rows count and are scored each;
an empty table gives an empty result; columns other than doc_id and text are ignored. Different tokens with equal 64-bit
hashes would share a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import chunked, materialize, tidied, tidy, whole_texts

DEPTH = 3
CONTEXT, PAIR = 0.5, 0.03
# bounds that tests pass to least(); the tree has none
MOST_CONTEXTS, MOST_PAIRS = 1 << 18, 1 << 21
LEAST_CONTEXT, LEAST_PAIR = 16, 3
PRUNE, KAPPA = 3.0, 20.0
ADD = 0.1
CHUNK_BYTES = 8 << 20
FOLDS = 10


class Ids(dict):
    """word -> position of its first sight; the end is the empty word, 0."""

    def __init__(self) -> None:
        super().__init__()
        self[b""] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(local ids of all tokens, tokens per text, hashes of the local vocabulary)."""
    from xxhash import xxh64_intdigest

    ids = Ids()
    get, parts = ids.__getitem__, []
    for t in texts:
        words = t.encode().lower().split()
        words.append(b"")
        parts.append(np.fromiter(map(get, words), np.int32, len(words)))
    flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return flat, np.array([len(p) for p in parts], np.int64), np.fromiter((xxh64_intdigest(w, 7) for w in ids), np.uint64, len(ids))


END_HASH = int(tokens([])[2][0])


def find(keys: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Positions of want in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(want), -1)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, at, -1)


def least(total: int, root: float, most: float = np.inf, floor: float = 0) -> float:
    """A floor on counts among ``total`` tokens. The tree gives no bounds: any would make scores switch rules at some size."""
    return max(floor, root * total**0.5, total / most)


class Level:
    """Contexts of one length. words: each one's words; parent: its suffix one level down; codes = context * F + symbol."""

    def __init__(self, words: np.ndarray, parent: np.ndarray, total: np.ndarray, codes: np.ndarray):
        self.words, self.parent, self.total = words, parent, total
        self.enter = codes  # codes of the level above (word ids at the first level) that lead into contexts, sorted
        self.codes, self.p = np.empty(0, np.int64), np.empty(0)
        self.keep, self.alpha = np.zeros(len(words), bool), np.ones(len(words))


class SuffixTree:
    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        self.order = np.sort(hashes)
        counts = counts[np.argsort(hashes)]
        self.total, self.distinct, self.levels = total, distinct, []
        self.root = self.base(counts)
        self.size = len(self.order)
        self.end = int(find(self.order, np.array([END_HASH], np.uint64))[0]) if self.size else -1
        ok = np.flatnonzero((counts >= least(total, CONTEXT)) & (np.arange(self.size) != self.end))
        self.levels.append(Level(ok[:, None], np.zeros(len(ok), np.int64), counts[ok], ok))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADD) / (self.total + ADD * (self.distinct + 1))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        return find(self.order, hashes)

    def states(self, sym: np.ndarray) -> list[np.ndarray]:
        """Per level the context that ends at each token, or -1. No context holds an end, so none crosses texts."""
        out: list[np.ndarray] = []
        for k, level in enumerate(self.levels):
            if k == 0:
                table = np.full(self.size + 1, -1)
                table[level.enter] = np.arange(len(level.enter))
                out.append(table[sym])
                continue
            state = np.full(len(sym), -1)
            at = np.flatnonzero((out[-1][:-1] >= 0) & (sym[1:] >= 0)) + 1
            state[at] = find(level.enter, out[-1][at - 1] * self.size + sym[at])
            out.append(state)
        return out

    def probability(self, depth: int, context: np.ndarray, sym: np.ndarray, root: np.ndarray) -> np.ndarray:
        """P(symbol | context of that length), backing off along retained suffixes; root: the symbols' root probabilities."""
        out, factor, live = np.zeros(len(sym)), np.ones(len(sym)), np.arange(len(sym))
        for k in range(depth - 1, -1, -1):
            level = self.levels[k]
            kept = level.keep[context]
            hit = np.full(len(live), -1)
            ask = np.flatnonzero(kept & (sym[live] >= 0))
            hit[ask] = find(level.codes, context[ask] * self.size + sym[live[ask]])
            got = hit >= 0
            out[live[got]] = factor[live[got]] * level.p[hit[got]]
            factor[live] *= np.where(kept & ~got, level.alpha[context], 1.0)
            live, context = live[~got], level.parent[context[~got]]
        out[live] = factor[live] * root[live]
        return out

    def grow(self, codes: np.ndarray, counts: np.ndarray) -> bool:
        """Fit the deepest level from its pair counts, and add the next one; False where nothing follows."""
        k, level = len(self.levels), self.levels[-1]
        by = np.argsort(codes)
        codes, counts = codes[by], counts[by].astype(float)
        context, sym = codes // self.size, codes % self.size
        parent = self.probability(k - 1, level.parent[context], sym, self.root[sym]) if len(codes) else np.empty(0)
        n = len(level.words)
        total = np.maximum(level.total, 1).astype(float)
        listed, below = np.bincount(context, counts, n), np.bincount(context, parent, n)
        weight = total / (total + KAPPA)
        rest = np.clip(1 - listed / total, 0, 1)
        open_mass = np.clip(1 - below, 1e-12, 1)
        level.alpha = weight * rest / open_mass + (1 - weight)
        p = weight[context] * counts / total[context] + (1 - weight[context]) * parent
        gain = np.bincount(context, counts * np.log(p / parent), n) + (total - listed) * np.log(np.maximum(level.alpha, 1e-300))
        level.keep = gain >= PRUNE * (np.bincount(context, minlength=n) + 1)
        level.codes, level.p = codes, p
        deeper = np.flatnonzero((counts >= least(self.total, CONTEXT)) & (sym != self.end))
        if k >= DEPTH or not len(deeper):
            return False
        words = np.concatenate([level.words[context[deeper]], sym[deeper, None]], axis=1)
        known = {tuple(w): i for i, w in enumerate(level.words.tolist())}
        suffix = np.array([known[tuple(w[1:])] for w in words.tolist()], np.int64)
        self.levels.append(Level(words, suffix, counts[deeper].astype(np.int64), codes[deeper]))
        return True

    def log10(self, sym: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Each token's log10 probability from the longest retained state before it."""
        longest, where = np.zeros(len(sym), np.int64), np.full(len(sym), -1)
        for k, state in enumerate(self.states(sym)):
            at = np.flatnonzero(state[:-1] >= 0)
            at = at[self.levels[k].keep[state[at]]]
            longest[at + 1], where[at + 1] = k + 1, state[at]
        out = np.log10(root)
        for k in range(1, len(self.levels) + 1):
            at = np.flatnonzero(longest == k)
            out[at] = np.log10(self.probability(k, where[at], sym[at], root[at]))
        return out


BACK = "kind int, chunk int, bucket int, hashes binary, counts binary, n long, v long"
BACK_SCHEMA = pa.schema([("kind", pa.int32()), ("chunk", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
SENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
FREQUENT, STATS, COUNTS = 2, 1, 0


def dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket and hash, where each bucket starts)."""
    bucket = (hashes >> np.uint64(40)) % np.uint64(buckets)
    order = np.lexsort((hashes, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def corpus_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """Counts of every token of each chunk over all training texts, in the order of dealt(), with totals and frequent tokens."""

    def send(rows: pa.Table) -> pa.Table:
        flat, sizes, hashes = tokens(rows.column("text").to_pylist())
        train = np.repeat(np.array(rows.column("train").to_pylist(), bool), sizes)
        counts = np.bincount(flat[train], minlength=len(hashes)).astype("<u4")
        order, starts = dealt(hashes, buckets)
        key = rows.column("chunk")[0].as_py()
        return rows_of(SENT_SCHEMA, [(b, key, hashes[order[s:e]].tobytes(), counts[order[s:e]].tobytes()) for b, (s, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)) if e > s])

    def total(rows: pa.Table) -> pa.Table:
        raw, chunk = rows.column("hashes").to_pylist(), rows.column("chunk").to_pylist()
        b = rows.column("bucket")[0].as_py()
        hashes = np.frombuffer(b"".join(raw), np.uint64)
        known, flat = np.unique(hashes, return_inverse=True)
        sums = np.bincount(flat, np.frombuffer(b"".join(rows.column("counts").to_pylist()), "<u4"), len(known)).astype("<i8")
        cuts = np.cumsum([0] + [len(x) // 8 for x in raw])
        often = (sums > 0) & (sums >= least(int(sums.sum()), PAIR))  # a bucket's floor is never above the corpus's
        out = [(COUNTS, c, b, b"", sums[flat[s:e]].tobytes(), 0, 0) for c, s, e in zip(chunk, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return rows_of(BACK_SCHEMA, [*out, (STATS, -1, b, b"", b"", int(sums.sum()), int((sums > 0).sum())), (FREQUENT, -1, b, known[often].tobytes(), sums[often].tobytes(), 0, 0)])

    sent = texts.groupBy("chunk").applyInArrow(send, "bucket int, chunk int, hashes binary, counts binary")
    return materialize(sent.groupBy("bucket").applyInArrow(total, BACK))


def frequent_tokens(back: DataFrame, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of tokens with at least that count."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, c = np.frombuffer(h, np.int64), np.frombuffer(c, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(h[c >= floor]), pa.array(c[c >= floor])], names=["h", "c"])

    rows = back.where(F.col("kind") == FREQUENT).select("hashes", "counts").mapInArrow(keep, "h long, c long").toArrow()
    return rows.column("h").to_numpy().view(np.uint64), rows.column("c").to_numpy()


def pair_counts(texts: DataFrame, tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the deepest level's contexts with frequent next symbols, over all training texts."""
    shared = texts.sparkSession.sparkContext.broadcast(tree)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, codes, counts = shared.value, np.empty(0, np.int64), np.empty(0, np.int64)
        pending: list[np.ndarray] = []

        def merge() -> None:
            nonlocal codes, counts
            if pending:
                fresh, n = np.unique(np.concatenate(pending), return_counts=True)
                codes, flat = np.unique(np.concatenate([codes, fresh]), return_inverse=True)
                counts = np.bincount(flat, np.concatenate([counts, n]), len(codes)).astype(np.int64)
                pending.clear()

        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                flat, _, hashes = tokens(batch.column(0).slice(low, 1000).to_pylist())
                sym = model.symbols(hashes)[flat]
                state = model.states(sym)[-1]
                at = np.flatnonzero((state[:-1] >= 0) & (sym[1:] >= 0))
                pending.append(state[at] * model.size + sym[at + 1])
                if sum(map(len, pending)) > 2_000_000:
                    merge()
                    if len(codes) > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])
                        codes, counts = codes[:0], counts[:0]
        merge()
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

    floor = least(tree.total, PAIR)
    rows = texts.select("text").mapInArrow(tidied(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= floor).toArrow()  # at most total / floor rows
    return rows.column("code").to_numpy(), rows.column("n").to_numpy()


def held_out(folds: int = FOLDS):
    return F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds) == 0, F.lit(False))


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row for each row of docs."""
    texts, n = chunked(docs, chunk_bytes)
    texts = texts.select("chunk", "doc_id", "text", (~held_out()).alias("train"))
    buckets = n // 4 + 64
    back = corpus_counts(texts, buckets)
    stats = back.where(F.col("kind") == STATS).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    total, distinct = stats.n or 0, stats.v or 0
    tree = SuffixTree(*frequent_tokens(back, least(total, PAIR)), total, distinct)
    train = whole_texts(docs).where(~held_out())
    while len(tree.levels[-1].words) and tree.grow(*pair_counts(train, tree)):
        pass
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(rows: pa.Table, counted: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return out.empty_table()
        model = shared.value
        flat, sizes, hashes = tokens(rows.column("text").to_pylist())
        order, starts = dealt(hashes, buckets)
        counts = np.zeros(len(hashes), np.int64)
        for b, c in zip(counted.column("bucket").to_pylist(), counted.column("counts").to_pylist(), strict=True):
            counts[order[starts[b] : starts[b + 1]]] = np.frombuffer(c, "<i8")
        root = model.base(counts)[flat]
        edges = np.cumsum(sizes) - sizes
        known = np.add.reduceat((counts > 0)[flat], edges, dtype=np.int64)
        base = np.add.reduceat(np.log10(root), edges)
        own = np.add.reduceat(model.log10(model.symbols(hashes)[flat], root), edges)
        tidy()
        held = pa.array([not t for t in rows.column("train").to_pylist()])
        return pa.Table.from_arrays([rows.column("doc_id").cast(pa.int64()), held, pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), total)), pa.array(base), pa.array(own)], schema=out)

    counts = back.where(F.col("kind") == COUNTS).select("chunk", "bucket", "counts").groupBy("chunk")
    return texts.groupBy("chunk").cogroup(counts).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
