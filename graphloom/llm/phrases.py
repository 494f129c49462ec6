"""Phrase collocations: frequent phrases of two to five words, scored exactly, per language.

Method: a first pass counts words; only words of at least ``least`` occurrences can be in a phrase, and get numbers in the order of
(lang, word). A second pass numbers the texts and builds, per shard of bounded tokens, a count trie of depth ``depth``, level by level: a level's
nodes are sorted by (parent, word), so every level is a sorted run. Shards cut their tries at common boundaries (prefixes found by sampling
trie nodes, also inside a frequent word's or phrase's subtree) and send each prefix range a compressed part; a range's parts are merged level by
level, and nodes under a parent that stays below ``least`` are never merged. A walk down the merged trie gives every phrase the counts of its
left parts (those above the range's first node lie in another range and are looked up); right parts are suffix links: the node of
the phrase without its first words, looked up by a join. Counts are whole: no shard drops anything by its own counts.

Sizes: a shard holds ``SHARD`` tokens, a range about ``RANGE`` nodes over all shards, so tasks grow in number and not in size. Boundaries are broadcast:
20 bytes a range, 200 MB at 100 TB of text. Numbers of words are broadcast up to ``WORDS`` words; beyond, texts are numbered by a join, with equal results.

Results: a null text is empty, a null lang ``und``; lang ``und`` itself is the same language. Repeated rows count as often as they occur, doc_id and
other columns are ignored. A text of any length is read in slices that overlap by ``depth - 1`` words. Empty tables give no rows. Ties are in the order below.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import HEAVY_ROWS, bounded_batches, materialize, tidied
from graphloom.operators.relational import numbered

#: Tokens of a shard, trie nodes of a range, words whose numbers are broadcast.
SHARD, RANGE, WORDS = 1_000_000, 4_000_000, 500_000
#: Words of a slice of a text, bytes that are split into words at once, words that a task counts before it hands counts on.
SLICE, BYTES, COUNTED = 1 << 16, 1 << 20, 200_000
#: Trie nodes sampled for each range, and tokens that the sample reads for each.
SAMPLES, SAMPLE_TOKENS = 64, 2_000
#: Marks between pieces; a word can't hold it.
BREAK = b"."
_BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", BREAK * 9)
_EDGE = re.compile(rb"[ \t.,;:!?\n-\r]")


def tokens(raw: bytes):
    """Lists of words of a text's bytes, A-Z lower-cased, with BREAK between pieces; joined, they are the text's."""
    low = 0
    while low < len(raw):
        edge = _EDGE.search(raw, low + BYTES)
        high = edge.end() if edge else len(raw)
        yield raw[low:high].lower().translate(_BREAKS).replace(BREAK, b" . ").split()
        low = high


def slices(raw: bytes, depth: int):
    """(words, own): phrases that start among the first ``own`` words are this slice's; up to depth - 1 words follow them."""
    held: list[bytes] = []
    for words in tokens(raw):
        held += words
        while len(held) >= SLICE + depth:
            yield held[: SLICE + depth - 1], SLICE
            held = held[SLICE:]
    if held:
        yield held, len(held)


def texts_of(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def word_counts(texts: DataFrame, least: int) -> DataFrame:
    """(lang, word, f) of the words with at least that many occurrences, and per lang a row of word null and all words' count; written once."""

    def count(batches):
        schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("f", pa.int64())])
        found: dict[str, Counter] = {}

        def flush():
            for lang, words in found.items():
                words.pop(BREAK, None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(words) + 1)), pa.array([*words, None], pa.binary()), pa.array([*words.values(), words.total()], pa.int64())], schema=schema)
            found.clear()

        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                for words in tokens(raw.as_py()):
                    found.setdefault(lang, Counter()).update(words)
                if sum(map(len, found.values())) > COUNTED:
                    yield from flush()
        yield from flush()

    counts = texts.mapInArrow(tidied(count), "lang string, word binary, f bigint")
    counts = counts.groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return materialize(counts.where((F.col("f") >= least) | F.col("word").isNull()))


def trie(ids: np.ndarray, start: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(parent, word, count) per level of the count trie of all phrases that begin at a start; id 0 ends a phrase. Levels are sorted."""
    at = np.flatnonzero(start & (ids > 0))
    word, node, count = np.unique(ids[at], return_inverse=True, return_counts=True)
    levels = [(np.zeros(len(word), np.int64), word.astype(np.int64), count)]
    for d in range(1, depth):
        inside = at + d < len(ids)
        at, node = at[inside], node[inside]
        alive = ids[at + d] > 0
        at, node = at[alive], node[alive]
        key, node, count = np.unique((node.astype(np.int64) << 32) | ids[at + d], return_inverse=True, return_counts=True)
        levels.append((key >> 32, key & 0xFFFFFFFF, count))
    return levels


def paths(levels) -> list[np.ndarray]:
    """Per level, the nodes' words from the root: nodes x level."""
    out = []
    for parent, word, _ in levels:
        out.append(word[:, None] if not out else np.concatenate([out[-1][parent], word[:, None]], axis=1))
    return out


def cuts(levels, bounds: np.ndarray) -> list[np.ndarray]:
    """Per level, how many nodes come before each boundary (rows of words, padded with zeros) when phrases are sorted, a prefix first."""
    out, low, there = [], np.zeros(len(bounds), np.int64), np.ones(len(bounds), bool)
    for d, (parent, word, _) in enumerate(levels):
        key = (parent << 32) | word
        sought = (low << 32) | np.where(there, bounds[:, d], 0)
        low = np.searchsorted(key, sought)
        there = there & (low < len(key)) & (bounds[:, d] > 0)
        there[there] = key[low[there]] == sought[there]
        deeper = there & (bounds[:, d + 1] > 0) if d + 1 < bounds.shape[1] else np.zeros(len(bounds), bool)
        out.append(low + deeper)
    return out


def _planes(values: np.ndarray) -> bytes:
    """Numbers below 2^32 byte plane by byte plane, which compresses well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def packed(levels, low: list[int], high: list[int]) -> bytes | None:
    """The nodes [low, high) of each level with their ancestors (count 0 outside the range), compressed; None without nodes."""
    import zstandard

    if all(a >= b for a, b in zip(low, high)):
        return None
    first, last = list(low), [max(a, b) for a, b in zip(low, high)]
    for d in range(len(levels) - 1, 0, -1):
        if first[d] < last[d]:
            first[d - 1] = min(first[d - 1], int(levels[d][0][first[d]]))  # only a prefix of the boundary lies before it
    body = []
    for d, (parent, word, count) in enumerate(levels):
        count = count[first[d] : last[d]].copy()
        count[: low[d] - first[d]] = 0
        body += [_planes(word[first[d] : last[d]]), _planes(count)]
        if d:
            body.append(_planes(np.bincount(parent[first[d] : last[d]] - first[d - 1], minlength=last[d - 1] - first[d - 1])))
    sizes = np.array([b - a for a, b in zip(first, last)], "<u4").tobytes()
    return sizes + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpacked(data: bytes, depth: int):
    """Per level (words, counts, children of each node of the level above)."""
    import zstandard

    sizes = np.frombuffer(data[: 4 * depth], "<u4").astype(int)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4 * depth :], max_output_size=1 << 31), np.uint8)
    at, out = 0, []

    def take(n):
        nonlocal at
        at += 4 * n
        return np.ascontiguousarray(raw[at - 4 * n : at].reshape(4, n).T).view("<u4").ravel()

    for d in range(depth):
        word, count = take(sizes[d]), take(sizes[d])
        out.append((word, count, take(sizes[d - 1]) if d else None))
    return out


def merged(parts: list[bytes], low: np.ndarray, depth: int, least: int):
    """Per level (words of the phrases, counts, counts of their left parts) of one range: its phrases of at least that many occurrences.

    ``low`` is the range's first phrase, padded with zeros. Its proper prefixes belong to another range: as a left part their count is -1.
    """
    blocks = [unpacked(p, depth) for p in parts]
    above = None  # of every part's node in the level above, the merged node, or -1
    path = lefts = guests = total = None
    for d in range(depth):
        word = np.concatenate([b[d][0] for b in blocks]).astype(np.int64)
        count = np.concatenate([b[d][1] for b in blocks]).astype(np.int64)
        if d:
            parent = above[np.repeat(np.arange(len(above)), np.concatenate([b[d][2] for b in blocks]))]
        else:
            parent = np.zeros(len(word), np.int64)
        alive = np.flatnonzero(parent >= 0)
        key, node = np.unique((parent[alive] << 32) | word[alive], return_inverse=True)
        order = np.argsort(node, kind="stable")
        ends = np.searchsorted(node[order], np.arange(len(key)))
        f = np.add.reduceat(count[alive][order], ends) if len(key) else np.zeros(0, np.int64)
        up, w = key >> 32, key & 0xFFFFFFFF
        guest = (w == low[d]) & (low[d + 1] > 0 if d + 1 < depth else False)
        if d:
            guest &= guests[up]
            lefts = np.concatenate([lefts[up], np.where(guests[up], -1, total[up])[:, None]], axis=1)
            path = np.concatenate([path[up], w[:, None]], axis=1)
        else:
            lefts, path = np.zeros((len(key), 0), np.int64), w[:, None]
        stays = guest | (f >= least)
        number = np.where(stays, np.cumsum(stays) - 1, -1)
        above = np.full(len(word), -1, np.int64)
        above[alive] = number[node]
        path, lefts, total, guests = path[stays], lefts[stays], f[stays], guest[stays]
        yield path[~guests], total[~guests], lefts[~guests]


def numbered_slices(texts: DataFrame, words: DataFrame, many: int, depth: int) -> tuple[DataFrame, object]:
    """Slices of texts and what turns one row into (ids, own) lists: ids of words, 0 for breaks and rarer words.

    Up to WORDS words, texts themselves and a broadcast of the words' numbers; beyond, (ids, own) rows made by a join.
    """
    spark = texts.sparkSession
    if many <= WORDS:
        table = words.select("lang", "word", "id").toArrow()
        names, keys, ids = (table.column(c).to_pylist() for c in ("lang", "word", "id"))
        shared = spark.sparkContext.broadcast((names, keys, ids))
        known: dict[str, dict[bytes, int]] = {}

        def read(batch):
            if not known:
                for lang, word, number in zip(*shared.value):
                    known.setdefault(lang, {})[word] = number
                known.setdefault("", {})
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                get = known.get(lang, {}).get
                for part, own in slices(raw.as_py(), depth):
                    yield np.fromiter(map(get, part, repeat(0)), np.int64, len(part)), own

        return texts, read

    def cut(batches):
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part, own in slices(raw.as_py(), depth):
                    yield pa.RecordBatch.from_pylist([{"lang": lang, "own": own, "part": part}], schema=pa.schema([("lang", pa.string()), ("own", pa.int32()), ("part", pa.list_(pa.binary()))]))

    # written with their numbers, so that a task that runs again gives the same ones
    parts = materialize(texts.mapInArrow(cut, "lang string, own int, part array<binary>").withColumn("slice", F.monotonically_increasing_id()))
    each = parts.select("slice", "own", "lang", F.posexplode("part").alias("pos", "word")).join(words.select("lang", "word", "id"), ["lang", "word"], "left")
    rows = each.groupBy("slice", "own").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(0)).alias("id")))), lambda x: x["id"]).alias("ids"))

    def listed(batch):
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield ids.values.to_numpy(zero_copy_only=False).astype(np.int64), own

    return rows.select("own", "ids"), listed


def _tries(batches, read, depth: int):
    """Tries of shards of bounded tokens."""
    ids, starts, held = [], [], 0

    def build():
        return trie(np.concatenate(ids), np.concatenate(starts), depth)

    for batch in batches:
        for part, own in read(batch):
            ids += [part, np.zeros(1, np.int64)]
            starts.append(np.arange(len(part) + 1) < own)
            held += len(part) + 1
            if held >= SHARD:
                yield build()
                ids, starts, held = [], [], 0
    if held:
        yield build()


def boundaries(rows: DataFrame, read, n: int, depth: int, ranges: int) -> np.ndarray:
    """ranges - 1 phrases (words, padded with zeros) that deal a shard's trie nodes evenly, from a sample of the texts: balance only."""
    if ranges < 2:
        return np.zeros((0, depth), np.int64)
    share = min(1.0, ranges * SAMPLE_TOKENS / max(n, 1))
    sampled = rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    every = max(1, depth * int(n * share) // (ranges * SAMPLES))

    def sample(batches):
        for levels in _tries(batches, read, depth):
            for path in paths(levels):
                mixed = np.zeros(len(path), np.uint64)
                for column in path.T:
                    mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                chosen = path[mixed % np.uint64(every) == 0]
                wide = np.zeros((len(chosen), depth), np.int64)
                wide[:, : chosen.shape[1]] = chosen
                yield pa.RecordBatch.from_arrays([pa.array(wide.tolist(), pa.list_(pa.int64()))], ["key"])

    keys = numbered(sampled.mapInArrow(tidied(sample), "key array<bigint>"), F.col("key"), name="place")
    step = max(1, keys.count() // ranges)
    found = keys.where((F.col("place") % step == 0) & (F.col("place") > 0)).select("key").distinct().orderBy("key").toArrow().column("key")
    return np.array(found.to_pylist(), np.int64).reshape(-1, depth)


def counted(docs: DataFrame, depth: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, id, n) and all frequent phrases (ids, f, lefts) of up to ``depth`` words, single words among them; both written once."""
    texts = texts_of(docs)
    counts = word_counts(texts, least)
    sizes = counts.where("word IS NULL").select("lang", F.col("f").alias("n"))
    words = numbered(counts.where("word IS NOT NULL").select("lang", "word"), F.col("lang"), F.col("word"), name="id")
    words = materialize(words.join(_small(sizes), "lang").select("lang", "word", (F.col("id") + 1).alias("id"), "n"))
    n, many = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], words.count()
    rows, read = numbered_slices(texts, words, many, depth)
    bounds = boundaries(rows, read, n, depth, -(-depth * n // RANGE))

    def shard(batches):
        for levels in _tries(batches, read, depth):
            sizes_ = [np.array([len(x[1])]) for x in levels]
            at = [np.concatenate([[0], c, s]) for c, s in zip(cuts(levels, bounds), sizes_)]
            for r in range(len(bounds) + 1):
                part = packed(levels, [int(a[r]) for a in at], [int(a[r + 1]) for a in at])
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([part], pa.binary())], ["range", "part"])

    def merge(table: pa.Table) -> pa.Table:
        r = table.column("range")[0].as_py()
        low = bounds[r - 1] if r else np.zeros(depth, np.int64)
        out = []
        for path, total, lefts in merged(table.column("part").to_pylist(), low, depth, least):
            rows_, width = path.shape
            flat = lambda m, k: pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * k, pa.int32()), pa.array(m.ravel(), pa.int64()))
            out.append(pa.Table.from_arrays([flat(path, width), pa.array(total, pa.int64()), flat(lefts, width - 1)], ["ids", "f", "lefts"]))
        return pa.concat_tables(out)

    parts = rows.mapInArrow(tidied(shard), "range int, part binary")
    return words, materialize(parts.groupBy("range").applyInArrow(merge, "ids array<bigint>, f bigint, lefts array<bigint>"))


def _small(df: DataFrame) -> DataFrame:
    """df for a broadcast if it has few rows; otherwise as it is, for a join by shuffles."""
    return F.broadcast(df) if df.limit(HEAVY_ROWS + 1).count() <= HEAVY_ROWS else df


def collocations(docs: DataFrame, depth: int = 5, least: int = 100, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: phrases of 2 to ``depth`` words with a >= ``least`` occurrences, each lang's first ``top``.

    A cut after k words gives l and r, the occurrences of both parts, and floor(1000 a n / (l r)) with n the lang's words; a phrase has the cut
    of the lowest score (ties: smallest k). Phrases that lie in a longer one with as many occurrences are left out. By score and a,
    descending, then by the phrase's bytes.
    """
    words, found = counted(docs, depth, least)
    n_of = words.select(F.col("id").alias("first"), "lang", "n")
    phrases = found.where(F.size("ids") > 1)
    # a phrase inside a longer one of equal count is inside one that is longer by one word, also of that count
    inner = found.where(F.size("ids") > 2).select(F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"), F.col("f").alias("sup"))
    covered = phrases.select("ids", "f", F.lit(0).cast("bigint").alias("sup")).unionByName(inner.select("ids", F.lit(0).cast("bigint").alias("f"), "sup"))
    open_ = covered.groupBy("ids").agg(F.max("f").alias("f"), F.max("sup").alias("sup")).where("sup < f").select("ids")
    kept = materialize(phrases.join(open_, "ids"))

    each = kept.select("ids", F.col("f").alias("a"), F.posexplode("lefts").alias("k", "l"))
    each = each.select("ids", "a", (F.col("k") + 1).alias("k"), "l", F.expr("slice(ids, k + 2, size(ids))").alias("rest"))
    each = each.join(found.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest").drop("rest")
    elsewhere = each.where("l < 0").withColumn("head", F.expr("slice(ids, 1, k)"))
    elsewhere = elsewhere.drop("l").join(found.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head").drop("head")
    each = each.where("l >= 0").unionByName(elsewhere)
    each = each.withColumn("first", F.element_at("ids", 1)).join(_small(n_of), "first").drop("first")
    # up to 1000 a n < 2^127 for all counts below 1e17; the quotient is at most 1000 n / a
    exact = F.expr("CAST((1000BD * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) AS DECIMAL(38,0)) div CAST(CAST(l AS DECIMAL(17,0)) * CAST(r AS DECIMAL(17,0)) AS DECIMAL(38,0))")
    best = each.withColumn("score", exact).groupBy("ids", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("ids", "lang", "a", "n", "cut.score", "cut.l", "cut.r")

    spelled = best.select("ids", F.posexplode("ids").alias("pos", "id")).join(_small(words.select("id", "word")), "id")
    spelled = spelled.groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("word").cast("string").alias("word")))).alias("each"))
    out = best.join(spelled, "ids").withColumn("phrase", F.array_join(F.transform("each", lambda x: x["word"]), " "))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # each of many parts of a lang gives its first ones, so no task sorts a whole lang
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = out.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)))
        out = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
