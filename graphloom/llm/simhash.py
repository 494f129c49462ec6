"""SimHash near-duplicates (operator 7): generalised pigeonhole over 64-bit fingerprints.

A document's fingerprint holds, for each bit, the majority over its word shingles' XXH64 values. Distinct
fingerprints are matched within a Hamming radius r: bits are grouped into parts, correlated bits together;
part i gets a threshold t_i with sum(t_i) = r - parts + 1, so a pair within r is within t_i in at least one part.
Thresholds (and the number of parts) come from dynamic programming on estimated candidate counts; -1 skips a
part. Each fingerprint is indexed under its value in every part and probes all values within t_i; candidates
are verified on all 64 bits. The estimate only steers cost: no threshold choice loses a pair.

Bits and counts are fitted on at most ``FIT_ROWS`` fingerprints (smallest hashes). Equal texts collapse to
one fingerprint before matching, a bucket's pairs are compared block by block and leave it as a spanning
forest, so neither copies nor one full bucket are expanded into all pairs.

Defined results: null and blank texts have fingerprint zero and link like any other; fewer words than a
shingle make one shingle; repeated rows keep one row each; an empty table gives an empty result; null doc_ids
get their component's smallest doc_id; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import buckets_of, dealt_in_blocks, hash_sample, materialize, only_cache, paired, small_slices, tidied, tidy, whole_texts
from graphloom.llm.components import components, forest, local_labels

WORDS, RADIUS, SEED = 3, 2, 42
FIT_ROWS = 20_000
#: Rows of a bucket that are compared with each other at a time.
BLOCK = 1024
#: A bucket of more rows is dealt over several tasks, as pairs of blocks of about so many rows.
BUCKET = 4096


def shingle_hashes(text: str, words: int, seed: int = SEED) -> list[int]:
    """XXH64 of each word shingle, repeats included; ASCII lower case, ASCII white space."""
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().split()
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [xxh64_intdigest(joined, seed)] if parts else []
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    first = [0, *(ends[: len(parts) - words] + 1).tolist()]
    return [xxh64_intdigest(joined[s:e], seed) for s, e in zip(first, ends[words - 1 :].tolist(), strict=True)]


def bit_majority(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of values (sizes > 0): a bit is set where over half of the run has it."""
    pieces = -(-sizes // 255)  # at most 255 values are added up in a byte
    first = np.cumsum(pieces) - pieces
    at = np.repeat(np.cumsum(sizes) - sizes, pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(first, pieces))
    lanes = np.unpackbits(np.ascontiguousarray(flat).view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)  # a byte per bit
    sums = np.add.reduceat(lanes, at, axis=0).view(np.uint8)
    counts = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """One fingerprint per list: bit set where over half of the list's values have it; zero for an empty list."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = bit_majority(np.fromiter(itertools.chain.from_iterable(hashes), np.uint64, int(sizes.sum())), sizes[full])
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint long), as many rows as docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch, 1, 64):
                found = majority([shingle_hashes(t, words, seed) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    return whole_texts(docs).mapInArrow(tidied(run), "doc_id long, fingerprint long")


def bit_parts(sample: np.ndarray, m: int) -> list[list[int]]:
    """m parts of the 64 bits; each is grown from a free bit with those that vary most like it."""
    if len(sample) < 2:
        corr = np.eye(64)
    else:
        bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
        bits -= bits.mean(0)
        norm = np.sqrt((bits**2).sum(0))
        corr = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    free, parts = list(range(64)), []
    for k in range(m):
        size = len(free) // (m - k)
        part = [free.pop(0)]
        while len(part) < size:
            best = max(free, key=lambda b: (corr[b, part].mean(), -b))
            free.remove(best)
            part.append(best)
        parts.append(sorted(part))
    return parts


def values(fps: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for i, b in enumerate(part):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def masks(width: int, t: int) -> np.ndarray:
    """All differences of at most t bits in a part of that width."""
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in itertools.combinations(range(width), k)], np.uint64)


def allocate(sample: np.ndarray, n: int, radius: int) -> list[tuple[list[int], int]]:
    """(part, threshold) of the cheapest allocation with thresholds that sum to radius - parts + 1."""
    best: tuple[float, list] = (float("inf"), [])
    for m in range(1, radius + 3):
        parts = bit_parts(sample, m)
        cost: list[dict[int, float]] = []
        for part in parts:
            _, c = np.unique(values(sample, part), return_counts=True)
            same = max(float((c * (c - 1.0)).sum()) / max(1.0, len(sample) * (len(sample) - 1.0)), 2.0 ** -len(part))
            ball = [sum(comb(len(part), j) for j in range(t + 1)) for t in range(radius + 1)]
            cost.append({-1: 0.0} | {t: n * n / 2 * min(1.0, same * ball[t]) + 40.0 * n * ball[t] for t in range(radius + 1) if ball[t] <= 5000})
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for options in cost:
            nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
            for total, (spent, chosen) in table.items():
                for t, c in options.items():
                    key = total + t + 1
                    if key <= radius + 1 and (key not in nxt or spent + c < nxt[key][0]):
                        nxt[key] = (spent + c, (*chosen, t))
            table = nxt
        if radius + 1 in table and table[radius + 1][0] < best[0]:
            best = (table[radius + 1][0], [(p, t) for p, t in zip(parts, table[radius + 1][1], strict=True) if t >= 0])
    return best[1]


def links_within(part: np.ndarray, key: np.ndarray, fps: np.ndarray, probe: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of all buckets (part, key, i, j) at once, as a forest: short ones by shifted comparison, long ones block by block.

    probe: rows that only probe; at least one end of a link is indexed. A pair of different blocks has its ends in both.
    """
    order, starts, group, size = buckets_of(j, i, key, part)
    fps, probe, own, across = fps[order], probe[order], own[order], (i != j)[order]
    a, b = np.empty(0, np.uint64), np.empty(0, np.uint64)
    for x, y in paired(starts, group, size):
        hit = (np.bitwise_count(fps[x] ^ fps[y]) <= radius) & (fps[x] != fps[y]) & ~(probe[x] & probe[y]) & ~(across[x] & (own[x] == own[y]))
        if hit.any():
            a, b = forest(np.concatenate([a, fps[x[hit]]]), np.concatenate([b, fps[y[hit]]]))
    return a, b


def hamming_links(distinct: DataFrame, radius: int) -> DataFrame:
    """(u, v): links that join all distinct fingerprints within the radius into the right components."""
    n = distinct.count()
    sample = np.array([r[0] for r in hash_sample(distinct.select("fingerprint"), FIT_ROWS, n, "fingerprint").collect()], np.int64).view(np.uint64)
    plan = allocate(sample, n, radius)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [masks(len(p), t) for p, t in plan]
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                fps = batch.column(0).slice(low, 2000).to_numpy(zero_copy_only=False).view(np.uint64)
                for k, (part, _) in enumerate(plan):
                    for i, mask in enumerate(balls[k]):
                        size = len(fps)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k, np.int32)), pa.array((values(fps, part) ^ mask).view(np.int64)), pa.array(fps.view(np.int64)), pa.array(np.full(size, i > 0))], names=["part", "key", "fingerprint", "probe"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches if b.num_rows]
        if got:
            part, key, fps, probe, own, i, j = (np.concatenate(c) for c in zip(*got, strict=True))
            a, b = links_within(part, key, fps.view(np.uint64), probe.astype(bool), own, i, j, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

    entries = distinct.select("fingerprint").mapInArrow(tidied(keys), "part int, key long, fingerprint long, probe boolean")
    dealt = dealt_in_blocks(entries, ("part", "key"), "fingerprint", BUCKET)
    return dealt.select("part", "key", "fingerprint", "probe", "own", "i", "j").mapInArrow(tidied(match), "u long, v long")


def simhash_components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) from (doc_id, fingerprint): smallest doc_id that links reach."""
    prints = materialize(prints.select("doc_id", "fingerprint"))
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    found = components(hamming_links(distinct, radius)).withColumnRenamed("node", "fingerprint")
    classes = distinct.join(found, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "component").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    return simhash_components(fingerprints(docs, words), radius)


# --- similarity mode: links are pairs of texts whose shingle sets have a Jaccard similarity of at least a bound ---

#: Odds of missing a pair at the similarity bound.
MISS = 0.01
#: Candidate pairs that a task gathers before it thins and emits them.
LOT = 500_000
#: Ids that may be broadcast to pick out rows: at most this many 8-byte numbers.
BROADCAST_IDS = 1_000_000
#: Bytes of distinct texts in a block that verifies links.
BLOCK_BYTES = 4 << 20
#: Fingerprints that check a pair before its texts, and standard deviations around their expected distance at the bound.
CHECKS = 4
LOOSE, STRICT = 2.5, -1.5


def agreement(similarity: float) -> float:
    """Chance that one bit of two fingerprints agrees, for sets of one size with that Jaccard similarity."""
    return 1 - float(np.arccos(2 * similarity / (1 + similarity))) / float(np.pi)


def layout(n: int, similarity: float, miss: float = MISS) -> tuple[int, int]:
    """(bits in a part, parts): every part has threshold 0, and parts are added until a miss is as rare as asked."""
    bits = int(min(24, max(12, np.ceil(np.log2(max(2, n))) - 2)))
    return bits, int(np.ceil(np.log(miss) / np.log(1 - agreement(similarity) ** bits)))


class WordHashes(dict):
    """word -> XXH64; dropped when large."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 400_000:
            self.clear()
        self[word] = found = xxh64_intdigest(word, SEED)
        return found


_WORDS = WordHashes()


def remixed(x: np.ndarray, k: int) -> np.ndarray:
    """The values under the k-th of a family of 64-bit mixers; the 0th changes nothing."""
    if k:
        x = (x ^ np.uint64(0xA0761D6478BD642F * k & (1 << 64) - 1)) * np.uint64(0xE7037ED1A0B428DB)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x8EBC6AF09C88C6E3)
        x ^= x >> np.uint64(29)
    return x


def shingle_set(text: str, words: int) -> np.ndarray:
    """Distinct word shingles as sorted 64-bit hashes, a hash of the words' own; fewer words than a shingle are one."""
    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(_WORDS.__getitem__, parts), np.uint64, len(parts))
    n = max(1, len(parts) - words + 1)
    out = np.full(n, len(parts) if len(parts) < words else words, np.uint64)
    for k in range(min(words, len(parts))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n]
    return np.unique(remixed(out, 1))


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity; empty sets are equal."""
    few, many = sorted((len(x), len(y)))
    if few < similarity * many:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (few + many - both)


def wide_prints(sets: list[np.ndarray], count: int) -> np.ndarray:
    """rows x count fingerprints of the sets, each of hashes mixed in another way."""
    sizes = np.array([len(h) for h in sets], np.int64)
    out = np.zeros((len(sets), count), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate(sets)
        for k in range(count):
            out[full, k] = bit_majority(remixed(flat, k), sizes[full])
    return out


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of links a-b that connect what all of them connect, with no link to spare (every part picks one, then they merge)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label, chosen = np.arange(len(nodes)), []
    while True:
        open_ = np.flatnonzero(label[x] != label[y])
        if not len(open_):
            return np.unique(np.concatenate(chosen)) if chosen else open_
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, label[x[open_]], open_)
        np.minimum.at(best, label[y[open_]], open_)
        pick = np.unique(best[best < len(a)])
        chosen.append(pick)
        roots, low = local_labels(label[x[pick]], label[y[pick]])
        merge = np.arange(len(nodes))
        merge[roots] = low
        label = merge[label]


def bit_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int32)


def candidate_pairs(part: np.ndarray, key: np.ndarray, node: np.ndarray, check: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray, strict: int, loose: int, held: list[np.ndarray], lot: int = LOT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes that share a bucket (part, key, i, j), by the distance of their check fingerprints (rows x words), in lots.

    All pairs are compared (of different blocks: those with an end in each). Of those within strict, which are likely
    near-duplicates, only links that connect them are offered; those within loose are where strict ones found so far don't
    connect their ends already. Every other pair lies inside one of the groups of nodes that strict links connect;
    ``held`` gets these, for pairs_across() to offer what verification leaves apart.
    """
    order, starts, group, size = buckets_of(j, i, key, part)
    node, check, own, across = node[order], check[order], own[order], (i != j)[order]
    none = np.empty(0, np.int64)
    near, far, gathered = [(none, none)], [(none, none)], 0

    def thinned() -> tuple[np.ndarray, np.ndarray]:
        """The far pairs that near ones leave apart; near ones are thinned to what connects them."""
        nonlocal gathered
        a, b = (np.concatenate(x) for x in zip(*near, strict=True))
        keep = spanning(a, b)
        near[:] = [(a[keep], b[keep])]
        c, d = (np.concatenate(x) for x in zip(*far, strict=True))
        far[:], gathered = [(none, none)], 0
        if len(keep) and len(c):
            roots, low = local_labels(a[keep], b[keep])

            def name(z: np.ndarray) -> np.ndarray:
                at = np.minimum(np.searchsorted(roots, z), len(roots) - 1)
                return np.where(roots[at] == z, low[at], z)

            apart = name(c) != name(d)
            c, d = c[apart], d[apart]
        pairs = np.unique(np.stack([c, d], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    for x, y in paired(starts, group, size):
        valid = (node[x] != node[y]) & ~(across[x] & (own[x] == own[y]))
        x, y = x[valid], y[valid]
        d = bit_distance(check[x], check[y])
        for found, hit in ((near, d <= strict), (far, (d > strict) & (d <= loose))):
            if hit.any():
                found.append((np.minimum(node[x[hit]], node[y[hit]]), np.maximum(node[x[hit]], node[y[hit]])))
                gathered += int(hit.sum())
        if gathered > lot:
            yield thinned()
    yield thinned()
    a, b = near[0]
    roots, low = local_labels(a, b)
    by = np.argsort(low, kind="stable")
    held += [g for g in np.split(roots[by], np.flatnonzero(np.diff(low[by])) + 1) if len(g) > 2]  # two nodes have one pair, offered
    yield a, b


def pairs_across(node: np.ndarray, label: np.ndarray, check: np.ndarray, own: np.ndarray, across: bool, loose: int, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of one group's nodes within loose whose labels differ, smaller node first, in lots of about ``most``; across: of different blocks only."""
    order = np.lexsort((node, label))
    node, label, check, own = node[order], label[order], check[order], own[order]
    a, b, n = [], [], 0
    for i in range(0, len(node), BLOCK // 2):
        x = slice(i, i + BLOCK // 2)
        for j in range(i, len(node), BLOCK // 2):
            y = slice(j, j + BLOCK // 2)
            if label[x][0] == label[y][-1]:  # sorted: one label throughout
                continue
            p, q = np.nonzero((label[x][:, None] < label[y][None, :]) & (not across or own[x][:, None] != own[y][None, :]) & (bit_distance(check[x][:, None, :], check[y][None, :, :]) <= loose))
            a.append(np.minimum(node[x][p], node[y][q]))
            b.append(np.maximum(node[x][p], node[y][q]))
            n += len(p)
            if n > most:
                yield np.concatenate(a), np.concatenate(b)
                a, b, n = [], [], 0
    if n:
        yield np.concatenate(a), np.concatenate(b)


def by_block(a: np.ndarray, b: np.ndarray, blocks: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block of a, ends a, ends b) of links, packed by block: what travels is a row per block, not per link."""
    block = a.view(np.uint64) % np.uint64(blocks)
    order = np.argsort(block, kind="stable")
    cuts = np.searchsorted(block[order], np.arange(blocks + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        at = order[cuts[k] : cuts[k + 1]]
        yield k, a[at], b[at]


def unpacked(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(rows.column(n).to_pylist()), np.int64) for n in names]


def verified_links(packs: DataFrame, texts: DataFrame, blocks: int, words: int, similarity: float) -> DataFrame:
    """(u, v): links of packs(block, us, vs) whose texts(block, node, text) are similar enough, as far as they connect.

    A block of texts sends each text once to every other block that asks for it, whatever the number of its links there.
    """
    sent = pa.schema([("block", pa.int32()), ("us", pa.binary()), ("vs", pa.binary()), ("nodes", pa.binary()), ("texts", pa.list_(pa.string()))])
    links = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def send(asked: pa.Table, own: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return sent.empty_table()
        u, v = np.unique(np.stack(unpacked(asked, "us", "vs"), 1), axis=0).T
        text = dict(zip(own.column("node").to_pylist(), own.column("text").to_pylist(), strict=True))
        rows = []
        for k, b, a in by_block(np.ascontiguousarray(v), np.ascontiguousarray(u), blocks):
            need = np.unique(a)
            rows.append((k, a.tobytes(), b.tobytes(), need.tobytes(), [text[n] for n in need.tolist()]))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(sent)], schema=sent)

    def check(came: pa.Table, own: pa.Table) -> pa.Table:
        text = dict(zip(own.column("node").to_pylist(), own.column("text").to_pylist(), strict=True))
        sets: dict[int, np.ndarray] = {}
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        out = []
        for row in range(came.num_rows):
            us, vs, nodes = (np.frombuffer(came.column(c)[row].as_py(), np.int64).tolist() for c in ("us", "vs", "nodes"))
            theirs = {n: shingle_set(t, words) for n, t in zip(nodes, came.column("texts")[row].as_py(), strict=True)}
            for u, v in zip(us, vs, strict=True):
                a, b = find(u), find(v)
                if a == b:
                    continue
                if v not in sets:
                    sets[v] = shingle_set(text[v], words)
                if similar(theirs[u], sets[v], similarity):
                    root[a] = b
                    out.append((u, v))
        del sets, text
        tidy()
        return pa.Table.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], schema=links)

    dealt = texts.groupBy("block")
    asked = packs.groupBy("block").cogroup(dealt).applyInArrow(send, "block int, us binary, vs binary, nodes binary, texts array<string>")
    return asked.groupBy("block").cogroup(dealt).applyInArrow(check, "u long, v long")


def picked(df: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """Rows of df with (left_semi) or without (left_anti) their column in ids, broadcast only if ids are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, column, how)


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, node, component_id): documents linked by word-shingle sets with at least that Jaccard similarity.

    Fingerprints of several remixed hashes, of each text's distinct shingles, are cut into parts of correlated bits; parts have threshold 0 and are as many as
    recall asks for. Candidates pass a check of fingerprints of their own and then the exact similarity of whole texts.
    node stands for one distinct text; equal texts are one node. Likely near copies are verified along links that connect
    them (see candidate_pairs); what stays apart then is verified in all its pairs, so no candidate is lost.
    """
    spark = docs.sparkSession
    texts = whole_texts(docs).withColumn("node", F.xxhash64(F.sha2(F.col("text").cast("binary"), 256)))
    nodes = materialize(texts.groupBy("node").agg(F.min("doc_id").alias("least"), F.max(F.octet_length("text")).alias("bytes")))
    n = nodes.count()
    blocks = int(max(64, -(-(nodes.agg(F.sum("bytes")).first()[0] or 0) // BLOCK_BYTES)))
    bits, parts = layout(n, similarity)
    per_word = 64 // bits
    prints = -(-parts // per_word) + CHECKS
    p = agreement(similarity)
    strict, loose = (int(64 * CHECKS * (1 - p) + x * np.sqrt(64 * CHECKS * p * (1 - p))) for x in (STRICT, LOOSE))

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("simhash", _WORDS.clear)
        for batch in batches:
            for own in small_slices(batch, 1, 64):
                found = wide_prints([shingle_set(t, words) for t in own.column(1).to_pylist()], prints)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "prints"])

    rows = materialize(texts.select("node", "text").mapInArrow(tidied(wide), "node long, prints binary").dropDuplicates(["node"]))
    sample = [np.frombuffer(r.prints, np.uint64) for r in hash_sample(rows, FIT_ROWS // 10, n, "node").collect()]
    layouts = [bit_parts(np.array([x[k] for x in sample], np.uint64), per_word) for k in range(CHECKS, prints)]
    plan = [(k, part[:bits]) for k, of in enumerate(layouts, CHECKS) for part in of][:parts]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                own = batch.slice(low, 2000)
                found = np.frombuffer(b"".join(own.column(1).to_pylist()), np.uint64).reshape(-1, prints)
                check = pa.array([x.tobytes() for x in found[:, :CHECKS]], pa.binary())
                for i, (k, part) in enumerate(plan):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i, np.int32)), pa.array(values(found[:, k], part).astype(np.int32)), own.column(0), check], names=["part", "key", "node", "chk"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "key", "node")), np.frombuffer(b"".join(b.column("chk").to_pylist()), np.uint64).reshape(-1, CHECKS), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("own", "i", "j"))) for b in batches if b.num_rows]
        if got:
            columns = [np.concatenate(c) for c in zip(*got, strict=True)]
            got.clear()
            held: list[np.ndarray] = []
            for a, b in candidate_pairs(*columns, strict, loose, held):
                yield packed(a, b)
            for low in range(0, len(held), 1000):
                own = [g.tobytes() for g in held[low : low + 1000]]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.binary()), pa.nulls(len(own), pa.binary()), pa.array(own, pa.binary())], names=["block", "us", "vs", "held"])

    def packed(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        packs = list(by_block(a, b, blocks))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in packs], pa.int32()), pa.array([u.tobytes() for _, u, _ in packs], pa.binary()), pa.array([v.tobytes() for _, _, v in packs], pa.binary()), pa.nulls(len(packs), pa.binary())], names=["block", "us", "vs", "held"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), group)), pa.array(own)], names=["group", "node"])

    def rematch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("group", "node", "label", "own", "i", "j")), np.frombuffer(b"".join(x[: 8 * CHECKS] for x in b.column("prints").to_pylist()), np.uint64).reshape(-1, CHECKS)) for b in batches if b.num_rows]
        if got:
            group, node, label, part, i, j, check = (np.concatenate(c) for c in zip(*got, strict=True))
            order, starts, _, size = buckets_of(j, i, group)
            for low, n in zip(starts.tolist(), size.tolist(), strict=True):
                at = order[low : low + n]
                for a, b in pairs_across(node[at], label[at], check[at], part[at], bool(i[at[0]] != j[at[0]]), loose):
                    yield packed(a, b)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(unpacked(pa.Table.from_batches([batch]), "us", "vs"))))], names=["node"])

    entries = rows.mapInArrow(tidied(keys), "part int, key int, node long, chk binary")
    dealt = dealt_in_blocks(entries, ("part", "key"), "node", BUCKET)
    found = materialize(dealt.mapInArrow(tidied(match), "block int, us binary, vs binary, held binary"))
    block = F.expr(f"cast(mod(cast(node as decimal(20,0)) + if(node < 0, 18446744073709551616, 0), {blocks}) as int)")

    def verify(packs: DataFrame) -> DataFrame:
        linked = materialize(packs.mapInArrow(ends, "node long").distinct())
        whole = picked(texts.select("node", "text"), linked, "node", "left_semi").dropDuplicates(["node"])
        return materialize(verified_links(packs, whole.select(block.alias("block"), "node", "text"), blocks, words, similarity))

    links = verify(found.where("block is not null").select("block", "us", "vs"))
    joined = materialize(components(links))
    # the pairs that candidate_pairs held back, where the links in their stead turned out too weak
    held = found.where("held is not null").select(F.xxhash64("held").alias("group"), "held").dropDuplicates(["group"])
    named = materialize(held.mapInArrow(members, "group long, node long").join(joined, "node", "left").select("group", "node", F.coalesce("component", "node").alias("label")))
    split = named.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("group")
    again = named.join(split, "group", "left_semi").join(rows, "node").select("group", "node", "label", "prints")
    packs = materialize(dealt_in_blocks(again, ("group",), "node", BUCKET).mapInArrow(tidied(rematch), "block int, us binary, vs binary, held binary").select("block", "us", "vs"))
    if not packs.isEmpty():
        joined = components(verify(packs).union(joined.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    classes = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "component").select("node", "component_id", "least")
    return texts.select("doc_id", "node").join(named, "node").select("doc_id", "node", "component_id", "least")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row kept of each group of near-duplicates: that with the smallest doc_id (null ids come last)."""
    last = (1 << 63) - 1
    order = F.coalesce("doc_id", F.lit(last)).alias("id")
    node = F.xxhash64(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("node")
    packed = docs.select(F.struct(order, node).alias("key"), F.struct("*").alias("row"))  # whatever the columns are called
    named = similar_documents(docs, words, similarity)
    rows = materialize(named.select(order, "node", F.coalesce("component_id", F.lit(last)).alias("first")))
    # where one doc_id has several texts of its group, the smallest node stays
    stays = rows.where("id = first").groupBy("first").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))
    kept = materialize(stays.select(F.col("first").alias("id"), "node", "n"))
    goes = rows.select("id", "node").distinct().join(kept, ["id", "node"], "left_anti").select(F.struct("id", "node").alias("key"))
    out = picked(packed, materialize(goes), "key", "left_anti")
    again = materialize(kept.where("n > 1").select(F.struct("id", "node").alias("key")))
    if again.isEmpty():
        return out.select("row.*")
    w = Window.partitionBy("key").orderBy(F.xxhash64("row"))
    one = picked(out, again, "key", "left_semi").withColumn("k", F.row_number().over(w)).where("k = 1")
    return picked(out, again, "key", "left_anti").select("row.*").union(one.select("row.*"))
