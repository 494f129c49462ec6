"""Repeated windows (operator 6): a depth-limited most-significant-digit radix sort of suffixes, in Spark.

Suffixes are ordered only through ``WINDOW`` bytes. Each digit is ``DIGIT`` leading bytes; after each pass suffixes that are alone
with what they share so far leave, and the groups that remain after the last digit are exactly the repeated windows.
Before that, suffixes are routed, so that those that can be equal meet and few bytes travel:

1. A suffix goes to the bucket of its window's anchor: of the window's ``GRAM``-byte strings the one with the smallest hash. Equal
   windows have equal anchors, and neighbouring windows mostly share theirs, so they travel as one entry per anchor.
2. An entry first holds a hash of its context, all bytes of the windows that share the anchor. Where an anchor has one context
   only, all its windows are equal without any sorting, and the smallest doc_id of the entries settles them.
3. Where an anchor has several contexts, one copy of each travels, and their suffixes are radix sorted.

A byte is removed when a window over it also starts in a document with a smaller doc_id. Documents are dealt into chunks of
bounded bytes; a chunk sends each distinct entry once (packed arrays per bucket), so a passage in a third of all documents
costs one entry per chunk. What the buckets find goes back to the chunks, which read the same shuffled text again. Sorting
compares bytes; anchors and contexts are compared by hash (48 bits each; anchors inside their bucket), with odds below 1e-14 of a false match per pair.

Defined results: null texts are empty; texts shorter than a window keep all bytes; equal doc_ids never remove
each other's bytes; a null doc_id counts as larger than all others; repeated rows each give a row; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import chunked, only_cache, tidy

WINDOW, GRAM = 50, 16
#: Bytes of a digit: what one machine word orders at once.
DIGIT = 8
CHUNK_BYTES = 4 << 20
LAST = np.iinfo(np.int64).max
LOW48 = np.uint64((1 << 48) - 1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i <= n."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 21)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (BASE, INVERSE)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def prefix(buf: np.ndarray) -> np.ndarray:
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=out[1:])
    return out


def substring(p: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    _, down = powers(len(p))
    return (p[end] - p[start]) * down[: len(p)][start]


def anchors(buf: np.ndarray, first: np.ndarray, last: np.ndarray, window: int, gram: int) -> list[np.ndarray]:
    """(document, lo, hi, anchor hash, context hash): windows lo..hi of a document share an anchor."""
    outs: list[list[np.ndarray]] = []
    k = 0
    while k < len(first):
        j = k + 1
        while j < len(first) and last[j] - first[k] <= 1 << 20:
            j += 1
        at, end = int(first[k]), int(last[j - 1])
        n = end - at
        if n >= window:
            p = prefix(buf[at:end])
            grams = mix(substring(p, slice(0, n - gram + 1), slice(gram, n + 1)))
            key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
            span, width = 1, window - gram + 1
            while span * 2 <= width:
                key = np.minimum(key[:-span], key[span:])
                span *= 2
            if span < width:
                key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
            sizes = last[k:j] - first[k:j]
            doc = np.repeat(np.arange(k, j), np.maximum(sizes - window + 1, 0))
            starts = first[doc] - at
            count = np.maximum(sizes - window + 1, 0)
            s = starts + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            where = (key[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            head = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])])) if len(s) else np.empty(0, np.int64)
            tail = np.append(head[1:], len(s)) - 1 if len(head) else head
            lo, hi, pos = s[head], s[tail], where[head]
            context = substring(p, lo, hi + window) + (pos - lo).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + (hi - lo).astype(np.uint64) * np.uint64(0x9E6C63D0876A9A67)
            outs.append([doc[head], lo + at, hi + at, grams[pos], mix(context) & LOW48])
        k = j
    if not outs:
        return [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
    return [np.concatenate(c) for c in zip(*outs, strict=True)]


def six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each anchor, from all 64 bits of its hash: any number of buckets fills."""
    return (mix(grams) % np.uint64(buckets)).astype(np.int64)


class Chunk:
    """A chunk's documents, its anchors and its distinct entries (bucket, anchor, context), in a fixed order."""

    def __init__(self, table: pa.Table, buckets: int, window: int, gram: int):
        only_cache("repeats", _POWERS.clear)
        data = table.column("text").cast(pa.large_binary()).combine_chunks()
        self.raw = b"".join(data.to_pylist())
        self.ids = table.column("doc_id").to_pylist()
        sizes = np.array([len(x) for x in data.to_pylist()], np.int64)
        self.last = np.cumsum(sizes)
        self.first = self.last - sizes
        self.buf = np.frombuffer(self.raw, np.uint8)
        order = np.array([LAST if i is None else i for i in self.ids], np.int64)
        doc, self.lo, self.hi, grams, context = anchors(self.buf, self.first, self.last, window, gram)
        self.doc = order[doc]
        bucket, h = bucket_of(grams, buckets), grams & LOW48
        by = np.lexsort((self.doc, context, h, bucket))
        new = np.ones(len(by), bool)
        if len(by):
            b, x, c = bucket[by], h[by], context[by]
            new[1:] = (b[1:] != b[:-1]) | (x[1:] != x[:-1]) | (c[1:] != c[:-1])
        heads = by[new]
        self.entry = np.empty(len(by), np.int64)
        self.entry[by] = np.cumsum(new) - 1
        self.head, self.bucket, self.h, self.c, self.least = heads, bucket[heads], h[heads], context[heads], self.doc[heads]
        self.starts = np.searchsorted(self.bucket, np.arange(buckets + 1))

    def filled(self) -> np.ndarray:
        return np.flatnonzero(np.diff(self.starts))


def table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("h", pa.binary()), ("c", pa.binary()), ("base", pa.int64()), ("d", pa.binary()), ("lens", pa.binary()), ("context", pa.binary())])
BACK = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("digit", pa.int32()), ("pos", pa.binary()), ("least", pa.binary()), ("flag", pa.binary())])
KEPT = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def narrow(d: np.ndarray) -> tuple[int, bytes]:
    """doc_ids as differences from the smallest, in four bytes where they fit."""
    base = int(d.min())
    wide = int(d.max()) - base >= 1 << 32
    return base, (d.view(np.uint64) - np.uint64(base & (1 << 64) - 1)).astype("<u8" if wide else "<u4").tobytes()


def widen(base: int, raw: bytes, n: int) -> np.ndarray:
    return (np.frombuffer(raw, "<u8" if len(raw) == 8 * n else "<u4").astype(np.uint64) + np.uint64(base & (1 << 64) - 1)).view(np.int64)


def gathered(sent: pa.Table) -> tuple[np.ndarray, ...]:
    """(h, c, d, row, place): the entries of a bucket, and where each came from."""
    cols = [[], [], [], [], []]
    for i, (h, c, base, d) in enumerate(zip(*(sent.column(x).to_pylist() for x in ("h", "c", "base", "d")), strict=True)):
        n = len(h) // 6
        for col, x in zip(cols, (unsix(h), unsix(c), widen(base, d, n), np.full(n, i), np.arange(n)), strict=True):
            col.append(x)
    return tuple(np.concatenate(x) for x in cols)


MANY, FIRST = 1, 2


def settle_contexts(sent: pa.Table) -> pa.Table:
    """The smallest doc_id of each (anchor, context); marks for anchors with several contexts."""
    h, c, d, row, place = gathered(sent)
    by = np.lexsort((row, d, c, h))
    h, c, d, row, place = (x[by] for x in (h, c, d, row, place))
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new = new_h | np.concatenate([[True], c[1:] != c[:-1]])
    heads, group = np.flatnonzero(new), np.cumsum(new) - 1
    least = d[heads]
    anchor = (np.cumsum(new_h) - 1)[heads]
    tops = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    many = (np.minimum.reduceat(least, tops) < np.maximum.reduceat(least, tops))[anchor]
    flag = np.where(many[group], MANY, 0).astype(np.uint8)
    flag[heads[many]] |= FIRST
    keep = np.flatnonzero((least[group] < d) | (flag > 0))
    keep = keep[np.argsort(row[keep], kind="stable")]
    edges = np.searchsorted(row[keep], np.arange(sent.num_rows + 1))
    chunk, bucket = sent.column("chunk").to_pylist(), sent.column("bucket").to_pylist()
    rows = []
    for i in np.flatnonzero(np.diff(edges)).tolist():
        k = keep[edges[i] : edges[i + 1]]
        rows.append((chunk[i], bucket[i], 2, place[k].astype("<u4").tobytes(), least[group[k]].astype("<i8").tobytes(), flag[k].tobytes()))
    return table(BACK, rows)


def radix_groups(raw: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, group of each): those that share their first ``depth`` bytes and their given group with another, in order.

    One most-significant-digit pass for each DIGIT bytes; suffixes that are alone in their group leave after every pass.
    """
    live = np.argsort(group, kind="stable")
    group = group[live]
    for low in range(0, depth, DIGIT):
        width = min(DIGIT, depth - low)
        digit = np.zeros((len(live), 8), np.uint8)
        digit[:, :width] = np.lib.stride_tricks.sliding_window_view(raw, width)[at[live] + low] if len(live) else 0
        digit = digit.view(">u8")[:, 0].astype(np.uint64)  # big-endian: the first byte is the most significant
        by = np.lexsort((digit, group))
        live, group, digit = live[by], group[by], digit[by]
        new = np.ones(len(live), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new) - 1
        together = np.bincount(group)[group] > 1 if len(group) else new
        live, group = live[together], group[together]
    return live, group


def settle_windows(sent: pa.Table, window: int) -> pa.Table:
    """For contexts of one anchor, the smallest doc_id of each window that another has earlier, by a radix sort of their suffixes."""
    h, c, d, row, place = gathered(sent)
    lens = np.concatenate([np.frombuffer(x, "<u4") for x in sent.column("lens").to_pylist()]).astype(np.int64)
    raw = np.frombuffer(b"".join(sent.column("context").to_pylist()), np.uint8)
    ends = np.cumsum(lens)
    first = np.flatnonzero(lens)
    count = lens[first] - window + 1
    owner = np.repeat(np.arange(len(first)), count)
    at = (ends - lens)[first][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    least = d[first][owner]
    live, group = radix_groups(raw, at, np.unique(h[first], return_inverse=True)[1][owner], window)
    if len(live):
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least[live] = np.repeat(np.minimum.reduceat(least[live], heads), np.diff(np.append(heads, len(live))))
    cuts = np.append(np.cumsum(count) - count, len(at))
    news = np.array([bool((least[a:b] < x).any()) for a, b, x in zip(cuts[:-1], cuts[1:], d[first], strict=True)], bool)
    known = {(int(x), int(y)): i for i, (x, y) in enumerate(zip(h[first], c[first], strict=True)) if news[i]}
    chunk, bucket = sent.column("chunk").to_pylist(), sent.column("bucket").to_pylist()
    found: dict[int, list[tuple[int, int]]] = {}
    for x, y, r, p in zip(h.tolist(), c.tolist(), row.tolist(), place.tolist(), strict=True):
        i = known.get((x, y))
        if i is not None:
            found.setdefault(r, []).append((p, i))
    rows = []
    for r, got in found.items():
        rows.append((chunk[r], bucket[r], 3, np.array([p for p, _ in got], "<u4").tobytes(), b"".join(least[cuts[i] : cuts[i + 1]].astype("<i8").tobytes() for _, i in got), np.array([cuts[i + 1] - cuts[i] for _, i in got], "<u4").tobytes()))
    return table(BACK, rows)


def send_entries(chunk: Chunk, key: int) -> pa.Table:
    rows = []
    for b in chunk.filled().tolist():
        s = slice(chunk.starts[b], chunk.starts[b + 1])
        rows.append((b, key, six(chunk.h[s]), six(chunk.c[s]), *narrow(chunk.least[s]), b"", b""))
    return table(SENT, rows)


def heard(chunk: Chunk, back: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(smallest doc_id, flag) of each entry once contexts are settled."""
    least, flag = chunk.least.copy(), np.zeros(len(chunk.least), np.uint8)
    for bucket, pos, ids, marks in zip(*(back.column(x).to_pylist() for x in ("bucket", "pos", "least", "flag")), strict=True):
        entry = chunk.starts[bucket] + np.frombuffer(pos, "<u4").astype(np.int64)
        least[entry], flag[entry] = np.frombuffer(ids, "<i8"), np.frombuffer(marks, np.uint8)
    return least, flag


def send_contexts(chunk: Chunk, key: int, back: pa.Table, window: int) -> pa.Table:
    _, flag = heard(chunk, back)
    asked = np.flatnonzero(flag & MANY)
    cuts = np.searchsorted(chunk.bucket[asked], np.arange(len(chunk.starts)))
    rows = []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        e = asked[cuts[b] : cuts[b + 1]]
        lo, hi = chunk.lo[chunk.head[e]], chunk.hi[chunk.head[e]] + window
        own = (flag[e] & FIRST) > 0
        text = b"".join(chunk.raw[x:y] for x, y in zip(lo[own].tolist(), hi[own].tolist(), strict=True))
        rows.append((b, key, six(chunk.h[e]), six(chunk.c[e]), *narrow(chunk.least[e]), np.where(own, hi - lo, 0).astype("<u4").tobytes(), text))
    return table(SENT, rows)


def covered(chunk: Chunk, back: pa.Table, window: int) -> np.ndarray:
    """Which bytes of the chunk lie in a window that also starts in a document with a smaller doc_id."""
    digit = np.array(back.column("digit").to_pylist(), np.int64)
    second, third = back.filter(pa.array(digit == 2)), back.filter(pa.array(digit == 3))
    least, flag = heard(chunk, second)
    asked = np.flatnonzero(flag & MANY)
    cuts = np.searchsorted(chunk.bucket[asked], np.arange(len(chunk.starts)))
    change = np.zeros(len(chunk.buf) + 1, np.int32)
    whole = np.flatnonzero(least[chunk.entry] < chunk.doc)
    np.add.at(change, chunk.lo[whole], 1)
    np.add.at(change, chunk.hi[whole] + window, -1)
    if third.num_rows:
        by = np.argsort(chunk.entry, kind="stable")
        edges = np.searchsorted(chunk.entry[by], np.arange(len(chunk.least) + 1))
        for bucket, pos, ids, sizes in zip(*(third.column(x).to_pylist() for x in ("bucket", "pos", "least", "flag")), strict=True):
            entries = asked[cuts[bucket] + np.frombuffer(pos, "<u4").astype(np.int64)]
            parts = np.split(np.frombuffer(ids, "<i8"), np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))[:-1])
            for e, own in zip(entries.tolist(), parts, strict=True):
                for o in by[edges[e] : edges[e + 1]].tolist():
                    if least[e] >= chunk.doc[o]:
                        s = chunk.lo[o] + np.flatnonzero(own < chunk.doc[o])
                        np.add.at(change, s, 1)
                        np.add.at(change, s + window, -1)
    return np.cumsum(change)[:-1] > 0


def finish(chunk: Chunk, back: pa.Table, window: int) -> pa.Table:
    gone = covered(chunk, back, window)
    rows = []
    for i, a, b in zip(chunk.ids, chunk.first.tolist(), chunk.last.tolist(), strict=True):
        own = gone[a:b]
        if own.any():
            step = np.diff(np.concatenate([[0], own.view(np.int8), [0]]))
            rows.append((i, chunk.buf[a:b][~own].tobytes(), b - a, np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))
        else:
            rows.append((i, chunk.raw[a:b], b - a, [], []))
    return table(KEPT, rows)


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES, finisher: Callable[[pa.Table, pa.Table], pa.Table] | None = None, schema: str = ddl(KEPT), keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept bytes, the input's length, and the removed spans' starts and ends, a row for each row of docs.

    finisher turns that table and the chunk's rows (with the columns to keep) into one with the given schema
    where the result is made, so that digests needn't carry the bytes.
    """
    texts, n = chunked(docs, chunk_bytes, keep=keep)
    texts = texts.select("chunk", "doc_id", "text", *keep)
    buckets = n // 4 + 64
    by_chunk = texts.groupBy("chunk")

    def first(rows: pa.Table) -> pa.Table:
        out = send_entries(Chunk(rows, buckets, window, gram), rows.column("chunk")[0].as_py())
        tidy()
        return out

    def third(rows: pa.Table, back: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return SENT.empty_table()
        out = send_contexts(Chunk(rows, buckets, window, gram), rows.column("chunk")[0].as_py(), back, window)
        tidy()
        return out

    def last(rows: pa.Table, back: pa.Table) -> pa.Table:
        out = finish(Chunk(rows, buckets, window, gram), back, window) if rows.num_rows else KEPT.empty_table()
        tidy()
        return finisher(out, rows) if finisher else out

    sent = by_chunk.applyInArrow(first, ddl(SENT))
    contexts = sent.groupBy("bucket").applyInArrow(settle_contexts, ddl(BACK))
    asked = by_chunk.cogroup(contexts.groupBy("chunk")).applyInArrow(third, ddl(SENT))
    windows = asked.groupBy("bucket").applyInArrow(lambda t: settle_windows(t, window), ddl(BACK))
    return by_chunk.cogroup(contexts.union(windows).groupBy("chunk")).applyInArrow(last, schema)


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def digest(kept: pa.Table, rows: pa.Table) -> pa.Table:
    text = kept.column("text").to_pylist()
    size = kept.column("n_bytes").to_pylist()
    return table(DIGEST, [(i, n, n - len(t), len(s), hashlib.sha256(t).hexdigest()) for i, n, t, s in zip(kept.column("doc_id").to_pylist(), size, text, kept.column("starts").to_pylist(), strict=True)])


def repeats_digest(docs: DataFrame, **options) -> DataFrame:
    return find_repeats(docs, finisher=digest, schema="doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", **options)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with repeated windows cut out of text; characters that lose a byte go whole. n_chars follows the text."""
    names = docs.columns
    rest = [F.col(c) for c in names if c != "text"]
    packed = docs.select("doc_id", "text", F.struct(*rest).alias("_row"))  # whatever the other columns are called

    def rewrite(kept: pa.Table, rows: pa.Table) -> pa.Table:
        text = [t.decode(errors="ignore") for t in kept.column("text").to_pylist()]
        cut = [len(s) > 0 for s in kept.column("starts").to_pylist()]
        columns, own = [], rows.column("_row").combine_chunks()
        for name in names:
            if name == "text":
                columns.append(pa.array(text, pa.string()))
            elif name == "n_chars":
                old = own.field(name)
                columns.append(pa.array([len(t) if c else n for t, c, n in zip(text, cut, old.to_pylist(), strict=True)], old.type))
            else:
                columns.append(own.field(name))
        return pa.Table.from_arrays(columns, names=list(names))

    return find_repeats(packed, finisher=rewrite, schema=docs.schema, keep=("_row",), **options)
