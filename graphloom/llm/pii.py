"""Personal data (operator 2): fixed patterns, then a skip-chain conditional random field over each document.

The patterns (email, ip, card, phone) give base spans, which always stay. The field's nodes are the base spans
and all looser candidates: strings around an at sign, and groups of seven and more digits with separators.
Neighbouring nodes are joined by chain edges; nodes that repeat or resemble an earlier one (equal text, equal
digits or last digits, equal local part of an address) are joined to it by skip edges, at most two a node, so a token
that recurs a thousand times costs a thousand edges. Loopy sum-product passing spreads labels along both: a phone
number written once with its country code makes its other spellings phone numbers too. Base spans are observed nodes.

All weights, those of edges included, are learned by pseudo-likelihood on at most ``FIT_DOCS`` documents that have candidates
(smallest hashes of doc_id), and on at most ``FIT_NODES`` nodes of each (smallest hashes of position; their neighbours' labels come
from the whole document). Labels are base spans and, for looser candidates, none; a candidate that resembles a base span is
what the field is to decide, so it is neither a target nor a neighbour. Half the nodes hide their formatting features, so that edges
carry weight. The field runs on every document that has looser candidates, and a span is added where a label's marginal
reaches ``SURE`` and no base span overlaps.

Defined results: null texts are empty and have no spans; repeated rows give a row each; an empty table gives an
empty result; columns other than doc_id and text are ignored unless asked for; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, hash_sample, tidied, whole_texts

KINDS = ("email", "ip", "card", "phone")
FIT_DOCS = 3000
FIT_NODES = 400
#: Means of the Gaussian priors on the weights of chain and skip edges, which hold where a corpus says nothing about them.
PRIOR = (0.0, 4.0)
SURE = 0.9
ROUNDS = 12

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A failed start inside a run of digits fails again, so a match can only start where a run does.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOOSE_MAIL = re.compile(r"@[A-Za-z0-9.-]*+")
LOOSE_NUMBER = re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[ ().-]{0,2}[0-9]){6,}")
DIGITS = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str, domain: re.Pattern = DOMAIN, least: int = 0) -> list[tuple[int, int]]:
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        m = domain.match(text, at) if start < at else None
        if m and m.end() - start > least:
            found.append((start, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        at = text.find("+")
        if at >= 0:
            for m in PHONE.finditer(text, at):
                if 10 <= len(DIGITS.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Looser strings that no base span overlaps."""
    loose = emails(text, LOOSE_MAIL, 3) if "@" in text else []
    loose += [m.span() for m in LOOSE_NUMBER.finditer(text)]
    if not loose or not base:
        return sorted(set(loose))
    starts = np.array([s for s, _, _ in base])
    reach = np.maximum.accumulate([e for _, e, _ in base])
    out = []
    for s, e in sorted(set(loose)):
        k = int(np.searchsorted(starts, e))  # base spans that start before the candidate ends
        if k == 0 or reach[k - 1] <= s:
            out.append((s, e))
    return out


N_FORMAT, N_CONTEXT = 18, 16


def node_features(text: str, s: int, e: int) -> np.ndarray:
    """Formatting features, then hashed context features and a constant."""
    t = text[s:e]
    digits = DIGITS.findall(t)
    n = len(digits)
    x = np.zeros(N_FORMAT + N_CONTEXT + 1)
    x[0] = "@" in t
    x[1] = "@" in t and "." in t.split("@")[-1]
    x[2] = t[:1] == "+"
    x[3] = "(" in t
    x[4] = t.count(".") == 3
    x[5] = bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", t))
    x[6] = "-" in t
    x[7] = " " in t
    x[8] = t.isdigit()
    x[9], x[10], x[11], x[12], x[13] = n < 7, 7 <= n <= 9, 10 <= n <= 13, 14 <= n <= 19, n > 19
    x[14] = 14 <= n <= 19 and luhn("".join(digits))
    x[15] = 10 <= n <= 15
    x[16] = text[max(0, s - 1) : s].isalnum() or text[e : e + 1].isalnum()
    x[17] = n == 16
    before = text[max(0, s - 24) : s].lower().split()
    if before:
        x[N_FORMAT + int.from_bytes(hashlib.md5(before[-1].encode()).digest()[:2], "little") % N_CONTEXT] = 0.3
    x[-1] = 1
    return x


def likeness(t: str) -> list[str]:
    """Keys under which a node resembles others."""
    keys = ["t:" + t.lower()]
    if "@" in t:
        keys.append("m:" + t.split("@")[0].lower())
    digits = "".join(DIGITS.findall(t))
    if len(digits) >= 7:
        keys += ["d:" + digits, "s:" + digits[-10:]]
    return keys


def edges(text: str, nodes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(i, j, type): 0 for the chain, 1 for skips to the first and the last node that shares a key."""
    out = [(i - 1, i, 0) for i in range(1, len(nodes)) if nodes[i][0] - nodes[i - 1][1] <= 80]
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    for i, (s, e) in enumerate(nodes):
        ends: list[int] = []
        for key in likeness(text[s:e]):
            for seen in (last, first):
                j = seen.get(key)
                if j is not None and j not in ends and len(ends) < 2:
                    ends.append(j)
            first.setdefault(key, i)
            last[key] = i
        out += [(j, i, 1) for j in ends]
    return out


class Field:
    """theta: labels x features; skip, chain: what two joined nodes gain by the same label. Label 0 is none."""

    def __init__(self, theta: np.ndarray, chain: float, skip: float):
        self.theta, self.pair = theta, np.array([chain, skip])

    def marginals(self, x: np.ndarray, fixed: np.ndarray, links: list[tuple[int, int, int]]) -> np.ndarray:
        """Loopy sum-product beliefs; fixed: a node's observed label, or -1."""
        k = len(self.theta)
        unary = x @ self.theta.T
        unary[fixed >= 0] = -40.0
        seen = np.flatnonzero(fixed >= 0)
        unary[seen, fixed[seen]] = 0.0
        if links:
            i = np.array([a for a, _, _ in links] + [b for _, b, _ in links])
            j = np.array([b for _, b, _ in links] + [a for a, _, _ in links])
            w = self.pair[[t for _, _, t in links] * 2][:, None]
            back = np.concatenate([np.arange(len(links), 2 * len(links)), np.arange(len(links))])
            msg = np.zeros((len(i), k))  # from i to j
            for _ in range(ROUNDS):
                total = unary.copy()
                np.add.at(total, j, msg)
                out = total[i] - msg[back]
                out -= out.max(1, keepdims=True)
                p = np.exp(out)
                new = np.log(p.sum(1, keepdims=True) + (np.exp(w) - 1) * p)
                new -= new.max(1, keepdims=True)
                done = np.abs(new - msg).max() < 1e-4
                msg = 0.3 * msg + 0.7 * new
                if done:
                    break
            np.add.at(unary, j, msg)
        unary -= unary.max(1, keepdims=True)
        p = np.exp(unary)
        return p / p.sum(1, keepdims=True)


def graph(text: str, base: list[Span]) -> tuple[list[tuple[int, int]], np.ndarray, list[tuple[int, int, int]]]:
    """(nodes in order, observed labels or -1, edges); no edges where nothing is to be decided."""
    loose = candidates(text, base)
    if not loose:
        return [], np.empty(0, np.int64), []
    every = sorted([(s, e, KINDS.index(k) + 1) for s, e, k in base] + [(s, e, -1) for s, e in loose])
    nodes = [(s, e) for s, e, _ in every]
    return nodes, np.array([k for _, _, k in every], np.int64), edges(text, nodes)


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    nodes, fixed, links = graph(text, base)
    if not nodes:
        return []
    p = field.marginals(np.array([node_features(text, *n) for n in nodes]), fixed, links)
    best = p.argmax(1)
    out: list[Span] = []
    for i in np.flatnonzero((fixed < 0) & (best > 0) & (p.max(1) >= SURE)).tolist():
        if not out or out[-1][1] <= nodes[i][0]:
            out.append((*nodes[i], KINDS[best[i] - 1]))
    return out


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans by start, then kind)."""
    base = base_spans(text)
    extra = added_spans(text, base, field)
    return base, sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Field:
    """Weights from pseudo-likelihood on a bounded sample of documents with candidates."""
    able = whole_texts(docs).where("doc_id is not null and text rlike '@|[0-9]{3}'")
    picked = hash_sample(able.select("doc_id").distinct(), fit_docs, able.count(), "doc_id")
    sample = able.join(F.broadcast(picked), "doc_id").select("doc_id", "text")  # at most fit_docs ids

    def nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(text)
                every = sorted([(s, e, KINDS.index(k) + 1) for s, e, k in base] + [(s, e, 0) for s, e in candidates(text, base)])
                if every:
                    spans, y = [(s, e) for s, e, _ in every], np.array([k for _, _, k in every], "<i4")
                    known = {key for s, e, _ in base for key in likeness(text[s:e])}
                    y[[k == 0 and not known.isdisjoint(likeness(text[s:e])) for s, e, k in every]] = -1  # the field's to decide
                    near = np.zeros((len(every), 2, len(KINDS) + 1))
                    for i, j, t in edges(text, spans):
                        if y[i] >= 0 <= y[j]:
                            near[i, t, y[j]] += 1
                            near[j, t, y[i]] += 1
                    at = np.flatnonzero(y >= 0)
                    at = at[np.sort(np.argsort((at * 2654435761) & 0xFFFFFFFF, kind="stable")[:FIT_NODES])]
                    rows.append((doc, y[at].tobytes(), np.array([node_features(text, *spans[i]) for i in at.tolist()], "<f4").tobytes(), np.minimum(near[at], 3).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64())] + [pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)], names=["doc_id", "y", "x", "near"])

    rows = sorted(sample.mapInArrow(nodes_of, "doc_id long, y binary, x binary, near binary").collect(), key=lambda r: (r.doc_id, r.y))
    k, f = len(KINDS) + 1, N_FORMAT + N_CONTEXT + 1
    theta, pair = np.zeros((k, f)), np.array(PRIOR)
    if rows:
        y = np.concatenate([np.frombuffer(r.y, "<i4") for r in rows])
        x = np.concatenate([np.frombuffer(r.x, "<f4").reshape(-1, f) for r in rows]).astype(float)
        near = np.concatenate([np.frombuffer(r.near, "<f4").reshape(-1, 2, k) for r in rows]).astype(float)
        hidden = np.random.default_rng(11).random(len(y)) < 0.5
        x[hidden, :N_FORMAT] = 0
        hot = np.eye(k)[y]
        for step in range(400):
            u = x @ theta.T + near[:, 0] * pair[0] + near[:, 1] * pair[1]
            u -= u.max(1, keepdims=True)
            p = np.exp(u)
            p /= p.sum(1, keepdims=True)
            d = (hot - p) / len(y)
            rate = 4.0 / (1 + step / 200)
            theta += rate * (d.T @ x - 1e-4 * theta)
            pair += rate * (np.einsum("nk,ntk->t", d, near) - 1e-4 * (pair - PRIOR))
    return Field(theta, float(pair[0]), float(pair[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, stop), a row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                found = [all_spans(t, shared.value) for t in part.column(1).to_pylist()]
                cols = [pa.array([[{"kind": k, "start": s, "stop": e} for s, e, k in f[i]] for f in found], span) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *cols], names=["doc_id", "base", "spans"])

    return whole_texts(docs).mapInArrow(tidied(run), "doc_id long, base array<struct<kind: string, start: long, stop: long>>, spans array<struct<kind: string, start: long, stop: long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the hash of their list, and the list of all spans."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one. n_chars follows the text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    where, names = docs.columns.index("text"), docs.columns
    size = names.index("n_chars") if "n_chars" in names else -1

    def mask(text: str) -> str:
        out, at = [], 0
        for s, e, k in all_spans(text, shared.value)[1]:
            if s >= at:
                out += [text[at:s], f"[{k.upper()}]"]
            at = max(at, e)
        return "".join(out) + text[at:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                columns = list(part.columns)
                old = columns[where].to_pylist()
                new = [t if t is None else mask(t) for t in old]
                columns[where] = pa.array(new, pa.string())
                if size >= 0:
                    kept = columns[size].to_pylist()
                    columns[size] = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, kept, strict=True)], columns[size].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(tidied(run), docs.schema)
