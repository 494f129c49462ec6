import hashlib
import random
import re

from graphloom.llm import pii

DOCS = "doc_id long, text string, spans string, n_email int"
FOUR = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn_sum(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(FOUR.items()):
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn_sum(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), order, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    bits = ["a@b", "@", ".com", "x.y@z-1.co.uk", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (425) 555-9684", "+", "9", "00", " ", "-", ".", "é", "a", "4111111111111111", "(", ")", "10.0.0.1.5.6.7.8", "a@b@c.de", "..", "%+-", "\n", "1-2", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == brute(text), text


def documents(spark):
    rng = random.Random(9)
    rows = []
    for i in range(200):
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        mail = f"user{i}@mail.example.com"
        rows.append((i, f"words call {phone} now or write {mail} and 10.0.{i % 250}.1 then {rng.randint(10**11, 10**12)} items" + f", or {phone} {mail}" * (i % 2), "c", 0))  # half repeat theirs: what skip edges learn from
    rows += [(1000, "call +1 (425) 555-9684 today, or (425) 555-9684 tomorrow; 4251234567 parts", "c", 0), (1001, None, "c", 0), (1002, "", "c", 0), (1003, "nothing here at all", "c", 0), (1003, "nothing here at all", "c", 0), (1004, "x " * 100_000 + "a@b.co", "c", 0), (1005, "1" * 50_000 + " @ " * 1000, "c", 0)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_field_adds_what_resembles_and_keeps_base(spark):
    docs = documents(spark)
    field = pii.fit(docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pii.digest(pii.find(docs, field)).collect()
    assert len(rows) == 207
    for r in rows:
        want = brute(texts[r.doc_id]) if r.doc_id != 1005 else []
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, _, k in want) for x in FOUR]
        assert {f"{k}:{s}:{e}" for s, e, k in want} <= set(filter(None, r.spans.split(",")))
    got = {r.doc_id: r.spans for r in rows}
    s = texts[1000].index("(425) 555-9684 tom")
    assert f"phone:{s}:{s + 14}" in got[1000], "a spelling without the country code is linked to the full one"
    assert "4251234567" not in [texts[1000][int(x.split(":")[1]) : int(x.split(":")[2])] for x in got[1000].split(",")]
    assert got[1001] == got[1002] == got[1003] == ""
    masked = {r.doc_id: r.text for r in pii.redact(docs, field).collect()}
    assert field.pair[1] > 2, "that alike nodes agree is learned, not set"
    assert masked[1000] == "call [PHONE] today, or [PHONE] tomorrow; 4251234567 parts" and masked[1001] is None


def test_message_passing_is_exact_on_a_tree():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    theta = rng.normal(size=(3, 4))
    field = pii.Field(theta, 0.7, 2.0)
    x, fixed = rng.normal(size=(4, 4)), np.array([-1, 2, -1, -1])
    links = [(0, 1, 0), (1, 2, 1), (1, 3, 0)]
    p = np.zeros((4, 3))
    for ys in itertools.product(range(3), repeat=4):
        if ys[1] == 2:
            u = sum(float(x[i] @ theta[y]) for i, y in enumerate(ys) if i != 1) + sum([0.7, 2.0][t] * (ys[i] == ys[j]) for i, j, t in links)
            for i, y in enumerate(ys):
                p[i, y] += np.exp(u)
    assert np.allclose(field.marginals(x, fixed, links), p / p.sum(1, keepdims=True), atol=1e-3)


def test_whole_strings_and_whole_documents_count(spark):
    import numpy as np

    long = "1" * 300
    assert not set(pii.likeness(long + "2")) & set(pii.likeness(long + "3")) - {k for k in pii.likeness(long + "2") if k[0] == "s"}
    # the field runs where no base span is: what it is sure of there comes out
    theta = np.zeros((5, pii.N_FORMAT + pii.N_CONTEXT + 1))
    theta[4, -1] = 9.0
    assert pii.added_spans("call 425 555 9684", [], pii.Field(theta, 0.0, 0.0)) == [(5, 17, "phone")]
    # late nodes of a document with more than FIT_NODES teach the weights too: they alone have base spans here
    text = " ".join(f"x{i} {1000000 + i}" for i in range(600)) + " mail " + " ".join(f"u{i}@m{i}.example.com" for i in range(600))
    field = pii.fit(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert field.theta[1].max() > 0.5


def test_empty(spark):
    docs = documents(spark).limit(0)
    assert pii.find(docs, pii.fit(docs)).count() == 0
