"""The registered queries of the training-data operators: thin digests of each operator's output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import ann, byte_bpe, centroids, html_text, packing, phrases, pii, quality, repeats, simhash, suffix_lm, url_filter, vector_dedup
from graphloom.llm.common import load


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.fit(docs)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(load(spark, sf_dir, "embeddings"))


def op5_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score(load(spark, sf_dir, "documents"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_digest(load(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(load(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(load(spark, sf_dir, "embeddings"))


#: (verdict, host, path) of the listed rules.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return url_filter.judge(pages, URL_RULES, url_filter.mine(pages, load(spark, sf_dir, "labels"), bad))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(load(spark, sf_dir, "documents"))


def queries() -> dict:
    all_ten = (op1_ann, op2_pii, op3_quality, op4_vector_dedup, op5_suffix_tree_lm, op6_suffix_array, op7_simhash, op8_byte_bpe, op9_html_text, op10_packing)
    return {f.__name__: f for f in (*all_ten, op11_centroids, op12_url_filter, op13_phrases)}


#: All pairs and a closure: fit for the smallest tables only, and exact there.
OP4_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT k, vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
p AS (SELECT a.k AS x, b.k AS y, a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.k <> b.k AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id WHERE r.c < p.b),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id), n AS (SELECT a, x, count(*) AS n_links FROM p GROUP BY 1, 2), l AS (SELECT a, max(n_links) AS n_links FROM n GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept FROM embeddings LEFT JOIN l ON a = vec_id LEFT JOIN m ON id = vec_id
"""




def _op11_sql() -> str:
    """Five rounds, unrolled; integer arithmetic throughout. Fit for components whose distances fit 64 bits."""
    dist = "list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))"
    floor = "(s - ((s % n) + n) % n) // n"
    out = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT k, e FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS k, e FROM v) WHERE k < 40)"""
    for i in range(6):
        out += f""",
a{i} AS (SELECT r, k, d FROM (SELECT v.r, c.k, {dist} AS d, row_number() OVER (PARTITION BY v.r ORDER BY {dist}, c.k) AS place FROM v CROSS JOIN c{i} c) WHERE place = 1)"""
        if i < 5:
            out += f""",
s{i} AS (SELECT k, i, sum(v.e[i]) AS s, count(*) AS n FROM v JOIN a{i} USING (r) CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY k, i),
m{i} AS (SELECT k, list(CAST({floor} AS BIGINT) ORDER BY i) AS e FROM s{i} GROUP BY k),
c{i + 1} AS (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k)"""
    return out + """
SELECT v.vec_id, CAST(a5.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a5.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.e, ',')) AS centroid_sha256
FROM v JOIN a5 USING (r) JOIN c5 ON c5.k = a5.k"""


#: Frequent token sets are counted by writing out every part of every labelled page's tokens: at most 2^10 a page.
OP12_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, row_number() OVER () AS r FROM pages),
p AS (SELECT *, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM u),
w AS (SELECT *, list_reverse(string_split(host, '.')) AS h, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  string_split(regexp_replace(regexp_replace(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '^/', ''), '/') AS seg FROM p),
z AS (SELECT *, [{'k': 's:', 't': regexp_extract(low, '(?s)^(.*?)://', 1)}, {'k': 'h1:', 't': h[1]}, {'k': 'h2:', 't': h[2]}, {'k': 'h3:', 't': h[3]},
  {'k': 'h4:', 't': array_to_string(h[4:], '.')}, {'k': 'p1:', 't': seg[1]}, {'k': 'p2:', 't': seg[2]}, {'k': 'p3:', 't': array_to_string(seg[3:], '/')},
  {'k': 'q:', 't': regexp_replace(regexp_replace(regexp_extract(low, '(?s)://[^?#]*\?([^#]*)', 1), '=[^&]*', '', 'g'), '[0-9]+', '0', 'g')},
  {'k': 'f:', 't': regexp_replace(regexp_extract(low, '(?s)://[^#]*#(.*)', 1), '[0-9]+', '0', 'g')}] AS slots FROM w),
t AS (SELECT r, page_id, host, path, CASE WHEN url LIKE '%://%' THEN list_sort(list_transform(list_filter(slots, lambda x: x.t IS NOT NULL AND x.t <> ''), lambda x: x.k || x.t)) ELSE [] END AS tokens FROM z),
g AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
b AS (SELECT t.tokens, g.bad FROM t JOIN g ON g.doc_id = t.page_id),
n AS (SELECT greatest(10, CAST(ceil(count(*) * 0.001) AS BIGINT)) AS least FROM b),
e AS (SELECT tokens, bad, unnest(range(1, CAST(pow(2, len(tokens)) AS BIGINT))) AS mask FROM b WHERE len(tokens) > 0),
f AS (SELECT list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS part, count(*) AS support, sum(bad) AS bads FROM e GROUP BY 1),
rules AS (SELECT part FROM f, n WHERE bads >= least AND bads * 2 >= support),
hit AS (SELECT DISTINCT t.tokens FROM (SELECT DISTINCT tokens FROM t) t, rules WHERE len(list_intersect(t.tokens, rules.part)) = len(rules.part)),
l(verdict, domain, prefix) AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))),
m AS (SELECT r, l.verdict, domain || prefix AS name, row_number() OVER (PARTITION BY r ORDER BY length(domain || prefix) DESC) AS place FROM t JOIN l ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix))
SELECT t.page_id, t.host, t.path, m.name AS rule, coalesce(m.verdict, CASE WHEN hit.tokens IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM t LEFT JOIN m ON m.r = t.r AND m.place = 1 LEFT JOIN hit ON hit.tokens = t.tokens
"""


OP13_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS words FROM p),
s AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE len(words) > 0),
n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
g AS (SELECT lang, words, i, unnest(range(1, 6)) AS m FROM s),
f AS (SELECT lang, words[i:i + m - 1] AS ids, count(*) AS f FROM g WHERE i + m - 1 <= len(words) GROUP BY 1, 2 HAVING count(*) >= 100),
c AS (SELECT lang, ids, f AS a, len(ids) AS m FROM f WHERE len(ids) > 1),
longer AS (SELECT lang, ids, a, m, unnest(range(2, m)) AS size FROM c WHERE m > 2),
inner_ AS (SELECT lang, a, ids, size, m, unnest(range(1, m - size + 2)) AS i FROM longer),
sup AS (SELECT lang, ids[i:i + size - 1] AS ids, max(a) AS sup FROM inner_ GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN sup USING (lang, ids) WHERE sup IS NULL OR 100 * sup < 100 * a),
k AS (SELECT lang, ids, a, m, unnest(range(1, m)) AS k FROM kept),
x AS (SELECT k.lang, k.ids, k.a, k.k, l.f AS l, r.f AS r, n.n, CAST((CAST(1000 AS HUGEINT) * k.a * n.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.ids = k.ids[1:k.k] JOIN f r ON r.lang = k.lang AND r.ids = k.ids[k.k + 1:] JOIN n ON n.lang = k.lang),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, ids ORDER BY score, k) AS place FROM x),
z AS (SELECT *, array_to_string(ids, ' ') AS phrase FROM y WHERE place = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_vector_dedup": OP4_SQL, "op11_centroids": _op11_sql(), "op12_url_filter": OP12_SQL, "op13_phrases": OP13_SQL}
