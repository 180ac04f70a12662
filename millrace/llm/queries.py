"""The registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, embed_dedup, langid, lexical, negatives, packing, pii, secrets, simhash, suffix_dedup, toxicity, voronoi, warc
from millrace.llm.common import prepare, read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(read(prepare(spark), sf_dir, "documents"), size=4, n_words=1, tau=4, m=5)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents")
    held_out = lambda doc_id: F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1
    model = langid.fit(docs, ~held_out(F.col("doc_id")))
    found = langid.identify(docs, model)
    return found.select(F.col("id").alias("doc_id"), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(prepare(spark), sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read(prepare(spark), sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(prepare(spark), sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read(prepare(spark), sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(read(prepare(spark), sf_dir, "documents"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(prepare(spark), sf_dir, "pages")
    resolved = warc.resolve_revisits(warc.captures(pages))
    field = lambda name: F.try_element_at("headers", F.lit(name))
    return resolved.select(
        F.floor(F.col("record_id") / 2).alias("page_id"), F.floor(F.col("source_id") / 2).alias("source_page_id"), "outcome", field("etag").alias("etag"),
        field("date").alias("date"), field("content-type").alias("content_type"), F.col("payload_length").cast("long").alias("payload_length"), "payload_sha256",
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(read(prepare(spark), sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(prepare(spark), sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(read(prepare(spark), sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_k(read(prepare(spark), sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


_OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95
), reach AS (SELECT vec_id AS n, vec_id AS r FROM v UNION SELECT l.a, reach.r FROM reach JOIN l ON l.b = reach.n),
roots AS (SELECT n, min(r) AS r FROM reach GROUP BY n), counts AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(counts.n, 0)::BIGINT AS n_links, coalesce(roots.r, e.vec_id) AS component_id, coalesce(roots.r, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts ON counts.a = e.vec_id LEFT JOIN roots ON roots.n = e.vec_id
"""

_OP9 = r"""
WITH bare AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM pages
), split AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(b, '^[^/?]*(.*)$', 1), '([?&])utm_[^&]*', '\1', 'g') AS r
  FROM bare
), canon AS (
  SELECT page_id, html, '"' || md5(html)[1:16] || '"' AS tag, page_id AS at, page_id + ((page_id * 31 % 1000) + 1000) % 1000 - 100 AS again,
    host || regexp_replace(regexp_replace(regexp_replace(regexp_replace(r, '&{2,}', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''), '/+(\?|$)', '\1', 'g') AS url
  FROM split
), earlier AS (
  SELECT v.page_id, v.again, CASE WHEN v.page_id % 5 = 0 THEN '"outdated"' ELSE 'W/' || v.tag END AS sent,
    s.page_id AS source_page_id, s.tag AS stored, s.html, row_number() OVER (PARTITION BY v.page_id ORDER BY s.at DESC, s.page_id DESC) AS rn
  FROM canon v LEFT JOIN canon s ON s.url = v.url AND s.at <= v.again
), told AS (
  SELECT *, CASE WHEN source_page_id IS NULL THEN 'no_response' WHEN regexp_replace(sent, '^W/', '') = stored THEN 'resolved' ELSE 'validator_mismatch' END AS outcome
  FROM earlier WHERE rn = 1
)
SELECT page_id, source_page_id, outcome,
  CASE WHEN outcome = 'resolved' THEN sent END AS etag, CASE WHEN outcome = 'resolved' THEN again::VARCHAR END AS date,
  CASE WHEN outcome = 'resolved' THEN 'text/html' END AS content_type,
  CASE WHEN outcome = 'resolved' THEN strlen(html) END AS payload_length, CASE WHEN outcome = 'resolved' THEN sha256(html) END AS payload_sha256
FROM told
"""

_OP10 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark
), items AS (SELECT item_id, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)
), lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lengths WHERE len(w) >= n)
), found AS (SELECT g.doc_id, g.i, g.n, b.item_id FROM grams g JOIN windows b USING (n, win)),
spots AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS p FROM dw),
often AS (SELECT term, count(*) AS f FROM spots GROUP BY term),
bag AS (SELECT item_id, n, string_split(win, ' ') AS win FROM windows),
rarest AS (
  SELECT item_id, n, win, arg_min(term, (coalesce(f, 0), term)) AS term FROM (SELECT *, unnest(win) AS term FROM bag) LEFT JOIN often USING (term) GROUP BY item_id, n, win
),
around AS (
  SELECT doc_id, item_id, n + 2 AS wide, win, w[greatest(1, p - n - 1) : p + n + 1] AS part FROM rarest JOIN spots USING (term) JOIN dw USING (doc_id)
),
close AS (
  SELECT doc_id, item_id, win, part[b : b + wide - 1] AS part FROM (SELECT *, unnest(range(1, len(part) + 1)) AS b FROM around WHERE list_has_all(part, win))
),
nearby AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close
  WHERE list_has_all(part, win) AND len(list_filter(win, lambda t: len(list_filter(part, lambda x: x = t)) < len(list_filter(win, lambda x: x = t)))) = 0 GROUP BY doc_id
),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
told AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN nearby USING (doc_id)
"""

_OP11 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, c.r AS other, a.label = c.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 100 = 0
), positives AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) AS place FROM scored WHERE same),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.r, p.place ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON p.r = n.r AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score WHERE p.place <= 5
)
SELECT * FROM ranked WHERE rank <= 5
"""

_OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark
), whole AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
asked AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS term FROM b) GROUP BY ALL),
held AS (
  SELECT r, doc_id, length, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS length, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM held GROUP BY term), whole
), gains AS (
  SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * length * n) // total))) AS gain FROM held JOIN weights USING (term), whole
), scored AS (SELECT q, item_id, r, doc_id, sum(times * gain)::BIGINT AS score FROM asked JOIN gains USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

_OP13 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

QUERIES = {f.__name__: f for f in (op1_simhash, op2_langid, op3_toxicity, op4_pii, op5_embedding_dedup, op6_packing, op7_secrets, op8_suffix_dedup, op9_warc_revisits, op10_decontamination, op11_hard_negatives, op12_lexical_search, op13_exact_search)}
ORACLE_SQL = {"op5_embedding_dedup": _OP5, "op9_warc_revisits": _OP9, "op10_decontamination": _OP10, "op11_hard_negatives": _OP11, "op12_lexical_search": _OP12, "op13_exact_search": _OP13}
