"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm.bpe import round_trip_digests
from sparkloom.llm.caps import similar_vectors
from sparkloom.llm.common import table
from sparkloom.llm.divergence import divergence
from sparkloom.llm.fmindex import contamination
from sparkloom.llm.maxtree import ranked
from sparkloom.llm.media import media_digests
from sparkloom.llm.minhash import near_duplicates
from sparkloom.llm.packing import packed
from sparkloom.llm.passages import repeated_passages
from sparkloom.llm.repair import id_digests, write_ids
from sparkloom.llm.secrets import secrets
from sparkloom.llm.toxicity import toxicity
from sparkloom.llm.warc import read_warc, write_warc

QUERIES = {}
ORACLE_SQL = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


@_query
def op10_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents at 0.85 on shingles of five words."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, words=5)


ORACLE_SQL["op10_odd_sketches"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
    FROM (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 3, 2) END)) AS i FROM words)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
    SELECT x AS a, x AS b FROM links UNION SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b
), least_id AS (
    SELECT a, min(b) AS m FROM reach GROUP BY a
)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, w.doc_id) AS component_id, coalesce(m, w.doc_id) = w.doc_id AS kept
FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id ON a = w.doc_id
"""


@_query
def op1_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of one label with cosine 0.98 or more."""
    return similar_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


ORACLE_SQL["op1_spherical_caps"] = """
WITH RECURSIVE unit AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
), links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98
), reach AS (
    SELECT x AS a, x AS b FROM links UNION SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b
), least_id AS (
    SELECT a, min(b) AS m FROM reach GROUP BY a
), counted AS (
    SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept
FROM unit LEFT JOIN counted c ON c.x = vec_id LEFT JOIN least_id ON a = vec_id
"""


@_query
def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back by coalesced byte ranges."""
    return read_warc(write_warc(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op9_warc_index"] = """
WITH payloads AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
    SELECT payload_digest, max(page_id) AS first_id FROM payloads WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payloads.payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM payloads LEFT JOIN firsts ON firsts.payload_digest = payloads.payload_digest AND payload_bytes >= 1000
"""


@_query
def op3_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to ids and back."""
    return round_trip_digests(table(spark, sf_dir, "documents"))


@_query
def op8_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as Re-Pair shards and read back."""
    return id_digests(write_ids(table(spark, sf_dir, "documents")))


@_query
def op6_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as 8-bit sound, stored as deduplicated chunks and rebuilt."""
    return media_digests(table(spark, sf_dir, "documents"))


@_query
def op7_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents that a random forest confirms."""
    return secrets(table(spark, sf_dir, "documents"))


@_query
def op2_optimal_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into batches of optimal length buckets."""
    return packed(table(spark, sf_dir, "documents"))


@_query
def op4_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that documents share."""
    return repeated_passages(table(spark, sf_dir, "documents"))


@_query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, and by which terms."""
    return divergence(table(spark, sf_dir, "documents"), least=30, ranks=50)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL["op11_source_divergence"] = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), words AS (
    SELECT r, lang, source, unnest(w) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), scale AS (
    SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), totals AS (
    SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL
), p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0)::HUGEINT + 5)) // (g.total + 5 * s.v) AS p, 1 + (1000000000 * (k.n::HUGEINT + 5)) // (s.total + 5 * s.v) AS q
    FROM totals g JOIN kept k USING (lang) JOIN scale s USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), both_parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM both_parts QUALIFY part = 'pair' OR rank <= 50
"""


@_query
def op12_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the words that benchmark windows cover, found in an FM-index of each shard."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE_SQL["op12_fm_index"] = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), asked AS (
    SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM asked WHERE len(w) > 0)
), places AS (
    SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows))
), hits AS (
    SELECT r, i, n, item_id FROM places JOIN windows USING (n, s)
), hit_words AS (
    SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r
), hit_items AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


@_query
def op13_max_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), limit=10)


ORACLE_SQL["op13_max_tree"] = rf"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), corpus AS (
    SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM docs WHERE len(w) > 0
), tfs AS (
    SELECT doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tfs, corpus GROUP BY term
), scores AS (
    SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score FROM asked JOIN tfs USING (term) JOIN weights USING (term), corpus GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
