"""Queries of retrieval and query text."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import querytext as Q
from sparkloom.operators import retrieval as R
from sparkloom.operators import search_index as X
from sparkloom.sources.tables import load

QUERIES = {}
ORACLE_SQL = {}

WORDS = r"words AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents)"


def _query(sql: str | None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _words(spark, sf_dir):
    return X.tokenised(load(spark, sf_dir, "documents"), "doc_id", "text")


def _index(spark, sf_dir):
    return X.index_of(load(spark, sf_dir, "documents"), "doc_id", "text")


def _bm25_sql(terms: list[str]) -> str:
    some = ", ".join(f"'{t}'" for t in terms)
    return f"""{WORDS}, p AS (SELECT id, len(words) AS size, t, len(list_filter(words, lambda w: w = t)) AS tf FROM words, (SELECT unnest([{some}]) AS t)),
d AS (SELECT t, count(*) FILTER (tf > 0) AS df FROM p GROUP BY t), s AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM words),
bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM p JOIN d USING (t), s GROUP BY id HAVING sum(tf) > 0)"""


_NEAR = """q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
near AS (SELECT vec_id AS id, 1 - list_dot_product(embedding::DOUBLE[], e) / sqrt(list_dot_product(e, e) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS distance FROM embeddings, q)"""


def _near(spark, sf_dir, limit):
    v = load(spark, sf_dir, "embeddings")
    one = v.where("vec_id = 0").select(F.col("embedding").alias("asked"))
    return R.nearest(v.crossJoin(F.broadcast(one)), "vec_id", "embedding", F.col("asked"), limit)


@_query(f"WITH {_NEAR} SELECT id, round(distance, 6) AS distance FROM near ORDER BY near.distance, id LIMIT 20")
def knn_cosine(spark, sf_dir):
    return _near(spark, sf_dir, 20).withColumn("distance", F.round("distance", 6))


@_query(f"WITH {_bm25_sql(['thing', 'heron'])} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20")
def bm25_topk(spark, sf_dir):
    return _index(spark, sf_dir).top(["thing", "heron"], 20).withColumn("score", F.round("score", 6))


@_query(rf"""WITH {WORDS} SELECT t AS term, id, len(words) AS size, count(*) AS tf FROM (SELECT id, words, unnest(words) AS t FROM words) GROUP BY ALL""")
def postings_index(spark, sf_dir):
    return _index(spark, sf_dir).postings()


@_query(r"SELECT doc_id, regexp_replace(text, '(?i)\b(the|and)\b', '<mark>\1</mark>', 'g') AS marked FROM documents")
def bm25_highlight(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", R.highlighted(F.col("text"), ["the", "and"], "<mark>", "</mark>").alias("marked"))


@_query(f"WITH {WORDS} SELECT id, 1.0::DOUBLE AS score FROM words WHERE list_has_any(words, ['thing', 'tion']) AND list_has_any(words, ['idiot', 'trash', 'clown']) ORDER BY id LIMIT 50")
def boolean_fulltext(spark, sf_dir):
    return _index(spark, sf_dir).holding([["thing", "tion"], ["idiot", "trash", "clown"]]).select("id", F.lit(1.0).alias("score")).orderBy("id").limit(50)


_RANKED = ["the", "and", "tion", "trash"]


@_query(rf"""WITH {WORDS}, p AS (SELECT id, len(words) AS size, t, len(list_filter(words, lambda w: w = t)) AS tf FROM words, (SELECT unnest({_RANKED}) AS t)),
d AS (SELECT t, count(*) FILTER (tf > 0) AS df FROM p GROUP BY t), s AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM words),
bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM p JOIN d USING (t), s GROUP BY id HAVING sum(tf) > 0),
k AS (SELECT id, score, words, list_filter(range(len(words)), lambda i: list_contains({_RANKED}, words[i + 1])) AS pos FROM words JOIN bm USING (id)
WHERE list_has_any(words, ['tion', 'trash']) AND contains(' ' || array_to_string(words, ' ') || ' ', ' and the ') AND NOT list_has_any(words, ['idiot']) ORDER BY score DESC, id LIMIT 10),
c AS (SELECT id, score, words, unnest(pos) AS i, pos FROM k), b AS (SELECT id, score, words, i FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(list_filter(pos, lambda x: x >= i AND x < i + 12)) DESC, i) = 1)
SELECT id, round(score, 6) AS score, array_to_string(list_transform(words[i + 1:i + 12], lambda w: CASE WHEN list_contains({_RANKED}, w) THEN '<mark>' || w || '</mark>' ELSE w END), ' ') AS snippet FROM b""")
def ranked_boolean(spark, sf_dir):
    best = _index(spark, sf_dir).ranked([["tion", "trash"]], [["and", "the"]], ["idiot"], 10)
    words = _words(spark, sf_dir).join(F.broadcast(best), "id")
    return words.select("id", F.round("score", 6).alias("score"), X.snippet(F.col("words"), F.col("start"), _RANKED).alias("snippet"))


@_query(f"""WITH {_bm25_sql(['thing', 'heron'])}, {_NEAR},
a0 AS (SELECT id, 1 - distance / 2 AS s FROM near ORDER BY distance, id LIMIT 60), b0 AS (SELECT id, score AS t FROM bm ORDER BY score DESC, id LIMIT 60),
a AS (SELECT id, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS s FROM a0), b AS (SELECT id, (t - min(t) OVER ()) / (max(t) OVER () - min(t) OVER ()) AS t FROM b0),
f AS (SELECT id, 0.6 * coalesce(s, 0) + 0.4 * coalesce(t, 0) AS score FROM a FULL JOIN b USING (id))
SELECT id, round(score, 6) AS score FROM f WHERE score >= 0.1 ORDER BY f.score DESC, id LIMIT 20""")
def hybrid_linear(spark, sf_dir):
    found = _index(spark, sf_dir).top(["thing", "heron"], 60)
    return R.linear_fusion(_near(spark, sf_dir, 60), found, R.Hybrid()).withColumn("score", F.round("score", 6))


@_query(f"""WITH {_bm25_sql(['thing', 'heron'])}, {_NEAR},
a AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS k FROM near QUALIFY k <= 40), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS k FROM bm QUALIFY k <= 40),
u AS (SELECT id, 0.7 / (60 + k) AS p, 1 AS s FROM a UNION ALL SELECT id, 0.3 / (60 + k), 2 FROM b), g AS (SELECT id, sum(p) AS raw, count(DISTINCT s) AS sources FROM u GROUP BY id)
SELECT id, round(raw / max(raw) OVER (), 6) AS score, sources FROM g ORDER BY raw DESC, id LIMIT 20""")
def rank_fusion(spark, sf_dir):
    a = R.ranked(_near(spark, sf_dir, 40), [F.col("distance"), F.col("id")])
    b = R.ranked(_index(spark, sf_dir).top(["thing", "heron"], 40), [F.desc("score"), F.col("id")])
    return R.rank_fusion([(0.7, a), (0.3, b)], 20).withColumn("score", F.round("score", 6))


@_query("""WITH r AS (SELECT p_partkey AS id, p_size / 50.0 AS s, p_retailprice / 2000.0 AS k, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type] AS h FROM part),
c AS (SELECT *, len(list_intersect(h, ['red', 'ring'])) / 2.0 AS m, (CASE WHEN list_contains(h, 'blue') THEN 1 ELSE 0 END) + (CASE WHEN list_contains(h, 'widget') THEN 1 ELSE 0 END) AS x FROM r)
SELECT id, round((0.6 * s + 0.4 * k + 0.2 * m) * CASE x WHEN 0 THEN 1 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0.1 END, 6) AS score, list_contains(h, 'PROMO') AS vetoed FROM c""")
def rerank_attributes(spark, sf_dir):
    w = F.split("p_name", " ")
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("semantic"), (F.col("p_retailprice") / 2000.0).alias("keyword"), F.array(w[0], w[1], "p_type").alias("attributes"))
    return R.reranked(rows, ["red", "ring"], ["PROMO"], [("red", "blue"), ("ring", "widget"), ("large", "small")]).withColumn("score", F.round("score", 6))


@_query("""WITH n AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars, doc_id) AS number, source, text FROM documents),
p AS (SELECT id, number, '[' || number || '] ' || source || chr(10) || text AS passage FROM n), u AS (SELECT *, sum(octet_length(encode(passage))) OVER (ORDER BY number) AS used FROM p) SELECT id, number, passage FROM u WHERE used <= 4000""")
def rag_context(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").withColumn("id", F.col("doc_id"))
    return R.context(rows, [F.col("n_chars"), F.col("doc_id")], F.col("source"), F.col("text"), 4000)


@_query(f"WITH {WORDS}, w AS (SELECT DISTINCT unnest(words) AS word FROM words) SELECT word FROM w WHERE starts_with(word, 'the') ORDER BY length(word), word LIMIT 20")
def suggest_prefix(spark, sf_dir):
    return _index(spark, sf_dir).starting("The", 20)


@_query("SELECT CASE WHEN source IN ('rules') THEN 'rules' ELSE 'documents' END AS index_name, count(*) AS n FROM documents WHERE source NOT IN ('fiction', 'lore', 'chat', 'session', 'rulebook') GROUP BY 1")
def index_routing(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(R.routed(F.col("source")).alias("index_name")).agg(F.count("*").alias("n"))


@_query("SELECT source, count(*) AS chunks, sum(n_chars)::BIGINT AS chars, count(DISTINCT lang) AS langs FROM documents GROUP BY 1")
def library_rebuild(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.sum("n_chars").alias("chars"), F.count_distinct("lang").alias("langs"))


@_query("SELECT count(DISTINCT text) AS misses FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def embedding_cache_misses(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))
    return R.missing_vectors(docs, docs.where("doc_id % 2 = 0"), "hash").agg(F.count("*").alias("misses"))


@_query("SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING copies > 1")
def content_hash_copies(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(T.content_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


@_query(rf"WITH {WORDS} SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM words) WHERE length(word) >= 2 AND NOT regexp_full_match(word, '\p{{N}}+') GROUP BY 1 HAVING n >= 2")
def dictionary(spark, sf_dir):
    return _index(spark, sf_dir).dictionary()


@_query(f"WITH {WORDS} SELECT pair, count(*) AS n FROM (SELECT unnest([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) AS pair FROM words) GROUP BY 1 HAVING n >= 2")
def bigrams(spark, sf_dir):
    return Q.bigrams(_words(spark, sf_dir))


@_query("""WITH known AS (SELECT p_name AS word, count(*) AS n FROM part GROUP BY 1), typed AS (SELECT DISTINCT replace(left(p_name, 3) || substr(p_name, 5), ' ', ' ') AS word FROM part),
c AS (SELECT t.word, k.word AS best, n, levenshtein(t.word, k.word) AS d FROM typed t, known k WHERE length(t.word) >= 5 AND t.word NOT IN (SELECT word FROM known))
SELECT word, best, d::INT AS distance FROM c WHERE d <= CASE WHEN length(word) < 9 THEN 1 ELSE 2 END QUALIFY row_number() OVER (PARTITION BY word ORDER BY d, n DESC, best) = 1""")
def typo_correct(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    known = part.groupBy(F.col("p_name").alias("word")).agg(F.count("*").alias("n"))
    typed = part.select(F.concat(F.substring("p_name", 1, 3), F.substring("p_name", 5, 100)).alias("word"))
    return Q.corrections(typed, known)


@_query("""WITH s AS (SELECT n_name AS word, r_name AS synonym, r_regionkey AS priority FROM nation JOIN region ON n_regionkey <> r_regionkey),
t AS (SELECT word, list(synonym ORDER BY priority, synonym)[1:2] AS others FROM s GROUP BY 1)
SELECT s_suppkey AS id, array_to_string(list_prepend(n_name, others), ' OR ') AS terms FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN t ON word = n_name""")
def synonym_expansion(spark, sf_dir):
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    synonyms = n.join(r, F.col("n_regionkey") != F.col("r_regionkey")).select(F.col("n_name").alias("word"), F.col("r_name").alias("synonym"), F.col("r_regionkey").alias("priority"))
    asked = load(spark, sf_dir, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("id"), F.array("n_name").alias("words"))
    return Q.expanded(asked, synonyms, 2).select("id", F.array_join("terms", " OR ").alias("terms"))


@_query(r"""SELECT word, CASE WHEN word LIKE '%ing' AND length(word) > 5 THEN left(word, length(word) - 3) WHEN word LIKE '%ed' AND length(word) > 4 THEN left(word, length(word) - 2)
WHEN word LIKE '%s' AND word NOT LIKE '%ss' AND length(word) > 3 THEN left(word, length(word) - 1) WHEN word LIKE '%ly' AND length(word) > 4 THEN left(word, length(word) - 2) ELSE word END AS stem,
CASE WHEN word IN ('thing', 'heron') THEN 1.5 WHEN n > 20 THEN 1.2 ELSE 1.0 END AS weight FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents) WHERE length(word) >= 2 GROUP BY 1 HAVING n >= 2 AND NOT regexp_full_match(word, '\p{N}+'))""")
def weighted_expansion(spark, sf_dir):
    words = _index(spark, sf_dir).dictionary()
    return words.select("word", T.stem(F.col("word")).alias("stem"), Q.weights(F.col("word"), ["thing", "heron"], F.col("n") > 20).alias("weight"))


@_query(r"""SELECT c_custkey, array_to_string(regexp_extract_all(q, '"([^"]+)"', 1), ',') AS quoted, array_to_string(regexp_extract_all(lower(q), '\b(?:not|without|except|exclude)\s+(\w+)', 1), ',') AS negated,
c_custkey % 7 AS low, (c_custkey % 7 + 3) AS high, 'find things with' AS rest FROM (SELECT c_custkey, 'Find things  with "' || c_name || '" level ' || (c_custkey % 7) || '-' || (c_custkey % 7 + 3) || ' without ' || c_mktsegment AS q FROM customer)""")
def constraint_parser(spark, sf_dir):
    q = F.concat(F.lit('Find things  with "'), F.col("c_name"), F.lit('" level '), (F.col("c_custkey") % 7).cast("string"), F.lit("-"), (F.col("c_custkey") % 7 + 3).cast("string"), F.lit(" without "), F.col("c_mktsegment"))
    rows = load(spark, sf_dir, "customer").select("c_custkey", Q.constraints(q).alias("c"))
    return rows.select("c_custkey", F.array_join("c.quoted", ",").alias("quoted"), F.array_join("c.negated", ",").alias("negated"), F.col("c.low").cast("long").alias("low"), F.col("c.high").cast("long").alias("high"), "c.rest")


@_query("SELECT a.p_brand AS a, b.p_brand AS b, round(1 - levenshtein(a.p_brand, b.p_brand) / greatest(octet_length(encode(a.p_brand)), octet_length(encode(b.p_brand))), 6) AS likeness FROM (SELECT DISTINCT p_brand FROM part) a JOIN (SELECT DISTINCT p_brand FROM part) b ON a.p_brand < b.p_brand WHERE 1 - levenshtein(a.p_brand, b.p_brand) / greatest(octet_length(encode(a.p_brand)), octet_length(encode(b.p_brand))) >= 0.8")
def vocabulary_likeness(spark, sf_dir):
    return Q.alike(load(spark, sf_dir, "part").select(F.col("p_brand").alias("word")), 0.8).withColumn("likeness", F.round("likeness", 6))


@_query(r"SELECT page_id, CASE WHEN length(html) > 20000 THEN 'too long' WHEN regexp_matches(lower(html), '<script|javascript:|on\w+\s*=') THEN 'markup' END AS problem FROM pages")
def input_validation(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", Q.validation(F.col("html"), 20000).alias("problem"))


@_query(r"""WITH t AS (SELECT page_id AS id, html AS t FROM pages UNION ALL SELECT doc_id + 1000000000, text FROM documents), p AS (SELECT id, t, CASE WHEN length(t) > 20000 THEN 'too long' WHEN regexp_matches(lower(t), '<script|javascript:|on\w+\s*=') THEN 'markup' END AS problem FROM t),
s AS (SELECT id, t, problem, CASE WHEN problem IS NULL THEN replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') END AS safe FROM p)
SELECT id, problem, md5(safe) AS safe, safe != t AS changed FROM s""")
def sanitised_input(spark, sf_dir):
    rows = load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("t"))
    rows = rows.union(load(spark, sf_dir, "documents").select(F.col("doc_id") + 1000000000, "text"))
    return rows.select("id", Q.sanitised(F.col("t"), 20000).alias("s")).select("id", "s.problem", F.md5("s.text").alias("safe"), "s.changed")


@_query(r"SELECT doc_id, lower(trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g'))) AS text FROM documents")
def normalise_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.normalised(F.col("text")).alias("text"))


@_query(rf"WITH {WORDS} SELECT id, len(list_filter(words, lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','he','in','is','it','its','of','on','or','that','the','to','was','were','will','with'))) AS kept FROM words")
def stop_words(spark, sf_dir):
    return _words(spark, sf_dir).select("id", F.size(T.without_stop_words(F.col("words"))).cast("long").alias("kept"))


@_query("SELECT p_partkey, lower(replace(replace(p_name || ' ' || p_brand, ' ', '-'), '#', '')) AS slug FROM part")
def slug_key(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))
