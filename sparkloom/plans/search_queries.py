"""Queries of neighbouring rows, query preparation, search with filters, and streams in pieces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import documents as D
from sparkloom.operators import neighbours as N
from sparkloom.operators import querytext as Q
from sparkloom.operators import retrieval as R
from sparkloom.operators import search_index as X
from sparkloom.operators import spans as S
from sparkloom.plans.retrieval_queries import ORACLE_SQL as SQL
from sparkloom.plans.retrieval_queries import WORDS, _bm25_sql, _index, _words, hybrid_linear
from sparkloom.sources import versioned as V
from sparkloom.sources.tables import load
from sparkloom.streaming import stateful

QUERIES = {}
ORACLE_SQL = {}


def _query(sql: str | None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


@_query("""WITH a AS (SELECT s_nationkey AS g, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier),
b AS (SELECT c_nationkey AS g, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1 AS place FROM customer)
SELECT g, place, s_suppkey, c_custkey FROM a FULL JOIN b USING (g, place)""")
def zip_join(spark, sf_dir):
    a = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), "s_suppkey")
    b = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), "c_custkey", "c_acctbal")
    return S.zipped(a, b, "g", ["s_suppkey"], ["c_acctbal", "c_custkey"]).select("g", "place", "s_suppkey", "c_custkey")


@_query("""WITH w AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS clicked FROM events WHERE event_type IN ('click', 'purchase'))
SELECT event_id, user_id, clicked FROM w WHERE event_type = 'purchase'""")
def as_of_join(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", "event_id", F.col("value").alias("clicked"))
    return S.as_of(bought, clicks, "user_id", "ts", "event_id", "clicked").select("event_id", "user_id", "clicked")


_SPANS = "spans AS (SELECT l_orderkey AS g, (l_partkey * 7) % 60 AS s, (l_partkey * 7) % 60 + l_quantity::BIGINT AS e, l_discount AS c FROM lineitem)"


@_query(f"""WITH {_SPANS}, l AS (SELECT g, list([struct_pack(c := -c, s := s, e := e)] ORDER BY -c, s, e) AS l FROM spans GROUP BY 1),
k AS (SELECT g, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda k: k.s < x[1].e AND x[1].s < k.e)) > 0 THEN a ELSE list_concat(a, x) END)) AS k FROM l)
SELECT g, k.s AS s, k.e AS e, -k.c AS c FROM k""")
def greedy_spans(spark, sf_dir):
    start = (F.col("l_partkey") * 7) % 60
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), start.alias("s"), (start + F.col("l_quantity").cast("long")).alias("e"), F.col("l_discount").alias("c"))
    return S.without_overlaps(rows, "g", "s", "e", "c")


@_query("""WITH l AS (SELECT l_orderkey AS g, list([struct_pack(p := (l_partkey * 7) % 60, s := l_extendedprice)] ORDER BY (l_partkey * 7) % 60, l_extendedprice) AS l FROM lineitem GROUP BY 1),
k AS (SELECT g, unnest(list_reduce(l, lambda a, x: CASE WHEN x[1].p - a[-1].p >= 8 THEN list_concat(a, x) WHEN x[1].s > a[-1].s THEN list_concat(a[1:len(a) - 1], x) ELSE a END)) AS k FROM l)
SELECT g, k.p AS p, k.s AS s FROM k""")
def neighbour_collapse(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), ((F.col("l_partkey") * 7) % 60).alias("p"), F.col("l_extendedprice").alias("s"))
    return S.collapsed(rows, "g", "p", "s", 8)


@_query("""WITH RECURSIVE m AS (SELECT DISTINCT o_orderkey AS g, o_custkey * 3 + o_orderkey % 3 AS t FROM orders),
e AS (SELECT DISTINCT a.g AS x, b.g AS y FROM m a JOIN m b USING (t)), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y), n AS (SELECT x AS g, min(y) AS name FROM r GROUP BY 1)
SELECT DISTINCT t, name AS g FROM m JOIN n USING (g)""")
def synonym_groups(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return S.united(o.select(F.col("o_orderkey").alias("g"), (F.col("o_custkey") * 3 + F.col("o_orderkey") % 3).alias("t")), "g", "t").select("t", "g")


@_query("""SELECT user_id, arg_max(event_type, struct_pack(ts, event_id)) AS status, max(ts) FILTER (event_type = 'view') AS started_at, max(ts) FILTER (event_type IN ('purchase', 'error')) AS resolved_at FROM events GROUP BY 1""")
def plot_transitions(spark, sf_dir):
    log = load(spark, sf_dir, "events").withColumnRenamed("event_type", "status")
    return S.transitions(log, "user_id", "ts", "event_id", "status", "view", ["purchase", "error"])


@_query("SELECT event_id, ts, value FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 20")
def roll_history(spark, sf_dir):
    return load(spark, sf_dir, "events").where("user_id = 7").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts", "value")


@_query(f"""WITH {WORDS}, p AS (SELECT words[i] || ' ' || words[i + 1] AS pair, count(*) AS n FROM (SELECT words, unnest(range(1, len(words))) AS i FROM words) GROUP BY 1 HAVING n >= 2),
w AS (SELECT DISTINCT unnest(words) AS word FROM words), d AS (SELECT word FROM w WHERE length(word) >= 2)
SELECT word, arg_min(pair, struct_pack(n := -n, pair := pair)) AS split FROM d JOIN p ON replace(pair, ' ', '') = word GROUP BY 1""")
def compound_split(spark, sf_dir):
    words = _words(spark, sf_dir)
    return Q.compounds(_index(spark, sf_dir).dictionary(1).unionByName(_numbers(spark, sf_dir)), Q.bigrams(words))


def _numbers(spark, sf_dir):
    return _index(spark, sf_dir).terms.where((F.length("term") >= 2) & F.col("term").rlike(r"^\p{N}+$")).select(F.col("term").alias("word"), "n")


@_query("""WITH q AS (SELECT p_partkey, list_filter(string_split('the ' || p_name || ' of ' || lower(p_type), ' '), lambda w: w NOT IN ('the', 'of')) AS words FROM part)
SELECT p_partkey, array_to_string(list_filter(l, lambda w, i: list_position(l, w) = i), ',') AS terms FROM (SELECT p_partkey, flatten(list_transform(words, lambda w: list_concat([w], CASE w WHEN 'promo' THEN ['promotion'] WHEN 'economy' THEN ['eco', 'cheap'] WHEN 'red' THEN ['crimson', 'ring'] ELSE []::VARCHAR[] END))) AS l FROM q)""")
def variant_expansion(spark, sf_dir):
    words = F.split(F.concat(F.lit("the "), "p_name", F.lit(" of "), F.lower("p_type")), " ")
    terms = Q.variants(words, {"eco": "economy", "promo": "promotion"}, {"economy": ["cheap"], "red": ["crimson", "ring"]})
    return load(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", terms).alias("terms"))


_PREPARED = """known AS (SELECT n_name AS word, count(*) AS n FROM (SELECT lower(replace(n_name, ' ', '')) AS n_name FROM nation) GROUP BY 1),
raw AS (SELECT n_nationkey AS id, lower(replace(n_name, ' ', '')) AS a, left(lower(replace(n_name, ' ', '')), 3) || substr(lower(replace(n_name, ' ', '')), 5) AS b FROM nation),
each AS (SELECT id, 0 AS place, a AS word FROM raw UNION ALL SELECT id, 1, b FROM raw),
c AS (SELECT e.id, e.place, e.word, first(k.word ORDER BY levenshtein(e.word, k.word), n DESC, k.word) AS best FROM each e JOIN known k ON levenshtein(e.word, k.word) <= CASE WHEN length(e.word) < 9 THEN 1 ELSE 2 END
WHERE length(e.word) >= 5 AND e.word NOT IN (SELECT word FROM known) AND length(k.word) >= 4 GROUP BY ALL),
r AS (SELECT id, place, coalesce(best, word) AS word FROM each LEFT JOIN c USING (id, place, word)),
syn AS (SELECT lower(replace(n_name, ' ', '')) AS word, lower(r_name) AS synonym FROM nation JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT id, place, r.word, CASE WHEN synonym IS NULL THEN r.word ELSE '(' || r.word || ' OR ' || synonym || ')' END AS term FROM r LEFT JOIN syn USING (word))"""


@_query(f"WITH {_PREPARED} SELECT id, string_agg(word, ' ' ORDER BY place) AS corrected, string_agg(term, ' AND ' ORDER BY place) AS expanded FROM t GROUP BY 1")
def query_preparation(spark, sf_dir):
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    word = F.lower(F.replace("n_name", F.lit(" "), F.lit("")))
    known = n.groupBy(word.alias("word")).agg(F.count("*").alias("n"))
    raw = F.concat(F.lit("  "), F.upper(word), F.lit(" \t "), F.substring(word, 1, 3), F.substring(word, 5, 100))
    synonyms = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(word.alias("word"), F.lower("r_name").alias("synonym"), F.lit(1).alias("priority"))
    return Q.prepared(n.select(F.col("n_nationkey").alias("id"), raw.alias("query")), known, synonyms)


@_query(f"""WITH {WORDS}, known AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM words) WHERE length(word) >= 2 AND NOT regexp_full_match(word, '\\p{{N}}+') GROUP BY 1 HAVING n >= 2),
asked AS (SELECT unnest(['trasch', 'worthlss']) AS word),
c AS (SELECT a.word, first(k.word ORDER BY levenshtein(a.word, k.word), n DESC, k.word) AS best FROM asked a JOIN known k ON levenshtein(a.word, k.word) <= 1 WHERE a.word NOT IN (SELECT word FROM known) AND length(k.word) >= 4 GROUP BY 1),
terms AS (SELECT DISTINCT coalesce(best, word) AS t FROM asked LEFT JOIN c USING (word)),
p AS (SELECT id, len(words) AS size, t, len(list_filter(words, lambda w: w = t)) AS tf FROM words, terms), d AS (SELECT t, count(*) FILTER (tf > 0) AS df FROM p GROUP BY t), s AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM words)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM p JOIN d USING (t), s GROUP BY id HAVING sum(tf) > 0 ORDER BY sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) DESC, id LIMIT 20""")
def corrected_search(spark, sf_dir):
    index = _index(spark, sf_dir)
    terms = index.corrected("trasch worthlss".split(" "))
    return index.top(terms, 20).withColumn("score", F.round("score", 6))


@_query(f"WITH {_bm25_sql(['trash', 'clown'])} SELECT bm.id, round(score, 6) AS score, source FROM bm JOIN documents ON doc_id = bm.id WHERE lang = 'en' ORDER BY bm.score DESC, bm.id LIMIT 20")
def filtered_search(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), "source")
    return _index(spark, sf_dir).bm25(["trash", "clown"]).join(docs, "id").orderBy(F.desc("score"), "id").limit(20).withColumn("score", F.round("score", 6))


_VOCABULARY = ["the", "ther", "ing", "und", "sch", "que", "ment", "ción", "secret", "token", "license"]


@_query(f"SELECT doc_id, array_to_string(list_filter({_VOCABULARY}, lambda v: contains(lower(text), v))[1:5], ',') AS keywords FROM documents")
def keyword_extraction(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", D.keywords(F.col("text"), _VOCABULARY, 5)).alias("keywords"))


@_query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), v AS (SELECT doc_id, CASE WHEN regexp_matches(trim(lower(line)), '^(chapter|part|appendix)\b') THEN 1 WHEN regexp_matches(trim(lower(line)), '^section\b|^\d+\.\s') THEN 2
WHEN regexp_matches(trim(lower(line)), '^\d+\.\d+') THEN 3 WHEN upper(line) = line AND regexp_matches(line, '[A-Z]{2}') AND length(line) <= 60 THEN 4 END AS level FROM l)
SELECT doc_id, level, count(*) AS lines FROM v WHERE level IS NOT NULL GROUP BY ALL""")
def header_levels(spark, sf_dir):
    lines = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", D.header_level(F.col("line")).alias("level")).where("level is not null").groupBy("doc_id", "level").agg(F.count("*").alias("lines"))


@_query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'stat block' WHEN 1 THEN 'read-aloud' WHEN 2 THEN 'sidebar' WHEN 3 THEN 'callout' ELSE 'body' END AS kind, CASE p_partkey % 5 WHEN 0 THEN 0.85 WHEN 1 THEN 0.7 WHEN 2 THEN 0.8 WHEN 3 THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence FROM part""")
def page_regions(spark, sf_dir):
    blocks = [F.concat(F.lit("Beast\nArmor Class 12\nHit Points "), "p_size", F.lit("\nSpeed 30")), F.concat(F.lit("Read aloud: "), "p_name"), F.concat(F.lit("Optional rule "), "p_name"), F.concat(F.lit("Tip: "), "p_name"), F.col("p_name")]
    text = F.element_at(F.array(*blocks), (F.col("p_partkey") % 5).cast("int") + 1)
    return load(spark, sf_dir, "part").select("p_partkey", D.region(text).alias("r")).select("p_partkey", "r.kind", "r.confidence")


#: Lines that are evidence of a region; a part's block has those of the bits of its key.
_LINES = ["Armor Class 12", "Hit Points 7", "STR 8 (-1) speed 30", "Read aloud to all", "you see a light, before you lies", "a sound of silence", "Note: variant", "OPTIONAL", "Warning: beware!", "senses, languages and challenge"]


@_query(f"""WITH b AS (SELECT p_partkey AS id, p_name || list_aggregate(list_transform(list_filter(range(10), lambda i: (p_partkey >> i) % 2 = 1), lambda i: chr(10) || {_LINES}[i + 1]), 'string_agg', '') AS t FROM part UNION ALL SELECT p_partkey + 1000000000, '  *' || p_type || '! ' FROM part UNION ALL SELECT doc_id + 2000000000, text FROM documents),
t AS (SELECT id, regexp_replace(coalesce(t, ''), '^\\s+|\\s+$', '', 'g') AS t FROM b), l AS (SELECT id, t, lower(t) AS w FROM t WHERE octet_length(encode(t)) >= 20),
n AS (SELECT id, 2 * len(list_filter({list(("armor class", "hit points"))}, lambda x: contains(w, x))) + len(list_filter({list(D._STATS)}, lambda x: contains(w, x))) + CASE WHEN regexp_matches(w, '(str|dex|con|int|wis|cha)\\s+\\d+\\s*\\([+-]?\\d+\\)') THEN 3 ELSE 0 END AS stats,
CASE WHEN contains(w, 'read aloud') OR contains(w, 'boxed text') THEN 8 ELSE 0 END + CASE WHEN t[1] IN ('"', chr(39), '*') THEN 3 ELSE 0 END + CASE WHEN list_sum(list_transform({list(D._ADDRESS)}, lambda x: (length(w) - length(replace(w, x, ''))) // length(x))) >= 2 THEN 4 ELSE 0 END + CASE WHEN len(list_filter({list(D._MOOD)}, lambda x: contains(w, x))) >= 2 THEN 3 ELSE 0 END AS aloud,
CASE WHEN len(list_filter(string_split('{D._ASIDE}', '|'), lambda x: contains(chr(10) || w, chr(10) || x || ':'))) > 0 THEN 8 ELSE 0 END + CASE WHEN len(list_filter(['SIDEBAR', 'VARIANT', 'OPTIONAL', 'NOTE', 'TIP'], lambda x: contains(t, x))) > 0 THEN 4 ELSE 0 END + CASE WHEN length(t) - length(replace(t, chr(10), '')) < 14 THEN 1 ELSE 0 END AS aside,
CASE WHEN len(list_filter(string_split('{D._WARNING.replace("'", "''")}', '|'), lambda x: contains(chr(10) || w, chr(10) || x || ':'))) > 0 THEN 7 ELSE 0 END + CASE WHEN contains(t, '!') AND octet_length(encode(t)) < 500 THEN 2 ELSE 0 END AS warning FROM l),
k AS (SELECT id, 0 AS place, 'stat block' AS kind, least(stats / 12, 1.0)::DOUBLE AS confidence FROM n UNION ALL SELECT id, 1, 'read-aloud', least(aloud / 10, 1.0)::DOUBLE FROM n UNION ALL SELECT id, 2, 'sidebar', least(aside / 10, 1.0)::DOUBLE FROM n UNION ALL SELECT id, 3, 'callout', least(warning / 10, 1.0)::DOUBLE FROM n)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY confidence DESC, place))::INT AS rank, kind, confidence FROM k WHERE confidence >= 0.5""")
def region_candidates(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    lines = [F.when(F.shiftright("p_partkey", i) % 2 == 1, F.lit("\n" + x)).otherwise("") for i, x in enumerate(_LINES)]
    blocks = part.select(F.col("p_partkey").alias("id"), F.concat("p_name", *lines).alias("t"))
    blocks = blocks.union(part.select(F.col("p_partkey") + 1000000000, F.concat(F.lit("  *"), "p_type", F.lit("! "))))
    blocks = blocks.union(load(spark, sf_dir, "documents").select(F.col("doc_id") + 2000000000, "text"))
    found = blocks.select("id", F.posexplode(D.regions(F.col("t"))).alias("rank", "r"))
    return found.select("id", (F.col("rank") + 1).alias("rank"), "r.kind", "r.confidence")


@_query("SELECT user_id, sum((props->>'$.k')::INT)::BIGINT AS total, count(*) AS n FROM events WHERE props LIKE '{%' GROUP BY 1")
def stream_frames(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "props")
    # Each frame comes in two pieces, the cut inside the JSON.
    text = F.concat(F.lit("data: "), "props", F.lit("\n: comment\n\n"))
    cut = (F.col("event_id") % 9 + 1).cast("int")
    pieces = F.explode(F.array(F.struct((F.col("event_id") * 2).alias("o"), F.substring(text, F.lit(1), cut).alias("piece")), F.struct((F.col("event_id") * 2 + 1).alias("o"), F.substring(text, cut + 1, F.length(text)).alias("piece"))))
    got = stateful.frames(e.select("user_id", pieces.alias("p")).select("user_id", "p.o", "p.piece"), "user_id", "o", "piece", "k int")
    return got.groupBy("user_id").agg(F.sum("event.k").alias("total"), F.count("*").alias("n"))


_LINKS = """WITH refs AS (SELECT l_orderkey * 10 + l_linenumber AS key, 'page' AS kind, (l_partkey % 300)::VARCHAR AS target FROM lineitem UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'table', l_linenumber || '-2' FROM lineitem),
cat AS (SELECT 'page' AS kind, p_partkey::VARCHAR AS target, p_name AS title FROM part UNION ALL SELECT 'table', n_nationkey::VARCHAR, n_name FROM nation)"""


def _links(spark, sf_dir):
    i = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.concat(F.lit("on page "), F.col("l_partkey") % 300, F.lit(", see table "), "l_linenumber", F.lit("-2.")).alias("t"))
    refs = i.select("key", F.explode(D.cross_references(F.col("t"))).alias("r")).select("key", "r.kind", "r.target")
    pages = load(spark, sf_dir, "part").select(F.lit("page").alias("kind"), F.col("p_partkey").cast("string").alias("target"), F.col("p_name").alias("title"))
    tables = load(spark, sf_dir, "nation").select(F.lit("table").alias("kind"), F.col("n_nationkey").cast("string").alias("target"), F.col("n_name").alias("title"))
    return refs, D.linked_references(refs, pages.unionByName(tables))


@_query(_LINKS + """
SELECT DISTINCT key, r.kind, r.target, title, (CASE WHEN c.target = r.target THEN 1.0 ELSE 0.5 END)::DOUBLE AS confidence FROM refs r JOIN cat c ON c.kind = r.kind AND (c.target = r.target OR c.target = regexp_extract(r.target, '^(\\d+)', 1))""")
def rulebook_links(spark, sf_dir):
    return _links(spark, sf_dir)[1]


@_query(f"""WITH h AS ({SQL['hybrid_linear']}), d AS (SELECT id, score, text, source, (['spell', 'Monster', 'table', 'text'])[id % 4 + 1] AS kind, CASE id % 3 WHEN 0 THEN ' Saving throw' WHEN 1 THEN ' hit points, armor class' ELSE ' Prerequisite: none' END AS more FROM h JOIN documents ON doc_id = id)
SELECT id, round(least(greatest(score + CASE WHEN contains(lower(text), 'heron') THEN 0.1 ELSE 0 END + CASE WHEN contains(lower(source), 'heron') OR contains('heron', lower(source)) THEN 0.05 ELSE 0 END + CASE WHEN kind IN ('spell', 'table') THEN 0.05 ELSE 0 END, 0), 1), 6)::DOUBLE AS confidence,
CASE lower(kind) WHEN 'spell' THEN 'spell' WHEN 'monster' THEN 'monster' ELSE CASE WHEN regexp_matches(lower(text || more), 'saving throw|spell attack') THEN 'spell' WHEN contains(lower(text || more), 'hit points') AND contains(lower(text || more), 'armor class') THEN 'monster' WHEN contains(lower(text || more), 'prerequisite:') THEN 'feat' ELSE 'term' END END AS about FROM d""")
def linked_content(spark, sf_dir):
    """What a hybrid search finds for a reference, how surely it is meant, and what it is about."""
    found = hybrid_linear(spark, sf_dir)
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    rows = found.join(docs, "id").withColumn("kind", F.element_at(F.array(*map(F.lit, ("spell", "Monster", "table", "text"))), (F.col("id") % 4 + 1).cast("int")))
    more = F.element_at(F.array(*map(F.lit, (" Saving throw", " hit points, armor class", " Prerequisite: none"))), (F.col("id") % 3 + 1).cast("int"))
    sure = D.link_confidence(F.col("score"), F.lit("heron"), F.col("text"), F.col("source"), F.col("kind"))
    return rows.select("id", F.round(sure, 6).alias("confidence"), D.linked_kind(F.col("kind"), F.concat("text", more)).alias("about"))


@_query(_LINKS + """, r AS (SELECT DISTINCT * FROM refs), f AS (SELECT key, r.kind, r.target, max(CASE WHEN c.target = r.target THEN 1.0 WHEN c.target IS NOT NULL THEN 0.5 END) AS sure FROM r LEFT JOIN cat c ON c.kind = r.kind AND (c.target = r.target OR c.target = regexp_extract(r.target, '^(\\d+)', 1)) GROUP BY ALL)
SELECT kind, count(*) AS refs, count(sure) AS linked, count(*) FILTER (sure = 1.0) AS sure, count(*) - count(sure) AS open, round(count(sure) / count(*), 6)::DOUBLE AS share FROM f GROUP BY 1""")
def link_validation(spark, sf_dir):
    return D.link_report(*_links(spark, sf_dir)).withColumn("share", F.round("share", 6))


@_query(None)
def ann_cosine(spark, sf_dir):
    """The twenty vectors nearest to the first one, by the stored inverted file; recall is tested against knn_cosine."""
    v = load(spark, sf_dir, "embeddings")
    asked = v.where("vec_id = 0").select("embedding").first()[0]
    return N.index_of(v, "vec_id", "embedding").nearest(asked, 20).withColumn("distance", F.round("distance", 6))


_PRE = f"""{WORDS}, known AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM words) WHERE length(word) >= 2 AND NOT regexp_full_match(word, '\\p{{N}}+') GROUP BY 1 HAVING n >= 2),
asked AS (SELECT * FROM (VALUES (0, 'trasch'), (1, 'worthlss')) t(place, word)),
c AS (SELECT a.word, first(k.word ORDER BY levenshtein(a.word, k.word), n DESC, k.word) AS best FROM asked a JOIN known k ON levenshtein(a.word, k.word) <= 1 WHERE a.word NOT IN (SELECT word FROM known) AND length(k.word) >= 4 GROUP BY 1),
r AS (SELECT place, coalesce(best, word) AS word FROM asked LEFT JOIN c USING (word)),
syn AS (SELECT * FROM (VALUES ('trash', 'garbage'), ('trash', 'idiot'), ('worthless', 'clown')) t(word, other)),
g AS (SELECT place, word AS t FROM r UNION SELECT place, other FROM r JOIN syn USING (word)),
q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT sum(length(word)) FROM r)),
near AS (SELECT vec_id AS id, 1 - list_dot_product(embedding::DOUBLE[], e) / sqrt(list_dot_product(e, e) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS distance FROM embeddings, q ORDER BY distance, id LIMIT 60),
m AS (SELECT id FROM (SELECT id, place FROM words, g WHERE list_contains(words, t) GROUP BY id, place) GROUP BY id HAVING count(*) = 2),
p AS (SELECT id, size, t, tf FROM (SELECT id, len(words) AS size, t, len(list_filter(words, lambda w: w = t)) AS tf FROM words, (SELECT DISTINCT t FROM g))),
d AS (SELECT t, count(*) FILTER (tf > 0) AS df FROM p GROUP BY t), s AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM words),
bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM (SELECT * FROM p SEMI JOIN m USING (id)) p JOIN d USING (t), s GROUP BY id ORDER BY score DESC, id LIMIT 60),
a AS (SELECT id, CASE WHEN max(1 - distance / 2) OVER () > min(1 - distance / 2) OVER () THEN (1 - distance / 2 - min(1 - distance / 2) OVER ()) / (max(1 - distance / 2) OVER () - min(1 - distance / 2) OVER ()) ELSE 1 END AS s FROM near),
b AS (SELECT id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END AS t FROM bm),
f AS (SELECT id, 0.6 * coalesce(s, 0) + 0.4 * coalesce(t, 0) AS score FROM a FULL JOIN b USING (id))"""


@_query(f"WITH {_PRE} SELECT id, round(score, 6) AS score FROM f WHERE score >= 0.1 ORDER BY f.score DESC, id LIMIT 20")
def hybrid_preprocessed(spark, sf_dir):
    """Hybrid search of a raw query: corrected for the vector side, with synonyms for full text, fused."""
    synonyms = {"trash": ["garbage", "idiot"], "worthless": ["clown"]}
    v = load(spark, sf_dir, "embeddings")

    def embed(text: str):
        # The tables have no model: a corrected text stands for the vector numbered by its letters.
        n = len(text.replace(" ", ""))
        return F.broadcast(v.where(F.col("vec_id") == n).select(F.col("embedding").alias("asked")))

    return R.preprocessed(_index(spark, sf_dir), v, "vec_id", "embedding", "  TRASCH  worthlss ", embed, synonyms, R.Hybrid()).withColumn("score", F.round("score", 6))


@_query("""WITH c AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, doc_id, lang, CASE WHEN source = 'src1' THEN 'again: ' || text ELSE text END AS content FROM documents),
v AS (SELECT c.*, (CASE WHEN source = 'src0' THEN (doc_id + 1) % 500 ELSE doc_id % 500 END) AS vec FROM c)
SELECT source AS item_id, k::INT AS chunk_index, md5(content) AS hash, round(embedding[1]::DOUBLE, 6) AS first, n AS item_chunks FROM v JOIN embeddings ON vec_id = vec JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) USING (source) WHERE lang <> 'fr'""")
def chunk_sink(spark, sf_dir):
    """Documents as chunks with vectors in a store: ingested, one source once more, vectors of another updated, a language deleted; then read back."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    docs = load(spark, sf_dir, "documents").select(F.col("source").alias("item_id"), place.alias("chunk_index"), "doc_id", "lang", F.col("text").alias("content"))
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")

    def vectors(rows, more=0):
        return rows.select("item_id", "chunk_index", ((F.col("doc_id") + more) % 500).alias("vec_id")).join(e, "vec_id").drop("vec_id")

    store = V.chunk_store(spark)
    V.ingest_chunks(store, docs, vectors(docs), 64)
    again = docs.where("item_id = 'src1'").withColumn("content", F.concat(F.lit("again: "), "content"))
    V.ingest_chunks(store, again, vectors(again), 64)
    V.update_vectors(store, vectors(docs.where("item_id = 'src0'"), 1))
    store.delete("chunks", F.col("lang") == "fr")
    items = store.read("items").select("item_id", F.col("chunks").alias("item_chunks"))
    return store.read("chunks").join(items, "item_id").select("item_id", "chunk_index", F.md5("content").alias("hash"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), "item_chunks")
