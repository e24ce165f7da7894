"""Queries of mentions, references, completions, nested differences and rolls."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import completion as C
from sparkloom.operators import mentions as M
from sparkloom.operators import nested as N
from sparkloom.operators import querytext as Q
from sparkloom.sources import markup
from sparkloom.sources.tables import load

QUERIES = {}
ORACLE_SQL = {}


def _query(sql: str | None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


@_query(r"""WITH b AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 7) AS w FROM benchmark),
v AS (SELECT DISTINCT unnest(w) AS term FROM b),
d AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 7)) AS term FROM documents)
SELECT doc_id, term, count(*) AS n FROM d JOIN v USING (term) GROUP BY 1, 2""")
def vocabulary_mentions(spark, sf_dir):
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 7)
    terms = load(spark, sf_dir, "benchmark").select(F.explode(words).alias("term")).distinct()
    vocabulary = terms.select("term", F.lit("benchmark").alias("label"), F.lit(0.8).alias("confidence"))
    return M.mentions(load(spark, sf_dir, "documents"), "doc_id", "text", vocabulary).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@_query(None)
def vocabulary_spans(spark, sf_dir):
    words = T.tokens(F.col("text"))
    b = load(spark, sf_dir, "benchmark").select(words.alias("w")).where(F.size("w") > 1)
    pairs = b.select(F.explode(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda x, y: F.concat_ws(" ", x, y))).alias("term"))
    single = b.select(F.explode(F.filter("w", lambda w: F.length(w) >= 6)).alias("term"))
    vocabulary = pairs.distinct().select("term", F.lit("pair").alias("label"), F.lit(0.9).alias("confidence")).unionByName(single.distinct().select("term", F.lit("word").alias("label"), F.lit(0.6).alias("confidence")))
    return M.mentions(load(spark, sf_dir, "documents"), "doc_id", "text", vocabulary)


_ROMAN = "['I', 'II', 'III', 'IV', 'V', 'VI', 'VII']"


@_query(f"""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS key, l_partkey % 300 + 1 AS p, l_linenumber AS n FROM lineitem)
SELECT key, 'page' AS kind, p || '-' || (p + 4) AS target, p::BIGINT AS low, (p + 4)::BIGINT AS high, 0.95::DOUBLE AS confidence FROM l
UNION ALL SELECT key, 'chapter', {_ROMAN}[n], n, n, 0.85 FROM l
UNION ALL SELECT key, 'figure', n || '.2', NULL, NULL, 0.9 FROM l
UNION ALL SELECT key, 'table', unnest([n || '', (n + 1) || '']), unnest([n, n + 1]), unnest([n, n + 1]), 0.95 FROM l""")
def reference_mentions(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")
    page, n = (F.col("l_partkey") % 300 + 1), F.col("l_linenumber")
    numeral = F.element_at(F.array(*(F.lit(x) for x in ("I", "II", "III", "IV", "V", "VI", "VII"))), n.cast("int"))
    text = F.concat(F.lit("For this, see pages "), page, F.lit(" - "), page + 4, F.lit(" (Chapter "), numeral, F.lit(") with Fig. "), n, F.lit(".2; consult the tables "), n, F.lit(" and "), n + 1, F.lit("."))
    rows = l.select((F.col("l_orderkey") * 10 + n).alias("key"), text.alias("t"))
    return M.references(rows, "key", "t").drop("start", "end")


@_query("""WITH w AS (SELECT lower(p_name) AS word, count(*) AS n FROM part GROUP BY 1), q AS (SELECT DISTINCT left(p_name, k) AS partial FROM part, (VALUES (1), (3), (5), (7)) t(k))
SELECT partial, word, row_number() OVER (PARTITION BY partial ORDER BY n DESC, word)::INT AS rank FROM q JOIN w ON starts_with(word, lower(partial)) QUALIFY rank <= 5""")
def completions(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    known = part.groupBy(F.lower("p_name").alias("word")).agg(F.count("*").alias("n"))
    partials = part.select(F.explode(F.array(*(F.substring("p_name", 1, k) for k in (1, 3, 5, 7)))).alias("partial"))
    return C.Completions(known).completed(partials, 5)


@_query("""WITH q AS (SELECT DISTINCT p_partkey AS id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT id, a || 'x ' || b || ' lg' AS raw, a || ' ' || b || ' lg' AS corrected, a || ' AND (' || b || ' OR item) AND (lg OR large)' AS expanded, 'correction|' || a || 'x -> ' || a || ';abbreviation|lg: large;synonym|' || b || ': item' || CASE WHEN b = 'ring' THEN ';context|ring' ELSE '' END AS hints, CASE WHEN b = 'ring' THEN 'jewel,sound' END AS options FROM q WHERE length(a) >= 4""")
def query_enhancement(spark, sf_dir):
    name = F.split("p_name", " ")
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name[0].alias("a"), name[1].alias("b")).where(F.length("a") >= 4)
    known = p.select(F.explode(F.array("a", "b")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    synonyms = p.select(F.col("b").alias("word")).distinct().select("word", F.lit("item").alias("synonym"), F.lit(1).alias("priority"))
    raw = p.select("id", F.concat("a", F.lit("x "), "b", F.lit(" lg")).alias("query"))
    got = C.enhanced(raw, known, synonyms, {"lg": "large"}, {"ring": ["jewel", "sound"]})
    hints = F.array_join(F.transform("hints", lambda h: F.concat(h["kind"], F.lit("|"), h["text"])), ";")
    return got.join(raw, "id").select("id", F.col("query").alias("raw"), "corrected", "expanded", hints.alias("hints"), F.array_join("clarification.options", ",").alias("options"))


@_query("""WITH s AS (SELECT s_suppkey AS id, s_nationkey AS n FROM supplier)
SELECT id, 'name' AS path, 'modified' AS change, '"' || s_name || '"' AS old, '"renamed"' AS new FROM s JOIN supplier ON s_suppkey = id WHERE id % 7 = 0
UNION ALL SELECT id, 'place.nation', 'removed', n::VARCHAR, NULL FROM s WHERE id % 5 = 0
UNION ALL SELECT id, 'place.detail.n', 'modified', id::VARCHAR, (id + 1)::VARCHAR FROM s WHERE id % 3 = 0
UNION ALL SELECT id, 'tags', 'modified', '[' || id || ',1]', '[' || id || ',0]' FROM s WHERE id % 2 = 0
UNION ALL SELECT id, 'note', 'added', NULL, '{"a":{"b":1}}' FROM s WHERE id % 4 = 0""")
def nested_difference(spark, sf_dir):
    i = F.col("s_suppkey")

    def value(name, nation, n, tag, note):
        place = F.struct(nation.alias("nation"), F.struct(n.alias("n"), F.lit("x").alias("same")).alias("detail"))
        return F.to_json(F.struct(name.alias("name"), place.alias("place"), F.array(i, tag.cast("long")).alias("tags"), note.alias("note")))

    note = F.struct(F.struct(F.lit(1).alias("b")).alias("a"))
    old = value(F.col("s_name"), F.col("s_nationkey"), i, F.lit(1), F.when(F.lit(False), note))
    new = value(F.when(i % 7 == 0, "renamed").otherwise(F.col("s_name")), F.when(i % 5 != 0, F.col("s_nationkey")), i + F.when(i % 3 == 0, 1).otherwise(0), i % 2, F.when(i % 4 == 0, note))
    return N.differences(load(spark, sf_dir, "supplier").select(i.alias("id"), old.alias("a"), new.alias("b")), "id", "a", "b")


@_query("""WITH RECURSIVE e AS (SELECT n_nationkey AS t, low, high, CASE WHEN low = 5 THEN '' ELSE n_name || low END AS text, CASE low WHEN 3 THEN (n_nationkey * 2 + 1) % 25 WHEN 5 THEN (n_nationkey + 5) % 25 END AS nested FROM nation, (VALUES (1, 2), (3, 4), (5, 6)) v(low, high)),
r AS (SELECT o_orderkey AS id, 0 AS depth, [o_custkey % 25] AS visited, [e.text] AS said, nested, CASE WHEN e.t IS NULL THEN 'no entry' WHEN nested IS NULL THEN NULL WHEN nested = o_custkey % 25 THEN 'cycle' END AS problem FROM orders LEFT JOIN e ON e.t = o_custkey % 25 AND o_orderkey % 7 + 1 BETWEEN low AND high
UNION ALL SELECT id, depth + 1, list_append(visited, r.nested), list_append(said, e.text), e.nested, CASE WHEN e.t IS NULL THEN 'no entry' WHEN e.nested IS NULL THEN NULL WHEN depth + 2 > 4 THEN 'depth' WHEN list_contains(list_append(visited, r.nested), e.nested) THEN 'cycle' END
FROM r LEFT JOIN e ON e.t = r.nested AND (id + (depth + 1) * 3 + r.nested) % 6 + 1 BETWEEN low AND high WHERE r.nested IS NOT NULL AND r.problem IS NULL)
SELECT id, depth, CASE WHEN problem IS NULL THEN array_to_string(list_filter(said, lambda x: x <> ''), ': ') END AS text, problem FROM r WHERE nested IS NULL OR problem IS NOT NULL""")
def table_rolls(spark, sf_dir):
    n = F.col("n_nationkey").cast("long")
    rows = [(1, 2, F.concat("n_name", F.lit("1")), F.lit(None).cast("long")), (3, 4, F.concat("n_name", F.lit("3")), (n * 2 + 1) % 25), (5, 6, F.lit(""), (n + 5) % 25)]
    entry = F.explode(F.array(*(F.struct(F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high"), t.alias("text"), m.alias("nested")) for a, b, t, m in rows)))
    entries = load(spark, sf_dir, "nation").select(n.alias("table"), entry.alias("e")).select("table", "e.*")
    rolls = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("table"), (F.col("o_orderkey") % 7 + 1).alias("roll"))
    return N.rolled(rolls, entries, lambda i, t, depth: (i + depth * 3 + t) % 6 + 1, most=4).drop("tables")


@_query("""SELECT p_partkey, 'a & b' AS quoted, lower(p_type) AS negated, (p_size % 4 + 1) / 4.0::DOUBLE AS low, (p_size % 9)::DOUBLE AS high, p_size AS level, concat_ws(',', CASE WHEN split_part(p_name, ' ', 1) IN ('red', 'blue') THEN 'color:' || split_part(p_name, ' ', 1) END, CASE WHEN p_type = 'SMALL' OR split_part(p_name, ' ', 1) = 'small' THEN 'size:small' END) AS attributes, split_part(p_name, ' ', 1) || ' things a & b' AS rest, split_part(p_name, ' ', 1) || ' things a & b' || CASE split_part(p_name, ' ', 1) WHEN 'red' THEN ' (NOT blue) (NOT green)' ELSE '' END AS expanded
FROM part""")
def query_constraints(spark, sf_dir):
    color = F.split("p_name", " ")[0]
    p = load(spark, sf_dir, "part")
    query = F.concat(color, F.lit(' things "a & b" CR '), F.col("p_size") % 4 + 1, F.lit("/4 to "), F.col("p_size") % 9, F.lit(" level "), "p_size", F.lit(" without "), "p_type")
    asked = Q.asked_for(query, {"color": ["blue", "red"], "size": ["small"]}, {"red": ["blue", "green"]})
    got = p.select("p_partkey", asked.alias("a"))
    pairs = F.array_join(F.transform("a.attributes", lambda x: F.concat(x["category"], F.lit(":"), x["value"])), ",")
    return got.select("p_partkey", F.array_join("a.quoted", ",").alias("quoted"), F.array_join("a.negated", ",").alias("negated"), "a.challenge.low", "a.challenge.high", F.col("a.level.high").alias("level"), pairs.alias("attributes"), "a.rest", "a.expanded")


@_query("SELECT p_partkey, p_name || ' ' || p_brand || ' <b> & co' AS text FROM part")
def xml_texts(spark, sf_dir):
    xml = F.concat(F.lit('<?xml version="1.0"?>\n<!DOCTYPE part>\n<part key="1">\n <name>'), "p_name", F.lit("</name><!-- <no> -->\n <brand>"), "p_brand", F.lit(" &lt;b&gt;</brand><![CDATA[& co]]></part>"))
    return load(spark, sf_dir, "part").select("p_partkey", markup.xml_text(xml).alias("text"))


@_query("SELECT conv_id * 1000 + turn AS id, 'Turn ' || turn AS subject, role || '@example.org' AS sender, coalesce(text, '') AS text FROM conversations")
def mail_texts(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("From: "), "role", F.lit("@example.org\nSubject: Turn "), "turn", F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), F.coalesce("text", F.lit("")))
    mails = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), raw.alias("raw"))
    return markup.mail_texts(mails, "id", "raw").select("id", "subject", "sender", "text")
