"""Queries of documents, graphs and state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import documents as D
from sparkloom.operators import graph as G
from sparkloom.operators import ingest as I
from sparkloom.sources.tables import load
from sparkloom.sources.versioned import Store
from sparkloom.streaming import stateful as S

QUERIES = {}
ORACLE_SQL = {}


def _query(sql: str | None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


@_query(r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM b""")
def page_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", D.page_text(F.col("html")).alias("text"))


@_query("SELECT page_id, nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '') AS title FROM pages")
def page_title(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", D.page_title(F.col("html")).alias("title"))


@_query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages""")
def page_links(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.explode(D.page_links(F.col("html"))).alias("link"))


def _sentences_sql(text: str) -> str:
    """The sentences of a text in SQL: every cut is marked, then the marks behind abbreviations and single capitals go."""
    short = "|".join(a.replace(".", r"\.") for a in D.ABBREVIATIONS)
    marked = rf"regexp_replace({text}, '([.!?])([\s\x0B]+)', '\1' || chr(1) || '\2', 'g')"
    marked = rf"regexp_replace({marked}, '({short})\.\x01', '\1.', 'g')"
    marked = rf"regexp_replace({marked}, '(^|[\s\x0B])(\p{{Lu}})\.\x01', '\1\2.', 'g')"
    return rf"list_filter(list_transform(string_split_regex({marked}, '\x01[\s\x0B]+'), lambda x: trim(x)), lambda x: x != '')"


@_query(f"""WITH RECURSIVE s AS (SELECT doc_id, {_sentences_sql("text")} AS s FROM documents), e AS MATERIALIZED (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS piece FROM s),
w AS (SELECT doc_id, i, 0 AS number, piece AS chunk FROM e WHERE i = 1
UNION ALL SELECT doc_id, e.i, CASE WHEN length(chunk) + 1 + length(piece) <= 1200 THEN number ELSE number + 1 END, CASE WHEN length(chunk) + 1 + length(piece) <= 1200 THEN chunk || ' ' || piece ELSE piece END FROM w JOIN e USING (doc_id) WHERE e.i = w.i + 1)
SELECT doc_id, number, arg_max(chunk, i) AS chunk FROM w GROUP BY ALL""")
def chunk_documents(spark, sf_dir):
    return D.packed_sentences(load(spark, sf_dir, "documents"), "doc_id", "text", 1200)


def _end_sql(start: str) -> str:
    """Where the chunk from ``start`` ends, in SQL: behind the last mark of the best kind in its second half."""
    half = f"substr(text, {start} + 501, 500)"
    marks = " ".join(f"WHEN contains({half}, {mark}) THEN {start} + 500 + length(regexp_extract({half}, '(?s)^(.*)' || {pattern}, 1)) + {width}" for mark, pattern, width in (("chr(10) || chr(10)", "chr(10) || chr(10)", 2), ("'. '", r"'\. '", 2), ("' '", "' '", 1)))
    return f"CASE WHEN length(text) - ({start}) <= 1200 THEN length(text) {marks} ELSE {start} + 1000 END"


@_query(f"""WITH RECURSIVE w AS (SELECT doc_id, text, 0 AS number, 0 AS start, {_end_sql("0")} AS stop FROM documents WHERE text != ''
UNION ALL SELECT doc_id, text, number + 1, low, {_end_sql("low")} FROM (SELECT doc_id, text, number, greatest(stop - 100, start + 1) AS low FROM w WHERE stop < length(text)))
SELECT doc_id AS key, number, start, stop::INT AS "end", substr(text, start + 1, (stop - start)::INT) AS chunk FROM w""")
def overlapping_chunks(spark, sf_dir):
    return D.overlapping_chunks(load(spark, sf_dir, "documents"), "doc_id", "text")


@_query(r"WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM documents) SELECT doc_id, count(*) AS lines, count(*) FILTER (octet_length(encode(line)) <= 100 AND NOT regexp_matches(line, '[.,;]$') AND ((upper(line) = line AND regexp_matches(line, '\p{L}')) OR regexp_matches(lower(line), '^(chapter|section|part|appendix)'))) AS headers FROM l GROUP BY 1")
def header_lines(spark, sf_dir):
    lines = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(D.is_header(F.col("line"))).alias("headers"))


@_query("""WITH h AS (SELECT doc_id, contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT AS en, contains(lower(text), 'eau')::INT + contains(lower(text), ' les ')::INT AS fr, contains(lower(text), 'ung')::INT + contains(lower(text), ' der ')::INT AS de FROM documents)
SELECT doc_id, CASE WHEN greatest(en, fr, de) < 1 THEN 'other' WHEN de = greatest(en, fr, de) THEN 'de' WHEN en = greatest(en, fr, de) THEN 'en' ELSE 'fr' END AS label FROM h""")
def vocabulary_label(spark, sf_dir):
    t = F.col("text")
    scores = {"en": D.hits(t, ["the", "and"]), "fr": D.hits(t, ["eau", " les "]), "de": D.hits(t, ["ung", " der "])}
    return load(spark, sf_dir, "documents").select("doc_id", D.best_label(scores, 1, "other").alias("label"))


_RULES = "SELECT l_orderkey AS k, 'Roll ' || l_linenumber || 'd' || (l_quantity::INT + 1) || '+' || (l_partkey % 9) || ' against DC ' || (l_suppkey % 40) || ' on page ' || (l_partkey % 300) || ', see table ' || l_linenumber || '-2. You must not fail.' AS t FROM lineitem"


def _rules(spark, sf_dir):
    i = load(spark, sf_dir, "lineitem")
    return i.select(F.col("l_orderkey").alias("k"), F.concat(F.lit("Roll "), "l_linenumber", F.lit("d"), (F.col("l_quantity").cast("int") + 1), F.lit("+"), F.col("l_partkey") % 9, F.lit(" against DC "), F.col("l_suppkey") % 40, F.lit(" on page "), F.col("l_partkey") % 300, F.lit(", see table "), "l_linenumber", F.lit("-2. You must not fail.")).alias("t"))


@_query(f"""WITH r AS ({_RULES}), e AS (SELECT k, unnest(regexp_extract_all(t, '\\b(\\d*d\\d+(?:\\s*[+-]\\s*\\d+)?)', 1)) AS notation FROM r),
d AS (SELECT *, regexp_extract(notation, '^(\\d*)d(\\d+)', 1)::INT AS n, regexp_extract(notation, '^(\\d*)d(\\d+)', 2)::INT AS s, regexp_extract(notation, '\\+(\\d+)$', 1)::INT AS m FROM e)
SELECT k, notation, n + m AS least, n * s + m AS most, n * (s + 1) / 2 + m AS average FROM d""")
def dice_extraction(spark, sf_dir):
    return D.dice_rows(_rules(spark, sf_dir), "k", "t").select("k", "notation", "d.least", "d.most", "d.average")


@_query(f"WITH r AS ({_RULES}) SELECT k, 'page' AS kind, regexp_extract(t, 'page (\\d+)', 1) AS target FROM r UNION ALL SELECT k, 'table', regexp_extract(t, 'table (\\d+-\\d+)', 1) FROM r")
def cross_references(spark, sf_dir):
    return _rules(spark, sf_dir).select("k", F.explode(D.cross_references(F.col("t"))).alias("r")).select("k", "r.kind", "r.target")


@_query(f"WITH r AS ({_RULES}) SELECT k, regexp_extract(t, 'DC (\\d+)', 1)::INT AS dc, CASE WHEN dc >= 30 THEN 'legendary' WHEN dc >= 25 THEN 'nearly impossible' WHEN dc >= 20 THEN 'very hard' WHEN dc >= 15 THEN 'hard' WHEN dc >= 10 THEN 'medium' WHEN dc >= 5 THEN 'easy' ELSE 'trivial' END AS tier FROM r")
def difficulty_tiers(spark, sf_dir):
    dc = F.regexp_extract("t", r"DC (\d+)", 1).cast("int")
    return _rules(spark, sf_dir).select("k", dc.alias("dc"), T.difficulty_tier(dc).alias("tier"))


@_query(f"WITH r AS ({_RULES}) SELECT k, round(least(0.3 + 0.1 * len(regexp_extract_all(t, '[0-9]+d[0-9]+')), 0.5) + least(0.2 + 0.1 * len(regexp_extract_all(t, 'DC [0-9]+')), 0.4) + least(0.1 + 0.05 * len(regexp_extract_all(t, 'must')), 0.4), 4) AS crunch FROM r")
def content_mode(spark, sf_dir):
    return _rules(spark, sf_dir).select("k", F.round(D.crunch(F.col("t")), 4).alias("crunch"))


@_query("SELECT doc_id, number, len(list_filter(string_split(line, '|'), lambda c: trim(c) <> ''))::INT AS cells FROM (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS number, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE contains(line, '|')")
def table_cells(spark, sf_dir):
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("number", "line"))
    return lines.where(F.col("line").contains("|")).select("doc_id", "number", F.size(D.table_cells(F.col("line"))).alias("cells"))


@_query("SELECT p_partkey, '[Section: ' || p_brand || '] [Type: ' || p_type || '] ' || p_name AS text FROM part")
def embedding_text(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", D.embedding_text(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("text"))


@_query("""WITH b AS (SELECT p_brand AS page, p_partkey, (p_size // 10) * 100 + p_size % 3 AS x, p_retailprice AS y FROM part), o AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY page ORDER BY x, y, p_partkey) > 50 THEN 1 ELSE 0 END AS o FROM b),
c AS (SELECT *, sum(o) OVER (PARTITION BY page ORDER BY x, y, p_partkey ROWS UNBOUNDED PRECEDING) AS col FROM o) SELECT page, p_partkey, col::BIGINT AS "column", row_number() OVER (PARTITION BY page ORDER BY col, y, x, p_partkey)::INT AS place FROM c""")
def column_order(spark, sf_dir):
    blocks = load(spark, sf_dir, "part").select(F.col("p_brand").alias("page"), "p_partkey", (F.floor(F.col("p_size") / 10) * 100 + F.col("p_size") % 3).alias("x"), F.col("p_retailprice").alias("y"))
    return D.ordered_columns(blocks, "page", "x", "y", "p_partkey", 50).select("page", "p_partkey", "column", "place")


_EDGES = "edges AS (SELECT DISTINCT l_suppkey AS src, 100000 + l_partkey AS dst FROM lineitem)"


def _edges(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 100000).alias("dst")).distinct()


@_query(f"WITH {_EDGES}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) SELECT id, degree, degree > 2 * avg(degree) OVER () AS hub FROM d")
def degree_hubs(spark, sf_dir):
    return G.degrees(_edges(spark, sf_dir))


@_query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), w AS (SELECT 7::BIGINT AS id, 0 AS hops UNION SELECT b.dst, hops + 1 FROM w JOIN b ON b.src = w.id WHERE hops < 2),
n AS (SELECT id, min(hops) AS hops FROM w GROUP BY 1) SELECT id, hops FROM n""")
def ego_graph(spark, sf_dir):
    return G.within(_edges(spark, sf_dir), 7, 2)


@_query(f"WITH {_EDGES}, n AS (SELECT 7 AS id UNION SELECT dst FROM edges WHERE src = 7) SELECT src, dst FROM edges WHERE src IN (FROM n) AND dst IN (FROM n)")
def induced_graph(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return G.induced(e, G.within(e, 7, 1)).select("src", "dst")


@_query("SELECT s_suppkey AS src, s_nationkey AS dst, 'in' AS kind FROM supplier UNION ALL SELECT s_nationkey, s_suppkey, 'holds' FROM supplier")
def inverse_edges(spark, sf_dir):
    e = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst"), F.lit("in").alias("kind"))
    return G.with_inverses(e, {"in": "holds"})


_TREE = "t AS (SELECT p_partkey AS id, CASE WHEN p_partkey = 5 THEN 40 WHEN p_partkey > 0 THEN p_partkey // 3 END AS parent, p_size FROM part)"


def _tree(spark, sf_dir):
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(k.alias("id"), F.when(k == 5, 40).when(k > 0, F.floor(k / 3)).alias("parent"), "p_size")


@_query(f"""WITH RECURSIVE {_TREE}, w AS (SELECT id, [id] AS path, parent AS next, NULL::VARCHAR AS problem FROM t
UNION ALL SELECT w.id, CASE WHEN list_contains(path, next) THEN path ELSE list_prepend(next, path) END, CASE WHEN NOT list_contains(path, next) THEN t.parent END, CASE WHEN list_contains(path, next) THEN 'cycle' END FROM w JOIN t ON t.id = w.next WHERE w.next IS NOT NULL)
SELECT id, array_to_string(path, '>') AS path, problem FROM w WHERE next IS NULL""")
def inheritance_chain(spark, sf_dir):
    return G.chains(_tree(spark, sf_dir), "id", "parent", None).select("id", F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"), "problem")


@_query(f"""WITH RECURSIVE {_TREE}, w AS (SELECT id AS node, id, 0 AS d FROM t UNION ALL SELECT node, parent, d + 1 FROM w JOIN t USING (id) WHERE parent IS NOT NULL)
SELECT node AS id, 'k' || (p_size % 4) AS name, arg_min(p_size, d) AS value FROM w JOIN t USING (id) GROUP BY 1, 2""")
def inherited_traits(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    paths = G.chains(tree, "id", "parent", None).where("problem is null")
    traits = tree.select("id", F.concat(F.lit("k"), F.col("p_size") % 4).alias("name"), F.col("p_size").alias("value"))
    return G.inherited(paths, traits, "name", "value")


@_query("SELECT c_mktsegment, round(sum(c_nationkey * c_acctbal) / sum(c_nationkey), 4) AS c_acctbal FROM customer GROUP BY 1")
def weighted_blend(spark, sf_dir):
    return G.blended(load(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey", ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 4))


@_query("""SELECT user_id, list_reduce(list_prepend(50.0::DOUBLE, list((CASE WHEN event_type = 'error' THEN -value ELSE value / 4 END)::DOUBLE ORDER BY event_id)), lambda a, c: greatest(least(a + c, 100.0), -100.0)) AS final_raw FROM events GROUP BY 1""".replace("AS final_raw", "AS f").join(["SELECT user_id, round(f, 4) AS final, n FROM (", ") JOIN (SELECT user_id, count(*)::INT AS n FROM events GROUP BY 1) USING (user_id)"]))
def clamped_fold(spark, sf_dir):
    change = F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value") / 4)
    return G.clamped_fold(load(spark, sf_dir, "events").withColumn("c", change), "user_id", "event_id", "c", 50, -100, 100).withColumn("final", F.round("final", 4))


@_query("SELECT l_orderkey, l_linenumber, l_quantity - 10 AS l_quantity FROM lineitem WHERE l_quantity > 10")
def condition_ticks(spark, sf_dir):
    return G.ticked(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 10)


@_query("""WITH c AS (SELECT user_id AS who, event_type AS kind, CASE event_type WHEN 'click' THEN 'latest' WHEN 'view' THEN 'extend' WHEN 'error' THEN 'source' ELSE 'highest' END AS rule, trunc(value)::INT AS rest, event_id % 3 AS src, event_id FROM events)
SELECT who, kind, (CASE rule WHEN 'latest' THEN arg_max(rest, event_id) WHEN 'extend' THEN sum(rest) ELSE max(rest) END)::BIGINT AS remaining, CASE WHEN rule = 'source' THEN count(DISTINCT src) ELSE 1 END AS n FROM c GROUP BY who, kind, rule""")
def condition_stacking(spark, sf_dir):
    kind = F.col("event_type")
    rule = F.when(kind == "click", "latest").when(kind == "view", "extend").when(kind == "error", "source").otherwise("highest")
    c = load(spark, sf_dir, "events").select(F.col("user_id").alias("who"), kind.alias("kind"), rule.alias("rule"), F.col("value").cast("int").alias("rest"), (F.col("event_id") % 3).alias("src"), "event_id")
    return G.stacked(c, "who", "kind", "rule", "rest", "src", "event_id")


@_query("SELECT o_custkey, o_orderkey, row_number() OVER w AS version, nullif(row_number() OVER w - 1, 0) AS parent, sha256(o_orderpriority) AS hash FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def snapshot_versions(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return G.versions(rows, "o_custkey", "o_orderkey", "o_orderpriority").drop("o_orderpriority")


@_query("""WITH w AS (SELECT p_partkey, (1000 + p_partkey % 50) * 360 + (p_size % 12) * 30 + p_partkey % 30 + p_size * 11 - 200 AS d FROM part) SELECT p_partkey, d // 360 AS year, (d // 30) % 12 + 1 AS month, d % 30 + 1 AS day FROM w""")
def game_dates(spark, sf_dir):
    d = T.date_plus(1000 + F.col("p_partkey") % 50, F.col("p_size") % 12 + 1, F.col("p_partkey") % 30 + 1, F.col("p_size") * 11 - 200)
    return load(spark, sf_dir, "part").select("p_partkey", d.alias("d")).select("p_partkey", "d.*")


@_query("SELECT date_trunc('hour', ts) AS hour, round(sum(value), 4) AS cost, count(*) AS n FROM events GROUP BY 1")
def hourly_buckets(spark, sf_dir):
    return S.hourly(load(spark, sf_dir, "events"), "ts", "value").withColumn("cost", F.round("cost", 4))


@_query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS o FROM events), s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf_dir):
    return S.sessions(load(spark, sf_dir, "events"), "user_id", "ts", "6 hours")


@_query("""WITH RECURSIVE w AS (SELECT event_type, min(ts) AS ts FROM events GROUP BY 1 UNION ALL
SELECT w.event_type, min(e.ts) FROM w JOIN events e ON e.event_type = w.event_type AND e.ts >= w.ts + INTERVAL 1 HOUR GROUP BY w.event_type) SELECT event_type, ts FROM w""")
def alerts_once(spark, sf_dir):
    return S.alerts_once(load(spark, sf_dir, "events"), "event_type", "ts", 3600)


@_query("SELECT user_id, round(list_reduce(list_prepend(50.0::DOUBLE, list(value ORDER BY event_id)), lambda a, v: a * 0.9 + v * 0.1), 6) AS average FROM events GROUP BY 1")
def latency_average(spark, sf_dir):
    return S.moving_average(load(spark, sf_dir, "events"), "user_id", "event_id", "value", 0.9, 50).withColumn("average", F.round("average", 6))


@_query("""SELECT event_id, count(*) FILTER (value > 60) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS open FROM events""")
def circuit_breaker(spark, sf_dir):
    return S.breaker_states(load(spark, sf_dir, "events"), "user_id", "event_id", F.col("value") <= 60).select("event_id", "open")


@_query("SELECT event_id, CASE WHEN value >= 100 THEN 'critical' WHEN value >= 50 THEN 'info' WHEN value >= 90 THEN 'warning' END AS alert FROM events")
def budget_alerts(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", S.budget_alert(F.col("value"), [50, 90]).alias("alert"))


@_query("SELECT CASE WHEN user_id % 7 >= 5 THEN 'failed' WHEN ts <= TIMESTAMP '2024-01-15' THEN 'ready' ELSE 'waiting' END AS status, count(*) AS n FROM events GROUP BY 1")
def retry_queue(spark, sf_dir):
    return S.queue_counts(load(spark, sf_dir, "events").withColumn("tries", F.col("user_id") % 7), "tries", "ts", F.lit("2024-01-15").cast("timestamp_ntz"))


@_query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'stat block' WHEN 1 THEN 'random table' WHEN 2 THEN 'spell' WHEN 3 THEN 'sidebar' ELSE 'generic' END AS kind FROM part")
def element_kinds(spark, sf_dir):
    block = F.concat(F.lit("Beast\nArmor Class 12\nHit Points "), "p_size", F.lit("\nSpeed 30\nSTR 10 DEX 9 CON 8"))
    table = F.concat("p_name", F.lit(" 1d6\n1 a\n2-3 b\n4. c\n5-6 d"))
    spell = F.concat("p_name", F.lit("\nCasting Time: 1 action\nRange: 60 feet\nDuration: 1 hour"))
    text = F.element_at(F.array(block, table, spell, F.concat(F.lit("Note: "), "p_name"), F.col("p_name")), (F.col("p_partkey") % 5).cast("int") + 1)
    return load(spark, sf_dir, "part").select("p_partkey", D.element_kind(text).alias("kind"))


@_query(f"""WITH RECURSIVE p AS (SELECT conv_id, turn, coalesce(role = 'system', true) AS alone, CASE WHEN role = 'system' AND length(text) <= 1600 THEN [text] ELSE {_sentences_sql("text")} END AS s FROM conversations), k AS (SELECT conv_id, turn, alone, generate_subscripts(s, 1) AS k, unnest(s) AS piece FROM p),
e AS MATERIALIZED (SELECT conv_id, alone, piece, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k, alone, piece) AS i FROM k),
w AS (SELECT conv_id, i, alone, 0 AS number, piece AS chunk FROM e WHERE i = 1
UNION ALL SELECT conv_id, j, other, CASE WHEN fits THEN number ELSE number + 1 END, CASE WHEN fits THEN chunk || chr(10) || piece ELSE piece END FROM (SELECT conv_id, number, chunk, e.i AS j, e.alone AS other, piece, NOT w.alone AND NOT e.alone AND length(chunk) + 1 + length(piece) <= 800 AS fits FROM w JOIN e USING (conv_id) WHERE e.i = w.i + 1))
SELECT conv_id, number AS chunk_number, arg_max(chunk, i) AS chunk FROM w GROUP BY ALL""")
def element_chunks(spark, sf_dir):
    return D.packed_elements(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text", F.col("role") == "system", 800)


def _pages(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return load(spark, sf_dir, "documents").select(F.col("source").alias("item_id"), place.alias("page"), "lang", "text")


@_query(None)
def page_chunks(spark, sf_dir):
    """Documents of a source as the pages of one item, in chunks across page ends; tested against a plain version."""
    pages = _pages(spark, sf_dir).withColumn("raw_id", F.concat_ws("-p", "item_id", F.col("page").cast("string")))
    return I.page_chunks(pages).select("item_id", "chunk_index", F.md5("content").alias("hash"), "source_ids", "page_start", "page_end")


@_query("""WITH p AS (SELECT source AS item_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, lang, text FROM documents)
SELECT item_id, count(*) AS pages, 'ready' AS status, sum(length(CASE WHEN lang = 'fr' THEN 'again: ' || text ELSE text END))::BIGINT AS chars, count(*) FILTER (lang = 'fr' AND text IS NOT NULL) AS changed, 0::BIGINT AS without_chunk FROM p GROUP BY 1""")
def two_phase_ingest(spark, sf_dir):
    """Pages ingested, then once more with the texts of one language changed: what the store has, how many raw rows the second run wrote, and how many pages no chunk names."""
    store = Store(spark, {"raw": ["item_id", "page"], "chunks": ["item_id", "chunk_index"], "items": ["item_id"]})
    pages = _pages(spark, sf_dir)
    sizes = I.Sizes(least=0)
    I.ingest_pages(store, pages.drop("lang"), sizes)
    before = store.read("raw").select("item_id", "page", F.col("hash").alias("was"))
    I.ingest_pages(store, pages.withColumn("text", F.when(F.col("lang") == "fr", F.concat(F.lit("again: "), "text")).otherwise(F.col("text"))).drop("lang"), sizes)
    # The joins need no text, so none is shuffled for them.
    raw = store.read("raw").select("item_id", "page", "raw_id", "hash", F.length("text").alias("length"), (F.trim("text") != "").alias("filled")).join(before, ["item_id", "page"])
    cited = store.read("chunks").select(F.explode("source_ids").alias("raw_id")).distinct().withColumn("cited", F.lit(True))
    rows = raw.join(cited, "raw_id", "left").groupBy("item_id").agg(F.sum("length").alias("chars"), F.count_if(F.col("hash") != F.col("was")).alias("changed"), F.count_if(F.col("cited").isNull() & F.col("filled")).alias("without_chunk"))
    return store.read("items").join(rows, "item_id").select("item_id", "pages", "status", "chars", "changed", "without_chunk")


@_query(None)
def section_chunks(spark, sf_dir):
    """Lines of documents as elements: headings give chunks their path, lists are atomic; tested against a plain version."""
    lines = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.posexplode(F.split("text", "\n")).alias("place", "text"))
    atomic = F.col("text").rlike(r"^\s*(?:[-*]|\d+[.)])\s")
    elements = lines.select("item_id", "place", F.lit(1).alias("page"), "text", D.is_header(F.col("text")).alias("header"), F.when(atomic, "list").otherwise("text").alias("kind"), atomic.alias("atomic"))
    return I.section_chunks(elements, I.Sizes.small()).select("item_id", "chunk_index", "kind", F.array_join("section_path", " > ").alias("path"), F.md5("content").alias("hash"))


@_query("""SELECT user_id AS who, event_id, CASE WHEN event_type = 'error' THEN 'damage' WHEN event_type = 'purchase' THEN 'temporary' ELSE 'heal' END AS kind, value AS amount FROM events""".join(["""WITH e AS (""", """), n AS (SELECT who, event_id, kind, amount, row_number() OVER (PARTITION BY who ORDER BY event_id) AS k FROM e),
l AS (SELECT who, list({'i': event_id, 'k': kind, 'a': amount::DOUBLE, 'h': 100.0::DOUBLE, 't': 0.0::DOUBLE} ORDER BY event_id) AS l FROM n GROUP BY 1),
r AS (SELECT who, list_reduce(l, lambda s, x: {'i': x.i, 'k': x.k, 'a': x.a, 'h': CASE x.k WHEN 'damage' THEN greatest(s.h - greatest(x.a - s.t, 0), 0) WHEN 'heal' THEN least(s.h + x.a, 100) ELSE s.h END,
't': CASE x.k WHEN 'damage' THEN greatest(s.t - x.a, 0) WHEN 'temporary' THEN greatest(s.t, x.a) ELSE s.t END}, {'i': 0::BIGINT, 'k': '', 'a': 0.0::DOUBLE, 'h': 100.0::DOUBLE, 't': 0.0::DOUBLE}) AS s FROM l)
SELECT who, s.i AS event_id, round(s.h, 4) AS hit_points, round(s.t, 4) AS temporary FROM r"""]))
def hit_points(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "damage").when(F.col("event_type") == "purchase", "temporary").otherwise("heal")
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("who"), "event_id", kind.alias("kind"), F.col("value").alias("amount"))
    after = G.health(rows, "who", "event_id", "kind", "amount", 100)
    last = after.groupBy("who").agg(F.max_by(F.struct("event_id", "hit_points", "temporary"), "event_id").alias("s"))
    return last.select("who", "s.event_id", F.round("s.hit_points", 4).alias("hit_points"), F.round("s.temporary", 4).alias("temporary"))
