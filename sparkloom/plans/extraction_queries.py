"""Queries of detection, parsing, spelling and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import extraction as X
from sparkloom.operators import graph as G
from sparkloom.operators import querytext as Q
from sparkloom.operators import relational as R
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


def _hold(words: list[str], weight: str) -> str:
    return " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN {weight} ELSE 0 END" for w in words)


_SYSTEMS = {"alpha": (["thing", "heron"], ["tion", "ough"]), "beta": (["idiot", "trash"], ["eau"]), "gamma": (["ung", "keit"], ["der "])}


@_query("WITH s AS (SELECT doc_id, " + ", ".join(f"{_hold(a, '1.0')} + {_hold(b, '0.3')} AS {n}" for n, (a, b) in _SYSTEMS.items()) + """ FROM documents), b AS (SELECT *, greatest(alpha, beta, gamma) AS m FROM s)
SELECT doc_id, CASE WHEN least(m / 3.0, 1.0) < 0.3 THEN 'other' WHEN alpha = m THEN 'alpha' WHEN beta = m THEN 'beta' ELSE 'gamma' END AS label, round(least(m / 3.0, 1.0), 6)::DOUBLE AS confidence FROM b""")
def system_detection(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", X.detected(F.col("text"), _SYSTEMS).alias("d")).select("doc_id", "d.*")


@_query(r"""WITH s AS (SELECT doc_id, (CASE WHEN regexp_matches(lower(text), '\bthe\b') THEN 1.4 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '\band\b') THEN 0.5 ELSE 0 END) AS a, (CASE WHEN regexp_matches(lower(text), '\bles\b') THEN 1.3 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '\bde\b') THEN 0.4 ELSE 0 END) AS b FROM documents)
SELECT doc_id, CASE WHEN a >= b THEN 'combat' ELSE 'lore' END AS context, greatest(a, b)::DOUBLE AS score FROM s""")
def context_detection(spark, sf_dir):
    words = {"combat": {"the": 0.9, "and": 0.5}, "lore": {"les": 0.8, "de": 0.4}}
    return load(spark, sf_dir, "documents").select("doc_id", X.contexts(F.col("text"), words)[0].alias("c")).select("doc_id", "c.*")


@_query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '\b(idiot|trash|clown|scum)\b', 1))), ',') AS insults, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '\b(the|and|of)\b', 1))), ',') AS common FROM documents")
def attribute_extraction(spark, sf_dir):
    found = X.attributes(F.col("text"), {"insults": ["idiot", "trash", "clown", "scum"], "common": ["the", "and", "of"]})
    return load(spark, sf_dir, "documents").select("doc_id", found.alias("a")).select("doc_id", *(F.array_join(F.array_sort(f"a.{c}"), ",").alias(c) for c in ("insults", "common")))


@_query("SELECT p_partkey, (p_size % 12 + 10)::INT AS armor, p_size * 3 AS hits, 30 AS speed, p_size AS str, floor((p_size - 10) / 2)::BIGINT AS str_mod, (p_size % 7)::VARCHAR AS challenge FROM part")
def stat_blocks(spark, sf_dir):
    size = F.col("p_size")
    text = F.concat(F.lit("Beast\nArmor Class "), size % 12 + 10, F.lit(" (hide)\nHit Points "), size * 3, F.lit("\nSpeed 30 ft.\nSTR "), size, F.lit(" DEX 12 CON 9\nChallenge "), size % 7)
    return load(spark, sf_dir, "part").select("p_partkey", X.stat_block(text).alias("s")).select("p_partkey", "s.armor", "s.hits", "s.speed", "s.str", "s.str_mod", "s.challenge")


@_query("""SELECT n_nationkey, low::INT AS low, high::INT AS high, n_name || ' ' || low AS entry, round((high - low + 1) / 11.0, 6)::DOUBLE AS chance FROM nation, (VALUES (2, 4), (5, 5), (6, 12)) t(low, high)""")
def random_table_parser(spark, sf_dir):
    text = F.concat(F.lit("Roll 2d6\n2-4 "), "n_name", F.lit(" 2\n5. "), "n_name", F.lit(" 5\n 6 - 12) "), "n_name", F.lit(" 6\nno entry"))
    return X.table_entries(load(spark, sf_dir, "nation").withColumn("t", text), "n_nationkey", "t").withColumn("chance", F.round("chance", 6))


@_query("WITH e AS (SELECT doc_id, (generate_subscripts(p, 1) - 1)::INT AS page, unnest(p) AS part FROM (SELECT doc_id, string_split(text, '. ') AS p FROM documents)) SELECT doc_id, page, trim(part, ' ') AS part FROM e WHERE length(trim(part, ' ')) >= 50")
def marker_pages(spark, sf_dir):
    return X.pages_by_marker(load(spark, sf_dir, "documents"), "doc_id", "text", r"\. ")


@_query("""WITH known AS (SELECT p_name AS word, count(*) AS n FROM part GROUP BY 1), typed AS (SELECT DISTINCT left(p_name, 1) || substr(p_name, 3, 1) || substr(p_name, 2, 1) || substr(p_name, 4) AS word FROM part),
c AS (SELECT t.word, k.word AS best, n, damerau_levenshtein(t.word, k.word) AS d FROM typed t, known k WHERE length(t.word) >= 5 AND t.word NOT IN (SELECT word FROM known))
SELECT word, best, d::INT AS distance FROM c WHERE d <= CASE WHEN length(word) < 9 THEN 1 ELSE 2 END QUALIFY row_number() OVER (PARTITION BY word ORDER BY d, n DESC, best) = 1""")
def swap_distances(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    known = part.groupBy(F.col("p_name").alias("word")).agg(F.count("*").alias("n"))
    typed = part.select(F.concat(F.substring("p_name", 1, 1), F.substring("p_name", 3, 1), F.substring("p_name", 2, 1), F.substring("p_name", 4, 100)).alias("word"))
    return Q.corrections(typed, known, swaps=True)


@_query(None)
def boundary_scores(spark, sf_dir):
    return X.best_splits(load(spark, sf_dir, "documents"), "doc_id", "text", 800, 150)


@_query("""WITH i AS (SELECT p_brand, p_partkey, length(p_name)::BIGINT AS size, substr(p_brand, 7)::INT AS rank FROM part), k AS (SELECT *, sum(size) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT i.*, p_size FROM i JOIN part USING (p_partkey))),
s AS (SELECT p_brand, rank, sum(size) AS s FROM k WHERE r <= 60 GROUP BY 1, 2), t AS (SELECT p_brand, sum(s) OVER (ORDER BY rank, p_brand ROWS UNBOUNDED PRECEDING) AS t FROM s) SELECT k.p_brand, p_partkey FROM k JOIN t USING (p_brand) WHERE r <= 60 AND t <= 500""")
def section_budget(spark, sf_dir):
    items = load(spark, sf_dir, "part").withColumn("size", F.length("p_name").cast("long")).withColumn("rank", F.expr("cast(substring(p_brand, 7) as int)"))
    return X.section_budget(items, "p_brand", [F.desc("p_size"), F.col("p_partkey")], "size", 60, 500, "rank").select("p_brand", "p_partkey")


@_query("""SELECT user_id, arg_max(v, event_id) FILTER (v IS NOT NULL) AS v, arg_max(w, event_id) FILTER (w IS NOT NULL) AS w FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS v, CASE WHEN event_type = 'view' THEN event_type END AS w FROM events) GROUP BY 1""")
def layered_resolution(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value"))).withColumn("w", F.when(F.col("event_type") == "view", F.col("event_type")))
    return X.layered(rows, "user_id", "event_id", ["v", "w"])


@_query("SELECT user_id, round((count(*) FILTER (event_type = 'purchase') + 0.5 * count(*) FILTER (event_type = 'view')) / count(*), 6)::DOUBLE AS share FROM events GROUP BY 1")
def verification_ratio(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "verified").when(F.col("event_type") == "view", "derived").otherwise("open")
    return X.verified_share(load(spark, sf_dir, "events").withColumn("status", status), "user_id", "status").withColumn("share", F.round("share", 6))


@_query("""SELECT conv_id, '[' || string_agg('"' || role || '"', ',' ORDER BY turn) || ']' AS history FROM conversations GROUP BY 1""")
def json_append(spark, sf_dir):
    return X.appended(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@_query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) <= 6")
def capped_cards(spark, sf_dir):
    return R.top_of_each(load(spark, sf_dir, "part"), ["p_brand"], [F.col("p_size"), F.col("p_partkey")], 6).select("p_brand", "p_partkey")


@_query("""WITH p AS (SELECT conv_id, max(turn) // 2 AS upto FROM conversations GROUP BY 1) SELECT conv_id + 1000000 AS conv_id, turn, role FROM conversations JOIN p USING (conv_id) WHERE turn <= upto""")
def branch_copy(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    points = turns.groupBy("conv_id").agg(F.floor(F.max("turn") / 2).alias("upto"))
    return X.branched(turns, points, "conv_id", "turn", "upto").withColumn("conv_id", F.col("conv_id") + 1000000)


@_query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def pending_suggestions(spark, sf_dir):
    return load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")


@_query("SELECT p_brand, count(*) AS uses FROM part GROUP BY 1 HAVING uses > 9")
def overused_sources(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("uses")).where("uses > 9")


@_query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey LIMIT 80")
def session_list(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return load(spark, sf_dir, "orders").orderBy(status, F.desc("o_orderdate"), "o_orderkey").limit(80).select("o_orderkey", "o_orderstatus")


@_query(None)
def names(spark, sf_dir):
    key = F.col("c_custkey")
    first, last = G.picked(key, ["Ada", "Bran", "Cora", "Dain"], "first"), G.picked(key, ["Ash", "Brook", "Crag"], "last")
    return load(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", first, last).alias("name"))


@_query("""WITH t AS (SELECT n_nationkey AS g, n_nationkey % 5 AS sub, n_name FROM nation) SELECT o_orderkey, a.n_name || ': ' || b.n_name AS result FROM orders JOIN t a ON a.g = o_custkey % 25 JOIN t b ON b.g = a.sub""")
def nested_roll(spark, sf_dir):
    table = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("g"), (F.col("n_nationkey") % 5).cast("long").alias("sub"), "n_name", F.col("n_nationkey").cast("long").alias("low"), F.col("n_nationkey").cast("long").alias("high"))
    rolls = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("g"), (F.col("o_custkey") % 25).alias("roll"))
    outer = R.looked_up(rolls, "roll", table, "low", "high", "g", 10).select("o_orderkey", F.col("n_name").alias("outer_name"), F.col("sub").alias("g"), F.col("sub").alias("roll"))
    return R.looked_up(outer, "roll", table.drop("sub"), "low", "high", "g", 10).select("o_orderkey", F.concat_ws(": ", "outer_name", "n_name").alias("result"))
