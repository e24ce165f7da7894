"""Queries of filters, joins, windows, pages and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import relational as R
from sparkloom.sources import sinks
from sparkloom.sources.tables import load

QUERIES = {}
ORACLE_SQL = {}


def _query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_lookup(spark, sf_dir):
    return load(spark, sf_dir, "customer").where("c_custkey = 42").select("c_custkey", "c_name")


@_query("SELECT p_partkey, p_name, p_size FROM part WHERE p_type = 'ECONOMY' AND p_size >= 5 AND p_size <= 20")
def composable_filter(spark, sf_dir):
    wanted = R.all_of(F.col("p_type") == "ECONOMY", None, F.col("p_size") >= 5, F.col("p_size") <= 20)
    return load(spark, sf_dir, "part").where(wanted).select("p_partkey", "p_name", "p_size")


@_query("SELECT p_partkey, p_brand, p_type, p_size FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_type NOT IN ('PROMO') AND p_size BETWEEN 3 AND 30 AND p_partkey = 15 OR p_brand IN ('Brand#4') AND p_type NOT IN ('ECONOMY') AND p_size = 7")
def attribute_filter(spark, sf_dir):
    a = R.constraint({"p_brand": ["Brand#1", "Brand#2", "Brand#3"]}, {"p_type": ["PROMO"]}, {"p_size": (3, 30), "p_partkey": (15, 15)})
    b = R.constraint({"p_brand": ["Brand#4"]}, {"p_type": ["ECONOMY"]}, {"p_size": (7, 7)})
    return load(spark, sf_dir, "part").where(R.any_of(a, b)).select("p_partkey", "p_brand", "p_type", "p_size")


@_query("SELECT p_partkey, p_retailprice, p_name FROM part WHERE p_retailprice BETWEEN 950 AND 1000 ORDER BY p_retailprice, p_name")
def range_predicate(spark, sf_dir):
    return load(spark, sf_dir, "part").where(F.col("p_retailprice").between(950, 1000)).orderBy("p_retailprice", "p_name").select("p_partkey", "p_retailprice", "p_name")


@_query(r"SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%#00000%7%' ESCAPE '\' ORDER BY c_name LIMIT 100")
def name_like(spark, sf_dir):
    return load(spark, sf_dir, "customer").where(F.col("c_name").like("%#00000%7%")).orderBy("c_name").limit(100).select("c_custkey", "c_name")


@_query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 1")
def null_or_equal(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.where(R.null_or_equal("quality", 1)).select("doc_id", "quality")


_EDGES = "edges AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, l_quantity > 25 AS both_ways FROM lineitem)"


def edges(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_quantity") > 25).alias("both_ways")).distinct()


@_query(f"WITH {_EDGES} SELECT * FROM edges WHERE src = 7 OR (both_ways AND dst = 7)")
def disjunctive_endpoints(spark, sf_dir):
    return edges(spark, sf_dir).where(R.touching(7, "src", "dst", F.col("both_ways")))


@_query("SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name || ' ' || p_type, ' '), lambda t: contains(lower(t), 'prom') OR contains(lower(t), 'ring'))) > 0")
def tag_search(spark, sf_dir):
    tags = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    return load(spark, sf_dir, "part").where(R.contains_any(tags, "PROM") | R.contains_any(tags, "ring")).select("p_partkey")


@_query("SELECT n_name, s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 ORDER BY s_name")
def inner_join_attr(spark, sf_dir):
    nation = load(spark, sf_dir, "nation").where("n_regionkey = 2")
    return load(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).orderBy("s_name").select("n_name", "s_suppkey", "s_name")


@_query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def correlated_count(spark, sf_dir):
    counted = R.counted_children(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", load(spark, sf_dir, "orders"), "o_custkey", "orders")
    return R.page(counted, [F.col("c_custkey")], 100, 50)


@_query(f"WITH {_EDGES} SELECT s_name, p_name, both_ways FROM edges JOIN supplier ON s_suppkey = src JOIN part ON p_partkey = dst")
def edge_nodes(spark, sf_dir):
    s, p = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "part")
    return edges(spark, sf_dir).join(s, F.col("s_suppkey") == F.col("src")).join(p, F.col("p_partkey") == F.col("dst")).select("s_name", "p_name", "both_ways")


@_query("""WITH t AS (SELECT n_nationkey AS g, r * 10 AS low, r * 10 + 7 + n_nationkey % 5 AS high, n_name || '-' || r AS entry FROM nation, range(0, 10) x(r)),
r AS (SELECT o_orderkey, o_custkey % 25 AS g, (o_orderkey * 7) % 100 AS roll FROM orders)
SELECT o_orderkey, roll, arg_min(entry, low) AS entry FROM r JOIN t ON r.g = t.g AND roll BETWEEN low AND high GROUP BY ALL""")
def range_join(spark, sf_dir):
    table = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("g"), "n_name", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("r"))
    table = table.select("g", (F.col("r") * 10).alias("low"), (F.col("r") * 10 + 7 + F.col("g") % 5).alias("high"), F.concat_ws("-", "n_name", "r").alias("entry"))
    rolls = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("g"), ((F.col("o_orderkey") * 7) % 100).alias("roll"))
    return R.looked_up(rolls, "roll", table, "low", "high", "g", 10).select("o_orderkey", "roll", "entry")


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'N')")
def semi_all_prereqs(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem")
    needs = items.select(F.col("l_orderkey").alias("o_orderkey"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").alias("need"))
    met = needs.where(F.col("need").endswith("-N"))
    return R.with_all_met(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", needs, "need", met)


@_query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def anti_unused(spark, sf_dir):
    used = load(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return sinks.without_keys(load(spark, sf_dir, "part").select("p_partkey"), used, ["p_partkey"])


@_query("""WITH n AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey > 4 THEN n_nationkey % 5 END AS parent, n_name FROM nation)
SELECT p.n_name AS parent, c.n_name AS child FROM n c LEFT JOIN n p ON c.parent = p.id""")
def self_join(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") > 4, F.col("n_nationkey") % 5).alias("parent"), "n_name")
    return n.alias("c").join(n.alias("p"), F.col("c.parent") == F.col("p.id"), "left").select(F.col("p.n_name").alias("parent"), F.col("c.n_name").alias("child"))


@_query("SELECT o_orderkey, s_name FROM (SELECT l_orderkey AS o_orderkey, unnest(list_distinct(list(l_suppkey + 0))) AS k FROM lineitem GROUP BY 1) JOIN supplier ON s_suppkey = k AND s_acctbal > 0")
def id_list_dereference(spark, sf_dir):
    lists = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("ids"))
    return R.dereferenced(lists, "ids", load(spark, sf_dir, "supplier").where("s_acctbal > 0"), "s_suppkey").select("o_orderkey", "s_name")


@_query("""SELECT c_custkey, c_name, n_name, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) ON o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey AS k, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON k = c_custkey""")
def context_gather(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = R.counted_children(rows, "c_custkey", orders, "o_custkey", "orders")
    return R.counted_children(rows, "c_custkey", lines, "o_custkey", "lines").select("c_custkey", "c_name", "n_name", "orders", "lines")


@_query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_mktsegment DESC, c_custkey) AS turn FROM customer")
def initiative_order(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), F.desc("c_mktsegment"), "c_custkey")
    return load(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.row_number().over(w).alias("turn"))


@_query("""WITH t AS (SELECT l_orderkey AS g, l_linenumber * 10 AS low, l_linenumber * 10 + l_quantity::INT % 15 AS high FROM lineitem),
b AS (SELECT *, max(high) OVER (PARTITION BY g ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM t)
SELECT g, low, high, CASE WHEN low > e + 1 THEN 'gap' WHEN low <= e THEN 'overlap' END AS issue FROM b""")
def range_gaps(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_linenumber") * 10).alias("low"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 15).alias("high"))
    return R.gaps(t, "g", "low", "high")


@_query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations""")
def carry_forward(spark, sf_dir):
    return R.carried_forward(load(spark, sf_dir, "conversations"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "asked").select("conv_id", "turn", "asked")


@_query("""WITH r AS (SELECT conv_id, turn, length(text) AS n, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations)
SELECT conv_id, run::BIGINT AS run, min(turn) AS first, count(*) AS n, sum(n)::BIGINT AS total FROM r GROUP BY 1, 2""")
def continuation_merge(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").withColumn("size", F.length("text"))
    return R.merged_runs(rows, "conv_id", "turn", F.col("role") == "user", "size")


@_query("""WITH w AS (SELECT event_id, list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM events)
SELECT event_id, (SELECT x FROM (SELECT unnest(l) AS x) GROUP BY x ORDER BY count(*) DESC, x LIMIT 1) AS smooth FROM w""")
def label_smoothing(spark, sf_dir):
    return R.smoothed(load(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("event_id", "smooth")


@_query("""SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER w) / (max(p_retailprice) OVER w - min(p_retailprice) OVER w), 6) AS min_max,
round((p_retailprice - avg(p_retailprice) OVER w) / stddev_pop(p_retailprice) OVER w, 6) AS z_score FROM part WINDOW w AS (PARTITION BY p_brand)""")
def score_normalise(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return part.select("p_partkey", *(F.round(R.normalised(part, "p_retailprice", m, ["p_brand"]), 6).alias(m) for m in ("min_max", "z_score")))


@_query("""SELECT p_type, p_partkey, round(greatest(1 - 0.1 * (rank - 1), 0.1), 4) AS score FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 12""")
def positional_score(spark, sf_dir):
    top = R.top_of_each(load(spark, sf_dir, "part"), ["p_type"], [F.desc("p_retailprice"), F.col("p_partkey")], 12)
    return top.select("p_type", "p_partkey", F.round(F.greatest(1 - 0.1 * (F.col("rank") - 1), F.lit(0.1)), 4).alias("score"))


@_query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 4 ORDER BY p_retailprice DESC, p_partkey")
def federated_topk(spark, sf_dir):
    top = R.top_of_each(load(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 4)
    return top.orderBy(F.desc("p_retailprice"), "p_partkey").select("p_brand", "p_partkey", "p_retailprice")


@_query("""WITH c AS (SELECT conv_id * 1000 + turn AS id, role FROM conversations), p AS (SELECT *, row_number() OVER (ORDER BY id DESC) AS k FROM c WHERE id < 50000)
SELECT id, role, (SELECT count(*) FROM p) > 20 AS has_more FROM p WHERE k <= 20""")
def keyset_page(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role").withColumn("key", F.lit(0))
    return R.page_after(rows, "id", "key", (50000, 0), 20).drop("key")


@_query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3 ORDER BY conv_id, turn")
def last_n_messages(spark, sf_dir):
    return R.top_of_each(load(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], 3).orderBy("conv_id", "turn").select("conv_id", "turn", "role")


@_query("SELECT conv_id, turn, running::BIGINT AS running FROM (SELECT conv_id, turn, sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn) AS running FROM conversations) WHERE running <= 1500")
def byte_budget(spark, sf_dir):
    return R.within_budget(load(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn")], F.octet_length("text"), 1500).select("conv_id", "turn", "running")


@_query("""SELECT p_partkey, freed::BIGINT AS freed_before FROM (SELECT p_partkey, coalesce(sum(p_size) OVER (ORDER BY p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM part) WHERE freed < 700""")
def lru_eviction(spark, sf_dir):
    return R.evicted(load(spark, sf_dir, "part"), "p_size", "p_retailprice", "p_partkey", 700).select("p_partkey", "freed_before")


@_query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders WHERE o_orderstatus = 'F' ORDER BY y DESC, m DESC, d DESC, o_orderkey LIMIT 50")
def multi_key_sort(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"))
    return rows.orderBy(F.desc(F.struct("y", "m", "d")), "o_orderkey").limit(50)


@_query("SELECT o_custkey, max(struct_pack(d := o_orderdate, k := o_orderkey)).k AS latest FROM orders GROUP BY 1")
def latest_per_group(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("latest"))


@_query("SELECT DISTINCT w FROM (SELECT p_brand AS w FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT c_mktsegment FROM customer) ORDER BY w LIMIT 10")
def union_distinct(spark, sf_dir):
    part, customer = load(spark, sf_dir, "part"), load(spark, sf_dir, "customer")
    return part.select(F.col("p_brand").alias("w")).union(part.select("p_type")).union(customer.select("c_mktsegment")).distinct().orderBy("w").limit(10)


@_query("SELECT p_partkey, CASE WHEN a = b THEN a ELSE a || ',' || b END AS tags FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)")
def ordered_tag_union(spark, sf_dir):
    w = F.split("p_name", " ")
    return load(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", R.ordered_union(F.array(w[0]), F.array(w[1]))).alias("tags"))


@_query("""WITH v AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE upper(event_type) END AS t FROM events),
f AS (SELECT user_id, min(event_id) AS e, arg_min(t, event_id) AS t FROM v GROUP BY user_id, lower(t)) SELECT user_id, string_agg(t, ',' ORDER BY e) AS tags FROM f GROUP BY 1""")
def folded_tag_union(spark, sf_dir):
    v = load(spark, sf_dir, "events").withColumn("t", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.upper("event_type")))
    return R.folded_union(v, "user_id", "event_id", "t").select("user_id", F.concat_ws(",", "values").alias("tags"))


@_query("""WITH o AS (SELECT p_brand, p_partkey, 60 - p_size AS priority FROM part WHERE p_partkey % 3 = 0), b AS (SELECT p_brand, p_partkey, p_size AS priority FROM part WHERE p_partkey % 3 <> 0 OR false),
u AS (SELECT * FROM b UNION ALL SELECT * FROM o) SELECT p_brand, p_partkey, priority FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY priority DESC, p_partkey) AS k FROM u) WHERE k <= 5""")
def bank_merge(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    overlay = part.where("p_partkey % 3 = 0").select("p_brand", "p_partkey", (60 - F.col("p_size")).alias("priority"))
    return R.overlaid(part.select("p_brand", "p_partkey", F.col("p_size").alias("priority")), overlay, ["p_partkey"], "priority", ["p_brand"], 5)


@_query("""WITH a AS (SELECT s_suppkey AS id, unnest([struct_pack(path := 'name', v := s_name), struct_pack(path := 'nation', v := s_nationkey::VARCHAR)], recursive := true) FROM supplier WHERE s_suppkey % 11 <> 3),
b AS (SELECT s_suppkey AS id, unnest([struct_pack(path := 'name', v := CASE WHEN s_suppkey % 7 = 0 THEN 'renamed' ELSE s_name END), struct_pack(path := 'nation', v := s_nationkey::VARCHAR)], recursive := true) FROM supplier WHERE s_suppkey % 13 <> 5)
SELECT id, path, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'modified' END AS change, a.v AS old, b.v AS new FROM a FULL JOIN b USING (id, path) WHERE a.v IS DISTINCT FROM b.v""")
def snapshot_diff(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    old, new = s.where("id % 11 != 3"), s.where("id % 13 != 5").withColumn("name", F.when(F.col("id") % 7 == 0, "renamed").otherwise(F.col("name")))
    return R.difference(R.flattened(old, "id", ["name", "nation"]), R.flattened(new, "id", ["name", "nation"]), ["id", "path"], "value")


@_query("""WITH o AS (SELECT c_custkey AS k, c_acctbal AS v, 1 AS ver FROM customer), n AS (SELECT o_custkey AS k, sum(o_totalprice) AS v, count(*) % 3 AS ver FROM orders GROUP BY 1)
SELECT k, round(CASE WHEN n.ver >= coalesce(o.ver, 0) THEN n.v ELSE o.v END, 2) AS v, greatest(coalesce(o.ver, 0), coalesce(n.ver, 0))::BIGINT AS ver FROM o FULL JOIN n USING (k)""")
def upsert_latest(spark, sf_dir):
    old = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(1).cast("long").alias("ver"))
    new = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("v"), (F.count("*") % 3).alias("ver"))
    return sinks.upserted(old, new, ["k"], "ver").withColumn("v", F.round("v", 2))


@_query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAYS")
def retention(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    end = e.agg(F.max("ts").alias("as_of"))
    return sinks.retained(e.crossJoin(F.broadcast(end)), "ts", F.col("as_of"), 5).select("event_id", "ts")


@_query("SELECT 'nation' AS table_name, 25::BIGINT AS expected_rows, 25::BIGINT AS copied_rows, true AS matches UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier WHERE s_acctbal > 0), (SELECT count(*) FROM supplier WHERE s_acctbal <= 0) = 0")
def copy_validation(spark, sf_dir):
    n, s = load(spark, sf_dir, "nation"), load(spark, sf_dir, "supplier")
    return sinks.reconciled({"nation": n, "supplier": s}, {"nation": n, "supplier": s.where("s_acctbal > 0")})


@_query(r"SELECT doc_id, regexp_replace(replace(text, ',', ';'), '[\r\n]+', ' ', 'g') AS line FROM documents")
def csv_export_field(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", sinks.csv_safe(F.col("text")).alias("line"))
