"""Queries over logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import analytics as A
from sparkloom.sources.tables import load, search_log, usage_log

QUERIES = {}
ORACLE_SQL = {}

SEARCH = """search_log AS (
    SELECT event_id AS search_id, event_type || '-' || (user_id % 20) AS query, trunc(value)::INT % 10 AS results_count,
        CASE WHEN event_type = 'click' THEN user_id % 5 END AS selected_index, regexp_extract(props, '([0-9]+)', 1)::INT % 2 = 0 AS cache_hit,
        trunc(value)::INT AS response_ms, event_type AS search_type, ts AS created_at FROM events
), as_of AS (SELECT max(ts) AS t FROM events)"""
USAGE = """usage_log AS (
    SELECT l_returnflag AS provider, l_linestatus AS model, (l_quantity * 100)::BIGINT AS input_tokens, (l_linenumber * 10)::BIGINT AS output_tokens,
        l_extendedprice * (1 - l_discount) AS cost, l_shipdate AS logged_at FROM lineitem
)"""


def _query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_log(load(spark, sf_dir, "events"))


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_log(load(spark, sf_dir, "lineitem"))


def _rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


@_query(f"""WITH {SEARCH}, one AS (
    SELECT count(*) AS searches, count(*) FILTER (results_count = 0) AS empty, count(selected_index) AS clicked, avg(results_count) AS avg_results, avg(response_ms) AS avg_ms, count(*) FILTER (cache_hit) AS hits
    FROM search_log, as_of WHERE created_at >= t - INTERVAL 168 HOURS)
SELECT searches, empty, clicked, round(avg_results, 4) AS avg_results, round(avg_ms, 4) AS avg_ms, hits, round(clicked / searches, 4) AS click_rate, round(hits / searches, 4) AS hit_rate, round(avg_ms * 0.8, 4) AS saved_ms FROM one""")
def search_summary(spark, sf_dir):
    return _rounded(A.search_summary(_searches(spark, sf_dir), 168), "avg_results", "avg_ms", "click_rate", "hit_rate", "saved_ms")


@_query(f"""WITH {SEARCH} SELECT lower(trim(query)) AS query, count(*) AS searches, count(selected_index) AS clicks, round(avg(results_count), 4) AS avg_results, max(created_at) AS last_at
FROM search_log GROUP BY 1 ORDER BY searches DESC, query LIMIT 10""")
def popular_queries(spark, sf_dir):
    return _rounded(A.popular_queries(_searches(spark, sf_dir), 10), "avg_results")


@_query(f"""WITH {SEARCH} SELECT count(*) FILTER (cache_hit) AS hits, count(*) FILTER (NOT cache_hit) AS misses, round(count(*) FILTER (cache_hit) / count(*), 4) AS hit_rate,
round(avg(CASE WHEN NOT cache_hit THEN response_ms END) * 0.8, 4) AS saved_ms FROM search_log""")
def cache_stats(spark, sf_dir):
    return _rounded(A.cache_stats(_searches(spark, sf_dir)), "hit_rate", "saved_ms")


@_query(f"WITH {SEARCH} SELECT selected_index, count(*) AS clicks FROM search_log WHERE selected_index IS NOT NULL GROUP BY 1")
def click_distribution(spark, sf_dir):
    return A.click_distribution(_searches(spark, sf_dir))


@_query(f"""WITH {SEARCH} SELECT query, max(created_at) AS last_at FROM search_log, as_of WHERE created_at >= t - INTERVAL 72 HOURS AND results_count = 0 GROUP BY 1 ORDER BY last_at DESC, query LIMIT 20""")
def zero_result_queries(spark, sf_dir):
    return A.zero_result_queries(_searches(spark, sf_dir), 72, 20)


_TREND = """SELECT {key} AS query, count(*) FILTER (created_at >= t - INTERVAL 1 DAY) AS recent, count(*) FILTER (created_at < t - INTERVAL 1 DAY AND created_at >= t - INTERVAL 7 DAYS) AS older
    FROM search_log, as_of GROUP BY 1 HAVING recent > 0"""


@_query(f"""WITH {SEARCH}, g AS ({_TREND.format(key="lower(trim(query))")})
SELECT query, recent, older, round(recent / coalesce(nullif(older, 0), 1) * 7.0, 4) AS score FROM g ORDER BY recent / coalesce(nullif(older, 0), 1) DESC, query LIMIT 10""")
def trending_queries(spark, sf_dir):
    return _rounded(A.trending_queries(_searches(spark, sf_dir), 10), "score")


@_query(f"""WITH {SEARCH}, g AS ({_TREND.format(key="lower(query)")}), s AS (SELECT *, recent / greatest(CASE WHEN older > 0 THEN older ELSE 1 END / 7, 1.0) AS score FROM g)
SELECT query, recent, older, round(score, 4) AS score FROM s ORDER BY s.score DESC, query LIMIT 10""")
def trending_queries_memory(spark, sf_dir):
    return _rounded(A.trending_queries(_searches(spark, sf_dir), 10, "memory"), "score")


@_query(f"""WITH {SEARCH} SELECT query, count(*) AS searches, round(avg(results_count), 4) AS avg_results, round(avg(response_ms), 4) AS avg_ms, min(selected_index) AS first_click, max(created_at) AS last_at FROM search_log GROUP BY 1""")
def query_stats(spark, sf_dir):
    return _rounded(A.query_stats(_searches(spark, sf_dir)), "avg_results", "avg_ms")


@_query(f"WITH {USAGE} SELECT count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost), 2) AS cost FROM usage_log")
def usage_totals(spark, sf_dir):
    return _rounded(A.usage_totals(_usage(spark, sf_dir)), "cost", digits=2)


@_query(f"WITH {USAGE} SELECT provider, count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost), 2) AS cost FROM usage_log GROUP BY 1")
def usage_by_provider(spark, sf_dir):
    return _rounded(A.usage_by_provider(_usage(spark, sf_dir)), "cost", digits=2)


@_query(f"""WITH {USAGE} SELECT provider, model, grouping_id(provider, model) AS level, count(*) AS requests, round(sum(cost), 2) AS cost, round(sum(cost) / count(*), 2) AS avg_cost
FROM usage_log GROUP BY GROUPING SETS ((), (provider), (provider, model))""")
def cost_breakdown(spark, sf_dir):
    return _rounded(A.cost_breakdown(_usage(spark, sf_dir)), "cost", "avg_cost", digits=2)


@_query(f"WITH {USAGE} SELECT count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost), 2) AS cost FROM usage_log WHERE lower(provider) = 'a'")
def provider_stats(spark, sf_dir):
    return _rounded(A.provider_stats(_usage(spark, sf_dir), "A"), "cost", digits=2)


@_query("""SELECT l_returnflag || l_linestatus AS model, round(sum((greatest(l_quantity * 100 - l_linenumber * 50, 0) * p + l_linenumber * 50 * p * 0.1 + l_linenumber * 10 * q) / 1e6), 6) AS cost
FROM (SELECT *, CASE WHEN contains(lower(l_returnflag || l_linestatus), 'af') THEN 15.0 WHEN contains(lower(l_returnflag || l_linestatus), 'n') THEN 3.0 ELSE 1.0 END AS p,
    CASE WHEN contains(lower(l_returnflag || l_linestatus), 'af') THEN 75.0 WHEN contains(lower(l_returnflag || l_linestatus), 'n') THEN 15.0 ELSE 3.0 END AS q FROM lineitem) GROUP BY 1""")
def token_costs(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").withColumn("model", F.concat("l_returnflag", "l_linestatus"))
    prices = A.price_by_rules([("af", 15.0, 75.0), ("n", 3.0, 15.0)], F.col("model"), (1.0, 3.0))
    cost = A.token_cost(F.col("l_quantity") * 100, F.col("l_linenumber") * 50, F.col("l_linenumber") * 10, prices, 0.9)
    return _rounded(rows.groupBy("model").agg(F.sum(cost).alias("cost")), "cost", digits=6)


@_query(f"""WITH {USAGE}, n AS (SELECT max(logged_at) AS t, date_trunc('month', max(logged_at)) AS s FROM usage_log),
b AS (SELECT t, s, coalesce(sum(CASE WHEN logged_at >= s THEN cost END), 0) AS spent FROM usage_log, n GROUP BY t, s),
h AS (SELECT *, greatest(date_diff('second', s, t) / 3600, 1.0) AS hours, greatest(date_diff('second', t, s + INTERVAL 30 DAYS) / 3600, 0) AS rest FROM b)
SELECT round(spent, 2) AS spent, round(spent / 5e6 * 100, 2) AS percent, round(spent / hours, 2) AS velocity, round(spent + spent / hours * rest, 2) AS projected,
CASE WHEN spent / 5e6 >= 1 THEN 'reject' WHEN spent / 5e6 >= 0.95 THEN 'degrade' WHEN spent / 5e6 >= 0.9 THEN 'throttle' WHEN spent / 5e6 >= 0.8 THEN 'warn' ELSE 'allow' END AS action FROM h""")
def budget_status(spark, sf_dir):
    return _rounded(A.budget_status(_usage(spark, sf_dir), 5e6, "month"), "spent", "percent", "velocity", "projected", digits=2)


@_query(f"""WITH {USAGE}, n AS (SELECT max(logged_at) AS t FROM usage_log)
SELECT h.hours::INT AS hours, round(coalesce(sum(CASE WHEN logged_at >= t - h.hours * INTERVAL 1 HOUR THEN cost END), 0), 2) AS spent FROM usage_log, n, (VALUES (1), (24), (168), (720)) h(hours) GROUP BY 1""")
def rolling_spending(spark, sf_dir):
    return _rounded(A.rolling_spending(_usage(spark, sf_dir), [1, 24, 168, 720]), "spent", digits=2)


HOURLY = "series AS (SELECT date_trunc('hour', ts) AS hour, sum(value) AS cost FROM events GROUP BY 1)"


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hourly_costs(load(spark, sf_dir, "events").select(F.col("ts").alias("logged_at"), F.col("value").alias("cost")))


@_query(f"""WITH {HOURLY}, o AS (SELECT avg(cost) AS m, stddev_pop(cost) AS s, count(*) AS n FROM series)
SELECT n AS points, round(m * 168, 4) AS expected, round(greatest(m * 168 - 2 * s * sqrt(168), 0), 4) AS low, round(m * 168 + 2 * s * sqrt(168), 4) AS high, round(least(n / 168, 1.0), 4) AS confidence FROM o""")
def cost_forecast(spark, sf_dir):
    return _rounded(A.forecast(_hourly(spark, sf_dir), 168), "expected", "low", "high", "confidence")


@_query(f"""WITH {HOURLY}, r AS (SELECT *, row_number() OVER (ORDER BY hour) AS k, count(*) OVER () AS n FROM series),
o AS (SELECT max(n) AS points, avg(cost) FILTER (k <= n // 2) AS a, avg(cost) FILTER (k > n // 2) AS b, avg(cost) AS m, stddev_pop(cost) AS s FROM r)
SELECT points, CASE WHEN points < 24 THEN 'unknown' WHEN abs(b - a) > 0.2 * a THEN 'trending' WHEN s > 0.5 * m THEN 'cyclical' ELSE 'stable' END AS pattern FROM o""")
def cost_pattern(spark, sf_dir):
    return A.pattern(_hourly(spark, sf_dir))


@_query(f"""WITH {HOURLY}, r AS (SELECT *, row_number() OVER (ORDER BY hour DESC) AS back FROM series),
b AS (SELECT avg(cost) AS m, greatest(stddev_pop(cost), 0.01) AS s FROM r WHERE back > 24 AND back <= 192)
SELECT hour, round(cost, 4) AS cost, round((cost - m) / s, 4) AS z FROM r, b WHERE back <= 24 AND abs((cost - m) / s) > 1.5""")
def cost_anomalies(spark, sf_dir):
    return _rounded(A.anomalies(_hourly(spark, sf_dir), bound=1.5), "cost", "z")


_AUDIT = "audit AS (SELECT event_id AS audit_id, ts AS logged_at, CASE user_id % 4 WHEN 0 THEN 'debug' WHEN 1 THEN 'info' WHEN 2 THEN 'warning' ELSE 'critical' END AS severity, event_type AS kind, props AS description FROM events)"


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, A.SEVERITIES)), (F.col("user_id") % 4).cast("int") + 1)
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("audit_id"), F.col("ts").alias("logged_at"), level.alias("severity"), F.col("event_type").alias("kind"), F.col("props").alias("description"))


@_query(f"WITH {_AUDIT} SELECT * FROM audit WHERE severity IN ('warning', 'critical') AND contains(kind, 'c') AND contains(description, '7') ORDER BY logged_at, audit_id LIMIT 100 OFFSET 20")
def audit_query(spark, sf_dir):
    return A.audit_query(_audit(spark, sf_dir), "warning", "C", "7", 20, 100)


@_query(f"WITH {_AUDIT} SELECT severity, count(*) AS n FROM audit GROUP BY 1")
def severity_counts(spark, sf_dir):
    return _audit(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))


@_query("""WITH f AS (SELECT user_id, event_type, min(ts) AS seen, count(*) AS n, sum(value) AS v, max(ts) AS last FROM events GROUP BY ALL)
SELECT user_id, round((epoch_us(max(last)) - epoch_us(min(seen))) / 60000000, 4) AS minutes, sum(n)::BIGINT AS events, round(sum(v), 4) AS total, string_agg(event_type, ',' ORDER BY seen) AS kinds FROM f GROUP BY 1""")
def timeline_summary(spark, sf_dir):
    log = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.col("ts").alias("logged_at"), "value")
    return _rounded(A.timeline_summary(log, "user_id"), "minutes", "total")


@_query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def count_by_type(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@_query("SELECT count(*) AS parts, count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types, round(avg(p_retailprice), 4) AS avg_price FROM part")
def distinct_counts(spark, sf_dir):
    return _rounded(load(spark, sf_dir, "part").agg(F.count("*").alias("parts"), F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_type").alias("types"), F.avg("p_retailprice").alias("avg_price")), "avg_price")


@_query("SELECT event_type AS provider, round(sum(value) / count(*), 4) AS avg_value, round(count(*) FILTER (value > 100) / count(*), 4) AS share FROM events GROUP BY 1")
def router_stats(spark, sf_dir):
    rows = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("provider")).agg(F.count("*").alias("n"), F.sum("value").alias("v"), F.count_if(F.col("value") > 100).alias("k"))
    return _rounded(rows.select("provider", A.ratio(F.col("v"), F.col("n")).alias("avg_value"), A.ratio(F.col("k"), F.col("n")).alias("share")), "avg_value", "share")
