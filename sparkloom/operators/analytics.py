"""Analytics of search, usage, cost and audit logs.

Where a summary depends on the present moment, it is the column ``as_of``, so
that a query over stored rows gives the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_end(rows: DataFrame, time: str) -> DataFrame:
    """The rows with ``as_of``, the latest time of all: one value, joined as a single row."""
    return rows.crossJoin(F.broadcast(rows.agg(F.max(time).alias("as_of"))))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def search_summary(log: DataFrame, hours: int) -> DataFrame:
    """One row: searches, empty ones, picks, averages and rates of the last ``hours`` hours."""
    recent = at_end(log, "created_at").where(F.col("created_at") >= F.col("as_of") - F.expr(f"INTERVAL {hours} HOURS"))
    n = F.count("*")
    one = recent.agg(n.alias("searches"), F.count_if(F.col("results_count") == 0).alias("empty"), F.count("selected_index").alias("clicked"), F.coalesce(F.avg("results_count"), F.lit(0.0)).alias("avg_results"), F.coalesce(F.avg("response_ms"), F.lit(0.0)).alias("avg_ms"), F.count_if("cache_hit").alias("hits"))
    return one.select("*", ratio(F.col("clicked"), F.col("searches")).alias("click_rate"), ratio(F.col("hits"), F.col("searches")).alias("hit_rate"), (F.col("avg_ms") * 0.8).alias("saved_ms"))


def popular_queries(log: DataFrame, limit: int) -> DataFrame:
    key = F.lower(F.trim("query")).alias("query")
    groups = log.groupBy(key).agg(F.count("*").alias("searches"), F.count("selected_index").alias("clicks"), F.avg("results_count").alias("avg_results"), F.max("created_at").alias("last_at"))
    return groups.orderBy(F.desc("searches"), "query").limit(limit)


def cache_stats(log: DataFrame) -> DataFrame:
    """Hits, misses, the hit rate, and the time a hit saves: 0.8 of a miss's average."""
    one = log.agg(F.count_if("cache_hit").alias("hits"), F.count_if(~F.col("cache_hit")).alias("misses"), F.avg(F.when(~F.col("cache_hit"), F.col("response_ms"))).alias("miss_ms"))
    return one.select("hits", "misses", ratio(F.col("hits"), F.col("hits") + F.col("misses")).alias("hit_rate"), (F.coalesce("miss_ms", F.lit(0.0)) * 0.8).alias("saved_ms"))


def click_distribution(log: DataFrame) -> DataFrame:
    return log.where("selected_index is not null").groupBy("selected_index").agg(F.count("*").alias("clicks"))


def zero_result_queries(log: DataFrame, hours: int, limit: int) -> DataFrame:
    """Queries that found nothing, each once, the latest first."""
    recent = at_end(log, "created_at").where((F.col("created_at") >= F.col("as_of") - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("results_count") == 0))
    return recent.groupBy("query").agg(F.max("created_at").alias("last_at")).orderBy(F.desc("last_at"), "query").limit(limit)


def trending_queries(log: DataFrame, limit: int, mode: str = "sql") -> DataFrame:
    """Queries by how much more often they came in the last day than in the six days before.

    ``sql`` divides by the older count (1 where there is none) and multiplies by
    7; ``memory`` divides by a seventh of it, 1 at least, and doesn't trim.
    """
    rows = at_end(log, "created_at")
    key = F.lower(F.trim("query")) if mode == "sql" else F.lower("query")
    day, week = F.col("as_of") - F.expr("INTERVAL 1 DAY"), F.col("as_of") - F.expr("INTERVAL 7 DAYS")
    recent, older = F.count_if(F.col("created_at") >= day), F.count_if((F.col("created_at") < day) & (F.col("created_at") >= week))
    groups = rows.groupBy(key.alias("query")).agg(recent.alias("recent"), older.alias("older")).where("recent > 0")
    score = F.col("recent") / F.coalesce(F.nullif(F.col("older"), F.lit(0)), F.lit(1)) * 7.0
    if mode == "memory":
        score = F.col("recent") / F.greatest(F.when(F.col("older") > 0, F.col("older")).otherwise(1) / 7, F.lit(1.0))
    return groups.withColumn("score", score).orderBy(F.desc("score"), "query").limit(limit)


def query_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("query").agg(F.count("*").alias("searches"), F.avg("results_count").alias("avg_results"), F.avg("response_ms").alias("avg_ms"), F.min("selected_index").alias("first_click"), F.max("created_at").alias("last_at"))


def usage_totals(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("requests"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cost")))


def usage_by_provider(log: DataFrame) -> DataFrame:
    return log.groupBy("provider").agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))


def cost_breakdown(log: DataFrame) -> DataFrame:
    """Costs in all, by provider, and by provider and model, from one pass: three grouping sets."""
    sets = log.groupingSets([[], ["provider"], ["provider", "model"]], "provider", "model").agg(F.grouping_id().alias("level"), F.count("*").alias("requests"), F.sum("cost").alias("cost"))
    return sets.withColumn("avg_cost", ratio(F.col("cost"), F.col("requests")))


def provider_stats(log: DataFrame, provider: str) -> DataFrame:
    """Totals of one provider, whatever the case of its name."""
    return usage_totals(log.where(F.lower("provider") == provider.lower()))


def price_by_rules(rules: list[tuple[str, float, float]], model: Column, default: tuple[float, float]) -> tuple[Column, Column]:
    """(input, output) price of the first rule whose string the model's name contains."""
    name = F.lower(model)
    prices = []
    for k in (1, 2):
        case = None
        for rule in rules:
            case = F.when(name.contains(rule[0]), rule[k]) if case is None else case.when(name.contains(rule[0]), rule[k])
        prices.append(case.otherwise(default[k - 1]))
    return prices[0], prices[1]


def token_cost(input_tokens: Column, cached: Column, output_tokens: Column, prices: tuple[Column, Column], discount: float) -> Column:
    """Price of a request in units of a million tokens; cached input tokens are cheaper by ``discount``."""
    fresh = F.greatest(input_tokens - cached, F.lit(0))
    return (fresh * prices[0] + cached * prices[0] * (1 - discount) + output_tokens * prices[1]) / 1e6


def budget_status(log: DataFrame, limit: float, period: str) -> DataFrame:
    """Spending since the start of the calendar period, its share of the limit, its velocity, and what to do about it.

    A month ends 30 days after its start.
    """
    length = {"hour": "1 HOUR", "day": "1 DAY", "week": "7 DAYS", "month": "30 DAYS"}[period]
    rows = at_end(log, "logged_at").withColumn("start", F.date_trunc(period, "as_of"))
    one = rows.groupBy("as_of", "start").agg(F.coalesce(F.sum(F.when(F.col("logged_at") >= F.col("start"), F.col("cost"))), F.lit(0.0)).alias("spent"))
    hours = F.greatest((F.unix_timestamp("as_of") - F.unix_timestamp("start")) / 3600, F.lit(1.0))
    left = (F.unix_timestamp(F.col("start") + F.expr(f"INTERVAL {length}")) - F.unix_timestamp("as_of")) / 3600
    used = F.col("spent") / limit
    action = F.when(used >= 1, "reject").when(used >= 0.95, "degrade").when(used >= 0.9, "throttle").when(used >= 0.8, "warn").otherwise("allow")
    return one.select("spent", (used * 100).alias("percent"), (F.col("spent") / hours).alias("velocity"), (F.col("spent") + F.col("spent") / hours * F.greatest(left, F.lit(0.0))).alias("projected"), action.alias("action"))


def rolling_spending(log: DataFrame, hours: list[int]) -> DataFrame:
    """Spending of the last so many hours, one row for each window, in one pass."""
    rows = at_end(log, "logged_at")
    sums = rows.agg(*(F.coalesce(F.sum(F.when(F.col("logged_at") >= F.col("as_of") - F.expr(f"INTERVAL {h} HOURS"), F.col("cost"))), F.lit(0.0)).alias(str(h)) for h in hours))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(h).alias("hours"), F.col(str(h)).alias("spent")) for h in hours))).alias("w")).select("w.*")


def hourly_costs(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("hour", "logged_at").alias("hour")).agg(F.sum("cost").alias("cost"))


def forecast(series: DataFrame, horizon: int) -> DataFrame:
    """Expected cost of the next ``horizon`` points: mean times horizon, two deviations each side, and a confidence by the points seen."""
    one = series.agg(F.avg("cost").alias("mean"), F.stddev_pop("cost").alias("sigma"), F.count("*").alias("points"))
    spread = 2 * F.col("sigma") * F.sqrt(F.lit(float(horizon)))
    middle = F.col("mean") * horizon
    return one.select("points", middle.alias("expected"), F.greatest(middle - spread, F.lit(0.0)).alias("low"), (middle + spread).alias("high"), F.least(F.col("points") / horizon, F.lit(1.0)).alias("confidence"))


def pattern(series: DataFrame) -> DataFrame:
    """What a series does: unknown (under 24 points), trending (halves differ by over 20 %), cyclical (deviation over half the mean) or stable."""
    n = F.count("*").over(Window.partitionBy())
    rows = series.withColumn("k", F.row_number().over(Window.orderBy("hour"))).withColumn("n", n)
    one = rows.agg(F.max("n").alias("points"), F.avg(F.when(F.col("k") <= F.floor(F.col("n") / 2), F.col("cost"))).alias("first"), F.avg(F.when(F.col("k") > F.floor(F.col("n") / 2), F.col("cost"))).alias("second"), F.avg("cost").alias("mean"), F.stddev_pop("cost").alias("sigma"))
    kind = F.when(F.col("points") < 24, "unknown").when(F.abs(F.col("second") - F.col("first")) > 0.2 * F.col("first"), "trending").when(F.col("sigma") > 0.5 * F.col("mean"), "cyclical").otherwise("stable")
    return one.select("points", kind.alias("pattern"))


def anomalies(series: DataFrame, recent: int = 24, before: int = 168, bound: float = 3.0) -> DataFrame:
    """The last ``recent`` points whose z-score against the ``before`` points before them exceeds ``bound``; under 48 points none."""
    rows = series.withColumn("back", F.row_number().over(Window.orderBy(F.desc("hour"))))
    base = rows.where((F.col("back") > recent) & (F.col("back") <= recent + before)).agg(F.avg("cost").alias("mean"), F.greatest(F.stddev_pop("cost"), F.lit(0.01)).alias("sigma"), F.count("*").alias("n"))
    z = (F.col("cost") - F.col("mean")) / F.col("sigma")
    return rows.where(F.col("back") <= recent).crossJoin(F.broadcast(base)).where(F.col("n") + recent >= 48).withColumn("z", z).where(F.abs("z") > bound).select("hour", "cost", "z")


#: Severities in rising order.
SEVERITIES = ["debug", "info", "warning", "critical"]


def at_least(severity: Column, least: str) -> Column:
    names = F.array(*map(F.lit, SEVERITIES))
    return F.array_position(names, severity) >= SEVERITIES.index(least) + 1


def audit_query(log: DataFrame, least: str, kind: str, text: str, offset: int, limit: int) -> DataFrame:
    """Audit rows of a severity or worse whose kind and description contain strings, whatever their case, oldest first."""
    wanted = at_least(F.col("severity"), least) & F.lower("kind").contains(kind.lower()) & F.lower("description").contains(text.lower())
    return log.where(wanted).orderBy("logged_at", "audit_id").offset(offset).limit(limit)


def timeline_summary(log: DataFrame, session: str) -> DataFrame:
    """For each session: its minutes, events by kind, the sum of values, and its kinds in order of first sight."""
    first = log.groupBy(session, "kind").agg(F.min("logged_at").alias("seen"), F.count("*").alias("n"), F.sum("value").alias("v"), F.max("logged_at").alias("last"))
    return first.groupBy(session).agg(((F.max(F.unix_micros(F.col("last").cast("timestamp"))) - F.min(F.unix_micros(F.col("seen").cast("timestamp")))) / 60_000_000).alias("minutes"), F.sum("n").alias("events"), F.sum("v").alias("total"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("seen", "kind"))), lambda s: s["kind"])).alias("kinds"))
