"""Filters, joins, ordered computations, paging and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given; of none, true."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def any_of(*conditions: Column | None) -> Column:
    """The disjunction of the conditions that are given; of none, true."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a | b, given) if given else F.lit(True)


def constraint(included: dict[str, list[str]], excluded: dict[str, list[str]], ranges: dict[str, tuple[float, float]]) -> Column:
    """AND across columns, OR within one, NOT for exclusions; a range with equal bounds is an equality."""
    parts = [F.col(c).isin(v) for c, v in included.items() if v]
    parts += [~F.col(c).isin(v) for c, v in excluded.items() if v]
    parts += [F.col(c) == a if a == b else F.col(c).between(a, b) for c, (a, b) in ranges.items()]
    return all_of(*parts)


def null_or_equal(column: str, value: object) -> Column:
    return F.col(column).isNull() | (F.col(column) == F.lit(value))


def touching(entity: object, src: str, dst: str, both_ways: Column) -> Column:
    """Edges that start at an entity, or end there and go both ways."""
    return (F.col(src) == F.lit(entity)) | (both_ways & (F.col(dst) == F.lit(entity)))


def contains_any(tags: Column, wanted: str) -> Column:
    """Whether a tag contains a string, whatever the case."""
    return F.exists(tags, lambda t: F.lower(t).contains(wanted.lower()))


def counted_children(parents: DataFrame, key: str, children: DataFrame, foreign: str, count: str) -> DataFrame:
    """Parents with the number of their children, 0 included; children are counted before the join."""
    n = children.groupBy(F.col(foreign).alias("_key")).agg(F.count("*").alias("_n"))
    return parents.join(n, F.col(key) == F.col("_key"), "left").withColumn(count, F.coalesce("_n", F.lit(0))).drop("_key", "_n")


def with_all_met(items: DataFrame, key: str, needs: DataFrame, needed: str, met: DataFrame) -> DataFrame:
    """Items whose needs (``needs``: key, needed) are all in ``met``; an item without needs passes."""
    unmet = needs.join(met.select(needed).distinct(), needed, "left_anti").select(key).distinct()
    return items.join(unmet, key, "left_anti")


def dereferenced(rows: DataFrame, ids: str, targets: DataFrame, key: str) -> DataFrame:
    """A row for each id of an array column that leads to a target; dangling ids are dropped."""
    return rows.withColumn("_id", F.explode(ids)).join(targets, F.col("_id") == F.col(key)).drop("_id")


def looked_up(rolls: DataFrame, value: str, table: DataFrame, low: str, high: str, group: str, width: int) -> DataFrame:
    """Rolls with the first entry of their group's table whose range holds the value.

    The range join is an equality on buckets of ``width`` values: entries are
    listed under each bucket they touch, so no pair outside a bucket is compared.
    """
    entries = table.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    joined = rolls.withColumn("_b", F.floor(F.col(value) / width)).join(entries, [group, "_b"]).where(F.col(value).between(F.col(low), F.col(high)))
    first = F.row_number().over(Window.partitionBy(*rolls.columns).orderBy(low, high))
    return joined.withColumn("_n", first).where("_n = 1").drop("_n", "_b")


def gaps(table: DataFrame, group: str, low: str, high: str) -> DataFrame:
    """Ranges with ``issue``: gap or overlap against the greatest end before them, or null."""
    before = F.max(high).over(Window.partitionBy(group).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1))
    issue = F.when(F.col(low) > before + 1, "gap").when(F.col(low) <= before, "overlap")
    return table.withColumn("issue", issue)


def carried_forward(rows: DataFrame, group: str, order: str, marked: Column, name: str) -> DataFrame:
    """Rows with the last marked value up to them."""
    return rows.withColumn(name, F.last(marked, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def merged_runs(rows: DataFrame, group: str, order: str, is_base: Column, value: str) -> DataFrame:
    """Continuation rows put together with the base row before them: (group, run, first, n, total)."""
    run = F.sum(F.when(is_base, 1).otherwise(0)).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("run", run).groupBy(group, "run").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.sum(value).alias("total"))


def smoothed(rows: DataFrame, group: str, order: str, label: str, width: int = 5) -> DataFrame:
    """Rows with the commonest label of the last ``width`` rows, of equally common ones the least."""
    window = Window.partitionBy(group).orderBy(order).rowsBetween(1 - width, 0)
    seen = F.collect_list(label).over(window)
    ranked = F.transform(F.array_distinct(seen), lambda x: F.struct((-F.size(F.filter(seen, lambda y: y == x))).alias("n"), x.alias("x")))
    return rows.withColumn("smooth", F.array_min(ranked)["x"])


def normalised(rows: DataFrame, score: str, method: str, group: list[str] | None = None) -> Column:
    """A score as min-max (1 if all are equal) or z-score (0 if all are equal) within its group."""
    w = Window.partitionBy(*(group or []))
    low, high, mean, sigma = F.min(score).over(w), F.max(score).over(w), F.avg(score).over(w), F.stddev_pop(score).over(w)
    if method == "min_max":
        return F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(1.0)
    if method == "z_score":
        return F.when(sigma > 0, (F.col(score) - mean) / sigma).otherwise(0.0)
    return F.col(score)


def top_of_each(rows: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_after(rows: DataFrame, time: str, key: str, cursor: tuple[object, object] | None, limit: int) -> DataFrame:
    """The ``limit`` rows before a (time, key) cursor, newest first, with ``has_more``: whether another page follows."""
    if cursor is not None:
        rows = rows.where(F.struct(time, key) < F.struct(F.lit(cursor[0]).cast(rows.schema[time].dataType).alias(time), F.lit(cursor[1]).alias(key)))
    some = rows.orderBy(F.desc(time), F.desc(key)).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(F.desc(time), F.desc(key)))
    return some.withColumn("_n", place).withColumn("has_more", F.max("_n").over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def within_budget(rows: DataFrame, group: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Rows in order up to, without, the first that would take the running cost over the budget."""
    running = F.sum(cost).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", running).where(F.col("running") <= budget)


def evicted(cache: DataFrame, size: str, used_at: str, key: str, need: int) -> DataFrame:
    """Entries to drop, oldest use first, until ``need`` is free; the last one may free more."""
    before = F.coalesce(F.sum(size).over(Window.orderBy(used_at, key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cache.withColumn("freed_before", before).where(F.col("freed_before") < need)


def ordered_union(first: Column, second: Column) -> Column:
    """Both arrays, each value once, where it first stands."""
    return F.array_distinct(F.concat(first, second))


def folded_union(values: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Values of a group once whatever their case, in the first spelling, in order: (group, values)."""
    first = values.groupBy(group, F.lower(value).alias("_k")).agg(F.min(F.struct(order, value)).alias("v"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list("v")), lambda v: v[value]).alias("values"))


def overlaid(base: DataFrame, overlay: DataFrame, keys: list[str], priority: str, group: list[str], cap: int) -> DataFrame:
    """Base rows, overlay rows instead of those with their key, and of each group the ``cap`` of highest priority."""
    both = base.join(overlay.select(*keys), keys, "left_anti").unionByName(overlay)
    return top_of_each(both, group, [F.desc(priority), *(F.col(k) for k in keys)], cap).drop("rank")


def flattened(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, path, value): a row for each column."""
    paths = F.explode(F.array(*(F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(key, paths.alias("p")).select(key, "p.*")


def difference(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change, old, new): what was added, removed or modified."""
    a, b = old.select(*keys, F.col(value).alias("old"), F.lit(True).alias("_a")), new.select(*keys, F.col(value).alias("new"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return a.join(b, keys, "full_outer").withColumn("change", change).where("change is not null").select(*keys, "change", "old", "new")
