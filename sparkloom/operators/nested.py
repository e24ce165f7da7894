"""Differences of nested values and rolls on tables that lead to each other: frontiers that shrink round by round."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.relational import looked_up
from sparkloom.sources.tables import stored

#: How deep tables may lead to tables.
MOST_DEPTH = 10


def differences(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, path, change, old, new): what differs between two JSON values of a row, at dotted paths of any depth.

    Objects are walked, whatever else differs is one change: ``added``, ``removed`` or
    ``modified``, with the values as JSON; arrays count as one value.  The order of an
    object's members is nothing.  A null or malformed value is absent; a JSON null is a
    value.  Each round opens the objects that differ by one level, so equal parts are left
    at once, and rows never meet each other.
    """
    def plain(c: Column) -> Column:
        return F.to_json(F.try_parse_json(c))

    def members(c: str) -> Column:
        return F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>")

    both = F.col("_old").startswith("{") & F.col("_new").startswith("{")
    differ = ~F.col("_old").eqNullSafe(F.col("_new"))
    rows = pairs.select(F.col(key).alias("_key"), F.lit(None).cast("string").alias("_path"), plain(F.col(old)).alias("_old"), plain(F.col(new)).alias("_new"))
    level = stored(rows.where(differ), "differences")
    done = []
    while True:
        done.append(level.where(~F.coalesce(both, F.lit(False))))
        open_ = level.where(both)
        if open_.isEmpty():
            break
        maps = open_.select("_key", "_path", members("_old").alias("_a"), members("_new").alias("_b"))
        each = maps.select("*", F.explode(F.array_union(F.map_keys("_a"), F.map_keys("_b"))).alias("_name"))
        # A member that is absent has no JSON, one that is null has the JSON of null.
        values = [F.when(F.map_contains_key(m, F.col("_name")), F.coalesce(F.to_json(F.col(m)[F.col("_name")]), F.lit("null"))) for m in ("_a", "_b")]
        opened = each.select("_key", F.concat_ws(".", "_path", "_name").alias("_path"), values[0].alias("_old"), values[1].alias("_new"))
        level = stored(opened.where(differ), "differences")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("modified")
    found = reduce(DataFrame.unionByName, done)
    return found.select(F.col("_key").alias(key), F.coalesce("_path", F.lit("")).alias("path"), change.alias("change"), F.col("_old").alias("old"), F.col("_new").alias("new"))


def rolled(rolls: DataFrame, entries: DataFrame, roll: Callable[[Column, Column, int], Column], most: int = MOST_DEPTH, width: int = 10) -> DataFrame:
    """(id, depth, tables, text, problem) of rolls (id, table, roll), one for each id, on tables of entries (table, low, high, text, nested).

    The entry of a roll may lead to another table, on which ``roll(id, table, depth)`` is
    rolled; texts that aren't empty are joined by a colon and a space.  A roll without a
    text has a ``problem``: ``no entry``, ``depth`` (beyond ``most``) or ``cycle`` (a table
    that the roll has visited).  Of entries that overlap the first one counts.  Each round
    is one range join by buckets, for the rolls that go on; what a roll has visited is no
    longer than the depth.
    """
    table = entries.select(F.col("table"), F.col("low"), F.col("high"), F.col("text").alias("_text"), F.col("nested").alias("_nested"))
    front = rolls.select("id", "table", "roll", F.array("table").alias("tables"), F.array().cast("array<string>").alias("_said"))
    done = []
    for depth in range(most + 1):
        hit = looked_up(front.select("id", "table", "roll"), "roll", table, "low", "high", "table", width).select("id", "low", "_text", "_nested")
        seen = F.array_contains("tables", F.col("_nested"))
        problem = F.when(F.col("low").isNull(), "no entry").when(F.col("_nested").isNull(), None).when(F.lit(depth + 1 > most), "depth").when(seen, "cycle")
        said = F.when(F.col("_text") != "", F.concat("_said", F.array("_text"))).otherwise(F.col("_said"))
        after = front.join(hit, "id", "left").select("id", "tables", said.alias("_said"), "_nested", problem.alias("problem"))
        level = stored(after, "rolls")
        on = F.col("_nested").isNotNull() & F.col("problem").isNull()
        text = F.when(F.col("problem").isNull(), F.array_join("_said", ": "))
        done.append(level.where(~on).select("id", F.lit(depth).alias("depth"), "tables", text.alias("text"), "problem"))
        further = level.where(on)
        if depth == most or further.isEmpty():
            break
        front = further.select("id", F.col("_nested").alias("table"), roll(F.col("id"), F.col("_nested"), depth + 1).alias("roll"), F.concat("tables", F.array("_nested")).alias("tables"), "_said")
    return reduce(DataFrame.unionByName, done)
