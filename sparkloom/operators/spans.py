"""Rows next to one another: joins by position and by time, spans that overlap, groups that share members."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.graph import components
from sparkloom.operators.scan import Machine, scanned
from sparkloom.sources.tables import stored


def zipped(left: DataFrame, right: DataFrame, group: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Within each group the first row of one side with the first of the other, and so on, with ``place`` from 0; a row without a partner has nulls for it."""
    a = left.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*left_order)) - 1)
    b = right.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*right_order)) - 1)
    return a.join(b, [group, "place"], "full_outer")


def as_of(rows: DataFrame, other: DataFrame, key: str, time: str, tie: str, value: str) -> DataFrame:
    """``rows`` (key, time, tie and others) with ``value`` of the last row of ``other`` (key, time, tie, value) at or before each.

    Both sides are one sorted pass over their union; nothing is joined.  Of equal times the greater ``tie`` is later.
    """
    mark = F.struct(F.col(value).alias("v"))
    both = rows.withColumn("_mark", F.lit(None).cast(other.select(mark.alias("m")).schema["m"].dataType)).unionByName(other.select(key, time, tie, mark.alias("_mark")), allowMissingColumns=True)
    mine = both.withColumn("_own", F.col("_mark").isNull())
    last = F.last("_mark", ignorenulls=True).over(Window.partitionBy(key).orderBy(time, tie, "_own").rowsBetween(Window.unboundedPreceding, 0))
    return mine.withColumn("_last", last).where("_own").select(*rows.columns, F.col("_last.v").alias(value))


class Greedy(Machine):
    """Spans that are kept, by start; they overlap in nothing, so only the neighbours of a place can meet a new one."""

    def __init__(self) -> None:
        self.starts: list = []
        self.ends: list = []

    def take(self, start, end, confidence) -> list[tuple]:
        at = bisect_left(self.starts, start)
        empty = start >= end
        clash = (at > 0 and self.ends[at - 1] > start) or (at < len(self.starts) and self.starts[at] < end)
        if clash:
            return []
        if not empty:
            self.starts.insert(at, start)
            self.ends.insert(at, end)
        return [(start, end, confidence)]


def without_overlaps(spans: DataFrame, group: str, start: str, end: str, confidence: str) -> DataFrame:
    """(group, start, end, confidence) of the spans that a greedy choice keeps: by falling confidence, then by start, each that overlaps none kept before.

    One sorted pass; a task holds the spans kept of one group.
    """
    rows = spans.select(group, (-F.col(confidence)).alias("_order"), start, end, confidence)
    kinds = ", ".join(f"`{c}` {spans.schema[c].dataType.simpleString()}" for c in (start, end, confidence))
    return scanned(rows, [group], ["_order", start, end], [start, end, confidence], Greedy, kinds)


class _Collapse(Machine):
    """The last place kept, which waits for a better one near it."""

    def __init__(self, gap: float) -> None:
        self.gap, self.last = gap, None

    def take(self, place, score) -> list[tuple]:
        if self.last is None:
            self.last = (place, score)
        elif place - self.last[0] >= self.gap:
            out, self.last = [self.last], (place, score)
            return out
        elif score > self.last[1]:
            self.last = (place, score)
        return []

    def end(self) -> list[tuple]:
        return [self.last] if self.last else []


def collapsed(places: DataFrame, group: str, place: str, score: str, gap: float) -> DataFrame:
    """(group, place, score): of places nearer than ``gap`` to the last one kept only that with the higher score stays, of equal ones the first; one sorted pass."""
    kinds = ", ".join(f"`{c}` {places.schema[c].dataType.simpleString()}" for c in (place, score))
    return scanned(places, [group], [place, score], [place, score], lambda: _Collapse(gap), kinds)


def united(members: DataFrame, group: str, member: str) -> DataFrame:
    """(member, group): groups that share a member are one, named by its smallest; so are those that it shares with others.

    Each group is tied to the smallest group of each of its members, and these ties are
    contracted to components, in rounds that grow with the logarithm of the longest chain.
    """
    rows = stored(members.select(F.col(group).alias("g"), F.col(member).alias("m")).where("g is not null and m is not null").distinct(), "united")
    least = rows.groupBy("m").agg(F.min("g").alias("to"))
    ties = rows.join(least, "m").select("g", "to").where("g != to").distinct()
    found = components(ties, "g", "to")
    names = rows.join(found.withColumnRenamed("id", "g"), "g", "left").select(F.col("m").alias(member), F.coalesce("component", "g").alias(group))
    return names.groupBy(member).agg(F.min(group).alias(group))


def transitions(log: DataFrame, key: str, time: str, tie: str, status: str, begun: str, ended: list[str]) -> DataFrame:
    """(key, status, started_at, resolved_at): the last status of each key, when it last came to ``begun``, and when to one of ``ended``; any status may follow any other."""
    at = F.col(time)
    return log.groupBy(key).agg(F.max_by(F.col(status), F.struct(time, tie)).alias(status), F.max(F.when(F.col(status) == begun, at)).alias("started_at"), F.max(F.when(F.col(status).isin(ended), at)).alias("resolved_at"))
