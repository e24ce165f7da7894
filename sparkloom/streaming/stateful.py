"""Stateful computations over streams, with batch twins that give the same for the whole log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.operators.scan import Machine, folded, scanned


def hourly(stream: DataFrame, time: str, value: str, late: str = "1 hour") -> DataFrame:
    """(hour, cost, n): sums of clock hours; rows that come later than ``late`` are left out of a stream."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(time, "1 hour").alias("w")).agg(F.sum(value).alias("cost"), F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "cost", "n")


def sessions(stream: DataFrame, key: str, time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): runs of a key's rows without a gap."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    return rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def alerts_once(stream: DataFrame, key: str, time: str, seconds: int = 3600) -> DataFrame:
    """(key, time): alerts, but for those within ``seconds`` of the last one let through of the same key.

    A suppressed alert doesn't prolong the silence.  The state of a key is the
    time of that alert, whatever the length of the log; a batch is sorted and
    read once, with that state alone.
    """
    schema = f"{key} string, {time} timestamp"

    def let_through(times: list[pd.Timestamp], last: pd.Timestamp | None) -> tuple[list[pd.Timestamp], pd.Timestamp | None]:
        out = []
        for t in times:
            if last is None or (t - last).total_seconds() >= seconds:
                out.append(t)
                last = t
        return out, last

    def frame_of(name: str | None, times: list[pd.Timestamp]) -> pd.DataFrame:
        # Typed, as a frame without rows would have columns of numbers.
        return pd.DataFrame({key: pd.Series([name] * len(times), dtype=object), time: pd.Series(times, dtype="datetime64[ns]")})

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, last = None, None
        for frame in frames:
            for other, part in frame.groupby(key, sort=False, dropna=False):
                other = None if pd.isna(other) else other
                last = last if other == name else None
                name = other
                out, last = let_through(list(part[time]), last)
                yield frame_of(other, out)

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = sorted(t for f in frames for t in f[time])
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        out, last = let_through(times, last)
        if last is not None:
            state.update((last.value // 1000,))
        yield frame_of(name[0], out)

    rows = stream.select(F.col(key).cast("string").alias(key), F.col(time).cast("timestamp").alias(time))
    if stream.isStreaming:
        return rows.groupBy(key).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.NoTimeout)
    return rows.repartition(key).sortWithinPartitions(key, time).mapInPandas(batch, schema)


class _Lines(Machine):
    """Lines out of pieces; what follows the last end of a line waits."""

    def __init__(self, rest: str = "", number: int = 0) -> None:
        self.parts, self.number = [rest] if rest else [], number

    def take(self, piece: str | None) -> list[tuple]:
        if not piece:
            return []
        first, *more = piece.split("\n")
        self.parts.append(first)
        if not more:
            return []
        whole = ["".join(self.parts), *more[:-1]]
        self.parts = [more[-1]] if more[-1] else []
        out = [(self.number + k, line.removesuffix("\r")) for k, line in enumerate(whole)]
        self.number += len(whole)
        return out


def lines(stream: DataFrame, key: str, order: str, piece: str) -> DataFrame:
    """(key, number, line): the whole lines of each key's text, which comes in pieces cut anywhere.

    A line without its end isn't given: in a stream it waits, and is the key's state with
    the number of the next line, whatever came before.  Null pieces are empty.  The pieces of
    one micro-batch are sorted; later ones are taken to follow them.  A log as a whole is
    read in one sorted pass.
    """
    kind = stream.schema[key].dataType
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(order).alias("order"), F.col(piece).cast("string").alias("piece"))

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = _Lines(*state.get) if state.exists else _Lines()
        pieces = pd.concat(list(frames), ignore_index=True).sort_values("order", kind="stable")["piece"]
        out = [row for p in pieces for row in machine.take(p)]
        state.update(("".join(machine.parts), machine.number))
        # Typed, as a frame without rows would have columns of numbers.
        yield pd.DataFrame({"key": pd.Series([name[0]] * len(out), dtype=object), "number": pd.Series([n for n, _ in out], dtype="int64"), "line": pd.Series([x for _, x in out], dtype=object)})

    if stream.isStreaming:
        found = rows.groupBy("key").applyInPandasWithState(step, "key string, number long, line string", "rest string, number long", "append", GroupStateTimeout.NoTimeout)
    else:
        found = scanned(rows, ["key"], ["order"], ["piece"], _Lines, "number long, line string")
    return found.select(F.col("key").cast(kind).alias(key), "number", "line")


def frames(stream: DataFrame, key: str, order: str, piece: str, schema: str) -> DataFrame:
    """(key, number, event, done) of the frames in a stream that comes in pieces: lines of JSON, with or without ``data:`` before them.

    ``[DONE]`` is a frame without an event; comments, other fields and what isn't JSON are left out.
    """
    body = lines(stream, key, order, piece).withColumn("line", F.trim(F.regexp_replace("line", r"^data:\s*", "")))
    known = body.where(F.col("line").startswith("{") | (F.col("line") == "[DONE]"))
    event = F.when(F.try_parse_json("line").isNotNull() & F.col("line").startswith("{"), F.from_json("line", schema))
    return known.select(key, "number", event.alias("event"), (F.col("line") == "[DONE]").alias("done")).where("done or event is not null")


def moving_average(rows: DataFrame, group: str, order: str, value: str, keep: float, start: float | None) -> DataFrame:
    """(group, average): keep * old + (1 - keep) * new in order; without ``start`` the first value seeds it.

    Some steps one behind another shrink what was before by one factor and add one sum, so ranges of a group's rows are
    composed wherever they lie.  Null values are left out.
    """
    def both(a: list, b: list) -> list:
        return [a[0] * b[0], a[1] * b[0] + b[1]]

    real = rows.where(F.col(value).isNotNull())
    steps = folded(real, group, order, [F.lit(keep), F.col(value) * (1 - keep)], both)
    p = F.col("parts")
    if start is not None:
        return steps.select(group, (F.lit(float(start)) * p[0] + p[1]).alias("average"))
    # A step from the first value to itself changes nothing.
    first = real.groupBy(group).agg(F.min_by(F.col(value).cast("double"), order).alias("_first"))
    return steps.join(first, steps[group].eqNullSafe(first[group])).select(steps[group], (F.col("_first") * p[0] + p[1]).alias("average"))


def breaker_states(calls: DataFrame, group: str, order: str, ok: Column, failures: int = 3) -> DataFrame:
    """Calls with ``open``: whether the ``failures`` calls up to each all failed."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(1 - failures, 0)
    return calls.withColumn("open", (F.count_if(~ok).over(w) == failures))


def budget_alert(percent: Column, thresholds: list[int]) -> Column:
    """The alert of the first threshold reached: critical from 100 %, warning from a threshold of 90, else info."""
    level = F.when(percent >= 100, "critical")
    for t in sorted(thresholds):
        level = level.when(percent >= t, "warning" if t >= 90 else "info")
    return level


def queue_counts(jobs: DataFrame, tries: str, ready_at: str, now: Column, most: int = 5) -> DataFrame:
    """(status, n) of a retry queue: failed after ``most`` tries, ready from their time on, else waiting."""
    status = F.when(F.col(tries) >= most, "failed").when(F.col(ready_at) <= now, "ready").otherwise("waiting")
    return jobs.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
