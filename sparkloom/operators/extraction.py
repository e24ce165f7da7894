"""Detection by vocabularies, parsers of semi-structured text, spelling with transpositions, budgets of sections."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from sparkloom.functions import text as T


def detected(text: Column, indicators: dict[str, tuple[list[str], list[str]]], full: float = 3.0, least: float = 0.3) -> Column:
    """The label whose strong (1.0) and weak (0.3) indicators a text holds most, with a confidence that is full at ``full``; other below ``least``.

    Of equal scores the first label by name.
    """
    low = F.lower(text)

    def held(words: list[str], weight: float) -> list[Column]:
        return [F.when(low.contains(w.lower()), weight).otherwise(0.0) for w in words]

    scores = []
    for k, (name, (strong, weak)) in enumerate(sorted(indicators.items())):
        total = reduce(lambda a, b: a + b, [*held(strong, 1.0), *held(weak, 0.3)], F.lit(0.0))
        scores.append(F.struct(total.alias("score"), F.lit(-k).alias("k"), F.lit(name).alias("label")))
    best = F.array_max(F.array(*scores))
    confidence = F.least(best["score"] / full, F.lit(1.0))
    return F.struct(F.when(confidence >= least, best["label"]).otherwise("other").alias("label"), F.round(confidence, 6).alias("confidence"))


def contexts(text: Column, keywords: dict[str, dict[str, float]], strong: float = 0.8, bonus: float = 0.5) -> Column:
    """(context, score) of every context, best first: weights of its whole words in the text, strong ones with a bonus."""
    low = F.lower(text)
    rows = []
    for name, words in sorted(keywords.items()):
        parts = [F.when(low.rlike(T.whole(w)), v + (bonus if v >= strong else 0.0)).otherwise(0.0) for w, v in words.items()]
        rows.append(F.struct((-F.round(reduce(lambda a, b: a + b, parts), 6)).alias("s"), F.lit(name).alias("name")))
    return F.transform(F.array_sort(F.array(*rows)), lambda r: F.struct(r["name"].alias("context"), (-r["s"]).alias("score")))


def attributes(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """For each category the different words of it that a text holds whole, in the order they come: one pattern a category."""
    low = F.lower(text)
    found = [F.array_distinct(F.regexp_extract_all(low, F.lit(T.whole(f"({'|'.join(w)})")), F.lit(1))).alias(c) for c, w in vocabulary.items()]
    return F.struct(*found)


def stat_block(text: Column) -> Column:
    """Armor class, hit points, speed, six abilities with modifiers and the challenge of a creature's block, null where absent."""
    def number(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")

    abilities = []
    for a in ("str", "dex", "con", "int", "wis", "cha"):
        score = number(rf"(?i)\b{a}\s+(\d+)")
        abilities += [score.alias(a), F.floor((score - 10) / 2).alias(f"{a}_mod")]
    return F.struct(number(r"(?i)armor class\s+(\d+)").alias("armor"), number(r"(?i)hit points\s+(\d+)").alias("hits"), number(r"(?i)speed\s+(\d+)").alias("speed"), *abilities, F.nullif(F.regexp_extract(text, r"(?i)challenge\s+(\d+(?:/\d+)?)", 1), F.lit("")).alias("challenge"))


def table_entries(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, low, high, entry, chance) of lines like ``3-5 something`` under a heading with NdS: the share of the N * S - N + 1 totals that a range spans."""
    n, s = (F.regexp_extract(text, r"(?i)\b(\d*)d(\d+)\b", k) for k in (1, 2))
    outcomes = F.coalesce(F.nullif(n, F.lit("")).cast("int"), F.lit(1)) * (s.cast("int") - 1) + 1
    lines = texts.select(key, outcomes.alias("outcomes"), F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").rlike(r"^\s*\d+\s*(?:[-–]\s*\d+)?[.:)]?\s+\S"))
    low = F.regexp_extract("line", r"^\s*(\d+)", 1).cast("int")
    high = F.coalesce(F.nullif(F.regexp_extract("line", r"^\s*\d+\s*[-–]\s*(\d+)", 1), F.lit("")).cast("int"), low)
    entry = F.regexp_extract("line", r"^\s*\d+\s*(?:[-–]\s*\d+)?[.:)]?\s+(.*)$", 1)
    return lines.select(key, low.alias("low"), high.alias("high"), entry.alias("entry"), ((high - low + 1) / F.col("outcomes")).alias("chance"))


def pages_by_marker(texts: DataFrame, key: str, text: str, marker: str, least: int = 50) -> DataFrame:
    """(key, page, part): what lies between markers, parts under ``least`` characters dropped."""
    return texts.select(key, F.posexplode(F.split(text, marker)).alias("page", "part")).withColumn("part", F.trim("part")).where(F.length("part") >= least)


def distance(a: str, b: str) -> int:
    """Edits from one string to the other, a swap of neighbours being one."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], before[j - 2] + 1)
        before, last = last, row
    return last[-1]


@F.pandas_udf(IntegerType())
def swap_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


#: How good a place is for a cut, which lies behind what the pattern takes.
BOUNDARIES = [
    ("section header", r"(?i)(?:^|\n)(?=(?:#{1,6}\s|(?:chapter|section|part|appendix)\b))", 0.95),
    ("blank line", r"\n\s*\n", 0.85),
    ("line of capitals", r"(?:^|\n)(?=[\p{Lu}][\p{Lu}\d '-]{3,}(?:\n|$))", 0.80),
    ("bullet", r"(?:^|\n)(?=\s*(?:[-*•]|\d+[.)])\s)", 0.70),
    ("sentence and capital", r"[.!?]\s+(?=\p{Lu})", 0.60),
    ("transition word", r"\s(?=(?:However|Therefore|Moreover|Furthermore|Meanwhile|Additionally|Consequently|Finally)\b)", 0.50),
    ("sentence", r"[.!?]\s", 0.40),
    ("clause", r"[,;:]\s", 0.20),
]


def best_splits(texts: DataFrame, key: str, text: str, target: int, window: int) -> DataFrame:
    """(key, kind, place, score): the best boundary around ``target``: its worth less 0.3 of its distance for the window's width.

    Texts shorter than the target have none; without a boundary the target itself is one, worth 0.1.
    """
    import regex

    patterns = [(k, name, regex.compile(p), v) for k, (name, p, v) in enumerate(BOUNDARIES)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not data or len(data) <= target:
                    continue
                best = (0.1, 0, "fallback", target)
                low, high = max(target - window, 0), min(target + window, len(data))
                for k, name, pattern, worth in patterns:
                    for m in pattern.finditer(data, low, high):
                        best = max(best, (round(worth - 0.3 * abs(m.end() - target) / window, 6), -k, name, m.end()))
                rows.append((i, best[2], best[3], best[0]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "kind", "place", "score"])

    return texts.select(F.col(key).cast("long"), F.col(text)).mapInArrow(find, "key long, kind string, place long, score double")


def section_budget(items: DataFrame, section: str, order: list[Column], size: str, section_cap: int, total_cap: int, rank: str) -> DataFrame:
    """Items up to each section's cap, then whole sections by ``rank`` up to the total cap."""
    inside = F.sum(size).over(Window.partitionBy(section).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    kept = items.withColumn("_r", inside).where(F.col("_r") <= section_cap).drop("_r")
    sums = kept.groupBy(section, rank).agg(F.sum(size).alias("_s"))
    running = sums.withColumn("_t", F.sum("_s").over(Window.orderBy(rank, section).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_t") <= total_cap)
    return kept.join(running.select(section), section, "left_semi")


def layered(layers: DataFrame, key: str, level: str, fields: list[str]) -> DataFrame:
    """For each key and field the value of the highest level that has one."""
    return layers.groupBy(key).agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(level))).alias(f) for f in fields))


def verified_share(claims: DataFrame, group: str, status: str) -> DataFrame:
    """Verified claims, and half of the derived ones, of all."""
    return claims.groupBy(group).agg((F.count_if(F.col(status) == "verified") + 0.5 * F.count_if(F.col(status) == "derived")).alias("good"), F.count("*").alias("n")).select(group, (F.col("good") / F.col("n")).alias("share"))


def appended(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, history): values in order as a JSON array."""
    return rows.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])).alias("history"))


def branched(turns: DataFrame, points: DataFrame, key: str, order: str, upto: str) -> DataFrame:
    """The turns of each thread up to, with, its branch point (key, upto), as a new thread starts with them."""
    return turns.join(points, key).where(F.col(order) <= F.col(upto)).drop(upto)
