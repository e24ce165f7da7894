"""Full text, nearest neighbours, fusion, re-ranking and context.

Ties are broken by id everywhere, so results are the same on every run.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators.search_index import K1, B, SearchIndex

#: The constant of reciprocal rank fusion.
RRF_K = 60


@dataclass(frozen=True)
class Hybrid:
    """Weights of the two sides, results wanted, least score."""

    semantic: float = 0.6
    keyword: float = 0.4
    limit: int = 20
    least: float = 0.1

    @staticmethod
    def by_ratio(ratio: float) -> Hybrid:
        r = min(max(ratio, 0.0), 1.0)
        return Hybrid(r, 1 - r)


#: Presets by kind of content.
PRESETS = {"rules": Hybrid(0.4, 0.6, 15, 0.15), "lore": Hybrid(0.7, 0.3, 10, 0.1), "notes": Hybrid(0.5, 0.5, 20, 0.05)}


def bm25(words: DataFrame, terms: list[str], every: bool = False) -> DataFrame:
    """(id, score) of documents that hold any, or every, term.

    Only the terms asked for are counted: their frequencies come from each
    document's own array, and the corpus statistics from one aggregation.
    """
    def times(term: str) -> Column:
        return F.size(F.filter("words", lambda w: w == term))

    tf = [times(t) for t in terms]
    rows = words.select("id", F.size("words").alias("size"), *(c.alias(f"tf{k}") for k, c in enumerate(tf)))
    stats = rows.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))))

    def part(k: int) -> Column:
        idf = F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        f = F.col(f"tf{k}")
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.col("mean")))

    hit = F.lit(every)
    for k in range(len(terms)):
        hit = hit & (F.col(f"tf{k}") > 0) if every else hit | (F.col(f"tf{k}") > 0)
    return rows.where(hit).crossJoin(F.broadcast(stats)).select("id", sum((part(k) for k in range(1, len(terms))), part(0)).alias("score"))


def highlighted(text: Column, terms: list[str], start: str, end: str) -> Column:
    return F.regexp_replace(text, r"(?i)(?<![A-Za-z0-9_])(" + "|".join(terms) + r")(?![A-Za-z0-9_])", f"{start}$1{end}")


def nearest(vectors: DataFrame, key: str, column: str, query: Column, limit: int, where: Column | None = None) -> DataFrame:
    """(id, distance): the rows with the least cosine distance, filtered before they are ranked."""
    rows = vectors if where is None else vectors.where(where)
    return rows.select(F.col(key).alias("id"), (1 - T.cosine(F.col(column), query)).alias("distance")).orderBy("distance", "id").limit(limit)


def min_max(rows: DataFrame, score: str) -> DataFrame:
    """Scores from 0 to 1; 1 if all are equal.  For result lists, which are short."""
    w = Window.partitionBy()
    low, high = F.min(score).over(w), F.max(score).over(w)
    return rows.withColumn(score, F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(1.0))


def linear_fusion(near: DataFrame, found: DataFrame, by: Hybrid) -> DataFrame:
    """(id, score) of near neighbours (id, distance) and full-text hits (id, score): similarities 1 - d / 2 and scores, each from 0 to 1, weighted; an absent one is 0."""
    a = min_max(near.select("id", (1 - F.col("distance") / 2).alias("s")), "s")
    b = min_max(found.select("id", F.col("score").alias("t")), "t")
    score = by.semantic * F.coalesce("s", F.lit(0.0)) + by.keyword * F.coalesce("t", F.lit(0.0))
    return a.join(b, "id", "full_outer").select("id", score.alias("score")).where(F.col("score") >= by.least).orderBy(F.desc("score"), "id").limit(by.limit)


def preprocessed(index: SearchIndex, vectors: DataFrame, key: str, column: str, raw: str, embed: Callable[[str], DataFrame], synonyms: dict[str, list[str]], by: Hybrid, most: int = 5) -> DataFrame:
    """(id, score): hybrid search of a raw query.

    It is normalised and its words are corrected by the index's dictionary.  The corrected text goes to the vector side by ``embed``, a table
    of one row (asked); each word with at most ``most`` synonyms is a group, and full text must hold a term of every group.  Each side gives
    three times the results wanted, and both are fused by weight.
    """
    words = index.corrected(re.sub(r"\s+", " ", raw).strip().lower().split(" "))
    near = nearest(vectors.crossJoin(embed(" ".join(words))), key, column, F.col("asked"), 3 * by.limit)
    groups = [[w, *synonyms.get(w, [])[:most]] for w in words if w]
    found = index.ranked(groups, [], [], 3 * by.limit, window=None)
    return linear_fusion(near, found, by)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Result lists with ``rank`` from 0."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def rank_fusion(lists: list[tuple[float, DataFrame]], limit: int, least: float = 0.0, k: int = RRF_K) -> DataFrame:
    """(id, score, sources) of ranked lists (id, rank): the sum of weight / (k + rank + 1), divided by the best; ``least`` holds before the division."""
    both = None
    for n, (weight, rows) in enumerate(lists):
        one = rows.select("id", (F.lit(weight) / (k + F.col("rank") + 1)).alias("part"), F.lit(n).alias("source"))
        both = one if both is None else both.unionByName(one)
    sums = both.groupBy("id").agg(F.sum("part").alias("raw"), F.count_distinct("source").alias("sources")).where(F.col("raw") >= least)
    return sums.select("id", (F.col("raw") / F.max("raw").over(Window.partitionBy())).alias("score"), "sources").orderBy(F.desc("score"), "id").limit(limit)


def reranked(rows: DataFrame, required: list[str], excluded: list[str], opposites: list[tuple[str, str]]) -> DataFrame:
    """Rows (id, semantic, keyword, attributes) by 0.6 semantic + 0.4 keyword + 0.2 share of required attributes, less for each opposite; rows with an excluded attribute come last."""
    held = F.col("attributes")
    share = F.size(F.array_intersect(held, F.array(*map(F.lit, required)))) / max(len(required), 1) if required else F.lit(0.0)
    clashes = sum((F.when(F.array_contains(held, b), 1).otherwise(0) for a, b in opposites if a in required), F.lit(0))
    penalty = F.when(clashes == 0, 1.0).when(clashes == 1, 0.5).when(clashes == 2, 0.25).otherwise(0.1)
    veto = F.arrays_overlap(held, F.array(*map(F.lit, excluded))) if excluded else F.lit(False)
    score = (0.6 * F.col("semantic") + 0.4 * F.col("keyword") + 0.2 * share) * penalty
    return rows.select("id", score.alias("score"), veto.alias("vetoed")).orderBy("vetoed", F.desc("score"), "id")


def context(rows: DataFrame, order: list[Column], label: Column, text: Column, budget: int) -> DataFrame:
    """Results as numbered passages up to, without, the first that goes over the byte budget: (id, number, passage).

    A passage has five bytes at least, so that many rows at most are looked at, and are numbered in one task.
    """
    rows = rows.orderBy(*order).limit(budget // 5 + 1)
    number = F.row_number().over(Window.orderBy(*order))
    numbered = rows.withColumn("number", number).withColumn("passage", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), label, F.lit("\n"), text))
    running = F.sum(F.octet_length("passage")).over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("used", running).where(F.col("used") <= budget).select("id", "number", "passage")


def routed(kind: Column) -> Column:
    """The index that a kind of source belongs to."""
    return F.when(kind.isin("rules", "rulebook"), "rules").when(kind.isin("fiction", "lore"), "fiction").when(kind.isin("chat", "session"), "chat").otherwise("documents")


def missing_vectors(texts: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Different texts whose hash isn't in the cache of vectors."""
    return texts.join(cache.select(key), key, "left_anti").dropDuplicates([key])
