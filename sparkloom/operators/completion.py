"""Completions of words that are being typed, and queries explained: corrected, expanded, with hints and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators.querytext import corrections
from sparkloom.operators.search_index import Sorted


class Completions:
    """Words of a dictionary (word, n), stored for completion.

    The best words of each prefix up to ``deep`` letters are a row; other words are
    sorted by their first ``deep`` letters, so that a longer prefix reads a part of those
    that share them.
    """

    def __init__(self, known: DataFrame, deep: int = 4, most: int = 10) -> None:
        self.deep, self.most = deep, most
        words = known.where(F.col("word") != "").groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
        heads = words.withColumn("head", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(deep))), lambda k: F.substring("word", F.lit(1), k))))
        # The limit is applied in each task before words of one letter meet.
        best = heads.withColumn("rank", F.row_number().over(Window.partitionBy("head").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= most)
        self.short = Sorted(best, "head", [], ["rank"], best.count(), "completions")
        long = words.where(F.length("word") > deep).withColumn("head", F.substring("word", 1, deep))
        self.long = Sorted(long, "head", [], ["word"], long.count(), "completion-words")

    def of(self, prefix: str, k: int = 10, first: list[str] | None = None) -> DataFrame:
        """(word, rank) of at most ``k`` words that start so, the commonest first, of equal ones by name.

        Words or phrases of ``first`` (such as belong to the context) that start so come
        before all others, in their own order.
        """
        self._check(k)
        low = prefix.lower()
        ours = list(dict.fromkeys(w.lower() for w in first or [] if w.lower().startswith(low)))[:k] if low else []
        rows = self.short.of([low]) if len(low) <= self.deep else self.long.of([low[: self.deep]]).where(F.col("word").startswith(low))
        others = rows.where(~F.col("word").isin(ours)).orderBy(F.desc("n"), "word").limit(k - len(ours)).select("word", "n")
        rank = F.row_number().over(Window.orderBy("_own", F.desc("n"), "word")).alias("rank")
        spark = rows.sparkSession
        mine = spark.createDataFrame([(w, 0, j) for j, w in enumerate(ours)], "word string, n long, _own int")
        return mine.unionByName(others.withColumn("_own", F.lit(len(ours)))).select("word", rank)

    def completed(self, partials: DataFrame, k: int = 10) -> DataFrame:
        """(partial, word, rank) of the different values of ``partial``, each with at most ``k`` words as above."""
        self._check(k)
        asked = partials.where(F.col("partial") != "").select("partial", F.lower("partial").alias("_low")).distinct()
        few, many = F.length("_low") <= self.deep, F.length("_low") > self.deep
        short = asked.where(few).join(self.short.rows().where(F.col("rank") <= k), F.col("_low") == F.col("head")).select("partial", "word", "rank")
        met = asked.where(many).withColumn("head", F.substring("_low", 1, self.deep)).join(self.long.rows(), "head").where(F.col("word").startswith(F.col("_low")))
        long = met.withColumn("rank", F.row_number().over(Window.partitionBy("partial").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= k)
        return short.unionByName(long.select("partial", "word", "rank"))

    def _check(self, k: int) -> None:
        if not 0 < k <= self.most:
            raise ValueError(f"k must be from 1 to {self.most}, for which the completions were stored")


def _map(entries: dict, value) -> Column | None:
    return F.create_map(*(x for k, v in sorted(entries.items()) for x in (F.lit(k), value(v)))) if entries else None


def enhanced(queries: DataFrame, known: DataFrame, synonyms: DataFrame, abbreviations: dict[str, str], ambiguous: dict[str, list[str]], most: int = 5) -> DataFrame:
    """(id, corrected, corrections, expanded, hints, clarification, enhanced) of raw queries (id, query).

    ``corrections`` are structs of a word, its nearest in the dictionary (word, n) and the
    distance; abbreviations, and words with more than one meaning, aren't corrected.
    ``expanded`` has each word with what it abbreviates and its synonyms (word, synonym,
    priority) as ``(a OR b) AND c``.  ``hints`` are structs of a kind (correction,
    abbreviation, synonym, context) and a text, in this order; ``clarification`` is the
    first word of more than one meaning with its options, or null.  A query without words
    has empty fields.
    """
    lower = F.split(T.normalised(F.col("query")), " ")
    each = queries.select("id", F.posexplode(F.filter(lower, lambda w: w != "")).alias("place", "word"))
    short, many = _map(abbreviations, F.lit), _map(ambiguous, lambda v: F.array(*map(F.lit, v)))
    fixed = corrections(each.where(~F.col("word").isin([*abbreviations, *ambiguous])), known).select("word", "best", "distance")
    right = each.join(fixed, "word", "left").withColumn("right", F.coalesce("best", "word"))
    top = synonyms.withColumn("_k", F.row_number().over(Window.partitionBy("word").orderBy("priority", "synonym"))).where(F.col("_k") <= most)
    lists = top.groupBy(F.col("word").alias("right")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "synonym"))), lambda s: s["synonym"]).alias("others"))
    none = F.array().cast("array<string>")
    terms = right.join(lists, "right", "left").withColumn("long", short[F.col("right")] if short is not None else F.lit(None).cast("string"))
    terms = terms.withColumn("others", F.coalesce("others", none)).withColumn("same", F.array_distinct(F.concat(F.array("right"), F.array_compact(F.array("long")), "others")))
    fields = F.struct("place", "word", "best", "distance", "right", "long", "others", "same")
    ordered = terms.groupBy("id").agg(F.array_sort(F.collect_list(fields)).alias("_t"))
    t = F.col("_t")
    wrong, cut, alike = F.filter(t, lambda x: x["best"].isNotNull()), F.filter(t, lambda x: x["long"].isNotNull()), F.filter(t, lambda x: F.size(x["others"]) > 0)
    group = F.transform(t, lambda x: F.when(F.size(x["same"]) > 1, F.concat(F.lit("("), F.array_join(x["same"], " OR "), F.lit(")"))).otherwise(x["right"]))
    unclear = F.filter(t, lambda x: F.map_contains_key(many, x["word"])) if many is not None else F.filter(t, lambda x: F.lit(False))

    def hint(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    hints = F.concat(
        F.transform(wrong, lambda x: hint("correction", F.concat(x["word"], F.lit(" -> "), x["best"]))),
        F.transform(cut, lambda x: hint("abbreviation", F.concat(x["right"], F.lit(": "), x["long"]))),
        F.transform(alike, lambda x: hint("synonym", F.concat(x["right"], F.lit(": "), F.array_join(x["others"], ", ")))),
        F.transform(unclear, lambda x: hint("context", x["word"])),
    )
    options = many[unclear[0]["word"]] if many is not None else none
    out = queries.select("id").join(ordered, "id", "left").withColumn("_t", F.coalesce("_t", F.expr("cast(array() as " + ordered.schema["_t"].dataType.simpleString() + ")")))
    return out.select(
        "id",
        F.array_join(F.transform(t, lambda x: x["right"]), " ").alias("corrected"),
        F.transform(wrong, lambda x: F.struct(x["word"].alias("word"), x["best"].alias("best"), x["distance"].alias("distance"))).alias("corrections"),
        F.array_join(group, " AND ").alias("expanded"),
        hints.alias("hints"),
        F.when(F.size(unclear) > 0, F.struct(F.get(F.transform(unclear, lambda x: x["word"]), F.lit(0)).alias("word"), options.alias("options"))).alias("clarification"),
        (F.size(hints) > 0).alias("enhanced"),
    )
