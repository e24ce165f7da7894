"""Queries as text: dictionaries, corrections, expansions, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators.extraction import swap_distance
from sparkloom.operators.search_index import deletions


def dictionary(words: DataFrame, least: int = 2) -> DataFrame:
    """(word, n) of words of two characters and more that aren't numbers and come ``least`` times."""
    each = words.select(F.explode("words").alias("word")).where((F.length("word") >= 2) & ~F.col("word").rlike(r"^\p{N}+$"))
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def bigrams(words: DataFrame, least: int = 2) -> DataFrame:
    """(pair, n) of neighbouring words of one text."""
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return words.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def corrections(queries: DataFrame, known: DataFrame, swaps: bool = False) -> DataFrame:
    """(word, best, distance) of words of five letters and more that the dictionary (word, n) lacks.

    Words under nine letters may have one edit, others two; with ``swaps`` two
    neighbouring letters that changed places are one edit.  Candidates share a
    deletion: both sides are listed under what is left when up to two letters
    are taken out, and joined on that, so no word meets the whole dictionary.
    """
    unknown = queries.select("word").distinct().where(F.length("word") >= 5).join(known.select("word"), "word", "left_anti")
    listed = known.select(F.col("word").alias("best"), "n").where(F.length("best") >= 4)
    pairs = deletions(unknown, "word", 7).join(deletions(listed, "best", 7), "_left").select("word", "best", "n").distinct()
    distance = swap_distance("word", "best") if swaps else F.levenshtein("word", "best")
    near = pairs.withColumn("distance", distance).where(F.col("distance") <= F.when(F.length("word") < 9, 1).otherwise(2))
    first = F.row_number().over(Window.partitionBy("word").orderBy("distance", F.desc("n"), "best"))
    return near.withColumn("_k", first).where("_k = 1").select("word", "best", "distance")


def alike(words: DataFrame, least: float) -> DataFrame:
    """(a, b, likeness) of different words (word), a before b, whose likeness is ``least`` or more; null words are like none.

    The longer word of a pair, in bytes, allows d edits.  Cut into d + 1 parts, it
    has one that stands whole in the other word, the part number i at most i places
    away seen from the left end and d - i seen from the right one (Pass-Join): both
    sides are listed under these parts and joined.  A word whose edits are as many as
    its characters has empty parts, and meets all words of about its length.
    """
    each = words.select("word").where("word is not null").distinct().withColumn("m", F.char_length("word"))
    long = each.select(F.col("word").alias("a"), F.col("m").alias("n"), F.floor((1 - least) * F.octet_length("word") + 1e-9).cast("int").alias("d")).where("d > 0")
    shapes = long.select("n", "d").distinct().select("n", "d", F.explode(F.sequence(F.greatest(F.expr("n - d"), F.lit(0)), F.expr("n + d"))).alias("m"))
    start, end = F.expr("i * n div (d + 1)"), F.expr("(i + 1) * n div (d + 1)")

    def parts(rows: DataFrame) -> DataFrame:
        return rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d")))).withColumn("start", start.cast("int")).withColumn("size", (end - F.col("start")).cast("int"))

    one = parts(long).select("n", "d", "i", F.expr("substring(a, start + 1, size)").alias("part"), "a")
    two = parts(each.withColumnRenamed("word", "b").join(shapes, "m"))
    low = F.expr("greatest(start - i, start + m - n - (d - i), 0)")
    high = F.expr("least(start + i, start + m - n + (d - i), m - size)")
    two = two.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("p", F.explode(F.sequence("low", "high")))
    two = two.select("n", "d", "i", F.expr("substring(b, p + 1, size)").alias("part"), "b").distinct()
    met = one.join(two, ["n", "d", "i", "part"]).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return met.withColumn("likeness", similarity(F.col("a"), F.col("b"))).where(F.col("likeness") >= least)


def expanded(queries: DataFrame, synonyms: DataFrame, most: int = 5) -> DataFrame:
    """Queries (id, words) as groups: (id, place, terms), each word with at most ``most`` synonyms (word, synonym, priority)."""
    each = queries.select("id", F.posexplode("words").alias("place", "word"))
    top = synonyms.withColumn("_k", F.row_number().over(Window.partitionBy("word").orderBy("priority", "synonym"))).where(F.col("_k") <= most)
    lists = top.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "synonym"))), lambda s: s["synonym"]).alias("others"))
    return each.join(F.broadcast(lists) if lists.isStreaming else lists, "word", "left").select("id", "place", F.array_distinct(F.concat(F.array("word"), F.coalesce("others", F.array().cast("array<string>")))).alias("terms"))


def weights(word: Column, domain: list[str], known: Column) -> Column:
    """Weight of a query term: 1.5 of the domain, 1.2 known, else 1."""
    return F.when(word.isin(domain), 1.5).when(known, 1.2).otherwise(1.0)


def constraints(query: Column) -> Column:
    """What a query asks for, as a struct: quoted phrases, negated words, a range of levels, and what is left to search."""
    quoted = F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1))
    negated = F.regexp_extract_all(F.lower(query), F.lit(r"\b(?:not|without|except|exclude)\s+(\w+)"), F.lit(1))
    span = r"(?i)levels?\s+(\d+)\s*(?:-|to)\s*(\d+)"
    low, high = (F.nullif(F.regexp_extract(query, span, k), F.lit("")).cast("int") for k in (1, 2))
    rest = T.normalised(F.regexp_replace(F.regexp_replace(F.regexp_replace(query, '"[^"]*"', " "), r"(?i)\b(?:not|without|except|exclude)\s+\w+", " "), span, " "))
    return F.struct(quoted.alias("quoted"), negated.alias("negated"), low.alias("low"), high.alias("high"), rest.alias("rest"))


#: Words of a bound of challenge or level in a query.
_NEGATED = r"(?i)\b(?:not|without|except|exclude)\s+(\w+)"
_CHALLENGE = r"(?i)\b(?:cr|challenge(?:\s+rating)?)\s+(\d+(?:/[1-9]\d*)?)(?:\s*(?:-|to)\s*(\d+(?:/[1-9]\d*)?))?"
_LEVEL = r"(?i)\blevels?\s+(\d+)(?:\s*(?:-|to)\s*(\d+))?"


def asked_for(query: Column, vocabulary: dict[str, list[str]], opposites: dict[str, list[str]]) -> Column:
    """All that a query asks for, as a struct.

    ``quoted`` phrases, ``negated`` words, bounds of ``challenge`` (fractions too) and
    ``level`` as structs of low and high, equal for a single value, null where not named;
    ``attributes``: (category, value) of the vocabulary's words that stand whole in it, by
    category and the vocabulary's order; ``rest``: the query without negations and bounds, quoted
    phrases kept; ``expanded``: the rest with the opposites of its attributes ruled out.
    A null query asks for nothing: its fields are empty or null.
    """
    q = F.coalesce(query, F.lit(""))

    def bound(pattern: str, number) -> Column:
        first, last = (F.nullif(F.regexp_extract(q, pattern, k), F.lit("")) for k in (1, 2))
        return F.when(first.isNotNull(), F.struct(number(first).alias("low"), number(F.coalesce(last, first)).alias("high")))

    def fraction(c: Column) -> Column:
        return F.split_part(c, F.lit("/"), F.lit(1)).try_cast("double") / F.coalesce(F.nullif(F.split_part(c, F.lit("/"), F.lit(2)), F.lit("")).try_cast("double"), F.lit(1.0))

    low = F.lower(q)
    none = F.array().cast("array<struct<category:string,value:string>>")
    found = [F.when(low.rlike(rf"(?<!\w)\Q{v.lower()}\E(?!\w)"), F.array(F.struct(F.lit(c).alias("category"), F.lit(v).alias("value")))).otherwise(none) for c, words in vocabulary.items() for v in dict.fromkeys(words)]
    attributes = F.concat(none, *found)
    rest = q
    for pattern, put in ((_NEGATED, " "), (_CHALLENGE, " "), (_LEVEL, " "), ('"([^"]+)"', "$1")):
        rest = F.regexp_replace(rest, pattern, put)
    rest = F.trim(F.regexp_replace(rest, r"\s+", " "))
    against = F.create_map(*(x for k, v in sorted(opposites.items()) for x in (F.lit(k), F.array(*map(F.lit, v))))) if opposites else None
    out = F.flatten(F.transform(attributes, lambda a: F.coalesce(against[a["value"]] if against is not None else None, F.array().cast("array<string>")))) if opposites else F.array().cast("array<string>")
    return F.struct(
        F.regexp_extract_all(q, F.lit('"([^"]+)"'), F.lit(1)).alias("quoted"),
        F.transform(F.regexp_extract_all(q, F.lit(_NEGATED), F.lit(1)), F.lower).alias("negated"),
        bound(_CHALLENGE, fraction).alias("challenge"),
        bound(_LEVEL, lambda c: c.try_cast("int")).alias("level"),
        attributes.alias("attributes"),
        rest.alias("rest"),
        F.concat_ws(" ", rest, F.transform(out, lambda w: F.concat(F.lit("(NOT "), w, F.lit(")")))).alias("expanded"),
    )


def similarity(a: Column, b: Column) -> Column:
    """One less the edit distance for each byte of the longer string."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.octet_length(a), F.octet_length(b))


def validation(text: Column, most: int) -> Column:
    """null for a text that may be used, else what is wrong with it."""
    return F.when(text.contains("\0"), "nul").when(F.length(text) > most, "too long").when(F.lower(text).rlike(r"<script|javascript:|on\w+\s*="), "markup")


def sanitised(text: Column, most: int) -> Column:
    """What ``validation`` finds and, for a text that may be used, the text with the signs of markup written as entities, and whether that changed it: a struct (problem, text, changed); all null for a null text."""
    out = text
    # Entities of the five signs.
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    problem = validation(text, most)
    kept = F.when(problem.isNull(), out)
    return F.struct(problem.alias("problem"), kept.alias("text"), (kept != text).alias("changed"))


def compounds(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, split) of words that are two words run together, by the commonest pair (pair, n) of words that gives them; of equal ones the first by name."""
    joined = pairs.select(F.replace("pair", F.lit(" "), F.lit("")).alias("word"), F.struct((-F.col("n")).alias("n"), "pair").alias("p"))
    return words.select("word").join(joined, "word").groupBy("word").agg(F.min("p")["pair"].alias("split"))


def variants(words: Column, abbreviations: dict[str, str], synonyms: dict[str, list[str]]) -> Column:
    """The terms of a query without stop words: each word, what it abbreviates or is abbreviated to, and its synonyms, every term once where it first stands."""
    other: dict[str, list[str]] = {}
    for short, long in abbreviations.items():
        other.setdefault(short, []).append(long)
        other.setdefault(long, []).append(short)
    for word, same in synonyms.items():
        other.setdefault(word, []).extend(same)
    none = F.array().cast("array<string>")
    known = F.create_map(*(x for k, v in other.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if other else None
    each = F.transform(T.without_stop_words(words), lambda w: F.concat(F.array(w), F.coalesce(known[w], none) if other else none))
    return F.array_distinct(F.flatten(each))


def prepared(queries: DataFrame, known: DataFrame, synonyms: DataFrame, most: int = 5) -> DataFrame:
    """(id, corrected, expanded) of raw queries (id, query): normalised and corrected by the dictionary (word, n), for the vector; and with each word's synonyms as ``(a OR b) AND c``, for full text.

    Words are corrected together: each different one once, whatever the number of queries.
    """
    each = queries.select("id", F.posexplode(F.split(T.normalised(F.col("query")), " ")).alias("place", "word")).where("word != ''")
    fixed = corrections(each, known).select("word", "best")
    right = each.join(fixed, "word", "left").select("id", "place", F.coalesce("best", "word").alias("word"))
    top = synonyms.withColumn("_k", F.row_number().over(Window.partitionBy("word").orderBy("priority", "synonym"))).where(F.col("_k") <= most)
    lists = top.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "synonym"))), lambda s: s["synonym"]).alias("others"))
    terms = right.join(lists, "word", "left").withColumn("term", F.when(F.col("others").isNull(), F.col("word")).otherwise(F.concat(F.lit("("), F.concat_ws(" OR ", F.array("word"), "others"), F.lit(")"))))
    ordered = terms.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "word", "term"))).alias("_t"))
    return ordered.select("id", F.concat_ws(" ", "_t.word").alias("corrected"), F.concat_ws(" AND ", "_t.term").alias("expanded"))
