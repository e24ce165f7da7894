"""Terms of a vocabulary and references to parts of a book, found with their places in one pass over the texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.operators.scan import scanned
from sparkloom.operators.spans import Greedy

#: Bytes of the terms that one automaton holds; a larger vocabulary is dealt out to several, each with a pass of its own.
VOCABULARY_BYTES = 8 << 20

#: Rows of a batch that a task gives.
OUT_ROWS = 4096

#: Texts whose references a task keeps for when they come again, and characters of the longest one.
KEPT_TEXTS, KEPT_LENGTH = 4096, 300


class _Named(Greedy):
    """Spans that are kept, with what belongs to them."""

    def take(self, start, end, confidence, *more) -> list[tuple]:
        return [(*kept, *more) for kept in super().take(start, end, confidence)]


def _lower(text: str) -> str:
    """In lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _parts(vocabulary: DataFrame, most: int) -> Iterator[list[tuple]]:
    """Entries by hash of the term, each part of about ``most`` bytes, so that the driver and a task hold one at a time."""
    size = vocabulary.agg(F.sum(F.octet_length("term") + F.octet_length("label") + 16)).first()[0] or 0
    n = -(-size // most)
    for k in range(n):
        yield [tuple(r) for r in vocabulary.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k).collect()]


def mentions(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, most: int = VOCABULARY_BYTES) -> DataFrame:
    """(key, start, end, confidence, term, label): where terms of a vocabulary (term, label, confidence) stand whole in texts, whatever their case.

    No letter, digit or low line may touch a term.  Of mentions that overlap the most
    confident one is kept, of equal ones the longest, then the first, then the first label
    by name.  A task matches all terms of a part of the vocabulary by one automaton, in one
    pass of each text whatever the number of terms; overlaps are settled by a sorted pass
    over the mentions alone.  Null and empty texts and terms have none.  Places are those of
    the text of one row: keys should be unique.
    """
    words = vocabulary.select(F.lower("term").alias("term"), F.col("label").cast("string").alias("label"), F.col("confidence").cast("double").alias("confidence"))
    words = words.where((F.col("term") != "") & F.col("label").isNotNull() & F.col("confidence").isNotNull()).groupBy("term", "label").agg(F.max("confidence").alias("confidence"))
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = [_matched(rows, part) for part in _parts(words, most)] or [_matched(rows.limit(0), [])]
    every = reduce(DataFrame.unionByName, found).withColumn("_order", -F.col("confidence")).withColumn("_long", F.col("start") - F.col("end"))
    kept = scanned(every, ["key"], ["_order", "_long", "start", "label"], ["start", "end", "confidence", "term", "label"], _Named, "start long, end long, confidence double, term string, label string")
    return kept.withColumnRenamed("key", key)


def _matched(rows: DataFrame, entries: list[tuple]) -> DataFrame:
    """All mentions of some entries, overlaps with them."""
    schema = StructType([rows.schema["key"], *StructType.fromDDL("start long, end long, confidence double, term string, label string").fields])
    shared = rows.sparkSession.sparkContext.broadcast(entries)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        of: dict[str, list[tuple]] = {}
        for term, label, confidence in shared.value:
            of.setdefault(_lower(term), []).append((confidence, term, label))
        automaton = ahocorasick.Automaton()
        for term, named in of.items():
            automaton.add_word(term, (len(term), named))
        automaton.make_automaton()
        out: list[tuple] = []
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not data or not of:
                    continue
                low = _lower(data)
                for last, (length, named) in automaton.iter(low):
                    start, end = last + 1 - length, last + 1
                    if _word(low, start - 1) or _word(low, end):
                        continue
                    out += [(k, start, end, *n) for n in named]
                while len(out) >= OUT_ROWS:
                    yield _batch(out[:OUT_ROWS], arrow)
                    out = out[OUT_ROWS:]
        if out:
            yield _batch(out, arrow)

    return rows.mapInArrow(find, schema)


def _word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)


#: Words that name a part of a book, by kind.
KINDS = {
    "page": ("page", "pages", "p.", "pp."),
    "chapter": ("chapter", "chapters", "ch."),
    "section": ("section", "sections", "sec."),
    "table": ("table", "tables", "tbl.", "tbl"),
    "figure": ("figure", "figures", "fig.", "figs.", "fig"),
    "appendix": ("appendix", "appendices", "app."),
}
#: Words before a reference that leave no doubt.
LEADS = ("see", "refer to", "on", "at", "in", "from", "use", "consult", "roll on", "shown in", "described in")
#: How sure a reference is with such a word, abbreviated, and bare.
SURE, SHORT, BARE = 0.95, 0.9, 0.85

_KIND_OF = {w: kind for kind, words in KINDS.items() for w in words}
_NUMBER = r"\d+(?:\s*[-–]\s*\d+|(?:\.\d+)+)?"
_REFERENCE = re.compile(
    rf"(?<!\w)(?P<lead>(?:{'|'.join(w.replace(' ', chr(92) + 's+') for w in LEADS)})\s+(?:the\s+)?)?"
    rf"(?P<kind>{'|'.join(re.escape(w) for w in sorted(_KIND_OF, key=len, reverse=True))})\s*"
    rf"(?:[\"“](?P<name>[^\"“”\n]{{3,80}})[\"”]|(?P<list>{_NUMBER}(?:\s*(?:,|and|&)\s*{_NUMBER})*)(?!\w)|(?<=\s)(?P<letters>(?-i:[IVXLCDM]+|[A-Z]))(?![\w.]\w|\w))",
    re.IGNORECASE,
)
_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman(letters: str) -> int | None:
    """The number of roman numerals as they are written today, else null."""
    values = [_ROMAN[c] for c in letters]
    total = sum(-v if any(w > v for w in values[k + 1 : k + 2]) else v for k, v in enumerate(values))
    left, out = total, ""
    for v, s in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += s * (left // v)
        left %= v
    return total if out == letters else None


def references_in(text: str) -> list[tuple]:
    """(kind, target, low, high, confidence, start, end) in the order of the text."""
    out = []
    for m in _REFERENCE.finditer(text):
        word = m["kind"].lower()
        kind = _KIND_OF[word]
        sure = SURE if m["lead"] else SHORT if word.endswith(".") or len(word) == 3 else BARE
        at = (sure, m.start(), m.end())
        if m["name"]:
            out.append((kind, m["name"].strip(), None, None, *at))
        elif m["letters"]:
            number = roman(m["letters"]) if set(m["letters"]) <= _ROMAN.keys() else None
            if kind == "appendix" and len(m["letters"]) == 1:
                out.append((kind, m["letters"], None, None, *at))
            elif number is not None:
                out.append((kind, m["letters"], number, number, *at))
        else:
            for target in re.findall(_NUMBER, m["list"]):
                target = re.sub(r"\s*[-–]\s*", "-", target)
                ends = target.split("-")
                low, high = int(ends[0].split(".")[0]), int(ends[-1].split(".")[0])
                # Of tables and figures 4-1 is a name, of the others a range.
                whole = target.isdigit() or len(ends) == 2 and kind not in ("table", "figure") and low <= high
                # Numbers of more than 18 digits have no range.
                whole = whole and max(map(len, ends)) <= 18
                out.append((kind, target, low if whole else None, high if whole else None, *at))
    return out


def _read(text: str, known: dict[str, list[tuple]], least: float) -> list[tuple]:
    """The references of a text that are sure enough, from those a task has read before if it is among them."""
    found = known.get(text)
    if found is None:
        found = [r for r in references_in(text) if r[4] >= least]
        if len(text) <= KEPT_LENGTH:
            if len(known) == KEPT_TEXTS:
                known.clear()
            known[text] = found
    return found


def references(texts: DataFrame, key: str, text: str, least: float = 0.0) -> DataFrame:
    """(key, kind, target, low, high, confidence, start, end) of references to pages, chapters, sections, tables, figures and appendices in texts.

    Abbreviations, quoted names, roman numerals, ranges and lists are read; ``low`` and
    ``high`` are numbers where the target is a number or a range.  A list gives a row for
    each of its numbers, at one place.  References don't overlap.  Null and empty texts have none.
    A text that many rows of a batch have, or, if short, that came before in the task, is read once.
    """
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = StructType([rows.schema["key"], *StructType.fromDDL("kind string, target string, low long, high long, confidence double, start long, end long").fields])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        parts = pa.schema(list(arrow)[1:])
        known: dict[str, list[tuple]] = {}
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            each = [_read(t, known, least) for t in coded.dictionary.to_pylist()]
            made = [r for found in each for r in found]
            if not made:
                continue
            # The references of each text once, then one copy for each row that has it.
            table = _batch(made, parts)
            counts = np.array([len(found) for found in each])
            rows = np.flatnonzero(coded.indices.is_valid().to_numpy(zero_copy_only=False))
            code = coded.indices.drop_null().to_numpy()
            n = counts[code]
            first = np.cumsum(counts)[code] - np.cumsum(n)
            of, at = np.repeat(rows, n), np.arange(n.sum()) + np.repeat(first, n)
            for low in range(0, len(at), OUT_ROWS):
                end = low + OUT_ROWS
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[low:end])), *table.take(pa.array(at[low:end])).columns], schema=arrow)

    return rows.mapInArrow(find, schema).withColumnRenamed("key", key)
