"""Documents: pages of HTML, sentences, chunks with provenance, classification and extraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.functions import text as T
from sparkloom.operators.scan import Machine, scanned


def page_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags out, five entities read, white space one space."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def page_title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1), F.lit(""))


def page_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))


# Abbreviations that end no sentence.
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "Inc", "Ltd", "Corp", "Co", "vs", "etc", "e.g", "i.e", "St", "Ave", "Rd", "Blvd", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def sentences(text: Column) -> Column:
    """Sentences: cut behind . ! ? before white space, unless an abbreviation or a single capital stands there."""
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    cut = F.split(text, rf"(?<=[.!?])(?<!(?:{short})\.)(?<!(?:^|\s)\p{{Lu}}\.)\s+")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def is_header(line: Column) -> Column:
    """Up to 100 bytes without the space around, not ended by a full stop, comma or semicolon, all letters capitals or begun like chapter, section, part or appendix."""
    bare = F.regexp_replace(line, r"^\s+|\s+$", "")
    capitals = (F.upper(bare) == bare) & bare.rlike(r"\p{L}")
    return (F.octet_length(bare) <= 100) & ~bare.rlike(r"[.,;]$") & (capitals | F.lower(bare).rlike(r"^(chapter|section|part|appendix)"))


class _Packer(Machine):
    """The chunk that is being filled; a piece that stands alone neither joins nor is joined."""

    def __init__(self, target: int, mark: str) -> None:
        self.target, self.mark = target, mark
        self.parts: list[str] = []
        self.size = self.number = 0
        self.alone = False

    def take(self, piece: str, alone: bool) -> list[tuple]:
        size = self.size + len(self.mark) + len(piece)
        if self.parts and not self.alone and not alone and size <= self.target:
            self.parts.append(piece)
            self.size = size
            return []
        out = self.end()
        self.parts, self.size, self.alone = [piece], len(piece), alone
        return out

    def end(self) -> list[tuple]:
        if not self.parts:
            return []
        self.number += 1
        return [(self.number - 1, self.mark.join(self.parts))]


def packed_sentences(texts: DataFrame, key: str, text: str, target: int) -> DataFrame:
    """(key, number, chunk): sentences packed in order into chunks of up to ``target`` characters; a longer sentence is a chunk of its own.

    One pass over the sentences of each row; no row leaves its task.  Null and empty texts have no chunk.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                owner, made = [], []
                for k, pieces in enumerate(batch.column(1).to_pylist()):
                    one = _Packer(target, " ")
                    rows = [r for piece in pieces or () for r in one.take(piece, False)] + one.end()
                    owner += [k] * len(rows)
                    made += rows
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), pa.array([n for n, _ in made], pa.int32()), pa.array([c for _, c in made], pa.string())], names=[key, "number", "chunk"])

    schema = StructType([texts.schema[key], *StructType.fromDDL("number int, chunk string").fields])
    return texts.select(key, sentences(F.col(text)).alias("_pieces")).mapInArrow(pack, schema)


def _boundary(data: str, at: int, half: int) -> int:
    """The best end of a chunk at or before ``at``: a blank line, a sentence's end, a space, each beyond ``half``; else ``at``."""
    for mark, width in (("\n\n", 2), (". ", 2), (" ", 1)):
        k = data.rfind(mark, half, at)
        if k > 0:
            return k + width
    return at


def overlapping_chunks(texts: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 100, least: int = 200) -> DataFrame:
    """(key, number, start, end, chunk): chunks of about ``size`` characters that overlap; a rest under ``least`` joins the last one.

    Each chunk ends at the best boundary in its second half.  Null and empty texts have none.
    """
    def pieces(data: str | None) -> Iterator[tuple[int, int, int, str]]:
        start = number = 0
        while data and start < len(data):
            end = len(data) if len(data) - start <= size + least else _boundary(data, start + size, start + size // 2)
            yield number, start, end, data[start:end]
            if end == len(data):
                break
            start, number = max(end - overlap, start + 1), number + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                rows = [(k, *row) for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for row in pieces(data.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["key", "number", "start", "end", "chunk"])

    return texts.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(cut, "key long, number int, start int, end int, chunk string")


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words the text contains, whatever the case."""
    low = F.lower(text)
    return sum((low.contains(w.lower()).cast("int") for w in words[1:]), low.contains(words[0].lower()).cast("int"))


def best_label(scores: dict[str, Column], least: float, other: str) -> Column:
    """The label with the greatest score, of equal ones the first by name, if it is ``least`` or more."""
    ordered = F.array_max(F.array(*(F.struct(s.cast("double").alias("s"), F.lit(-k).alias("k"), F.lit(n).alias("n")) for k, (n, s) in enumerate(sorted(scores.items())))))
    return F.when(ordered["s"] >= least, ordered["n"]).otherwise(other)


def crunch(text: Column) -> Column:
    """How much a text is rules, from 0 to 1, by dice, difficulties, modifiers, lists and commands; 0.5 under five words."""
    def part(pattern: str, base: float, step: float, most: float) -> Column:
        n = F.regexp_count(text, F.lit(pattern))
        return F.when(n > 0, F.least(base + step * n, F.lit(most))).otherwise(0.0)

    total = part(r"\b\d*d\d+(?:\s*[+\-]\s*\d+)?\b", 0.3, 0.1, 0.5) + part(r"(?i)\bDC\s*\d+\b", 0.2, 0.1, 0.4) + part(r"\s[+\-]\d+\b", 0.1, 0.03, 0.3) + part(r"(?m)^\s*\d+[.)]\s+", 0.1, 0.05, 0.25) + part(r"(?i)\b(must|shall|may not|cannot)\b", 0.1, 0.05, 0.4)
    return F.when(F.size(F.split(F.trim(text), r"\s+")) < 5, 0.5).otherwise(F.least(total, F.lit(1.0)))


def cross_references(text: Column) -> Column:
    """(kind, target) of mentions like page 12, chapter 3, table 4-1."""
    kinds = [_refs(text, k) for k in ("page", "chapter", "section", "table", "figure")]
    return F.concat(*kinds)


def _refs(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"(?i)\b{kind}s?\.?\s+(\d+(?:[.-]\d+)*)"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("target")))


def table_cells(line: Column) -> Column:
    """Cells of a line of a table, by bars, tabs or runs of spaces."""
    by = F.when(line.contains("|"), F.split(line, r"\s*\|\s*")).when(line.contains("\t"), F.split(line, "\t")).otherwise(F.split(line, " {2,}"))
    return F.filter(F.transform(by, lambda c: F.trim(c)), lambda c: c != "")


def embedding_text(chunk: Column, section: Column, kind: Column) -> Column:
    """A chunk behind what is known of it."""
    return F.concat_ws(" ", F.concat(F.lit("[Section: "), section, F.lit("]")), F.concat(F.lit("[Type: "), kind, F.lit("]")), chunk)


def ordered_columns(blocks: DataFrame, page: str, x: str, y: str, key: str, gap: float) -> DataFrame:
    """Blocks of a page in reading order: a gap in their sorted x opens a column."""
    w = Window.partitionBy(page).orderBy(x, y, key)
    opened = F.when(F.col(x) - F.lag(x).over(w) > gap, 1).otherwise(0)
    column = F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("_o", opened).withColumn("column", column).withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("column", y, x, key))).drop("_o")


def dice_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.explode(T.dice_in(F.col(text))).alias("notation")).withColumn("d", T.dice(F.col("notation")))


def element_kind(text: Column, least: float = 0.5) -> Column:
    """What an element of a rule book is, by marks of each kind: stat block, random table, spell, item, read-aloud, sidebar, else generic."""
    def shown(patterns: list[str]) -> Column:
        return sum((text.rlike(p).cast("int") for p in patterns[1:]), text.rlike(patterns[0]).cast("int"))

    entries = F.regexp_count(text, F.lit(r"(?m)^\s*\d+(?:[-–]\d+)?[.:)]?\s+\S"))
    block = F.least((shown([r"(?i)armor class", r"(?i)hit points", r"(?i)\bspeed\s+\d", r"(?i)challenge\s+\d"]) + F.when(text.rlike(r"(?i)\bstr\b.*\bdex\b.*\bcon\b"), 1.5).otherwise(0.0)) / 6, F.lit(1.0))
    scores = {
        "stat block": block,
        "random table": F.when(text.rlike(r"(?i)\b\d*d\d+\b") & (entries >= 4), 0.9).when(text.rlike(r"(?i)\b\d*d\d+\b") & (entries >= 2), 0.7).otherwise(0.0),
        "spell": F.when(text.rlike(r"(?i)casting time") & text.rlike(r"(?i)\brange\b") & text.rlike(r"(?i)\bduration\b"), 0.9).otherwise(0.0),
        "item": F.when(text.rlike(r"(?i)requires attunement|wondrous item|\b(?:weapon|armor) \("), 0.7 + 0.15 * shown([r"(?i)\brare\b", r"(?i)\blegendary\b"])).otherwise(0.0),
        "read-aloud": F.when(text.rlike(r'^\s*["“].*["”]\s*$') | text.rlike(r"(?i)read (?:aloud|the following)"), 0.7).otherwise(0.0),
        "sidebar": F.when(text.rlike(r"(?im)^\s*(?:sidebar|note|tip|variant)\b\s*:"), 0.7).otherwise(0.0),
    }
    return best_label(scores, least, "generic")


def packed_elements(elements: DataFrame, key: str, order: str, text: str, atomic: Column, target: int) -> DataFrame:
    """(key, chunk_number, chunk): elements packed in order up to ``target`` characters; an atomic one stays whole and alone up to twice that.

    Longer ones are cut at sentences.  One sorted pass by key, which holds one chunk.
    """
    pieces = F.when(atomic & (F.length(text) <= 2 * target), F.array(F.col(text))).otherwise(sentences(F.col(text)))
    rows = elements.select(key, order, F.coalesce(atomic, F.lit(True)).alias("_alone"), F.posexplode(pieces).alias("_k", "_piece"))
    return scanned(rows, [key], [order, "_k", "_alone", "_piece"], ["_piece", "_alone"], lambda: _Packer(target, "\n"), "chunk_number int, chunk string")


def keywords(text: Column, vocabulary: list[str], most: int) -> Column:
    """The first ``most`` terms of the vocabulary that a text contains, whatever the case, in the vocabulary's order."""
    low = F.lower(text)
    return F.slice(F.filter(F.array(*map(F.lit, vocabulary)), lambda v: low.contains(F.lower(v))), 1, most)


def header_level(line: Column) -> Column:
    """1 for chapters, parts and appendices, 2 for sections and numbers like 3., 3 for numbers like 3.1, 4 for other short lines in capitals; else null."""
    low = F.trim(F.lower(line))
    capitals = (F.upper(line) == line) & line.rlike(r"[A-Z]{2}") & (F.length(line) <= 60)
    return F.when(low.rlike("^" + T.whole("chapter|part|appendix")), 1).when(low.rlike("^" + T.whole("section") + r"|^\d+\.\s"), 2).when(low.rlike(r"^\d+\.\d+"), 3).when(capitals, 4)


def region(text: Column) -> Column:
    """What a block of a page is, and how sure that is, as a struct (kind, confidence): stat block, read-aloud text, sidebar, callout or body."""
    low = F.lower(text)
    marks = sum((low.contains(w).cast("int") for w in ("hit points", "speed", "challenge")), low.contains("armor class").cast("int"))
    aloud = low.rlike(r"read (?:aloud|the following)|^\s*[\"“]")
    boxed = low.rlike(r"^\s*(?:sidebar|variant|optional rule)\b")
    called = low.rlike(r"^\s*(?:note|tip|warning|important)\s*:")
    cases = [(marks >= 2, "stat block", F.least(0.4 + 0.15 * marks, F.lit(1.0))), (aloud, "read-aloud", F.lit(0.7)), (boxed, "sidebar", F.lit(0.8)), (called, "callout", F.lit(0.75))]
    out = None
    for test, kind, sure in cases:
        one = F.struct(F.lit(kind).alias("kind"), sure.cast("double").alias("confidence"))
        out = F.when(test, one) if out is None else out.when(test, one)
    return out.otherwise(F.struct(F.lit("body").alias("kind"), F.lit(0.5).cast("double").alias("confidence")))


# Words that tell the regions of a page, and their worth.
_STATS = ("speed", "str", "dex", "con", "int", "wis", "cha", "challenge", "saving throws", "damage resistances", "damage immunities", "condition immunities", "senses", "languages", "actions", "reactions", "legendary actions")
_MOOD = ("darkness", "shadow", "light", "smell", "sound", "cold", "warm", "ancient", "dusty", "damp", "eerie", "silence", "whisper")
_ADDRESS = (" you ", "you see", "you hear", "you notice", "before you")
_ASIDE = "sidebar|note|tip|variant|optional rule|designer notes|dm tip|gm tip|roleplaying|variant rule|using this rule"
_WARNING = "warning|caution|important|remember|don't forget|note that|be aware"


def regions(text: Column, least: float = 0.5) -> Column:
    """Every kind of region that a block of a page may be, surest first: an array of (kind, confidence), confidence at least ``least`` and 0.5.

    Kinds of equal confidence keep the order stat block, read-aloud, sidebar, callout.
    Blocks of under 20 bytes, and null ones, have none.  Evidence is counted in whole
    points, so that sums are exact.
    """
    # Bound as a variable: each of the many tests would trim and lower the whole text again.
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.transform(F.array(F.struct(bare.alias("t"), F.lower(bare).alias("low"))), lambda x: _regions(x["t"], x["low"], least))[0]


def _regions(t: Column, low: Column, least: float) -> Column:
    """The regions of a block without the white space around, and in lower case."""

    def held(words, points: int) -> Column:
        return sum((F.when(low.contains(w), points).otherwise(0) for w in words), F.lit(0))

    def worth(test: Column, points: int) -> Column:
        return F.when(test, points).otherwise(0)

    stats = held(("armor class", "hit points"), 2) + held(_STATS, 1) + worth(low.rlike(r"(?:str|dex|con|int|wis|cha)\s+\d+\s*\([+-]?\d+\)"), 3)
    address = sum((F.regexp_count(low, F.lit(w)) for w in _ADDRESS), F.lit(0))
    aloud = worth(low.rlike("read aloud|boxed text"), 8) + worth(t.rlike(r"^[\"'*]"), 3) + worth(address >= 2, 4) + worth(held(_MOOD, 1) >= 2, 3)
    aside = worth(low.rlike(rf"(?:^|\n)(?:{_ASIDE}):"), 8) + worth(t.rlike("SIDEBAR|VARIANT|OPTIONAL|NOTE|TIP"), 4) + worth(F.size(F.split(t, "\n")) < 15, 1)
    warning = worth(low.rlike(rf"(?:^|\n)(?:{_WARNING}):"), 7) + worth(t.contains("!") & (F.octet_length(t) < 500), 2)
    kinds = (("stat block", stats, 12), ("read-aloud", aloud, 10), ("sidebar", aside, 10), ("callout", warning, 10))
    every = F.array(*(F.struct(F.lit(k).alias("kind"), F.least(points / whole, F.lit(1.0)).alias("confidence")) for k, points, whole in kinds))
    sure = F.filter(every, lambda r: r["confidence"] >= max(least, 0.5))
    ranked = F.transform(F.array_sort(F.transform(sure, lambda r, k: F.struct((-r["confidence"]).alias("c"), k.alias("k"), r.alias("r")))), lambda x: x["r"])
    return F.when(F.octet_length(t) >= 20, ranked).otherwise(F.filter(every, lambda r: F.lit(False)))


def linked_references(refs: DataFrame, catalogue: DataFrame, least: float = 0.5) -> DataFrame:
    """(key, kind, target, title, confidence): references (key, kind, target) with the catalogue's entries (kind, target, title) that they name.

    A reference that names an entry's own target is sure; one to a part of it (12-3 or 12.3) is half as sure; the others aren't linked.
    """
    part = F.regexp_extract("target", r"^(\d+)", 1)
    asked = refs.withColumn("_to", F.explode(F.array_distinct(F.array("target", part)))).where("_to != ''")
    entries = catalogue.select("kind", F.col("target").alias("_to"), "title")
    sure = F.when(F.col("_to") == F.col("target"), 1.0).otherwise(0.5)
    found = asked.join(entries, ["kind", "_to"]).withColumn("confidence", sure).where(F.col("confidence") >= least)
    return found.groupBy("key", "kind", "target").agg(F.max_by("title", "confidence").alias("title"), F.max("confidence").alias("confidence"))


# Kinds of chunk that are surer links, kinds that name what is linked, and words that tell it otherwise.
_SURER = ["stat_block", "spell", "item", "table"]
_NAMED = {"spell": "spell", "stat_block": "monster", "monster": "monster", "item": "item", "feat": "feat"}


def link_confidence(score: Column, query: Column, content: Column, title: Column, kind: Column) -> Column:
    """How sure a search result is what a query refers to: its score between 0 and 1, more where the content holds the query, the title and the query hold one another, and the chunk is of a structured kind.

    Null contents, titles and kinds add nothing; a null score gives null.
    """
    low = F.lower(query)
    inside = F.coalesce(F.lower(content).contains(low), F.lit(False))
    titled = F.coalesce(F.lower(title).contains(low) | low.contains(F.lower(title)), F.lit(False))
    more = F.when(inside, 10).otherwise(0) + F.when(titled, 5).otherwise(0) + F.when(kind.isin(_SURER), 5).otherwise(0)
    return F.when(score.isNotNull(), F.greatest(F.least(score + more / 100, F.lit(1.0)), F.lit(0.0)))


def linked_kind(kind: Column, content: Column) -> Column:
    """What a linked chunk is about: its kind's name, whatever the case, else by the words of its content, else a term."""
    low = F.lower(content)
    out = F.when(low.contains("saving throw") | low.contains("spell attack"), "spell").when(low.contains("hit points") & low.contains("armor class"), "monster").when(low.contains("prerequisite:"), "feat").otherwise("term")
    known = F.create_map(*(F.lit(x) for pair in _NAMED.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(kind)), out)


def link_report(refs: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, refs, linked, sure, open, share): how many different references (key, kind, target) of each kind have links, and sure ones."""
    each = refs.select("key", "kind", "target").distinct().join(links.select("key", "kind", "target", "confidence"), ["key", "kind", "target"], "left")
    made = each.groupBy("kind").agg(F.count("*").alias("refs"), F.count("confidence").alias("linked"), F.count_if(F.col("confidence") >= 1.0).alias("sure"))
    return made.select("*", (F.col("refs") - F.col("linked")).alias("open"), (F.col("linked") / F.col("refs")).alias("share"))
