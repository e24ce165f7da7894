"""Audit of how far sources of one language differ in their words, by sorted streams.

Texts become terms in blocks; a block's terms are sorted by (lang, source, term,
document) and its runs counted, so a row leaves a task for each run only.  Rows
are dealt by (lang, term, source), sorted within their partitions, and a scan
that holds one run at a time adds them up: the occurrences in a group and its
documents.  A second such scan, of one row for each group, gives each language
its terms that are frequent enough, with their counts in all groups.  From these
the partial sums of all pairs of sources and the best terms of each group leave
a task for each stretch of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import saved, sized
from sparkloom.llm.words import by_bytes, range_hashes, same_ranges, separators, texts_of, word_spans

#: Terms are runs of letters and bytes over 127.
APART = separators((0, 96), (123, 127))
#: Bytes of texts that are counted together; numbers of a stretch of terms by groups.
BLOCK, STRETCH = 4 << 20, 1 << 20
#: Fixed values of the probability: 1 + floor(ONE * (count + MORE) / (N + MORE * V)).
ONE, MORE = 1_000_000_000, 5
#: Counts from here on are multiplied as Python's integers.
WIDE = 9_000_000_000
_COUNTS = "lang string, source string, term string, df long, n long"


def _numbered_terms(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each term, the place of one occurrence of each number); terms of one hash are told apart by their bytes."""
    codes, keys = pd.factorize(range_hashes(raw, first, last))
    one = np.empty(len(keys), np.int64)
    one[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    size, of = last - first, one[codes]
    long = np.flatnonzero(size > 7)
    if (size[of] != size).any() or not same_ranges(raw, first[long], raw, first[of[long]], size[long]).all():
        codes, _ = pd.factorize(np.array([raw[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)], object))
        one = np.empty(codes.max() + 1, np.int64)
        one[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, one


def _block_runs(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """(lang, source, term, df, n) of the runs of one block (lang, source, text)."""
    raw, _, first, last, bounds = word_spans(batch.column(2), APART)
    if not len(first):
        return None
    codes, one = _numbered_terms(raw, first, last)
    langs, sources = (batch.column(k).dictionary_encode() for k in (0, 1))
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    rows, terms = batch.num_rows, len(one)
    document = np.repeat(np.arange(rows), np.diff(bounds))
    key = np.sort((group[document] * terms + codes) * rows + document)
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    run = key[start] // rows
    head = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    df = np.diff(np.append(head, len(run)))
    n = np.diff(np.append(start[head], len(key)))
    of_group, term = run[head] // terms, run[head] % terms
    words = texts_of(raw, first[one], last[one])
    columns = [langs.dictionary.take(pa.array(of_group // len(sources.dictionary))), sources.dictionary.take(pa.array(of_group % len(sources.dictionary))), words.take(pa.array(term)), pa.array(df.astype(np.int64)), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "df", "n"])


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row differs from the one before in any of the columns, which have no nulls; the first one does."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[0] = True
    for c in columns:
        if n > 1:
            out[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return out


def _scanned(batches: Iterator[pa.RecordBatch], keys: list[str], sums: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with equal keys as one, with their sums; the last run of a batch waits for the next one."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.select([*keys, *sums])
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        start = np.flatnonzero(_changes([batch.column(k) for k in keys]))
        added = [pa.array(np.add.reduceat(batch.column(s).to_numpy(), start)) for s in sums]
        at = pa.array(start)
        out = pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *added], names=[*keys, *sums])
        held = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    if held is not None:
        yield held


def group_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, df, n): documents with the term and its occurrences in each group of ``docs`` (lang, source, text), none of them null."""

    def block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            if (out := _block_runs(pa.Table.from_batches(held).combine_chunks().to_batches()[0])) is not None:
                yield out

        for batch in by_bytes(batches, 2, BLOCK):
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column(2))).as_py()
            if size >= BLOCK:
                yield from counted()
                held, size = [], 0
        if held:
            yield from counted()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _scanned(batches, ["lang", "term", "source"], ["df", "n"]):
            yield out.select(["lang", "source", "term", "df", "n"])

    partial = docs.select("lang", "source", "text").mapInArrow(block_runs, _COUNTS)
    key = ["lang", "term", "source"]
    return partial.repartition(*key).sortWithinPartitions(*key).mapInArrow(scan, _COUNTS)


def frequent_terms(counts: DataFrame, least: int) -> DataFrame:
    """(lang, term, n, sources, counts) of the terms in at least ``least`` documents of the language: occurrences in all, and by source."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def kept(batch: pa.RecordBatch, start: np.ndarray, end: int) -> pa.RecordBatch:
            df = np.add.reduceat(batch.column("df").to_numpy()[:end], start)
            n = np.add.reduceat(batch.column("n").to_numpy()[:end], start)
            cuts = pa.array(np.append(start, end).astype(np.int32))
            at = pa.array(start)
            columns = [batch.column("lang").take(at), batch.column("term").take(at), pa.array(n), *(pa.ListArray.from_arrays(cuts, batch.column(c).slice(0, end)) for c in ("source", "n"))]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "term", "n", "sources", "counts"]).filter(pa.array(df >= least))

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            start = np.flatnonzero(_changes([batch.column("lang"), batch.column("term")]))
            last = int(start[-1])
            if last:
                yield kept(batch, start[:-1], last)
            held = batch.slice(last)
        if held is not None:
            yield kept(held, np.zeros(1, np.int64), held.num_rows)

    key = ["lang", "term", "source"]
    return counts.repartition("lang", "term").sortWithinPartitions(*key).mapInArrow(scan, "lang string, term string, n long, sources array<string>, counts array<long>")


def shares(counts: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(ONE * (count + MORE) / (total + MORE * terms)), exact at any size."""
    if counts.size and counts.max() >= WIDE:
        return (1 + ONE * (counts.astype(object) + MORE) // (np.asarray(total).astype(object) + MORE * terms)).astype(np.int64)
    return 1 + ONE * (counts + MORE) // (total + MORE * terms)


def divergence(docs: DataFrame, least: int = 30, ranks: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (lang, source, text; other columns are ignored).

    A language keeps the V terms that at least ``least`` of its documents hold.  In
    each group (lang, source), and in each language, a kept term has p = 1 +
    floor(10**9 (count + 5) / (N + 5 V)), N being the occurrences of all kept terms
    there.  Rows of part "pair" give for each other source of the language (item) the
    sum of |p - q| over all kept terms; rows of part "term" the ``ranks`` terms (item)
    that occur in the group and whose p is furthest above the language's.  Ranks
    count from 1 by falling value, equal ones by item.

    Null texts, languages and sources count as ''.  Each row is a document, so
    repeated rows count twice.  A language without kept terms has pairs of value 0; one
    with a single source has none.  An empty table gives an empty result.
    """
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = saved(frequent_terms(group_counts(plain), least), "kept")
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    groups = saved(plain.groupBy("lang", "source").agg(F.count("*").alias("documents")).drop("documents").join(sums, ["lang", "source"], "left").fillna(0, ["total"]), "groups")
    languages = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all"))
    members = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("g"))
    scales = saved(languages.join(members, "lang").select("lang", "v", "all", F.col("g.source").alias("names"), F.col("g.total").alias("totals")), "scales")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            for k, name in enumerate(lang.dictionary.to_pylist()):
                at = np.flatnonzero(lang.indices.to_numpy() == k)
                own = batch.take(pa.array(at))
                names = own.column("names")[0].as_py()
                step = max(STRETCH // len(names), 1)
                for low in range(0, len(at), step):
                    yield from _stretch(name, names, own.slice(low, step), ranks)

    rows = kept.join(sized(scales), "lang").select("lang", "term", "n", "sources", "counts", "v", "all", "names", "totals")
    partial = saved(rows.mapInArrow(compare, "lang string, source string, part string, item string, value long"), "partial")
    others = groups.select("lang", F.col("source").alias("item"))
    listed = groups.select("lang", "source").join(others, "lang").where("source != item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = partial.where("part = 'pair'").unionByName(listed).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms = partial.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", rank).unionByName(terms)


def _stretch(lang: str, names: list[str], rows: pa.RecordBatch, ranks: int) -> Iterator[pa.RecordBatch]:
    """The sums of all pairs over some terms of a language, and each group's best ones among them."""
    place = pa.array(names)
    v, everything = rows.column("v")[0].as_py(), rows.column("all")[0].as_py()
    totals = np.array(rows.column("totals")[0].as_py(), np.int64)
    lists = rows.column("sources")
    count = np.zeros((rows.num_rows, len(names)), np.int64)
    owner = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy())
    count[owner, pc.index_in(lists.flatten(), place).to_numpy()] = rows.column("counts").flatten().to_numpy()
    p = shares(count, totals, v)
    q = shares(rows.column("n").to_numpy(), everything, v)
    for k, name in enumerate(names):
        sums = np.abs(p - p[:, k : k + 1]).sum(0)
        other = [j for j in range(len(names)) if j != k]
        yield _rows(lang, name, "pair", place.take(pa.array(other, pa.int64())), sums[other])
        more = np.flatnonzero((count[:, k] > 0) & (p[:, k] > q))
        value = p[more, k] - q[more]
        if len(more) > ranks:
            # Those that reach the last rank's value, in the order of the ranks: what falls behind them here does so among all terms.
            reach = value >= np.partition(value, len(more) - ranks)[len(more) - ranks]
            more, value = more[reach], value[reach]
            said = rows.column("term").take(pa.array(more)).to_pylist()
            order = sorted(range(len(more)), key=lambda j: (-value[j], said[j].encode()))[:ranks]
            more, value = more[order], value[order]
        yield _rows(lang, name, "term", rows.column("term").take(pa.array(more)), value)


def _rows(lang: str, source: str, part: str, items: pa.Array, value: np.ndarray) -> pa.RecordBatch:
    n = len(items)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([part] * n, pa.string()), items, pa.array(value.astype(np.int64))], names=["lang", "source", "part", "item", "value"])
