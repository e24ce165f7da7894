"""Ranked lexical search by a tree of greatest impacts over ranges of documents.

One pass over the texts keeps, for each document, its length and the
frequencies of the terms that are asked for; corpus statistics are aggregates of
that table.  A task then reads it range by range.  In a range each term has a
tree: its greatest impact in every leaf of a few documents, in every node of
some leaves, and so on up to the range.  A query goes down the node with the
highest sum of weighted maxima first, and ends when no node reaches the score
of its last result; nodes that just reach it are opened, as a smaller doc_id
may lie there.  What a task has found so far bounds its later ranges.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import saved
from sparkloom.llm.words import Vocabulary, by_bytes, separators, word_spans

#: Terms are runs of digits, letters and bytes over 127.
APART = separators((0, 47), (58, 96), (123, 127))
#: Documents of a leaf, children of a node, postings and documents of a range.
LEAF, FAN, RANGE_POSTINGS, RANGE_DOCS = 64, 8, 2 << 20, 1 << 14
#: Bytes of query texts that are searched at once; more are searched block by block.
BLOCK_BYTES = 8 << 20
#: Fixed values of the score: impact = TF * tf div (TF_LOW * tf + NORM * m), m = 100 - PART + PART * n * N div L.
TF, TF_LOW, NORM, PART = 1_000_000_000, 1000, 8, 90


class MaxTree:
    """The postings of one range, by term and leaf, with each leaf's greatest impact."""

    def __init__(self, docs: np.ndarray, term: np.ndarray, place: np.ndarray, impact: np.ndarray, terms: int) -> None:
        self.docs = docs
        self._leaves = -(-len(docs) // LEAF)
        order = np.argsort(term.astype(np.int64) * len(docs) + place, kind="stable")
        term, self._place, self._impact = term[order].astype(np.int64), place[order], impact[order]
        entry = term * self._leaves + self._place // LEAF
        self._starts = np.flatnonzero(np.append(True, entry[1:] != entry[:-1])[: len(entry)])
        self._ends = np.append(self._starts[1:], len(entry))
        self._leaf = self._place[self._starts] // LEAF
        self._most = np.maximum.reduceat(self._impact, self._starts)
        self._of_term = np.searchsorted(term[self._starts], np.arange(terms + 1))

    def _maxima(self, terms: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Each term's maxima at every level, the leaves first, and the entry of each term and leaf."""
        low, high = self._of_term[terms], self._of_term[terms + 1]
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row = np.repeat(np.arange(len(terms)), n)
        entries = np.full((len(terms), self._leaves), -1, np.int64)
        entries[row, self._leaf[at]] = at
        levels = [np.zeros((len(terms), self._leaves), np.int64)]
        levels[0][row, self._leaf[at]] = self._most[at]
        while levels[-1].shape[1] > 1:
            last = levels[-1]
            wide = np.zeros((len(terms), -(-last.shape[1] // FAN) * FAN), np.int64)
            wide[:, : last.shape[1]] = last
            levels.append(wide.reshape(len(terms), -1, FAN).max(2))
        return levels, entries

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], limit: int) -> None:
        """Put the range's documents into ``best``, a heap of (score, -doc_id) that keeps the ``limit`` greatest."""
        levels, entries = self._maxima(terms)
        bounds = [weights @ m for m in levels]
        top = len(levels) - 1
        nodes = [(-int(bounds[top][0]), top, 0)]
        while nodes:
            bound, level, node = heapq.heappop(nodes)
            if not bound or len(best) == limit and -bound < best[0][0]:
                return
            if level:
                low = node * FAN
                for k, b in enumerate(bounds[level - 1][low : low + FAN].tolist(), low):
                    if b and (len(best) < limit or b >= best[0][0]):
                        heapq.heappush(nodes, (-b, level - 1, k))
                continue
            at = entries[:, node]
            held = np.flatnonzero(at >= 0)
            at = at[held]
            n = self._ends[at] - self._starts[at]
            index = np.repeat(self._starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            scores = np.zeros(LEAF, np.int64)
            np.add.at(scores, self._place[index] - node * LEAF, np.repeat(weights[held], n) * self._impact[index])
            least = best[0][0] if len(best) == limit else 1
            for k in np.flatnonzero(scores >= max(least, 1)).tolist():
                found = (int(scores[k]), -int(self.docs[node * LEAF + k]))
                if len(best) < limit:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)


class Queries:
    """The terms of some items, each once, as numbers of one vocabulary."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        raw, _, first, last, bounds = word_spans(pa.array([t for _, t in rows], pa.string()), APART)
        plain = raw.tobytes()
        words = [plain[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        self.vocabulary = Vocabulary(sorted(set(words)))
        numbers = self.vocabulary.find(raw, first, last)
        terms: dict[int, set[int]] = {}
        for (item, _), a, b in zip(rows, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            terms.setdefault(item, set()).update(numbers[a:b].tolist())
        self.terms = {i: np.array(sorted(x), np.int64) for i, x in terms.items() if x}


def frequencies(docs: DataFrame, vocabulary: Vocabulary, column: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with at least one term: all its terms with repeats, and those of the vocabulary with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            raw, _, first, last, bounds = word_spans(batch.column(1), APART)
            n = np.diff(bounds)
            number = vocabulary.find(raw, first, last)
            known = number >= 0
            key, tf = np.unique(np.repeat(np.arange(len(n)), n)[known] * max(len(vocabulary.words), 1) + number[known], return_counts=True)
            text, term = key // max(len(vocabulary.words), 1), key % max(len(vocabulary.words), 1)
            cuts = pa.array(np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32))
            lists = (pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (term, tf))
            rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])
            yield rows.filter(pa.array(n > 0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _weights(rows: DataFrame, terms: int, documents: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term of the vocabulary, whose size bounds what is collected."""
    df = np.zeros(terms, np.int64)
    for term, n in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():
        df[term] = n
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) if d else 0 for d in df.tolist()], np.int64)


def _found(docs: DataFrame, queries: Queries, limit: int, column: str) -> DataFrame:
    """(item_id, doc_id, score): for each item at least its ``limit`` best documents."""
    rows = saved(frequencies(docs, queries.vocabulary, column), "frequencies")
    documents, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = len(queries.vocabulary.words)
    weights = _weights(rows, size, documents)
    asked = queries.terms

    def tree(held: list[pa.RecordBatch]) -> MaxTree | None:
        table = pa.Table.from_batches(held).combine_chunks()
        n = table["n"].to_numpy()
        lengths = np.diff(table["terms"].chunk(0).offsets.to_numpy())
        place = np.repeat(np.arange(len(n)), lengths)
        term, tf = (table[c].chunk(0).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
        if not len(term):
            return None
        m = 100 - PART + PART * n * documents // total
        return MaxTree(table["doc_id"].to_numpy(), term, place, TF * tf // (TF_LOW * tf + NORM * m[place]), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {i: [] for i in asked}
        held: list[pa.RecordBatch] = []
        rows = postings = 0

        def look() -> None:
            if (one := tree(held)) is not None:
                for item, terms in asked.items():
                    one.search(terms, weights[terms], best[item], limit)

        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                held.append(part)
                rows += part.num_rows
                postings += len(part.column(2).flatten())
                if rows >= RANGE_DOCS or postings >= RANGE_POSTINGS:
                    look()
                    held, rows, postings = [], 0, 0
        if held:
            look()
        out = [(i, -d, s) for i, x in best.items() for s, d in x]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["item_id", "doc_id", "score"])

    return rows.where("doc_id is not null").mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, limit: int = 10, column: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``limit`` documents of ``docs`` with the highest scores above 0 for each item (item_id, text), from rank 1; equal scores by ascending doc_id.

    Null and empty texts have no terms and count nowhere; an item without terms
    or id has no rows, and an item_id of several texts asks for the terms of
    all.  Documents without doc_id count in the statistics and aren't ranked.  Each row
    is ranked by itself, so a repeated row comes twice.  Other columns are ignored.
    """
    asked = saved(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null"), "items")
    size = asked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    # A block of items is bounded by its bytes.
    parts = [_found(docs, Queries([tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()]), limit, column) for k in range(blocks)]
    found = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("item_id", "rank", "doc_id", "score")
