"""Benchmark decontamination by an FM-index of each shard of the corpus.

A shard is some texts of one task, as a row of symbols.  The symbols number the
words of the benchmark; words that stand in no benchmark text can't be part of
a hit, so they and all runs of words too short for any window are left out,
and a separator stands in their place.  The suffixes of the shard are sorted by
doubling, the Burrows-Wheeler transform lies in a wavelet matrix, each window
is searched backwards through its ranks, and the places of what is found follow
from sampled suffix positions.  Spans are merged for each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import fresh_path, numbered
from sparkloom.llm.words import Vocabulary, by_bytes, separators, word_spans

#: Words are runs of digits, letters and bytes over 127.
APART = separators((0, 47), (58, 96), (123, 127))
WINDOW = 10
#: Symbols of a shard; a run of more than PIECE is indexed in pieces that overlap by a window, which bounds what suffixes have in common.
SHARD, PIECE = 1 << 20, 512
#: One in so many suffix positions is kept.
SAMPLED = 8
#: Bytes of benchmark texts that a task holds at once; a larger benchmark is read block by block.
BLOCK_BYTES = 8 << 20
#: Occurrences that are located together.
TOGETHER = 1 << 20


class Bits:
    """A row of bits with the number of ones before each place."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        self._words = np.packbits(np.append(bits, np.zeros(64 - n % 64, bool)), bitorder="little").view("<u8")
        self._before = np.append(0, np.cumsum(np.bitwise_count(self._words), dtype=np.int64))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        return self._before[word] + np.bitwise_count(self._words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self._words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """A row of symbols by bits, the highest first: each level has the zeros of the one above before its ones."""

    def __init__(self, symbols: np.ndarray, most: int) -> None:
        self._levels: list[tuple[int, Bits, int]] = []
        for level in range(max(most.bit_length(), 1) - 1, -1, -1):
            bits = (symbols >> level) & 1 == 1
            self._levels.append((level, Bits(bits), int((~bits).sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros_like(at)
        for level, bits, zeros in self._levels:
            one = (symbol >> level) & 1 == 1
            a, b = bits.rank(start), bits.rank(at)
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, rank): the symbol at each place, and how often it stands before it."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for level, bits, zeros in self._levels:
            one = bits.get(at)
            a, b = bits.rank(start), bits.rank(at)
            symbol |= one.astype(symbol.dtype) << level
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
        return symbol, at - start


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The places of a row of symbols by the order of their suffixes, the shorter first: by doubling, of which only places that aren't told apart yet take part."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order]
    start = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])[:n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    length = 1
    while True:
        # Groups of equal rank and more than one member, each a stretch of ``order``.
        first = rank[order]
        many = np.zeros(n, bool)
        many[:-1] |= first[1:] == first[:-1]
        many[1:] |= first[1:] == first[:-1]
        slots = np.flatnonzero(many)
        if not len(slots):
            return order
        place = order[slots]
        behind = place + length
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1)
        key = first[slots] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        place, key = place[by], key[by]
        order[slots] = place
        fresh = np.append(True, key[1:] != key[:-1])
        rank[place] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        length *= 2


class FmIndex:
    """Backward search and location over a row of symbols from 1; 0 may stand between them and is never asked for."""

    def __init__(self, symbols: np.ndarray, most: int) -> None:
        symbols = np.append(symbols + 1, 0)  # an end of its own, so that what stands before each suffix keeps their order
        suffixes = suffix_array(symbols)
        self.size = len(symbols)
        before = symbols[suffixes - 1]
        self._tree = WaveletMatrix(before, most + 1)
        self._starts = np.append(0, np.cumsum(np.bincount(symbols, minlength=most + 2)))
        sampled = suffixes % SAMPLED == 0
        self._sampled, self._places = Bits(sampled), suffixes[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high): the rows of the suffixes that begin with each pattern, a row of symbols; -1 before a shorter one's first."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for symbol in patterns.T[::-1]:
            on = np.flatnonzero((symbol >= 0) & (low < high))
            c = symbol[on] + 1
            low[on], high[on] = (self._starts[c] + self._tree.rank(c, x[on]) for x in (low, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of the suffixes in each row: back to the next sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            done = self._sampled.get(rows)
            out[open_[done]] = self._places[self._sampled.rank(rows[done])] + steps
            open_, rows = open_[~done], rows[~done]
            symbol, rank = self._tree.access(rows)
            rows = self._starts[symbol] + rank
            steps += 1
        return out


class Phrases:
    """The windows of some benchmark texts: ``WINDOW`` words that follow one another, or all of a shorter text's."""

    def __init__(self, ids: list[int], texts: pa.Array) -> None:
        raw, _, first, last, bounds = word_spans(texts, APART)
        plain = raw.tobytes()
        words = [plain[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        self.vocabulary = Vocabulary(sorted(set(words)))
        symbols = self.vocabulary.find(raw, first, last) + 1
        windows: dict[tuple[int, ...], set[int]] = {}
        for item, a, b in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            for k in range(a, max(b - WINDOW + 1, a + 1) if b > a else a):
                windows.setdefault(tuple(symbols[k : min(k + WINDOW, b)].tolist()), set()).add(item)
        self.least = min(map(len, windows), default=0)
        self.lengths = np.fromiter(map(len, windows), np.int64, len(windows))
        self.patterns = np.full((len(windows), WINDOW), -1, np.int64)
        for k, w in enumerate(windows):
            self.patterns[k, WINDOW - len(w) :] = w
        #: The items of each window, one behind the other, and where they begin.
        self.starts = np.append(0, np.cumsum([len(x) for x in windows.values()], dtype=np.int64)).astype(np.int64)
        self.items = np.fromiter((i for x in windows.values() for i in sorted(x)), np.int64, int(self.starts[-1]))

    def hits(self, symbols: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence in texts, given by the symbol of each word (0 for none) and the text that it is of."""
        runs = self._indexed(symbols, text)
        if not len(runs):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        # Position in the shard, from 1 at the first word: the word there, -1 between pieces.
        gaps = np.concatenate([np.append(np.arange(a, b), -1) for a, b in runs])
        index = FmIndex(np.where(gaps < 0, 0, symbols[gaps]), len(self.vocabulary.words))
        low, high = index.search(self.patterns)
        found = np.flatnonzero(low < high)
        counts = (high - low)[found]
        ends = np.cumsum(counts)
        places, windows = [], []
        a = 0
        while a < len(found):
            b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOGETHER, "right")), a + 1)
            n = counts[a:b]
            rows = np.repeat(low[found[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            places.append(gaps[index.locate(rows)])
            windows.append(np.repeat(found[a:b], n))
            a = b
        return (np.concatenate(x) if x else np.empty(0, np.int64) for x in (places, windows))

    def _indexed(self, symbols: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
        """Runs of known words of one text that are long enough for a window, in pieces."""
        known = symbols > 0
        if not known.any():
            return []
        joined = np.append(False, known[1:] & known[:-1] & (text[1:] == text[:-1]))
        first = np.flatnonzero(known & ~joined)
        last = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
        long = last - first >= self.least
        out = []
        for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
            out += [(k, min(k + PIECE + WINDOW - 1, b)) for k in range(a, max(b - WINDOW + 1, a + 1), PIECE)]
        return out


def _blocks(benchmark: DataFrame) -> list[str]:
    """Files of the benchmark's (item_id, text), each with texts of about BLOCK_BYTES."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    path = fresh_path(spark, "benchmark")
    rows.repartition(max(1, -(-size // BLOCK_BYTES))).write.parquet(path)
    return sorted(spark.read.parquet(path).inputFiles())


def _phrases(path: str) -> Phrases:
    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_file(place) as f:
        rows = pq.read_table(f)
    texts = rows["text"].combine_chunks()
    return Phrases(rows["item_id"].to_pylist(), texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts)


def _merged(text: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of words (text, first, last) united where they overlap or touch."""
    order = np.lexsort((first, text))
    text, first, last = text[order], first[order], last[order]
    if not len(text):
        return text, first, last
    # Words are numbered across texts, so the furthest end so far never reaches into another text.
    far = np.maximum.accumulate(last)
    fresh = np.append(True, (first[1:] > far[:-1]) | (text[1:] != text[:-1]))
    at = np.flatnonzero(fresh)
    return text[at], first[at], np.maximum.reduceat(last, at)


def contamination(docs: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``n_words`` long, ``spans`` and ``items``, in place of columns of these names.

    ``benchmark`` has (item_id, text).  Words are runs of digits, letters and bytes
    over 127, A-Z lower-cased; a window is ten words of an item that follow one
    another, or all words of a shorter item.  ``items`` are the ids, ascending, of the
    items with a window in the text; ``spans`` the stretches that windows
    cover, united: (first_word, last_word, start, end), words from 0 and the last
    one not included, and the bytes of the text in UTF-8 from the first word to the last.

    Null and empty texts have no words; items without words or id count for
    nothing; an item_id of several texts has the windows of all.  Each row is judged
    by itself, so repeated rows and ids have repeated results.  Nothing is
    shuffled: a task indexes its texts shard by shard and reads the benchmark
    from files, block by block.
    """
    files = _blocks(benchmark)
    plain, names = numbered(docs.drop("n_words", "spans", "items"))
    inner, place = plain.columns, names.index(column)
    kind = "array<struct<first_word: int, last_word: int, start: int, end: int>>"
    out = plain.withColumn("n_words", F.lit(None).cast("long")).withColumn("spans", F.lit(None).cast(kind)).withColumn("items", F.lit(None).cast("array<long>"))
    ints = [("first_word", pa.int32()), ("last_word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]

    def shard(held: list[pa.RecordBatch], blocks: Iterator[Phrases]) -> Iterator[pa.RecordBatch]:
        """Batches of texts with what is found in them."""
        texts = pa.concat_arrays([b.column(place).cast(pa.string()) for b in held])
        raw, offsets, first, last, bounds = word_spans(texts, APART)
        counts = np.diff(bounds)
        owner = np.repeat(np.arange(len(texts)), counts)
        places, ends, pairs = [], [], []
        for phrases in blocks:
            at, window = phrases.hits(phrases.vocabulary.find(raw, first, last) + 1, owner)
            if len(at):
                places.append(at)
                ends.append(at + phrases.lengths[window])
                # Each text and window once, then the window's items.
                both = np.unique(owner[at] * len(phrases.lengths) + window)
                text, w = both // len(phrases.lengths), both % len(phrases.lengths)
                n = phrases.starts[w + 1] - phrases.starts[w]
                index = np.repeat(phrases.starts[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                pairs.append(np.stack([np.repeat(text, n), phrases.items[index]]))
        low, high = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (places, ends))
        text, low, high = _merged(owner[low], low, high)
        found = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.empty((2, 0), np.int64)
        rows = np.arange(len(texts) + 1)
        spans = [low - bounds[text], high - bounds[text], first[low] - offsets[text], last[high - 1] - offsets[text]] if len(low) else [low] * 4
        structs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in spans], fields=[pa.field(*f) for f in ints])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, rows).astype(np.int32)), structs)
        items = pa.ListArray.from_arrays(pa.array(np.searchsorted(found[0], rows).astype(np.int32)), pa.array(found[1]))
        n_words = pa.array(counts.astype(np.int64))
        k = 0
        for b in held:
            yield pa.RecordBatch.from_arrays([*b.columns, *(x.slice(k, b.num_rows) for x in (n_words, spans, items))], names=[*inner, "n_words", "spans", "items"])
            k += b.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = [_phrases(files[0])] if len(files) == 1 else None
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in by_bytes(batches, place):
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column(place))).as_py() or 0
            if size >= 4 * SHARD:
                yield from shard(held, iter(one) if one else map(_phrases, files))
                held, size = [], 0
        if held:
            yield from shard(held, iter(one) if one else map(_phrases, files))

    return plain.mapInArrow(run, out.schema).toDF(*names, "n_words", "spans", "items")


def decontaminated(docs: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with the covered stretches taken out of the text; rows and other columns stay as they are."""
    found = contamination(docs, benchmark, column)
    plain, names = numbered(found.select(*docs.columns))
    inner, place = plain.columns, names.index(column)
    whole = plain.withColumns({"_spans": F.lit(None).cast(found.schema["spans"].dataType)})
    rows = found.select(*docs.columns, "spans").toDF(*whole.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, place):
            texts = batch.column(place).to_pylist()
            for k, spans in enumerate(batch.column("_spans").to_pylist()):
                if spans:
                    data, at, parts = texts[k].encode(), 0, []
                    for s in spans:
                        parts.append(data[at : s["start"]])
                        at = s["end"]
                    texts[k] = b"".join([*parts, data[at:]]).decode()
            columns = [*batch.columns[:-1]]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=inner)

    return rows.mapInArrow(cut, plain.schema).toDF(*names)
