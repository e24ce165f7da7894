"""Token-id shards compressed by Re-Pair grammars.

Documents are dealt in ascending doc_id order; each task writes its ids as
shards of up to ``SHARD_IDS`` ids, one behind another in one file, so that a
grammar is built in bounded memory.  A shard has one grammar: pairs of
neighbouring symbols are counted, frequent ones become nonterminals and the
sequence is rewritten, again and again until no pair comes ``LEAST`` times.
Each pass replaces all frequent pairs, the more frequent first where occurrences
overlap; from the second pass on only places are counted at which a frequent
pair can stand: next to a new symbol, or where one was left over.  A shard stores
the rules, the expansion length of each nonterminal, the rewritten sequence and
the documents' lengths, so that any range of ids can be decoded from its own
symbols alone.

Shard: 24 bytes of little-endian unsigned 32-bit integers (terminals, rules,
symbols, bytes of the rules, of the sequence and of the documents), then these
three parts compressed with zstd: rules as (left, right, expansion length),
symbols, and an Arrow stream (doc_id, n).
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.bpe import Encoder, encoded, vocabulary_path
from sparkloom.llm.common import fresh_path, saved
from sparkloom.llm.files import Input, Output, reading_tasks

#: Ids of a shard (a longer document has a shard of its own; places in a shard are 32-bit integers), least count of a pair.
SHARD_IDS, LEAST = 2_000_000, 8
#: Bytes of texts that are encoded together; the library gains nothing from more.
TOGETHER = 2_000_000
#: Size of the table that finds a pair's rank.
SLOT_BITS = 20
END_ID = 0


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def _frequent(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, at, rank): the pairs that come LEAST times, sorted; the places that hold one; and its rank there, the most frequent pair having 0."""
    ordered = np.sort(keys)
    heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    counts = np.diff(np.append(heads, len(ordered)))
    heads, counts = heads[counts >= LEAST], counts[counts >= LEAST]
    pairs = ordered[heads]
    if not len(pairs):
        return pairs, heads, heads
    rank = np.empty(len(pairs), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(pairs))
    # Most places are told by a table of slots; where two pairs share one, by search.
    slots = np.full(1 << SLOT_BITS, -1, np.int32)
    slots[_slot(pairs)] = np.arange(len(pairs), dtype=np.int32)
    number = slots[_slot(keys)]
    at = np.flatnonzero(number >= 0)
    number, mine = number[at], keys[at]
    other = np.flatnonzero(pairs[number] != mine)
    number[other] = np.minimum(np.searchsorted(pairs, mine[other]), len(pairs) - 1)
    same = pairs[number] == mine
    return pairs, at[same], rank[number[same]]


def _chosen(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` are replaced: where they overlap the lower rank, of equal ranks in a row every other one."""
    near = np.diff(at) == 1
    stays = np.ones(len(at), bool)
    stays[1:] &= ~near | (rank[1:] <= rank[:-1])
    stays[:-1] &= ~near | (rank[:-1] <= rank[1:])
    k = np.flatnonzero(stays)
    begins = np.append(True, np.diff(at[k]) > 1)[: len(k)]
    start = np.maximum.accumulate(np.where(begins, np.arange(len(k)), 0))
    k = k[(np.arange(len(k)) - start) % 2 == 0]
    # A pair that lost most of its places to others waits for the next pass.
    return k[np.bincount(rank[k])[rank[k]] >= LEAST // 2]


def grammar(ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(terminals, rules, symbols): rule k, a row (left, right, expansion length), is the symbol terminals + k; no pair of symbols comes LEAST times."""
    seq = ids.astype(np.uint32)
    terminals = int(seq.max()) + 1 if len(seq) else 1
    lengths = np.ones(terminals, np.uint32)
    rules = [np.empty((0, 3), np.uint32)]
    open_ = np.arange(max(len(seq) - 1, 0))
    while len(open_):
        pairs, k, rank = _frequent(seq[open_].astype(np.uint64) << np.uint64(32) | seq[open_ + 1])
        if not len(pairs):
            break
        at = open_[k]
        k = _chosen(at, rank)
        places, rank_at = at[k], rank[k]
        given = np.zeros(len(pairs), bool)
        given[rank_at] = True
        number = (np.cumsum(given) - 1)[rank_at]
        first = np.empty(int(given.sum()), np.int64)
        first[number] = places
        left, right = seq[first], seq[first + 1]
        new = np.stack([left, right, lengths[left] + lengths[right]], 1)
        rest = np.ones(len(at), bool)
        rest[k] = False
        rest = at[rest]
        seq[places] = len(lengths) + number
        keep = np.ones(len(seq), bool)
        keep[places + 1] = False
        seq = seq[keep]
        lengths = np.concatenate([lengths, new[:, 2]])
        rules.append(new)
        # Places in the shorter sequence: those beside new symbols, and those of frequent pairs that are still there.
        moved = places - np.arange(len(places))
        before = np.searchsorted(places, rest - 1, "left")
        lost = places[np.minimum(before, len(places) - 1)] == rest - 1
        beside = np.zeros(len(seq) + 1, bool)
        beside[moved] = beside[moved - 1] = beside[(rest - before)[~lost]] = True
        open_ = np.flatnonzero(beside[: max(len(seq) - 1, 0)])
    return terminals, np.concatenate(rules), seq


def _unfolded(terminals: int, rules: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The ids of ``symbols``: all nonterminals give way to their two symbols, level by level."""
    seq = symbols.astype(np.uint32)
    while len(at := np.flatnonzero(seq >= terminals)):
        rule = seq[at] - terminals
        twice = np.ones(len(seq), np.uint8)
        twice[at] = 2
        seq = np.repeat(seq, twice)
        left = at + np.arange(len(at))
        seq[left], seq[left + 1] = rules[rule, 0], rules[rule, 1]
    return seq


def expand(terminals: int, rules: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The ids of ``symbols``; of many symbols each rule is unfolded once and copied to its places."""
    if len(symbols) < 2 * len(rules):
        return _unfolded(terminals, rules, symbols)
    lengths = np.concatenate([np.ones(terminals, np.int64), rules[:, 2].astype(np.int64)])
    table = np.concatenate([np.arange(terminals, dtype=np.uint32), _unfolded(terminals, rules, np.arange(terminals, terminals + len(rules)))])
    n = lengths[symbols]
    ends = np.cumsum(n)
    place = np.repeat(((np.cumsum(lengths) - lengths)[symbols] - (ends - n)).astype(np.int32), n)
    place += np.arange(len(place), dtype=np.int32)
    return table[place]


def expand_range(terminals: int, rules: np.ndarray, symbols: np.ndarray, start: int, count: int) -> np.ndarray:
    """The ids from ``start`` on, decoded from the symbols that hold them."""
    lengths = np.concatenate([np.ones(terminals, np.int64), rules[:, 2].astype(np.int64)])
    ends = np.cumsum(lengths[symbols])
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + count, "left")
    part = expand(terminals, rules, symbols[first : last + 1])
    skip = start - (ends[first] - lengths[symbols[first]]) if first < len(symbols) else 0
    return part[skip : skip + count]


def pack(ids: np.ndarray, doc_ids: list[int | None], counts: list[int]) -> bytes:
    terminals, rules, symbols = grammar(ids)
    sink = pa.BufferOutputStream()
    docs = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n": pa.array(counts, pa.int64())})
    with pa.ipc.new_stream(sink, docs.schema) as out:
        out.write_table(docs)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts = [squeeze(rules.astype("<u4").tobytes()), squeeze(symbols.astype("<u4").tobytes()), squeeze(sink.getvalue().to_pybytes())]
    return np.array([terminals, len(rules), len(symbols), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def unpack(block: bytes) -> tuple[int, np.ndarray, np.ndarray, pa.Table]:
    """(terminals, rules, symbols, documents) of a shard."""
    terminals, _, _, *sizes = np.frombuffer(block, "<u4", 6).tolist()
    ends = np.cumsum([24, *sizes])
    grow = zstandard.ZstdDecompressor().decompress
    rules, symbols, docs = (grow(block[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True))
    return terminals, np.frombuffer(rules, "<u4").reshape(-1, 3), np.frombuffer(symbols, "<u4"), pa.ipc.open_stream(docs).read_all()


@lru_cache(2)
def library_encoder(path: str) -> Encoder:
    """Chunks encoded by the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    mark, mark_id = next(((t.content, i) for i, t in tokenizer.get_added_tokens_decoder().items()), (None, None))

    def encode_chunks(texts: list[str]) -> list[bytes]:
        # Chunks share calls: the special string between them is cut out before anything else is done.
        alone = {k for k, t in enumerate(texts) if mark is None or mark in t}
        rest = [k for k in range(len(texts)) if k not in alone] if alone else range(len(texts))
        out: list[bytes] = [b""] * len(texts)
        if alone:
            order = sorted(alone)
            for k, e in zip(order, tokenizer.encode_batch_fast([texts[k] for k in order], add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, "<u4").tobytes()
        groups = [rest[lo : lo + 64] for lo in range(0, len(rest), 64)]
        for group, e in zip(groups, tokenizer.encode_batch_fast([mark.join([texts[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            data, ends = ids.tobytes(), [*(np.flatnonzero(ids == mark_id) * 4).tolist(), len(ids) * 4]
            at = 0
            for k, end in zip(group, ends, strict=True):
                out[k] = data[at:end]
                at = end + 4
        return out

    return Encoder(encode_chunks)


def write_ids(docs: DataFrame, path: str | None = None, folder: str | None = None) -> DataFrame:
    """Write the ids of every row's text, an end id behind each, in ascending doc_id order, and return the index of shards.

    Index: (part, shard, file, offset, length, n_docs, n_ids, low, high, start),
    low and high being the smallest and the greatest doc_id, start the ids of all
    shards before.  Null and empty texts have the end id
    alone.  Rows without doc_id come first; rows that repeat a doc_id follow one
    another by text.
    """
    path = path or vocabulary_path()
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, number = library_encoder(path), None, 0
        part = TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4")
        held: list[np.ndarray] = []
        names: list[int | None] = []
        counts: list[int] = []
        size = 0

        def shard() -> pa.RecordBatch:
            data = pack(np.concatenate(held), names, counts)
            known = [n for n in names if n is not None]
            row = [part, number, out.path, out.write(data), len(data), len(names), size, min(known, default=None), max(known, default=None)]
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["part", "shard", "file", "offset", "length", "n_docs", "n_ids", "low", "high"])

        for batch, ids in encoded(batches, encoder, 1, TOGETHER):
            for doc_id, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                out = out or Output(folder, ".repair")
                if held and size + len(x) + 1 > SHARD_IDS:
                    yield shard()
                    held.clear(), names.clear(), counts.clear()
                    size, number = 0, number + 1
                held += [x, end]
                names.append(doc_id)
                counts.append(len(x) + 1)
                size += len(x) + 1
        if held:
            yield shard()
        if out:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    index = saved(ordered.mapInArrow(write, "part long, shard long, file string, offset long, length long, n_docs long, n_ids long, low long, high long"), "ids-index")
    # One row for each task, then the shards of one task.
    before = index.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return index.withColumn("inside", inside).join(before.select("part", "base"), "part").withColumn("start", F.coalesce("base", F.lit(0)) + F.coalesce("inside", F.lit(0))).drop("base", "inside")


def read_ids(index: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the shards of ``index``, or of those asked for.

    For the latter only shards that may hold them are read, and of those only the symbols of their documents are expanded.
    """
    if doc_ids is None:
        return _documents(index, True)
    asked = F.array(*(F.lit(d).cast("long") for d in doc_ids)) if doc_ids else F.array().cast("array<long>")
    return _documents(index.where(F.exists(asked, lambda d: d.between(F.col("low"), F.col("high")))), True, frozenset(doc_ids))


def id_digests(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, the checksum taken of its ids as little-endian unsigned 32-bit integers."""
    return _documents(index, False)


def _documents(index: DataFrame, with_ids: bool, asked: frozenset[int] | None = None) -> DataFrame:

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, length, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source = Input(path)
                terminals, rules, symbols, docs = unpack(source.read(offset, length))
                source.close()
                counts = docs["n"].to_numpy()
                ends = np.cumsum(counts)
                rows = np.arange(len(counts))
                if asked is None:
                    ids = expand(terminals, rules, symbols)
                else:
                    rows = np.flatnonzero([d in asked for d in docs["doc_id"].to_pylist()])
                for lo in range(0, len(rows), 1000):
                    k = rows[lo : lo + 1000]
                    places = zip((ends[k] - counts[k]).tolist(), counts[k].tolist(), strict=True)
                    cut = [ids[a : a + n] if asked is None else expand_range(terminals, rules, symbols, a, n) for a, n in places]
                    last = pa.array([x.astype("<i4") for x in cut], pa.list_(pa.int32())) if with_ids else pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], pa.int64())
                    yield pa.RecordBatch.from_arrays([docs["doc_id"].combine_chunks().take(pa.array(k)), pa.array(start + ends[k] - counts[k]), pa.array(counts[k]), last], names=["doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"])

    shards = index.select("file", "offset", "length", "start").repartition(reading_tasks(index), "file", "offset")
    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, " + ("ids array<int>" if with_ids else "ids_crc32 long"))
