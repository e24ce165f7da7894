"""Byte-level BPE by a pair occurrence index.

The vocabulary file is that of the tokenizers library.  A text is cut at single
spaces into chunks that the library's pre-tokenizer can't join (see
``Encoder``); the ids of a chunk never depend on its neighbours.  The chunks of a
batch that the task hasn't met yet are encoded together: their symbols lie in
one linked list, an index maps each mergeable pair to all its positions, and
the active ranks are applied in ascending order, each to all its positions at
once.  A merge puts the pairs it makes on the lists of their ranks, which are
higher than its own; positions that a merge has taken away fail the check
against the current symbols.  So every step works on whole arrays.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import numbered, odd_numbers, slices
from sparkloom.llm.words import PADDING, by_bytes, eights, padded, range_hashes, same_ranges, text_bytes

#: Chunks whose ids a task keeps.
KEPT_CHUNKS = 700_000
#: Bytes of texts whose new chunks share one pair index.
TOGETHER = 12_000_000
_GAP, _GONE = -1, -2


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The file of a public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Bpe:
    """Merges, special strings and bytes of one vocabulary file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.first = np.array([ids[c] for c in letters], np.int32)
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = left * self.size + right
        self._order = np.argsort(keys, kind="stable")
        self._keys = keys[self._order]
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        self.bytes_of = [b""] * self.size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self._words = regex.compile(pattern)
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or the number of merges if it isn't one."""
        key = a.astype(np.int64) * self.size + b
        key[(a | b) < 0] = -1
        at = np.searchsorted(self._keys[:-1], key)
        return np.where(self._keys[at] == key, self._order[at], len(self._keys))

    def encode_chunks(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        words: list[bytes] = []
        owner: list[int] = []
        fixed: dict[int, int] = {}
        for k, text in enumerate(texts):
            for piece in self._special.split(text) if self._special and any(s in text for s in self.special) else (text,):
                if piece in self.special:
                    fixed[len(words)] = self.special[piece]
                    found = [b"?"]
                else:
                    found = [w.encode() for w in self._words.findall(piece)]
                words += found
                owner += [k] * len(found)
        if not words:
            return [b""] * len(texts)
        # A gap stands before each word and behind the last one.
        gaps = np.cumsum([0, *(len(w) + 1 for w in words)])
        sym = np.empty(gaps[-1] + 1, np.int32)
        letters = np.ones(len(sym), bool)
        letters[gaps] = False
        sym[gaps] = _GAP
        sym[letters] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        for w, i in fixed.items():
            sym[gaps[w] + 1] = -3 - i  # no pair holds a negative symbol
        self._merge(sym)
        alive = sym != _GONE
        word = np.cumsum(sym == _GAP)[alive] - 1
        ids = sym[alive]
        keep = ids != _GAP
        word, ids = word[keep], ids[keep]
        ids = np.where(ids <= -3, -3 - ids, ids).astype("<u4")
        counts = np.bincount(np.asarray(owner)[word], minlength=len(texts))
        ends = np.cumsum(counts) * 4
        data = ids.tobytes()
        return [data[e - 4 * n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]

    def _merge(self, sym: np.ndarray) -> None:
        """Apply all merges in place; taken positions become _GONE."""
        n = len(sym)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        none = len(self._keys)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(rank: np.ndarray, at: np.ndarray) -> None:
            found = rank < none
            rank, at = rank[found], at[found]
            if not len(rank):
                return
            if len(rank) == 1 or (rank[0] == rank).all():
                groups = [(int(rank[0]), at)]
            else:
                order = np.argsort(rank, kind="stable")
                rank, at = rank[order], at[order]
                cut = np.flatnonzero(np.diff(rank)) + 1
                groups = zip(rank[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True)
            for r, positions in groups:
                if r in index:
                    index[r].append(positions)
                else:
                    index[r] = [positions]
                    heapq.heappush(active, r)

        enter(self.ranks(sym[:-1], sym[1:]), np.arange(n - 1, dtype=np.int32))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b = self.left[r], self.right[r]
            at = at[sym[at] == a]
            at = at[sym[nxt[at]] == b]
            if a == b and len(at) > 1:
                at = self._apart(at, nxt)
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = self.merged[r], _GONE
            nxt[at], prv[after] = after, at
            left, right = np.concatenate([prv[at], at]), np.concatenate([at, after])
            enter(self.ranks(sym[left], sym[right]), left)

    @staticmethod
    def _apart(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """Of positions of a pair of equal symbols, those that merge from the left without overlap."""
        follows = np.zeros(len(at), bool)
        follows[1:] = nxt[at[:-1]] == at[1:]
        start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
        return at[(np.arange(len(at)) - start) % 2 == 0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special ones included; bytes that aren't UTF-8 become the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


#: The pre-tokenizer's pattern, fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def bpe(path: str) -> Bpe:
    return Bpe(path, PATTERN)


_SPACED = re.compile(r"\s*\S+|\s+")


class Encoder:
    """Texts to ids by chunks; the ids of chunks seen lately are kept.

    A pre-token is a run of white space, or a run of other characters with one
    space before it at most.  So a space between two characters that aren't
    spaces always begins one, and a text without two spaces in a row is cut
    before each space.  Other texts are cut before each run of white space.
    Chunks are found by a hash of their size, their first eight bytes and their last
    eight, and of all bytes beyond 16.  What is found under a hash is compared: by
    size and these two numbers, which are all bytes of up to 16, and longer chunks
    with the bytes that are kept.
    """

    def __init__(self, encode_chunks: Callable[[list[str]], list[bytes]]) -> None:
        self._encode = encode_chunks
        self._forget()

    def _forget(self) -> None:
        self._number: dict[int, int] = {}
        self._starts = self._counts = self._places = self._sizes = np.empty(0, np.int64)
        self._heads = self._tails = np.empty(0, np.uint64)
        self._ids = np.empty(0, np.uint32)
        self._bytes = np.zeros(PADDING, np.uint8)

    def __call__(self, texts: pa.Array | list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; chunks that aren't kept are encoded first, all together.  Beyond the bound all that is kept goes."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        raw, offsets = text_bytes(column)
        first = _chunk_starts(raw, offsets, column)
        last = np.append(first[1:], len(raw))[: len(first)]
        raw = padded(raw)
        size = last - first
        heads, tails = _ends(raw, first, size)
        hashes = _hashes(raw, first, last, heads, tails)
        order = np.argsort(hashes)
        ordered = hashes[order]
        begins = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
        keys, at = ordered[begins], order[begins]
        inverse = np.empty(len(order), np.int32)
        inverse[order] = np.cumsum(begins, dtype=np.int32) - 1
        if len(self._number) > KEPT_CHUNKS:
            self._forget()
        number = np.fromiter(map(self._number.get, keys.tolist(), repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(number < 0)
        if len(new):
            some = at[new]
            data = raw.tobytes()
            chunks = [data[a:b] for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True)]
            found = self._encode([c.decode() for c in chunks])
            counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
            number[new] = len(self._number) + np.arange(len(new))
            self._number.update(zip(keys[new].tolist(), number[new].tolist(), strict=True))
            sizes = size[some]
            kept = len(self._bytes) - PADDING + np.cumsum(sizes) - sizes
            self._places, self._sizes = np.concatenate([self._places, kept]), np.concatenate([self._sizes, sizes])
            self._heads, self._tails = np.concatenate([self._heads, heads[some]]), np.concatenate([self._tails, tails[some]])
            self._starts, self._counts = np.concatenate([self._starts, len(self._ids) + np.cumsum(counts) - counts]), np.concatenate([self._counts, counts])
            self._ids = np.concatenate([self._ids, np.frombuffer(b"".join(found), "<u4")])
            self._bytes = np.concatenate([self._bytes[:-PADDING], np.frombuffer(b"".join(chunks) + bytes(PADDING), np.uint8)])
        which = number[inverse]
        counts, starts, own = self._counts[which], self._starts[which], self._ids
        same = (self._heads[which] == heads) & (self._tails[which] == tails) & (self._sizes[which] == size)
        long = np.flatnonzero((size > 16) & same)
        if len(long):
            same[long] = same_ranges(raw, first[long], self._bytes, self._places[which[long]], size[long])
        if not same.all():
            # Another chunk has the hash: these are encoded by themselves.
            strange = np.flatnonzero(~same)
            found = self._encode([raw[first[k] : last[k]].tobytes().decode() for k in strange.tolist()])
            more = np.fromiter(map(len, found), np.int64, len(found)) // 4
            counts[strange], starts[strange] = more, len(own) + np.cumsum(more) - more
            own = np.concatenate([own, np.frombuffer(b"".join(found), "<u4")])
        ends = np.cumsum(counts)
        place = np.repeat(starts - (ends - counts), counts)
        place += np.arange(len(place))
        ids = own[place]
        bounds = np.append(0, ends)[np.searchsorted(first, offsets)].tolist()
        return (ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))


_ODD = odd_numbers(3, 31)


def _ends(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight bytes of each range as a number, fewer of a shorter one, and the last eight, 0 of one of up to eight."""
    at = eights(raw)
    heads = at[first] & _FIRST_BYTES[np.minimum(size, 8)]
    tails = np.zeros(len(first), np.uint64)
    long = np.flatnonzero(size > 8)
    tails[long] = at[first[long] + size[long] - 8]
    return heads, tails


_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    size = last - first
    out = (heads * _ODD[0] + tails) * _ODD[1] + size.astype(np.uint64) * _ODD[2]
    out ^= out >> np.uint64(31)
    long = np.flatnonzero(size > 16)
    if len(long):
        out[long] = range_hashes(raw, first[long], last[long])
    return out


def _chunk_starts(raw: np.ndarray, offsets: np.ndarray, column: pa.Array) -> np.ndarray:
    """Where the chunks of the texts begin, all in ascending order; empty texts have none."""
    space = raw == 32
    twice = np.flatnonzero(space[:-1] & space[1:])
    owner = np.searchsorted(offsets, twice, "right") - 1
    spaced = np.unique(owner[twice + 1 < offsets[owner + 1]])
    begins = space
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    for k in spaced.tolist():
        a, b = int(offsets[k]), int(offsets[k + 1])
        begins[a:b] = False
        sizes = [len(x.encode()) for x in _SPACED.findall(column[k].as_py())]
        begins[a + np.cumsum([0, *sizes[:-1]])] = True
    return np.flatnonzero(begins)


def encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder, place: int, together: int = TOGETHER) -> Iterator[tuple[pa.RecordBatch, Iterator[np.ndarray]]]:
    """Batches with the ids of each text; texts of up to ``together`` bytes, or one longer one, are encoded at a time.

    The ids of a batch are to be used up before the next batch is asked for.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> Iterator[tuple[pa.RecordBatch, Iterator[np.ndarray]]]:
        ids = encoder(pa.concat_arrays([b.column(place) for b in held]))
        for batch in held:
            yield batch, islice(ids, batch.num_rows)

    for batch in by_bytes(batches, place, together):
        more = pc.sum(pc.binary_length(batch.column(place))).as_py() or 0
        if held and size + more > together:
            yield from flush()
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield from flush()


@lru_cache(2)
def pair_index_encoder(path: str) -> Encoder:
    return Encoder(bpe(path).encode_chunks)


def encode(docs: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``ids`` array<int> of the column's text, in place of a column of that name.  Null and empty texts have no ids."""
    path = path or vocabulary_path()
    plain, names = numbered(docs, "ids")
    inner, place = plain.columns, names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pair_index_encoder(path)
        for batch, ids in encoded(batches, encoder, place):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.view("<i4") for x in ids], pa.list_(pa.int32()))], names=[*inner, "ids"])

    return plain.mapInArrow(run, plain.withColumn("ids", F.lit(None).cast("array<int>")).schema).toDF(*names, "ids")


def decode(rows: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """The rows with ``decoded`` string of the column's ids, in place of a column of that name; null ids give null."""
    path = path or vocabulary_path()
    plain, names = numbered(rows, "decoded")
    inner, place = plain.columns, names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in slices(batches, 500):
            texts = [None if x is None else model.decode(x) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*inner, "decoded"])

    return plain.mapInArrow(run, plain.withColumn("decoded", F.lit(None).cast("string")).schema).toDF(*names, "decoded")


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoding, decoding and both digests in one pass.

    Digests are taken of the decimal ids joined by commas and of the decoded
    text in UTF-8.  A null text counts as empty.  Rows are independent, so
    repeated rows and null ids of documents are kept as they are.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, encoder = bpe(path), pair_index_encoder(path)
        decimal = [str(i) for i in range(model.size)]
        for batch, ids in encoded(batches, encoder, 1):
            counts, said, back = [], [], []
            for x in ids:
                counts.append(len(x))
                numbers = x.tolist()
                said.append(hashlib.sha256(",".join(map(decimal.__getitem__, numbers)).encode()).hexdigest())
                back.append(hashlib.sha256(model.decode(numbers).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(said), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
