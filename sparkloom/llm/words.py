"""Hashes of the words of whole columns of texts, and seeds and runs made of them, as array operations.

Words are runs of bytes outside a class of separators, A-Z lower-cased.  A word of
up to seven bytes is its own hash, so two of them never share one; a longer one
is a polynomial of its blocks of seven bytes modulo the prime 2**61 - 1, where two
different words of n blocks meet with a chance of n / 2**61 at most; one of over
``LONG`` bytes is 64 bits of BLAKE2b.  The three kinds lie in ranges of their own,
and a bijection spreads the bits.  No word is ever a Python object but a very long
one, and nothing is kept between batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sparkloom.llm.common import mixed, odd_numbers

#: Bytes of texts whose words are held together; words of more bytes are hashed by BLAKE2b.
TOGETHER, LONG = 1 << 20, 64
#: Zero bytes that stand behind the texts, so that eight bytes can be read at any of them.
PADDING = 8
_PLACES = odd_numbers(64, 11)
_PRIME = np.uint64((1 << 61) - 1)
_BASE = int(odd_numbers(1, 21)[0]) % int(_PRIME)
_HIGH, _LOW = np.uint64(_BASE >> 31), np.uint64(_BASE & ((1 << 31) - 1))
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A class of bytes: those from the first to the last of each range."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Space and the controls from tab to carriage return.
SPACES = separators((32, 32), (9, 13))


def _times_base(x: np.ndarray) -> np.ndarray:
    """x times the base modulo the prime, by halves; x is below the prime."""
    high, low = x >> np.uint64(31), x & np.uint64((1 << 31) - 1)
    middle = high * _LOW + low * _HIGH
    total = np.uint64(2) * high * _HIGH + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + low * _LOW
    return _reduced(total)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number; ``raw`` is padded."""
    return np.ndarray((max(len(raw) - 7, 0),), "<u8", raw, 0, (1,))


def range_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``first`` to ``last``, ranges of at least a byte; PADDING bytes stand behind the last one."""
    size = last - first
    at = eights(raw)
    out = (at[first] & _FIRST[np.minimum(size, 7)]) | (np.minimum(size, 8).astype(np.uint64) << np.uint64(56))
    long = np.flatnonzero(size > 7)
    if len(long):
        long = long[np.argsort(-size[long], kind="stable")]
        n, where = size[long], first[long]
        x = n.astype(np.uint64)
        huge = int((n > LONG).sum())
        for k in range(-(-min(int(n[0]), LONG) // 7)):
            some = slice(huge, int(np.searchsorted(-n, -7 * k)))
            block = at[where[some] + 7 * k] & _FIRST[np.minimum(n[some] - 7 * k, 7)]
            x[some] = _reduced(_times_base(x[some]) + block)
        x |= np.uint64(1 << 61)
        for k in range(huge):
            digest = hashlib.blake2b(raw[where[k] : where[k] + n[k]].tobytes(), digest_size=8).digest()
            x[k] = int.from_bytes(digest, "little") | 3 << 62
        out[long] = x
    return mixed(out)


def same_ranges(raw: np.ndarray, first: np.ndarray, other: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of ``raw`` at each ``first`` are those of ``other`` at ``place``, ``size`` of them; both are padded."""
    out = np.ones(len(size), bool)
    a, b = eights(raw), eights(other)
    order = np.argsort(-size, kind="stable")
    n, x, y = size[order], first[order], place[order]
    for k in range(-(-int(n[0]) // 8) if len(n) else 0):
        some = slice(0, int(np.searchsorted(-n, -8 * k)))
        mask = _FIRST[np.minimum(n[some] - 8 * k, 8)]
        out[order[some]] &= (a[x[some] + 8 * k] & mask) == (b[y[some] + 8 * k] & mask)
    return out


def word_spans(column: pa.Array, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(raw, offsets, first, last, bounds): the padded, lower-cased bytes of all texts (``apart`` is a class of these), where each text and each word begins and ends, and which words are of which text; null texts have none."""
    plain, offsets = text_bytes(column)
    raw = np.zeros(len(plain) + PADDING, np.uint8)
    raw[: len(plain)] = _LOWER[plain]
    if not len(plain):
        none = np.empty(0, np.int64)
        return raw, offsets, none, none, np.zeros(len(offsets), np.int64)
    gap = apart[raw[: len(plain)]]
    inner = offsets[(offsets > 0) & (offsets < len(plain))]
    begins, ends = ~gap, ~gap
    begins[1:] &= gap[:-1]
    begins[inner] = ~gap[inner]
    ends[:-1] &= gap[1:]
    ends[inner - 1] = ~gap[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return raw, offsets, first, last, np.searchsorted(first, offsets)


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the words of all texts of a column, and where each text's begin and end; null texts have none."""
    raw, _, first, last, bounds = word_spans(column)
    return range_hashes(raw, first, last), bounds


class Vocabulary:
    """Different words as numbers from 0, found by hash and told apart by their bytes."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        self._first = np.append(0, ends[:-1])[: len(words)].astype(np.int64)
        self._size = ends - self._first
        self._raw = np.frombuffer(b"".join(words) + bytes(PADDING), np.uint8)
        hashes = range_hashes(self._raw, self._first, ends) if words else np.empty(0, np.uint64)
        self._order = np.argsort(hashes, kind="stable")
        self._hashes = hashes[self._order]
        self._number = {w: k for k, w in enumerate(words)}

    def find(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The number of each word of a text's bytes, -1 for those that aren't here."""
        out = np.full(len(first), -1, np.int64)
        if not len(self.words) or not len(first):
            return out
        h = range_hashes(raw, first, last)
        at = np.minimum(np.searchsorted(self._hashes, h), len(h) and len(self._hashes) - 1)
        hit = np.flatnonzero(self._hashes[at] == h)
        found = self._order[at[hit]]
        out[hit] = found
        size = last[hit] - first[hit]
        long = np.flatnonzero(size > 7)
        same = self._size[found[long]] == size[long]
        checked = long[same]
        same[same] = same_ranges(raw, first[hit[checked]], self._raw, self._first[found[checked]], size[checked])
        for k in hit[long[~same]].tolist():
            out[k] = self._number.get(raw[first[k] : last[k]].tobytes(), -1)
        return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the bytes of all texts of a column, and where each text's begin and end; null texts are empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(column.buffers()[2], np.uint8)[low:high] if high > low else np.empty(0, np.uint8)
    return raw, offsets - low


def padded(raw: np.ndarray) -> np.ndarray:
    return np.concatenate([raw, np.zeros(PADDING, np.uint8)])


def texts_of(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The ranges of a text's bytes, which begin and end between characters, as strings."""
    size = last - first
    ends = np.cumsum(size)
    place = np.repeat(first - (ends - size), size)
    place += np.arange(len(place))
    offsets = np.append(0, ends).astype(np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[place])))


def word_hashes(text: str | None) -> np.ndarray:
    """The hashes of one text's words."""
    return hashed(pa.array([text], pa.string()))[0]


def by_bytes(batches: Iterator[pa.RecordBatch], place: int, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts, in column ``place``, have about ``most`` bytes together; a longer text is alone."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = int(sizes[lo - 1]) if lo else 0
            hi = max(int(np.searchsorted(sizes, before + most, "right")), lo + 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def grams(h: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all runs of ``length`` words: of up to 16 by a weighted sum, of longer ones by runs of 2, 4, 8 and so on, the last two of which may overlap; all are mixed at each step."""
    n = len(h) - length + 1
    if n < 1:
        return np.empty(0, np.uint64)
    if length <= len(_PLACES) // 4:
        total = h[:n] * _PLACES[0]
        for k in range(1, length):
            total += h[k : n + k] * _PLACES[k]
        return mixed(total)
    run, held = h, 1
    while held < length:
        step = min(held, length - held)
        a, b = _PLACES[2 * held.bit_length()], _PLACES[2 * held.bit_length() + 1]
        run = mixed(run[: len(run) - step] * a + run[step:] * b)
        held += step
    return run
