"""Passages that repeat across documents, found by collinear chaining of shared k-mer seeds.

1. Documents of equal text are one from here on; each copy is a passage as long
   as its text.
2. Seeds: hashes of ``K`` words, kept where the hash is among the smallest
   1 / ``RATE``, which doesn't depend on the words around, and, where ``WINDOW``
   neighbours have none of those, the least of them.  So edited passages share
   about 1 / RATE of their equal runs of K words, and two equal runs of
   K + WINDOW - 1 words share a seed for sure.
3. Every place of a shared seed is joined with one place in the document that
   holds the seed first (the first document's own with one in the last): the
   matches grow with the places, not with their pairs.
4. The matches of two documents are chained: a chain climbs in both texts, each
   match adds its words, and gaps cost; a Fenwick tree over the places in the
   second text gives the best chain to continue.
5. Chains are aligned on the words of both texts: between seeds, and outwards
   from the ends, and cut into the parts that hold ``MIN_WORDS`` equal words
   and have a share of ``LEAST_SHARE`` of them.
6. Where seeds of three and more places stand outside all passages, their first
   holders may be others than the text that the passage is from.  There, seeds
   that follow one another and have other first holders are keys in pairs, which
   are rarer, and are joined, chained and aligned as above with the first document that holds the pair.
7. Equal runs don't depend on those partners: around seeds of three and more
   places that no passage covers whole, every run of MIN_WORDS words is a key of
   its own, joined with its first holder, and runs that follow each other on one
   diagonal are put together, however long they get.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import likely, mixed, numbered, saved, sized, slices, trimmed
from sparkloom.llm.words import by_bytes, grams, hashed, word_hashes

K, RATE, WINDOW, MIN_WORDS, LEAST_SHARE = 5, 7, 16, 50, 0.8
#: Cost of a word of a gap in either text; words looked at beyond a chain's ends (more equal ones are a run of MIN_WORDS, found whole); words of a gap that are aligned.
GAP_COST, BEYOND, MOST_GAP = 0.1, MIN_WORDS, 200
#: Places between the seeds of a pair at most.
PAIR_GAP = 60
PAIR_STRIDE = PAIR_GAP + 1
#: A seed is paired with so many that follow it at most.
PAIR_STEPS = 6
#: Seeds of MIN_WORDS equal words stand over so many places at least.
LEAST_EXTENT = MIN_WORDS - K - 2 * (WINDOW - 1)
#: Ends of chains that one row asks of a text.
TOGETHER = 500
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_FEW = np.uint64((1 << 64) // RATE)
_NAMES = ["doc_id", "start_word", "end_word", "other_id", "other_start", "other_end", "equal_words"]
_FOUND = ", ".join(f"{n} long" for n in _NAMES)


def seeds_of(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, text, place) of the seeds kept in the texts whose words' hashes lie between ``offsets``."""
    g = grams(h, K)
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(offsets[1:], counts)
    at = np.arange(len(g))
    inside = at + K <= end[: len(g)]
    few = (g < _FEW) & inside
    # Windows of one text in which no hash is that small: the next small one lies behind them.
    small = np.append(np.flatnonzero(few), len(g) + WINDOW)
    bare = np.flatnonzero((small[np.searchsorted(small, at)] >= at + WINDOW) & (at + WINDOW - 1 + K <= end[: len(g)]))
    if len(bare):
        few[np.unique(bare + np.lib.stride_tricks.sliding_window_view(g, WINDOW)[bare].argmin(1))] = True
    k = np.flatnonzero(few)
    return g[k].view(np.int64), owner[k], k - offsets[owner[k]]


def _seeds(docs: DataFrame) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            seed, text, place = seeds_of(*hashed(batch.column(1)))
            ids = batch.column(0).to_numpy(zero_copy_only=False)[text]
            yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(ids), pa.array(place.astype(np.int32))], names=["key", "doc", "place"])

    return docs.mapInArrow(trimmed(find), "key long, doc long, place int")


def _shared(places: DataFrame, name: str) -> DataFrame:
    """The rows (key, doc, place) whose key more than one document holds, with its first and last document and its places in all, saved."""
    ends = saved(places.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).where("first < last"), f"{name}-ends")
    return saved(places.join(ends, "key"), name)


def _matches(shared: DataFrame) -> DataFrame:
    """(doc, other, x, y): every place of a shared key with one in its first document, those of that document with one in the last; x and y are places, doc is the greater id."""
    own = [F.min(F.when(F.col("doc") == F.col(e), F.col("place"))).alias(p) for e, p in (("first", "p"), ("last", "q"))]
    ends = saved(shared.where("doc = first or doc = last").groupBy("key").agg(*own), "places")
    rows = shared.join(ends, "key").where("doc != first or place != p")
    back = F.col("doc") == F.col("first")
    return rows.select(F.when(back, F.col("last")).otherwise(F.col("doc")).alias("doc"), F.col("first").alias("other"), F.when(back, F.col("q")).otherwise(F.col("place")).alias("x"), F.when(back, F.col("place")).otherwise(F.col("p")).alias("y"))


def chain(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Chains of matches, best first: lists of numbers of matches that climb in both texts; every match is in one chain."""
    n = len(x)
    if n > 1 and (np.diff(x) > 0).all() and (np.diff(y) > 0).all():
        return _climbing(x, y)
    order = np.lexsort((-y, x))
    places = np.unique(y)
    rank = (np.searchsorted(places, y) + 1).tolist()
    xs, ys = x.tolist(), y.tolist()
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(places) + 1)
    score, before = [0.0] * n, [-1] * n
    # Matches at one place of the first text are entered in falling order of the second, so none follows another.
    for i in order.tolist():
        level = GAP_COST / 2 * (xs[i] + ys[i])
        best = (-np.inf, -1)
        k = rank[i] - 1
        while k:
            best = max(best, tree[k])
            k &= k - 1
        gain = best[0] - level
        score[i] = K + max(gain, 0.0)
        before[i] = best[1] if gain > 0 else -1
        entry = (score[i] + level, i)
        k = rank[i]
        while k < len(tree):
            if tree[k] < entry:
                tree[k] = entry
            k += k & -k
    used = [False] * n
    out = []
    for i in sorted(range(n), key=lambda k: -score[k]):
        if used[i]:
            continue
        part = []
        while i >= 0 and not used[i]:
            used[i] = True
            part.append(i)
            i = before[i]
        out.append(part[::-1])
    return out


def _climbing(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """The chains of matches that all climb: each best continues the one before it, unless the gap costs more than what is gained; a chain ends where its score is highest."""
    cost = (GAP_COST / 2 * (np.diff(x) + np.diff(y))).tolist()
    score = [float(K)]
    begins = [0]
    for i, c in enumerate(cost, 1):
        if score[-1] > c:
            score.append(score[-1] + K - c)
        else:
            begins.append(i)
            score.append(float(K))
    out = []
    for a, b in zip(begins, [*begins[1:], len(score)], strict=True):
        while a < b:
            top = max(range(a, b), key=score.__getitem__)
            out.append((score[top], list(range(a, top + 1))))
            a = top + 1
    return [part for _, part in sorted(out, key=lambda c: -c[0])]


def _chains(matches: DataFrame, pairs: bool = False) -> DataFrame:
    """(doc, other, number, xs, ys) of the chains of two seeds and more that don't overlap.

    ``matches`` has doc, other, x and y.  With ``pairs`` a row is two matches, and x
    and y are the first one's places times PAIR_STRIDE, and the gaps to the second.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if pairs:
                # A seed is in several pairs.
                docs, (places, gaps) = rows[:, :2], np.divmod(rows[:, 2:], PAIR_STRIDE)
                rows = np.concatenate([np.hstack([docs, places]), np.hstack([docs, places + gaps])])
                rows = rows[np.lexsort(rows.T[::-1])]
                rows = rows[np.append(True, (np.diff(rows, axis=0) != 0).any(1))]
            cut = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(rows)]])
            wide = np.maximum.reduceat(rows[:, 2], starts) - np.minimum.reduceat(rows[:, 2], starts) >= K
            found = []
            for a, b in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
                x, y = rows[a:b, 2], rows[a:b, 3]
                for number, part in enumerate(chain(x, y)):
                    if x[part[-1]] - x[part[0]] >= K:
                        found.append((int(rows[a, 0]), int(rows[a, 1]), number, x[part].astype(np.int32), y[part].astype(np.int32)))
            for lo in range(0, len(found), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[lo : lo + 1000], strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], names=["doc", "other", "number", "xs", "ys"])

        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)
            last = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
            # A pair of documents may go on in the next batch.
            if held and (held[-1][-1, :2] != rows[0, :2]).any():
                yield from solve(np.concatenate(held))
                held = []
            if len(last):
                yield from solve(np.concatenate([*held, rows[: last[-1] + 1]]))
                held = []
            held.append(rows[last[-1] + 1 :] if len(last) else rows)
        if held:
            yield from solve(np.concatenate(held))

    return matches.repartition("doc", "other").sortWithinPartitions("doc", "other", "x", "y").mapInArrow(trimmed(run), "doc long, other long, number int, xs array<int>, ys array<int>")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of a longest common subsequence."""
    same = _outwards(a, b)
    a, b = a[same:], b[same:]
    if len(a) and len(b):
        back = _outwards(a[::-1], b[::-1])
        same += back
        a, b = a[: len(a) - back], b[: len(b) - back]
    if not len(a) or not len(b):
        return same
    row = np.zeros(len(b) + 1, np.int32)
    for w in a[np.isin(a, b)]:
        # A match continues the diagonal; the running maximum carries it on.
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == w, row[:-1] + 1, 0)))
    return same + int(row[-1])


def _outwards(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words from the start of both."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _onwards(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(words of a, words of b, equal ones) by which a passage goes on from the start of both: first with replaced words alone, then with words left out or put in, where two equal words make good each other one."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0, 0
    equal = a[:n] == b[:n]
    score = np.cumsum(np.where(equal, 1, -2))
    k = int(score.argmax()) + 1
    k, same = (k, int(equal[:k].sum())) if score[k - 1] > 0 else (0, 0)
    u, v = a[k : k + BEYOND], b[k : k + BEYOND]
    held = np.isin(u, v)
    best = (0.0, 0, 0, 0)
    if held.sum() > 2:
        row, column = np.zeros(len(v) + 1, np.int32), np.arange(len(v) + 1)
        for i in np.flatnonzero(held).tolist():
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(v == u[i], row[:-1] + 1, 0)))
            gain = row - 2 / 3 * np.maximum(column, i + 1)
            j = int(gain.argmax())
            best = max(best, (float(gain[j]), i + 1, j, int(row[j])))
    return k + best[1], k + best[2], same + best[3]


def _parts(pieces: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The passages of a row of pieces (start, end, start, end, equal words) that follow one another: cut where that is needed to keep LEAST_SHARE."""
    total = sum(p[4] for p in pieces)
    if total < MIN_WORDS:
        return []
    first, last = pieces[0], pieces[-1]
    if total >= LEAST_SHARE * max(last[1] - first[0], last[3] - first[2]):
        return [(first[0], last[1], first[2], last[3], total)]
    gains = np.array([p[4] - LEAST_SHARE * max(p[1] - p[0], p[3] - p[2]) for p in pieces])
    sums = np.concatenate([[0.0], np.cumsum(gains)])
    low = np.minimum.accumulate(sums)
    hi = int((sums - low)[1:].argmax()) + 1
    lo = int(sums[:hi].argmin())
    if (lo, hi) == (0, len(pieces)):
        return []
    return _parts(pieces[:lo]) + _parts(pieces[lo:hi]) + _parts(pieces[hi:])


def align(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Passages (start, end, start, end, equal words) of texts ``a`` and ``b`` along a chain of seeds at ``xs`` and ``ys``."""
    i, j, same = _onwards(a[: xs[0]][::-1], b[: ys[0]][::-1])
    x, y = int(xs[0]), int(ys[0])
    pieces = [(x - i, x, y - j, y, same), (x, x + K, y, y + K, K)]
    out = []
    for x, y in zip(xs[1:].tolist(), ys[1:].tolist(), strict=True):
        _, p, _, q, _ = pieces[-1]
        if x < p or y < q:
            # Overlapping seeds on one diagonal lengthen the passage; others add nothing.
            if x - p == y - q:
                pieces.append((p, x + K, q, y + K, x + K - p))
            continue
        u, v = a[p:x], b[q:y]
        near = max(len(u), len(v)) <= MOST_GAP
        same = _common(u, v) if near else 0
        if not near or same < LEAST_SHARE * max(len(u), len(v)):
            # The ends of the gap may belong to passages that its middle parts.
            i, j, ahead = _onwards(u, v)
            k, m, behind = _onwards(u[i:][::-1], v[j:][::-1])
            pieces.append((p, p + i, q, q + j, ahead))
            if near:
                pieces.append((p + i, x - k, q + j, y - m, same - ahead - behind))
            else:
                out += _parts(pieces)
                pieces = []
            pieces.append((x - k, x, y - m, y, behind))
        else:
            pieces.append((p, x, q, y, same))
        pieces.append((x, x + K, y, y + K, K))
    _, p, _, q, _ = pieces[-1]
    i, j, same = _onwards(a[p:], b[q:])
    pieces.append((p, p + i, q, q + j, same))
    return out + _parts(pieces)


def _slices(docs: DataFrame, chains: DataFrame) -> DataFrame:
    """(doc, other, number, side, low, places, words): for both sides of every chain its places and the hashes of the words from ``low`` on."""
    key = ["doc", "other", "number"]
    sides = None
    for side, (name, places) in enumerate((("doc", "xs"), ("other", "ys"))):
        one = chains.select(F.col(name).alias("id"), *key, F.lit(side).alias("side"), F.col(places).alias("places"))
        sides = one if sides is None else sides.unionByName(one)
    # A document that is the first of many others is asked in many rows.
    counts = saved(sides.groupBy("id").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts")), "asked")
    part = F.pmod(F.xxhash64(*key), F.col("parts"))
    asked = saved(sides.join(counts, "id").groupBy("id", part.alias("part")).agg(F.collect_list(F.struct(*key, "side", "places")).alias("asked")).select("id", "asked"), "slices")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 0):
            h, offsets = hashed(batch.column(0))
            rows: list[tuple] = []
            size = 0
            for a, b, wanted in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(1).to_pylist(), strict=True):
                for w in wanted:
                    low, high = max(min(w["places"]) - BEYOND, 0), max(w["places"]) + K + BEYOND
                    rows.append((w["doc"], w["other"], w["number"], w["side"], low, w["places"], h[a + low : min(a + high, b)].tobytes()))
                    size += len(rows[-1][-1])
                    if size > 4 << 20:
                        yield made(rows)
                        rows, size = [], 0
            if rows:
                yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()), strict=True)], names=[*key, "side", "low", "places", "words"])

    # Most texts are asked for nothing and aren't shuffled.
    joined = likely(docs, "doc_id", counts).join(asked, F.col("doc_id") == F.col("id")).select("text", "asked")
    return joined.mapInArrow(trimmed(cut), "doc long, other long, number int, side int, low int, places array<int>, words binary")


def _aligned(docs: DataFrame, chains: DataFrame) -> DataFrame:
    """The passages along the chains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in slices(batches, 200):
            found: list[tuple] = []
            for doc, other, _, side, low, places, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, places = np.frombuffer(words, np.uint64), np.array(places) - low
                if side == 0:
                    held = (low, places, words)
                    continue
                at, xs, a = held
                for s, e, t, f, same in align(a, words, xs, places):
                    found.append((doc, s + at, e + at, other, t + low, f + low, same))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=_NAMES)

    key = ["doc", "other", "number"]
    return _slices(docs, chains).repartition(*key).sortWithinPartitions(*key, "side").mapInArrow(trimmed(run), _FOUND)


def stretches(places: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) places at which a run of MIN_WORDS may start that another text shares, given all places of shared seeds, sorted.

    The seeds of the windows inside such a run are the same in both texts: the
    first one stands at most WINDOW - 1 places behind the run's start, the next
    ones at most WINDOW apart, the last one LEAST_EXTENT behind the first or more.
    """
    cut = np.flatnonzero(np.diff(places) > WINDOW) + 1
    out = []
    for part in np.split(places, cut):
        first = part[part <= part[-1] - LEAST_EXTENT] if len(part) else part
        if len(first):
            out.append((max(int(first[0]) - WINDOW + 1, 0), int(first[-1])))
    return out


def uncovered(places: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of ``stretches`` from which a run of MIN_WORDS leaves the spans (start, end)."""
    out = []
    for low, high in stretches(places):
        bare = np.ones(high + MIN_WORDS - low, np.int64)
        for s, e in spans:
            bare[max(s - low, 0) : max(e - low, 0)] = 0
        sums = np.concatenate([[0], np.cumsum(bare)])
        leaves = (sums[MIN_WORDS:] > sums[:-MIN_WORDS])[: high - low + 1]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], leaves.astype(np.int8), [0]])))
        out += [(low + int(a), low + int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return out


def _open_seeds(shared: DataFrame, found: DataFrame) -> DataFrame:
    """The shared seeds around which a run of MIN_WORDS that an earlier document holds may be covered by no passage, or not whole.

    Seeds of two places are settled: their two documents have met there.
    """
    spans = found.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    lists = shared.where("doc != first").groupBy("doc").agg(F.collect_list(F.struct("place", "key", "n")).alias("seeds")).where(F.exists("seeds", lambda s: s["n"] > 2))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            keys = []
            for seeds, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = np.array([(s["place"], s["key"], s["n"]) for s in seeds], np.int64)
                rows = rows[rows[:, 0].argsort()]
                open_ = np.zeros(len(rows), bool)
                for low, high in uncovered(np.unique(rows[:, 0]), [(s["start_word"], s["end_word"]) for s in spans or ()]):
                    near = (rows[:, 0] >= low) & (rows[:, 0] <= high + MIN_WORDS - K)
                    if (rows[near, 2] > 2).any():
                        open_ |= near
                keys.append(rows[open_, 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], names=["key"])

    return lists.join(spans, "doc", "left").select("seeds", "spans").mapInArrow(trimmed(find), "key long").distinct()


def _pairs(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(key, doc, at) of pairs of seeds, each with the next PAIR_STEPS, of those that stand outside of the passages in some document; at is the first one's place times PAIR_STRIDE, and the gap.

    Two seeds of one first document have met that one already and are no pair.
    """
    spans = found.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    lists = shared.where("doc != first and n > 2").groupBy("doc").agg(F.collect_list(F.struct("place", "key")).alias("seeds"))

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            keys = []
            for seeds, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = np.array([(s["place"], s["key"]) for s in seeds], np.int64)
                bare = np.ones(len(rows), bool)
                for x in spans or ():
                    bare &= (rows[:, 0] < x["start_word"]) | (rows[:, 0] + K > x["end_word"])
                rows = rows[bare]
                rows = rows[rows[:, 0].argsort()]
                # Seeds at most PAIR_GAP apart; one by itself is in no pair.
                cut = np.flatnonzero(np.diff(rows[:, 0]) > PAIR_GAP) + 1
                keys += [part[:, 1] for part in np.split(rows, cut) if len(part) > 1]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], names=["key"])

    open_ = saved(lists.join(spans, "doc", "left").select("seeds", "spans").mapInArrow(trimmed(outside), "key long").distinct(), "outside")
    held = shared.join(sized(open_), "key", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("place", "key", "first")).alias("seeds"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            parts = []
            for doc, seeds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = np.array([(s["place"], s["key"], s["first"]) for s in seeds], np.int64)
                rows = rows[rows[:, 0].argsort()]
                for step in range(1, PAIR_STEPS + 1):
                    a, b = rows[:-step], rows[step:]
                    near = (b[:, 0] - a[:, 0] <= PAIR_GAP) & (a[:, 2] != b[:, 2])
                    a, b = a[near], b[near]
                    key = mixed(mixed(a[:, 1].view(np.uint64).copy()) + b[:, 1].view(np.uint64)).view(np.int64)
                    parts.append(np.stack([key, np.full(len(a), doc), a[:, 0] * PAIR_STRIDE + b[:, 0] - a[:, 0]], 1))
            if parts:
                whole = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in whole.T], names=["key", "doc", "at"])

    return held.mapInArrow(trimmed(pair), "key long, doc long, at long")


def _pair_matches(pairs: DataFrame) -> DataFrame:
    """(doc, other, x, y): every pair of seeds, as one row, with the first document that holds it."""
    ends = saved(pairs.groupBy("key").agg(F.min(F.struct("doc", "at")).alias("f"), F.max("doc").alias("last")).where("f.doc < last").select("key", F.col("f.doc").alias("other"), F.col("f.at").alias("y")), "pair-ends")
    return pairs.join(ends, "key").where("doc != other").select("doc", "other", F.col("at").alias("x"), "y")


def _equal_runs(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The passages of MIN_WORDS and more equal words around the seeds at ``places`` (doc, place): every place of one, with a document that holds it too."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            found = [stretches(np.array(p)) for p in batch.column(1).to_pylist()]
            keep = pa.array([bool(f) for f in found], pa.bool_())
            lists = [pa.array([[x[k] for x in f] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["id", "lows", "highs"]).filter(keep)

    lists = places.groupBy("doc").agg(F.sort_array(F.collect_set("place")).alias("places")).where(F.element_at("places", -1) - F.element_at("places", 1) >= LEAST_EXTENT)
    wanted = saved(lists.mapInArrow(trimmed(find), "id long, lows array<int>, highs array<int>"), "stretches")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            h, offsets = hashed(batch.column(1))
            keys, ids, at = [], [], []
            for doc, a, b, lows, highs in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                for low, high in zip(lows, highs, strict=True):
                    part = grams(h[a + low : min(a + high + MIN_WORDS, b)], MIN_WORDS)
                    keys.append(part)
                    ids.append(np.full(len(part), doc, np.int64))
                    at.append(np.arange(low, low + len(part), dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(at))], names=["key", "doc", "place"])

    joined = likely(docs, "doc_id", wanted).join(sized(wanted), F.col("doc_id") == F.col("id")).select("doc_id", "text", "lows", "highs")
    runs = _shared(saved(joined.mapInArrow(trimmed(cut), "key long, doc long, place int"), "runs"), "shared-runs")
    matches = _matches(runs).select("doc", "other", (F.col("x") - F.col("y")).alias("diagonal"), "x")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # the passage that the next rows may continue: doc, other, diagonal, first and last place
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)
            rows = np.column_stack([rows, rows[:, 3]])
            if held is not None:
                rows = np.concatenate([held[None], rows])
            cut = np.flatnonzero((np.diff(rows[:, :3], axis=0) != 0).any(1) | (rows[1:, 3] - rows[:-1, 4] > MIN_WORDS)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(rows)]]) - 1
            whole = np.column_stack([rows[starts, :4], rows[ends, 4]])
            held = whole[-1]
            yield passages_of(whole[:-1])
        if held is not None:
            yield passages_of(held[None])

    def passages_of(rows: np.ndarray) -> pa.RecordBatch:
        doc, other, diagonal, low, high = rows.T
        high = high + MIN_WORDS
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (doc, low, high, other, low - diagonal, high - diagonal, high - low)], names=_NAMES)

    return matches.repartition("doc", "other").sortWithinPartitions("doc", "other", "diagonal", "x").mapInArrow(trimmed(merge), _FOUND)


def _copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, passages): the first document of every text, and for each other one the passage that is its whole text.

    Ids that stand for several texts are left out, and rows that repeat an id and its text.
    """
    text_id = F.unhex(F.sha2("text", 256))
    ids = saved(docs.select("doc_id", text_id.alias("text_id")).groupBy("doc_id").agg(F.min("text_id").alias("text_id"), F.max("text_id").alias("last"), F.count("*").alias("rows")), "texts")
    same = saved(ids.where("text_id = last").groupBy("text_id").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("text_id", "first"), "same")
    gone = saved(docs.join(sized(same), text_id == F.col("text_id")).where("doc_id != first").select("doc_id", "first", "text"), "copies")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            n = np.diff(hashed(batch.column(2))[1])
            zero = np.zeros(len(n), np.int64)
            rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(zero), pa.array(n), batch.column(1), pa.array(zero), pa.array(n), pa.array(n)], names=_NAMES)
            yield rows.filter(pa.array(n >= MIN_WORDS))

    odd = ids.where("text_id != last").select("doc_id")
    out = saved(gone.select("doc_id").union(ids.where("text_id != last or rows > 1").select("doc_id")).distinct(), "gone")
    rest = docs.join(sized(out), "doc_id", "left_anti")
    twice = saved(ids.where("text_id = last and rows > 1").select("doc_id").join(gone.select("doc_id"), "doc_id", "left_anti"), "twice")
    if not twice.isEmpty():
        rest = rest.unionByName(docs.join(sized(twice), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return rest, gone.join(sized(odd), "doc_id", "left_anti").mapInArrow(trimmed(count), _FOUND)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, other_id, other_start, other_end, equal_words) of passages that two documents share.

    ``docs`` has doc_id and text; other columns are ignored.  A passage has at
    least MIN_WORDS equal words and a share of LEAST_SHARE of them; words are
    numbered from 0, ends are exclusive, doc_id > other_id.  Every document that
    shares a passage is in a row with a document that holds it, not with all of
    them; this is sure of equal words, wherever parts of the passage stand, not
    of edited ones.  Repeats inside one document aren't looked for.  Null and
    empty texts and rows without doc_id share nothing, nor do rows whose doc_id
    stands for several texts: their words couldn't be told apart by it.  Rows
    that repeat a doc_id and a text count once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    rows, copies = _copies(rows)
    shared = _shared(saved(_seeds(rows), "all-seeds"), "seeds")
    chains = saved(_chains(_matches(shared)), "chains")
    found = saved(_aligned(rows, chains), "passages")
    more = saved(_chains(_pair_matches(saved(_pairs(shared, found), "pairs")), pairs=True), "pair-chains")
    found = found.unionByName(saved(_aligned(rows, more), "pair-passages"))
    open_ = saved(_open_seeds(shared, found), "open-seeds")
    runs = _equal_runs(rows, shared.join(sized(open_), "key", "left_semi"))
    return found.unionByName(runs).unionByName(copies).distinct()


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space behind them."""
    raw = text.encode()
    gone = np.zeros(1 + max(e for _, e in spans), bool)
    for s, e in spans:
        gone[s:e] = True
    out, at = [], 0
    places = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    for k in range(min(len(gone), len(places) - 1)):
        if gone[k]:
            out.append(raw[at : places[k]])
            at = places[k + 1]
    out.append(raw[at:])
    return b"".join(out).decode()


def deduplicated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the passages of ``found`` in the documents of the greater id; a document of which nothing is left goes.

    n_chars, if there, is counted anew where the text has changed.  Other
    columns stay as they are, whatever their names.
    """
    plain, names = numbered(docs)
    inner = plain.columns
    lists = saved(found.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans")), "spans")
    joined = plain.join(sized(lists), F.col(inner[names.index("doc_id")]) == F.col("id"), "left")
    place = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, place):
            texts = batch.column(place).to_pylist()
            spans = batch.column(len(names)).to_pylist()
            new = [t if s is None or t is None else without_spans(t, [(x["start_word"], x["end_word"]) for x in s]) for t, s in zip(texts, spans, strict=True)]
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(new, pa.string())
            keep = pa.array([s is None or not t or bool(n.strip()) for t, n, s in zip(texts, new, spans, strict=True)], pa.bool_())
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([c if s is None or n is None else len(n) for c, n, s in zip(columns[k].to_pylist(), new, spans, strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=inner).filter(keep)

    return joined.select(*inner, "spans").mapInArrow(trimmed(cut), plain.schema).toDF(*names)
