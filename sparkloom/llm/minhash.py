"""MinHash near-duplicates whose banded candidates are checked by odd sketches.

A document's set holds its distinct shingles of ``words`` words; a document of
fewer words has its whole word sequence as its one shingle, a document without
words or text has the empty set and links with nothing.  Shingles are kept as
64-bit hashes, so two different shingles of a compared pair are taken for equal
with a chance of about 2**-64.

1. One pass makes, for each document, ``HASHES`` MinHash samples, their band
   keys and an odd sketch: bit ``h(i, sample_i) mod BITS`` is flipped for every
   sample i, so that the XOR of two sketches has about one bit for each sample
   in which the two differ.
2. Equal sets are one class from here on.
3. Star step: every member of a band's bucket is paired with one member that
   the bucket picks by a hash, so a bucket of n gives n - 1 pairs.  Pairs whose
   sketches leave room for the threshold are confirmed on the full sets.
4. Buckets whose members the confirmed links have already joined hold no
   further information.  In the others every pair of members from different
   components is compared by sketch, block by block inside tasks; pairs that
   pass are confirmed on the full sets, in the block of their first common
   band.  No pair is left out and buckets have no cap.

A link at the threshold 0.85 shares no band with probability below 1e-10, and at
0.8 below 1e-7; the sketch lets pairs pass from ``SLACK`` below the threshold,
over five standard deviations of the estimate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import mixed, odd_numbers, runs, saved, sized, trimmed
from sparkloom.llm.components import components
from sparkloom.llm.words import by_bytes, grams, hashed

HASHES, BANDS, ROWS, BITS = 192, 32, 4, 1024
SLACK = 0.15
#: Members of a bucket, and their shingles, that are compared with one another in one task.
BLOCK, BLOCK_SHINGLES = 2000, 2_000_000
_MULTIPLIERS = odd_numbers(HASHES, 10)
_FLIPS = odd_numbers(HASHES, 12)


def shingle_sets(texts: pa.Array, words: int = 5) -> list[np.ndarray]:
    """For each text of a column the sorted 64-bit hashes of its distinct shingles."""
    h, offsets = hashed(texts)
    whole = grams(h, words)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out.append(np.unique(whole[a : b - words + 1] if b - a >= words else grams(h[a:b], b - a) if b > a else h[:0]))
    return out


def _samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, one row for each (non-empty) set."""
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((HASHES, len(sets)), np.uint64)
    for i, a in enumerate(_MULTIPLIERS):
        out[i] = np.minimum.reduceat(x * a, starts)
    return out.T


def band_keys(samples: np.ndarray) -> np.ndarray:
    parts = samples[:, : BANDS * ROWS].reshape(len(samples), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for r in range(ROWS):
        keys = mixed(keys ^ parts[:, :, r])
    return keys.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """BITS / 64 words for each row of samples."""
    place = (mixed(samples ^ _FLIPS) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    flips = np.zeros((len(samples), BITS), np.uint8)
    np.add.at(flips, (np.arange(len(samples))[:, None], place), 1)
    return np.packbits(flips & 1, axis=1, bitorder="little").view("<u8").view(np.int64)


def most_flips(similarity: float) -> int:
    """The greatest XOR population count at which the estimate is still ``similarity`` or more."""
    return int(BITS / 2 * (1 - np.exp(-4 * HASHES * (1 - similarity) / BITS))) if similarity > 0 else BITS


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands, sketch) of every row; without shingles the last three are null."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1, 1 << 19):
            sets = shingle_sets(batch.column(1), words)
            full = [k for k, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            sketches: list = [None] * len(sets)
            if full:
                samples = _samples([sets[k] for k in full])
                for k, b, s in zip(full, band_keys(samples), odd_sketch(samples), strict=True):
                    bands[k], sketches[k] = b, s
            ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, schema.field(3).type), pa.array(sketches, schema.field(4).type)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(sign), "doc_id long, n_shingles long, set_id binary, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, hashes) of the documents named in ``ids``, one row for an id."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            hashes = [x.view(np.int64) for x in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.list_(pa.int64()))], names=["id", "hashes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.join(sized(ids), "id", "left_semi").mapInArrow(trimmed(make), "id long, hashes array<long>").dropDuplicates(["id"])


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of the full sets."""
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = _sets(docs, ids, words)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def _flips(x: str, y: str) -> Column:
    bits = [F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(BITS // 64)]
    return sum(bits[1:], bits[0])


def _star_pairs(buckets: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b): every member with the one its bucket picks, if sizes and sketches allow the threshold."""
    pick = buckets.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "key").alias("h"), "rep")).alias("m"), F.count("*").alias("n")).where("n > 1").select("key", F.col("m.rep").alias("b"))
    pairs = buckets.join(pick, "key").where("rep != b").select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
    one = sketches.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = sketches.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (_flips("sa", "sb") <= most_flips(percent / 100 - SLACK))
    return pairs.join(one, "a").join(two, "b").where(fits).select("a", "b")


def _fitting(group: pa.Table, key: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a block that lie in different components, whose sizes and sketches allow the threshold, and whose first common band is this one."""
    at_most = most_flips(percent / 100 - SLACK)
    i, j = group["i"][0].as_py(), group["j"][0].as_py()
    mine, rep, part, n = (group[c].to_numpy() for c in ("mine", "rep", "part", "n"))
    words, bands = (np.asarray(group[c].combine_chunks().flatten()).reshape(len(rep), -1) for c in ("sketch", "bands"))
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    for lo in range(0, len(left), 256):
        rows = left[lo : lo + 256]
        a, b = n[rows][:, None], n[right][None]
        fits = (part[rows][:, None] != part[right][None]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        if i == j:
            fits &= rep[rows][:, None] < rep[right][None]
        p, q = np.nonzero(fits)
        p, q = rows[p], right[q]
        flips = np.zeros(len(p), np.int64)
        for w in range(words.shape[1]):
            flips += np.bitwise_count((words[p, w] ^ words[q, w]).view(np.uint64))
        p, q = p[flips <= at_most], q[flips <= at_most]
        first = (bands[p] == bands[q]).argmax(1)
        here = bands[p, first] == key
        yield p[here], q[here]


def _joined(group: pa.Table, key: int, percent: int) -> list[tuple[int, int]]:
    """Links between the components of a block's rows, confirmed on the sets; pairs that earlier links have joined need no look."""
    rep, part = group["rep"].to_numpy(), group["part"].to_numpy()
    flat, at = np.asarray(group["hashes"].combine_chunks().flatten()).view(np.uint64), np.asarray(group["hashes"].combine_chunks().offsets)
    at = at - at[0]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    links = []
    for p, q in _fitting(group, key, percent):
        cuts = np.flatnonzero(np.diff(p)) + 1
        for x, partners in zip(p[np.concatenate([[0], cuts])] if len(p) else [], np.split(q, cuts), strict=True) if len(p) else ():
            own = np.sort(flat[at[x] : at[x + 1]])
            for y in partners:
                if top(int(part[x])) == top(int(part[y])):
                    continue
                other = flat[at[y] : at[y + 1]]
                found = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
                common = int(found.sum())
                if 100 * common >= percent * (len(own) + len(other) - common):
                    root[top(int(part[x]))] = top(int(part[y]))
                    links.append((int(rep[x]), int(rep[y])))
    return links


def _across_links(buckets: DataFrame, classes: DataFrame, known: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """Links (a, b) that join the components of a bucket's members.

    Blocks of members first tell which of their rows have a pair to confirm, one
    row for each; only those rows get their sets, and the pairs are confirmed
    where they meet, so no pair ever becomes a row.
    """
    rows = buckets.join(known.withColumnRenamed("id", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).select("key", "rep", "part")
    open_ = rows.join(classes.select("rep", "n"), "rep").groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("m"), F.sum("n").alias("size")).where("p != q")
    open_ = open_.select("key", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = rows.join(open_, "key").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "part")
    traits = classes.select("rep", "n", "sketch", "bands")
    place = ["key", "i", "j"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, place):
            key = group["key"][0].as_py()
            pairs = [np.concatenate(x) for x in _fitting(group, key, percent)]
            if pairs and len(rows := np.unique(np.concatenate(pairs))):
                yield from group.select([*place, "mine", "rep", "part"]).take(pa.array(rows)).combine_chunks().to_batches()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, place):
            links = _joined(group, group["key"][0].as_py(), percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])

    gathered = dealt.join(traits, "rep").repartition(*place).sortWithinPartitions(*place)
    meetings = saved(gathered.mapInArrow(trimmed(meet), "key long, i int, j int, mine int, rep long, part long"), "meetings")
    sets = _sets(docs, saved(meetings.select(F.col("rep").alias("id")).distinct(), "ids"), words)
    full = meetings.join(traits, "rep").join(sets.withColumnRenamed("id", "rep"), "rep")
    return full.repartition(*place).sortWithinPartitions(*place).mapInArrow(trimmed(confirm), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Documents are linked if 100 * |intersection| >= percent * |union| of their
    sets.  component_id is the smallest doc_id reachable by links, the row's own
    included; kept says that it is the row's own.  Null and empty texts are
    components of their own, so are rows without doc_id (their component is
    null, kept true) and rows whose doc_id stands for texts of several sets, which
    couldn't be told apart by it.  Repeated rows give repeated results.
    """
    sig = saved(signatures(docs, words), "signatures")
    odd = saved(sig.where("doc_id is not null").groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b"), F.count("*").alias("n"), F.count("set_id").alias("m")).where("a != b or m > 0 and m < n").select("doc_id"), "odd-ids")
    if not odd.isEmpty():
        sig = sig.join(sized(odd.withColumn("odd", F.lit(True))), "doc_id", "left").withColumn("set_id", F.when(F.col("odd").isNull(), F.col("set_id"))).drop("odd")
    classes = saved(sig.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    sketches = classes.select("rep", "n", "sketch")
    keys = classes.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    buckets = saved(keys.join(shared, "key"), "buckets")
    star = saved(_confirmed(saved(_star_pairs(buckets, sketches, percent), "pairs"), docs, percent, words), "links")
    found = saved(components(star, "a", "b"), "components")
    links = star.unionByName(_across_links(buckets, classes, found, docs, percent, words))
    found = saved(components(links, "a", "b"), "components")
    of_class = classes.select("set_id", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    own = F.coalesce("component", "doc_id")
    return sig.select("doc_id", "n_shingles", "set_id").join(of_class, "set_id", "left").select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
