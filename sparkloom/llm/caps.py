"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A filter is a direction on the unit sphere.  Directions form a product code:
after a random rotation the space is cut into two blocks, each block has its own
random unit codewords, and a direction takes one codeword from each block
(divided by sqrt(2)).  The scores of a vector against all directions follow from
the few scores against codewords, so the list of all directions that exceed a
threshold is decoded block by block, dropping partial sums that can't reach it.

Every vector x is stored with the one filter that it exceeds most, at score s.  A
vector y within the angle t = arccos(threshold) of x has there the score
s cos t + u sin t sqrt(1 - s * s) or more, where u is the cosine between the way
from x to y and that from x to the filter.  The code is turned at random, so u is
one coordinate of a random unit vector, and below -``turn`` with the chance
``MISS``; that gives a bound, which rises with s.  A pair is looked for at the
filter of the one with the higher score, so y only probes filters that it exceeds
by the bound of its own score: few, however badly some other vector is covered.

Equal vectors of a label are one row, with a weight.  Pairs are verified in double
precision, inside tasks and in blocks; only counts and a spanning forest of each
block's links leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import runs, saved, sized, slices
from sparkloom.llm.components import components

#: Stored vectors, and probing ones, of a bucket that meet in one block.
BLOCK = 2048
#: Vectors to a filter that the size of the code aims at; most codewords of a block.
TO_FILTER, MOST_CODEWORDS = 640, 4096
#: Chance that a link isn't met, for each of its two ends.
MISS = 1e-12
#: Numbers of a matrix of partial sums.
HELD = 1 << 20


@lru_cache(4)
def product_code(dim: int, codewords: int, seed: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation and, for each block of coordinates, ``codewords`` unit vectors, already divided by sqrt(blocks)."""
    rng = np.random.default_rng([seed, dim, codewords])
    rotation, upper = np.linalg.qr(rng.standard_normal((dim, dim)))
    rotation *= np.sign(np.diag(upper))
    widths = [len(x) for x in np.array_split(np.arange(dim), min(2, dim))]
    blocks = []
    for w in widths:
        c = rng.standard_normal((codewords, w))
        blocks.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(len(widths)))
    return rotation, blocks


def block_scores(unit: np.ndarray, codewords: int) -> list[np.ndarray]:
    rotation, blocks = product_code(unit.shape[1], codewords)
    turned = unit @ rotation
    cuts = np.cumsum([b.shape[1] for b in blocks])[:-1]
    return [x @ b.T for x, b in zip(np.split(turned, cuts, axis=1), blocks, strict=True)]


def best_filters(scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The filter that each vector exceeds most, and the score."""
    number = np.zeros(len(scores[0]), np.int64)
    total = np.zeros(len(scores[0]))
    for s in scores:
        best = s.argmax(1)
        number = number * s.shape[1] + best
        total += s[np.arange(len(s)), best]
    return number, total


def exceeding_filters(scores: list[np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """List decoding: (row, filter) for every filter with a score of at least ``bounds[row]``."""
    row = np.arange(len(scores[0]))
    number, total = np.zeros(len(row), np.int64), np.zeros(len(row))
    rest = [sum((s.max(1) for s in scores[k + 1 :]), np.zeros(len(scores[0]))) for k in range(len(scores))]
    for s, left in zip(scores, rest, strict=True):
        found = []
        step = max(HELD // s.shape[1], 1)
        for lo in range(0, len(row), step):
            here = row[lo : lo + step]
            sums = total[lo : lo + step, None] + s[here]
            r, c = np.nonzero(sums + left[here][:, None] >= bounds[here][:, None])
            found.append((here[r], number[lo : lo + step][r] * s.shape[1] + c, sums[r, c]))
        row, number, total = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (row, number, total)
    return row, number


@lru_cache(64)
def turn(dim: int, miss: float = MISS) -> float:
    """The number that a coordinate of a random unit vector of dim - 1 dimensions exceeds with the chance ``miss``; 1 in few dimensions."""
    if dim < 5:
        return 1.0
    u = np.linspace(0, 1, 200_001)
    density = (1 - u * u) ** ((dim - 4) / 2)
    tail = np.cumsum(density[::-1])[::-1] / density.sum() / 2
    return float(u[np.searchsorted(-tail, -miss)])


def probe_bounds(score: np.ndarray, threshold: float, dim: int) -> np.ndarray:
    """What a vector within ``threshold`` of one with this score, or a higher one, scores at the other's filter at least; anything under 0."""
    t = np.arccos(threshold)
    s = np.clip(score, -1, 1)
    return np.where(s < 0, -1.0, s * np.cos(t) - turn(dim) * np.sin(t) * np.sqrt(1 - s * s)) - 1e-9


def _unit(vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges (smallest id, id) that span the components of the links between ``left`` and ``right``."""
    src: list[int] = []
    dst: list[int] = []
    waiting = linked.any(1)
    while waiting.any():
        rows = np.zeros(len(left), bool)
        rows[waiting.argmax()] = True
        cols, fresh = np.zeros(len(right), bool), rows.copy()
        while fresh.any():
            new_cols = linked[fresh].any(0) & ~cols
            cols |= new_cols
            fresh = linked[:, new_cols].any(1) & ~rows if new_cols.any() else np.zeros(len(left), bool)
            rows |= fresh
        waiting &= ~rows
        ids = np.unique(np.concatenate([left[rows], right[cols]]))
        src += [int(ids[0])] * (len(ids) - 1)
        dst += ids[1:].tolist()
    return src, dst


_PLACE = ["label", "dim", "filter"]
_STORED = "vec_id long, label long, dim long, vector_id binary, filter long, score double, vector binary"


def similar_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label; other columns are ignored).

    Two rows are linked if their labels are equal and not null, their vectors
    have the same length and their cosine is ``threshold`` or more.  Vectors that
    are null, empty, zero, or hold null or non-finite components link with
    nothing, nor do rows without vec_id.  n_links counts the other rows linked
    directly, without those that have the same vec_id and the same vector;
    component_id is the smallest vec_id reachable by links, the own included.  A
    link isn't found with a chance of 2 * MISS.
    """
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    held = "array<float>" if kind == "<f4" else "array<double>"
    v = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.cast(held).alias("embedding")).where(usable)
    codewords = int(np.clip(np.ceil(np.sqrt(rows.count() / TO_FILTER)), 4, MOST_CODEWORDS))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            lists = batch.column(2)
            flat, at = np.asarray(lists.flatten()).astype(kind), np.asarray(lists.offsets)
            at = at - at[0]
            raw = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            dims = np.diff(at)
            number, score = np.zeros(len(raw), np.int64), np.zeros(len(raw))
            for d in np.unique(dims):
                k = np.flatnonzero(dims == d)
                number[k], score[k] = best_filters(block_scores(_unit([raw[i] for i in k], kind), codewords))
            ids = [hashlib.blake2b(x, digest_size=16).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int64()), pa.array(ids, pa.binary()), pa.array(number), pa.array(score), pa.array(raw, pa.binary())], names=["vec_id", "label", "dim", "vector_id", "filter", "score", "vector"])

    stored = saved(rows.mapInArrow(store, _STORED), "caps")
    one = [F.first(c).alias(c) for c in ("filter", "score", "vector")]
    # The smallest vec_id names a class of equal vectors; a vec_id that several vectors have names several.
    classes = stored.groupBy("label", "dim", "vector_id").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), *one)
    classes = saved(classes.select("label", "dim", "vector_id", "rep", "weight", *("filter", "score", "vector")), "classes")

    def probed(with_vectors: bool):
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 256):
                dims, raw, score = batch["dim"].to_numpy(), batch["vector"].to_pylist(), batch["score"].to_numpy()
                for d in np.unique(dims):
                    k = np.flatnonzero(dims == d)
                    row, number = exceeding_filters(block_scores(_unit([raw[i] for i in k], kind), codewords), probe_bounds(score[k], threshold, int(d)))
                    if with_vectors:
                        part = batch.select(["label", "dim", "vector_id", "rep", "weight", "score", "vector"]).take(pa.array(k[row]))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(number)], names=[*part.schema.names, "filter"])
                    else:
                        part = batch.select(["label"]).take(pa.array(k[row]))
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(row), d)), pa.array(number)], names=_PLACE)

        return probe

    # Buckets of many stored or many probing rows are cut into blocks that meet each other.
    probing = classes.mapInArrow(probed(False), "label long, dim long, filter long").groupBy(*_PLACE).agg(F.count("*").alias("right"))
    holding = classes.groupBy(*_PLACE).agg(F.count("*").alias("left"))
    parts = holding.join(probing, _PLACE).select(*_PLACE, *(F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("left", "right")))
    parts = sized(saved(parts, "buckets"))
    what = [*_PLACE, "vector_id", "rep", "weight", "score", "vector"]
    fields = "label long, dim long, vector_id binary, rep long, weight long, score double, vector binary, filter long"

    def dealt(side: int, table: DataFrame) -> DataFrame:
        mine, others = ("left", "right") if side == 0 else ("right", "left")
        block = F.pmod(F.xxhash64("vector_id"), F.col(mine)).cast("int")
        all_ = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        placed = table.join(parts, _PLACE).select(*what, F.lit(side).alias("side"), block.alias("mine"), all_.alias("all"))
        return placed.select(*what, "side", F.col("mine" if side == 0 else "all").alias("i"), F.col("all" if side == 0 else "mine").alias("j"))

    both = dealt(0, classes).unionByName(dealt(1, classes.mapInArrow(probed(True), fields)))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, [*_PLACE, "i", "j"]):
            side, raw = group["side"].to_numpy(), group["vector"].to_pylist()
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(a) or not len(b):
                continue
            ids, weight, score = (group[c].to_numpy() for c in ("rep", "weight", "score"))
            names = group["vector_id"].to_pylist()
            linked = _unit([raw[k] for k in a], kind) @ _unit([raw[k] for k in b], kind).T >= threshold
            # A pair is met at the filter of its higher score; of equal scores, at that of the greater vector id.
            number = {n: k for k, n in enumerate(sorted(set(names)))}
            order = np.fromiter(map(number.__getitem__, names), np.int64, len(names))
            higher = (score[a][:, None] > score[b][None]) | (score[a][:, None] == score[b][None]) & (order[a][:, None] > order[b][None])
            linked &= higher
            near, far = linked @ weight[b], weight[a] @ linked
            src, dst = _forest(linked, ids[a], ids[b])
            x, y = a[near > 0], b[far > 0]
            k = np.concatenate([x, y])
            none = [None] * len(src)
            yield pa.RecordBatch.from_arrays([
                pa.array([*group["label"].take(pa.array(k)).to_pylist(), *none], pa.int64()),
                pa.array([*(names[i] for i in k), *none], pa.binary()),
                pa.array([*near[near > 0].tolist(), *far[far > 0].tolist(), *none], pa.int64()),
                pa.array([None] * len(k) + src, pa.int64()),
                pa.array([None] * len(k) + dst, pa.int64()),
            ], names=["label", "vector_id", "n", "src", "dst"])

    met = both.repartition(*_PLACE, "i", "j").sortWithinPartitions(*_PLACE, "i", "j")
    found = saved(met.mapInArrow(verify, "label long, vector_id binary, n long, src long, dst long"), "links")
    linked = found.where("src is null").groupBy("label", "vector_id").agg(F.sum("n").alias("n"))
    counted = classes.select("label", "vector_id", "rep", "weight").join(linked, ["label", "vector_id"], "left")
    per_class = counted.select("label", "vector_id", "rep", (F.col("weight") + F.coalesce("n", F.lit(0))).alias("all"))
    # Rows of one class are linked as well: a path from the smallest id to each other one.
    own = stored.groupBy("label", "vector_id", "vec_id").agg(F.count("*").alias("same")).join(per_class, ["label", "vector_id"])
    own = saved(own.select("vec_id", "rep", "label", "vector_id", (F.col("all") - F.col("same")).alias("n")), "rows")
    edges = found.where("src is not null").select("src", "dst").unionByName(own.where("vec_id != rep").select(F.col("rep").alias("src"), F.col("vec_id").alias("dst")))
    component = components(edges, "src", "dst").withColumnRenamed("id", "vec_id")
    keyed = stored.select("vec_id", "label", "vector_id")
    good = keyed.join(own.select("vec_id", "label", "vector_id", "n"), ["vec_id", "label", "vector_id"]).select("vec_id", "n")
    bad = vectors.where(~F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n"))
    out = good.unionByName(bad).join(component, "vec_id", "left")
    smallest = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.col("n").cast("long").alias("n_links"), smallest.alias("component_id"), F.coalesce(smallest == F.col("vec_id"), F.lit(True)).alias("kept"))
