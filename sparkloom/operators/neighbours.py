"""Approximate nearest neighbours: a stored inverted file of cells with residual product codes.

Centres of the cells and the code books are fitted on a bounded sample.  Every
vector is stored with its cell, in files of cells that are next to one another,
as a code of its residual and in full.  A query looks at the cells nearest to it, reads
their codes alone, ranks these by a table of distances, and reads the full
vectors of the best ones for the exact order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.search_index import files_state
from sparkloom.sources.tables import shared_path, stored

#: Vectors that the centres and the code books are fitted on at most; rounds of fitting.
TRAIN_ROWS, ROUNDS = 50_000, 12
#: Parts of a code, values of a part; vectors of a cell that are aimed at; rows of a file.
PARTS, VALUES, CELL, FILE_ROWS = 16, 256, 200, 100_000
#: Candidates for each result wanted whose exact distance is taken.
OVERSAMPLE = 10


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    offsets = (centres * centres).sum(1)
    return np.concatenate([(offsets - 2 * (x[k : k + 4096] @ centres.T)).argmin(1) for k in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def clustered(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of ``k`` clusters at most by Lloyd's rounds; a cluster that loses all rows stays where it was."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


class VectorIndex:
    """The stored index of (id, vector) for cosine distance.

    Vectors that are null, zero or hold null or non-finite numbers are in no cell, nor are those of other lengths than the commonest.
    """

    def __init__(self, vectors: DataFrame, key: str, column: str) -> None:
        self.spark = vectors.sparkSession
        v = F.col(column).cast("array<double>")
        rows = vectors.select(F.col(key).alias("id"), v.alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
        widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
        self.width, self.n = (widths.width, widths.n) if widths else (0, 0)
        self.path = shared_path(self.spark, "cells")
        if not self.n:
            self._schema = None
            return
        rows = rows.where(F.size("vector") == self.width)
        # A bounded sample, the same on every run: those with the smallest hashes.
        sample = rows.orderBy(F.xxhash64("vector"), "id").limit(TRAIN_ROWS).select("vector")
        x = _unit(np.array([r[0] for r in sample.collect()]))
        self.centres = clustered(x, max(1, round(self.n / CELL)) if self.n / CELL < len(x) / 4 else max(1, len(x) // 4), 1)
        own = _nearest(x, self.centres)
        parts = min(PARTS, self.width)
        self.cuts = np.linspace(0, self.width, parts + 1).astype(int)
        residual = x - self.centres[own]
        self.books = [clustered(residual[:, a:b], VALUES, 2 + k) for k, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True))]
        centres, books, cuts = self.centres, self.books, self.cuts

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for low in range(0, whole.num_rows, 4096):
                    batch = whole.slice(low, 4096)
                    x = _unit(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
                    cell = _nearest(x, centres)
                    left = x - centres[cell]
                    codes = np.stack([_nearest(left[:, a:b], book) for book, a, b in zip(books, cuts[:-1], cuts[1:], strict=True)], axis=1).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in codes], pa.binary())], names=["id", "vector", "cell", "code"])

        kind = rows.schema["id"].dataType.simpleString()
        coded = stored(rows.mapInArrow(encode, f"id {kind}, vector array<double>, cell int, code binary"), "coded")
        # By cell and id, so that a cell of very many vectors is cut into many files; a cell's row groups are found by their bounds.
        dealt = coded.repartitionByRange(max(1, -(-self.n // FILE_ROWS)), "cell", "id").sortWithinPartitions("cell", "id")
        dealt.write.option("parquet.block.size", 1 << 20).parquet(self.path)
        self._rows = self.spark.read.schema(coded.schema).parquet(self.path)

    def probed(self, query: list[float], cells: int) -> list[int]:
        """The ``cells`` nearest cells."""
        q = _unit(np.array([query], float))[0]
        return np.argsort(((self.centres - q) ** 2).sum(1), kind="stable")[:cells].tolist()

    def candidates(self, query: list[float], limit: int, cells: int) -> DataFrame:
        """(id, cell, guess): the codes of the probed cells with the least distances by table; full vectors aren't read."""
        q = _unit(np.array([query], float))[0]
        near = self.probed(query, cells)
        # |q - c - r|^2 for the code's r: a part for each cell and a table of each part's products.
        products = np.concatenate([np.pad((book**2).sum(1) - 2 * book @ q[a:b], (0, VALUES - len(book))) for book, a, b in zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)])
        across = {c: np.concatenate([np.pad(2 * book @ self.centres[c, a:b], (0, VALUES - len(book))) for book, a, b in zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)]) for c in near}
        base = {c: float(((self.centres[c] - q) ** 2).sum()) for c in near}
        parts = len(self.books)

        def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = batch.column(1).to_numpy()
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, parts) + np.arange(parts) * VALUES
                out = np.empty(len(cell))
                for c in np.unique(cell).tolist():
                    at = np.flatnonzero(cell == c)
                    out[at] = base[c] + (products + across[c])[codes[at]].sum(1)
                # More than the limit never leaves a batch.
                best = np.argsort(out, kind="stable")[:limit]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(best)), batch.column(1).take(pa.array(best)), pa.array(out[best])], names=["id", "cell", "guess"])

        kind = self._rows.schema["id"].dataType.simpleString()
        codes = self._rows.where(F.col("cell").isin(near)).select("id", "cell", "code")
        return codes.mapInArrow(guess, f"id {kind}, cell int, guess double").orderBy("guess", "id").limit(limit)

    def nearest(self, query: list[float], limit: int, share: float = 0.1, least: int = 8) -> DataFrame:
        """(id, distance) of about the ``limit`` vectors with the least cosine distance, exact for those that are found, equal ones by id.

        Looks at a ``share`` of the cells, ``least`` of them or more.
        """
        if not self.n or len(query) != self.width or not any(query):
            return self.spark.createDataFrame([], "id long, distance double")
        cells = min(len(self.centres), max(least, round(share * len(self.centres))))
        found = self.candidates(query, limit * OVERSAMPLE, cells).collect()
        ids, near = [r.id for r in found], sorted({r.cell for r in found})
        full = self._rows.where(F.col("cell").isin(near) & F.col("id").isin(ids)).select("id", "vector")
        q = F.array(*map(F.lit, map(float, query)))
        size = float(np.linalg.norm(np.array(query, float)))
        dot = F.aggregate(F.zip_with("vector", q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
        return full.select("id", (1 - dot / (norm * size)).alias("distance")).orderBy("distance", "id").limit(limit)


_indexes: dict[tuple, VectorIndex] = {}


def index_of(vectors: DataFrame, key: str, column: str) -> VectorIndex:
    """The index of a table of files, built once for an application and the files as they are now."""
    at = (vectors.sparkSession.sparkContext.applicationId, key, column, files_state(vectors))
    if at not in _indexes:
        _indexes[at] = VectorIndex(vectors, key, column)
    return _indexes[at]
