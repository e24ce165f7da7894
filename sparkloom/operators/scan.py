"""One pass over the rows of each key in order, by a small machine that keeps what it needs of the rows before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Machine:
    """Rows in, rows out."""

    def take(self, *row) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def scanned(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], machine: Callable[[], Machine], out: str) -> DataFrame:
    """What a machine of each key's own makes of its ``columns`` in order, behind the keys.

    Keys are dealt out by hash and sorted; a key's rows stream through one task, which
    holds the machine's state only.
    """
    plain = rows.select(*keys, *(c for c in order if c not in keys), *(c for c in columns if c not in keys and c not in order))
    schema = StructType([*(plain.schema[k] for k in keys), *_fields(rows, out)])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        one = machine()
        made: list[tuple] = []
        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                batch = whole.slice(low, 4096)
                of = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
                for now, row in zip(of, zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
                    if now != key:
                        if key is not None:
                            made += [(*key, *r) for r in one.end()]
                        key, one = now, machine()
                    made += [(*key, *r) for r in one.take(*row)]
                if made:
                    yield _batch(made, arrow)
                    made = []
        if key is not None:
            made += [(*key, *r) for r in one.end()]
        if made:
            yield _batch(made, arrow)

    return plain.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _fields(rows: DataFrame, ddl: str) -> list:
    return StructType.fromDDL(ddl).fields


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _starts(column: pa.Array) -> np.ndarray:
    """Where runs of equal values, nulls among them, begin."""
    fresh = np.ones(len(column), bool)
    if len(column) > 1:
        a, b = column.slice(0, len(column) - 1), column.slice(1)
        fresh[1:] = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(fresh)


#: Rows of a range that becomes one summary.
RANGE_ROWS = 200_000


def folded(rows: DataFrame, group: str, order: str, parts: list[Column], both: Callable[[list, list], list], count: int | None = None) -> DataFrame:
    """(group, first, parts, n): for each range of a group's rows in order, the composition of their steps.

    A step is some numbers, and ``both`` gives those of two steps one behind
    the other, for arrays as for columns.  Rows are dealt by group and order, so a group of very many rows
    is in many tasks; each task composes neighbours in pairs until a run is one step.
    """
    names = [f"s{k}" for k in range(len(parts))]
    plain = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), *(p.cast("double").alias(n) for p, n in zip(parts, names, strict=True)))
    schema = StructType([*plain.schema.fields, *StructType.fromDDL("n long").fields])

    def reduced(table: pa.Table) -> pa.Table:
        starts = _starts(table["g"].combine_chunks())
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        steps = [table[n].to_numpy() for n in names]
        n = table["n"].to_numpy()
        while len(owner) > len(starts):
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            left = np.flatnonzero((place % 2 == 0) & np.append(owner[1:] == owner[:-1], False))
            joined = both([s[left] for s in steps], [s[left + 1] for s in steps])
            keep = np.flatnonzero(place % 2 == 0)
            at = np.searchsorted(keep, left)
            n = np.where(np.isin(keep, left), n[keep] + n[np.minimum(keep + 1, len(n) - 1)], n[keep])
            steps = [s[keep].copy() for s in steps]
            for s, j in zip(steps, joined, strict=True):
                s[at] = j
            owner = owner[keep]
        first = table.take(pa.array(starts)).select(["g", "o"]).combine_chunks()
        return pa.table([*first.columns, *map(pa.array, steps), pa.array(n)], names=["g", "o", *names, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # Spark's fields may exclude nulls, those of what was held don't.
            now = pa.table([*batch.columns, pa.array(np.ones(batch.num_rows, np.int64))], names=[*batch.schema.names, "n"])
            now = reduced(pa.concat_tables([held, now]) if held is not None else now)
            if now.num_rows > 1:
                yield from now.slice(0, now.num_rows - 1).combine_chunks().to_batches()
            held = now.slice(now.num_rows - 1)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    total = rows.count() if count is None else count
    dealt = plain.repartitionByRange(max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // RANGE_ROWS)), "g", "o").sortWithinPartitions("g", "o")
    ranges = dealt.mapInArrow(run, schema)
    one = F.struct("o", *names, "n")
    lists = ranges.groupBy("g").agg(F.array_sort(F.collect_list(one)).alias("all"))

    def step(a: Column, b: Column) -> Column:
        joined = both([a[x] for x in names], [b[x] for x in names])
        return F.struct(a["o"].alias("o"), *(c.alias(x) for c, x in zip(joined, names, strict=True)), (a["n"] + b["n"]).alias("n"))

    whole = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))), F.col("all")[0], step)
    return lists.select("g", whole.alias("w")).select(F.col("g").alias(group), F.array(*(F.col(f"w.{x}") for x in names)).alias("parts"), F.col("w.n").alias("n"))


def least(a, b):
    """The smaller of two columns or arrays."""
    return F.least(a, b) if isinstance(a, Column) else np.minimum(a, b)


def greatest(a, b):
    return F.greatest(a, b) if isinstance(a, Column) else np.maximum(a, b)
