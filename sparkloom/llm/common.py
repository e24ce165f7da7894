"""What several operators share: the shared folder, size-checked joins, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Tables of at most so many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Rows of 64 bits that ``likely`` broadcasts at most, 16 MB.
BIT_ROWS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where that is unset (on one machine), one of our own for the application."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own[spark.sparkContext.applicationId] = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
    if "://" not in base and not base.startswith("file:"):
        # A bare path belongs to the default file system, for own files as for Spark's.
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        base = jvm.org.apache.hadoop.fs.Path(base).makeQualified(jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(conf), jvm.org.apache.hadoop.fs.Path("/")).toString()
    return base.rstrip("/")


#: Folders of applications whose session names none.
_own: dict[str, str] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage ends at files that outlive any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(column: Column, kind: DataType) -> Column:
    """Bytes of a column's values, without overhead."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType)):
            return F.coalesce(F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 8), F.lit(0))
        width = 8 * (len(kind.elementType.fields) + 1) if isinstance(kind.elementType, StructType) else 8
        return F.coalesce(F.size(column), F.lit(0)) * width
    return F.lit(8)


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A saved table with a broadcast hint if its rows have at most ``most`` bytes, else as it is (then the join shuffles)."""
    size = sum((_bytes(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most else df


def likely(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` is among ``ids`` (id), and few others: those whose hash has the bit of an id.

    It is put before a join that shuffles long rows, which settles the others.  The bits are broadcast, at most BIT_ROWS
    rows of them whatever the number of ids; ten million ids let about a quarter of the other rows through.
    """
    row, bit = (lambda c: F.pmod(F.xxhash64(c), F.lit(BIT_ROWS)).alias("_row")), (lambda c: F.pmod(F.xxhash64(F.lit(1), c), F.lit(64)).cast("int"))
    bits = ids.select(row(F.col("id")), bit(F.col("id")).alias("_bit")).groupBy("_row").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    rows = df.withColumn("_row", row(F.col(column).cast(ids.schema["id"].dataType)))
    return rows.join(F.broadcast(bits), "_row").where(F.bit_get("_bits", bit(F.col(column).cast(ids.schema["id"].dataType))) == 1).select(*df.columns)


def numbered(df: DataFrame, without: str | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named c0, c1 and so on, and their own names; a column ``without`` is left out.  What an operator adds can't clash then."""
    names = [c for c in df.columns if c != without]
    return df.select(*names).toDF(*(f"c{k}" for k in range(len(names)))), names


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, that leaves its worker small: Spark keeps Python workers for later tasks, and their allocators keep what earlier ones freed."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            # Of glibc; other C libraries hand memory back by themselves.
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch | pa.Table]:
    """Tables of equal ``keys`` from batches that are sorted by them; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            if batch.num_rows > 1:
                a, b = c.slice(0, batch.num_rows - 1), c.slice(1)
                differ = pc.not_equal(a, b)
                nulls = pc.xor(pc.is_null(a), pc.is_null(b))
                change[1:] |= pc.or_(pc.fill_null(differ, False), nulls).to_numpy(zero_copy_only=False)
        starts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[lo].as_py() for c in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
