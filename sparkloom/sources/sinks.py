"""Sinks with keys: writes that replace, merge or forget rows, and exports in three formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, for each key that with the greatest ``version``; of equal versions the new row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new")))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_new")


def without_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't in ``gone``."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def retained(rows: DataFrame, time: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days."""
    return rows.where(F.col(time) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def reconciled(expected: dict[str, DataFrame], copied: dict[str, DataFrame]) -> DataFrame:
    """(table_name, expected_rows, copied_rows, matches) after a copy from one store to another."""
    parts = [f[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit(side).alias("side"), "n") for side, f in (("expected", expected), ("copied", copied)) for name in f]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    sides = out.groupBy("table_name").agg(*(F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(f"{s}_rows") for s in ("expected", "copied")))
    return sides.withColumn("matches", F.col("expected_rows") == F.col("copied_rows"))


def csv_safe(text: Column) -> Column:
    """A field for a CSV export: commas become semicolons, line breaks spaces."""
    return F.regexp_replace(F.regexp_replace(text, ",", ";"), r"[\r\n]+", " ")


def export(rows: DataFrame, path: str, kind: str, rows_to_file: int = 0) -> None:
    """Write as ``json`` (one object a line) or ``csv`` (with a header); files are cut after ``rows_to_file`` rows."""
    out = rows.write.option("maxRecordsPerFile", rows_to_file)
    if kind == "csv":
        strings = {f.name for f in rows.schema if f.dataType.typeName() == "string"}
        rows.select(*(csv_safe(F.col(c)).alias(c) if c in strings else F.col(c) for c in rows.columns)).write.option("maxRecordsPerFile", rows_to_file).option("header", True).csv(path)
    elif kind == "json":
        out.json(path)
    else:
        raise ValueError(f"no export as {kind}")
