"""Tables of the driver, and the views of them that the analytics operators read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of applications whose session names none.
_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, or, where that is unset (on one machine), below a folder of our own for the application."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own[spark.sparkContext.applicationId] = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
    return f"{base.rstrip('/')}/sparkloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage ends at files that outlive any executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search_log(events: DataFrame) -> DataFrame:
    """Events as a log of searches: one row for each, with what was asked, found and picked."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("search_id"),
        F.concat_ws("-", F.col("event_type"), (F.col("user_id") % 20).cast("string")).alias("query"),
        (F.col("value").cast("int") % 10).alias("results_count"),
        F.when(F.col("event_type") == "click", F.col("user_id") % 5).alias("selected_index"),
        (k % 2 == 0).alias("cache_hit"),
        F.col("value").cast("int").alias("response_ms"),
        F.col("event_type").alias("search_type"),
        F.col("ts").alias("created_at"),
    )


def usage_log(lineitem: DataFrame) -> DataFrame:
    """Line items as a log of paid requests."""
    return lineitem.select(
        F.col("l_returnflag").alias("provider"),
        F.col("l_linestatus").alias("model"),
        (F.col("l_quantity") * 100).cast("long").alias("input_tokens"),
        (F.col("l_linenumber") * 10).cast("long").alias("output_tokens"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost"),
        F.col("l_shipdate").alias("logged_at"),
    )
