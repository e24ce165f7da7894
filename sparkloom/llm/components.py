"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import saved

MAX_ROUNDS = 60


def _nearest(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the smallest id next to u, u itself included; hot ids are pre-aggregated before the join."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): for every id of an edge, the smallest id that it reaches.

    Edges with a null end and loops count for nothing; an empty table gives an
    empty result.  Each round is written to the shared folder, so a lost
    executor costs one round at most.
    """
    u, v = F.col(src).cast("long"), F.col(dst).cast("long")
    now = saved(edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _nearest(large)
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        now = saved(small.select(ends.alias("e")).select("e.*").where("u != v").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        state = seen
    else:
        raise RuntimeError("the components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
