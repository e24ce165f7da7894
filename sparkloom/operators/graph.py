"""Graphs, hierarchies, ordered state and overlays."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.scan import Machine, folded, greatest, least, scanned
from sparkloom.sources.tables import stored


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, hub): edges at each node, both ends counted; a hub has over twice the mean."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    mean = ends.agg(F.avg("degree").alias("mean"))
    return ends.crossJoin(F.broadcast(mean)).select("id", "degree", (F.col("degree") > 2 * F.col("mean")).alias("hub"))


def within(edges: DataFrame, start: object, depth: int) -> DataFrame:
    """(id, hops) of the nodes that are at most ``depth`` edges away, whichever way they point; none at depth 0.

    Each hop is written, so the next one reads it instead of walking again.
    """
    spark = edges.sparkSession
    both = stored(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "edges")
    seen = spark.range(1).select(F.lit(start).cast("long").alias("id"), F.lit(0).alias("hops"))
    edge_of = seen
    for hop in range(1, depth + 1):
        found = both.join(edge_of.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        edge_of = stored(found.withColumn("hops", F.lit(hop)), "hop")
        seen = seen.unionByName(edge_of)
    return seen if depth else seen.limit(0)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def with_inverses(edges: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Edges and, for the kinds that have one, their inverses."""
    mapped = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)) if kinds else None
    if mapped is None:
        return edges
    turned = edges.withColumn("_k", mapped[F.col("kind")]).where("_k is not null").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("_k").alias("kind"))
    return edges.unionByName(turned)


def chains(nodes: DataFrame, key: str, parent: str, depth: int | None = 10) -> DataFrame:
    """(id, path, problem): the way from the root to each node; problem is cycle or depth where the walk can't end.

    ``depth`` joins of the frontier with the parents at most, each with the rows that still climb, as the step before wrote them;
    without a depth as many as the longest way has, which ends as a cycle is a problem.
    """
    links = stored(nodes.select(F.col(key).alias("_id"), F.col(parent).alias("_parent")), "links")
    climbing = links.select(F.col("_id").alias("id"), F.array("_id").alias("path"), F.col("_parent").alias("next"))
    done = climbing.where("next is null").select("id", "path", F.lit(None).cast("string").alias("problem"))
    climbing = climbing.where("next is not null")
    for _ in count() if depth is None else range(depth):
        cycle = F.array_contains("path", F.col("next"))
        done = done.unionByName(climbing.where(cycle).select("id", "path", F.lit("cycle").alias("problem")))
        step = climbing.where(~cycle).join(links, F.col("next") == F.col("_id")).select("id", F.concat(F.array("next"), F.col("path")).alias("path"), F.col("_parent").alias("next"))
        climbing = stored(step, "climbing")
        if climbing.isEmpty():
            break
        done = done.unionByName(climbing.where("next is null").select("id", "path", F.lit(None).cast("string").alias("problem")))
        climbing = climbing.where("next is not null")
    return done.unionByName(climbing.select("id", "path", F.lit("depth").alias("problem")))


def inherited(paths: DataFrame, traits: DataFrame, name: str, value: str) -> DataFrame:
    """(id, name, value): traits (id, name, value) along each path, the nearest to the node winning."""
    steps = paths.select(F.col("id").alias("node"), F.posexplode("path").alias("place", "id"))
    joined = steps.join(traits, "id")
    return joined.groupBy(F.col("node").alias("id"), name).agg(F.max_by(value, "place").alias(value))


def blended(profiles: DataFrame, group: str, weight: str, values: list[str]) -> DataFrame:
    """Weighted means of values in a group; weights are divided by their sum."""
    w = F.sum(weight)
    return profiles.groupBy(group).agg(*(F.when(w > 0, F.sum(F.col(weight) * F.col(v)) / w).alias(v) for v in values))


def clamped_fold(events: DataFrame, group: str, order: str, change: str, start: float, low: float, high: float) -> DataFrame:
    """(group, final, n): changes added in order, kept within bounds after each, as health and dispositions are; null changes count as 0.

    "Add, then keep within bounds" one behind another is again such a step, so ranges of a group's rows become one
    step each, wherever they lie, and these are composed.
    """
    def both(a: list, b: list) -> list:
        return [a[0] + b[0], least(greatest(a[1] + b[0], b[1]), b[2]), least(greatest(a[2] + b[0], b[1]), b[2])]

    steps = folded(events, group, order, [F.coalesce(F.col(change), F.lit(0)), F.lit(low), F.lit(high)], both)
    p = F.col("parts")
    return steps.select(group, F.greatest(F.least(F.lit(float(start)) + p[0], p[2]), p[1]).alias("final"), F.col("n").cast("int").alias("n"))


class _Health(Machine):
    """Hit points with temporary ones, which are lost first."""

    def __init__(self, most: float) -> None:
        self.most, self.now, self.extra = most, most, 0.0

    def take(self, tie: object, kind: str, amount: float | None) -> list[tuple]:
        x = max(amount or 0.0, 0.0)
        if kind == "damage":
            taken = min(self.extra, x)
            self.extra -= taken
            self.now = max(self.now - (x - taken), 0.0)
        elif kind == "heal":
            self.now = min(self.now + x, self.most)
        elif kind == "temporary":
            self.extra = max(self.extra, x)
        return [(tie, self.now, self.extra)]


def health(events: DataFrame, who: str, order: str, kind: str, amount: str, most: float) -> DataFrame:
    """(who, order, hit_points, temporary) after each event: damage takes temporary hit points first and stops at 0, heal stops at ``most``, temporary ones don't add up."""
    rows = events.select(who, order, kind, F.col(amount).cast("double").alias(amount))
    return scanned(rows, [who], [order], [order, kind, amount], lambda: _Health(float(most)), f"`{order}` {rows.schema[order].dataType.simpleString()}, hit_points double, temporary double")


def components(edges: DataFrame, src: str, dst: str, rounds: int = 60) -> DataFrame:
    """(id, component): for every end of an edge the smallest one that it reaches, by alternating large and small stars; the rounds grow with the logarithm of the longest path."""
    def stars(table: DataFrame) -> DataFrame:
        # The smallest neighbour of each node, itself included.
        return table.join(table.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")

    now = stored(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u != v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        large = stars(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        now = stored(stars(large).select(ends.alias("e")).select("e.*").where("u != v").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id").unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = seen
    raise RuntimeError("the components did not settle")


def ticked(conditions: DataFrame, left: str, rounds: int) -> DataFrame:
    """Conditions after so many rounds: one less each, gone when one is left or fewer; those without a count stay."""
    after = F.col(left) - rounds
    return conditions.withColumn(left, after).where(F.col(left).isNull() | (F.col(left) > 0))


def stacked(conditions: DataFrame, who: str, kind: str, rule: str, left: str, source: str, at: str) -> DataFrame:
    """One state for each holder and kind, by the kind's rule: latest, highest, extend, or one for each source."""
    one = conditions.groupBy(who, kind, rule).agg(F.max_by(left, at).alias("latest"), F.max(left).alias("highest"), F.sum(left).alias("extend"), F.count_distinct(source).alias("sources"))
    remaining = F.when(F.col(rule) == "latest", F.col("latest")).when(F.col(rule) == "extend", F.col("extend")).otherwise(F.col("highest"))
    return one.select(who, kind, remaining.alias("remaining"), F.when(F.col(rule) == "source", F.col("sources")).otherwise(1).cast("long").alias("n"))


def versions(snapshots: DataFrame, group: str, order: str, data: str) -> DataFrame:
    """Snapshots with their number from 1, that of their parent, and a hash for checking them."""
    number = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return snapshots.withColumn("version", number).withColumn("parent", F.nullif(F.col("version") - 1, F.lit(0))).withColumn("hash", F.sha2(F.col(data).cast("string"), 256))


def picked(key: Column, names: list[str], salt: str = "") -> Column:
    """A pick that is always the same for a key."""
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(len(names)))).cast("int") + 1)
