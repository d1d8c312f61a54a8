"""Segment-level operators: sums over segments, model look-ups, changes, running bests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colonnade.operators import models, packed
from colonnade.operators.scan import blocked_scan, series_scan
from colonnade.session import cut_lineage

MAX_BROADCAST_LEVELS = 1024


def candidate_summary(rows: DataFrame, keys: list[str], pos: str, value: str, min_height: int = 1) -> DataFrame:
    """Per top row: how many segments can end there, and the sum, least and greatest
    of their value sums.

    A segment sum is a difference of two prefix sums, so all segments ending at a
    row are described by running figures over the bottom rows; the quadratic
    number of (bottom, top) pairs is never produced.
    """
    p = series_scan(rows, keys, pos, [("_p", value, "sum_before")])
    start = F.when(F.col(pos) % min_height == 0, F.col("_p"))
    w = W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.col("_p") + F.col(value)
    out = p.select(
        *keys, F.col(pos).alias("v_t"), F.count(start).over(w).alias("n_candidates"),
        (F.count(start).over(w) * end - F.sum(start).over(w)).alias("total"),
        (end - F.max(start).over(w)).alias("least"), (end - F.min(start).over(w)).alias("greatest"))
    return out.where(F.col("v_t") % min_height == min_height - 1)


def object_table(spark, m: models.Model) -> DataFrame:
    """Object cost in millionths for every (model value, observed value or -1).

    ``max_dis`` squared rows, whatever the data: small enough to broadcast, which
    the level limit guards.
    """
    if m.max_dis > MAX_BROADCAST_LEVELS:
        raise ValueError("too many value levels for a broadcast table")
    fn = spark.range(m.max_dis).select(F.col("id").cast("int").alias("fn"), F.col("id").cast("double").alias("f"))
    fn = models.with_object_model(fn, m, "f")
    levels = fn.select("*", F.explode(F.sequence(F.lit(-1), F.lit(m.max_dis - 1))).alias("d"))
    seen = F.when(F.col("d") >= 0, F.col("d").cast("double"))
    cost = models.object_cost(m, F.col("norm"), F.col("inv"), F.col("f"), seen)
    return F.broadcast(levels.select("fn", "d", models.micro(cost).alias("cost")))


def model_prefix(rows: DataFrame, keys: list[str], pos: str, level: str, m: models.Model) -> DataFrame:
    """Exclusive prefix sums of the object cost for every model value."""
    fan = rows.withColumn("fn", F.explode(F.sequence(F.lit(0), F.lit(m.max_dis - 1))))
    cost = fan.join(object_table(rows.sparkSession, m).withColumnRenamed("d", level), ["fn", level])
    return series_scan(cost, [*keys, "fn"], pos, [("prefix", "cost", "sum_before")])


def model_cost(segs: DataFrame, columns: DataFrame, keys: list[str], seg: str, values: str,
               m: models.Model) -> DataFrame:
    """Object cost of each segment under the whole part of its own mean.

    ``columns`` holds one dense value array per key with null for a missing value.
    """
    part = F.slice(values, F.col("v_b") + 1, F.col("v_t") - F.col("v_b") + 1)
    joined = segs.select(*keys, seg, "v_b", "v_t").join(columns.select(*keys, values), keys)
    known = F.filter("_part", lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0).cast("bigint"), lambda a, x: a + x)
    fn = F.when(F.size(known) > 0, F.floor(total / F.size(known))).otherwise(0).cast("int")
    rows = (joined.withColumn("_part", part).select(*keys, seg, fn.alias("fn"), F.explode("_part").alias("_x"))
            .withColumn("d", F.coalesce(F.col("_x").cast("int"), F.lit(-1))))
    cost = rows.join(object_table(segs.sparkSession, m), ["fn", "d"])
    return cost.groupBy(*keys, seg, "fn").agg(F.sum("cost").alias("cost"))


def change_sessions(rows: DataFrame, keys: list[str], order: str, watched: Column, block: int) -> DataFrame:
    """Numbers the stretches of equal ``watched`` values in order; also for keys of any size."""
    before = blocked_scan(rows.withColumn("_w", watched), keys, order, [("_prev", "_w", "last_before")], block)
    changed = F.when(F.col("_prev").isNotNull() & (F.col("_prev") != F.col("_w")), 1).otherwise(0)
    flagged = cut_lineage(before.withColumn("changed", changed))  # read twice by the next scan
    return blocked_scan(flagged, keys, order, [("session", "changed", "sum")], block).drop("_w", "_prev")


def running_best(runs: DataFrame, order: str, score: str, block: int) -> DataFrame:
    """Best score so far and the first run that reached it."""
    cand = runs.withColumn("_c", F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o")))
    out = blocked_scan(cand, [], order, [("_best", "_c", "max")], block)
    return out.select(order, score, F.col("_best.s").alias("best"), (-F.col("_best.o")).alias("best_at"))


def closest_per_column(points: DataFrame, keys: list[str], dist: Column, tie: str) -> DataFrame:
    rest = [c for c in points.columns if c not in keys]
    best = F.min(F.struct(dist.alias("_d"), F.col(tie).alias("_t"), *rest)).alias("_b")
    return points.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def residual_filter(points: DataFrame, keys: list[str], dims: list[str], limit: float) -> DataFrame:
    """Points nearer than ``limit`` to the mean of their group."""
    mid = points.groupBy(*keys).agg(*[F.avg(d).alias(f"_m_{d}") for d in dims])
    joined = points.join(mid, keys)
    square = sum(((F.col(d) - F.col(f"_m_{d}")) ** 2 for d in dims), F.lit(0.0))
    return joined.withColumn("residual", F.sqrt(square)).where(F.col("residual") < limit).drop(*[f"_m_{d}" for d in dims])


def second_difference(points: DataFrame, keys: list[str], order: str, dims: list[str], limit: float) -> DataFrame:
    """[1, -2, 1] along ``order`` with repeated ends; flags rows whose norm is below ``limit``."""
    w = W.partitionBy(*keys).orderBy(order)

    def bend(d: str) -> Column:
        return F.coalesce(F.lag(d).over(w), F.col(d)) - 2 * F.col(d) + F.coalesce(F.lead(d).over(w), F.col(d))

    out = points.select("*", *[bend(d).alias(f"dd_{d}") for d in dims])
    norm = F.sqrt(sum((F.col(f"dd_{d}") ** 2 for d in dims), F.lit(0.0)))
    return out.withColumn("bend", norm).withColumn("inlier", norm < limit)


def strip_columns(strips: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Dense value array per strip, null where a row has no valid cell."""
    return packed.pack_dense(strips, keys, "v", {"vals": ("md", None)}, rows)
