"""Line voting on a histogram image and the camera geometry of the winning line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.session import cut_lineage

UNIT = 1_000_000  # cosines and sines are whole millionths, so a vote never depends on rounding
TASK_POINTS = 1 << 12  # points whose votes one task sums up: 180 for each of them


def angle_table() -> Column:
    """Array of (theta, cos, sin) for 0..179 degrees; folded to a constant by the optimizer."""
    return F.transform(F.sequence(F.lit(0), F.lit(179)), lambda a: F.struct(
        a.alias("theta"), F.round(F.cos(F.radians(a)) * UNIT).cast("bigint").alias("cos"),
        F.round(F.sin(F.radians(a)) * UNIT).cast("bigint").alias("sin")))


def line_votes(points: DataFrame, frame: list[str], x: str, y: str, min_votes: int) -> DataFrame:
    """Votes per (theta, rho) with rho in steps of one and theta in degrees.

    A frame's points are cells of a bounded histogram and all its votes come from them, so
    frames are dealt out by how many points there are, and a task sums up whole frames.
    Weak bins go before the peak test: they can never beat a bin above the limit.
    """
    held = cut_lineage(points.select(*frame, x, y))
    tasks = held.count() // TASK_POINTS + 1
    fan = held.repartition(tasks, *frame).select(*frame, x, y, F.explode(angle_table()).alias("a"))
    rho = F.floor((F.col(x) * F.col("a.cos") + F.col(y) * F.col("a.sin") + UNIT // 2) / UNIT)
    votes = (fan.select(*frame, F.col("a.theta").alias("theta"), rho.cast("int").alias("rho"))
             .groupBy(*frame, "theta", "rho").agg(F.count("*").alias("votes")))
    return votes.where(F.col("votes") >= min_votes)


def mark_peaks(votes: DataFrame, frame: list[str]) -> DataFrame:
    """Flags bins that beat their lower neighbours and are not beaten by their upper
    ones (in theta and in rho).  Each bin tells its four neighbours its votes, so
    one shuffle replaces four self joins."""
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dt).alias("dt"), F.lit(dr).alias("dr"))
                      for k, dt, dr in ((0, 0, 0), (1, 1, 0), (1, 0, 1), (2, -1, 0), (2, 0, -1))])
    told = votes.select(*frame, F.explode(steps).alias("s"), "theta", "rho", "votes").select(
        *frame, (F.col("theta") + F.col("s.dt")).alias("theta"), (F.col("rho") + F.col("s.dr")).alias("rho"),
        F.col("s.k").alias("k"), "votes")
    of = [F.max(F.when(F.col("k") == k, F.col("votes"))) for k in (0, 1, 2)]
    bins = told.groupBy(*frame, "theta", "rho").agg(of[0].alias("votes"), of[1].alias("below"), of[2].alias("above"))
    peak = (F.col("votes") > F.coalesce("below", F.lit(0))) & (F.col("votes") >= F.coalesce("above", F.lit(0)))
    return bins.where(F.col("votes").isNotNull()).select(*frame, "theta", "rho", "votes", peak.alias("peak"))


def camera_geometry(lines: DataFrame, last_row: int, focal: float, baseline: float, center_y: float) -> DataFrame:
    """Horizon, pitch, slope and camera height of each line (null where undefined)."""
    rad = F.radians("theta")
    sin, cos = F.round(F.sin(rad), 6), F.round(F.cos(rad), 6)
    out = lines.withColumn("horizon", F.try_divide(F.abs("rho").cast("double"), sin))
    out = out.withColumn("pitch", -F.atan((center_y - F.col("horizon")) / focal))
    down = F.try_divide(F.abs("rho") - last_row * sin, cos)
    out = out.withColumn("slope", F.try_divide(-down, F.col("horizon") - last_row))
    height = F.try_divide(baseline * F.cos("pitch"), F.col("slope"))
    return out.withColumn("camera_height", height).withColumn("horizon_row", F.ceil("horizon").cast("int"))


def first_acceptable(lines: DataFrame, frame: list[str], max_pitch_deg: float = 50.0) -> DataFrame:
    """The line with most votes whose pitch is within limits; ties by theta, rho.
    A running minimum over a struct, so nothing is sorted or collected."""
    rest = [c for c in lines.columns if c not in (*frame, "votes", "theta", "rho")]
    ranked = F.struct((-F.col("votes")).alias("neg_votes"), "theta", "rho", *rest)
    best = (lines.where(F.abs("pitch") <= F.radians(F.lit(max_pitch_deg)))
            .groupBy(*frame).agg(F.min(ranked).alias("b")))
    return best.select(*frame, (-F.col("b.neg_votes")).alias("votes"), "b.theta", "b.rho", *[f"b.{c}" for c in rest])
