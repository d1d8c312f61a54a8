"""Aggregations over cells, instances, runs and segments.

All are mergeable: values are counted or summed before they are shuffled, so a
group with a third of the rows costs no more than one with a thousand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def strip_cells(cells: DataFrame, frame: list[str], row: str, col: str, step: int, height: int,
                value: Column) -> DataFrame:
    """Joins ``step`` neighbouring cells per row to one strip cell and turns rows
    bottom-up; ``value`` aggregates the valid cells of a strip row."""
    return cells.groupBy(*frame, F.floor(F.col(col) / step).cast("int").alias("col_id"),
                         (height - 1 - F.col(row)).alias("v")).agg(value.alias("value"))


def strip_mean(cells, frame, row, col, value, step, height):
    return strip_cells(cells, frame, row, col, step, height, F.avg(value))


def strip_median(cells, frame, row, col, value, step, height):
    """At most ``step`` values meet in one group, so the exact median is cheap."""
    return strip_cells(cells, frame, row, col, step, height, F.median(value))


def value_histogram(cells: DataFrame, frame: list[str], row: str, value: str, max_dis: int) -> DataFrame:
    """Count per row and whole value; zeros, negative values and values from ``max_dis`` on are left out."""
    level = F.floor(F.col(value)).cast("int")
    return (cells.where((F.col(value) > 0) & (F.col(value) < max_dis)).select(*frame, row, level.alias("level"))
            .groupBy(*frame, row, "level").agg(F.count("*").alias("n")))


def binarize(hist: DataFrame, frame: list[str], n: str, threshold: float) -> DataFrame:
    """Histogram cells strictly above ``threshold`` times the frame's largest count."""
    top = hist.groupBy(*frame).agg(F.max(n).alias("top"))
    return hist.join(top, frame).where(F.col(n) > F.col("top") * threshold)


def instance_offsets(cells: DataFrame, keys: list[str], row: str, col: str) -> DataFrame:
    """Offset of every cell to the centre of mass of its instance."""
    mid = cells.groupBy(*keys).agg(F.avg(row).alias("mid_y"), F.avg(col).alias("mid_x"))
    return (cells.join(mid, keys).withColumn("off_y", F.col("mid_y") - F.col(row))
            .withColumn("off_x", F.col("mid_x") - F.col(col)))


def group_median(rows: DataFrame, keys: list[str], value: str, lower: bool) -> DataFrame:
    """Exact median per group from value counts.

    ``lower`` takes the smaller of two middle values, otherwise their mean.  Only
    one row per (group, distinct value) is shuffled on to the second step.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    if not lower:
        return counts.groupBy(*keys).agg(F.percentile(value, F.lit(0.5), F.col("_n")).alias("median"))
    w = W.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    half = F.floor((F.sum("_n").over(w) + 1) / 2)
    return (counts.withColumn("_ok", upto >= half).where("_ok")
            .groupBy(*keys).agg(F.min(value).alias("median")))


def image_error(a: DataFrame, b: DataFrame, frame: str, cell: list[str], value: str) -> DataFrame:
    """Mean absolute difference per frame over cells valid in both, scaled by 1/256."""
    other = b.withColumnRenamed(value, "_other").where(F.col("_other") != 0)
    both = a.where(F.col(value) != 0).join(other, [frame, *cell])
    return both.groupBy(frame).agg(
        F.count("*").alias("n"), (F.sum(F.abs(F.col(value) - F.col("_other"))) / F.count("*") / 256.0).alias("error"))


def mean_after_first(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Mean of ``value`` without the first row in order: a plain aggregate, no sort."""
    first, n = F.min_by(value, order), F.count(value)
    rest = F.when(n > 1, (F.sum(value) - first) / (n - 1))
    return rows.groupBy(*keys).agg(n.alias("n"), rest.alias("mean"))


def count_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How often each key occurs in ``a`` and in ``b``: one shuffle for all set operations."""
    both = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    return both.groupBy(*keys).agg(F.sum("_a").alias("n_expected"), F.sum("_b").alias("n_actual"))
