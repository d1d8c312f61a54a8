"""Sampling a parameter space and scoring what a sweep gives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS = 1_000_000_007


@dataclass(frozen=True)
class Dimension:
    """One parameter: ``log`` (exponents of ten), ``real`` or ``int``, with closed bounds."""

    name: str
    kind: str
    low: float
    high: float
    step: int  # multiplier of this dimension's number sequence


# --- fixed values: the search space of the pipeline ---
SEARCH_SPACE = (
    Dimension("w_seg", "log", -4, 2, 48271), Dimension("w_inst", "log", -4, 2, 69621),
    Dimension("w_disp", "log", -4, 1, 16807), Dimension("eps", "real", 1.0, 100.0, 39373),
    Dimension("min_size", "int", 1, 10, 30269), Dimension("size_filter", "int", 1, 100, 30307),
)


def uniform(ident: Column, step: int) -> Column:
    """A number in [0, 1) that depends on the id alone: the same on every executor and rerun."""
    return ((F.pmod(ident, F.lit(MODULUS)) * step + step * 7919) % MODULUS) / MODULUS


def draw(ident: Column, dim: Dimension) -> Column:
    u = uniform(ident, dim.step)
    if dim.kind == "log":
        return F.pow(F.lit(10.0), dim.low + u * (dim.high - dim.low))
    if dim.kind == "real":
        return dim.low + u * (dim.high - dim.low)
    return (dim.low + F.floor(u * (dim.high - dim.low + 1))).cast("int")


def sample_space(ids: DataFrame, ident: str, start: dict) -> DataFrame:
    """One parameter set per id, and the given start point as id -1."""
    drawn = ids.select(ident, *[draw(F.col(ident), d).alias(d.name) for d in SEARCH_SPACE])
    first = ids.sparkSession.range(1).select(
        F.lit(-1).cast(ids.schema[ident].dataType).alias(ident),
        *[F.lit(start[d.name]).cast("int" if d.kind == "int" else "double").alias(d.name) for d in SEARCH_SPACE])
    return drawn.unionByName(first)


def composite_score(semantic: Column, instance: Column) -> Column:
    """Semantic score plus one and a half times the instance score; a failed run counts 0."""
    return F.coalesce(semantic, F.lit(0.0)) + 1.5 * F.coalesce(instance, F.lit(0.0))


def golden_check(expected: DataFrame, actual: DataFrame, case: str, value: str, tolerance: float) -> DataFrame:
    """Verdict per test case: equal within tolerance, different, or not run."""
    j = expected.select(case, F.col(value).alias("expected")).join(
        actual.select(case, F.col(value).alias("actual")), case, "left")
    verdict = (F.when(F.col("actual").isNull(), "missing")
               .when(F.abs(F.col("actual") - F.col("expected")) <= tolerance, "equal").otherwise("different"))
    return j.withColumn("verdict", verdict)
