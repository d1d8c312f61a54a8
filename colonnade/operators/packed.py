"""Series packed into one row: dense arrays whose length the grid height bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack_dense(df: DataFrame, keys: list[str], pos: str, cols: dict[str, tuple[str, object]],
               length: int) -> DataFrame:
    """One row per key with an array of ``length`` entries per column.

    ``cols`` maps an output name to (input column, value of an absent position).
    Positions must be unique per key and below ``length``; a larger one is an
    error rather than a silent loss.
    """
    kinds = dict(df.dtypes)
    entry = F.struct(F.col(pos).cast("int").alias("p"), *[F.col(src).alias(out) for out, (src, _) in cols.items()])
    packed = df.groupBy(*keys).agg(F.collect_list(entry).alias("_e"), F.max(pos).alias("_hi"), F.min(pos).alias("_lo"))
    fault = F.raise_error(F.concat(F.lit(f"position outside 0..{length - 1}: "), F.col("_hi").cast("string")))
    index = F.when((F.col("_hi") >= length) | (F.col("_lo") < 0), fault.cast("array<int>")).otherwise(
        F.sequence(F.lit(0), F.lit(length - 1)))
    blank = [F.lit(absent).cast(kinds[src]).alias(out) for out, (src, absent) in cols.items()]
    missing = F.transform(F.array_except(index, F.col("_e.p")), lambda i: F.struct(i.alias("p"), *blank))
    dense = packed.select(*keys, F.array_sort(F.concat("_e", missing)).alias("_d"))

    def values(out: str, src: str, absent) -> Column:
        """Known nulls become the absent value too."""
        got = F.col(f"_d.{out}")
        return (got if absent is None else F.transform(got, lambda x: F.coalesce(x, F.lit(absent).cast(kinds[src])))).alias(out)

    return dense.select(*keys, *[values(o, s, a) for o, (s, a) in cols.items()])


def prefix_array(values: Column, zero: Column | None = None) -> Column:
    """Exclusive prefix sums with the total at the end: [1, 2, 3] -> [0, 1, 3, 6]."""
    zero = F.lit(0).cast("bigint") if zero is None else zero
    return F.aggregate(values, F.array(zero), lambda acc, v: F.concat(
        acc, F.array(F.element_at(acc, -1) + v)))


def at(prefix: Column, i: Column) -> Column:
    """Zero-based access."""
    return F.element_at(prefix, (i + 1).cast("int"))


def range_sum(prefix: Column, v_b: Column, v_t: Column) -> Column:
    return at(prefix, v_t + 1) - at(prefix, v_b)


def coarse_range_sum(prefix: Column, v_b: Column, v_t: Column, factor: int) -> Column:
    """Sum over fine rows ``v_b..v_t`` of values given on rows ``factor`` times as
    coarse: whole coarse rows at full weight, the two ends by the rows they share."""
    qb, qt = F.floor(v_b / factor), F.floor(v_t / factor)
    rb, rt = v_b % factor, v_t % factor
    whole = (at(prefix, qt) - at(prefix, qb)) * factor
    head = (at(prefix, qt + 1) - at(prefix, qt)) * (rt + 1)
    tail = (at(prefix, qb + 1) - at(prefix, qb)) * rb
    return whole + head - tail


def segment_mean(sums: Column, valid: Column, v_b: Column, v_t: Column) -> Column:
    """Mean of the valid values of a segment, 0 if there is none, never negative."""
    total, n = range_sum(sums, v_b, v_t), range_sum(valid, v_b, v_t)
    return F.when(n > 0, F.greatest(total / n, F.lit(0.0))).otherwise(F.lit(0.0))


def segment_scatter(sx: Column, sy: Column, sxx: Column, syy: Column, v_b: Column, v_t: Column) -> Column:
    """Sum of squared distances of a segment's votes to their mean."""
    h = v_t - v_b + 1
    x, y = range_sum(sx, v_b, v_t), range_sum(sy, v_b, v_t)
    return (range_sum(sxx, v_b, v_t) - x * x / h) + (range_sum(syy, v_b, v_t) - y * y / h)


def best_class(sums: dict[int, Column], classes: list[int], extra: dict[int, Column]) -> Column:
    """(cost, class) struct of the cheapest class; lowest class on a tie."""
    return F.least(*[F.struct((sums[c] + extra.get(c, F.lit(0))).cast("double").alias("cost"),
                              F.lit(c).alias("cls")) for c in classes])
