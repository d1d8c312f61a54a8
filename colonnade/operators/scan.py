"""Running sums, maxima and last values over series of any length.

A plain window holds one series in one task.  Here a series is cut into blocks
of positions: each block is scanned on its own, one row per block carries the
totals, and the totals are scanned the same way a level higher.  A series with a
third of all rows is thus spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colonnade.session import cut_lineage

Spec = tuple[str, str, str]  # output column, input column, kind


def _local(kind: str, col: str, w) -> Column:
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    if kind == "sum":
        return F.sum(col).over(upto)
    if kind == "sum_before":
        return F.coalesce(F.sum(col).over(before), F.lit(0))
    if kind == "max":
        return F.max(col).over(upto)
    if kind == "max_before":
        return F.max(col).over(before)
    if kind == "last":
        return F.last(col, ignorenulls=True).over(upto)
    if kind == "last_before":
        return F.last(col, ignorenulls=True).over(before)
    raise ValueError(kind)


def _total(kind: str, col: str, pos: str) -> Column:
    base = kind.removesuffix("_before")
    if base == "sum":
        return F.sum(col)
    if base == "max":
        return F.max(col)
    return F.max_by(col, F.when(F.col(col).isNotNull(), F.col(pos)))


def _merge(kind: str, local: Column, carry: Column) -> Column:
    base = kind.removesuffix("_before")
    if base == "sum":
        return local + F.coalesce(carry, F.lit(0))
    if base == "max":
        return F.greatest(local, carry)
    return F.coalesce(local, carry)


def series_scan(df: DataFrame, keys: list[str], pos: str, specs: list[Spec]) -> DataFrame:
    """One plain window per series: for series whose length the grid bounds."""
    w = W.partitionBy(*keys).orderBy(pos)
    return df.select("*", *[_local(kind, col, w).alias(out) for out, col, kind in specs])


def blocked_scan(df: DataFrame, keys: list[str], pos: str, specs: list[Spec], block: int,
                 levels: int = 1, fan: int = 1024) -> DataFrame:
    """Scan without a length bound.  ``pos`` is an integer, unique within ``keys``.

    The rows are cut into blocks of ``block`` positions, and the last, plain window
    sees one row per block; each further level groups ``fan`` blocks first.  A block
    of a million rows is a comfortable task, so one level serves a key of 10^12 rows.
    """
    if levels == 0:
        return series_scan(df, keys, pos, specs)
    cut = df.withColumn("_block", F.expr(f"floor({pos} / {float(block)})").cast("bigint"))
    return _scan_blocks(cut, keys, pos, specs, fan, levels - 1).select(*df.columns, *[out for out, _, _ in specs])


def ranged_scan(df: DataFrame, order: list[str], specs: list[Spec]) -> DataFrame:
    """Scan of all rows in one order, cut into blocks of about equally many rows wherever they lie.

    A block is a range partition, so rows crowded into a short stretch of the order are
    spread as well.  The blocks are written, as drawing the ranges again could cut them
    elsewhere; the last, plain window sees one row per block.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(
        {"_block": F.spark_partition_id().cast("bigint"), "_place": F.monotonically_increasing_id()})
    return _scan_blocks(cut_lineage(placed), [], "_place", specs, 1024, 0).select(*df.columns, *[out for out, _, _ in specs])


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """All rows with their number from 0 in one order, ``out``.

    A row knows its partition and its place in it, so nothing is shuffled after the ranges
    are drawn; what goes to every task is one row per partition.
    """
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    range_no, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(range_no.alias("_range")).agg(F.count("*").alias("_n"))
    before = series_scan(counts, [], "_range", [("_before", "_n", "sum_before")]).drop("_n")
    found = placed.withColumn("_range", range_no).join(F.broadcast(before), "_range")
    return found.select(*df.columns, (F.col("_before") + place).alias(out))


def _scan_blocks(cut: DataFrame, keys: list[str], pos: str, specs: list[Spec], fan: int, levels: int) -> DataFrame:
    b = "_block"
    totals = cut.groupBy(*keys, b).agg(*[_total(kind, col, pos).alias(f"_t{i}")
                                         for i, (_, col, kind) in enumerate(specs)])
    carry_specs = [(f"_c{i}", f"_t{i}", kind.removesuffix("_before") + "_before")
                   for i, (_, _, kind) in enumerate(specs)]
    carry = blocked_scan(totals.withColumnRenamed(b, "_p"), keys, "_p", carry_specs, fan, levels, fan)
    carry = carry.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         F.col("_p").alias("_kb"), *[f"_c{i}" for i in range(len(specs))])
    w = W.partitionBy(*keys, b).orderBy(pos)
    local = cut.select("*", *[_local(kind, col, w).alias(f"_l{i}") for i, (_, col, kind) in enumerate(specs)])
    on = (F.col(b) == F.col("_kb"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(carry, on, "left")
    return joined.select(*cut.columns, *[
        _merge(kind, F.col(f"_l{i}"), F.col(f"_c{i}")).alias(out)
        for i, (out, _, kind) in enumerate(specs)])
