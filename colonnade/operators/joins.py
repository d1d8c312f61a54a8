"""Joins the plain equi-join cannot express: rectangles, as-of, names, parameter fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.operators.scan import ranged_scan

MAX_PARAMETER_SETS = 4096


def rectangle_join(segs: DataFrame, cells: DataFrame, keys: list[str], width: int, rows: int,
                   row: str = "r", col: str = "c", band: int = 16, how: str = "inner") -> DataFrame:
    """Cells inside each segment's rectangle.

    A segment of strip ``col_id`` covers columns ``col_id * width ..`` and image rows
    ``rows - 1 - v_t .. rows - 1 - v_b``.  Strip and row band make it an equi-join: a
    segment is repeated once per band it touches, so a cell only meets the segments
    of its own strip and band.
    """
    top, bottom = rows - 1 - F.col("v_t"), rows - 1 - F.col("v_b")
    bands = F.sequence(F.floor(top / band).cast("int"), F.floor(bottom / band).cast("int"))
    s = segs.withColumn("_top", top).withColumn("_bottom", bottom).withColumn("_band", F.explode(bands))
    c = cells.withColumn("col_id", F.floor(F.col(col) / width).cast("int")).withColumn(
        "_band", F.floor(F.col(row) / band).cast("int"))
    j = s.join(c, [*keys, "col_id", "_band"]) if how == "inner" else s.join(c, [*keys, "col_id", "_band"], how)
    return j.where(F.col(row).between(F.col("_top"), F.col("_bottom"))).drop("_top", "_bottom", "_band")


def majority_assign(segs: DataFrame, cells: DataFrame, keys: list[str], seg: list[str], instance: str,
                    width: int, rows: int, share: float = 0.1) -> DataFrame:
    """The instance most cells of a segment carry, or -1.

    Cells of another class count as 0; ties go to the smallest id; the winner needs
    ``share`` of ``width * (height - 1)`` cells.
    """
    inside = rectangle_join(segs, cells, keys, width, rows)
    own = F.when(F.col("cell_class") == F.col("class_id"), F.col(instance)).otherwise(0)
    votes = inside.groupBy(*seg, "class_id", "v_b", "v_t", own.alias("_id")).agg(F.count("*").alias("_n"))
    best = votes.groupBy(*seg, "class_id", "v_b", "v_t").agg(
        F.max(F.struct(F.col("_n").alias("n"), (-F.col("_id")).alias("neg"))).alias("_b"))
    winner = F.when(F.col("_b.n") < share * width * (F.col("v_t") - F.col("v_b")), -1).otherwise(-F.col("_b.neg"))
    label = F.when(winner > 1000, winner % 1000 + F.col("class_id") * 1000).otherwise(-1)
    found = best.select(*seg, label.cast("int").alias("label"))
    return segs.select(*seg).join(found, seg, "left").select(*seg, F.coalesce("label", F.lit(-1)).alias("label"))


def rectangle_median(segs: DataFrame, cells: DataFrame, keys: list[str], seg: list[str], value: str,
                     width: int, rows: int) -> DataFrame:
    """Median of the values from 1 up inside each segment of an instance class, else 0."""
    wanted = segs.where(F.col("class_id") > 10)
    inside = rectangle_join(wanted, cells.where(F.col(value) >= 1), keys, width, rows)
    med = inside.groupBy(*seg).agg(F.median(value).alias("median"))
    return segs.select(*seg).join(med, seg, "left").select(*seg, F.coalesce("median", F.lit(0.0)).alias("median"))


def label_left_join(segs: DataFrame, labels: DataFrame, seg: list[str], label: str) -> DataFrame:
    return segs.join(labels, seg, "left").withColumn(label, F.coalesce(label, F.lit(-1)))


def names_in_text(names: tuple[str, ...], text: str) -> list[str]:
    """Names that occur anywhere in a configuration text."""
    return [n for n in names if n in text]


def fan_out(rows: DataFrame, params: list[dict], name: str = "param_id") -> DataFrame:
    """Every row once per parameter set, as a generator over a literal list.

    Sweep summaries, not raw cells: aggregate first, then fan out.
    """
    if len(params) > MAX_PARAMETER_SETS:
        raise ValueError("too many parameter sets for a literal; use a join with a parameter table")
    sets = F.array(*[F.struct(F.lit(i).alias(name), *[F.lit(v).alias(k) for k, v in p.items()])
                     for i, p in enumerate(params)])
    return rows.select("*", F.explode(sets).alias("_p")).select(*rows.columns, "_p.*")


def asof_config(events: DataFrame, configs: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """The configuration in force at each event: the last one at or before it.

    Both sides go into one ordered stream that is scanned in blocks of equally many rows,
    so neither a long history, a burst of events nor a single global key ends up in one task.
    """
    cfg = F.struct(*fields)
    e = events.withColumn("_side", F.lit(1)).withColumn("_cfg", F.lit(None).cast(configs.select(cfg).schema[0].dataType))
    rest = [c for c in events.columns if c != order]
    one = configs.groupBy(order).agg(F.max(cfg).alias("_cfg"))  # of several at one instant the greatest holds
    c = one.select(order, *[F.lit(None).cast(events.schema[n].dataType).alias(n) for n in rest],
                       F.lit(0).alias("_side"), "_cfg")
    both = e.unionByName(c).withColumn("_pos", F.col(order) * 2 + F.col("_side"))
    scanned = ranged_scan(both, ["_pos"], [("_now", "_cfg", "last")])
    return scanned.where(F.col("_side") == 1).select(*events.columns, *[F.col(f"_now.{f}").alias(f) for f in fields])


def micros(ts: Column) -> Column:
    """Event time as whole microseconds, for timestamps with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))
