"""Cropping, resizing, normalising and relabelling of grid cells.

Everything here is row-wise or an explode with a factor fixed by the request,
except the block mode and the padding: no operator needs to see a whole frame.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.constants import CHANNEL_MEAN, CHANNEL_STD, FIRST_INSTANCE_CLASS, LABEL_IDS
from colonnade.functions.lookup import lookup


def crop(cells: DataFrame, row: str, col: str, shape: tuple[int, int], margin: tuple[int, int]) -> DataFrame:
    """Cuts ``margin`` (x, y) off both sides of a grid of ``shape`` (height, width)."""
    (h, w), (cx, cy) = shape, margin
    inside = F.col(row).between(cy, h - cy - 1) & F.col(col).between(cx, w - cx - 1)
    return cells.where(inside).withColumns({row: F.col(row) - cy, col: F.col(col) - cx})


def roi_offsets(h: Column, w: Column, size: tuple[int, int], bottom: int) -> tuple[Column, Column]:
    """(off_y, off_x) of a centred window that hangs ``bottom`` above the lower edge
    once the frame is tall enough for that."""
    th, tw = size
    off_y = F.floor((h - th) / 2).cast("int")
    off_x = F.floor((w - tw) / 2).cast("int")
    return F.when(off_y > bottom, h - th - bottom).otherwise(off_y), off_x


def resize_shape(shape: tuple[int, int], target: tuple[int, int], step: int) -> tuple[int, int]:
    """Aspect-preserving size: the smaller ratio, width snapped down to ``step``."""
    (h, w), (th, tw) = shape, target
    ratio = min(th / h, tw / w)
    new_w = int(w * ratio) // step * step
    if new_w % 8:
        raise ValueError("resized width must be a multiple of 8")
    return int(h * ratio), new_w


def _axis_targets(src: str, n_src: int, n_dst: int) -> Column:
    """Target positions d with floor((d + 0.5) * n_src / n_dst) = src, as a closed range."""
    lo = F.ceil((F.col(src) * (2 * n_dst) - n_src) / (2.0 * n_src))
    hi = F.ceil(((F.col(src) + 1) * (2 * n_dst) - n_src) / (2.0 * n_src)) - 1
    hi = F.least(hi, F.lit(n_dst - 1))
    return F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int")))


def resize_nearest(cells: DataFrame, row: str, col: str, shape: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """Nearest resize without a join: each source cell knows the targets it feeds."""
    rest = [c for c in cells.columns if c not in (row, col)]
    tall = cells.select(*rest, col, F.explode(_axis_targets(row, shape[0], new[0])).alias(row))
    return tall.select(*rest, row, F.explode(_axis_targets(col, shape[1], new[1])).alias(col))


def upsample(cells: DataFrame, row: str, col: str, k: int) -> DataFrame:
    rest = [c for c in cells.columns if c not in (row, col)]
    reps = F.sequence(F.lit(0), F.lit(k - 1))
    return (cells.select(*rest, row, col, F.explode(reps).alias("_i"))
            .select(*rest, (F.col(row) * k + F.col("_i")).alias(row), col)
            .select(*rest, row, col, F.explode(reps).alias("_i"))
            .select(*rest, row, (F.col(col) * k + F.col("_i")).alias(col)))


def rescale_center(camera: Column, new: tuple[int, int], old: tuple[int, int]) -> Column:
    """Scales only the principal point (u0 by width, v0 by height); focal lengths stay."""
    (nh, nw), (oh, ow) = new, old
    return (camera.withField("u0", camera["u0"] * nw / ow).withField("v0", camera["v0"] * nh / oh))


def channel_normalize(value: Column, channel: Column) -> Column:
    mean, std = (lookup(channel, dict(enumerate(t))) for t in (CHANNEL_MEAN, CHANNEL_STD))
    return (value / 255.0 - mean) / std


def stretch(value: Column, low: float, high: float) -> Column:
    """Linear stretch of [low, high] to 0..255, cut towards zero."""
    return ((value - low) / (high - low) * 255.0).cast("int")


def flip_pad_quantize(cells: DataFrame, keys: list[str], row: str, value: str, height: int, padded: int,
                      scale: int = 8) -> DataFrame:
    """Turns rows upside down, fills up to ``padded`` rows with zeros, scales to int.

    One row set per key: the known rows are kept as a small array of at most
    ``padded`` entries, so the fill needs no join with a generated grid.  A row outside
    of ``0..padded - 1`` ends the job.
    """
    k = height - 1 - F.col(row)
    outside = F.raise_error(F.concat(F.lit("row outside of the padded range: "), F.col(row).cast("string"))).cast("int")
    entry = F.struct(F.when((k >= 0) & (k < padded), k).otherwise(outside).alias("k"), (F.col(value) * scale).cast("int").alias("v"))
    packed = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    return (packed.select(*keys, "_m", F.explode(F.sequence(F.lit(0), F.lit(padded - 1))).alias(row))
            .select(*keys, row, F.coalesce(F.try_element_at("_m", F.col(row)), F.lit(0)).alias(value)))


def block_mode(cells: DataFrame, keys: list[str], row: str, col: str, value: str, factor: int) -> DataFrame:
    """Most frequent value per block, the smallest on a tie; ``factor`` must be even."""
    if factor % 2:
        raise ValueError("block factor must be even")
    return (cells.groupBy(*keys, F.floor(F.col(row) / factor).cast("int").alias(row),
                          F.floor(F.col(col) / factor).cast("int").alias(col))
            .agg(F.mode(value, True).alias(value)))


def argmin_class(costs: DataFrame, keys: list[str], cls: str, cost: str) -> DataFrame:
    """Cheapest class per cell, the lowest class on a tie."""
    best = F.min(F.struct(F.col(cost).alias("cost"), F.col(cls).alias("cls"))).alias("_b")
    return costs.groupBy(*keys).agg(best).select(*keys, F.col("_b.cls").alias(cls), F.col("_b.cost").alias(cost))


TRAIN_TO_ID = dict(enumerate(LABEL_IDS))
ID_TO_TRAIN = {v: k for k, v in TRAIN_TO_ID.items()}


def to_label_id(train_id: Column) -> Column:
    """Train id to public label id; other values stay as they are."""
    return F.coalesce(lookup(train_id, TRAIN_TO_ID), train_id)


def to_train_id(label_id: Column) -> Column:
    return lookup(label_id, ID_TO_TRAIN)


def mask_instances(cells: DataFrame, instance: str) -> DataFrame:
    """Cells of instance classes with the instance renumbered to train class * 1000 + n."""
    label = F.floor(F.col(instance) / 1000).cast("int")
    train = to_train_id(label)
    return (cells.where(F.col(instance) > 1000).withColumn("class_id", train)
            .where(F.col("class_id") >= FIRST_INSTANCE_CLASS)
            .withColumn("instance", (F.col(instance) % (label * 1000) + F.col("class_id") * 1000).cast("int")))


def offset_polar(off_y: Column, off_x: Column, width: int) -> tuple[Column, Column]:
    """(magnitude, direction) of an offset, both scaled to 0..255; no direction for a zero offset."""
    size = F.sqrt(off_y * off_y + off_x * off_x)
    mag = (F.least(F.greatest(size * 8 / width, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    angle = F.acos(off_x / size)
    signed = F.when(off_y < 0, -angle).otherwise(angle)
    return mag, F.when(size > 0, ((signed + math.pi) / (2 * math.pi) * 255).cast("int"))


def quantized_log(v: Column) -> tuple[Column, Column]:
    """(log of ``v`` rounded to 1e-6, whether that is minus infinity)."""
    q = F.floor(v * 1e6 + 0.5) / 1e6
    return F.when(q > 0, F.log(q)), q <= 0
