"""Projection of segments to space, filters on the result, rasterising and colouring.

All row-wise; rasterising fans a segment out to its cells, which the grid bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.constants import CLASS_COLOURS, GROUND, INSTANCE_COLOURS, MAX_COST, OBJECT, SKY, WHITE
from colonnade.functions.lookup import lookup

CORNERS = ("tl", "tr", "br", "bl")


@dataclass(frozen=True)
class Camera:
    focal: float
    baseline: float
    center_x: float | None
    center_y: float | None
    focal_y: float | None = None

    def __post_init__(self):
        if self.center_x is None or self.center_y is None:
            raise ValueError("camera centre is not set")


def quads(segs: DataFrame, cam: Camera, rows: int, width: int, alpha: Column, vhor: Column) -> DataFrame:
    """Adds x/y/z of the four corners, clockwise from the top left.

    Objects stand at one depth, ground follows the plane, sky lies at 0; a depth that
    would divide by zero is null.
    """
    fb = cam.focal * cam.baseline
    plane = {end: F.try_divide(F.lit(fb), alpha * (vhor - F.col(v))) for end, v in (("t", "v_t"), ("b", "v_b"))}
    flat = F.try_divide(F.lit(fb), F.col("disparity").cast("double"))
    z = {end: F.when(F.col("type") == OBJECT, flat).when(F.col("type") == GROUND, plane[end]).otherwise(0.0) for end in "tb"}
    x = {"l": F.col("col_id") * width, "r": F.col("col_id") * width + width}
    y = {"t": rows - F.col("v_t") - 1, "b": rows - F.col("v_b")}
    out = {}
    for c in CORNERS:
        depth = z[c[0]]
        out[f"x_{c}"] = -depth / cam.focal * (cam.center_x - x[c[1]])
        out[f"y_{c}"] = -depth / cam.focal * (cam.center_y - y[c[0]])
        out[f"z_{c}"] = depth
    return segs.withColumns(out)


def points_3d(df: DataFrame, x: Column, y: Column, d: Column, cam: Camera) -> DataFrame:
    """Adds px, py, pz; a zero value has no point and is flagged as an error."""
    fy = cam.focal_y or cam.focal
    z = F.try_divide(F.lit(cam.focal * cam.baseline), d.cast("double"))
    return df.withColumns({
        "pz": z, "px": -(z / cam.focal) * (cam.center_x - x), "py": -(z / fy) * (cam.center_y - y), "is_error": d == 0})


def pointcloud(segs: DataFrame, keys: list[str], rows: int, width: int, alpha: Column, vhor: Column) -> tuple[DataFrame, DataFrame]:
    """(object centres with their height, corners of the ground patches), in image coordinates."""
    left, top = F.col("col_id") * width, rows - 1 - F.col("v_t")
    right, bottom = left + width - 1, rows - 1 - F.col("v_b")
    obj = segs.where(F.col("type") == OBJECT).select(
        *keys, "class_id", (0.5 * (left + right + 1)).alias("x"), (0.5 * (top + bottom)).alias("y"),
        F.col("disparity").cast("double").alias("d"), (bottom - top + 1).alias("n_rows"))
    d_top, d_bottom = alpha * (vhor - F.col("v_t")), alpha * (vhor - F.col("v_b"))
    corners = F.array(*[F.struct(F.lit(i).alias("corner"), a.cast("double").alias("x"), b.cast("double").alias("y"), d.alias("d"))
                        for i, (a, b, d) in enumerate(((left, top, d_top), (right, top, d_top),
                                                       (right, bottom, d_bottom), (left, bottom, d_bottom)))])
    ground = segs.where(F.col("type") == GROUND).select(*keys, "class_id", F.explode(corners).alias("_p")).select(
        *keys, "class_id", "_p.*")
    return obj, ground


def triangles(quad_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Two triangles per non-sky quad: (bl, tr, tl) and (bl, br, tr), one row per vertex."""
    order = (("bl", "tr", "tl"), ("bl", "br", "tr"))
    vertices = F.array(*[F.struct(F.lit(t).alias("triangle"), F.lit(i).alias("vertex"), *[F.col(f"{a}_{c}").alias(a) for a in "xyz"])
                         for t, tri in enumerate(order) for i, c in enumerate(tri)])
    return quad_rows.where(F.col("type") != SKY).select(*keys, "class_id", F.explode(vertices).alias("_v")).select(
        *keys, "class_id", "_v.*")


def view_filter(points: DataFrame, box: tuple[float, float, float]) -> DataFrame:
    """Keeps points in view, without those in the ego box (x from, x to, y above) of the image."""
    lo, hi, below = box
    ego = (F.col("x") > lo) & (F.col("x") < hi) & (F.col("y") > below)
    return points.where((F.col("pz") < 120.0) & (F.col("py") > -5.0) & (F.col("py") < 5.0) & ~ego)


def rasterize(segs: DataFrame, keys: list[str], values: list[str], rows: int, width: int) -> DataFrame:
    """One row per cell of each segment, in image rows."""
    r = F.explode(F.sequence(rows - 1 - F.col("v_t"), rows - 1 - F.col("v_b"))).alias("r")
    tall = segs.select(*keys, *values, "col_id", r)
    c = F.explode(F.sequence(F.col("col_id") * width, F.col("col_id") * width + (width - 1))).alias("c")
    return tall.select(*keys, *values, "r", c)


def class_colour(cls: Column) -> list[Column]:
    return [lookup(cls, {i: c[k] for i, c in enumerate(CLASS_COLOURS)}) for k in range(3)]


def instance_colour(cls: Column, inst: Column) -> list[Column]:
    """One of thirty colours by class and number, white without an instance."""
    index = (cls * (inst + 1)) % len(INSTANCE_COLOURS)
    return [F.when(inst == -1, WHITE[k]).otherwise(lookup(index, {i: c[k] for i, c in enumerate(INSTANCE_COLOURS)}))
            for k in range(3)]


def value_hue(d: Column) -> Column:
    return F.greatest(F.least(0.6 * ((70.0 - d) / 70.0), F.lit(1.0)), F.lit(0.0))


def cost_ramp(cost: Column) -> Column:
    """255 at -1e4 or less, falling to 0 at 1e4."""
    return (1.0 - F.greatest(cost + MAX_COST, F.lit(0.0)) / (2 * MAX_COST)) * 255


def alpha_blend(a: DataFrame, b: DataFrame, on: list[str], x: str, y: str, alpha: float) -> DataFrame:
    return a.join(b, on).select(*on, (F.col(x) * alpha + F.col(y) * (1.0 - alpha)).alias("blend"))
