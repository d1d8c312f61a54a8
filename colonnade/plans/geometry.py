"""Queries over projection, rasterising and colouring."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.functions.constants import CLASS_COLOURS, INSTANCE_COLOURS
from colonnade.operators import geometry as geo
from colonnade.plans.registry import query

SEG = ["frame_id", "col_id", "seg_idx"]
CAM = geo.Camera(focal=60.0, baseline=0.5, center_x=32.0, center_y=32.0, focal_y=62.0)


def plane():
    """Slope and horizon of a frame's ground, from the frame id."""
    horizon = 40 + F.col("frame_id") % 8
    return 48.0 / horizon, horizon.cast("int")


def quads(t):
    return geo.quads(t.fx_segments, CAM, 64, 8, *plane())


def corner_sql() -> str:
    parts = []
    for c in geo.CORNERS:
        z = "zt" if c[0] == "t" else "zb"
        x = "col_id * 8" if c[1] == "l" else "(col_id * 8 + 8)"
        y = "(64 - v_t - 1)" if c[0] == "t" else "(64 - v_b)"
        parts.append(f"-{z} / 60 * (32 - {x}) AS x_{c}, -{z} / 60 * (32 - {y}) AS y_{c}, {z} AS z_{c}")
    return ", ".join(parts)


QUAD_SQL = f"""
pz AS (SELECT *, CASE type WHEN 1 THEN 30.0::DOUBLE / disparity WHEN 0 THEN 30.0::DOUBLE / NULLIF(48.0::DOUBLE / (40 + frame_id % 8) * (40 + frame_id % 8 - v_t), 0) ELSE 0.0 END AS zt,
  CASE type WHEN 1 THEN 30.0::DOUBLE / disparity WHEN 0 THEN 30.0::DOUBLE / NULLIF(48.0::DOUBLE / (40 + frame_id % 8) * (40 + frame_id % 8 - v_b), 0) ELSE 0.0 END AS zb FROM fx_segments),
quad AS (SELECT frame_id, col_id, seg_idx, type, class_id, {corner_sql()} FROM pz)"""
NAMES = [f"{a}_{c}" for c in geo.CORNERS for a in "xyz"]


@query("q_quads_3d", views=("fx_segments",), sql=f"""
WITH {QUAD_SQL} SELECT frame_id, col_id, seg_idx, {', '.join(f'ROUND({n}, 5) + 0.0 AS {n}' for n in NAMES)} FROM quad""")
def q_quads_3d(t):
    return quads(t).select(*SEG, *[(F.round(n, 5) + 0.0).alias(n) for n in NAMES])


@query("q_triangles", views=("fx_segments",), sql=f"""
WITH {QUAD_SQL}, tri AS (
{' UNION ALL '.join(f"SELECT frame_id, col_id, seg_idx, class_id, {t} AS triangle, {i} AS vertex, x_{c} AS x, y_{c} AS y, z_{c} AS z FROM quad WHERE type <> 2" for t, tri in enumerate((("bl", "tr", "tl"), ("bl", "br", "tr"))) for i, c in enumerate(tri))})
SELECT frame_id, col_id, seg_idx, class_id, triangle, vertex, ROUND(x, 5) + 0.0 AS x, ROUND(y, 5) + 0.0 AS y, ROUND(z, 5) + 0.0 AS z FROM tri""")
def q_triangles(t):
    return geo.triangles(quads(t), SEG).withColumns({a: F.round(a, 5) + 0.0 for a in "xyz"})


POINT_SQL = """
p0 AS (SELECT frame_id, r, c, CASE WHEN d % 10 = 0 THEN 0 ELSE d END AS d FROM fx_pixels),
pt AS (SELECT *, CASE WHEN d <> 0 THEN 30.0::DOUBLE / d END AS pz, d = 0 AS is_error FROM p0)"""


def points(t):
    px = t.fx_pixels.withColumn("d", F.when(F.col("d") % 10 == 0, 0).otherwise(F.col("d")))
    return geo.points_3d(px, F.col("c"), F.col("r"), F.col("d"), CAM)


@query("q_points_3d", views=("fx_pixels",), sql=f"""
WITH {POINT_SQL} SELECT frame_id, r, c, is_error, ROUND(-(pz / 60) * (32 - c), 5) + 0.0 AS px, ROUND(-(pz / 62) * (32 - r), 5) + 0.0 AS py, ROUND(pz, 5) AS pz FROM pt""")
def q_points_3d(t):
    return points(t).select("frame_id", "r", "c", "is_error", (F.round("px", 5) + 0.0).alias("px"),
                            (F.round("py", 5) + 0.0).alias("py"), F.round("pz", 5).alias("pz"))


@query("q_view_filter", views=("fx_pixels",), sql=f"""
WITH {POINT_SQL} SELECT frame_id, r, c, d FROM pt WHERE pz < 120 AND -(pz / 62) * (32 - r) > -5 AND -(pz / 62) * (32 - r) < 5 AND NOT (c > 20 AND c < 44 AND r > 50)""")
def q_view_filter(t):
    pts = points(t).withColumns({"x": F.col("c"), "y": F.col("r")})
    return geo.view_filter(pts, (20, 44, 50)).select("frame_id", "r", "c", "d")


@query("q_pointcloud", views=("fx_segments",), sql="""
WITH b AS (SELECT frame_id, col_id, seg_idx, type, class_id, disparity, col_id * 8 AS x0, col_id * 8 + 7 AS x1, 63 - v_t AS y0, 63 - v_b AS y1,
  48.0::DOUBLE / (40 + frame_id % 8) * (40 + frame_id % 8 - v_t) AS d0, 48.0::DOUBLE / (40 + frame_id % 8) * (40 + frame_id % 8 - v_b) AS d1 FROM fx_segments)
SELECT frame_id, col_id, seg_idx, class_id, 'object' AS part, 0 AS corner, CAST(0.5 * (x0 + x1 + 1) AS DOUBLE) AS x, CAST(0.5 * (y0 + y1) AS DOUBLE) AS y, CAST(disparity AS DOUBLE) AS d, y1 - y0 + 1 AS n_rows FROM b WHERE type = 1
UNION ALL SELECT frame_id, col_id, seg_idx, class_id, 'ground', k, CAST(CASE WHEN k IN (0, 3) THEN x0 ELSE x1 END AS DOUBLE), CAST(CASE WHEN k < 2 THEN y0 ELSE y1 END AS DOUBLE), ROUND(CASE WHEN k < 2 THEN d0 ELSE d1 END, 6) + 0.0, 0
FROM b CROSS JOIN (SELECT CAST(k AS INTEGER) AS k FROM range(4) g(k)) WHERE type = 0""")
def q_pointcloud(t):
    obj, ground = geo.pointcloud(t.fx_segments, SEG, 64, 8, *plane())
    obj = obj.withColumn("part", F.lit("object")).withColumn("corner", F.lit(0))
    ground = ground.withColumn("part", F.lit("ground")).withColumn("n_rows", F.lit(0)).withColumn("d", F.round("d", 6) + 0.0)
    return obj.unionByName(ground)


@query("q_rasterize", views=("fx_segments",), sql="""
SELECT s.frame_id, s.class_id, s.disparity, s.inst, CAST(63 - v.v AS INTEGER) AS r, CAST(s.col_id * 2 + x.x AS INTEGER) AS c
FROM fx_segments s JOIN range(64) v(v) ON v.v BETWEEN s.v_b AND s.v_t CROSS JOIN range(2) x(x)""")
def q_rasterize(t):
    return geo.rasterize(t.fx_segments, ["frame_id"], ["class_id", "disparity", "inst"], 64, 2)


def palette_cte(name: str, colours) -> str:
    rows = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(colours))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) v(k, r, g, b))"


@query("q_palette", views=("fx_segments",), sql=f"""
WITH {palette_cte('pc', CLASS_COLOURS)}, {palette_cte('pi', INSTANCE_COLOURS)}
SELECT s.frame_id, s.col_id, s.seg_idx, pc.r AS class_r, pc.g AS class_g, pc.b AS class_b,
  CASE WHEN inst = -1 THEN 255 ELSE pi.r END AS inst_r, CASE WHEN inst = -1 THEN 255 ELSE pi.g END AS inst_g, CASE WHEN inst = -1 THEN 255 ELSE pi.b END AS inst_b,
  ROUND(GREATEST(LEAST(0.6::DOUBLE * ((70.0::DOUBLE - disparity) / 70.0::DOUBLE), 1.0), 0.0), 6) AS hue,
  ROUND((1.0::DOUBLE - GREATEST(cost + 10000.0::DOUBLE, 0.0) / 20000.0::DOUBLE) * 255, 6) AS ramp
FROM fx_segments s JOIN pc ON pc.k = s.class_id JOIN pi ON pi.k = (s.class_id * (s.inst + 1)) % 30""")
def q_palette(t):
    cls = geo.class_colour(F.col("class_id"))
    inst = geo.instance_colour(F.col("class_id"), F.col("inst"))
    return t.fx_segments.select(
        *SEG, *[c.alias(f"class_{n}") for n, c in zip("rgb", cls)], *[c.alias(f"inst_{n}") for n, c in zip("rgb", inst)],
        F.round(geo.value_hue(F.col("disparity").cast("double")), 6).alias("hue"),
        F.round(geo.cost_ramp(F.col("cost").cast("double")), 6).alias("ramp"))


@query("q_alpha_blend", views=("fx_pixels", "fx_masks"), sql="""
SELECT p.frame_id, m.r, m.c, ROUND(p.d * 0.3::DOUBLE + m.gt * 0.7::DOUBLE, 6) AS blend FROM fx_masks m JOIN fx_pixels p ON p.frame_id = m.frame_id AND p.r = m.c AND p.c = m.r""")
def q_alpha_blend(t):
    p = t.fx_pixels.select("frame_id", F.col("r").alias("c"), F.col("c").alias("r"), "d")
    out = geo.alpha_blend(p, t.fx_masks.select("frame_id", "r", "c", "gt"), ["frame_id", "r", "c"], "d", "gt", 0.3)
    return out.withColumn("blend", F.round("blend", 6))
