"""Queries over projections, filters and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.operators import resample as rs
from colonnade.plans.registry import query


@query("q_crop", views=("fx_pixels",), sql="""
SELECT frame_id, r - 6 AS r, c - 10 AS c, d FROM fx_pixels
WHERE r >= 6 AND r < 58 AND c >= 10 AND c < 54""")
def q_crop(t):
    return rs.crop(t.fx_pixels, "r", "c", (64, 64), (10, 6))


@query("q_roi", views=("fx_pixels",), sql="""
WITH f AS (SELECT frame_id, MAX(r) + 1 AS h, MAX(c) + 1 AS w FROM fx_pixels GROUP BY 1),
o AS (SELECT frame_id, CASE WHEN (h - 40) // 2 > 10 THEN h - 40 - 10 ELSE (h - 40) // 2 END AS off_y, (w - 48) // 2 AS off_x FROM f)
SELECT p.frame_id, CAST(o.off_y AS INTEGER) AS off_y, CAST(o.off_x AS INTEGER) AS off_x, 32.0::DOUBLE - o.off_x AS u0, 32.0::DOUBLE - o.off_y AS v0,
  COUNT(*) AS n, CAST(SUM(d) AS BIGINT) AS total
FROM fx_pixels p JOIN o ON p.frame_id = o.frame_id
WHERE p.r BETWEEN o.off_y AND o.off_y + 39 AND p.c BETWEEN o.off_x AND o.off_x + 47 GROUP BY 1, 2, 3, 4, 5""")
def q_roi(t):
    f = t.fx_pixels.groupBy("frame_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    off_y, off_x = rs.roi_offsets(F.col("h"), F.col("w"), (40, 48), 10)
    f = f.select("frame_id", off_y.alias("off_y"), off_x.alias("off_x"))
    inside = (F.col("r").between(F.col("off_y"), F.col("off_y") + 39)
              & F.col("c").between(F.col("off_x"), F.col("off_x") + 47))
    kept = t.fx_pixels.join(f, "frame_id").where(inside)
    return (kept.groupBy("frame_id", "off_y", "off_x").agg(F.count("*").alias("n"), F.sum("d").alias("total"))
            .withColumn("u0", 32.0 - F.col("off_x")).withColumn("v0", 32.0 - F.col("off_y")))


@query("q_resize_nearest", views=("fx_pixels",), sql="""
WITH g AS (SELECT CAST(y AS INTEGER) AS r, CAST(x AS INTEGER) AS c, CAST(FLOOR((y + 0.5) * 64 / 48) AS INTEGER) AS sr,
  CAST(FLOOR((x + 0.5) * 64 / 48) AS INTEGER) AS sc FROM range(48) a(y), range(48) b(x))
SELECT p.frame_id, g.r, g.c, p.d FROM fx_pixels p JOIN g ON p.r = g.sr AND p.c = g.sc""")
def q_resize_nearest(t):
    new = rs.resize_shape((64, 64), (48, 56), 8)
    return rs.resize_nearest(t.fx_pixels, "r", "c", (64, 64), new)


@query("q_intrinsics_rescale", sql="""
SELECT c_custkey, c_acctbal AS fx, ROUND(c_acctbal * 1792 / 2048, 6) AS u0,
  ROUND((c_acctbal + 5) * 784 / 1024, 8) AS v0 FROM customer""")
def q_intrinsics_rescale(t):
    bal = F.col("c_acctbal")
    cam = t.customer.select("c_custkey", F.struct(
        bal.alias("fx"), bal.alias("fy"), bal.alias("u0"), (bal + 5).alias("v0")).alias("camera"))
    out = cam.withColumn("camera", rs.rescale_center(F.col("camera"), (784, 1792), (1024, 2048)))
    return out.select("c_custkey", "camera.fx", F.round("camera.u0", 6).alias("u0"), F.round("camera.v0", 8).alias("v0"))


@query("q_uniform_shape", views=("fx_pixels",), sql="""
WITH f AS (SELECT frame_id, MAX(r) + 1 AS h, MAX(c) + 1 AS w FROM fx_pixels GROUP BY 1)
SELECT COUNT(*) AS n_frames, COUNT(DISTINCT h * 100000 + w) AS n_shapes, COUNT(DISTINCT h * 100000 + w) = 1 AS uniform FROM f""")
def q_uniform_shape(t):
    f = t.fx_pixels.groupBy("frame_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    n = F.countDistinct(F.struct("h", "w"))
    return f.agg(F.count("*").alias("n_frames"), n.alias("n_shapes"), (n == 1).alias("uniform"))


@query("q_channel_normalize", views=("fx_pixels",), sql="""
SELECT frame_id, r, c, ROUND((d / 255.0 - CASE c % 3 WHEN 0 THEN 0.290101::DOUBLE WHEN 1 THEN 0.328081::DOUBLE ELSE 0.286964::DOUBLE END)
 / CASE c % 3 WHEN 0 THEN 0.182954::DOUBLE WHEN 1 THEN 0.186566::DOUBLE ELSE 0.184475::DOUBLE END, 6) AS x FROM fx_pixels""")
def q_channel_normalize(t):
    x = rs.channel_normalize(F.col("d"), F.col("c") % 3)
    return t.fx_pixels.select("frame_id", "r", "c", F.round(x, 6).alias("x"))


@query("q_minmax_stretch", views=("fx_pixels",), sql="""
SELECT frame_id, r, c, CAST(TRUNC((d - 1.0::DOUBLE) / 49.0::DOUBLE * 255.0::DOUBLE) AS INTEGER) AS x FROM fx_pixels""")
def q_minmax_stretch(t):
    return t.fx_pixels.select("frame_id", "r", "c", rs.stretch(F.col("d"), 1.0, 50.0).alias("x"))


@query("q_flip_pad_quantize", views=("fx_pixels",), sql="""
WITH b AS (SELECT frame_id, CAST(FLOOR(c / 8.0) AS INTEGER) AS c, CAST(FLOOR(r / 8.0) AS INTEGER) AS r, SUM(d) AS v FROM fx_pixels GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT frame_id, c FROM b)
SELECT k.frame_id, k.c, CAST(g.r AS INTEGER) AS r, CAST(COALESCE(b.v * 8, 0) AS INTEGER) AS v
FROM k CROSS JOIN range(16) g(r) LEFT JOIN b ON b.frame_id = k.frame_id AND b.c = k.c AND 7 - b.r = g.r""")
def q_flip_pad_quantize(t):
    b = t.fx_pixels.groupBy("frame_id", F.floor(F.col("c") / 8).cast("int").alias("c"),
                            F.floor(F.col("r") / 8).cast("int").alias("r")).agg(F.sum("d").alias("v"))
    return rs.flip_pad_quantize(b, ["frame_id", "c"], "r", "v", height=8, padded=16)


@query("q_block_mode", views=("fx_masks",), sql="""
WITH n AS (SELECT frame_id, CAST(FLOOR(r / 4.0) AS INTEGER) AS r, CAST(FLOOR(c / 4.0) AS INTEGER) AS c, gt, COUNT(*) AS n FROM fx_masks GROUP BY 1, 2, 3, 4)
SELECT frame_id, r, c, arg_max(gt, n * 1000 - gt) AS gt FROM n GROUP BY 1, 2, 3""")
def q_block_mode(t):
    return rs.block_mode(t.fx_masks, ["frame_id"], "r", "c", "gt", 4)


@query("q_upsample_nearest", views=("fx_pixels",), sql="""
SELECT frame_id, d, CAST(r * 2 + i AS INTEGER) AS r, CAST(c * 2 + j AS INTEGER) AS c
FROM fx_pixels CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j)""")
def q_upsample_nearest(t):
    return rs.upsample(t.fx_pixels, "r", "c", 2)


@query("q_argmin_class", views=("fx_class_cost",), sql="""
WITH m AS (SELECT series_id, MAX(n) AS m FROM fx_class_cost GROUP BY 1),
x AS (SELECT c.series_id, pos, class_id, m - n AS cost FROM fx_class_cost c JOIN m ON m.series_id = c.series_id)
SELECT series_id, pos, class_id, cost FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id, pos ORDER BY cost, class_id) AS k FROM x) WHERE k = 1""")
def q_argmin_class(t):
    top = t.fx_class_cost.groupBy("series_id").agg(F.max("n").alias("m"))
    costs = t.fx_class_cost.join(top, "series_id").withColumn("cost", F.col("m") - F.col("n"))
    return rs.argmin_class(costs, ["series_id", "pos"], "class_id", "cost")


@query("q_label_remap", views=("fx_segments",), sql="""
WITH ids AS (SELECT unnest([7,8,11,12,13,17,19,20,21,22,23,24,25,26,27,28,31,32,33]) AS id, unnest(range(19)) AS train)
SELECT s.frame_id, s.col_id, s.seg_idx, ids.id AS label_id, s.class_id AS back
FROM fx_segments s JOIN ids ON ids.train = s.class_id""")
def q_label_remap(t):
    out = t.fx_segments.select("frame_id", "col_id", "seg_idx", rs.to_label_id(F.col("class_id")).alias("label_id"))
    return out.withColumn("back", rs.to_train_id(F.col("label_id")))


@query("q_mask_extract", views=("fx_masks",), sql="""
SELECT frame_id, r, c, CAST(gt_id // 1000 - 13 AS INTEGER) AS class_id,
  CAST(gt_id % 1000 + (gt_id // 1000 - 13) * 1000 AS INTEGER) AS instance
FROM fx_masks WHERE gt_id > 1000""")
def q_mask_extract(t):
    return rs.mask_instances(t.fx_masks, "gt_id").select("frame_id", "r", "c", "class_id", "instance")


@query("q_offset_polar", views=("fx_pixels",), sql="""
WITH o AS (SELECT frame_id, r, c, CAST(d - 25 AS DOUBLE) AS oy, CAST(c - 32 AS DOUBLE) AS ox, sqrt(CAST((d - 25) * (d - 25) + (c - 32) * (c - 32) AS DOUBLE)) AS s FROM fx_pixels)
SELECT frame_id, r, c, CAST(TRUNC(LEAST(GREATEST(s * 8 / 512, 0.0), 1.0) * 255) AS INTEGER) AS mag,
  CASE WHEN s > 0 THEN CAST(TRUNC(((CASE WHEN oy < 0 THEN -acos(ox / s) ELSE acos(ox / s) END) + pi()) / (2 * pi()) * 255) AS INTEGER) END AS ang FROM o""")
def q_offset_polar(t):
    mag, ang = rs.offset_polar((F.col("d") - 25).cast("double"), (F.col("c") - 32).cast("double"), 512)
    return t.fx_pixels.select("frame_id", "r", "c", mag.alias("mag"), ang.alias("ang"))


@query("q_vote_points", views=("fx_masks",), sql="""
SELECT frame_id, r, c, r + gt - 4 AS vy, c + pred - 4 AS vx, CASE WHEN gt_id > 1000 THEN 'instance' ELSE 'background' END AS part FROM fx_masks""")
def q_vote_points(t):
    return t.fx_masks.select(
        "frame_id", "r", "c", (F.col("r") + F.col("gt") - 4).alias("vy"), (F.col("c") + F.col("pred") - 4).alias("vx"),
        F.when(F.col("gt_id") > 1000, "instance").otherwise("background").alias("part"))


@query("q_quantized_log", views=("fx_pixels",), sql="""
WITH q AS (SELECT frame_id, r, c, FLOOR((d / 50.0::DOUBLE - 0.02::DOUBLE) * 1e6 + 0.5) / 1e6 AS q FROM fx_pixels)
SELECT frame_id, r, c, CASE WHEN q > 0 THEN ROUND(ln(q), 6) END AS log_v, q <= 0 AS impossible FROM q""")
def q_quantized_log(t):
    log_v, none = rs.quantized_log(F.col("d") / 50.0 - 0.02)
    return t.fx_pixels.select("frame_id", "r", "c", F.round(log_v, 6).alias("log_v"), none.alias("impossible"))
