"""Queries over aggregations, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.operators import aggregate as ag
from colonnade.operators import lines
from colonnade.plans.registry import query


@query("q_strip_mean", views=("fx_pixels",), sql="""
SELECT frame_id, CAST(FLOOR(c / 8.0) AS INTEGER) AS col_id, 63 - r AS v, ROUND(AVG(d), 6) AS value FROM fx_pixels GROUP BY 1, 2, 3""")
def q_strip_mean(t):
    out = ag.strip_mean(t.fx_pixels, ["frame_id"], "r", "c", "d", 8, 64)
    return out.withColumn("value", F.round("value", 6))


@query("q_strip_median", views=("fx_pixels",), sql="""
SELECT frame_id, CAST(FLOOR(c / 8.0) AS INTEGER) AS col_id, 63 - r AS v, CAST(median(d) AS DOUBLE) AS value FROM fx_pixels GROUP BY 1, 2, 3""")
def q_strip_median(t):
    return ag.strip_median(t.fx_pixels, ["frame_id"], "r", "c", "d", 8, 64)


#: Values reach from 0 to 50.
LEVELS = 51

HIST_SQL = """
hist AS (SELECT frame_id, r, CAST(d AS INTEGER) AS level, COUNT(*) AS n FROM fx_pixels WHERE d > 0 AND d < 51 GROUP BY 1, 2, 3),
top AS (SELECT frame_id, MAX(n) AS top FROM hist GROUP BY 1),
bin AS MATERIALIZED (SELECT h.frame_id, r, level, n, top FROM hist h JOIN top ON h.frame_id = top.frame_id WHERE n > top * 0.6::DOUBLE)"""


def histogram(t):
    return ag.value_histogram(t.fx_pixels, ["frame_id"], "r", "d", LEVELS)


def bright(t):
    return ag.binarize(histogram(t), ["frame_id"], "n", 0.6)


@query("q_vdisp_histogram", views=("fx_pixels",), sql=f"WITH {HIST_SQL} SELECT * FROM hist")
def q_vdisp_histogram(t):
    return histogram(t)


@query("q_binarize", views=("fx_pixels",), sql=f"WITH {HIST_SQL} SELECT * FROM bin")
def q_binarize(t):
    return bright(t)


PEAK_SQL = HIST_SQL + """,
ang AS (SELECT CAST(a AS INTEGER) AS theta, CAST(ROUND(cos(radians(a)) * 1000000) AS BIGINT) AS co, CAST(ROUND(sin(radians(a)) * 1000000) AS BIGINT) AS si FROM range(180) g(a)),
vote AS MATERIALIZED (SELECT frame_id, theta, CAST(FLOOR((level * co + r * si + 500000) / 1000000.0::DOUBLE) AS INTEGER) AS rho, COUNT(*) AS votes FROM bin CROSS JOIN ang GROUP BY 1, 2, 3),
strong AS (SELECT * FROM vote WHERE votes >= 4),
near AS (SELECT *, lag(struct_pack(t := theta, v := votes)) OVER a AS a, lead(struct_pack(t := theta, v := votes)) OVER a AS c,
  lag(struct_pack(r := rho, v := votes)) OVER b AS b, lead(struct_pack(r := rho, v := votes)) OVER b AS d FROM strong
  WINDOW a AS (PARTITION BY frame_id, rho ORDER BY theta), b AS (PARTITION BY frame_id, theta ORDER BY rho)),
peak AS (SELECT frame_id, theta, rho, votes, votes > CASE WHEN a.t = theta - 1 THEN a.v ELSE 0 END AND votes > CASE WHEN b.r = rho - 1 THEN b.v ELSE 0 END
  AND votes >= CASE WHEN c.t = theta + 1 THEN c.v ELSE 0 END AND votes >= CASE WHEN d.r = rho + 1 THEN d.v ELSE 0 END AS peak FROM near)"""


def peaks(t):
    return lines.mark_peaks(lines.line_votes(bright(t), ["frame_id"], "level", "r", 4), ["frame_id"])


@query("q_hough_votes", views=("fx_pixels",), sql=f"WITH {PEAK_SQL} SELECT * FROM peak")
def q_hough_votes(t):
    return peaks(t)


@query("q_line_geometry", views=("fx_pixels",), sql=f"""WITH {PEAK_SQL},
cand AS (SELECT *, ROUND(sin(radians(theta)), 6) AS si, ROUND(cos(radians(theta)), 6) AS co FROM peak WHERE peak),
g AS (SELECT *, CASE WHEN si <> 0 THEN abs(rho) / si END AS horizon FROM cand),
p AS (SELECT *, -atan((32.0 - horizon) / 60.0) AS pitch, CASE WHEN co <> 0 THEN (abs(rho) - 63 * si) / co END AS down FROM g),
s AS (SELECT *, CASE WHEN horizon <> 63 THEN -down / (horizon - 63) END AS slope FROM p),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY frame_id ORDER BY votes DESC, theta, rho) AS k FROM s WHERE abs(pitch) <= radians(50.0))
SELECT frame_id, votes, theta, rho, ROUND(horizon, 8) AS horizon, ROUND(pitch, 8) AS pitch, ROUND(slope, 8) AS slope,
  ROUND(CASE WHEN slope <> 0 THEN 0.5 * cos(pitch) / slope END, 6) AS camera_height, CAST(ceil(horizon) AS INTEGER) AS horizon_row FROM b WHERE k = 1""")
def q_line_geometry(t):
    geo = lines.camera_geometry(peaks(t).where("peak").drop("peak"), last_row=63, focal=60.0, baseline=0.5, center_y=32.0)
    best = lines.first_acceptable(geo, ["frame_id"])
    digits = {"horizon": 8, "pitch": 8, "slope": 8, "camera_height": 6}
    return best.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("q_instance_offsets", views=("fx_masks",), sql="""
WITH m AS (SELECT frame_id, gt_id, AVG(r) AS my, AVG(c) AS mx FROM fx_masks WHERE gt_id > 1000 GROUP BY 1, 2)
SELECT f.frame_id, f.gt_id, r, c, ROUND(my - r, 6) AS off_y, ROUND(mx - c, 6) AS off_x
FROM fx_masks f JOIN m ON f.frame_id = m.frame_id AND f.gt_id = m.gt_id""")
def q_instance_offsets(t):
    cells = t.fx_masks.where(F.col("gt_id") > 1000).select("frame_id", "gt_id", "r", "c")
    out = ag.instance_offsets(cells, ["frame_id", "gt_id"], "r", "c")
    return out.select("frame_id", "gt_id", "r", "c", F.round("off_y", 6).alias("off_y"), F.round("off_x", 6).alias("off_x"))


VALUE_SQL = """
cells AS (SELECT m.frame_id, m.gt_id, m.r, m.c, CASE WHEN p.d % 7 = 0 THEN 0 ELSE p.d END AS d
  FROM fx_masks m JOIN fx_pixels p ON p.frame_id = m.frame_id AND p.r = m.c AND p.c = m.r WHERE m.gt_id > 1000)"""


def instance_values(t):
    """Mask cells with the value of their pixel; some values are blanked to zero."""
    p = t.fx_pixels.select("frame_id", F.col("r").alias("c"), F.col("c").alias("r"), "d")
    d = F.when(F.col("d") % 7 == 0, 0).otherwise(F.col("d"))
    return (t.fx_masks.where(F.col("gt_id") > 1000).select("frame_id", "gt_id", "r", "c")
            .join(p, ["frame_id", "r", "c"]).withColumn("d", d))


def back_to_cells(cells, medians):
    """Every cell gets its instance's median; an instance without a value gets 0."""
    return cells.join(medians, ["frame_id", "gt_id"], "left").select(
        "frame_id", "gt_id", "r", "c", F.coalesce("median", F.lit(0)).alias("median"))


@query("q_instance_median_avg", views=("fx_masks", "fx_pixels"), sql=f"""WITH {VALUE_SQL},
m AS (SELECT frame_id, gt_id, CAST(median(d) AS DOUBLE) AS median FROM cells WHERE d <> 0 GROUP BY 1, 2)
SELECT c.frame_id, c.gt_id, r, c.c, COALESCE(median, 0) AS median FROM cells c LEFT JOIN m ON m.frame_id = c.frame_id AND m.gt_id = c.gt_id""")
def q_instance_median_avg(t):
    cells = instance_values(t)
    return back_to_cells(cells, ag.group_median(cells.where("d <> 0"), ["frame_id", "gt_id"], "d", lower=False))


@query("q_instance_median_lower", views=("fx_masks", "fx_pixels"), sql=f"""WITH {VALUE_SQL},
m AS (SELECT frame_id, gt_id, quantile_disc(d * 100 // 256, 0.5) AS median FROM cells WHERE d * 100 // 256 <> 0 GROUP BY 1, 2)
SELECT c.frame_id, c.gt_id, r, c.c, CAST(COALESCE(median, 0) AS BIGINT) AS median FROM cells c LEFT JOIN m ON m.frame_id = c.frame_id AND m.gt_id = c.gt_id""")
def q_instance_median_lower(t):
    cells = instance_values(t)
    scaled = cells.withColumn("d", F.expr("d * 100 div 256")).where("d <> 0")  # what scaling turns to 0 has no value
    return back_to_cells(cells, ag.group_median(scaled, ["frame_id", "gt_id"], "d", lower=True))


@query("q_instance_median_lower_all", views=("fx_masks", "fx_pixels"), sql=f"""WITH {VALUE_SQL},
m AS (SELECT frame_id, gt_id, quantile_disc(d, 0.5) AS median FROM cells GROUP BY 1, 2)
SELECT c.frame_id, c.gt_id, r, c.c, CAST(COALESCE(median, 0) AS BIGINT) AS median FROM cells c LEFT JOIN m ON m.frame_id = c.frame_id AND m.gt_id = c.gt_id""")
def q_instance_median_lower_all(t):
    cells = instance_values(t)
    return back_to_cells(cells, ag.group_median(cells, ["frame_id", "gt_id"], "d", lower=True))


@query("q_image_error", views=("fx_pixels",), sql="""
WITH e AS (SELECT a.frame_id, COUNT(*) AS n, SUM(abs(a.d - b.d)) / COUNT(*) / 256.0::DOUBLE AS error
  FROM fx_pixels a JOIN fx_pixels b ON b.frame_id = a.frame_id + 1 AND b.r = a.r AND b.c = a.c GROUP BY 1)
SELECT frame_id, n, ROUND(error, 12) AS error FROM e
UNION ALL SELECT -1, COUNT(*), ROUND(AVG(error), 12) FROM e""")
def q_image_error(t):
    """Frame against its successor; the row with frame -1 is the mean of the means."""
    after = t.fx_pixels.withColumn("frame_id", F.col("frame_id") - 1)
    per = ag.image_error(t.fx_pixels, after, "frame_id", ["r", "c"], "d")
    total = per.agg(F.lit(-1).cast("bigint").alias("frame_id"), F.count("*").alias("n"), F.avg("error").alias("error"))
    return per.unionByName(total).withColumn("error", F.round("error", 12))


@query("q_avg_segments", views=("fx_segments",), sql="""
SELECT COUNT(DISTINCT frame_id) AS n_frames, COUNT(*) AS n_segments, ROUND(COUNT(*) / COUNT(DISTINCT frame_id), 4) AS avg_segments FROM fx_segments""")
def q_avg_segments(t):
    per = t.fx_segments.groupBy("frame_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_frames"), F.sum("n").alias("n_segments"), F.round(F.avg("n"), 4).alias("avg_segments"))


@query("q_timing_mean", views=("fx_runs",), sql="""
WITH k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY frame) AS k FROM fx_runs),
m AS (SELECT run_id, COUNT(*) AS n, AVG(CASE WHEN k > 1 THEN ms / 100000.0::DOUBLE END) AS mean FROM k GROUP BY 1)
SELECT run_id, n, ROUND(mean, 8) AS mean_ms, ROUND(1000.0 / mean, 8) AS fps FROM m""")
def q_timing_mean(t):
    runs = t.fx_runs.withColumn("ms", F.col("ms") / 100000.0)
    m = ag.mean_after_first(runs, ["run_id"], "frame", "ms")
    return m.select("run_id", "n", F.round("mean", 8).alias("mean_ms"), F.round(1000.0 / F.col("mean"), 8).alias("fps"))


@query("q_run_stats", views=("fx_runs",), sql="""
SELECT run_id, COUNT(*) AS n, ROUND(AVG(ms / 100.0::DOUBLE), 6) AS mean, ROUND(stddev_pop(ms / 100.0::DOUBLE), 4) AS std FROM fx_runs GROUP BY 1""")
def q_run_stats(t):
    ms = F.col("ms") / 100.0
    return t.fx_runs.groupBy("run_id").agg(
        F.count("*").alias("n"), F.round(F.avg(ms), 6).alias("mean"), F.round(F.stddev_pop(ms), 4).alias("std"))


@query("q_epoch_metrics", sql="""
WITH x AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'train' ELSE 'validation' END AS split,
  CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS INTEGER) AS epoch, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS loss FROM orders)
SELECT epoch, ROUND(SUM(CASE WHEN split = 'train' THEN loss END) / COUNT(CASE WHEN split = 'train' THEN 1 END) / 100.0, 6) AS train,
  ROUND(CASE WHEN epoch % 5 = 0 THEN SUM(CASE WHEN split = 'validation' THEN loss END) / COUNT(CASE WHEN split = 'validation' THEN 1 END) / 100.0 END, 6) AS validation
FROM x GROUP BY epoch""")
def q_epoch_metrics(t):
    """Mean loss per split and epoch; validation is measured every fifth epoch only."""
    epoch = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")
    x = t.orders.select(
        epoch.alias("epoch"), F.when(F.col("o_orderstatus") == "F", "train").otherwise("validation").alias("split"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("loss"))
    wide = x.groupBy("epoch").pivot("split", ["train", "validation"]).agg(F.avg("loss") / 100.0)
    validation = F.when(F.col("epoch") % 5 == 0, F.col("validation"))
    return wide.select("epoch", F.round("train", 6).alias("train"), F.round(validation, 6).alias("validation"))


@query("q_segment_rollup", views=("fx_segments",), sql="""
SELECT COALESCE(class_id, -1) AS class_id, COUNT(*) AS n FROM fx_segments WHERE class_id >= 11 GROUP BY ROLLUP (class_id)""")
def q_segment_rollup(t):
    inst = t.fx_segments.where("class_id >= 11")
    return inst.rollup("class_id").agg(F.count("*").alias("n")).select(
        F.coalesce("class_id", F.lit(-1)).alias("class_id"), "n")


@query("q_topk_runs", views=("fx_runs",), sql="""
SELECT run_id, CAST(SUM(ms) AS BIGINT) AS score FROM fx_runs GROUP BY 1 ORDER BY score DESC, run_id LIMIT 10""")
def q_topk_runs(t):
    return t.fx_runs.groupBy("run_id").agg(F.sum("ms").alias("score")).orderBy(F.desc("score"), "run_id").limit(10)


@query("q_union_kinds", views=("fx_files",), sql="""
SELECT stem, path, kind FROM fx_files WHERE kind IN ('semantic', 'camera')""")
def q_union_kinds(t):
    pick = [t.fx_files.where(F.col("kind") == k).select("stem", "path", "kind") for k in ("semantic", "camera")]
    return pick[0].unionByName(pick[1])


@query("q_golden_diff", views=("fx_files",), sql="""
WITH e AS (SELECT stem, COUNT(*) AS n FROM fx_files WHERE kind = 'image' GROUP BY 1), a AS (SELECT stem, COUNT(*) AS n FROM fx_files WHERE kind = 'disparity' GROUP BY 1)
SELECT COALESCE(e.stem, a.stem) AS stem, COALESCE(e.n, 0) AS n_expected, COALESCE(a.n, 0) AS n_actual,
  CASE WHEN a.n IS NULL THEN 'missing' WHEN e.n IS NULL THEN 'unexpected' WHEN a.n = e.n THEN 'equal' ELSE 'count' END AS verdict
FROM e FULL JOIN a ON e.stem = a.stem""")
def q_golden_diff(t):
    side = [t.fx_files.where(F.col("kind") == k).select("stem") for k in ("image", "disparity")]
    n_e, n_a = F.col("n_expected"), F.col("n_actual")
    verdict = (F.when(n_a == 0, "missing").when(n_e == 0, "unexpected").when(n_a == n_e, "equal").otherwise("count"))
    return ag.count_diff(side[0], side[1], ["stem"]).withColumn("verdict", verdict)


@query("q_distinct_instances", views=("fx_masks",), sql="""
SELECT DISTINCT frame_id, gt_id FROM fx_masks WHERE gt_id > 1000""")
def q_distinct_instances(t):
    return t.fx_masks.where("gt_id > 1000").select("frame_id", "gt_id").distinct()
