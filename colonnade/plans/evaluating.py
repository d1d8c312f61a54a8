"""Queries over losses and evaluation scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.operators import evaluation as ev
from colonnade.plans.registry import query

CELL_SQL = """
cells AS (SELECT m.frame_id, m.r, m.c, m.gt_id, CAST(m.gt - 4 AS DOUBLE) AS off_y, CAST(m.pred - 3 AS DOUBLE) AS off_x,
  CASE WHEN p.d % 7 = 0 THEN 0 ELSE p.d END AS gt_d, CAST((p.d * 3) % 50 AS DOUBLE) AS pred_d
  FROM fx_masks m JOIN fx_pixels p ON p.frame_id = m.frame_id AND p.r = m.c AND p.c = m.r)"""
VIEWS = ("fx_masks", "fx_pixels")


def loss_cells(t):
    d = F.col("d")
    p = t.fx_pixels.select("frame_id", F.col("r").alias("c"), F.col("c").alias("r"),
                           F.when(d % 7 == 0, 0).otherwise(d).alias("gt_d"), ((d * 3) % 50).cast("double").alias("pred_d"))
    return t.fx_masks.select("frame_id", "r", "c", "gt_id", (F.col("gt") - 4).cast("double").alias("off_y"),
                             (F.col("pred") - 3).cast("double").alias("off_x")).join(p, ["frame_id", "r", "c"])


TERM_SQL = CELL_SQL + """,
m AS (SELECT *, AVG(r) OVER w AS my, AVG(c) OVER w AS mx, AVG(r + off_y) OVER w AS ay, AVG(c + off_x) OVER w AS ax, AVG(pred_d) OVER w AS ad, COUNT(*) OVER w AS n
  FROM cells WHERE gt_id > 1000 WINDOW w AS (PARTITION BY frame_id, gt_id)),
md AS (SELECT frame_id, gt_id, quantile_disc(gt_d, 0.5) AS med FROM cells WHERE gt_id > 1000 AND gt_d <> 0 GROUP BY 1, 2),
i AS (SELECT m.frame_id, m.gt_id, SUM(abs(r + off_y - my) + abs(c + off_x - mx)) / COUNT(*) / 2 AS om, (var_pop(r + off_y) + var_pop(c + off_x)) / 2 AS ov,
  CASE WHEN COUNT(*) > 2 THEN SUM(abs(r + off_y - ay) + abs(c + off_x - ax)) / COUNT(*) / 2 ELSE 0 END AS oa,
  COALESCE(SUM(abs(pred_d - med)) / COUNT(*), 0) AS dm, var_pop(pred_d) AS dv, CASE WHEN COUNT(*) > 2 THEN SUM(abs(pred_d - ad)) / COUNT(*) ELSE 0 END AS da
  FROM m LEFT JOIN md ON md.frame_id = m.frame_id AND md.gt_id = m.gt_id GROUP BY 1, 2),
f AS (SELECT frame_id, SUM(om) AS om, SUM(ov) AS ov, SUM(oa) AS oa, SUM(dm) AS dm, SUM(dv) AS dv, SUM(da) AS da FROM i GROUP BY 1),
b AS (SELECT frame_id, SUM(abs(off_y) + abs(off_x)) / COUNT(*) / 2 AS bo, SUM(abs(pred_d)) / COUNT(*) AS bd FROM cells WHERE gt_id < 11 OR gt_id = 255 GROUP BY 1),
x AS (SELECT COALESCE(f.frame_id, b.frame_id) AS frame_id, COALESCE(om, 0) + COALESCE(bo, 0) AS om, COALESCE(ov, 0) AS ov, COALESCE(oa, 0) AS oa, COALESCE(dm, 0) + COALESCE(bd, 0) AS dm, COALESCE(dv, 0) AS dv, COALESCE(da, 0) AS da
  FROM f FULL JOIN b ON b.frame_id = f.frame_id)"""


def rounded(df, names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("q_offset_loss", views=VIEWS, sql=f"""
WITH {TERM_SQL} SELECT frame_id, ROUND(om, 6) AS offset_mean, ROUND(ov, 6) AS offset_variance, ROUND(0.001::DOUBLE * om + 0.0001::DOUBLE * ov, 6) AS loss FROM x""")
def q_offset_loss(t):
    out = ev.frame_loss(loss_cells(t), "frame_id", "gt_id", {"offset_mean": 1e-3, "offset_variance": 1e-4})
    return rounded(out.drop("mode"), ["offset_mean", "offset_variance", "loss"])


@query("q_disp_offset_loss", views=VIEWS, sql=f"""
WITH {TERM_SQL}
SELECT frame_id, 'variance' AS mode, ROUND(om, 6) AS offset_mean, ROUND(ov, 6) AS offset_variance, ROUND(dm, 6) AS disparity_mean, ROUND(dv, 6) AS disparity_variance,
  ROUND(0.001::DOUBLE * om + 0.0001::DOUBLE * ov + 0.001::DOUBLE * dm + 0.0001::DOUBLE * dv, 6) AS loss FROM x
UNION ALL SELECT frame_id, 'absolute', ROUND(om, 6), ROUND(oa, 6), ROUND(dm, 6), ROUND(da, 6), ROUND(0.001::DOUBLE * om + 0.0001::DOUBLE * oa + 0.001::DOUBLE * dm + 0.0001::DOUBLE * da, 6) FROM x""")
def q_disp_offset_loss(t):
    weights = {"offset_mean": 1e-3, "offset_variance": 1e-4, "disparity_mean": 1e-3, "disparity_variance": 1e-4}
    return rounded(ev.frame_loss(loss_cells(t), "frame_id", "gt_id", weights, ("variance", "absolute")), [*weights, "loss"])


@query("q_nll", views=("fx_class_cost",), sql="""
WITH n AS (SELECT series_id, pos, SUM(n) AS total FROM fx_class_cost GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN pos % 6 = 5 THEN 255 ELSE pos % 6 END AS class_id FROM n)
SELECT t.series_id, COUNT(*) AS n, ROUND(AVG(-ln((COALESCE(c.n, 0) + 1.0::DOUBLE) / (total + 5))), 6) AS loss
FROM t LEFT JOIN fx_class_cost c ON c.series_id = t.series_id AND c.pos = t.pos AND c.class_id = t.class_id WHERE t.class_id <> 255 GROUP BY 1""")
def q_nll(t):
    """True class of a cell: its position modulo 6, where 5 means ignored."""
    total = t.fx_class_cost.groupBy("series_id", "pos").agg(F.sum("n").alias("total"))
    k = F.col("pos") % 6
    truth = total.select("series_id", "pos", F.when(k == 5, 255).otherwise(k).alias("class_id"),
                         (-F.log(1.0 / (F.col("total") + 5))).alias("absent"))
    costs = t.fx_class_cost.join(total, ["series_id", "pos"]).withColumn("cost", -F.log((F.col("n") + 1.0) / (F.col("total") + 5)))
    return rounded(ev.nll(costs, truth, ["series_id", "pos"], "series_id", "class_id", "cost", "absent"), ["loss"])


DIFF_SQL = "SELECT frame_id, (gt_d - pred_d) / 10.0::DOUBLE AS x FROM cells"


def diffs(t):
    return loss_cells(t).select("frame_id", ((F.col("gt_d") - F.col("pred_d")) / 10.0).alias("x"))


@query("q_smooth_l1", views=VIEWS, sql=f"""
WITH {CELL_SQL}, d AS ({DIFF_SQL}) SELECT frame_id, COUNT(*) AS n, ROUND(AVG(CASE WHEN abs(x) < 1 THEN 0.5::DOUBLE * x * x ELSE abs(x) - 0.5::DOUBLE END), 6) AS loss FROM d GROUP BY 1""")
def q_smooth_l1(t):
    return diffs(t).groupBy("frame_id").agg(F.count("*").alias("n"), F.round(F.avg(ev.smooth_l1(F.col("x"))), 6).alias("loss"))


@query("q_mse", views=VIEWS, sql=f"""
WITH {CELL_SQL}, d AS ({DIFF_SQL}) SELECT frame_id, COUNT(*) AS n, ROUND(AVG(x * x), 6) AS loss FROM d GROUP BY 1""")
def q_mse(t):
    return diffs(t).groupBy("frame_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x") * F.col("x")), 6).alias("loss"))


@query("q_confusion", views=("fx_masks",), sql="SELECT gt, pred, COUNT(*) AS n FROM fx_masks GROUP BY 1, 2")
def q_confusion(t):
    return ev.confusion(t.fx_masks, "gt", "pred")


@query("q_iou", views=("fx_masks",), sql="""
WITH c AS (SELECT cls, COUNT(CASE WHEN gt = cls THEN 1 END) AS n_gt, COUNT(CASE WHEN pred = cls THEN 1 END) AS n_pred, COUNT(CASE WHEN gt = cls AND pred = cls THEN 1 END) AS tp
  FROM fx_masks CROSS JOIN (SELECT DISTINCT CAST(gt AS INTEGER) AS cls FROM fx_masks) k GROUP BY 1),
i AS (SELECT cls, n_gt, n_pred, tp / (n_gt + n_pred - tp) AS iou FROM c)
SELECT cls, n_gt, n_pred, ROUND(iou, 6) AS iou FROM i UNION ALL SELECT -1, CAST(SUM(n_gt) AS BIGINT), CAST(SUM(n_pred) AS BIGINT), ROUND(AVG(iou), 6) FROM i""")
def q_iou(t):
    per = ev.iou_from_confusion(ev.confusion(t.fx_masks, "gt", "pred"), "gt", "pred")
    mean = per.agg(F.lit(-1).alias("cls"), F.sum("n_gt").alias("n_gt"), F.sum("n_pred").alias("n_pred"), F.avg("iou").alias("iou"))
    return rounded(per.unionByName(mean), ["iou"])


OVERLAP_SQL = """
g AS (SELECT frame_id, gt_id, COUNT(*) AS area FROM fx_masks WHERE gt_id > 1000 GROUP BY 1, 2),
p AS (SELECT frame_id, pred_id, COUNT(*) AS area FROM fx_masks WHERE pred_id > 1000 GROUP BY 1, 2),
o AS (SELECT frame_id, gt_id, pred_id, COUNT(*) AS inter FROM fx_masks WHERE gt_id > 1000 AND pred_id > 1000 AND gt_id // 1000 = pred_id // 1000 GROUP BY 1, 2, 3),
ov AS (SELECT o.frame_id, o.gt_id, o.pred_id, o.inter, g.area AS gt_area, p.area AS pred_area FROM o JOIN g ON g.frame_id = o.frame_id AND g.gt_id = o.gt_id JOIN p ON p.frame_id = o.frame_id AND p.pred_id = o.pred_id)"""


@query("q_instance_overlap", views=("fx_masks",), sql=f"""
WITH {OVERLAP_SQL} SELECT *, ROUND(inter / (gt_area + pred_area - inter), 6) AS iou FROM ov""")
def q_instance_overlap(t):
    out = ev.instance_overlap(ev.pair_counts(t.fx_masks, "frame_id", "gt_id", "pred_id"), "frame_id", "gt_id", "pred_id")
    iou = F.col("inter") / (F.col("gt_id_area") + F.col("pred_id_area") - F.col("inter"))
    return out.select("frame_id", "gt_id", "pred_id", "inter", F.col("gt_id_area").alias("gt_area"),
                      F.col("pred_id_area").alias("pred_area"), F.round(iou, 6).alias("iou"))


@query("q_instance_ap", views=("fx_masks",), sql=f"""
WITH {OVERLAP_SQL},
c AS (SELECT cls, SUM(n_gt) AS n_gt, SUM(n_pred) AS n_pred FROM (SELECT gt_id // 1000 AS cls, 1 AS n_gt, 0 AS n_pred FROM g UNION ALL SELECT pred_id // 1000, 0, 1 FROM p) z GROUP BY 1),
th AS (SELECT CAST(50 + 5 * k AS INTEGER) AS threshold FROM range(10) r(k)),
tp AS (SELECT gt_id // 1000 AS cls, threshold, COUNT(*) AS tp FROM ov CROSS JOIN th WHERE inter * 100 > (gt_area + pred_area - inter) * threshold GROUP BY 1, 2)
SELECT CAST(c.cls AS INTEGER) AS cls, th.threshold, COALESCE(tp.tp, 0) AS tp, CAST(n_gt AS BIGINT) AS n_gt, CAST(n_pred AS BIGINT) AS n_pred,
  ROUND(COALESCE(tp.tp, 0) / n_gt * (1 + COALESCE(tp.tp, 0) / n_pred) / 2, 6) AS ap
FROM c CROSS JOIN th LEFT JOIN tp ON tp.cls = c.cls AND tp.threshold = th.threshold WHERE n_gt > 0""")
def q_instance_ap(t):
    return rounded(ev.average_precision(t.fx_masks, "frame_id", "gt_id", "pred_id"), ["ap"])
