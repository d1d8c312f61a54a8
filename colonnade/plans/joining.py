"""Queries over joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.functions.constants import CLASS_NAMES, FIRST_INSTANCE_CLASS
from colonnade.operators import joins as jn
from colonnade.operators.resample import to_train_id
from colonnade.plans.registry import query

SEG = ["frame_id", "col_id", "seg_idx"]


@query("q_multiway_key_join", sql="""
SELECT o_orderkey, c_name, n_name, r_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def q_multiway_key_join(t):
    """Sizes differ per deployment, so join strategies are left to adaptive execution."""
    c, n, r = t.customer, t.nation, t.region
    return (t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"))
            .join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("o_orderkey", "c_name", "n_name", "r_name", "o_totalprice"))


@query("q_rect_join", views=("fx_segments",), sql="""
SELECT s.frame_id, s.col_id, s.seg_idx, COUNT(*) AS n, CAST(SUM(p.d) AS BIGINT) AS total FROM fx_segments s
JOIN fx_pixels p ON p.frame_id = s.frame_id AND p.c BETWEEN s.col_id * 8 AND s.col_id * 8 + 7 AND p.r BETWEEN 63 - s.v_t AND 63 - s.v_b GROUP BY 1, 2, 3""")
def q_rect_join(t):
    inside = jn.rectangle_join(t.fx_segments.select(*SEG, "v_b", "v_t"), t.fx_pixels, ["frame_id"], 8, 64)
    return inside.groupBy(*SEG).agg(F.count("*").alias("n"), F.sum("d").alias("total"))


@query("q_majority_assign", views=("fx_segments", "fx_masks"), sql="""
WITH s AS (SELECT * FROM fx_segments WHERE class_id >= 11),
v AS (SELECT s.frame_id, s.col_id, s.seg_idx, s.class_id, s.v_b, s.v_t, CASE WHEN m.gt_id > 1000 AND m.gt_id // 1000 - 13 = s.class_id THEN m.gt_id ELSE 0 END AS id, COUNT(*) AS n
  FROM s JOIN fx_masks m ON m.frame_id = s.frame_id AND m.c BETWEEN s.col_id * 8 AND s.col_id * 8 + 7 AND m.r BETWEEN 63 - s.v_t AND 63 - s.v_b GROUP BY 1, 2, 3, 4, 5, 6, 7),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY frame_id, col_id, seg_idx ORDER BY n DESC, id) AS k FROM v)
SELECT s.frame_id, s.col_id, s.seg_idx, CAST(CASE WHEN k.id > 1000 AND k.n >= 0.1::DOUBLE * 8 * (s.v_t - s.v_b) THEN k.id % 1000 + s.class_id * 1000 ELSE -1 END AS INTEGER) AS label
FROM s LEFT JOIN k ON k.frame_id = s.frame_id AND k.col_id = s.col_id AND k.seg_idx = s.seg_idx AND k.k = 1""")
def q_majority_assign(t):
    cells = t.fx_masks.select("frame_id", "r", "c", "gt_id", F.when(
        F.col("gt_id") > 1000, to_train_id(F.floor(F.col("gt_id") / 1000).cast("int"))).alias("cell_class"))
    segs = t.fx_segments.where(F.col("class_id") >= FIRST_INSTANCE_CLASS).select(*SEG, "class_id", "v_b", "v_t")
    return jn.majority_assign(segs, cells, ["frame_id"], SEG, "gt_id", 8, 64)


@query("q_rect_median", views=("fx_segments",), sql="""
WITH m AS (SELECT s.frame_id, s.col_id, s.seg_idx, median(p.d) AS median FROM fx_segments s
  JOIN fx_pixels p ON p.frame_id = s.frame_id AND p.c BETWEEN s.col_id * 8 AND s.col_id * 8 + 7 AND p.r BETWEEN 63 - s.v_t AND 63 - s.v_b
  WHERE s.class_id > 10 AND p.d >= 1 GROUP BY 1, 2, 3)
SELECT s.frame_id, s.col_id, s.seg_idx, CAST(COALESCE(m.median, 0) AS DOUBLE) AS median
FROM fx_segments s LEFT JOIN m ON m.frame_id = s.frame_id AND m.col_id = s.col_id AND m.seg_idx = s.seg_idx""")
def q_rect_median(t):
    segs = t.fx_segments.select(*SEG, "class_id", "v_b", "v_t")
    return jn.rectangle_median(segs, t.fx_pixels, ["frame_id"], SEG, "d", 8, 64)


@query("q_label_left_join", views=("fx_segments",), sql="""
WITH l AS (SELECT frame_id, col_id, seg_idx, class_id * 1000 + inst AS label FROM fx_segments WHERE inst >= 0 AND class_id >= 11)
SELECT s.frame_id, s.col_id, s.seg_idx, s.class_id, COALESCE(l.label, -1) AS label
FROM fx_segments s LEFT JOIN l ON l.frame_id = s.frame_id AND l.col_id = s.col_id AND l.seg_idx = s.seg_idx""")
def q_label_left_join(t):
    labels = t.fx_segments.where("inst >= 0 AND class_id >= 11").select(*SEG, (F.col("class_id") * 1000 + F.col("inst")).alias("label"))
    return jn.label_left_join(t.fx_segments.select(*SEG, "class_id"), labels, SEG, "label")


@query("q_label_violations", views=("fx_segments",), sql="""
SELECT frame_id, col_id, seg_idx, class_id, class_id < 11 AS violation FROM fx_segments WHERE inst >= 0""")
def q_label_violations(t):
    """Labelled segments, marked by whether their class may carry instances: one left join with the fixed class list."""
    allowed = t.spark.range(FIRST_INSTANCE_CLASS, len(CLASS_NAMES)).select(F.col("id").cast("int").alias("class_id"), F.lit(True).alias("_ok"))
    labelled = t.fx_segments.where("inst >= 0").select(*SEG, "class_id")
    return labelled.join(F.broadcast(allowed), "class_id", "left").select(*SEG, "class_id", F.col("_ok").isNull().alias("violation"))


CONFIG_TEXT = "person, car, truck; skyline"


@query("q_class_filter", views=("fx_segments",), sql=f"""
WITH n AS (SELECT unnest(range({len(CLASS_NAMES)})) AS class_id, unnest({list(CLASS_NAMES)!r}) AS name)
SELECT s.frame_id, s.col_id, s.seg_idx, s.class_id, n.name AS class_name FROM fx_segments s JOIN n ON n.class_id = s.class_id
WHERE strpos('{CONFIG_TEXT}', n.name) > 0""")
def q_class_filter(t):
    """Classes whose name occurs in the configuration text (so "skyline" keeps sky)."""
    kept = jn.names_in_text(CLASS_NAMES, CONFIG_TEXT)
    name = F.element_at(F.lit(list(CLASS_NAMES)), F.col("class_id") + 1)
    return t.fx_segments.select(*SEG, "class_id", name.alias("class_name")).where(F.col("class_name").isin(kept))


@query("q_param_sweep", views=("fx_segments",), sql="""
WITH f AS (SELECT frame_id, COUNT(*) AS n, CAST(SUM(cost) AS BIGINT) AS cost FROM fx_segments GROUP BY 1),
p AS (SELECT * FROM (VALUES (0, 0.5::DOUBLE), (1, 1.0::DOUBLE), (2, 4.7095::DOUBLE), (3, 14.9498::DOUBLE)) v(param_id, weight))
SELECT frame_id, param_id, n, ROUND(cost * weight, 4) AS weighted FROM f CROSS JOIN p""")
def q_param_sweep(t):
    per_frame = t.fx_segments.groupBy("frame_id").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
    out = jn.fan_out(per_frame, [{"weight": w} for w in (0.5, 1.0, 4.7095, 14.9498)])
    return out.select("frame_id", "param_id", "n", F.round(F.col("cost") * F.col("weight"), 4).alias("weighted"))


@query("q_asof_config", sql="""
WITH e AS (SELECT event_id, epoch_us(ts) AS us, user_id FROM events WHERE event_type <> 'error'),
c AS (SELECT epoch_us(ts) AS us, event_id AS config_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events WHERE event_type = 'error')
SELECT e.event_id, e.us, c.config_id, c.k FROM e ASOF LEFT JOIN c ON e.us >= c.us""")
def q_asof_config(t):
    """Error events change the configuration; every other event is processed under the last one."""
    ev = t.events.withColumn("us", jn.micros(F.col("ts")))
    config = ev.where("event_type = 'error'").select(
        "us", F.col("event_id").alias("config_id"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    events = ev.where("event_type <> 'error'").select("event_id", "us")
    return jn.asof_config(events, config, "us", ["config_id", "k"])
