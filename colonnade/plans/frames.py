"""The whole way of a frame: series to segments, instances, labels, corners in space and one message."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.operators import cluster as cl
from colonnade.operators import geometry as geo
from colonnade.plans import clustering, segmenting
from colonnade.plans.registry import query

#: Columns per frame; radius in hundredths, neighbours and least size of the clustering; bits kept for segments of a column.
COLUMNS, EPS, NEIGHBOURS, LEAST, SLOTS = 8, 1882, 3, 2, 64
CAM = geo.Camera(focal=60.0, baseline=0.5, center_x=32.0, center_y=16.0, focal_y=60.0)
HORIZON = 16


def labelled_segments(t):
    """Segments with the label of their instance; only object segments of the instance class are clustered, per frame."""
    seg = segmenting.rounded(segmenting.segments(t, True))
    seg = seg.withColumn("frame_id", F.floor(F.col("series_id") / COLUMNS)).withColumn("pt_id", F.col("series_id") * SLOTS + F.col("seg_idx"))
    hundredths = [F.round(F.col(f"mean_{a}") * 100).cast("bigint").alias(a) for a in "xy"]
    points = seg.where("type = 1 AND class_id = 3").select(
        "pt_id", (F.col("frame_id") * 10 + F.col("class_id")).alias("class_id"), *hundredths, (F.col("v_t") - F.col("v_b") + 1).alias("size"))
    found = cl.dbscan_core_only(points, "pt_id", "class_id", ("x", "y"), "size", EPS, NEIGHBOURS, LEAST).select("pt_id", "cluster")
    both = seg.join(found, "pt_id", "left")
    return both.withColumn("label", F.coalesce(cl.encode_label(F.col("class_id").cast("bigint"), F.col("cluster")), F.lit(-1).cast("bigint")))


def whole_frames(t):
    seg = labelled_segments(t).withColumn("col_id", (F.col("series_id") % COLUMNS).cast("int"))
    corners = geo.quads(seg, CAM, segmenting.ROWS, 8, F.lit(48.0 / HORIZON), F.lit(HORIZON))
    depth = [F.coalesce(F.round(F.col(f"z_{c}") * 1000).cast("bigint"), F.lit(0)) for c in geo.CORNERS]
    entry = F.struct("col_id", "seg_idx", F.concat_ws(":", "col_id", "seg_idx", "type", "label").alias("s"))
    return corners.groupBy("frame_id").agg(
        F.count("*").alias("n_segments"), F.count(F.when(F.col("label") >= 0, 1)).alias("n_labelled"),
        F.sum(sum(depth[1:], depth[0])).alias("depth_mm"),
        F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["s"]), " ").alias("message"))


def corner(row: str) -> str:
    ground = f"30.0::DOUBLE / NULLIF({48.0 / HORIZON}::DOUBLE * ({HORIZON} - {row}), 0)"
    return f"COALESCE(CAST(ROUND(1000 * CASE type WHEN 1 THEN 30.0::DOUBLE / disparity WHEN 0 THEN {ground} ELSE 0.0 END) AS BIGINT), 0)"


FRAMES_SQL = segmenting.sql(True, f""",
seg2 AS (SELECT *, series_id // {COLUMNS} AS frame_id, series_id * {SLOTS} + seg_idx AS pt_id FROM seg),
pts AS (SELECT pt_id, frame_id * 10 + class_id AS class_id, CAST(ROUND(mean_x * 100) AS BIGINT) AS x, CAST(ROUND(mean_y * 100) AS BIGINT) AS y, v_t - v_b + 1 AS size
  FROM seg2 WHERE type = 1 AND class_id = 3),
{clustering.dbscan_ctes(clustering.core_sql("pts", EPS, NEIGHBOURS, LEAST), ("x", "y"), "pts", EPS)},
all_seg AS (SELECT s.*, CASE WHEN l.cluster >= 0 THEN s.class_id * 1000 + l.cluster ELSE -1 END AS label, CAST(series_id % {COLUMNS} AS INTEGER) AS col_id
  FROM seg2 s LEFT JOIN lab l ON l.pt_id = s.pt_id)
SELECT frame_id, COUNT(*) AS n_segments, COUNT(CASE WHEN label >= 0 THEN 1 END) AS n_labelled,
  CAST(SUM(2 * {corner('v_t')} + 2 * {corner('v_b')}) AS BIGINT) AS depth_mm,
  string_agg(concat(col_id, ':', seg_idx, ':', type, ':', label), ' ' ORDER BY col_id, seg_idx) AS message FROM all_seg GROUP BY 1""")


@query("q_frame_pipeline", views=segmenting.VIEWS, sql=FRAMES_SQL)
def q_frame_pipeline(t):
    return whole_frames(t)
