"""Queries over sources, sinks and ingest checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colonnade.functions.constants import FIRST_INSTANCE_LABEL_ID, LABEL_IDS
from colonnade.functions.lookup import lookup
from colonnade.plans.registry import query
from colonnade.session import cut_lineage, shared_dir, spread
from colonnade.sources import catalog, gates, logs, segment_text

KINDS = ("image", "disparity", "camera", "semantic")
R6 = 6


@query("q_frame_catalog", views=("fx_files",), sql="""
WITH w AS (SELECT stem,
  MIN(CASE WHEN kind='image' THEN path END) AS image, MIN(CASE WHEN kind='disparity' THEN path END) AS disparity,
  MIN(CASE WHEN kind='camera' THEN path END) AS camera, MIN(CASE WHEN kind='semantic' THEN path END) AS semantic,
  COUNT(CASE WHEN kind='image' THEN 1 END) AS n_image, COUNT(CASE WHEN kind='disparity' THEN 1 END) AS n_disparity,
  COUNT(CASE WHEN kind='camera' THEN 1 END) AS n_camera, COUNT(CASE WHEN kind='semantic' THEN 1 END) AS n_semantic
  FROM fx_files GROUP BY stem)
SELECT *, CASE WHEN image IS NULL OR disparity IS NULL OR camera IS NULL THEN 'error'
  WHEN n_image > 1 OR n_disparity > 1 OR n_camera > 1 OR n_semantic > 1 THEN 'warning' ELSE 'ok' END AS status
FROM w""")
def q_frame_catalog(t):
    return catalog.frame_catalog(t.fx_files, KINDS, optional=("semantic",))


@query("q_stem_extract", views=("fx_files",), sql="""
SELECT file_name, regexp_replace(file_name, '_[a-z].*', '') AS stem,
  regexp_extract(file_name, '([a-z]*)_([0-9]*)_([0-9]*)_', 1) AS place,
  CAST(regexp_extract(file_name, '([a-z]*)_([0-9]*)_([0-9]*)_', 2) AS INTEGER) AS seq,
  CAST(regexp_extract(file_name, '([a-z]*)_([0-9]*)_([0-9]*)_', 3) AS BIGINT) AS frame_no
FROM fx_files""")
def q_stem_extract(t):
    return catalog.stem_parts(t.fx_files.select("file_name"), "file_name")


@query("q_source_consistency", views=("fx_files",), sql="""
SELECT * FROM (SELECT stem,
  COUNT(CASE WHEN kind='image' THEN 1 END) AS n_image, COUNT(CASE WHEN kind='disparity' THEN 1 END) AS n_disparity,
  COUNT(CASE WHEN kind='camera' THEN 1 END) AS n_camera, COUNT(CASE WHEN kind='semantic' THEN 1 END) AS n_semantic
  FROM fx_files GROUP BY stem)
WHERE n_image <> 1 OR n_disparity <> 1 OR n_camera <> 1 OR n_semantic <> 1""")
def q_source_consistency(t):
    return catalog.consistency_report(t.fx_files, KINDS)


@query("q_sorted_limit", views=("fx_files",), sql="""
SELECT kind, path FROM (SELECT kind, path, page_id FROM fx_files WHERE kind = 'image'
  UNION ALL SELECT kind, path, page_id FROM fx_files WHERE kind = 'disparity')
ORDER BY path, page_id LIMIT 100""")
def q_sorted_limit(t):
    two = [t.fx_files.where(F.col("kind") == k).select("kind", "path", "page_id") for k in ("image", "disparity")]
    return catalog.sorted_listing(two[0].unionByName(two[1]), ["path", "page_id"], 100).select("kind", "path")


@query("q_json_params", sql="""
SELECT event_id, COALESCE(CAST(json_extract_string(props, '$.k') AS DOUBLE), 1495.46) AS k,
  COALESCE(CAST(json_extract_string(props, '$.baseline') AS DOUBLE), 0.22087) AS baseline FROM events""")
def q_json_params(t):
    return gates.json_params(t.events.select("event_id", "props"), "props",
                             {"k": 1495.46, "baseline": 0.22087}).drop("props")


SEG_FIELDS = ["type", "v_b", "v_t", "disparity", "class_id", "cost", "mean_x", "mean_y"]
LINE_SQL = """
SELECT frame_id, col_id, string_agg(concat(CAST(type AS VARCHAR), ',', CAST(v_b AS VARCHAR), ',',
  CAST(v_t AS VARCHAR), ',', CAST(disparity AS VARCHAR), ',', CAST(class_id AS VARCHAR), ',',
  CAST(cost AS VARCHAR), ',', CAST(mean_x AS VARCHAR), ',', CAST(mean_y AS VARCHAR),
  CASE WHEN class_id >= 11 THEN concat(',', CAST(inst AS VARCHAR)) ELSE '' END, ';'), '' ORDER BY seg_idx) AS line
FROM fx_segments GROUP BY frame_id, col_id"""


def segment_lines(t):
    segs = t.fx_segments.withColumn("lab", F.when(F.col("class_id") >= 11, F.col("inst")))
    return segment_text.write_segments(segs, ["frame_id", "col_id"], "seg_idx", SEG_FIELDS, "lab")


@query("q_segment_text_write", views=("fx_segments",), sql=LINE_SQL)
def q_segment_text_write(t):
    return segment_lines(t)


@query("q_segment_text_parse", views=("fx_segments",), sql="""
SELECT frame_id, col_id, seg_idx, type, v_b, v_t, CAST(disparity AS DOUBLE) AS disparity, class_id,
  CAST(cost AS DOUBLE) AS cost, CAST(mean_x AS DOUBLE) AS mean_x, CAST(mean_y AS DOUBLE) AS mean_y,
  CAST(CASE WHEN class_id < 11 THEN NULL WHEN inst >= 0 AND inst < 1000 THEN class_id * 1000 + inst
       ELSE -1 END AS INTEGER) AS label, FALSE AS bad_label
FROM fx_segments""")
def q_segment_text_parse(t):
    return segment_text.parse_segments(segment_lines(t), ["frame_id", "col_id"])


FORM_SQL = """
WITH s AS (SELECT *, CASE (col_id + seg_idx) % 4 WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 6 ELSE 8 END AS k,
  DENSE_RANK() OVER (PARTITION BY frame_id ORDER BY col_id) - 1 AS line_no FROM fx_segments)"""


def text_files(t):
    """Segment files, one per frame: lines of all forms, closed by a ground line; written, listed and read back."""
    k = F.element_at(F.array(*map(F.lit, (4, 5, 6, 8))), ((F.col("col_id") + F.col("seg_idx")) % 4 + 1).cast("int"))
    fields = F.slice(F.array(*[F.col(c).cast("string") for c in SEG_FIELDS]), F.lit(1), k)
    text = F.concat(F.array_join(fields, ","), F.lit(";"))
    lines = t.fx_segments.groupBy("frame_id", "col_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", text.alias("t")))), lambda s: s["t"]), "").alias("line"))
    ground = t.fx_segments.select("frame_id").distinct().select(
        "frame_id", F.lit(1 << 30).alias("col_id"), F.format_string("groundplane%.2f,%d", F.col("frame_id") % 8 / 4, 40 + F.col("frame_id") % 8).alias("line"))
    folder = fresh_folder(t.spark, "segment-files")
    segment_text.write_files(lines.unionByName(ground), "frame_id", "col_id", "line", folder)
    return folder


@query("q_segment_text_files", views=("fx_segments",), sql=FORM_SQL + """
SELECT frame_id, CAST(line_no AS INTEGER) AS line_no, seg_idx, type, v_b, v_t, CAST(disparity AS DOUBLE) AS disparity, CASE WHEN k >= 5 THEN class_id END AS class_id,
  CAST(CASE WHEN k >= 6 THEN cost END AS DOUBLE) AS cost, CAST(CASE WHEN k >= 8 THEN mean_x END AS DOUBLE) AS mean_x,
  CAST(CASE WHEN k >= 8 THEN mean_y END AS DOUBLE) AS mean_y, CAST(NULL AS INTEGER) AS label, FALSE AS bad_label FROM s""")
def q_segment_text_files(t):
    lines = segment_text.read_files(t.spark, text_files(t)).withColumn("frame_id", F.col("frame_id").cast("bigint"))
    return segment_text.parse_segments(lines, ["frame_id", "line_no"])


@query("q_ground_line_files", views=("fx_segments",), sql="""
SELECT DISTINCT CAST(frame_id AS INTEGER) AS frame_id, (frame_id % 8) / 4.0::DOUBLE AS alpha_ground, CAST(40 + frame_id % 8 AS INTEGER) AS vhor, TRUE AS listed FROM fx_segments""")
def q_ground_line_files(t):
    folder = text_files(t)
    lines = segment_text.read_files(t.spark, folder)
    found = catalog.list_files(t.spark, folder, "*.txt").select(F.regexp_extract("path", "frame_id=([0-9]+)", 1).cast("int").alias("frame_id"), (F.col("length") > 0).alias("listed"))
    return segment_text.parse_ground(lines, ["frame_id"]).withColumn("frame_id", F.col("frame_id").cast("int")).join(found, "frame_id")


@query("q_camera_files", sql="""
SELECT s_suppkey AS frame_id, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey / 8.0::DOUBLE ELSE 0.22087 END AS baseline,
  CASE WHEN s_suppkey % 3 = 1 THEN s_suppkey * 2.0::DOUBLE ELSE 1495.46 END AS fx FROM supplier""")
def q_camera_files(t):
    """Two thirds of the frames have a camera file, half of those without a focal length; the rest falls back."""
    frames = t.supplier.select(F.col("s_suppkey").alias("frame_id"))
    focal = F.when(F.col("frame_id") % 3 == 1, F.struct((F.col("frame_id") * 2.0).alias("fx")))
    folder = fresh_folder(t.spark, "cameras")
    given = frames.where("frame_id % 3 <> 0").withColumn("folder", F.col("frame_id"))
    found = given.select("folder", F.struct((F.col("frame_id") / 8).alias("baseline")).alias("extrinsic"), focal.alias("intrinsic"))
    segment_text.by_file(found, "folder").write.partitionBy("folder").option("maxRecordsPerFile", 1).json(folder)
    cameras = gates.read_cameras(t.spark, f"{folder}/*/*.json").withColumn("frame_id", F.regexp_extract("path", "folder=([0-9]+)", 1).cast("int"))
    got = frames.join(cameras, "frame_id", "left")
    return got.select("frame_id", F.coalesce("extrinsic.baseline", F.lit(0.22087)).alias("baseline"), F.coalesce("intrinsic.fx", F.lit(1495.46)).alias("fx"))


MANIFEST_SQL = """
SELECT DISTINCT frame_id, concat(CAST(frame_id AS VARCHAR), '_', CAST(class_id * 1000 + inst AS VARCHAR), '.png ',
  CASE class_id WHEN 11 THEN '24' WHEN 12 THEN '25' WHEN 13 THEN '26' WHEN 14 THEN '27' WHEN 15 THEN '28'
    WHEN 16 THEN '31' WHEN 17 THEN '32' WHEN 18 THEN '33' ELSE '0' END, ' 1.0') AS line,
  class_id < 11 AS is_error
FROM fx_segments WHERE inst >= 0 AND type = 1"""


@query("q_instance_manifest", views=("fx_segments",), sql=MANIFEST_SQL)
def q_instance_manifest(t):
    return manifest(t)


def manifest(t):
    """Lines of the instance manifest per frame."""
    ids = (t.fx_segments.where((F.col("inst") >= 0) & (F.col("type") == 1))
           .select("frame_id", "class_id", (F.col("class_id") * 1000 + F.col("inst")).alias("label")).distinct())
    label_id = lookup(F.col("class_id"), dict(enumerate(LABEL_IDS)))
    allowed = F.when(label_id >= FIRST_INSTANCE_LABEL_ID, label_id).otherwise(0)
    return ids.select(
        "frame_id", F.format_string("%d_%d.png %d 1.0", "frame_id", "label", allowed).alias("line"),
        (label_id < FIRST_INSTANCE_LABEL_ID).alias("is_error"))


@query("q_manifest_files", views=("fx_segments",), sql=f"""
SELECT CAST(frame_id AS INTEGER) AS frame_id, CAST(ROW_NUMBER() OVER (PARTITION BY frame_id ORDER BY line) - 1 AS INTEGER) AS line_no, line FROM ({MANIFEST_SQL}) m WHERE NOT is_error""")
def q_manifest_files(t):
    """One manifest file per frame, written and read back with line numbers."""
    folder = fresh_folder(t.spark, "manifest")
    segment_text.write_files(manifest(t).where("NOT is_error").withColumn("o", F.col("line")), "frame_id", "o", "line", folder)
    return segment_text.read_files(t.spark, folder).select(F.col("frame_id").cast("int").alias("frame_id"), "line_no", "line")


@query("q_scale_and_gate", views=("fx_pixels",), sql="""
WITH p AS (SELECT frame_id, r, c, CASE WHEN frame_id % 2 = 0 THEN d / 256.0 ELSE CAST(d AS DOUBLE) END AS v FROM fx_pixels),
f AS (SELECT frame_id, MAX(r) + 1 AS n_rows, COUNT(*) AS n_cells, ROUND(SUM(v), 6) AS total FROM p GROUP BY 1)
SELECT frame_id, n_rows, n_cells, total, CASE WHEN n_rows < 64 THEN 'too_small' WHEN n_rows >= 1024 THEN 'too_large'
  ELSE 'ok' END AS verdict FROM f""")
def q_scale_and_gate(t):
    bits = F.when(F.col("frame_id") % 2 == 0, 16).otherwise(8)
    p = t.fx_pixels.withColumn("v", gates.scale_values(F.col("d"), bits))
    verdict = gates.gate_by_height(p, ["frame_id"], "r", 64)
    sums = p.groupBy("frame_id").agg(F.count("*").alias("n_cells"), F.round(F.sum("v"), R6).alias("total"))
    return verdict.join(sums, "frame_id")


@query("q_shape_check", views=("fx_pixels",), sql="""
WITH f AS (SELECT frame_id, CAST(MAX(r) + 1 AS INTEGER) AS h, CAST(MAX(c) + 1 AS INTEGER) AS w, COUNT(DISTINCT c) AS n_cols
  FROM fx_pixels GROUP BY 1)
SELECT frame_id, h, w, n_cols,
  CAST(power(2, ceil(log2(floor(h / 8.0) + 1))) AS INTEGER) AS want_h, CAST(floor(w / 8.0) AS INTEGER) AS want_w,
  power(2, ceil(log2(floor(h / 8.0) + 1))) = 16 AND floor(w / 8.0) = 8 AS shape_ok FROM f""")
def q_shape_check(t):
    f = t.fx_pixels.groupBy("frame_id").agg(
        (F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"), F.countDistinct("c").alias("n_cols"))
    want_h, want_w = gates.padded_height(F.col("h"), 8), F.floor(F.col("w") / 8).cast("int")
    return f.select("*", want_h.alias("want_h"), want_w.alias("want_w"),
                    ((want_h == 16) & (want_w == 8)).alias("shape_ok"))


@query("q_log_parse", sql="""
WITH lines AS (SELECT o_custkey AS run_id, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no,
  CASE o_orderstatus WHEN 'F' THEN concat('Score Average : ', printf('%.3f', (o_orderkey % 1000) / 1000.0))
    WHEN 'O' THEN concat('Time per batch ', CAST(o_orderkey AS VARCHAR), '.5 s') ELSE 'progress' END AS line FROM orders),
n AS (SELECT run_id, MAX(line_no) AS n FROM lines GROUP BY 1),
hit AS (SELECT l.run_id, arg_min(line, line_no) AS line FROM lines l JOIN n ON l.run_id = n.run_id
  WHERE starts_with(line, 'Score') AND line_no > n - 5 GROUP BY 1)
SELECT n.run_id, COALESCE(TRY_CAST(regexp_extract(hit.line, '([0-9][.][0-9]{3})', 1) AS DOUBLE), -1.0) AS value
FROM n LEFT JOIN hit ON n.run_id = hit.run_id""")
def q_log_parse(t):
    from colonnade.operators.scan import blocked_scan
    status = F.col("o_orderstatus")
    score = F.format_string("Score Average : %.3f", (F.col("o_orderkey") % 1000) / 1000.0)
    text = (F.when(status == "F", score)
            .when(status == "O", F.format_string("Time per batch %d.5 s", "o_orderkey")).otherwise("progress"))
    log = blocked_scan(t.orders.select(F.col("o_custkey").alias("run_id"), "o_orderkey", text.alias("line"),
                                       F.lit(1).alias("one")),
                       ["run_id"], "o_orderkey", [("line_no", "one", "sum")], block=1 << 20)
    return gates.tail_match(log, ["run_id"], "line_no", "line", "Score", "([0-9][.][0-9]{3})", 5)


@query("q_log_files", sql="""
WITH lines AS (SELECT o_orderpriority AS run, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS line_no,
  CASE o_orderstatus WHEN 'F' THEN concat('Score Average : ', printf('%.3f', (o_orderkey % 1000) / 1000.0))
    WHEN 'O' THEN concat('Time per batch ', CAST(o_orderkey AS VARCHAR), '.5 s') ELSE 'progress' END AS line FROM orders),
n AS (SELECT run, COUNT(*) AS n_lines FROM lines GROUP BY 1)
SELECT n.run, n_lines, line_no, line FROM n JOIN lines l ON l.run = n.run WHERE line_no > n_lines - 20""")
def q_log_files(t):
    """Run logs written as text files and read in splits: the last lines of each, numbered as in the whole file."""
    status = F.col("o_orderstatus")
    score = F.format_string("Score Average : %.3f", (F.col("o_orderkey") % 1000) / 1000.0)
    text = (F.when(status == "F", score).when(status == "O", F.format_string("Time per batch %d.5 s", "o_orderkey")).otherwise("progress"))
    folder = fresh_folder(t.spark, "logs")
    logs.log_files(t.orders.select(F.col("o_orderpriority").alias("run"), "o_orderkey", text.alias("line")), "run", "o_orderkey", "line", folder)
    return logs.last_lines(t.spark, folder, 20).select("run", "n_lines", "line_no", "line")


@query("q_results_json", views=("fx_runs",), sql="""
SELECT run_id, COUNT(*) AS frames, CAST(SUM(ms) AS BIGINT) AS total_ms FROM fx_runs GROUP BY 1""")
def q_results_json(t):
    """Writes nested run records as JSON lines and reads them back."""
    runs = t.fx_runs.groupBy("run_id").agg(F.count("*").alias("frames"), F.sum("ms").alias("total_ms"))
    folder = fresh_folder(t.spark, "results-json")
    runs.select("run_id", F.struct("frames", "total_ms").alias("totals")).write.json(folder)
    back = t.spark.read.schema("run_id bigint, totals struct<frames:bigint,total_ms:bigint>").json(folder)
    return back.select("run_id", "totals.frames", "totals.total_ms")


def fresh_folder(spark, name: str) -> str:
    import uuid
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("q_quarantine", views=("fx_pixels",), sql="""
WITH f AS (SELECT frame_id, MAX(r) + 1 AS h, MAX(c) + 1 AS w, COUNT(*) AS n, COUNT(CASE WHEN d > 25 THEN 1 END) AS n_high
  FROM fx_pixels GROUP BY 1),
s AS (SELECT frame_id, CASE WHEN h <> 64 OR w <> 64 THEN 'size' WHEN n_high < 290 THEN 'no_road' ELSE 'ok' END AS verdict FROM f)
SELECT p.frame_id, s.verdict, COUNT(*) AS n_cells FROM fx_pixels p JOIN s ON p.frame_id = s.frame_id GROUP BY 1, 2""")
def q_quarantine(t):
    cells = spread(cut_lineage(t.fx_pixels), "frame_id")
    f = cells.groupBy("frame_id").agg(
        (F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"),
        F.count(F.when(F.col("d") > 25, 1)).alias("n_high"))
    verdicts = f.select("frame_id", F.when((F.col("h") != 64) | (F.col("w") != 64), "size")
                        .when(F.col("n_high") < 290, "no_road").otherwise("ok").alias("verdict"))
    good, bad = gates.split_by_verdict(cells, verdicts, ["frame_id"])
    rejected = cells.join(bad, "frame_id").groupBy("frame_id", "verdict").agg(F.count("*").alias("n_cells"))
    accepted = good.groupBy("frame_id").agg(F.count("*").alias("n_cells")).withColumn("verdict", F.lit("ok"))
    return accepted.unionByName(rejected)


@query("q_quarantine_counts", views=("fx_pixels",), sql="""
WITH f AS (SELECT frame_id, MAX(r) + 1 AS h, MAX(c) + 1 AS w, COUNT(CASE WHEN d > 25 THEN 1 END) AS n_high FROM fx_pixels GROUP BY 1),
s AS (SELECT frame_id, CASE WHEN h <> 64 OR w <> 64 THEN 'size' WHEN n_high < 290 THEN 'no_road' ELSE 'ok' END AS verdict FROM f),
n AS (SELECT verdict, COUNT(*) AS n_cells FROM fx_pixels p JOIN s ON p.frame_id = s.frame_id GROUP BY 1)
SELECT v.verdict, COALESCE(n.n_cells, 0) AS n_cells, CASE WHEN v.verdict = 'ok' THEN COALESCE(n.n_cells, 0) ELSE 0 END AS n_written
FROM (VALUES ('ok'), ('size'), ('no_road'), ('other')) v(verdict) LEFT JOIN n ON n.verdict = v.verdict""")
def q_quarantine_counts(t):
    """Good frames are written and bad ones counted in one run: the verdict of a frame stands beside its cells, a frame is at most a grid."""
    w = W.partitionBy("frame_id")
    size = (F.max("r").over(w) + 1 != 64) | (F.max("c").over(w) + 1 != 64)
    high = F.count(F.when(F.col("d") > 25, 1)).over(w)
    path = fresh_folder(t.spark, "accepted")
    counts = gates.write_accepted(t.fx_pixels, F.when(size, "size").when(high < 290, "no_road").otherwise("ok"), ["size", "no_road"], path)
    written = t.spark.read.parquet(path).agg(F.count("*").alias("n"))
    entries = F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(n).cast("bigint").alias("n_cells")) for v, n in counts.items()]))
    return written.select(entries.alias("e"), "n").select("e.*", F.when(F.col("e.verdict") == "ok", F.col("n")).otherwise(0).alias("n_written"))
