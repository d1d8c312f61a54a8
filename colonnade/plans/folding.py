"""Queries over prefix sums, segment costs, model tables and ordered windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colonnade.operators import models, packed
from colonnade.operators import segments as sg
from colonnade.operators.scan import blocked_scan, series_scan
from colonnade.plans.registry import query

MODEL = models.Model(rows=64, max_dis=51, focal=60.0, baseline=0.5)
SERIES_MODEL = models.Model(rows=31, max_dis=32, focal=60.0, baseline=0.5)
STRIP = ["frame_id", "col_id"]
SEG = [*STRIP, "seg_idx"]


def erf_sql(x: str) -> str:
    return (f"(sign({x}) * CASE WHEN abs({x}) >= 6 THEN 1.0::DOUBLE ELSE 2 / sqrt(pi()) * abs({x}) * exp(-({x}) * ({x})) * "
            "list_reduce(list_transform(range(150, 0, -1), lambda n: CAST(2 * n + 1 AS DOUBLE)), "
            f"lambda acc, k: 1.0::DOUBLE + acc * (2 * ({x}) * ({x})) / k, 1.0::DOUBLE) END)")


def object_sql(max_dis: int, focal: str = "60.0::DOUBLE", fn: str = "fn") -> str:
    """Expressions of norm and 1/(2 sigma^2) over columns sigma, x1, x2."""
    return (f"ln(0.5 * ({erf_sql('x1')} - {erf_sql('x2')})) - ln(0.85::DOUBLE / (sigma * sqrt(2 * 3.1416::DOUBLE)))")


def lut_ctes(max_dis: int) -> str:
    return f"""
lv AS (SELECT CAST(a AS INTEGER) AS fn, CAST(a AS DOUBLE) AS f FROM range({max_dis}) g(a)),
ls AS (SELECT *, sqrt(1 + (f * f * 10.2::DOUBLE / 30) * (f * f * 10.2::DOUBLE / 30)) AS sigma FROM lv),
lx AS (SELECT *, ({max_dis} - f) / (sigma * sqrt(2.0)) AS x1, -f / (sigma * sqrt(2.0)) AS x2 FROM ls),
lm AS (SELECT fn, f, {object_sql(max_dis)} AS norm, 1 / (2 * sigma * sigma) AS inv FROM lx),
lut AS (SELECT fn, CAST(d AS INTEGER) AS d, CAST(ROUND(1000000 * CASE WHEN d < 0 THEN -ln(0.33::DOUBLE)
   ELSE -ln(1 - 0.33::DOUBLE) + LEAST(ln({max_dis}) - ln(0.15::DOUBLE), norm + (d - f) * (d - f) * inv) END) AS BIGINT) AS cost
 FROM lm, range(-1, {max_dis}) g(d))"""


@query("q_prefix_sum", views=("fx_series",), sql="""
SELECT series_id, pos, v, CAST(COALESCE(SUM(v) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM fx_series""")
def q_prefix_sum(t):
    return series_scan(t.fx_series, ["series_id"], "pos", [("prefix", "v", "sum_before")])


@query("q_channel_prefix", views=("fx_class_cost",), sql="""
SELECT series_id, class_id, pos, n, CAST(COALESCE(SUM(n) OVER (PARTITION BY series_id, class_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM fx_class_cost""")
def q_channel_prefix(t):
    return series_scan(t.fx_class_cost, ["series_id", "class_id"], "pos", [("prefix", "n", "sum_before")])


@query("q_model_prefix", views=("fx_series",), sql=f"""
WITH {lut_ctes(32)}, x AS (SELECT s.series_id, s.pos, l.fn, l.cost FROM fx_series s JOIN lut l ON l.d = s.v % 32)
SELECT series_id, pos, fn, CAST(COALESCE(SUM(cost) OVER (PARTITION BY series_id, fn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM x""")
def q_model_prefix(t):
    rows = t.fx_series.select("series_id", "pos", (F.col("v") % 32).cast("int").alias("d"))
    return sg.model_prefix(rows, ["series_id"], "pos", "d", SERIES_MODEL).select("series_id", "pos", "fn", "prefix")


@query("q_candidate_segments", views=("fx_series",), sql="""
WITH p AS (SELECT series_id, pos, v, SUM(v) OVER (PARTITION BY series_id ORDER BY pos) AS s FROM fx_series)
SELECT b.series_id, b.pos AS v_t, COUNT(*) AS n_candidates, CAST(SUM(b.s - a.s + a.v) AS BIGINT) AS total,
  CAST(MIN(b.s - a.s + a.v) AS BIGINT) AS least, CAST(MAX(b.s - a.s + a.v) AS BIGINT) AS greatest
FROM p a JOIN p b ON a.series_id = b.series_id AND a.pos <= b.pos AND a.pos % 2 = 0 AND b.pos % 2 = 1 GROUP BY 1, 2""")
def q_candidate_segments(t):
    out = sg.candidate_summary(t.fx_series, ["series_id"], "pos", "v", min_height=2)
    return out.where("n_candidates > 0")


@query("q_model_cost_lookup", views=("fx_segments",), sql=f"""
WITH {lut_ctes(51)},
g AS (SELECT s.frame_id, s.col_id, s.seg_idx, v.v, p.md FROM fx_segments s JOIN range(64) v(v) ON v.v BETWEEN s.v_b AND s.v_t
  LEFT JOIN fx_strips p ON p.frame_id = s.frame_id AND p.col_id = s.col_id AND p.v = v.v),
m AS (SELECT frame_id, col_id, seg_idx, CAST(FLOOR(AVG(md)) AS INTEGER) AS fn FROM g GROUP BY 1, 2, 3)
SELECT g.frame_id, g.col_id, g.seg_idx, m.fn, CAST(SUM(l.cost) AS BIGINT) AS cost FROM g
JOIN m ON m.frame_id = g.frame_id AND m.col_id = g.col_id AND m.seg_idx = g.seg_idx
JOIN lut l ON l.fn = m.fn AND l.d = COALESCE(g.md, -1) GROUP BY 1, 2, 3, 4""")
def q_model_cost_lookup(t):
    columns = sg.strip_columns(t.fx_strips, STRIP, 64)
    return sg.model_cost(t.fx_segments, columns, STRIP, "seg_idx", "vals", MODEL)


COARSE_SQL = """
coarse AS (SELECT frame_id, col_id, CAST(FLOOR(v / 8.0) AS INTEGER) AS k, SUM(md) AS x FROM fx_strips GROUP BY 1, 2, 3)"""


def coarse_prefix(t):
    """Prefix sums of eight coarse rows per strip, with one row of padding."""
    k = F.floor(F.col("v") / 8).cast("int").alias("k")
    coarse = t.fx_strips.groupBy(*STRIP, k).agg(F.sum("md").alias("x"))
    dense = packed.pack_dense(coarse, STRIP, "k", {"x": ("x", 0)}, 9)
    return dense.select(*STRIP, packed.prefix_array(F.col("x")).alias("p"),
                        packed.prefix_array(F.transform("x", lambda a: a * a)).alias("p2"))


@query("q_downsampled_sum", views=("fx_segments",), sql=f"""
WITH {COARSE_SQL}
SELECT s.frame_id, s.col_id, s.seg_idx, CAST(SUM(COALESCE(c.x, 0)) AS BIGINT) AS total
FROM fx_segments s JOIN range(64) v(v) ON v.v BETWEEN s.v_b AND s.v_t
LEFT JOIN coarse c ON c.frame_id = s.frame_id AND c.col_id = s.col_id AND c.k = v.v // 8 GROUP BY 1, 2, 3""")
def q_downsampled_sum(t):
    total = packed.coarse_range_sum(F.col("p"), F.col("v_b"), F.col("v_t"), 8)
    return t.fx_segments.join(coarse_prefix(t), STRIP).select(*SEG, total.alias("total"))


@query("q_offset_energy", views=("fx_segments",), sql=f"""
WITH {COARSE_SQL}
SELECT s.frame_id, s.col_id, s.seg_idx, CAST(SUM(COALESCE(c.x * c.x, 0)) AS BIGINT) AS energy
FROM fx_segments s JOIN range(64) v(v) ON v.v BETWEEN s.v_b AND s.v_t
LEFT JOIN coarse c ON c.frame_id = s.frame_id AND c.col_id = s.col_id AND c.k = v.v // 8 GROUP BY 1, 2, 3""")
def q_offset_energy(t):
    energy = packed.coarse_range_sum(F.col("p2"), F.col("v_b"), F.col("v_t"), 8)
    return t.fx_segments.join(coarse_prefix(t), STRIP).select(*SEG, energy.alias("energy"))


@query("q_segment_mean", views=("fx_segments",), sql="""
SELECT s.frame_id, s.col_id, s.seg_idx, ROUND(COALESCE(AVG(p.md), 0.0), 6) AS mean, COUNT(p.md) AS n_valid
FROM fx_segments s LEFT JOIN fx_strips p ON p.frame_id = s.frame_id AND p.col_id = s.col_id AND p.v BETWEEN s.v_b AND s.v_t GROUP BY 1, 2, 3""")
def q_segment_mean(t):
    cols = sg.strip_columns(t.fx_strips, STRIP, 64)
    known = F.transform("vals", lambda x: F.when(x.isNotNull(), 1).otherwise(0).cast("bigint"))
    cols = cols.select(*STRIP, packed.prefix_array(F.transform("vals", lambda x: F.coalesce(x, F.lit(0)))).alias("ps"),
                       packed.prefix_array(known).alias("pn"))
    ends = (F.col("v_b"), F.col("v_t"))
    mean = packed.segment_mean(F.col("ps"), F.col("pn"), *ends)
    return t.fx_segments.join(cols, STRIP).select(
        *SEG, F.round(mean, 6).alias("mean"), packed.range_sum(F.col("pn"), *ends).alias("n_valid"))


@query("q_segment_scatter", views=("fx_segments",), sql="""
WITH g AS (SELECT s.frame_id, s.col_id, s.seg_idx, CAST(TRUNC(8 * s.col_id + 3.5 + COALESCE(p.sc % 7, 0) + 0.5) AS BIGINT) AS x,
  CAST(v.v - COALESCE(p.md % 5, 0) AS BIGINT) AS y
  FROM fx_segments s JOIN range(64) v(v) ON v.v BETWEEN s.v_b AND s.v_t
  LEFT JOIN fx_strips p ON p.frame_id = s.frame_id AND p.col_id = s.col_id AND p.v = v.v)
SELECT frame_id, col_id, seg_idx, ROUND(CAST(SUM(x * x) AS DOUBLE) - CAST(SUM(x) * SUM(x) AS DOUBLE) / COUNT(*)
  + (CAST(SUM(y * y) AS DOUBLE) - CAST(SUM(y) * SUM(y) AS DOUBLE) / COUNT(*)), 4) AS scatter FROM g GROUP BY 1, 2, 3""")
def q_segment_scatter(t):
    """Votes of a cell: its centre column plus the x offset, its row minus the y offset."""
    rows = t.fx_strips.withColumn("off_x", F.col("sc") % 7).withColumn("off_y", F.col("md") % 5)
    dense = packed.pack_dense(rows, STRIP, "v", {"ox": ("off_x", 0), "oy": ("off_y", 0)}, 64)
    xs = F.transform("ox", lambda o: F.expr("8 * col_id + 3.5D").__add__(o + 0.5).cast("bigint"))
    ys = F.transform("oy", lambda o, i: i - o)
    arrays = dense.select(*STRIP, xs.alias("x"), ys.alias("y"))
    square = lambda a: a * a
    arrays = arrays.select(*STRIP, *[packed.prefix_array(c).alias(n) for n, c in (
        ("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.transform("x", square)), ("syy", F.transform("y", square)))])
    scatter = packed.segment_scatter(*[F.col(c) for c in ("sx", "sy", "sxx", "syy", "v_b", "v_t")])
    return t.fx_segments.join(arrays, STRIP).select(*SEG, F.round(scatter, 4).alias("scatter"))


ROLES = {"ground": [1, 2], "object": [3, 5, 6, 7], "sky": 4}


@query("q_segment_best_class", views=("fx_segments", "fx_masks"), sql="""
WITH n AS (SELECT frame_id, CAST(FLOOR(c / 8.0) AS INTEGER) AS col_id, CAST(FLOOR((63 - r) / 8.0) AS INTEGER) AS k, gt, COUNT(*) AS n FROM fx_masks GROUP BY 1, 2, 3, 4),
s AS (SELECT s.frame_id, s.col_id, s.seg_idx, s.v_t - s.v_b + 1 AS h, cls, SUM(64 - COALESCE(n.n, 0)) AS cost
  FROM fx_segments s JOIN range(64) v(v) ON v.v BETWEEN s.v_b AND s.v_t CROSS JOIN range(1, 8) c(cls)
  LEFT JOIN n ON n.frame_id = s.frame_id AND n.col_id = s.col_id AND n.k = v.v // 8 AND n.gt = cls GROUP BY 1, 2, 3, 4, 5),
w AS (SELECT frame_id, col_id, seg_idx,
  MAX(CASE WHEN cls = 1 THEN cost END) AS c1, MAX(CASE WHEN cls = 2 THEN cost END) AS c2, MAX(CASE WHEN cls = 4 THEN cost END) AS c4,
  arg_min(cls, CASE WHEN cls IN (3, 5) THEN (cost + 2 * h) * 100 + cls WHEN cls IN (6, 7) THEN (cost + h) * 100 + cls END) AS o,
  MIN(CASE WHEN cls IN (3, 5) THEN cost + 2 * h WHEN cls IN (6, 7) THEN cost + h END) AS oc FROM s GROUP BY 1, 2, 3)
SELECT frame_id, col_id, seg_idx, CAST(CASE WHEN c1 < c2 THEN 1 ELSE 2 END AS INTEGER) AS ground_class, CAST(LEAST(c1, c2) AS DOUBLE) AS ground_cost,
  CAST(o AS INTEGER) AS object_class, CAST(oc AS DOUBLE) AS object_cost, CAST(c4 AS DOUBLE) AS sky_cost FROM w""")
def q_segment_best_class(t):
    """Cheapest class per geometric type; instance classes (6, 7) pay the instance term,
    the others the offset term."""
    keys = [F.floor(F.col("c") / 8).cast("int").alias("col_id"), F.floor((63 - F.col("r")) / 8).cast("int").alias("k")]
    per = [F.count(F.when(F.col("gt") == c, 1)).alias(f"n{c}") for c in range(1, 8)]
    counts = t.fx_masks.groupBy("frame_id", *keys).agg(*per)
    dense = packed.pack_dense(counts, STRIP, "k", {f"n{c}": (f"n{c}", 0) for c in range(1, 8)}, 9)
    prefix = dense.select(*STRIP, *[packed.prefix_array(F.transform(f"n{c}", lambda n: 64 - n)).alias(f"p{c}") for c in range(1, 8)])
    # a strip without mask cells still has segments: all its classes cost the same
    j = t.fx_segments.join(prefix, STRIP, "left")
    h = F.col("v_t") - F.col("v_b") + 1
    sums = {c: F.coalesce(packed.coarse_range_sum(F.col(f"p{c}"), F.col("v_b"), F.col("v_t"), 8), h * 64) for c in range(1, 8)}
    best = packed.best_class(sums, ROLES["object"], {3: 2 * h, 5: 2 * h, 6: h, 7: h})
    g1, g2 = sums[1], sums[2]
    return j.select(
        *SEG, F.when(g1 < g2, 1).otherwise(2).alias("ground_class"), F.least(g1, g2).cast("double").alias("ground_cost"),
        best["cls"].alias("object_class"), best["cost"].alias("object_cost"), sums[4].cast("double").alias("sky_cost"))


# ground plane of a frame: horizon and slope follow from the frame id
PLANE_SQL = "pl AS (SELECT DISTINCT frame_id, CAST(40 + frame_id % 8 AS INTEGER) AS vhor, 48.0::DOUBLE / (40 + frame_id % 8) AS alpha FROM fx_pixels)"
GROUND_SQL = PLANE_SQL + f""",
gm0 AS (SELECT frame_id, vhor, CAST(v AS INTEGER) AS v, alpha * (vhor - v) AS fn, 25.0::DOUBLE AS fb, (vhor - v) / 60.0::DOUBLE AS x FROM pl, range(64) g(v)),
gm1 AS (SELECT *, 4 + fb * fb * (0.05::DOUBLE * 0.05 * x * x / (1.2::DOUBLE * 1.2) + (0.05::DOUBLE * 3.1416 / 180) * (0.05::DOUBLE * 3.1416 / 180)) AS var FROM gm0),
gm2 AS (SELECT *, sqrt(var) AS sigma, (51 - fn) / (sqrt(var) * sqrt(2.0)) AS x1, -fn / (sqrt(var) * sqrt(2.0)) AS x2 FROM gm1),
gm AS (SELECT frame_id, vhor, v, fn, {object_sql(51)} AS norm, 1 / (2 * var) AS inv FROM gm2)"""


def plane(t):
    vhor = (40 + F.col("frame_id") % 8).cast("int")
    return t.fx_pixels.select("frame_id").distinct().select(
        "frame_id", vhor.alias("vhor"), (48.0 / (40 + F.col("frame_id") % 8)).alias("alpha"))


def ground_rows(t):
    rows = plane(t).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(63))))
    rows = rows.withColumn("fn", models.ground_line(F.col("alpha"), F.col("vhor"), F.col("v")))
    return models.with_ground_model(rows, MODEL).select("frame_id", "vhor", "v", "fn", "norm", "inv")


@query("q_ground_model", views=("fx_pixels",), sql=f"""
WITH {GROUND_SQL} SELECT frame_id, v, ROUND(fn, 6) AS fn, CASE WHEN v < vhor THEN ROUND(norm, 6) END AS norm, ROUND(inv, 8) AS inv FROM gm""")
def q_ground_model(t):
    return ground_rows(t).select("frame_id", "v", F.round("fn", 6).alias("fn"), F.round("norm", 6).alias("norm"), F.round("inv", 8).alias("inv"))


@query("q_object_model", views=("fx_pixels",), sql=f"""
WITH lv AS (SELECT DISTINCT frame_id, d, CAST(d AS DOUBLE) AS f, (60.0::DOUBLE + frame_id % 5) * 0.5 AS fb FROM fx_pixels),
ls AS (SELECT *, sqrt(1 + (f * f * 10.2::DOUBLE / fb) * (f * f * 10.2::DOUBLE / fb)) AS sigma FROM lv),
lx AS (SELECT *, (51 - f) / (sigma * sqrt(2.0)) AS x1, -f / (sigma * sqrt(2.0)) AS x2 FROM ls)
SELECT frame_id, d, ROUND({object_sql(51)}, 6) AS norm, ROUND(1 / (2 * sigma * sigma), 8) AS inv, ROUND(f - fb / (fb / f + 10.2::DOUBLE), 6) AS range_ FROM lx""")
def q_object_model(t):
    """Object model of every value level a frame has, with the camera of the frame."""
    m = models.Model(rows=64, max_dis=51, focal=60.0 + F.col("frame_id") % 5, baseline=0.5)
    levels = t.fx_pixels.select("frame_id", "d").distinct().withColumn("fn", F.col("d").cast("double"))
    return models.with_object_model(levels, m).select(
        "frame_id", "d", F.round("norm", 6).alias("norm"), F.round("inv", 8).alias("inv"),
        F.round(models.object_range(m, F.col("fn")), 6).alias("range_"))


SKY_SQL = "-ln(1 - 0.21::DOUBLE) + LEAST(ln(51) - ln(0.4::DOUBLE), ln(0.5::DOUBLE) - ln(0.6::DOUBLE / (0.1::DOUBLE * sqrt(2 * 3.1416::DOUBLE))) + d * d * 50.0::DOUBLE)"


@query("q_sky_model", views=("fx_pixels",), sql=f"""
SELECT DISTINCT frame_id, d, ROUND({SKY_SQL}, 6) AS cost FROM fx_pixels""")
def q_sky_model(t):
    cost = models.sky_cost(MODEL, F.col("d").cast("double"), F.lit(1), F.lit(0))
    return t.fx_pixels.select("frame_id", "d").distinct().select("frame_id", "d", F.round(cost, 6).alias("cost"))


@query("q_data_cost", views=("fx_strips",), sql=f"""
WITH {GROUND_SQL},
k AS (SELECT DISTINCT frame_id, col_id FROM fx_strips),
c AS (SELECT k.frame_id, k.col_id, gm.v, CASE WHEN gm.v < vhor THEN CAST(ROUND(1000000 * CASE WHEN md IS NULL THEN -ln(0.21::DOUBLE)
    ELSE -ln(1 - 0.21::DOUBLE) + LEAST(ln(51) - ln(0.15::DOUBLE), norm + (md - fn) * (md - fn) * inv) END) AS BIGINT) END AS ground_cost,
  CAST(ROUND(1000000 * CASE WHEN gm.v < vhor THEN 0 WHEN md IS NULL THEN -ln(0.21::DOUBLE) ELSE {SKY_SQL.replace('d * d', 'md * md')} END) AS BIGINT) AS sky_cost
  FROM k JOIN gm ON gm.frame_id = k.frame_id LEFT JOIN fx_strips s ON s.frame_id = k.frame_id AND s.col_id = k.col_id AND s.v = gm.v)
SELECT *, CAST(COALESCE(SUM(ground_cost) OVER w, 0) AS BIGINT) AS ground_prefix, CAST(COALESCE(SUM(sky_cost) OVER w, 0) AS BIGINT) AS sky_prefix
FROM c WINDOW w AS (PARTITION BY frame_id, col_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q_data_cost(t):
    cells = data_cost_cells(t)
    return series_scan(cells, STRIP, "v", [("ground_prefix", "ground_cost", "sum_before"), ("sky_prefix", "sky_cost", "sum_before")])


def data_cost_cells(t):
    dense = sg.strip_columns(t.fx_strips, STRIP, 64).select(*STRIP, F.posexplode("vals").alias("v", "md"))
    j = dense.join(ground_rows(t), ["frame_id", "v"])
    d = F.col("md").cast("double")
    ground = models.ground_cost(MODEL, F.col("norm"), F.col("inv"), F.col("fn"), d, F.col("v"), F.col("vhor"))
    sky = models.sky_cost(MODEL, d, F.col("v"), F.col("vhor"))
    return j.select(*STRIP, "v", models.micro(ground).alias("ground_cost"), models.micro(sky).alias("sky_cost"))


@query("q_transition_prior", views=("fx_segments", "fx_pixels"), sql=f"""
WITH {PLANE_SQL},
l AS (SELECT s.frame_id, col_id, seg_idx, type, v_b, v_t, disparity AS fn, LAG(type) OVER w AS frm, CAST(LAG(disparity) OVER w AS DOUBLE) AS m, vhor, alpha * (vhor - (v_b - 1)) AS g
  FROM fx_segments s JOIN pl ON pl.frame_id = s.frame_id WINDOW w AS (PARTITION BY s.frame_id, col_id ORDER BY v_b)),
p AS (SELECT *, ln(64.0 - v_b) AS u, v_b - 1 < vhor AS below, GREATEST(g, 0.0) AS gp, GREATEST(m - 30 / (30 / m + 10.2::DOUBLE), 0.0) AS r FROM l)
SELECT frame_id, col_id, seg_idx, ROUND(CASE
  WHEN frm IS NULL AND type = 0 THEN CASE WHEN v_t <= vhor THEN ln(2) + ln(64) END
  WHEN frm IS NULL AND type = 1 THEN ln(64) + CASE WHEN v_t <= vhor THEN ln(2) ELSE 0 END + ln(51)
  WHEN frm IS NULL THEN NULL
  WHEN type = 0 AND frm <> 2 THEN CASE WHEN below THEN -ln(0.3) + u END
  WHEN type = 2 AND frm = 0 THEN CASE WHEN NOT below AND g < 1 THEN u END
  WHEN type = 2 AND frm = 1 THEN CASE WHEN NOT below AND m >= 3 THEN ln(2) + u END
  WHEN type = 1 AND frm = 0 THEN -ln(0.7) + u + CASE WHEN fn > gp + 3 THEN -ln(0.1) + ln(51 - gp - 3) WHEN fn < gp - 3 THEN -ln(0.04) + ln(gp - 3) ELSE -ln(0.86) + ln(6) END
  WHEN type = 1 AND frm = 1 THEN CASE WHEN fn > m + r THEN CASE WHEN below THEN -ln(0.7) ELSE ln(2) END + u - ln(0.2) + ln(51 - m - r)
     WHEN fn < m - r THEN CASE WHEN below THEN -ln(0.7) ELSE ln(2) END + u - ln(0.8) + ln(m - r) END
  WHEN type = 1 AND frm = 2 THEN CASE WHEN fn > 3 THEN ln(48) + u END END, 6) AS prior FROM p""")
def q_transition_prior(t):
    """Prior cost of every segment given the one below it (a column holds at most 64)."""
    w = W.partitionBy(*STRIP).orderBy("v_b")
    s = t.fx_segments.select("*", F.lag("type").over(w).alias("frm"), F.lag("disparity").over(w).cast("double").alias("below_mean"))
    s = s.join(plane(t), "frame_id")
    mean, v_b = F.col("below_mean"), F.col("v_b")
    ground = models.ground_line(F.col("alpha"), F.col("vhor"), v_b - 1)
    later = models.transition_cost(MODEL, F.col("type"), F.col("frm"), v_b, F.col("vhor"), F.col("disparity").cast("double"),
                                   mean, models.object_range(MODEL, F.floor(mean).cast("double")), ground)
    first = models.first_cost(MODEL, F.col("type"), F.col("v_t"), F.col("vhor"))
    return s.select(*SEG, F.round(F.when(F.col("frm").isNull(), first).otherwise(later), 6).alias("prior"))


@query("q_running_best", views=("fx_runs",), sql="""
WITH r AS (SELECT run_id, CAST(SUM(ms) AS BIGINT) AS score FROM fx_runs GROUP BY 1),
b AS (SELECT *, MAX(score) OVER (ORDER BY run_id) AS best FROM r),
f AS (SELECT score, MIN(run_id) AS first_at FROM r GROUP BY 1)
SELECT b.run_id, b.score, b.best, f.first_at AS best_at FROM b JOIN f ON f.score = b.best""")
def q_running_best(t):
    runs = t.fx_runs.groupBy("run_id").agg(F.sum("ms").alias("score"))
    return sg.running_best(runs, "run_id", "score", block=1 << 20)


@query("q_residual_filter", views=("fx_segments",), sql="""
WITH p AS (SELECT *, AVG(mean_x) OVER w AS mx, AVG(mean_y) OVER w AS my FROM fx_segments WHERE class_id >= 11 AND inst >= 0 WINDOW w AS (PARTITION BY frame_id, class_id, inst))
SELECT frame_id, col_id, seg_idx, class_id, inst, ROUND(sqrt((mean_x - mx) * (mean_x - mx) + (mean_y - my) * (mean_y - my)), 6) AS residual
FROM p WHERE sqrt((mean_x - mx) * (mean_x - mx) + (mean_y - my) * (mean_y - my)) < 12.0""")
def q_residual_filter(t):
    pts = t.fx_segments.where("class_id >= 11 AND inst >= 0").select(*SEG, "class_id", "inst", "mean_x", "mean_y")
    out = sg.residual_filter(pts, ["frame_id", "class_id", "inst"], ["mean_x", "mean_y"], 12.0)
    return out.select(*SEG, "class_id", "inst", F.round("residual", 6).alias("residual"))


@query("q_closest_segment", views=("fx_segments",), sql="""
WITH p AS (SELECT frame_id, class_id, inst, col_id, seg_idx, 30.0::DOUBLE / disparity AS z, mean_x, 63 - mean_y AS y FROM fx_segments WHERE class_id >= 11 AND inst >= 0),
d AS (SELECT *, z * z + (z / 60 * (mean_x - 32)) * (z / 60 * (mean_x - 32)) + (z / 60 * (y - 32)) * (z / 60 * (y - 32)) AS dist FROM p)
SELECT frame_id, class_id, inst, col_id, seg_idx, ROUND(z, 6) AS z FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY frame_id, class_id, inst, col_id ORDER BY dist, seg_idx) AS k FROM d) WHERE k = 1""")
def q_closest_segment(t):
    return closest(t).select("frame_id", "class_id", "inst", "col_id", "seg_idx", F.round("z", 6).alias("z"))


def closest(t):
    z = 30.0 / F.col("disparity")
    pts = t.fx_segments.where("class_id >= 11 AND inst >= 0").select(
        "frame_id", "class_id", "inst", "col_id", "seg_idx", z.alias("z"), "mean_x", (63 - F.col("mean_y")).alias("y"))
    side_x, side_y = F.col("z") / 60 * (F.col("mean_x") - 32), F.col("z") / 60 * (F.col("y") - 32)
    dist = F.col("z") * F.col("z") + side_x * side_x + side_y * side_y
    return sg.closest_per_column(pts, ["frame_id", "class_id", "inst", "col_id"], dist, "seg_idx")


@query("q_second_difference", views=("fx_segments",), sql="""
WITH p AS (SELECT frame_id, class_id, inst, col_id, MAX(disparity) AS x, MAX(mean_y) AS y FROM fx_segments WHERE class_id >= 11 AND inst >= 0 GROUP BY 1, 2, 3, 4),
d AS (SELECT *, COALESCE(LAG(x) OVER w, x) - 2 * x + COALESCE(LEAD(x) OVER w, x) AS dx, COALESCE(LAG(y) OVER w, y) - 2 * y + COALESCE(LEAD(y) OVER w, y) AS dy
  FROM p WINDOW w AS (PARTITION BY frame_id, class_id, inst ORDER BY col_id))
SELECT frame_id, class_id, inst, col_id, CAST(dx AS BIGINT) AS dd_x, CAST(dy AS BIGINT) AS dd_y, sqrt(dx * dx + dy * dy) < 2.0 AS inlier FROM d""")
def q_second_difference(t):
    keys = ["frame_id", "class_id", "inst"]
    pts = (t.fx_segments.where("class_id >= 11 AND inst >= 0").groupBy(*keys, "col_id")
           .agg(F.max("disparity").alias("x"), F.max("mean_y").alias("y")))
    out = sg.second_difference(pts, keys, "col_id", ["x", "y"], 2.0)
    return out.select(*keys, "col_id", "dd_x", "dd_y", "inlier")


@query("q_change_sessions", sql="""
WITH c AS (SELECT conv_id, turn, role, length(text) > 200 AS long_, LAG(role) OVER w AS pr, LAG(length(text) > 200) OVER w AS pl FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
f AS (SELECT *, CASE WHEN pr IS NOT NULL AND long_ <> pl THEN 1 ELSE 0 END AS changed FROM c)
SELECT conv_id, turn, changed, CAST(SUM(changed) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS session FROM f""")
def q_change_sessions(t):
    """A new session starts where the size class of a turn differs from the one before."""
    rows = t.conversations.select("conv_id", "turn", (F.length("text") > 200).alias("long"))
    return sg.change_sessions(rows, ["conv_id"], "turn", F.col("long"), block=1 << 20).select("conv_id", "turn", "changed", "session")
