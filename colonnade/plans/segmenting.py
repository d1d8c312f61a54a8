"""Queries over the optimal segmentation of daily series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from colonnade.operators import models, packed
from colonnade.operators.segmentation import Roles, Task, Weights, segment_columns
from colonnade.plans.folding import erf_sql, lut_ctes, object_sql
from colonnade.plans.registry import query

ROWS, LEVELS, FACTOR, COARSE = 31, 32, 4, 8
MODEL = models.Model(rows=ROWS, max_dis=LEVELS, focal=60.0, baseline=0.5)
ROLES = Roles(ground=(0, 1), plain=(2,), instance=(3,), sky=4)


@dataclass(frozen=True)
class Scale:
    """Greatest value of a series and greatest count of a class in a coarse row: what levels and costs are measured by."""

    value: int
    count: int


def class_counts(t):
    k = F.floor(F.col("pos") / FACTOR).cast("int").alias("k")
    per = [F.coalesce(F.sum(F.when(F.col("class_id") == c, F.col("n"))), F.lit(0)).alias(f"n{c}") for c in range(5)]
    return t.fx_class_cost.groupBy("series_id", k).agg(*per)


def scale_of(t) -> Scale:
    most = class_counts(t).agg(F.max(F.greatest(*[f"n{c}" for c in range(5)])).alias("n")).first()["n"]
    return Scale(t.fx_series.agg(F.max("v").alias("v")).first()["v"] or 0, most or 0)


def columns(t, scale: Scale):
    """Packs every user's month: values, votes, model costs and class costs per row."""
    level = F.expr(f"v * {LEVELS} div {scale.value + 1}").alias("d")
    d = packed.pack_dense(t.fx_series.select("series_id", "pos", level), ["series_id"], "pos", {"d": ("d", None)}, ROWS)
    counts = class_counts(t)
    ox, oy = (F.col("n0") + F.col("n3")) % 5 - 2, F.col("n2") % 3
    counts = counts.withColumn("ox", ox).withColumn("oy", oy)
    fields = {f"n{c}": (f"n{c}", 0) for c in range(5)} | {"ox": ("ox", -2), "oy": ("oy", 0)}
    coarse = packed.pack_dense(counts, ["series_id"], "k", fields, COARSE)
    # per row: ground value, model and data costs; rows stay where their series was packed
    rows = d.select("series_id", (16 + F.col("series_id") % 5).cast("bigint").alias("vhor"), F.posexplode("d").alias("v", "d"))
    rows = rows.withColumn("fn", models.ground_line(30.0 / F.col("vhor"), F.col("vhor"), F.col("v")))
    rows = models.with_ground_model(rows, MODEL)
    seen = F.col("d").cast("double")
    ground = models.ground_cost(MODEL, F.col("norm"), F.col("inv"), F.col("fn"), seen, F.col("v"), F.col("vhor"))
    sky = models.sky_cost(MODEL, seen, F.col("v"), F.col("vhor"))
    rows = rows.select("series_id", "vhor", F.struct(
        "v", F.coalesce("d", F.lit(-1)).alias("d"), "fn",
        F.coalesce(models.micro(ground), F.lit(models.IMPOSSIBLE)).alias("g"), models.micro(sky).alias("s")).alias("r"))
    fine = rows.groupBy("series_id").agg(F.first("vhor").alias("vhor"), F.sort_array(F.collect_list("r")).alias("r"))
    j = fine.join(coarse, "series_id")
    index = F.sequence(F.lit(0), F.lit(ROWS - 1))

    def coarse_of(name, i):
        return F.element_at(name, F.floor(i / FACTOR).cast("int") + 1)

    cost = [F.transform(f"n{c}", lambda n: 8 * (scale.count - n)) for c in range(5)]
    return j.select(
        "series_id", "vhor", F.col("r.d").alias("d"), F.col("r.fn").alias("ground_fn"), F.col("r.g").alias("ground_cost"),
        F.col("r.s").alias("sky_cost"),
        F.transform(index, lambda i: F.col("series_id") * 8 + 4 + coarse_of("ox", i)).alias("x"),
        F.transform(index, lambda i: i - coarse_of("oy", i)).alias("y"),
        F.zip_with("ox", "oy", lambda a, b: a * a + b * b).alias("offset_energy"),
        F.concat(*cost).alias("class_cost"))


def segments(t, pairwise: bool, w_disp: float = 4.0, w_seg: float = 0.02, scale: Scale | None = None, jumps: bool = False):
    """Segments of every series; ``scale`` is that of the data unless it is given."""
    weights = Weights(w_disp, 1.0 if pairwise else 10.0, w_seg, 0.001)
    task = Task(MODEL, weights, ROLES, FACTOR, pairwise)
    return segment_columns(columns(t, scale or scale_of(t)), ["series_id"], task, jumps)


def candidate_sql(w_disp: int = 4, w_seg: str = "0.02") -> str:
    """Costs of every segment of every series, listed per top row."""
    def over(col, name):
        return f"CAST(SUM({col}) OVER (PARTITION BY series_id ORDER BY v) AS BIGINT) AS {name}"

    sums = {"gp": "gcost", "sp": "scost", "vs": "COALESCE(d, 0)", "vn": "CASE WHEN d IS NULL THEN 0 ELSE 1 END",
            "px": "x", "py": "y", "pxx": "x * x", "pyy": "y * y", "pe": "ox * ox + oy * oy",
            **{f"pc{c}": f"c{c}" for c in range(5)}}
    return f"""{lut_ctes(LEVELS)},
sr AS (SELECT DISTINCT series_id, CAST(16 + series_id % 5 AS INTEGER) AS vhor, 30.0::DOUBLE / (16 + series_id % 5) AS alpha FROM fx_series),
hz AS (SELECT DISTINCT vhor, alpha FROM sr),
g0 AS (SELECT vhor, CAST(v AS INTEGER) AS v, alpha * (vhor - v) AS fn, 25.0::DOUBLE AS fb, (vhor - v) / 60.0::DOUBLE AS x FROM hz, range({ROWS}) g(v)),
g1 AS (SELECT *, 4 + fb * fb * (0.05::DOUBLE * 0.05 * x * x / (1.2::DOUBLE * 1.2) + (0.05::DOUBLE * 3.1416 / 180) * (0.05::DOUBLE * 3.1416 / 180)) AS var FROM g0),
g2 AS (SELECT *, sqrt(var) AS sigma, ({LEVELS} - fn) / (sqrt(var) * sqrt(2.0)) AS x1, -fn / (sqrt(var) * sqrt(2.0)) AS x2 FROM g1),
gm AS (SELECT vhor, v, fn, {object_sql(LEVELS)} AS norm, 1 / (2 * var) AS inv FROM g2),
cc AS (SELECT series_id, pos // 4 AS k, class_id, SUM(n) AS n FROM fx_class_cost GROUP BY 1, 2, 3),
co AS (SELECT sr.series_id, k.k, {', '.join(f"CAST(COALESCE(SUM(CASE WHEN class_id = {c} THEN n END), 0) AS BIGINT) AS n{c}" for c in range(5))}
  FROM sr CROSS JOIN range(8) k(k) LEFT JOIN cc ON cc.series_id = sr.series_id AND cc.k = k.k GROUP BY 1, 2),
mx AS (SELECT (SELECT MAX(v) FROM fx_series) AS most_v, (SELECT CAST(MAX(n) AS BIGINT) FROM cc) AS most_n),
ce AS (SELECT sr.series_id, sr.vhor, gm.v, f.v * {LEVELS} // (mx.most_v + 1) AS d, gm.fn, gm.norm, gm.inv,
  (n0 + n3) % 5 - 2 AS ox, n2 % 3 AS oy, {', '.join(f"8 * (mx.most_n - n{c}) AS c{c}" for c in range(5))}
  FROM mx CROSS JOIN sr JOIN gm ON gm.vhor = sr.vhor JOIN co ON co.series_id = sr.series_id AND co.k = gm.v // 4
  LEFT JOIN fx_series f ON f.series_id = sr.series_id AND f.pos = gm.v),
cx AS (SELECT *, series_id * 8 + 4 + ox AS x, v - oy AS y,
  CASE WHEN v >= vhor THEN 1000000000000000 ELSE CAST(ROUND(1000000 * CASE WHEN d IS NULL THEN -ln(0.21::DOUBLE) ELSE -ln(1 - 0.21::DOUBLE) + LEAST(ln({LEVELS}) - ln(0.15::DOUBLE), norm + (d - fn) * (d - fn) * inv) END) AS BIGINT) END AS gcost,
  CAST(ROUND(1000000 * CASE WHEN v < vhor THEN 0 WHEN d IS NULL THEN -ln(0.21::DOUBLE) ELSE -ln(1 - 0.21::DOUBLE) + LEAST(ln({LEVELS}) - ln(0.4::DOUBLE), ln(0.5::DOUBLE) - ln(0.6::DOUBLE / (0.1::DOUBLE * sqrt(2 * 3.1416::DOUBLE))) + d * d * 50.0::DOUBLE) END) AS BIGINT) AS scost FROM ce),
pf AS (SELECT *, {', '.join(over(c, n) for n, c in sums.items())} FROM cx),
po AS (SELECT pf.series_id, pf.v, lut.fn, CAST(SUM(lut.cost) OVER (PARTITION BY pf.series_id, lut.fn ORDER BY pf.v) AS BIGINT) AS p FROM pf JOIN lut ON lut.d = COALESCE(pf.d, -1)),
pr AS (SELECT a.series_id, a.vhor, a.v AS vb, b.v AS vt, a.fn AS gfn, b.v - a.v + 1 AS h,
  b.gp - a.gp + a.gcost AS gd, b.sp - a.sp + a.scost AS sd, b.vs - a.vs + COALESCE(a.d, 0) AS vs, b.vn - a.vn + CASE WHEN a.d IS NULL THEN 0 ELSE 1 END AS vn,
  b.px - a.px + a.x AS x, b.py - a.py + a.y AS y, b.pxx - a.pxx + a.x * a.x AS xx, b.pyy - a.pyy + a.y * a.y AS yy,
  b.pe - a.pe + a.ox * a.ox + a.oy * a.oy AS e, {', '.join(f"b.pc{c} - a.pc{c} + a.c{c} AS c{c}" for c in range(5))}
  FROM pf a JOIN pf b ON a.series_id = b.series_id AND a.v <= b.v),
p2 AS (SELECT *, CASE WHEN vn > 0 THEN vs / vn ELSE 0.0::DOUBLE END AS mean, CASE WHEN vn > 0 THEN vs // vn ELSE 0 END AS fn,
  CAST(ROUND(1000000 * (0.001::DOUBLE / {w_seg}::DOUBLE) * e) AS BIGINT) AS still,
  CAST(ROUND(1000000 * ((0.001::DOUBLE / {w_seg}::DOUBLE) * ((xx - CAST(x * x AS DOUBLE) / h) + (yy - CAST(y * y AS DOUBLE) / h)))) AS BIGINT) AS moving FROM pr),
ca AS (SELECT p2.*, c2 * 1000000 + still <= c3 * 1000000 + moving AS plain,
  {w_disp} * gd + CAST(ROUND({w_seg}::DOUBLE * (LEAST(c0, c1) * 1000000 + still)) AS BIGINT) AS g,
  {w_disp} * (e.p - s.p + l.cost) + CAST(ROUND({w_seg}::DOUBLE * LEAST(c2 * 1000000 + still, c3 * 1000000 + moving)) AS BIGINT) AS o,
  {w_disp} * sd + CAST(ROUND({w_seg}::DOUBLE * (c4 * 1000000 + still)) AS BIGINT) AS s
  FROM p2 JOIN po e ON e.series_id = p2.series_id AND e.v = p2.vt AND e.fn = p2.fn
  JOIN po s ON s.series_id = p2.series_id AND s.v = p2.vb AND s.fn = p2.fn
  JOIN (SELECT series_id AS bs, v AS bv, COALESCE(d, -1) AS bd FROM cx) b ON b.bs = p2.series_id AND b.bv = p2.vb JOIN lut l ON l.fn = p2.fn AND l.d = b.bd),
cg AS (SELECT c.*, COALESCE(k.fn, 0.0) AS below_ground FROM ca c LEFT JOIN pf k ON k.series_id = c.series_id AND k.v = c.vb - 1),
cl AS (SELECT series_id, vhor, vt, list({{'vb': vb, 'mean': mean, 'gf': below_ground, 'g': g, 'o': o, 's': s}} ORDER BY vb) AS c FROM cg GROUP BY 1, 2, 3)"""


INF = 10**15


def recursion_sql(pairwise: bool) -> str:
    """The recurrence over top rows with the tables kept as lists."""
    def m(x):
        return f"CAST(ROUND(1000000 * ({x})) AS BIGINT)"

    u = f"ln({ROWS}.0::DOUBLE - q.vb)"
    cg, co_, cs, mo = "CG[q.vb]", "CO[q.vb]", "CS[q.vb]", "MO[q.vb]"
    gp = "GREATEST(q.gf, 0.0)"
    rng = f"(CASE WHEN floor({mo}) = 0 THEN 0.0 ELSE GREATEST(floor({mo}) - 30 / (30 / floor({mo}) + 10.2::DOUBLE), 0.0) END)"
    fg = (f"-ln(0.7) + {u} + CASE WHEN q.mean > {gp} + 3 THEN -ln(0.1) + ln({LEVELS} - {gp} - 3) WHEN q.mean < {gp} - 3 THEN -ln(0.04) + ln({gp} - 3) "
          "ELSE -ln(1.0::DOUBLE - 0.1::DOUBLE - 0.04::DOUBLE) + ln(6) END")
    fo = (f"CASE WHEN q.mean > {mo} + {rng} THEN {m(f'CASE WHEN q.vb - 1 < vhor THEN -ln(0.7) ELSE ln(2) END + {u} - ln(0.2) + ln({LEVELS} - {mo} - {rng})')} "
          f"WHEN q.mean < {mo} - {rng} THEN {m(f'CASE WHEN q.vb - 1 < vhor THEN -ln(0.7) ELSE ln(2) END + {u} - ln(0.8) + ln({mo} - {rng})')} ELSE {INF} END")
    if pairwise:
        via = {"gg": f"{cg} + {m(f'-ln(0.3) + {u}')}", "go": f"{co_} + {m(f'-ln(0.3) + {u}')}",
               "sg": f"{cg} + CASE WHEN q.gf < 1 THEN {m(u)} ELSE {INF} END", "so": f"{co_} + CASE WHEN {mo} < 3 THEN {INF} ELSE {m(f'ln(2) + {u}')} END",
               "og": f"{cg} + {m(fg)}", "oo": f"{co_} + {fo}", "os": f"{cs} + CASE WHEN q.mean > 3 THEN {m(f'ln({LEVELS - 3}) + {u}')} ELSE {INF} END"}
        first_g, first_o = m(f"ln(2) + ln({ROWS})"), m(f"ln({ROWS}) + CASE WHEN vt <= vhor THEN ln(2) ELSE 0 END + ln({LEVELS})")
        add = {"g": "LEAST(gg, go)", "s": "LEAST(sg, so)", "o": "LEAST(og, oo, os)"}
    else:
        via = {"gg": cg, "go": co_, "sg": cg, "so": co_, "og": cg, "oo": co_, "os": cs}
        each = m("10.0::DOUBLE / (vt - q.vb + 1)")
        first_g = first_o = m("10.0::DOUBLE / (vt + 1)")
        add = {k: each for k in "gso"}
    via = {k: f"LEAST({v}, {INF})" for k, v in via.items()}
    sub = lambda text: text.replace("LEAST(gg, go)", f"LEAST({via['gg']}, {via['go']})").replace(
        "LEAST(sg, so)", f"LEAST({via['sg']}, {via['so']})").replace("LEAST(og, oo, os)", f"LEAST({via['og']}, {via['oo']}, {via['os']})")
    g = f"CASE WHEN q.vb = 0 THEN CASE WHEN vt <= vhor THEN q.g + {first_g} ELSE {INF} END WHEN q.vb - 1 < vhor THEN q.g + {sub(add['g'])} ELSE {INF} END"
    s = f"CASE WHEN q.vb > 0 AND q.vb - 1 >= vhor THEN q.s + {sub(add['s'])} ELSE {INF} END"
    o = f"CASE WHEN q.vb = 0 THEN q.o + {first_o} ELSE q.o + {sub(add['o'])} END"
    fgp = f"CASE WHEN q.vb > 0 AND {via['gg']} < {via['go']} THEN 0 ELSE 1 END"
    fsp = f"CASE WHEN q.vb > 0 AND {via['sg']} < {via['so']} THEN 0 ELSE 1 END"
    fop = (f"CASE WHEN q.vb = 0 THEN 1 WHEN {via['os']} < LEAST({via['og']}, {via['oo']}) THEN 2 WHEN {via['og']} < {via['oo']} THEN 0 ELSE 1 END")

    def best(cost, prev):
        return (f"list_min(list_transform(c, lambda q: {{'c': LEAST({cost}, {INF}), 'vb': q.vb, "
                f"'p': CASE WHEN ({cost}) >= {INF} THEN 1 ELSE {prev} END, 'm': q.mean}}))")

    return f"""
rec AS (
 SELECT series_id, vhor, -1 AS vt, []::BIGINT[] AS CG, []::BIGINT[] AS CO, []::BIGINT[] AS CS, []::DOUBLE[] AS MO, []::BIGINT[] AS BG, []::BIGINT[] AS BO, []::BIGINT[] AS BS FROM sr
 UNION ALL
 SELECT series_id, vhor, vt, list_append(CG, CAST(g.c AS BIGINT)), list_append(CO, CAST(o.c AS BIGINT)), list_append(CS, CAST(s.c AS BIGINT)), list_append(MO, CAST(o.m AS DOUBLE)),
  list_append(BG, CAST(g.vb * 3 + g.p AS BIGINT)), list_append(BO, CAST(o.vb * 3 + o.p AS BIGINT)), list_append(BS, CAST(s.vb * 3 + s.p AS BIGINT))
 FROM (SELECT *, {best(g, fgp)} AS g, {best(o, fop)} AS o, {best(s, fsp)} AS s
   FROM (SELECT r.series_id, r.vhor, cl.vt, CG, CO, CS, MO, BG, BO, BS, c FROM rec r JOIN cl ON cl.series_id = r.series_id AND cl.vt = r.vt + 1) j) k),
fin AS (SELECT *, CASE WHEN CS[{ROWS}] < LEAST(CG[{ROWS}], CO[{ROWS}]) THEN 2 WHEN CG[{ROWS}] < CO[{ROWS}] THEN 0 ELSE 1 END AS k FROM rec WHERE vt = {ROWS - 1}),
bt AS (
 SELECT series_id, CG, CO, CS, BG, BO, BS, CAST({ROWS - 1} AS BIGINT) AS vt, CAST(k AS BIGINT) AS k, 0 AS i FROM fin
 UNION ALL
 SELECT series_id, CG, CO, CS, BG, BO, BS, b // 3 - 1, b % 3, i + 1
 FROM (SELECT *, CASE k WHEN 0 THEN BG[vt + 1] WHEN 1 THEN BO[vt + 1] ELSE BS[vt + 1] END AS b FROM bt) z WHERE b // 3 > 0),
seg AS (SELECT b.series_id, CAST(i AS INTEGER) AS seg_idx, CAST(CASE WHEN k = 1 AND c.mean < 1 THEN 2 ELSE k END AS INTEGER) AS type, CAST(c.vb AS INTEGER) AS v_b, CAST(b.vt AS INTEGER) AS v_t,
  ROUND(c.mean, 6) AS disparity, CAST(CASE WHEN k = 2 OR (k = 1 AND c.mean < 1) THEN 4 WHEN k = 0 THEN CASE WHEN c.c0 < c.c1 THEN 0 ELSE 1 END WHEN c.plain THEN 2 ELSE 3 END AS INTEGER) AS class_id,
  LEAST(CASE k WHEN 0 THEN CG[b.vt + 1] WHEN 1 THEN CO[b.vt + 1] ELSE CS[b.vt + 1] END, 10000000000) AS cost,
  ROUND(CAST(c.x AS DOUBLE) / c.h, 6) AS mean_x, ROUND(CAST(c.y AS DOUBLE) / c.h, 6) AS mean_y
  FROM bt b JOIN ca c ON c.series_id = b.series_id AND c.vt = b.vt AND c.vb = CASE b.k WHEN 0 THEN BG[b.vt + 1] WHEN 1 THEN BO[b.vt + 1] ELSE BS[b.vt + 1] END // 3)"""


def sql(pairwise: bool, select: str, w_disp: int = 4, w_seg: str = "0.02") -> str:
    return f"WITH RECURSIVE {candidate_sql(w_disp, w_seg)}, {recursion_sql(pairwise)} {select}"


VIEWS = ("fx_series", "fx_class_cost")


def rounded(segs):
    return segs.withColumns({c: F.round(c, 6) for c in ("disparity", "mean_x", "mean_y")})


@query("q_segment_dp", views=VIEWS, sql=sql(True, """
SELECT series_id, COUNT(*) AS n_segments, arg_max(cost, v_t) AS cost, COUNT(CASE WHEN type = 1 THEN 1 END) AS n_objects FROM seg GROUP BY 1"""))
def q_segment_dp(t):
    """Best total cost and number of segments of every series."""
    return segments(t, True).groupBy("series_id").agg(
        F.count("*").alias("n_segments"), F.max_by("cost", "v_t").alias("cost"),
        F.count(F.when(F.col("type") == 1, 1)).alias("n_objects"))


@query("q_backtrace", views=VIEWS, sql=sql(True, "SELECT * FROM seg"))
def q_backtrace(t):
    """The way back of every series by pointer jumping over its best segments."""
    return rounded(segments(t, True, jumps=True))


@query("q_segment_unary", views=VIEWS, sql=sql(False, "SELECT * FROM seg"))
def q_segment_unary(t):
    """Costs without the cost of what lies below: minima over all segments of a column, no fold; what lies below only fixes types."""
    return rounded(segments(t, False))
