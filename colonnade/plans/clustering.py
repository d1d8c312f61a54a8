"""Queries over density clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.functions.constants import INSTANCE_COLOURS
from colonnade.operators import cluster as cl
from colonnade.operators import geometry as geo
from colonnade.plans.geometry import palette_cte
from colonnade.plans.registry import query
from colonnade.session import dealt

EPS, MIN_SAMPLES, SIZE = 300, 4, 50
XY = ("x", "y")


@query("q_cluster_candidates", views=("fx_segments",), sql="""
SELECT frame_id, col_id, seg_idx, class_id, mean_x, mean_y, v_t - v_b + 1 AS size, v_t - v_b + 1 >= 3 AS core_candidate
FROM fx_segments WHERE class_id >= 11""")
def q_cluster_candidates(t):
    size = F.col("v_t") - F.col("v_b") + 1
    return t.fx_segments.where("class_id >= 11").select(
        "frame_id", "col_id", "seg_idx", "class_id", "mean_x", "mean_y", size.alias("size"), (size >= 3).alias("core_candidate"))


@query("q_eps_neighbors", views=("fx_points",), sql=f"""
SELECT a.pt_id, COUNT(*) AS degree FROM fx_points a JOIN fx_points b ON a.class_id = b.class_id
AND b.y BETWEEN a.y - {EPS} AND a.y + {EPS} AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS * EPS} GROUP BY 1""")
def q_eps_neighbors(t):
    """How many points of its class lie within the radius of each point (itself included)."""
    grid = cl.Grid("class_id", XY, EPS)
    sites = cl.make_sites(grid, t.fx_points, "pt_id", F.lit(True), F.lit(True))
    degree = cl.degree_by_lines(grid, sites)
    return t.fx_points.join(dealt(degree), ["class_id", *XY]).select("pt_id", "degree")


def core_sql(points: str = "fx_points", eps: int = EPS, min_samples: int = MIN_SAMPLES, size: int = SIZE) -> str:
    return f"""
large AS (SELECT p.* FROM {points} p JOIN (SELECT class_id FROM {points} WHERE size >= {size} GROUP BY 1 HAVING COUNT(*) > {min_samples}) k ON k.class_id = p.class_id WHERE size >= {size}),
core AS (SELECT a.pt_id, a.class_id, a.x, a.y FROM large a JOIN large b ON a.class_id = b.class_id AND b.y BETWEEN a.y - {eps} AND a.y + {eps}
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {eps * eps} GROUP BY 1, 2, 3, 4 HAVING COUNT(*) >= {min_samples})"""


CORE_SQL = core_sql()


def near_sql(targets: str) -> str:
    return f"""
near AS (SELECT pt_id, core_id, sq FROM (SELECT a.pt_id, b.pt_id AS core_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS sq,
  ROW_NUMBER() OVER (PARTITION BY a.pt_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.pt_id) AS k
  FROM ({targets}) a JOIN core b ON a.class_id = b.class_id AND b.y BETWEEN a.y - {EPS} AND a.y + {EPS}
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS * EPS}) z WHERE k = 1)"""


@query("q_nearest_core", views=("fx_points",), sql=f"""
WITH {CORE_SQL}, {near_sql(f"SELECT * FROM fx_points WHERE size < {SIZE}")} SELECT pt_id, core_id, sq FROM near""")
def q_nearest_core(t):
    """Nearest core point within the radius for every small point that has one."""
    grid = cl.Grid("class_id", XY, EPS)
    able = cl.enough_large(t.fx_points, "class_id", F.col("size") >= SIZE, MIN_SAMPLES)
    large = t.fx_points.where(F.col("size") >= SIZE).join(able, "class_id", "left_semi")
    _, core, tree = cl.core_structure(grid, large, "pt_id", MIN_SAMPLES, F.lit(True), F.lit(True))
    small = t.fx_points.where(F.col("size") < SIZE)
    targets = grid.with_cell(small.select("class_id", *XY).distinct())
    near = cl.nearest_core(grid, targets, core, tree)
    return small.join(dealt(near), ["class_id", *XY]).select("pt_id", "core_id", "sq")


def dbscan_sql(core: str, dims: tuple[str, ...], select: str) -> str:
    return f"WITH RECURSIVE {dbscan_ctes(core, dims)} {select}"


def dbscan_ctes(core: str, dims: tuple[str, ...], points: str = "fx_points", eps: int = EPS) -> str:
    sq = " + ".join(f"(a.{d} - b.{d}) * (a.{d} - b.{d})" for d in dims)
    near = f"a.class_id = b.class_id AND b.y BETWEEN a.y - {eps} AND a.y + {eps} AND {sq} <= {eps * eps}"
    return f"""{core},
link AS (SELECT a.pt_id AS a, b.pt_id AS b FROM core a JOIN core b ON {near}),
reach AS (SELECT pt_id AS root, pt_id AS id FROM core UNION SELECT r.root, l.b FROM reach r JOIN link l ON l.a = r.id WHERE l.b > r.root OR l.b < r.root),
comp AS (SELECT id AS pt_id, MIN(root) AS root FROM reach GROUP BY 1),
num AS (SELECT c.pt_id, DENSE_RANK() OVER (PARTITION BY class_id ORDER BY root) - 1 AS cluster FROM comp c JOIN core k ON k.pt_id = c.pt_id),
nr AS (SELECT pt_id, core_id FROM (SELECT a.pt_id, b.pt_id AS core_id, ROW_NUMBER() OVER (PARTITION BY a.pt_id ORDER BY {sq}, b.pt_id) AS k
  FROM {points} a JOIN core b ON {near}) z WHERE k = 1),
lab AS (SELECT p.*, COALESCE(n.cluster, -1) AS cluster, c.pt_id IS NOT NULL AS is_core FROM {points} p
  LEFT JOIN nr ON nr.pt_id = p.pt_id LEFT JOIN num n ON n.pt_id = nr.core_id LEFT JOIN core c ON c.pt_id = p.pt_id)"""


ROWS = "SELECT pt_id, class_id, cluster, is_core FROM lab"
MASKED = f"""core AS (SELECT a.pt_id, a.class_id, a.x, a.y FROM fx_points a JOIN fx_points b ON a.class_id = b.class_id AND b.y BETWEEN a.y - {EPS} AND a.y + {EPS}
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS * EPS} WHERE a.size >= {SIZE} GROUP BY 1, 2, 3, 4 HAVING COUNT(*) >= {MIN_SAMPLES})"""
CORE_3D = (CORE_SQL.replace("large AS (SELECT p.* FROM", "large AS (SELECT p.*, p.size * 4 AS z FROM")
           .replace("a.x, a.y FROM", "a.x, a.y, a.z FROM").replace("GROUP BY 1, 2, 3, 4", "GROUP BY 1, 2, 3, 4, 5")
           .replace("* (a.y - b.y) <=", "* (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <="))


@query("q_dbscan_core_only", views=("fx_points",), sql=dbscan_sql(CORE_SQL, XY, ROWS))
def q_dbscan_core_only(t):
    out = cl.dbscan_core_only(t.fx_points, "pt_id", "class_id", XY, "size", EPS, MIN_SAMPLES, SIZE)
    return out.select("pt_id", "class_id", "cluster", "is_core")


@query("q_dbscan_masked", views=("fx_points",), sql=dbscan_sql(MASKED, XY, ROWS))
def q_dbscan_masked(t):
    out = cl.dbscan_masked(t.fx_points, "pt_id", "class_id", XY, "size", EPS, MIN_SAMPLES, SIZE)
    return out.select("pt_id", "class_id", "cluster", "is_core")


@query("q_dbscan_3d", views=("fx_points",), sql=dbscan_sql(CORE_3D, ("x", "y", "z"), ROWS).replace(
    "FROM fx_points a JOIN core", "FROM (SELECT *, size * 4 AS z FROM fx_points) a JOIN core"))
def q_dbscan_3d(t):
    pts = t.fx_points.withColumn("z", F.col("size") * 4)
    out = cl.dbscan_core_only(pts, "pt_id", "class_id", ("x", "y", "z"), "size", EPS, MIN_SAMPLES, SIZE)
    return out.select("pt_id", "class_id", "cluster", "is_core")


# --- the same on real coordinates ---
#: Radius, and the unit that spreads values and users about as densely as the whole-number points.
REAL_EPS, UNIT = 18.822, 6.274
REAL_SQUARE = f"CAST('{REAL_EPS * REAL_EPS!r}' AS DOUBLE)"
REAL_POINTS = f"""pts AS (SELECT event_id AS pt_id, CASE event_type WHEN 'click' THEN 11 WHEN 'error' THEN 12 WHEN 'purchase' THEN 13 WHEN 'signup' THEN 14 ELSE 15 END AS class_id,
  value * {UNIT}::DOUBLE AS x, user_id * {UNIT}::DOUBLE + value * 0.01::DOUBLE AS y, size, CAST(size % 7 AS DOUBLE) * 2.5::DOUBLE AS z
  FROM events JOIN fx_points ON pt_id = event_id)"""


def real_points(t):
    size = t.fx_points.select(F.col("pt_id").alias("event_id"), "class_id", "size")
    ev = t.events.select("event_id", "user_id", "value").join(dealt(size), "event_id")
    return ev.select(F.col("event_id").alias("pt_id"), "class_id", (F.col("value") * UNIT).alias("x"),
                     (F.col("user_id") * F.lit(UNIT) + F.col("value") * 0.01).alias("y"), "size", ((F.col("size") % 7).cast("double") * 2.5).alias("z"))


def real_near(a: str = "a", b: str = "b", dims: tuple[str, ...] = XY) -> str:
    square = " + ".join(f"({a}.{d} - {b}.{d}) * ({a}.{d} - {b}.{d})" for d in dims)
    return f"{a}.class_id = {b}.class_id AND {b}.y BETWEEN {a}.y - 19 AND {a}.y + 19 AND {square} <= {REAL_SQUARE}"


def real_ctes(mask: bool = False, dims: tuple[str, ...] = XY, points: str = "pts") -> str:
    """Cores, their components, and the label of every point, by definition."""
    square = " + ".join(f"(a.{d} - b.{d}) * (a.{d} - b.{d})" for d in dims)
    able = f"SELECT class_id FROM {points} WHERE size >= {SIZE} GROUP BY 1 HAVING COUNT(*) > {MIN_SAMPLES}"
    large = f"large AS (SELECT * FROM {points}" + (")" if mask else f" WHERE size >= {SIZE} AND class_id IN ({able}))")
    return f"""{large},
core AS (SELECT a.pt_id, a.class_id, {', '.join(f'a.{d}' for d in dims)} FROM large a JOIN large b ON {real_near(dims=dims)} WHERE a.size >= {SIZE} GROUP BY ALL HAVING COUNT(*) >= {MIN_SAMPLES}),
link AS (SELECT a.pt_id AS a, b.pt_id AS b FROM core a JOIN core b ON {real_near(dims=dims)}),
reach AS (SELECT pt_id AS root, pt_id AS id FROM core UNION SELECT r.root, l.b FROM reach r JOIN link l ON l.a = r.id WHERE l.b > r.root OR l.b < r.root),
num AS (SELECT c.id AS pt_id, DENSE_RANK() OVER (PARTITION BY class_id ORDER BY root) - 1 AS cluster FROM (SELECT id, MIN(root) AS root FROM reach GROUP BY 1) c JOIN core k ON k.pt_id = c.id),
nr AS (SELECT pt_id, core_id, sq FROM (SELECT a.pt_id, b.pt_id AS core_id, {square} AS sq, ROW_NUMBER() OVER (PARTITION BY a.pt_id ORDER BY {square}, b.pt_id) AS k
  FROM {points} a JOIN core b ON {real_near(dims=dims)}) z WHERE k = 1),
lab AS (SELECT p.*, COALESCE(n.cluster, -1) AS cluster, c.pt_id IS NOT NULL AS is_core FROM {points} p
  LEFT JOIN nr ON nr.pt_id = p.pt_id LEFT JOIN num n ON n.pt_id = nr.core_id LEFT JOIN core c ON c.pt_id = p.pt_id)"""


@query("q_real_neighbors", views=("fx_points",), sql=f"""
WITH {REAL_POINTS} SELECT a.pt_id, COUNT(*) AS degree FROM pts a JOIN pts b ON {real_near()} GROUP BY 1""")
def q_real_neighbors(t):
    """Neighbour counts on real coordinates."""
    grid, pts = cl.Grid("class_id", XY, REAL_EPS), real_points(t)
    sites = cl.make_sites(grid, pts, "pt_id", F.lit(True), F.lit(True))
    return pts.join(dealt(cl.degrees(grid, sites)), ["class_id", *XY]).select("pt_id", "degree")


@query("q_real_nearest_core", views=("fx_points",), sql=f"""
WITH RECURSIVE {REAL_POINTS}, {real_ctes()} SELECT nr.pt_id, core_id, ROUND(sq, 6) AS sq FROM nr JOIN pts p ON p.pt_id = nr.pt_id WHERE p.size < {SIZE}""")
def q_real_nearest_core(t):
    grid, pts = cl.Grid("class_id", XY, REAL_EPS), real_points(t)
    able = cl.enough_large(pts, "class_id", F.col("size") >= SIZE, MIN_SAMPLES)
    large = pts.where(F.col("size") >= SIZE).join(able, "class_id", "left_semi")
    _, core, tree = cl.core_structure(grid, large, "pt_id", MIN_SAMPLES, F.lit(True), F.lit(True))
    small = pts.where(F.col("size") < SIZE)
    near = cl.nearest_core(grid, grid.with_cell(small.select("class_id", *XY).distinct()), core, tree)
    return small.join(dealt(near), ["class_id", *XY]).select("pt_id", "core_id", F.round("sq", 6).alias("sq"))


@query("q_real_dbscan", views=("fx_points",), sql=f"WITH RECURSIVE {REAL_POINTS}, {real_ctes()} {ROWS}")
def q_real_dbscan(t):
    """Clusters of real positions with the radius of the published runs."""
    out = cl.dbscan_core_only(real_points(t), "pt_id", "class_id", XY, "size", REAL_EPS, MIN_SAMPLES, SIZE)
    return out.select("pt_id", "class_id", "cluster", "is_core")


@query("q_real_dbscan_masked", views=("fx_points",), sql=f"WITH RECURSIVE {REAL_POINTS}, {real_ctes(mask=True)} {ROWS}")
def q_real_dbscan_masked(t):
    out = cl.dbscan_masked(real_points(t), "pt_id", "class_id", XY, "size", REAL_EPS, MIN_SAMPLES, SIZE)
    return out.select("pt_id", "class_id", "cluster", "is_core")


@query("q_real_dbscan_3d", views=("fx_points",), sql=f"""
WITH RECURSIVE {REAL_POINTS}, known AS (SELECT * FROM pts WHERE z <> 0), {real_ctes(dims=("x", "y", "z"), points="known")}
{ROWS} UNION ALL SELECT pt_id, class_id, -1, FALSE FROM pts WHERE z = 0""")
def q_real_dbscan_3d(t):
    """A third feature that not every point has; points without it take no part."""
    out = cl.dbscan_measured(real_points(t), "pt_id", "class_id", XY, "z", "size", REAL_EPS, MIN_SAMPLES, SIZE)
    return out.select("pt_id", "class_id", "cluster", "is_core")


@query("q_label_codec", views=("fx_masks",), sql="""
SELECT frame_id, r, c, CAST(gt_id // 1000 AS INTEGER) AS class_part, CAST(gt_id % 1000 AS INTEGER) AS n_part,
  CASE WHEN gt_id > 1000 THEN CAST(gt_id AS INTEGER) ELSE -1 END AS again FROM fx_masks""")
def q_label_codec(t):
    cls, n = F.floor(F.col("gt_id") / 1000).cast("int"), F.col("gt_id") % 1000
    again = cl.encode_label(cls, F.when(F.col("gt_id") > 1000, n).otherwise(-1))
    return t.fx_masks.select("frame_id", "r", "c", cls.alias("class_part"), n.alias("n_part"), again.cast("int").alias("again"))


@query("q_cluster_summary", views=("fx_points",), sql=dbscan_sql(CORE_SQL, XY, f""",
{palette_cte('pi', INSTANCE_COLOURS)},
s AS (SELECT class_id, cluster, COUNT(*) AS n, MIN(pt_id) AS first_id, ROUND(AVG(x), 4) AS mid_x, MIN(x) AS min_x, MAX(x) AS max_x,
  ROUND(AVG(y), 4) AS mid_y, MIN(y) AS min_y, MAX(y) AS max_y FROM lab GROUP BY 1, 2),
m AS (SELECT class_id, cluster, part, string_agg(concat(pt_id, ':', x, ':', y), ' ' ORDER BY pt_id) AS members
  FROM (SELECT *, (ROW_NUMBER() OVER (PARTITION BY class_id, cluster ORDER BY pt_id) - 1) // {cl.LISTED} AS part FROM lab) z GROUP BY 1, 2, 3)
SELECT s.*, m.part, m.members, CASE WHEN s.cluster = -1 THEN 255 ELSE pi.r END AS r, CASE WHEN s.cluster = -1 THEN 255 ELSE pi.g END AS g,
  CASE WHEN s.cluster = -1 THEN 255 ELSE pi.b END AS b
FROM s JOIN m ON m.class_id = s.class_id AND m.cluster = s.cluster JOIN pi ON pi.k = (s.class_id * (s.cluster + 1)) % {len(INSTANCE_COLOURS)}"""))
def q_cluster_summary(t):
    """Every label with its members, as id:x:y, and the colour they are overlaid in; points without a cluster are white."""
    labelled = cl.dbscan_core_only(t.fx_points, "pt_id", "class_id", XY, "size", EPS, MIN_SAMPLES, SIZE)
    out = cl.cluster_summary(labelled, ["class_id", "cluster"], "pt_id", XY)
    text = F.transform("members", lambda m: F.concat(*[
        x for c in ("pt_id", *XY) for x in (F.lit(":"), F.coalesce(m[c].cast("string"), F.lit("")))][1:]))
    colour = geo.instance_colour(F.col("class_id"), F.col("cluster"))
    return out.withColumns({"members": F.array_join(text, " "), **dict(zip("rgb", colour)), **{c: F.round(c, 4) for c in ("mid_x", "mid_y")}})
