"""Queries over parameter sweeps and run scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from colonnade.functions.constants import SEARCH_START
from colonnade.operators import sweep as sw
from colonnade.plans import segmenting
from colonnade.plans.registry import query


@query("q_composite_score", views=("fx_runs",), sql="""
SELECT run_id, ROUND(MIN(ms) / MAX(ms) + 1.5::DOUBLE * COALESCE(CASE WHEN COUNT(*) > 5 THEN 5.0::DOUBLE / COUNT(*) END, 0), 6) AS score FROM fx_runs GROUP BY 1""")
def q_composite_score(t):
    semantic, instance = F.min("ms") / F.max("ms"), F.when(F.count("*") > 5, 5.0 / F.count("*"))
    return t.fx_runs.groupBy("run_id").agg(F.round(sw.composite_score(semantic, instance), 6).alias("score"))


def draw_sql(d: sw.Dimension) -> str:
    u = f"(((run_id % {sw.MODULUS}) * {d.step} + {d.step * 7919}) % {sw.MODULUS}) / {sw.MODULUS}.0::DOUBLE"
    if d.kind == "log":
        return f"ROUND(power(10.0::DOUBLE, {d.low} + {u} * {d.high - d.low}), 8) AS {d.name}"
    if d.kind == "real":
        return f"ROUND({d.low} + {u} * {d.high - d.low}, 6) AS {d.name}"
    return f"CAST({d.low} + FLOOR({u} * {d.high - d.low + 1}) AS INTEGER) AS {d.name}"


@query("q_sample_space", views=("fx_runs",), sql=f"""
WITH r AS (SELECT DISTINCT run_id FROM fx_runs)
SELECT run_id, {', '.join(draw_sql(d) for d in sw.SEARCH_SPACE)} FROM r
UNION ALL SELECT -1, {', '.join(f"CAST({SEARCH_START[d.name]} AS {'INTEGER' if d.kind == 'int' else 'DOUBLE'})" for d in sw.SEARCH_SPACE)}""")
def q_sample_space(t):
    out = sw.sample_space(t.fx_runs.select("run_id").distinct(), "run_id", SEARCH_START)
    digits = {"log": 8, "real": 6}
    return out.withColumns({d.name: F.round(d.name, digits[d.kind]) for d in sw.SEARCH_SPACE if d.kind in digits})


SETS = ((4, 0.02), (2, 0.05), (1, 0.01))
SCORE_SQL = ("SELECT {i} AS param_id, COUNT(*) AS n_segments, ROUND(COUNT(CASE WHEN type = 1 THEN 1 END) / COUNT(*) "
             "+ 1.5::DOUBLE * (COUNT(CASE WHEN class_id = 3 THEN 1 END) / COUNT(*)), 6) AS score FROM seg")


@query("q_sweep_scores", views=segmenting.VIEWS, sql=" UNION ALL ".join(
    f"SELECT * FROM ({segmenting.sql(True, SCORE_SQL.format(i=i), wd, str(ws))}) s{i}" for i, (wd, ws) in enumerate(SETS)))
def q_sweep_scores(t):
    """The segmentation under several weight sets, one score each.

    Columns are packed once per set from the same scan; the sets are independent
    branches, so a cluster works on them side by side.
    """
    runs = [segmenting.segments(t, True, float(wd), ws).withColumn("param_id", F.lit(i)) for i, (wd, ws) in enumerate(SETS)]
    every = reduce(lambda a, b: a.unionByName(b), runs)
    n = F.count("*")
    semantic = F.count(F.when(F.col("type") == 1, 1)) / n
    instance = F.count(F.when(F.col("class_id") == 3, 1)) / n
    return every.groupBy("param_id").agg(n.alias("n_segments"), F.round(sw.composite_score(semantic, instance), 6).alias("score"))


@query("q_golden_check", sql="""
WITH a AS (SELECT o_custkey AS run_id, COUNT(*) AS n, ROUND(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) / COUNT(*) / 5000.0::DOUBLE, 6) AS value FROM orders GROUP BY 1)
SELECT c_custkey AS run_id, c_acctbal AS expected, a.value AS actual,
  CASE WHEN a.value IS NULL THEN 'missing' WHEN abs(a.value - c_acctbal) <= 1500 THEN 'equal' ELSE 'different' END AS verdict
FROM customer LEFT JOIN a ON a.run_id = c_custkey""")
def q_golden_check(t):
    expected = t.customer.select(F.col("c_custkey").alias("run_id"), F.col("c_acctbal").alias("value"))
    mean = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / F.count("*") / 5000.0
    actual = t.orders.groupBy(F.col("o_custkey").alias("run_id")).agg(F.round(mean, 6).alias("value"))
    return sw.golden_check(expected, actual, "run_id", "value", 1500.0)
