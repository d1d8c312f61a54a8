"""Probabilistic models of ground, object and sky cells, and transition costs.

Costs are negative log likelihoods.  ``micro`` turns them into whole millionths:
sums of whole numbers do not depend on the order in which tasks add them up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.constants import MODEL_DEFAULTS, PI
from colonnade.functions.erf import erf

MICRO = 1_000_000
IMPOSSIBLE = 10**15  # in millionths; at most a thousand of them add up safely


@dataclass(frozen=True)
class Model:
    """Parameters of one camera and one cost model."""

    rows: int
    max_dis: int
    focal: float
    baseline: float
    camera_height: float = 1.2
    tilt: float = 0.0
    p: dict = field(default_factory=lambda: dict(MODEL_DEFAULTS))

    def log_exists(self, kind: str) -> tuple[float, float]:
        """(-ln pn, -ln(1 - pn)) for a type, pn = p(type|missing) p(missing) / p(type)."""
        pn = self.p[f"p{kind}_given_nexist"] * self.p["pnexist_dis"] / self.p[f"p{kind}"]
        return -math.log(pn), -math.log(1.0 - pn)

    @property
    def uniform(self) -> float:
        return math.log(self.max_dis) - math.log(self.p["pout"])

    @property
    def uniform_sky(self) -> float:
        return math.log(self.max_dis) - math.log(self.p["pout_sky"])

    @property
    def tilt_sigma(self) -> float:
        return self.p["sigma_camera_tilt"] * PI / 180.0


def micro(cost: Column) -> Column:
    return F.round(cost * MICRO).cast("bigint")


def ground_line(alpha: Column, vhor: Column, v: Column) -> Column:
    return alpha * (vhor - v)


def _with_gauss(df: DataFrame, m: Model, fn: str, var: Column) -> DataFrame:
    """Adds ``norm`` and ``inv`` (1 / 2 sigma^2) of a Gaussian at ``fn`` cut to the value range.

    Built in steps: each intermediate is a column of its own, because an expression
    that repeats its argument many times must not be repeated itself.
    """
    root2 = math.sqrt(2.0)
    df = df.withColumn("_var", var).withColumn("_sigma", F.sqrt("_var"))
    df = df.withColumns({"_x1": (m.max_dis - F.col(fn)) / (F.col("_sigma") * root2), "_x2": -F.col(fn) / (F.col("_sigma") * root2)})
    df = df.withColumns({"_e1": erf(F.col("_x1")), "_e2": erf(F.col("_x2"))})
    mass = 0.5 * (F.col("_e1") - F.col("_e2"))
    norm = F.log(F.when(mass > 0, mass)) - F.log((1.0 - m.p["pout"]) / (F.col("_sigma") * math.sqrt(2.0 * PI)))
    return df.withColumns({"norm": norm, "inv": 1.0 / (2.0 * F.col("_var"))}).drop("_var", "_sigma", "_x1", "_x2", "_e1", "_e2")


def with_ground_model(df: DataFrame, m: Model, fn: str = "fn", v: str = "v", vhor: str = "vhor") -> DataFrame:
    """Adds norm and inv of the ground value ``fn`` at row ``v``.

    The norm is null from the horizon up: there is no ground there, and the mass
    inside the value range would be a difference of two almost equal numbers.
    """
    fb = m.focal * m.baseline / m.camera_height
    df = df.withColumn("_x", m.tilt + (F.col(vhor) - F.col(v)) / m.focal)
    var = (m.p["sigma_disparity_ground"] ** 2
           + fb * fb * (m.p["sigma_camera_height"] ** 2 * F.col("_x") * F.col("_x") / m.camera_height ** 2 + m.tilt_sigma ** 2))
    out = _with_gauss(df, m, fn, var).drop("_x")
    return out.withColumn("norm", F.when(F.col(v) < F.col(vhor), F.col("norm")))


def with_object_model(df: DataFrame, m: Model, fn: str = "fn") -> DataFrame:
    """Adds norm and inv of an object at value ``fn`` (a double column)."""
    df = df.withColumn("_spread", F.col(fn) * F.col(fn) * m.p["range_objects_z"] / (m.focal * m.baseline))
    var = m.p["sigma_disparity_object"] ** 2 + F.col("_spread") * F.col("_spread")
    return _with_gauss(df, m, fn, var).drop("_spread")


def object_range(m: Model, mean: Column) -> Column:
    """How far two objects must differ in value to be ``range_objects_z`` apart."""
    fb = m.focal * m.baseline
    return F.when(mean != 0, mean - fb / (fb / F.nullif(mean, F.lit(0.0)) + m.p["range_objects_z"])).otherwise(0.0)


def sky_norm(m: Model) -> Column:
    sigma = m.p["sigma_sky"]
    mass = 0.5 * erf(F.lit(m.max_dis / (sigma * math.sqrt(2.0))))
    return F.log(mass) - math.log((1.0 - m.p["pout_sky"]) / (sigma * math.sqrt(2.0 * PI)))


def object_cost(m: Model, norm: Column, inv: Column, fn: Column, d: Column) -> Column:
    """Cost of value ``d`` under an object at ``fn``; a missing value costs a constant."""
    exists, not_exists = m.log_exists("object")
    return F.when(d.isNull(), F.lit(exists)).otherwise(
        not_exists + F.least(F.lit(m.uniform), norm + (d - fn) * (d - fn) * inv))


def ground_cost(m: Model, norm: Column, inv: Column, fn: Column, d: Column, v: Column, vhor: Column) -> Column:
    """Cost of a ground cell; null (impossible) from the horizon up."""
    exists, not_exists = m.log_exists("ground")
    seen = not_exists + F.least(F.lit(m.uniform), norm + (d - fn) * (d - fn) * inv)
    return F.when(v < vhor, F.when(d.isNull(), F.lit(exists)).otherwise(seen))


def sky_cost(m: Model, d: Column, v: Column, vhor: Column) -> Column:
    """Cost of a sky cell; 0 below the horizon, where sky segments never reach."""
    exists, not_exists = m.log_exists("sky")
    inv = 1.0 / (2.0 * m.p["sigma_sky"] ** 2)
    seen = not_exists + F.least(F.lit(m.uniform_sky), sky_norm(m) + d * d * inv)
    return F.when(v < vhor, F.lit(0.0)).when(d.isNull(), F.lit(exists)).otherwise(seen)


def transition_cost(m: Model, to: Column, frm: Column, v_b: Column, vhor: Column, fn: Column, mean: Column,
                    mean_range: Column, ground: Column) -> Column:
    """Cost of a segment of type ``to`` starting at ``v_b`` on one of type ``frm``.

    ``fn`` is the new segment's mean, ``mean`` the mean of the object below with its
    range, ``ground`` the ground value just below.  Null is impossible.
    """
    eps, top = m.p["epsilon"], float(m.max_dis)
    u = F.log(F.lit(float(m.rows)) - v_b)
    below = (v_b - 1) < vhor
    g = F.greatest(ground, F.lit(0.0))
    r = F.greatest(mean_range, F.lit(0.0))
    ln2 = math.log(2.0)

    def neg_log(p: float, width: Column) -> Column:
        """-ln p + ln width; an empty width is impossible."""
        return F.when(width > 0, -math.log(p) + F.log(F.when(width > 0, width)))

    on_ground = -math.log(0.7) + u + (
        F.when(fn > g + eps, neg_log(m.p["pgrav"], top - g - eps))
        .when(fn < g - eps, neg_log(m.p["pblg"], g - eps))
        .otherwise(-math.log(1.0 - m.p["pgrav"] - m.p["pblg"]) + math.log(2.0 * eps)))
    on_object = F.when(below, -math.log(0.7)).otherwise(ln2) + u + (
        F.when(fn > mean + r, neg_log(m.p["pord"], top - mean - r))
        .when(fn < mean - r, neg_log(1.0 - m.p["pord"], mean - r)))
    return (
        F.when((to == 0) & (frm != 2), F.when(below, -math.log(0.3) + u))
        .when((to == 2) & (frm == 0), F.when(~below & (ground < 1.0), u))
        .when((to == 2) & (frm == 1), F.when(~below & (mean >= eps), ln2 + u))
        .when((to == 1) & (frm == 0), on_ground)
        .when((to == 1) & (frm == 1), on_object)
        .when((to == 1) & (frm == 2), F.when(fn > eps, math.log(top - eps) + u)))


def first_cost(m: Model, to: Column, v_t: Column, vhor: Column) -> Column:
    """Cost of the lowest segment of a column."""
    low = v_t <= vhor
    rows = math.log(m.rows)
    return (F.when((to == 0) & low, math.log(2.0) + rows)
            .when(to == 1, rows + F.when(low, math.log(2.0)).otherwise(0.0) + math.log(m.max_dis)))
