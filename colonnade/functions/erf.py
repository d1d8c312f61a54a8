"""The error function as a column expression (Spark SQL has none).

Rational Chebyshev approximations on three ranges (W. J. Cody, 1969), accurate to
about 1e-16 and made of plain arithmetic, so they stay inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: published coefficients, highest order last before the leading one ---
SMALL_NUM = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02,
             3.20937758913846947e03, 1.85777706184603153e-1)
SMALL_DEN = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
MID_NUM = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02,
           8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03,
           2.15311535474403846e-8)
MID_DEN = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03,
           3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
LARGE_NUM = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2,
             6.58749161529837803e-4, 1.63153871373020978e-2)
LARGE_DEN = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2,
             2.33520497626869185e-3)


def _ratio(x: Column, num: tuple[float, ...], den: tuple[float, ...]) -> Column:
    """(num[-1] x^n + num[0] x^(n-1) + ..) / (x^n + den[0] x^(n-1) + ..)."""
    top, bottom = F.lit(num[-1]), F.lit(1.0)
    for a, b in zip(num[:-1], den):
        top, bottom = top * x + a, bottom * x + b
    return top / bottom


def erf(x: Column) -> Column:
    a = F.least(F.abs(x), F.lit(6.0))
    small = a * _ratio(a * a, SMALL_NUM, SMALL_DEN)
    mid = 1.0 - F.exp(-a * a) * _ratio(a, MID_NUM, MID_DEN)
    inv = F.lit(1.0) / F.greatest(a * a, F.lit(1.0))
    tail = (1.0 / math.sqrt(math.pi) - inv * _ratio(inv, LARGE_NUM, LARGE_DEN)) / F.greatest(a, F.lit(1.0))
    large = 1.0 - F.exp(-a * a) * tail
    value = F.when(a <= 0.46875, small).when(a <= 4.0, mid).otherwise(large)
    return F.when(x < 0, -value).otherwise(value)
