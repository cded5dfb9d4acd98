"""Standard normal quantile as a Spark Column expression.

Spark SQL has no inverse normal CDF; this is P. J. Acklam's published
rational approximation (relative error below 1.2e-9), evaluated inside
whole-stage codegen — no Python worker involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published coefficients of the approximation.
A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
     1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
     6.680131188771972e+01, -1.328068155288572e+01]
C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
     -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
     3.754408661907416e+00]
P_LOW = 0.02425


def _horner(coefs: list[float], x):
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_ppf(p: Column) -> Column:
    q_tail = F.sqrt(-2 * F.log(p))
    q_up = F.sqrt(-2 * F.log(1 - p))
    q = p - 0.5
    r = q * q
    low = _horner(C, q_tail) / (_horner(D, q_tail) * q_tail + 1)
    central = _horner(A, r) * q / (_horner(B, r) * r + 1)
    high = -_horner(C, q_up) / (_horner(D, q_up) * q_up + 1)
    return (F.when(p < P_LOW, low).when(p <= 1 - P_LOW, central).otherwise(high))


def _horner_sql(coefs: list[float], x: str) -> str:
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"(({acc}) * {x} + {c!r})"
    return acc


def norm_ppf_sql(p: str) -> str:
    """The same approximation as SQL text (for the DuckDB oracle)."""
    qt = f"SQRT(-2 * LN({p}))"
    qu = f"SQRT(-2 * LN(1 - {p}))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    low = f"({_horner_sql(C, qt)}) / (({_horner_sql(D, qt)}) * {qt} + 1)"
    central = f"({_horner_sql(A, r)}) * {q} / (({_horner_sql(B, r)}) * {r} + 1)"
    high = f"-({_horner_sql(C, qu)}) / (({_horner_sql(D, qu)}) * {qu} + 1)"
    return (f"(CASE WHEN {p} < {P_LOW} THEN {low} WHEN {p} <= {1 - P_LOW} THEN {central} "
            f"ELSE {high} END)")
