"""Normal distribution helpers.

Cuts of the form ``pnorm(x, mu, sd) < p`` are rewritten as ``x < mu + z(p) * sd`` so
they stay exact; ``z(p)`` is a plan-time constant. ``pnorm`` as a column (for printed
probabilities) uses a rational approximation with |error| < 7.5e-8.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_ppf(p: float) -> float:
    """Standard normal quantile (Acklam's rational approximation + one Halley step)."""
    if not 0.0 < p < 1.0:
        raise ValueError("p must be in (0, 1)")
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00]
    lo, hi = 0.02425, 1 - 0.02425
    if p < lo:
        q = math.sqrt(-2 * math.log(p))
        x = (((((c[0]*q+c[1])*q+c[2])*q+c[3])*q+c[4])*q+c[5]) / ((((d[0]*q+d[1])*q+d[2])*q+d[3])*q+1)
    elif p <= hi:
        q = p - 0.5
        r = q * q
        x = (((((a[0]*r+a[1])*r+a[2])*r+a[3])*r+a[4])*r+a[5])*q / (((((b[0]*r+b[1])*r+b[2])*r+b[3])*r+b[4])*r+1)
    else:
        q = math.sqrt(-2 * math.log(1 - p))
        x = -(((((c[0]*q+c[1])*q+c[2])*q+c[3])*q+c[4])*q+c[5]) / ((((d[0]*q+d[1])*q+d[2])*q+d[3])*q+1)
    # Halley refinement against the exact CDF
    e = 0.5 * math.erfc(-x / math.sqrt(2)) - p
    u = e * math.sqrt(2 * math.pi) * math.exp(x * x / 2)
    return x - u / (1 + x * u / 2)


def pnorm_col(x, mu=0.0, sd=1.0) -> Column:
    """Normal CDF as a column expression (Zelen & Severo 26.2.17)."""
    x = F.col(x) if isinstance(x, str) else x
    mu = F.lit(mu) if not isinstance(mu, Column) else mu
    sd = F.lit(sd) if not isinstance(sd, Column) else sd
    z = (x - mu) / sd
    az = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * az)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-az * az / 2.0) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1.0 - upper).otherwise(upper)


def upper_cut(mu: Column, sd: Column, p: float) -> Column:
    """Value above which ``pnorm(x, mu, sd) > p``."""
    return mu + F.lit(norm_ppf(p)) * sd
