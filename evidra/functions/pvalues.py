"""Tail probabilities of Student's t as column expressions.

With t = sqrt(n) sinh(w) the density of Student's t with n degrees of freedom is cosh(w)^-n up to a constant, so
the two-sided tail is the integral of cosh^-n from w on, divided by that from 0 on: no gamma function and one
formula for all degrees of freedom. Both integrals end where the integrand has fallen to e^-``DEPTH`` of its first
value, and are taken by Gauss-Legendre quadrature.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

NODES = 64
DEPTH = 40.0


def _nodes() -> Column:
    """(place between 0 and 1, weight) of every node."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    return F.array(*(F.struct(F.lit(float(a + 1) / 2).alias("at"), F.lit(float(b) / 2).alias("weight")) for a, b in zip(x, w)))


def _arccosh_exp(v: Column) -> Column:
    """The w >= 0 with log cosh w = v, exact to the last digits also for tiny v."""
    return v + F.log1p(F.sqrt(-F.expm1(-2 * v)))


def _log_cosh(w: Column) -> Column:
    return F.when(w > 20, w - math.log(2)).otherwise(F.log1p(F.sinh(w) * F.sinh(w)) / 2)


def _integral(dof: Column, first: Column) -> Column:
    """The integral of (cosh w / cosh w0)^-dof from w0 on, where ``first`` is log cosh w0."""
    given = F.struct(dof.alias("dof"), first.alias("first"), _arccosh_exp(first).alias("low"), _arccosh_exp(first + DEPTH / dof).alias("high"))

    def summed(g: Column) -> Column:
        width = g["high"] - g["low"]
        value = lambda n: F.exp(-g["dof"] * (_log_cosh(g["low"] + width * n["at"]) - g["first"]))
        return width * F.aggregate(_nodes(), F.lit(0.0), lambda total, n: total + n["weight"] * value(n))

    # The one-row array lets the bounds be evaluated once for all nodes.
    return F.transform(F.array(given), summed)[0]


def t_pvalue(t: Column, dof: Column) -> Column:
    """Two-sided p-value of a t statistic: P(|T| >= |t|).

    Null where t is null or NaN and where there is no positive number of degrees of freedom; 0 for infinite t.
    """
    t, dof = F.abs(t.cast("double")), dof.cast("double")
    ok = t.isNotNull() & ~F.isnan(t) & (dof > 0) & ~F.isnan(dof)
    first = F.log1p(t * t / dof) / 2
    tail = F.exp(-dof * first) * _integral(dof, first) / _integral(dof, F.lit(0.0))
    return F.when(ok & (t >= 1e150), F.lit(0.0)).when(ok, F.least(tail, F.lit(1.0)))


def pearson_t(r: Column, n: Column) -> Column:
    """t statistic of a Pearson correlation over ``n`` pairs (n - 2 degrees of freedom)."""
    rest = F.greatest(1 - r * r, F.lit(1e-300))
    return r * F.sqrt((n - 2) / rest)


def pooled_t(n1: Column, mean1: Column, ss1: Column, n2: Column, mean2: Column, ss2: Column) -> Column:
    """Equal-variance two-sample t from counts, means and centred sums of squares."""
    pooled = (ss1 + ss2) / F.nullif(n1 + n2 - 2, F.lit(0))
    scale = F.sqrt(F.greatest(pooled, F.lit(0.0)) * (1 / n1 + 1 / n2))
    return (mean1 - mean2) / F.nullif(scale, F.lit(0.0))


def paired_t(n: Column, mean_diff: Column, sd_diff: Column) -> Column:
    """Paired t from the mean and sample deviation of the differences."""
    return mean_diff / F.nullif(sd_diff / F.sqrt(n), F.lit(0.0))
