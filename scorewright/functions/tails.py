"""Tail probabilities and critical values.

The normal tail, the t tail and its critical values and the power of a t test are built-in expressions: quadratures whose nodes
are a literal array. The exact U distribution runs as Arrow batches over comparison rows, which are few, never over runs.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .numeric import col, let

# Nodes and weights of the quadrature of the normal tail; 20 give a relative error below 1e-11 for z up to 30.
_TAIL_NODES, _TAIL_WEIGHTS = np.polynomial.legendre.leggauss(20)


def normal_sf(z: Column | str) -> Column:
    """P(Z > z) for a standard normal Z.

    The tail is the density at |z| times the integral of exp(-|z| u - u^2 / 2) over u > 0, whose integrand has died
    away at u = 36 / (|z| + 4.2).
    """
    x = F.abs(col(z))
    half = F.lit(18.0) / (x + F.lit(4.2))
    rule = F.array(*[F.struct(F.lit(n + 1.0).alias("at"), F.lit(w).alias("weight"))
                     for n, w in zip(_TAIL_NODES.tolist(), _TAIL_WEIGHTS.tolist())])

    def add(total: Column, node: Column) -> Column:
        u = half * node["at"]
        return total + node["weight"] * F.exp(-u * (x + u * F.lit(0.5)))

    total = F.aggregate(rule, F.lit(0.0), add)
    tail = F.exp(-x * x * F.lit(0.5)) * F.lit(1.0 / math.sqrt(2.0 * math.pi)) * half * total
    return F.when(col(z) >= 0, tail).otherwise(F.lit(1.0) - tail)


#: Steps of Newton's method; three settle it nearly everywhere.
STEPS = 5
_WIDE_NODES, _WIDE_WEIGHTS = np.polynomial.legendre.leggauss(32)


def _rule() -> Column:
    """Nodes between 0 and 1 with their weights."""
    return F.array(*[F.struct(F.lit(n).alias("at"), F.lit(w).alias("weight"))
                     for n, w in zip(((_WIDE_NODES + 1) / 2).tolist(), (_WIDE_WEIGHTS / 2).tolist())])


def _quadrature(body) -> Column:
    return F.aggregate(_rule(), F.lit(0.0), lambda total, node: total + node["weight"] * body(node["at"]))


def _sine_power(sine: Column, df: Column) -> Column:
    """The integral of (sin x / sin a)^(df - 1) from 0 to the angle a between 0 and pi / 2 whose sine is given.

    It starts where the integrand is below 1e-17, or at 0. The nodes go by the cube, so that an integrand that starts like a
    root of x is smooth in them.
    """
    top = F.asin(F.least(sine, F.lit(1.0)))
    low = F.asin(F.least(sine, F.lit(1.0)) * F.exp(F.lit(-39.0) / F.greatest(df - F.lit(1.0), F.lit(1e-9))))

    def at(node: Column) -> Column:
        x = low + (top - low) * node * node * node
        return node * node * F.exp((df - F.lit(1.0)) * F.ln(F.sin(x) / sine))

    return F.lit(3.0) * (top - low) * _quadrature(at)


def _log_t_sf(t: Column, df: Column, whole: Column) -> Column:
    """Log of P(T > t) for t >= 0; with t = sqrt(df) cot x the density is a power of sin x. whole: the integral up to pi / 2."""
    grown = F.lit(1.0) + t * t / df
    return let(F.lit(1.0) / F.sqrt(grown), lambda sine: F.ln(F.lit(0.5) * _sine_power(sine, df) / whole)) - (
        df - F.lit(1.0)) / F.lit(2.0) * F.log1p(t * t / df)


def t_sf(t: Column | str, df: Column | str) -> Column:
    """P(T > t) for Student's t; null without a t or degrees of freedom."""
    def tail(v: Column) -> Column:
        x, sign = F.abs(col(t)), col(t) >= 0
        one = F.exp(_log_t_sf(x, v, _sine_power(F.lit(1.0), v)))
        return F.when(sign, one).otherwise(F.lit(1.0) - one)

    return F.when(col(t).isNotNull() & (col(df) > 0), let(col(df).cast("double"), tail))


def t_critical(df: Column | str, confidence: float = 0.95) -> Column:
    """Two-sided critical value of Student's t for whole degrees of freedom (others are cut), null below 1.

    Newton's method for the log of the tail as a function of the log of t, which is a line for few degrees of freedom. It starts
    from the exact value for 1 and 2 of them and from the normal value corrected by powers of their inverse for more.
    """
    alpha = (1.0 - confidence) / 2.0
    z = NormalDist().inv_cdf(1.0 - alpha)
    terms = [z, (z ** 3 + z) / 4, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96, (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384]

    def solve(v: Column) -> Column:
        def search(whole: Column) -> Column:
            def step(y: Column, _: Column) -> Column:
                def better(found: Column) -> Column:
                    log_density = -(v + F.lit(1.0)) / F.lit(2.0) * F.log1p(F.exp(F.lit(2.0) * y) / v) - F.ln(F.lit(2.0) * F.sqrt(v) * whole)
                    return y + (found - F.lit(math.log(alpha))) * F.exp(found - log_density - y)

                return let(_log_t_sf(F.exp(y), v, whole), better)

            near = F.lit(terms[0]) + (F.lit(terms[1]) + (F.lit(terms[2]) + F.lit(terms[3]) / v) / v) / v
            start = (F.when(v == 1, F.lit(1.0 / math.tan(math.pi * alpha)))
                     .when(v == 2, F.lit((1 - 2 * alpha) * math.sqrt(1 / (2 * alpha * (1 - alpha))))).otherwise(near))
            return F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.ln(start), step))

        return let(_sine_power(F.lit(1.0), v), search)

    return F.when(col(df) >= 1, let(F.floor(col(df).cast("double")).cast("double"), solve))


def post_hoc_power(d: Column | str, n1: Column | str, n2: Column | str, alpha: float = 0.05) -> Column:
    """Power of a two-sided two-sample t test; alpha where there is no effect or too little data.

    The noncentral t beyond the critical value: the normal tail beyond it, averaged over the density of the scale s (s^2 df is chi
    squared), which has its weight within 12 spreads of 1.
    """
    a, b = col(n1).cast("double"), col(n2).cast("double")
    shift = F.abs(col(d)) * F.sqrt(a * b / (a + b))

    def average(c: Column) -> Column:
        v, critical, delta = c["df"], c["critical"], c["delta"]
        width = F.lit(12.0) / F.sqrt(F.lit(2.0) * v)
        low, high = F.greatest(F.lit(1e-12), F.lit(1.0) - width), F.lit(1.0) + width

        def add(sums: Column, node: Column) -> Column:
            s = low + (high - low) * node["at"]
            weight = node["weight"] * F.exp((v - F.lit(1.0)) * F.ln(s) - v * (s * s - F.lit(1.0)) / F.lit(2.0))
            beyond = normal_sf(critical * s - delta) + normal_sf(critical * s + delta)
            return F.struct((sums["all"] + weight).alias("all"), (sums["hit"] + weight * beyond).alias("hit"))

        start = F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("hit"))
        return F.least(F.lit(1.0), let(F.aggregate(_rule(), start, add), lambda g: g["hit"] / g["all"]))

    case = F.struct((a + b - F.lit(2.0)).alias("df"), t_critical(a + b - F.lit(2.0), 1.0 - alpha).alias("critical"), shift.alias("delta"))
    return F.when((a >= 2) & (b >= 2) & (F.abs(col(d)) >= 1e-10), let(case, average)).otherwise(F.lit(float(alpha)))


def u_distribution(m: int, n: int) -> np.ndarray:
    """Number of arrangements of m and n items per value of U, as exact floats."""
    size = m * n + 1
    counts = np.zeros(size)
    counts[0] = 1.0
    for i in range(1, m + 1):
        up = n + i
        if up < size:
            counts[up:] = counts[up:] - counts[:-up].copy()
        for start in range(i):
            counts[start::i] = np.cumsum(counts[start::i])
    return counts


@F.pandas_udf(DoubleType())
def exact_u_sf(u: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
    """P(U >= floor(u)) without ties; null sizes give null."""
    cache: dict[tuple[int, int], np.ndarray] = {}
    out = []
    for stat, a, b in zip(u, m, n):
        if pd.isna(stat) or pd.isna(a) or pd.isna(b):
            out.append(None)
            continue
        key = (int(min(a, b)), int(max(a, b)))
        if key not in cache:
            counts = u_distribution(*key)
            cache[key] = np.cumsum(counts[::-1])[::-1] / counts.sum()
        out.append(float(cache[key][min(int(stat), key[0] * key[1])]))
    return pd.Series(out, index=u.index, dtype="object")
