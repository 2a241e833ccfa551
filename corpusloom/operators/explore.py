"""Exploratory statistics over metric tables: correlation, regressions, percentiles, histograms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import numbered, running_sum


def points(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows in which both are numbers."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.where(ok(x) & ok(y)).withColumn("x", F.col(x).cast("double")).withColumn("y", F.col(y).cast("double"))


def summary(df: DataFrame, column: str) -> DataFrame:
    """n, mean, variance, std, median. The median comes from counts per value, summed range by range, so no task holds all values."""
    c = F.col(column)
    flat = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("variance"), F.stddev_pop(c).alias("std"))
    up = running_sum(df.where(c.isNotNull()).groupBy(c.alias("v")).count(), "cum", "v", "count")
    lo, hi = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    middle = up.crossJoin(F.broadcast(flat.select("n"))).agg(F.min(F.when(F.col("cum") > lo, F.col("v"))).alias("lo"), F.min(F.when(F.col("cum") > hi, F.col("v"))).alias("hi"))  # one row
    return flat.crossJoin(F.broadcast(middle)).select("n", "mean", "variance", "std", (F.col("lo") * 0.5 + F.col("hi") * 0.5).alias("median"))  # one row


def correlation(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null without variance."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """r, r2 and strength (weak below 0.4, strong from 0.7); null below two points or without variance."""
    p = points(df, x, y).agg(F.count("*").alias("n"), correlation("x", "y").alias("r"))
    r = F.when(F.col("n") >= 2, F.col("r"))
    size = F.abs(r)
    return p.select("n", r.alias("r"), (r * r).alias("r2"), F.when(size >= 0.7, "strong").when(size >= 0.4, "moderate").when(size >= 0, "weak").alias("strength"))


def linear_fit(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """slope and intercept; a constant x gives slope 0 and the mean."""
    g = points(df, x, y).groupBy(*by).agg(F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("v"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    slope = F.when(F.col("v") == 0, 0.0).otherwise(F.col("c") / F.col("v"))
    return g.select(*by, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def quadratic_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """a + b x + c x^2 by least squares, on x shifted by its mean; the three normal equations by Cramer's rule."""
    p = points(df, x, y)
    mx = p.agg(F.avg("x").alias("m"))
    p = p.crossJoin(F.broadcast(mx)).withColumn("u", F.col("x") - F.col("m"))  # one row
    s = p.agg(F.first("m").alias("m"), F.count("*").cast("double").alias("s0"), *(F.sum(F.pow("u", k)).alias(f"s{k}") for k in range(1, 5)), *(F.sum(F.pow("u", k) * F.col("y")).alias(f"t{k}") for k in range(3)))
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))

    def det(a, b, c) -> Column:
        return a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])

    d = det((s0, s1, s2), (s1, s2, s3), (s2, s3, s4))
    a = det((t0, s1, s2), (t1, s2, s3), (t2, s3, s4)) / d
    b = det((s0, t0, s2), (s1, t1, s3), (s2, t2, s4)) / d
    c = det((s0, s1, t0), (s1, s2, t1), (s2, s3, t2)) / d
    m = F.col("m")
    return s.where(d != 0).select((a - b * m + c * m * m).alias("a"), (b - 2 * c * m).alias("b"), c.alias("c"))


def logistic_fit(df: DataFrame, x: str, y: str, rounds: int = 50) -> dict[str, float]:
    """A logistic curve through y scaled to 0..1: Newton steps on two sums of the data each."""
    p = points(df, x, y)
    lo, hi, mx, sx = p.agg(F.min("y"), F.max("y"), F.avg("x"), F.stddev_pop("x")).first()
    if lo is None or hi == lo:
        return {"low": lo, "high": hi, "b0": 0.0, "b1": 0.0}
    sx = sx or 1.0
    p = p.select(((F.col("x") - mx) / sx).alias("u"), F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), (F.col("y") - lo) / (hi - lo))).alias("t")).persist()
    w = np.zeros(2)
    try:
        for _ in range(rounds):
            q = 1 / (1 + F.exp(-(F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("u"))))
            v = q * (1 - q)
            g0, g1, h00, h01, h11 = p.agg(F.sum(F.col("t") - q), F.sum((F.col("t") - q) * F.col("u")), F.sum(v), F.sum(v * F.col("u")), F.sum(v * F.col("u") * F.col("u"))).first()
            step = np.linalg.solve(np.array([[h00, h01], [h01, h11]]) + np.eye(2) * 1e-9, [g0, g1])
            w += step
            if np.abs(step).max() < 1e-9:
                break
    finally:
        p.unpersist()
    return {"low": lo, "high": hi, "b0": float(w[0] - w[1] * mx / sx), "b1": float(w[1] / sx)}


def curve(fit: Column, lo: float, hi: float, spark, steps: int = 101) -> DataFrame:
    """Evenly spaced x and the fit there; ``fit`` is a column over x."""
    return spark.range(steps).select((F.lit(lo) + (F.lit(hi) - F.lit(lo)) * F.col("id") / (steps - 1)).alias("x")).withColumn("y", fit)


def residuals(df: DataFrame, x: str, y: str, key: str, k: int = 5) -> DataFrame:
    """The k greatest and k least absolute residuals of the line: kind, rank, key, residual."""
    p = points(df, x, y).crossJoin(F.broadcast(linear_fit(df, x, y)))  # one row
    r = p.withColumn("residual", F.col("y") - (F.col("intercept") + F.col("slope") * F.col("x"))).select(key, "residual")
    size = F.round(F.abs("residual"), 9)
    out = None
    for kind, order in (("greatest", size.desc()), ("least", size.asc())):
        top = r.orderBy(order, key).limit(k)
        part = top.withColumn("rank", F.row_number().over(Window.orderBy(order, key))).withColumn("kind", F.lit(kind))
        out = part if out is None else out.union(part)
    return out.select("kind", "rank", key, "residual")


def percentiles(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Adds percentile: the share of values not above, in per cent. Counts per value first, so the window sorts distinct values."""
    per = df.where(F.col(column).isNotNull()).groupBy(*by, column).count()
    if not by:
        total = per.agg(F.sum("count").alias("total"))
        cum = running_sum(per, "cum", column, "count").crossJoin(F.broadcast(total))  # one row
        return df.join(cum.select(column, (F.col("cum") / F.col("total") * 100).alias("percentile")), column)
    w = Window.partitionBy(*by)
    cum = F.sum("count").over(w.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("count").over(w) * 100
    return df.join(per.select(*by, column, cum.alias("percentile")), [*by, column])


def ecdf(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Steps of the empirical distribution: by, value, share of values not above, from 0 to 1."""
    p = percentiles(df.select(*by, column), column, *by)
    return p.groupBy(*by, column).agg((F.max("percentile") / 100).alias("share"))


def word_z_scores(df: DataFrame, value: str, word: str = "word", least: int = 3) -> DataFrame:
    """Adds z within each word (population deviation); words of fewer than ``least`` values or without spread go."""
    by = df.where(F.col(value).isNotNull()).groupBy(word).agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n"))
    by = by.where((F.col("n") >= least) & (F.col("sd") > 0))
    return df.join(by, word).withColumn("z", (F.col(value) - F.col("mu")) / F.col("sd")).drop("mu", "sd", "n")


def listed(df: DataFrame, label: str, value: str, search: str = "", order: str = "value_desc") -> DataFrame:
    """Rows whose label holds ``search`` in any case, without null values, with their place in one of four orders."""
    orders = {"value_desc": [F.desc(value), F.asc(label)], "value_asc": [F.asc(value), F.asc(label)], "name_asc": [F.asc(label)], "name_desc": [F.desc(label)]}
    some = df.where(F.col(value).isNotNull() & F.lower(label).contains(search.lower()))
    first = value if order.startswith("value") else label
    return numbered(some, "place", first, *orders[order][1:], descending=order.endswith("desc"))


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def normal_cdf(z: Column) -> Column:
    """By the error function's rational approximation with five terms."""
    # The published coefficients.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + p * x)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    erf = 1 - poly * F.exp(-x * x)
    return (1 + F.signum(z) * erf) / 2


def histogram(df: DataFrame, column: str, least: int = 10, most: int = 60) -> DataFrame:
    """bin, lo, hi, n, density; the width goes by deviation and count, bins are clamped."""
    c = F.col(column).cast("double")
    d = df.where(c.isNotNull()).select(c.alias("v"))
    s = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_pop("v").alias("sd"), F.count("*").alias("n"))
    width = 3.49 * F.col("sd") * F.pow("n", F.lit(-1 / 3))
    bins = F.when((width > 0) & (F.col("hi") > F.col("lo")), F.least(F.lit(most), F.greatest(F.lit(least), F.ceil((F.col("hi") - F.col("lo")) / width)))).otherwise(F.lit(least))
    s = s.withColumn("bins", bins).withColumn("w", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("bins")).otherwise(1.0))
    b = d.crossJoin(F.broadcast(s)).withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.col("bins") - 1))  # one row
    return b.groupBy("bin", "lo", "w", "n").agg(F.count("*").alias("c")).select(
        F.col("bin").cast("long"), (F.col("lo") + F.col("bin") * F.col("w")).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("hi"),
        F.col("c").alias("n"), (F.col("c") / (F.col("n") * F.col("w"))).alias("density"),
    )
