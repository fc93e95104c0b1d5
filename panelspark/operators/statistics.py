"""Balance and association tests. Sums come from Spark; tails are closed forms or short series as columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_LANCZOS = (76.18009172947146, -86.50532032941677, 24.01409824083091, -1.231739572450155, 0.001208650973866179, -0.000005395239384953)


def ln_gamma(x: Column) -> Column:
    """Natural log of the gamma function for x > 0 (Lanczos series)."""
    base = x + 5.5
    series = F.lit(1.000000000190015)
    for k, c in enumerate(_LANCZOS, 1):
        series = series + F.lit(c) / (x + k)
    return (x + 0.5) * F.ln(base) - base + F.ln(F.lit(math.sqrt(2 * math.pi)) * series / x)


def _gamma_density(a: Column, z: Column) -> Column:
    """z ** a * exp(-z) / gamma(a). For large a by Stirling's series, so that large logarithms don't cancel each other."""
    off = (z - a) / a
    star = 1 / (12 * a) - 1 / (360 * F.pow(a, F.lit(3.0))) + 1 / (1260 * F.pow(a, F.lit(5.0))) - 1 / (1680 * F.pow(a, F.lit(7.0)))
    large = F.exp(a * (F.log1p(off) - off) - star) * F.sqrt(a / F.lit(2 * math.pi))
    return F.when(a >= 10, large).otherwise(F.exp(a * F.ln(z) - z - ln_gamma(a)))


def chi2_tail(x: Column, df: Column) -> Column:
    """P(chi-square with df degrees exceeds x), for any x and df > 0.

    Up to the mean by the series of the lower incomplete gamma function, whose terms are all positive; beyond by the continued fraction
    of the upper one, whose small values keep their relative precision. Both take steps in proportion to the root of df.
    """
    a, z = df / F.lit(2.0), x / F.lit(2.0)
    steps = F.sequence(F.lit(1), F.ceil(F.sqrt(a) * 12).cast("int") + 80)
    start = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))
    term = lambda acc, k: acc["term"] * z / (a + k)
    lower = F.aggregate(steps, start, lambda acc, k: F.struct(term(acc, k).alias("term"), (acc["sum"] + term(acc, k)).alias("sum")))["sum"]
    first = z + 1 - a

    def fraction(acc: Column, k: Column) -> Column:
        top, bottom = -k * (k - a), first + 2 * k
        d, c = 1 / (top * acc["d"] + bottom), bottom + top / acc["c"]
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

    upper = F.aggregate(steps, F.struct(F.lit(1e300).alias("c"), (1 / first).alias("d"), (1 / first).alias("h")), fraction)["h"]
    density = _gamma_density(a, z)
    return F.when(x <= 0, 1.0).when(z < a + 1, F.greatest(1 - density * lower, F.lit(0.0))).otherwise(density * upper)


def t_tail(t: Column, df: Column, steps: int = 400) -> Column:
    """Two-sided P(|T| > t): Simpson's rule over the angle, in which the density is a power of the cosine."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    h = angle / steps
    weight = lambda k: F.when((k == 0) | (k == steps), 1).when(k % 2 == 1, 4).otherwise(2)
    area = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda s, k: s + weight(k) * F.pow(F.cos(k * h), df - 1)) * h / 3
    scale = F.exp(ln_gamma((df + 1) / 2) - ln_gamma(df / 2)) / F.sqrt(F.lit(math.pi))
    return F.greatest(1 - 2 * scale * area, F.lit(0.0))


def smd(df: DataFrame, flag: str, cols: list[str]) -> DataFrame:
    """Standardised mean difference of each column between rows with flag 1 and 0, with the pooled sample deviation."""
    def part(c: str) -> Column:
        one, nil = F.when(F.col(flag) == 1, F.col(c)), F.when(F.col(flag) == 0, F.col(c))
        pooled = F.sqrt((F.var_samp(one) + F.var_samp(nil)) / 2)
        return F.struct(F.lit(c).alias("column"), F.avg(one).alias("mean_1"), F.avg(nil).alias("mean_0"), F.when(pooled > 0, (F.avg(one) - F.avg(nil)) / pooled).alias("smd"))

    return df.agg(F.array(*map(part, cols)).alias("s")).select(F.inline("s"))


def association(df: DataFrame, by: list[str], group: str, flag: str, least: int = 20) -> DataFrame:
    """Chi-square test of a 0/1 flag against groups of at least ``least`` rows: statistic, df, p, Cramer's V, share of expected counts under 5.

    ``status``: ok, sparse (a fifth of the expected counts is under 5, or one under 1) or not_estimable.
    """
    cells = df.groupBy(*by, group).agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("long")).alias("ones")).filter(F.col("n") >= least)
    totals = cells.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.sum("n").alias("all_n"), F.sum("ones").alias("all_ones"))
    cells = cells.join(totals, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))) if by else cells.crossJoin(F.broadcast(totals))  # one row
    e1, e0 = F.col("n") * F.col("all_ones") / F.col("all_n"), F.col("n") * (F.col("all_n") - F.col("all_ones")) / F.col("all_n")
    chi = F.when(e1 > 0, F.pow(F.col("ones") - e1, F.lit(2.0)) / e1).otherwise(0.0) + F.when(e0 > 0, F.pow(F.col("n") - F.col("ones") - e0, F.lit(2.0)) / e0).otherwise(0.0)
    low = lambda edge: F.sum((e1 < edge).cast("int") + (e0 < edge).cast("int"))
    out = cells.groupBy(*by).agg(F.count("*").alias("n_groups"), F.max("all_n").alias("n"), F.max("all_ones").alias("ones"), F.sum(chi).alias("chi2"), low(5).alias("under_5"), low(1).alias("under_1"))
    able = (F.col("n_groups") > 1) & (F.col("ones") > 0) & (F.col("ones") < F.col("n"))
    status = F.when(~able, "not_estimable").when((F.col("under_5") > 0.2 * 2 * F.col("n_groups")) | (F.col("under_1") > 0), "sparse").otherwise("ok")
    out = out.withColumns({"df": F.col("n_groups") - 1, "status": status})
    return out.withColumns({"chi2": F.when(able, F.col("chi2")), "p_value": F.when(able, chi2_tail(F.col("chi2"), F.col("df"))), "cramers_v": F.when(able, F.sqrt(F.col("chi2") / F.col("n")))})


def _by_value(df: DataFrame, by: list[str], p: str, name: str, adjusted: Callable[[WindowSpec], Column]) -> DataFrame:
    """Adds ``name``: ``adjusted`` of each family's distinct p-values, with counts ``__n`` of a value, ``__below`` it and ``__m`` in all.

    Windows run over distinct values, so tied rows never gather in a family's task; rows take their value by a join.
    """
    keys = {c: f"__by{k}" for k, c in enumerate(by)}
    values = df.filter(F.col(p).isNotNull()).groupBy(*(F.col(c).alias(k) for c, k in keys.items()), F.col(p).alias("__p")).agg(F.count("*").alias("__n"))
    family = Window.partitionBy(*keys.values())
    below = F.coalesce(F.sum("__n").over(family.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumns({"__m": F.sum("__n").over(family), "__below": below})
    values = values.select(*keys.values(), "__p", adjusted(family).alias(name))
    rows = df.drop(name)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()), F.col(p) == F.col("__p"))
    return rows.join(values, same, "left").select(*rows.columns, name)


def benjamini_hochberg(df: DataFrame, by: list[str], p: str = "p_value", name: str = "q_value") -> DataFrame:
    """Adjusted p-values within groups; null ones stay null and don't count. Groups are families of tests."""
    q = F.col("__p") * F.col("__m") / (F.col("__below") + F.col("__n"))  # ties share the last rank
    return _by_value(df, by, p, name, lambda family: F.least(F.min(q).over(family.orderBy(F.desc("__p"))), F.lit(1.0)))


def holm(df: DataFrame, by: list[str], p: str = "p_value", name: str = "p_holm") -> DataFrame:
    q = F.col("__p") * (F.col("__m") - F.col("__below"))  # ties share the first rank, as its value is the largest of theirs
    return _by_value(df, by, p, name, lambda family: F.least(F.max(q).over(family.orderBy("__p")), F.lit(1.0)))


def clustered_difference(df: DataFrame, flag: str, y: str, cluster: str) -> DataFrame:
    """OLS of y on a 0/1 flag with cluster-robust errors: estimate, se, clusters, t, p (t with clusters - 1 degrees).

    Two passes of sums: means first, then each cluster's score sums; no rows are gathered. Small-sample factor
    G/(G-1) * (n-1)/(n-2).
    """
    rows = df.select(F.col(flag).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(cluster).alias("g")).dropna()
    total = rows.agg(F.count("*").alias("n"), F.sum("x").alias("n1"), F.avg(F.when(F.col("x") == 1, F.col("y"))).alias("m1"), F.avg(F.when(F.col("x") == 0, F.col("y"))).alias("m0"))
    e = F.col("y") - F.when(F.col("x") == 1, F.col("m1")).otherwise(F.col("m0"))
    scores = rows.crossJoin(F.broadcast(total)).groupBy("g", "n", "n1", "m1", "m0").agg(F.sum(e).alias("u0"), F.sum(e * F.col("x")).alias("u1"))
    n0 = F.col("n") - F.col("n1")
    influence = F.col("u1") / F.col("n1") - (F.col("u0") - F.col("u1")) / n0
    out = scores.groupBy("n", "n1", "m1", "m0").agg(F.count("*").alias("clusters"), F.sum(F.pow(influence, F.lit(2.0))).alias("v"))
    g = F.col("clusters")
    se = F.sqrt(F.col("v") * g / (g - 1) * (F.col("n") - 1) / (F.col("n") - 2))
    out = out.select((F.col("m1") - F.col("m0")).alias("estimate"), se.alias("se"), "clusters", "n")
    return out.withColumn("t", F.col("estimate") / F.col("se")).withColumn("p_value", t_tail(F.col("t"), F.col("clusters") - 1))
