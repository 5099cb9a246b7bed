"""Distributions as columns, and paired tests of many groups in one plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commlens.functions.text import let
from commlens.operators.ranks import medians, running_total

#: Pairs up to which the signed-rank test is exact (without ties).
EXACT = 50
# Coefficients of Lanczos' approximation (g = 7).
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def ln_gamma(x: Column) -> Column:
    """ln of the gamma function, for x > 0.5."""

    def value(z: Column) -> Column:
        total = sum((F.lit(c) / (z + k) for k, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
        return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(z + 7.5) - (z + 7.5) + F.log(total)

    return let(x - 1, value)


def _fold(first: int, last: int, start: float, step) -> Column:
    """step(value, k) for k from first to last, either way."""
    return F.aggregate(F.sequence(F.lit(first), F.lit(last)), F.lit(start), lambda v, k: step(v, k.cast("double")))


def erfc(x: Column) -> Column:
    """The complementary error function, for x >= 0: a series near 0, a continued fraction beyond."""

    def value(x: Column) -> Column:
        # sum of 2**k x**(2k + 1) / (2k + 1)!!, from its end
        series = 2 / math.sqrt(math.pi) * F.exp(-x * x) * x * _fold(60, 1, 1.0, lambda v, k: 1 + v * 2 * x * x / (2 * k + 1))
        fraction = F.exp(-x * x) / math.sqrt(math.pi) / _fraction(x)
        return F.when(x < 2.5, 1 - series).otherwise(fraction)

    return let(x, value)


def _fraction(x: Column) -> Column:
    """x + (1/2) / (x + (2/2) / (x + ...))."""
    return let(F.aggregate(F.sequence(F.lit(80), F.lit(1)), x, lambda v, k: x + (k / 2) / v), lambda v: v)


def _beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function where x is small beside a / (a + b)."""

    def step(v: Column, m: Column) -> Column:
        k = F.floor(m / 2)
        even = k * (b - k) * x / ((a + m - 1) * (a + m))
        odd = -(a + k) * (a + b + k) * x / ((a + m - 1) * (a + m))
        return 1 + F.when(m % 2 == 0, even).otherwise(odd) / v

    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.log(x) + b * F.log(1 - x)) / a
    return front / _fold(200, 1, 1.0, step)


def t_above(t: Column, df: Column) -> Column:
    """P(T > t) of Student's t with df degrees of freedom (df >= 1), by a continued fraction."""

    def both(v: Column) -> Column:
        t, df = v["t"], v["df"]
        a, b, x = df / 2, F.lit(0.5), df / (df + t * t)
        # the tail of both sides; 1 - x is computed from t, so that a small t keeps its digits
        direct = _beta(a, b, x)
        other = 1 - _beta_tail(a, t * t / (df + t * t))
        tail = F.when(t == 0, 1.0).when(x < (a + 1) / (a + b + 2), direct).otherwise(other) / 2
        return F.when(t > 0, tail).otherwise(1 - tail)

    return let(F.struct(t.cast("double").alias("t"), df.cast("double").alias("df")), both)


def _beta_tail(a: Column, y: Column) -> Column:
    """I_y(1/2, a)."""
    # ln Gamma(1/2) is known, and the approximation of ln_gamma begins above it
    half = F.lit(0.5)

    def step(v: Column, m: Column) -> Column:
        k = F.floor(m / 2)
        even = k * (a - k) * y / ((half + m - 1) * (half + m))
        odd = -(half + k) * (a + half + k) * y / ((half + m - 1) * (half + m))
        return 1 + F.when(m % 2 == 0, even).otherwise(odd) / v

    front = F.exp(ln_gamma(a + half) - ln_gamma(a) - math.log(math.pi) / 2 + half * F.log(y) + a * F.log(1 - y)) / half
    return front / _fold(200, 1, 1.0, step)


def signed_rank_table(spark: SparkSession, most: int = EXACT) -> DataFrame:
    """n, ways: in how many of the 2**n sign patterns the positive ranks sum to 0, 1, 2, ...; a row for each n up to ``most``."""
    n = spark.range(1, most + 1).select(F.col("id").cast("int").alias("n"))
    none = F.transform(F.sequence(F.lit(0), (F.col("n") * (F.col("n") + 1) / 2).cast("int")), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    # with rank k each sum is reached as before, or from the sum k below
    ways = F.aggregate(F.sequence(F.lit(1), F.col("n")), none, lambda w, k: F.transform(w, lambda v, i: v + F.when(i >= k, F.get(w, (i - k).cast("int"))).otherwise(0.0)))
    return n.select("n", ways.alias("ways"))


def wilcoxon_by(df: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """groups, n_pairs, n, w, ties, median_difference, p_value of the paired signed-rank test of each group.

    Zero differences are dropped.  Up to ``EXACT`` pairs without ties the p-value is exact, by the null
    distribution; else it is the normal approximation with the variance of ties; where all
    differences are zero it is 1.  Rows with a null group are left out.  Ranks come from histograms by running totals, so no group
    is held by one task.
    """
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*groups, (F.col(a) - F.col(b)).cast("double").alias("d"))
    counts = d.where("d <> 0").groupBy(*groups, F.abs("d").alias("size")).agg(F.count_if(F.col("d") > 0).alias("plus"), F.count_if(F.col("d") < 0).alias("minus"))
    counts = counts.withColumn("t", F.col("plus") + F.col("minus"))
    placed = running_total(counts, [*groups, "size"], "t", "upto")
    # a rank is a place in all groups, less what stands before the group
    base = placed.groupBy(*groups).agg((F.min(F.struct("upto", "t"))).alias("first")).select(*groups, (F.col("first.upto") - F.col("first.t")).alias("before"))
    ranked = placed.join(base, groups)
    rank = F.col("upto") - F.col("before") - (F.col("t") - 1) / 2
    sums = ranked.groupBy(*groups).agg(
        F.sum(F.col("plus") * rank).alias("plus"), F.sum(F.col("minus") * rank).alias("minus"), F.sum("t").alias("n"), F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("ties"),
    )
    every = d.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_pairs"))
    out = every.join(sums, groups, "left").join(medians(d, groups, "d", "median_difference"), groups)
    out = out.withColumns({"n": F.coalesce("n", F.lit(0)), "w": F.coalesce(F.least("plus", "minus"), F.lit(0.0)), "ties": F.coalesce("ties", F.lit(0.0))})
    n = F.col("n").cast("double")
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    table = F.broadcast(signed_rank_table(df.sparkSession))  # a row for each n up to EXACT
    exact = 2 * F.aggregate(F.slice("ways", F.lit(1), F.floor("w").cast("int") + 1), F.lit(0.0), lambda s, v: s + v) / F.pow(F.lit(2.0), "n")
    p = F.when(F.col("n") == 0, 1.0).when((F.col("n") <= EXACT) & (F.col("ties") == 0), F.least(F.lit(1.0), exact)).otherwise(F.least(F.lit(1.0), erfc(F.abs(z) / math.sqrt(2))))
    return out.join(table.withColumnRenamed("n", "_n"), F.col("n") == F.col("_n"), "left").select(*groups, "n_pairs", "n", "w", "ties", "median_difference", p.alias("p_value"))


def tost_by(df: DataFrame, groups: list[str], a: str, b: str, margin: float = 0.4, alpha: float = 0.05) -> DataFrame:
    """groups, n_pairs, mean_difference, p_lower, p_upper, equivalent: two one-sided paired t-tests of each group.

    Without any spread (a single pair too) the mean is certain: both p are 0 inside the margin and 1 elsewhere.
    """
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*groups, (F.col(a) - F.col(b)).cast("double").alias("d"))
    n, mean = F.count(F.lit(1)), F.avg("d")
    x = d.groupBy(*groups).agg(n.alias("n_pairs"), mean.alias("mean_difference"), F.coalesce(F.stddev_samp("d") / F.sqrt(n), F.lit(0.0)).alias("se"))
    certain = F.when((F.col("mean_difference") > -margin) & (F.col("mean_difference") < margin), 0.0).otherwise(1.0)
    df_ = F.greatest(F.col("n_pairs") - 1, F.lit(1))
    safe = F.when(F.col("se") > 0, F.col("se"))
    lower, upper = t_above((F.col("mean_difference") + margin) / safe, df_), t_above(-(F.col("mean_difference") - margin) / safe, df_)
    out = x.withColumns({"p_lower": F.when(F.col("se") == 0, certain).otherwise(lower), "p_upper": F.when(F.col("se") == 0, certain).otherwise(upper)})
    return out.withColumn("equivalent", (F.col("p_lower") < alpha) & (F.col("p_upper") < alpha)).drop("se")
