"""Paired tests, effect sizes, corrections and resampling intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .protocol import running


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: a series with positive terms, from 2.5 on a continued fraction."""
    step = lambda s, n: F.struct((s["t"] * 2 * x * x / (2 * n + 1)).alias("t"), (s["sum"] + s["t"] * 2 * x * x / (2 * n + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("sum")), step, lambda s: s["sum"])
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), x, lambda f, n: x + n / 2 / f)
    scale = F.exp(-x * x) / math.sqrt(math.pi)
    return F.when(x < 2.5, 1 - 2 * scale * series).otherwise(scale / fraction)


def normal_p(z: Column) -> Column:
    """Two-sided p of a z value."""
    return erfc(F.abs(z) / math.sqrt(2))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's method."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def half(s, aa):
        """One term; packs c, d and the value."""
        d, c = 1 / safe(1 + aa * s["d"]), safe(1 + aa / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    def step(s, n):
        m = F.floor(n / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return half(s, F.when(n % 2 == 0, even).otherwise(odd))

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(2), F.lit(600)), start, step, lambda s: s["h"])


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t: the regularised incomplete beta function of df / (df + t^2) at (df / 2, 1/2)."""
    t, n = t.cast("double"), df.cast("double")
    a, x = n / 2, n / (n + t * t)
    y = t * t / (n + t * t)
    # ln of gamma(a + 1/2) / gamma(a): asymptotic from a + 8 on, stepped down to a
    z = a + 8
    ratio = F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * z * z * z) - 1 / (640 * F.pow(z, F.lit(5.0))) + 17 / (14336 * F.pow(z, F.lit(7.0)))
    for i in range(8):
        ratio = ratio - F.log((a + i + 0.5) / (a + i))
    front = F.exp(a * F.log1p(-y) + F.log(y) / 2 + ratio) / math.sqrt(math.pi)
    near = front / a * _beta_fraction(a, F.lit(0.5), x)
    far = 1 - front / 0.5 * _beta_fraction(F.lit(0.5), a, y)
    p = F.when(y == 0, 1.0).when(x < (a + 1) / (a + 2.5), near).otherwise(far)
    return F.when(t.isNotNull() & (n > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def paired_t(diffs: DataFrame, by: list[str], d: str = "d") -> DataFrame:
    """n, mean, std (ddof 1), Cohen's d, t and its two-sided p_value with n - 1 degrees of freedom. No spread:
    d and t are 0 and p is 1 for no difference, else all are null (undefined)."""
    x = F.col(d)
    one = diffs.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    flat = F.col("std") == 0
    cohen = F.when(flat & (F.col("mean") == 0), 0.0).when(~flat, F.try_divide("mean", "std"))
    rows = one.withColumn("cohens_d", cohen).withColumn("t", F.col("cohens_d") * F.sqrt("n"))
    return rows.withColumn("p_value", student_p(F.col("t"), F.col("n") - 1))


def wilcoxon_pratt(diffs: DataFrame, by: list[str], d: str = "d") -> DataFrame:
    """Signed ranks with Pratt's zeros: zeros are ranked, then dropped. Average ranks, normal
    approximation without continuity correction. n, zeros, w_plus, w_minus, z, r = z / sqrt(n), direction
    (sign of the median, of the mean where that is 0), and the two-sided p_value of z.

    Equal sizes of difference are counted first; ranks come from running counts, so no task ranks a group."""
    x, size = F.col(d), F.abs(d)
    known = diffs.where(x.isNotNull())
    counts = known.groupBy(*by, size.alias("__size")).agg(F.count(F.lit(1)).alias("__t"), F.count_if(x > 0).alias("__plus"), F.count_if(x < 0).alias("__minus"))
    ranked = running(counts, by, [F.col("__size")], F.col("__t"), "__below")
    rank, t = F.col("__below") + (F.col("__t") + 1) / 2, F.col("__t").cast("double")
    nonzero = F.col("__size") != 0
    s = ranked.groupBy(*by).agg(
        F.sum("__t").alias("n"),
        F.coalesce(F.sum(F.when(~nonzero, F.col("__t"))), F.lit(0)).alias("zeros"),
        F.sum(F.col("__plus") * rank).alias("w_plus"),
        F.sum(F.col("__minus") * rank).alias("w_minus"),
        F.coalesce(F.sum(F.when(nonzero, t * t * t - t)), F.lit(0.0)).alias("__ties"),
    )
    s = s.join(known.groupBy(*by).agg(F.percentile(d, F.lit(0.5)).alias("__median"), F.avg(d).alias("__mean")), by)
    n, z0 = F.col("n").cast("double"), F.col("zeros").cast("double")
    mean = n * (n + 1) / 4 - z0 * (z0 + 1) / 4
    var = (n * (n + 1) * (2 * n + 1) - z0 * (z0 + 1) * (2 * z0 + 1) - F.col("__ties") / 2) / 24
    z = F.try_divide(F.least("w_plus", "w_minus") - mean, F.sqrt(F.when(var > 0, var)))
    direction = F.when(F.col("__median") != 0, F.signum("__median")).otherwise(F.signum("__mean")).cast("int")
    rows = s.withColumn("z", z).withColumn("r", F.abs("z") / F.sqrt("n") * direction).withColumn("direction", direction)
    return rows.withColumn("p_value", normal_p(F.col("z"))).drop("__ties", "__median", "__mean")


def bonferroni(p: Column, family: Window) -> Column:
    return F.least(F.lit(1.0), p * F.count(F.lit(1)).over(family))


def benjamini_hochberg(df: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """Step-up adjusted p over the whole family; ties in p share the largest rank."""
    whole = Window.partitionBy(*family)
    rank = F.row_number().over(whole.orderBy(p))
    scaled = df.withColumn("__q", F.col(p) * F.count(F.lit(1)).over(whole) / rank)
    onwards = whole.orderBy(p).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return scaled.withColumn("adjusted", F.least(F.lit(1.0), F.min("__q").over(onwards))).drop("__q")


def cliffs_delta(values: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """(greater - smaller) / (n m), from ranks over both samples, without pairing them."""
    both = values.where(F.col(group).isin(first, second))
    counts = both.groupBy(value).agg(F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) == second).alias("b"))
    below = running(counts.where(F.col(value).isNotNull()), [], [F.col(value)], F.col("b"), "b_below")
    sums = below.agg(F.sum("a").alias("n"), F.sum("b").alias("m"), F.sum(F.col("a") * (2 * F.col("b_below") + F.col("b"))).alias("twice"))
    # greater pairs less smaller ones: a (b_below - b_above), with b_above = m - b_below - b
    return sums.select(F.try_divide(F.col("twice") - F.col("n") * F.col("m"), F.col("n") * F.col("m")).alias("delta"))


def hash_draws(values: DataFrame, by: list[str], n_draws: int, seed: int = 42) -> DataFrame:
    """Bootstrap draws (*by, b, position, ix): position p of draw b takes index sha256("seed:b:p") mod n of its
    group, one position for each value. The same for groups of one size, so their intervals are aligned.
    ``values`` has ix from 0, dense in each group; the draws are made where the values are."""
    sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rows = values.select(*by, F.col("ix").alias("position")).join(F.broadcast(sizes), by)
    rows = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    number = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "b", "position"), 256), 1, 12), 16, 10).cast("long")
    return rows.select(*by, "b", "position", (number % F.col("n")).alias("ix"))


def bootstrap_interval(values: DataFrame, by: list[str], statistic: Column, n_draws: int = 200, seed: int = 42) -> DataFrame:
    """2.5 and 97.5 linear percentiles of ``statistic`` over hash draws; ``values`` has by, ix, value. The values
    are the hashed side: Spark takes the exploded draws for as small as the values and would broadcast them."""
    drawn = hash_draws(values, by, n_draws, seed).join(values.hint("shuffle_hash"), [*by, "ix"]).groupBy(*by, "b").agg(statistic.alias("s"))
    return drawn.groupBy(*by).agg(F.percentile("s", F.lit(0.025)).alias("low"), F.percentile("s", F.lit(0.975)).alias("high"))


def compare_models(diffs: DataFrame, by: list[str], test: str = "wilcoxon", correction: str | None = None) -> DataFrame:
    """Paired comparison by ``test`` ("wilcoxon" or "t"). A correction is refused here: it needs the whole
    family (``benjamini_hochberg``, ``bonferroni``), not one pair."""
    if correction is not None:
        raise ValueError("correct the whole family of comparisons, not single pairs")
    if test not in ("wilcoxon", "t"):
        raise ValueError(f"unknown test: {test}")
    return (wilcoxon_pratt if test == "wilcoxon" else paired_t)(diffs, by)
