"""Descriptive statistics: moments, outliers, correlations, histograms, distributions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpoint


def unpivot(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Long form: keys, feature, value."""
    return df.unpivot([F.col(k) for k in keys], [F.col(c) for c in columns], "feature", "value")


def moments(long: DataFrame, sample: bool) -> DataFrame:
    """Per feature: n, mean, std (sample or population), min, q1, median, q3, max, skew, kurtosis (biased,
    excess; null for a constant)."""
    x = F.col("value")
    varied = F.stddev_pop(x) > 0
    one = long.groupBy("feature").agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        (F.stddev_samp(x) if sample else F.stddev_pop(x)).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.when(varied, F.skewness(x)).alias("skew"),
        F.when(varied, F.kurtosis(x)).alias("kurtosis"),
    )
    both = one.join(quantiles(long, [0.25, 0.5, 0.75]), "feature", "left")
    return both.select("feature", "n", "mean", "std", "min", *(F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))), "max", "skew", "kurtosis")


def quantiles(long: DataFrame, shares: list[float]) -> DataFrame:
    """Exact linear quantiles per feature as an array q, in the order of ``shares``; nulls are left out.

    Equal values are counted first, so one frequent value is one row; the distinct values are then dealt out
    by ranges, and only the ranges' counts meet in one place."""
    counts = long.where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    ranged = checkpoint(counts.repartitionByRange("feature", "value").withColumn("p", F.spark_partition_id()))
    sums = ranged.groupBy("feature", "p").agg(F.sum("c").alias("s"))
    upto = Window.partitionBy("feature").orderBy("p")
    starts = sums.select("feature", "p", (F.sum("s").over(upto) - F.col("s")).alias("start"), F.sum("s").over(Window.partitionBy("feature")).alias("n"))
    end = F.sum("c").over(Window.partitionBy("feature", "p").orderBy("value")) + F.col("start")
    rows = ranged.join(F.broadcast(starts), ["feature", "p"]).withColumn("end", end)

    def at(i):
        return F.max(F.when((i >= F.col("end") - F.col("c")) & (i < F.col("end")), F.col("value")))

    def one(share: float):
        place = (F.col("n") - 1) * F.lit(share)
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return rows.groupBy("feature").agg(F.array(*(one(s) for s in shares)).alias("q"))


def outliers(long: DataFrame) -> DataFrame:
    """Per feature: n, missing, outside the Tukey fences, |z| > 3 with the population std; features of
    fewer than four values have none. The statistics are one row per feature and joined back."""
    s = moments(long, sample=False).select("feature", "q1", "q3", "mean", "std", F.col("n").alias("known"))
    rows = long.join(s, "feature")
    x, spread = F.col("value"), 1.5 * (F.col("q3") - F.col("q1"))
    enough = F.col("known") >= 4
    tukey = enough & ((x < F.col("q1") - spread) | (x > F.col("q3") + spread))
    z = enough & (F.col("std") > 0) & (F.abs(x - F.col("mean")) > 3 * F.col("std"))
    return rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("missing"), F.count_if(tukey).alias("iqr_outliers"), F.count_if(z).alias("z_outliers"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (a, b, r) of all column pairs in one pass; null where a column is constant."""

    def r(a: str, b: str):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        return F.try_divide(F.covar_pop(x, y), F.when(spread > 0, spread))

    pairs = list(combinations(columns, 2))
    one = df.agg(*(r(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("p")).select("p.a", "p.b", "p.r")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share in percent of each value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def histogram(long: DataFrame, bins: int) -> DataFrame:
    """Equal-width counts per feature, the last bin closed; empty bins are left out."""
    ends = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = long.join(ends, "feature").where("value is not null")
    at = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("value") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))).otherwise(0)
    return rows.groupBy("feature", F.least(at, F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def varying_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with two values at least (nulls aside), in their order."""
    row = df.agg(*((F.min(c) < F.max(c)).alias(c) for c in columns)).head()
    return [c for c in columns if row[c]]
