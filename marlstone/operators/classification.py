"""Classification metrics from (y_true, y_pred) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .protocol import running


def per_class(pairs: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support over true or predicted labels; division by zero gives 0."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("y_pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("e"), (F.col("y_true") == F.col("y_pred")).cast("int").alias("hit"))
    c = ends.groupBy("e.label").agg(F.sum("e.t").alias("support"), F.sum("e.p").alias("predicted"), F.sum(F.col("hit") * F.col("e.t")).alias("hits"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.withColumn("precision", share(F.col("hits"), F.col("predicted"))).withColumn("recall", share(F.col("hits"), F.col("support")))
    f1 = share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return c.withColumn("f1", f1).select("label", "precision", "recall", "f1", "support")


def summary(pairs: DataFrame) -> DataFrame:
    """accuracy, macro and weighted averages, and micro scores where there are more than two classes."""
    c = per_class(pairs)
    weighted = lambda m: F.sum(F.col(m) * F.col("support")) / F.sum("support")
    means = c.agg(F.count(F.lit(1)).alias("classes"), *(F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")), *(weighted(m).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")))
    one = pairs.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy")).join(means)
    return one.withColumn("micro_f1", F.when(F.col("classes") > 2, F.col("accuracy")))


def one_vs_rest_auc(scores: DataFrame) -> DataFrame:
    """Rank statistic per class and its support. ``scores``: y_true, label, score (one row per item and class)."""
    own = F.count_if(F.col("y_true") == F.col("label"))
    counts = scores.groupBy("label", "score").agg(F.count(F.lit(1)).alias("c"), own.alias("own"))
    ranked = running(counts, ["label"], [F.col("score")], F.col("c"), "below")
    # average rank of the rows of one score
    rank = F.col("below") + (F.col("c") + 1) / 2
    c = ranked.groupBy("label").agg(F.sum("own").cast("double").alias("n"), F.sum(F.col("c") - F.col("own")).cast("double").alias("m"), F.sum(F.col("own") * rank).alias("ranks"))
    auc = F.try_divide(F.col("ranks") - F.col("n") * (F.col("n") + 1) / 2, F.col("n") * F.col("m"))
    return c.select("label", F.coalesce(auc, F.lit(0.0)).alias("auc"), F.col("n").cast("long").alias("support"))
