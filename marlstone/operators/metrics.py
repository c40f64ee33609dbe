"""Ranking metrics from rank tables and relevance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hits(ranking: DataFrame, relevance: DataFrame, user: str = "user_id") -> DataFrame:
    """Ranking rows with hit (0/1) and n_relevant of the user (0 if none)."""
    flagged = ranking.join(relevance.select(user, "track_id", F.lit(1).alias("hit")), [user, "track_id"], "left")
    sizes = relevance.groupBy(user).agg(F.count(F.lit(1)).alias("n_relevant"))
    return flagged.join(sizes, user, "left").withColumns({"hit": F.coalesce("hit", F.lit(0)), "n_relevant": F.coalesce("n_relevant", F.lit(0))})


def label_hits(ranking: DataFrame, items: DataFrame, user: str = "user_id") -> DataFrame:
    """``hits`` where all other items of the user's own label are relevant: the labels of the ranked rows are
    compared and the label's count gives n_relevant, so no table of relevant pairs is made."""
    sizes = items.groupBy("genre").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    own = items.select(F.col("track_id").alias(user), "genre").join(sizes, "genre").withColumnRenamed("genre", "__own")
    rows = ranking.join(items.select("track_id", F.col("genre").alias("__genre")), "track_id").join(own, user)
    return rows.withColumn("hit", (F.col("__genre") == F.col("__own")).cast("int")).select(*ranking.columns, "hit", "n_relevant")


def ideal_dcg(n: Column) -> Column:
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))


def per_user(flagged: DataFrame, ks: tuple[int, ...] = (1, 5, 10), user: str = "user_id") -> DataFrame:
    """user, k, precision, recall, dcg, ndcg, ap. Precision divides by k whatever the list's length; nothing
    relevant gives 0; NDCG and AP compare with min(relevant, k)."""
    upto = Window.partitionBy(user).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = flagged.withColumn("so_far", F.sum("hit").over(upto)).withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks))))
    inside = (F.col("rank") <= F.col("k")).cast("int") * F.col("hit")
    sums = rows.groupBy(user, "k", "n_relevant").agg(
        F.sum(inside).alias("found"),
        F.sum(inside / F.log2(F.col("rank") + 1.0)).alias("dcg"),
        F.sum(inside * F.col("so_far") / F.col("rank")).alias("precisions"),
    )
    best = F.least("n_relevant", "k")
    some = F.col("n_relevant") > 0
    return sums.select(
        user,
        "k",
        (F.col("found") / F.col("k")).alias("precision"),
        F.when(some, F.try_divide("found", "n_relevant")).otherwise(0.0).alias("recall"),
        "dcg",
        F.when(some, F.try_divide(F.col("dcg"), ideal_dcg(best))).otherwise(0.0).alias("ndcg"),
        F.when(some, F.try_divide(F.col("precisions"), best)).otherwise(0.0).alias("ap"),
    )


def coverage(ranking: DataFrame, catalogue_size: int, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Distinct tracks in the first k of any user, over the catalogue."""
    rows = ranking.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where("rank <= k")
    return rows.groupBy("k").agg((F.countDistinct("track_id") / F.lit(catalogue_size)).alias("coverage"))


def available(value: Column) -> Column:
    return F.struct(F.lit("available").alias("status"), value.alias("value"), F.lit(None).cast("string").alias("reason_code"))


def unavailable(reason: str | Column) -> Column:
    return F.struct(F.lit("unavailable").alias("status"), F.lit(None).cast("double").alias("value"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason_code"))


def optional_mean(metric: Column) -> Column:
    """Mean if all are available; else one unavailable record, with the reason if there is just one."""
    reasons = F.collect_set(metric["reason_code"])
    all_there = F.bool_and(metric["status"] == "available")
    return F.when(all_there, available(F.avg(metric["value"]))).otherwise(unavailable(F.when(F.size(reasons) == 1, F.element_at(reasons, 1)).otherwise(F.lit("several_reasons"))))


def novelty(ranking: DataFrame, popularity: DataFrame, user: str = "user_id") -> DataFrame:
    """Mean of 1 - popularity over each user's list; a track without popularity is an error."""
    joined = ranking.join(popularity, "track_id", "left")
    value = F.when(F.col("popularity").isNull(), F.raise_error(F.concat(F.lit("no popularity: "), F.col("track_id"))).cast("double")).otherwise(1 - F.col("popularity"))
    return joined.groupBy(user).agg(F.avg(value).alias("novelty"))


def list_diversity(ranking: DataFrame, k: int, vectors: DataFrame, user: str = "user_id") -> DataFrame:
    """1 - mean pair cosine of the first k (lists of one: 1)."""
    from .ranking import dot

    top = ranking.where(F.col("rank") <= k).join(vectors, "track_id").select(user, "rank", "u")
    a, b = top.alias("a"), top.alias("b")
    pairs = a.join(b, (F.col(f"a.{user}") == F.col(f"b.{user}")) & (F.col("a.rank") < F.col("b.rank")))
    mean = pairs.groupBy(F.col(f"a.{user}").alias(user)).agg((1 - F.avg(dot(F.col("a.u"), F.col("b.u")))).alias("diversity"))
    return ranking.select(user).distinct().join(mean, user, "left").withColumn("diversity", F.coalesce("diversity", F.lit(1.0)))
