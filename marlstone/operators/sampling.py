"""Quotas, balanced samples, folds and sub-samples, all by hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .protocol import hash_order, positions, running


def hamilton(capacities: DataFrame, places: int, name: str = "genre", capacity: str = "capacity") -> DataFrame:
    """Largest-remainder shares of ``places`` by capacity: floors, then one more each in order of
    (fraction descending, name). With places at most the sum of capacities no floor exceeds its capacity and
    fewer places than names are left, so the one round is all there is, except that a full name passes its
    turn on."""
    whole = Window.partitionBy()
    exact = F.lit(places) * F.col(capacity) / F.sum(capacity).over(whole)
    c = capacities.withColumn("__exact", exact).withColumn("__floor", F.floor("__exact").cast("long"))
    c = c.withColumn("__open", (F.col("__floor") < F.col(capacity)).cast("int"))
    order = whole.orderBy(F.desc("__open"), F.desc(F.col("__exact") - F.col("__floor")), name)
    left = F.lit(places) - F.sum("__floor").over(whole)
    extra = (F.col("__open") == 1) & (F.row_number().over(order) <= left)
    return c.withColumn("quota", F.col("__floor") + extra.cast("long")).drop("__exact", "__floor", "__open")


def genre_quotas(capacities: DataFrame, target: int, base: int = 100) -> DataFrame:
    """min(base, capacity) each, the rest by Hamilton on what is left; all by Hamilton if the bases are too
    many."""
    sums = capacities.agg(F.sum("capacity").alias("all"), F.sum(F.least(F.lit(base), "capacity")).alias("bases")).head()
    if sums["all"] is None or sums["all"] < target:
        raise ValueError("capacity is below the target")
    if sums["bases"] > target:
        return hamilton(capacities, target)
    own = F.least(F.lit(base), "capacity")
    rest = capacities.withColumn("base", own).withColumn("residual", F.col("capacity") - own)
    shared = hamilton(rest.where("residual > 0"), target - sums["bases"], capacity="residual").select("genre", F.col("quota").alias("more"))
    return rest.join(shared, "genre", "left").select("genre", "capacity", (F.col("base") + F.coalesce("more", F.lit(0))).alias("quota"))


def fill_quotas(candidates: DataFrame, quotas: DataFrame, seed: int = 42) -> DataFrame:
    """Candidates (track_id, genre, ok) in hash order: the first ``quota`` that succeed of each genre, then
    for what is missing the next successes of any genre in one global hash order. One pass, no loop."""
    good = candidates.where("ok").join(quotas.select("genre", "quota"), "genre")
    own = running(good, ["genre"], [hash_order(seed, F.col("genre"), F.col("track_id")), F.col("track_id")], F.lit(1), "nth")
    placed = own.withColumn("primary", F.col("nth") < F.col("quota"))
    missing = quotas.agg(F.sum("quota").alias("want")).join(placed.agg(F.count_if("primary").alias("have")))
    filled = running(placed, ["primary"], [hash_order(seed, F.lit("global"), F.col("track_id")), F.col("track_id")], F.lit(1), "place").join(F.broadcast(missing))
    return filled.where(F.col("primary") | (F.col("place") < F.col("want") - F.col("have"))).select("track_id", "genre", "primary")


def balanced_sample(tracks: DataFrame, n: int, least: int, seed: int = 42) -> DataFrame:
    """``least`` of every genre that has as many, then round-robin over the genres, to n tracks."""
    counts = tracks.groupBy("genre").count().where(F.col("count") >= least).select("genre")
    rows = tracks.join(counts, "genre", "left_semi")
    rows = running(rows, ["genre"], [hash_order(seed, F.col("genre"), F.col("track_id")), F.col("track_id")], F.lit(1), "nth")
    first = F.when(F.col("nth") < least, 0).otherwise(F.col("nth"))
    return rows.orderBy(first, hash_order(seed, F.col("genre")), "nth").limit(n).select("track_id", "genre")


def stratified_folds(rows: DataFrame, label: str, item: str, k: int, seed: int = 42) -> DataFrame:
    return running(rows, [label], [hash_order(seed, F.col(item)), F.col(item)], F.lit(1), "nth").withColumn("fold", F.col("nth") % k).drop("nth")


def shuffled_folds(rows: DataFrame, item: str, k: int, seed: int = 42) -> DataFrame:
    """Equal folds in hash order; the last takes the remainder."""
    placed = positions(rows, hash_order(seed, F.col(item)), F.col(item), name="__place")
    size = max(1, rows.count() // k)
    return placed.withColumn("fold", F.least(F.floor(F.col("__place") / size), F.lit(k - 1)).cast("long")).drop("__place")


def time_split(rows: DataFrame, order: list, by: list[str], test_share: float = 0.2) -> DataFrame:
    """The first floor(n (1 - share)) rows in time train, the rest test, per group."""
    nth = running(rows, by, [F.col(c) for c in order], F.lit(1), "nth")
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    train = F.col("nth") < F.floor(F.col("n") * F.lit(1 - test_share))
    return nth.join(n, by).withColumn("part", F.when(train, "train").otherwise("test")).drop("nth", "n")


def subsamples(users: DataFrame, sizes: list[int], seeds: list[int], item: str = "user_id") -> DataFrame:
    """(size, seed, item): the first ``size`` in each seed's hash order."""
    rows = users.select(item).withColumn("seed", F.explode(F.array(*(F.lit(s) for s in seeds))))
    rows = running(rows, ["seed"], [F.sha2(F.concat_ws(":", "seed", item), 256), F.col(item)], F.lit(1), "nth").where(F.col("nth") < max(sizes))
    return rows.withColumn("size", F.explode(F.array(*(F.lit(s) for s in sizes)))).where("nth < size").select("size", "seed", item)
