"""The evaluation protocol: ids, seeds, hash splits, candidates, relevance, withheld items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpoint
from .ranking import first_by

SEED, TEST_SHARE = 42, 0.15


def normalise_id(c: Column) -> Column:
    """Trimmed; digits lose leading zeros; an empty or negative id is an error."""
    text = F.trim(c)
    digits = F.regexp_replace(text, "^0+(?=[0-9])", "")
    bad = (text == "") | text.rlike("^-[0-9]+$")
    return F.when(bad, F.raise_error(F.concat(F.lit("bad id: "), F.coalesce(c, F.lit("")))).cast("string")).when(text.rlike("^[0-9]+$"), digits).otherwise(text)


def user_seed(seed: int, user: Column) -> Column:
    """First eight bytes, big-endian, of SHA-256 of "seed:user", as decimal digits."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), user), 256), 1, 16), 16, 10)


def hash_order(seed: int, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256)


def positions(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Adds dense positions from 0 in the given order. Ranges of the order are numbered apart and only their
    counts meet in one task, so no task holds the table."""
    ranged = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    ranged = checkpoint(ranged)  # the ranges are drawn once, for rows and counts alike
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    nth = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return ranged.withColumn("__nth", nth).join(F.broadcast(starts), "__p").withColumn(name, F.col("__start") + F.col("__nth")).drop("__p", "__nth", "__start")


def running(df: DataFrame, by: list[str], order: list[Column], amount: Column, name: str = "before") -> DataFrame:
    """Adds the sum of ``amount`` over the rows that come before in the given order, within each group of ``by``
    (not null). Groups are cut by ranges of the order and only the ranges' sums meet, so no task holds a
    group. The order has to be total, or rows that tie have to be equal."""
    ranged = checkpoint(df.withColumn("__a", amount).repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "__p").agg(F.sum("__a").alias("__s"))
    upto = F.sum("__s").over(Window.partitionBy(*by).orderBy("__p"))
    starts = sums.select(*by, "__p", (upto - F.col("__s")).alias("__start"))
    before = Window.partitionBy(*by, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("__own", F.coalesce(F.sum("__a").over(before), F.lit(0)))
    return rows.join(starts, [*by, "__p"]).withColumn(name, F.col("__start") + F.col("__own")).drop("__a", "__p", "__start", "__own")


def index_map(ids: DataFrame, column: str) -> DataFrame:
    """Dense positions from 0 in code-point order."""
    return positions(ids.select(column).distinct(), F.col(column))


def hash_split(interactions: DataFrame, seed: int = SEED, share: float = TEST_SHARE) -> DataFrame:
    """Adds split: per user the first floor(share n) in hash order are test, the next validation, the rest
    train. Users for whom a part would be empty are left out."""
    order = Window.partitionBy("user_id").orderBy(hash_order(seed, F.col("user_id"), F.col("track_id")), "track_id")
    cut = F.floor(F.lit(share) * F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    numbered = interactions.withColumn("__rn", F.row_number().over(order)).withColumn("__cut", cut).where("__cut >= 1")
    split = F.when(F.col("__rn") <= F.col("__cut"), "test").when(F.col("__rn") <= 2 * F.col("__cut"), "validation").otherwise("train")
    return numbered.withColumn("split", split).drop("__rn", "__cut")


def query_items(observed: DataFrame) -> DataFrame:
    """The query track of each user: largest score, then smallest id."""
    return first_by(observed, ["user_id"], F.desc("score"), F.asc("track_id"))


#: Rows of the head of a ranking that are broadcast, at most (some 50 bytes each).
BROADCAST_HEAD = 500_000


def unobserved_topk(scored_items: DataFrame, observed: DataFrame, k: int) -> DataFrame:
    """Top k unobserved items of each user under one score for all users.

    A user with n observed items finds them among the first n + k of the common ranking, so those
    ranks are joined and nothing else. All users want the first ranks: the head of the ranking that any
    of them can reach goes to every task where it is small enough, else ranks are joined by a shuffle."""
    ranked = positions(scored_items.select("track_id", "score"), F.desc("score"), F.asc("track_id"), name="place")
    ranked = ranked.withColumn("place", (F.col("place") + 1).cast("int"))
    need = observed.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    reach = (need.agg(F.max("n")).head()[0] or 0) + k
    head = ranked.where(F.col("place") <= reach)
    if reach <= BROADCAST_HEAD:
        head = F.broadcast(head)
    places = need.select("user_id", F.explode(F.sequence(F.lit(1), (F.col("n") + k).cast("int"))).alias("place"))
    open_ = places.join(head, "place").join(observed.select("user_id", "track_id"), ["user_id", "track_id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("place"))
    return open_.withColumn("rank", nth).where(F.col("rank") <= k).select("user_id", "rank", "track_id", "score")


def cold_items(catalogue: DataFrame, seed: int = SEED, share: float = TEST_SHARE) -> DataFrame:
    """The floor(share n) tracks of the catalogue that come first in hash order."""
    n = catalogue.select(F.floor(F.lit(share) * F.count(F.lit(1))).alias("n")).head()["n"]
    key = hash_order(seed, F.lit("cold"), F.col("track_id"))
    return catalogue.select("track_id").orderBy(key, "track_id").limit(int(n))


def withhold(split: DataFrame, cold: DataFrame) -> DataFrame:
    """Every interaction with a cold track becomes test."""
    flagged = split.join(cold.select("track_id", F.lit(True).alias("cold")), "track_id", "left")
    return flagged.withColumn("split", F.when(F.col("cold"), "test").otherwise(F.col("split"))).withColumn("cold", F.coalesce("cold", F.lit(False)))
