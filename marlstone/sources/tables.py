"""The driver's tables as the engine's domain: tracks, interactions, vectors, paths, users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, title, artist, genre, duration, price."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("track_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("genre"),
        F.col("p_size").cast("double").alias("duration"),
        F.col("p_retailprice").alias("price"),
    )


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and track_id of every line of an order, as numbers, repeats included."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("track_id"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, track_id, score, rating, ts; unique on (user_id, track_id)."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    unique = joined.groupBy("o_custkey", "l_partkey").agg((F.max("l_quantity") / 50).alias("score"), F.min("l_shipdate").alias("ts"))
    rating = F.greatest(F.lit(1), F.least(F.lit(5), F.floor(1 + 4 * F.col("score")).cast("int")))
    return unique.select(F.col("o_custkey").cast("string").alias("user_id"), F.col("l_partkey").cast("string").alias("track_id"), "score", rating.alias("rating"), "ts")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, grp (market segment), nation, region, balance."""
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_mktsegment").alias("grp"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("c_acctbal").alias("balance"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, vec (array of doubles), genre (the label as text)."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("track_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("genre"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each user's path: track_id, ts, event_id, value, k (from props), event_type."""
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("track_id"), "ts", "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), "event_type")
