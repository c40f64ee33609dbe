"""File scans with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACK_FILE = "schema_version int, record_type string, provenance map<string,string>, tracks array<struct<track_id:string,title:string,artist:string,genre:string,duration:double,path:string>>"
RANKING_ROW = "method string, seed int, user_id string, query_track_id string, recommendations array<string>, relevance_ids array<string>, metrics struct<precision:map<string,double>>"
METADATA = "track_id string, subset string, genre string, title string, duration double, artist string"


def metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """A metadata CSV with two header rows (group, field) and the track id first, as ``METADATA``.

    The columns are found by both header rows; rows that are headers are recognised by content, so the
    file may be split and in any order."""
    raw = spark.read.option("multiLine", False).csv(path)
    heads = spark.read.text(path).limit(3).collect()
    import csv

    groups, fields = (next(csv.reader([h["value"]])) for h in heads[:2])
    at = {pair: f"_c{i}" for i, pair in enumerate(zip(groups, fields, strict=False))}
    want = [("set", "subset"), ("track", "genre_top"), ("track", "title"), ("track", "duration"), ("artist", "name")]
    if missing := [w for w in want if w not in at]:
        raise ValueError(f"missing columns: {missing}")
    names = ["subset", "genre", "title", "duration", "artist"]
    out = raw.select(F.trim("_c0").alias("track_id"), *(F.col(at[w]).alias(n) for w, n in zip(want, names, strict=True)))
    return out.where(F.col("track_id").rlike("^[0-9]+$")).withColumn("duration", F.expr("try_cast(duration as double)"))


def selected_tracks(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Version 2 track files (one document per file, or per line), one row per track; another version or
    repeated ids are an error."""
    file = spark.read.schema(TRACK_FILE).option("multiLine", one_per_file).json(path)
    good = F.when((F.col("schema_version") == 2), True).otherwise(F.raise_error(F.lit("schema_version must be 2")).cast("boolean"))
    rows = file.where(good).select(F.explode("tracks").alias("t")).select("t.*")
    n = F.count(F.lit(1)).over(Window.partitionBy("track_id"))
    unique = F.when(n == 1, True).otherwise(F.raise_error(F.concat(F.lit("repeated track: "), F.col("track_id"))).cast("boolean"))
    return rows.withColumn("__unique", unique).where("__unique").drop("__unique")


def title_index(tracks: DataFrame, order: str = "position") -> DataFrame:
    """title -> track_id; of rows with one title the last in the file wins."""
    return tracks.groupBy("title").agg(F.max_by("track_id", order).alias("track_id"))


def ranking_rows(spark: SparkSession, path: str) -> DataFrame:
    """Ranking JSON lines; a user that comes twice for a method and seed is an error."""
    rows = spark.read.schema(RANKING_ROW).json(path)
    n = F.count(F.lit(1)).over(Window.partitionBy("method", "seed", "user_id"))
    unique = F.when(n == 1, True).otherwise(F.raise_error(F.concat(F.lit("repeated user: "), F.col("user_id"))).cast("boolean"))
    return rows.withColumn("__unique", unique).where("__unique").drop("__unique")


def precision_by_user(rows: DataFrame, k: int = 5) -> DataFrame:
    return rows.select("user_id", F.element_at("metrics.precision", str(k)).alias("precision"), "query_track_id")


def ranking_long(rows: DataFrame) -> DataFrame:
    """method, seed, user_id, rank, track_id."""
    return rows.select("method", "seed", "user_id", F.posexplode("recommendations").alias("pos", "track_id")).select("method", "seed", "user_id", (F.col("pos") + 1).alias("rank"), "track_id")


def json_map(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """{key: value} of a JSON object as rows (key, value); ``array<string>`` for ground truth, ``double`` for
    popularity."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value_type}>")).alias("key", "value"))


def json_maps(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """The same for a file with one object per line."""
    return spark.read.text(path).select(F.explode(F.from_json("value", f"map<string,{value_type}>")).alias("key", "value"))


def similarity_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a similarity table (a, b, score), each a Parquet folder below ``path``."""
    return spark.read.option("recursiveFileLookup", True).schema("a string, b string, score double").parquet(path)


def parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Features, feature bundles and row arrays: array columns in Parquet."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
