"""Round trips through files, audio features and arms of an ablation (SRC, SNK, SG, ML)."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import audio
from ..operators import metrics as M
from ..operators import ranking as R
from ..sources import files, sinks
from ..sources import tables as T
from .ranking_queries import _POP_TOP, _popular_top10
from .registry import INTER, TRACKS, VECTORS, query


@query("SRC-10 SNK-04", f"with {_POP_TOP} select 'popular' \"method\", user_id, rank, track_id from top10")
def ranking_file(spark, sf):
    """One JSON line per user and back to one row per rank."""
    top = _popular_top10(spark, sf)[2]
    lists = top.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "track_id"))), lambda x: x["track_id"]).alias("recommendations"))
    nested = lists.select(F.lit("popular").alias("method"), F.lit(0).alias("seed"), "user_id", F.element_at("recommendations", 1).alias("query_track_id"), "recommendations", F.array().cast("array<string>").alias("relevance_ids"), F.struct(F.create_map(F.lit("5"), F.lit(0.0)).alias("precision")).alias("metrics"))
    rows = sinks.round_trip(spark, lambda p: sinks.write_json_lines(nested, p), lambda p: files.ranking_rows(spark, p))
    return files.ranking_long(rows).select("method", "user_id", F.col("rank").cast("long").alias("rank"), "track_id")


@query("SRC-11", f"with {INTER} select user_id, round(max(score),6) \"precision\", arg_min(track_id, (-score, track_id)) query_track_id from inter group by user_id")
def precision_file(spark, sf):
    i = T.interactions(spark, sf)
    best = i.groupBy("user_id").agg(F.round(F.max("score"), 6).alias("p"), F.min_by("track_id", F.struct(-F.col("score"), F.col("track_id"))).alias("q"))
    rows = best.select(F.lit("m").alias("method"), F.lit(1).alias("seed"), "user_id", F.col("q").alias("query_track_id"), F.struct(F.create_map(F.lit("5"), "p").alias("precision")).alias("metrics"))
    return files.precision_by_user(sinks.round_trip(spark, lambda p: sinks.write_json_lines(rows, p), lambda p: files.ranking_rows(spark, p)))


@query("SRC-04 SRC-05", f"with {TRACKS} select title, arg_max(track_id, track_id::bigint) track_id from tracks group by title")
def track_file_titles(spark, sf):
    """The version 2 track file, then title -> id with the last one winning."""
    t = T.tracks(spark, sf).select("track_id", "title", "artist", "genre", "duration", F.concat(F.col("track_id"), F.lit(".mp3")).alias("path"))
    # several files of the same version, one for each genre: no row holds the catalogue
    shards = t.groupBy("genre").agg(F.collect_list(F.struct(*t.columns)).alias("tracks"))
    whole = shards.select(F.lit(2).alias("schema_version"), F.lit("tracks").alias("record_type"), F.create_map(F.lit("genre"), "genre").alias("provenance"), "tracks")
    back = sinks.round_trip(spark, lambda p: sinks.write_json_lines(whole, p), lambda p: files.selected_tracks(spark, p, one_per_file=False))
    return files.title_index(back.withColumn("position", F.col("track_id").cast("long")))


@query("SRC-06 SRC-07 SRC-08 SNK-01 SNK-02", f"with {VECTORS} select track_id, len(vec) n, round(list_sum(vec),6) total from vectors")
def vector_bundle(spark, sf):
    v = T.vectors(spark, sf)
    back = sinks.round_trip(spark, lambda p: sinks.write_new(v, p), lambda p: files.parquet(spark, p, "track_id string, vec array<double>"))
    return back.select("track_id", F.size("vec").cast("long").alias("n"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SRC-09 SNK-03", "select event_type || '-' || (user_id % 4) block, count(*) n, round(sum(value),4) total from events group by 1")
def similarity_blocks(spark, sf):
    """Blocks of a pair table written as folders and scanned as one."""
    e = T.read(spark, sf, "events").select("event_type", (F.col("user_id") % 4).cast("string").alias("part"), F.col("value").alias("score"))
    pairs = e.select(F.col("event_type").alias("a"), F.col("part").alias("b"), "score", F.col("part").alias("block"))
    back = sinks.round_trip(spark, lambda p: pairs.write.partitionBy("block").parquet(p), lambda p: files.similarity_blocks(spark, p))
    return back.groupBy(F.concat_ws("-", "a", "b").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query("SRC-12", f"with {TRACKS} select genre \"key\", count(*) n from tracks group by 1")
def ground_truth_map(spark, sf):
    g = T.tracks(spark, sf).groupBy("genre").agg(F.collect_list("track_id").alias("ids"))
    one = g.select(F.to_json(F.create_map("genre", "ids")).alias("value"))
    back = sinks.round_trip(spark, lambda p: one.write.text(p), lambda p: files.json_maps(spark, p, "array<string>"))
    return back.select("key", F.size("value").cast("long").alias("n"))


@query("SNK-05 SNK-06 SNK-10", f"with {TRACKS} select track_id, price, (genre='PROMO') selected from tracks")
def projection_csv(spark, sf):
    t = T.tracks(spark, sf).withColumn("selected", F.col("genre") == "PROMO")
    return sinks.round_trip(spark, lambda p: sinks.write_csv(t, p, ["track_id", "price", "selected"]), lambda p: spark.read.schema("track_id string, price double, selected boolean").csv(p, header=True))


@query("SNK-07", "select 'tracks' part, count(*) n from part union all select 'users', count(*) from customer")
def staged_run(spark, sf):
    parts = {"tracks": T.tracks(spark, sf), "users": T.users(spark, sf)}

    def read(p):
        counts = [spark.read.parquet(f"{p}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name in parts]
        return counts[0].unionByName(counts[1])

    return sinks.round_trip(spark, lambda p: sinks.write_parts(parts, p), read)


def _tones(batches):
    for pdf in batches:
        out = []
        for hz in pdf["hz"]:
            x = (12_000 * np.sin(2 * np.pi * hz * np.arange(audio.RATE // 2) / audio.RATE)).astype("<i2")
            buffer = io.BytesIO()
            with wave.open(buffer, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(2)
                w.setframerate(audio.RATE)
                w.writeframes(x.tobytes())
            out.append(buffer.getvalue())
        yield pd.DataFrame({"path": pdf["path"], "content": out})


@query("SRC-13 SG-06 SG-07")
def audio_features(spark, sf):
    """A half-second tone for each user of events, decoded and measured; the 72-value vector of each."""
    users = T.read(spark, sf, "events").select("user_id").distinct()
    tones = users.select(F.concat(F.lit("tone"), "user_id").alias("path"), (100.0 + F.col("user_id") % 900).alias("hz"))
    return audio.traditional_vector(audio.extract(tones.mapInPandas(_tones, "path string, content binary")))


_ARMS = {"first16": (1, 16), "first32": (1, 32), "all64": (1, 64), "last32": (33, 32)}


def _arm_sql(name, at, n):
    v = f"vec[{at}:{at + n - 1}]"
    return f"select '{name}' arm, track_id, genre, list_transform({v}, lambda x: x/sqrt(list_sum(list_transform({v}, lambda y: y*y)))) u from vectors"


@query("ML-22 ML-24", f"with {VECTORS}, arms as ({' union all '.join(_arm_sql(k, *x) for k, x in _ARMS.items())}), s as (select a.arm, a.track_id q, b.track_id t, (a.genre=b.genre)::int hit, round(list_sum(list_transform(list_zip(a.u,b.u), lambda p: p[1]*p[2])),9) score from arms a join arms b on a.arm=b.arm and a.track_id<>b.track_id), r as (select *, row_number() over (partition by arm, q order by score desc, t) rank from s) select arm, round(sum(hit)/5/count(distinct q),6) precision_at_5 from r where rank<=5 group by arm")
def ablation_arms(spark, sf):
    """One search per channel subset, then the precision of each arm."""
    v = T.vectors(spark, sf)
    out = None
    for name, (at, n) in _ARMS.items():
        arm = v.select("track_id", F.slice("vec", at, n).alias("vec"))
        top = R.blocked_cosine_topk(arm, arm, 5).withColumnRenamed("query_id", "user_id")
        p = M.per_user(M.label_hits(top, v), (5,)).agg(F.round(F.avg("precision"), 6).alias("precision_at_5")).select(F.lit(name).alias("arm"), "precision_at_5")
        out = p if out is None else out.unionByName(p)
    return out
