"""A synthetic population of listeners by hash draws, and its checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpoint
from .protocol import hash_order, hash_split, positions

SEED = 2025
#: Archetype, share of users, engagement, diversity, novelty, popularity bias, interaction rate,
#: preferred genres (none: drawn for each user).
ARCHETYPES = [
    ("music_enthusiast", 0.20, 0.9, 0.8, 0.7, 0.3, 0.8, ["Rock", "Electronic", "Jazz", "Classical"]),
    ("genre_specialist", 0.25, 0.7, 0.2, 0.4, 0.5, 0.6, ["Rock"]),
    ("casual_listener", 0.30, 0.4, 0.3, 0.2, 0.8, 0.3, ["Pop", "Rock"]),
    ("explorer", 0.15, 0.8, 0.9, 0.9, 0.2, 0.7, []),
    ("mainstream_fan", 0.10, 0.6, 0.1, 0.1, 0.9, 0.5, ["Pop", "Hip-Hop"]),
]
#: Shares of the age groups and of the listening frequencies.
AGES = [("18-25", 0.3), ("26-35", 0.25), ("36-45", 0.2), ("46-55", 0.15), ("55+", 0.1)]
FREQUENCIES = [("daily", 0.4), ("weekly", 0.4), ("monthly", 0.2)]
#: Strides of the draws without replacement: primes above any catalogue, so each is coprime to its size.
STRIDES = [2147483647, 2147483629, 2147483587, 2147483579]
LARGEST = 2_000_000_000
PROFILE = ("engagement", "diversity", "novelty", "bias")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on seed and parts only."""
    return F.conv(F.substring(hash_order(seed, *parts), 1, 13), 16, 10).cast("double") / float(1 << 52)


def normal(seed: int, *parts: Column) -> Column:
    """A standard normal number (Box and Muller), to nine digits."""
    u, v = uniform(seed, *parts, F.lit("u")), uniform(seed, *parts, F.lit("v"))
    return F.round(F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v), 9)


def choice(at: Column, options: list[tuple[str, float]]) -> Column:
    """The option whose share of [0, 1) holds ``at``."""
    out, high = None, 0.0
    for name, share in options[:-1]:
        high = round(high + share, 9)
        out = F.when(at < high, name) if out is None else out.when(at < high, name)
    return out.otherwise(options[-1][0])


def nth_place(seed: int, parts: list[Column], i: Column, size: Column) -> Column:
    """Place of the i-th draw without replacement out of ``size``: a start and a stride by hash."""
    start = F.floor(uniform(seed, *parts, F.lit("start")) * size).cast("long")
    stride = F.element_at(F.array(*(F.lit(s) for s in STRIDES)), F.floor(uniform(seed, *parts, F.lit("stride")) * len(STRIDES)).cast("int") + 1)
    return (start + i.cast("long") * stride) % size


def draw_places(users: DataFrame, seed: int, name: str, n: Column, size: Column) -> DataFrame:
    """Rows of ``users`` with i from 0 to n - 1 and the i-th place out of ``size``. Start and stride are hashed
    once a user, and users are dealt out, so that a few users' many draws do not share a task."""
    spark, user = users.sparkSession, F.col("user_id")
    dealt = users.repartition(4 * spark.sparkContext.defaultParallelism, "user_id")
    start = F.floor(uniform(seed, user, F.lit(name), F.lit("start")) * size).cast("long")
    stride = F.element_at(F.array(*(F.lit(s) for s in STRIDES)), F.floor(uniform(seed, user, F.lit(name), F.lit("stride")) * len(STRIDES)).cast("int") + 1)
    dealt = dealt.withColumns({"__start": start, "__stride": stride, "__size": size.cast("long")})
    rows = dealt.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    return rows.withColumn("at", (F.col("__start") + F.col("i") * F.col("__stride")) % F.col("__size")).drop("__start", "__stride", "__size")


def _catalogue(tracks: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Tracks with their place in the catalogue and in their genre, genres in order, and the number of tracks."""
    genres = tracks.groupBy("genre").agg(F.count(F.lit(1)).alias("size"))
    genres = checkpoint(positions(genres, F.col("genre"), name="genre_place"))
    n = tracks.count()
    if n > LARGEST:
        raise ValueError(f"more than {LARGEST} tracks")
    placed = positions(tracks.select("track_id", "genre", "artist"), F.col("genre"), F.col("track_id"), name="place")
    firsts = placed.groupBy("genre").agg(F.min("place").alias("first"))
    popularity = tracks.groupBy("artist").agg(F.count(F.lit(1)).alias("by_artist"))
    rows = placed.join(firsts, "genre").join(genres.select("genre", "size"), "genre").join(popularity, "artist")
    rows = rows.withColumn("popularity", (F.col("size") / n + F.col("by_artist") / n) / 2)
    return checkpoint(rows.select("track_id", "genre", "artist", "place", (F.col("place") - F.col("first")).alias("in_genre"), "popularity")), genres, n


def profiles(tracks: DataFrame, n_users: int, seed: int = SEED) -> DataFrame:
    """One row per user: archetype by its share, the archetype's values plus normal noise of 0.1 clipped to
    [0, 1] (engagement to [0.1, 1]), preferred genres (the archetype's; an explorer draws one to three), age
    group, listening frequency and the declared number of interactions."""
    return _profiles(*_catalogue(tracks)[1:], n_users, seed)


def _profiles(genres: DataFrame, n: int, n_users: int, seed: int) -> DataFrame:
    spark, user = genres.sparkSession, F.col("user_id")
    fields = "archetype string, share double, engagement double, diversity double, novelty double, bias double, rate double, focus array<string>"
    kinds = spark.createDataFrame(ARCHETYPES, fields).drop("share")
    users = spark.range(n_users).select(F.concat(F.lit("user_"), F.col("id").cast("string")).alias("user_id"))
    users = users.withColumn("archetype", choice(uniform(seed, user, F.lit("archetype")), [a[:2] for a in ARCHETYPES])).join(F.broadcast(kinds), "archetype")
    noisy = {c: F.least(F.lit(1.0), F.greatest(F.lit(0.1 if c == "engagement" else 0.0), F.round(F.col(c) + 0.1 * normal(seed, user, F.lit(c)), 9))) for c in PROFILE}
    users = users.withColumns(noisy)
    n_genres = genres.count()
    upper = max(2, min(4, n_genres))
    wanted = F.least(F.floor(1 + uniform(seed, user, F.lit("genres")) * (upper - 1)), F.lit(n_genres)).cast("int")
    draws = users.where(F.size("focus") == 0).select("user_id", F.explode(F.sequence(F.lit(0), wanted - 1)).alias("i"))
    draws = draws.withColumn("genre_place", nth_place(seed, [user, F.lit("genre")], F.col("i"), F.lit(n_genres)))
    drawn = draws.join(genres, "genre_place").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "genre"))), lambda x: x["genre"]).alias("drawn"))
    base = F.floor(F.col("engagement") * F.col("rate") * n * 0.3)
    count = F.least(F.greatest(F.lit(1), F.floor(base * (0.5 + uniform(seed, user, F.lit("count"))))), F.lit(n)).cast("long")
    users = users.join(drawn, "user_id", "left").withColumn("preferred_genres", F.coalesce("drawn", "focus"))
    return users.select("user_id", "archetype", *PROFILE, F.col("rate").alias("interaction_rate"), "preferred_genres", choice(uniform(seed, user, F.lit("age")), AGES).alias("age_group"), choice(uniform(seed, user, F.lit("frequency")), FREQUENCIES).alias("listening_frequency"), count.alias("declared"))


def population(tracks: DataFrame, n_users: int = 200, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(users, interactions). Of a user's declared interactions 70 % (rounded down, as far as there are tracks)
    come from preferred genres, the others from all tracks that are left, preferred ones among them. The score
    is bias x popularity, plus diversity x up to 0.3, novelty x up to 0.2, and 0.3 for a preferred genre, 1 at
    most; the rating truncates 1 + 4 x score.

    Draws are places in numbered genres and in the numbered catalogue: a user's rows are the draws, never all
    tracks, and each place is looked up by a join. Spark takes exploded draws for as small as the users they come
    from, so their joins are marked as merge joins: no draw is broadcast."""
    items, genres, n = _catalogue(tracks)
    users = checkpoint(_profiles(genres, n, n_users, seed))
    user, track = F.col("user_id"), F.col("track_id")
    # the preferred genres of a user, laid end to end in the order of their names
    own = users.select("user_id", "declared", F.explode("preferred_genres").alias("genre")).distinct().join(genres.select("genre", "size"), "genre")
    upto = Window.partitionBy("user_id").orderBy("genre")
    own = own.withColumn("to", F.sum("size").over(upto)).withColumn("all", F.sum("size").over(Window.partitionBy("user_id")))
    parts = own.groupBy("user_id", "declared", "all").agg(F.sort_array(F.collect_list(F.struct("to", "genre", "size"))).alias("parts"))
    first = parts.withColumn("n", F.least(F.floor(F.col("declared") * 0.7), F.col("all"))).where("n > 0")
    first = draw_places(first, seed, "preferred", F.col("n"), F.col("all"))
    part = F.element_at(F.filter("parts", lambda p: p["to"] > F.col("at")), 1)
    first = first.select("user_id", part["genre"].alias("genre"), (F.col("at") - part["to"] + part["size"]).alias("in_genre"))
    first = checkpoint(first.join(items.hint("merge"), ["genre", "in_genre"]).select("user_id", "place"))
    taken = first.groupBy("user_id").agg(F.count(F.lit(1)).alias("taken"))
    # as many draws from the whole catalogue as there are interactions: those not yet taken suffice
    rest = users.select("user_id", "declared").join(taken, "user_id", "left").fillna(0, ["taken"])
    rest = draw_places(rest, seed, "any", F.col("declared"), F.lit(n)).withColumnRenamed("at", "place").join(first.hint("merge"), ["user_id", "place"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("i"))
    rest = rest.withColumn("nth", nth).where(F.col("nth") <= F.col("declared") - F.col("taken")).select("user_id", "place")
    rows = first.unionByName(rest).join(items.hint("merge"), "place").join(users.select("user_id", *PROFILE, "preferred_genres"), "user_id")
    fits = F.array_contains("preferred_genres", F.col("genre"))
    score = F.col("bias") * F.col("popularity") + F.col("diversity") * 0.3 * uniform(seed, user, track, F.lit("diversity")) + F.col("novelty") * 0.2 * uniform(seed, user, track, F.lit("novelty")) + F.when(fits, 0.3).otherwise(0.0)
    rows = rows.withColumn("interaction_score", F.least(F.lit(1.0), F.round(score, 9)))
    stamp = uniform(seed, user, track, F.lit("time"))
    return users, rows.select("user_id", "track_id", rating_of(F.col("interaction_score")).alias("rating"), "interaction_score", stamp.alias("timestamp"), "genre", "artist")


def rating_of(score: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(5), F.floor(1 + 4 * score).cast("int")))


def violations(users: DataFrame, interactions: DataFrame, tracks: DataFrame | None = None, n_users: int | None = None) -> DataFrame:
    """(rule, n) of every broken rule with the number of records that break it; empty if the population is sound.

    Users, interactions and splits are recomputed record by record; with ``tracks`` against the catalogue."""
    focus = F.create_map(*(x for a in ARCHETYPES for x in (F.lit(a[0]), F.array(*(F.lit(g) for g in a[7])).cast("array<string>"))))
    own, known = focus[F.col("archetype")], F.col("archetype").isin([a[0] for a in ARCHETYPES])
    genres = F.col("preferred_genres")
    out_of = lambda c, low: ~F.coalesce(F.col(c).between(low, 1.0), F.lit(False))
    of_user = {
        "archetype": ~F.coalesce(known, F.lit(False)),
        "age_group": ~F.coalesce(F.col("age_group").isin([a for a, _ in AGES]), F.lit(False)),
        "listening_frequency": ~F.coalesce(F.col("listening_frequency").isin([f for f, _ in FREQUENCIES]), F.lit(False)),
        "profile_range": out_of("engagement", 0.1) | out_of("diversity", 0.0) | out_of("novelty", 0.0) | out_of("bias", 0.0),
        "preferred_genres": F.when(F.size(own) > 0, genres != own).otherwise(~F.size(genres).between(1, 3) | (F.size(F.array_distinct(genres)) != F.size(genres))),
        "declared_count": F.coalesce(F.col("declared") != F.col("realised"), F.lit(True)),
    }
    score, rating = F.col("interaction_score"), F.col("rating")
    of_record = {
        "unknown_user": F.col("declared").isNull(),
        "rating_range": ~F.coalesce(rating.between(1, 5), F.lit(False)),
        "score_range": out_of("interaction_score", 0.0),
        "timestamp_range": out_of("timestamp", 0.0),
        "rating_of_score": F.coalesce(rating != rating_of(score), F.lit(True)),
    }
    realised = interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("realised"))
    checked = users.join(realised, "user_id", "left").withColumn("realised", F.coalesce("realised", F.lit(0)))
    records = interactions.join(users.select("user_id", "declared"), "user_id", "left")
    if tracks is not None:
        items = tracks.select("track_id", F.col("genre").alias("its_genre"), F.col("artist").alias("its_artist"))
        records = records.join(items.hint("merge"), "track_id", "left")
        of_record["outside_catalogue"] = F.col("its_genre").isNull()
        of_record["metadata"] = F.col("its_genre").isNotNull() & ((F.col("genre") != F.col("its_genre")) | (F.col("artist") != F.col("its_artist")))
    sums = lambda df, rules: df.agg(*(F.count_if(c).alias(k) for k, c in rules.items())).unpivot([], list(rules), "rule", "n")
    pairs = interactions.groupBy("user_id", "track_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated_pair").alias("rule"), "n")
    ids = users.groupBy("user_id").count().agg((F.count_if(F.col("count") > 1) + (F.abs(F.count(F.lit(1)) - F.lit(n_users)) if n_users is not None else F.lit(0))).alias("n")).select(F.lit("user_ids").alias("rule"), "n")
    once = interactions.select("user_id", "track_id").distinct()
    parts = hash_split(once, SEED).groupBy("user_id").agg(F.countDistinct("split").alias("parts"))
    large = once.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 7").join(parts, "user_id", "left").agg(F.count_if(F.coalesce("parts", F.lit(0)) < 3).alias("n")).select(F.lit("empty_split").alias("rule"), "n")
    found = sums(checked, of_user).unionByName(sums(records, of_record)).unionByName(pairs).unionByName(ids).unionByName(large)
    return found.where("n > 0")


def fallback_ratings(vectors: DataFrame, n_users: int, seed: int = SEED) -> DataFrame:
    """clip(int(3 + 2 dot), 1, 5) of the user's preferences and the first five dimensions, for exactly
    max(1, floor(0.3 n)) tracks of each user. Preferences are normal draws, standardised over the users."""
    items = positions(vectors.select("track_id", F.slice("vec", 1, 5).alias("v")), F.col("track_id"), name="place")
    n, user = vectors.count(), F.col("user_id")
    spark = vectors.sparkSession
    users = spark.range(n_users).select(F.concat(F.lit("user_"), F.col("id").cast("string")).alias("user_id"))
    raw = users.select("user_id", *(normal(seed, user, F.lit(f"dim{i}")).alias(f"x{i}") for i in range(5)))
    spread = raw.agg(*(F.avg(f"x{i}").alias(f"m{i}") for i in range(5)), *(F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(5)))
    one = raw.join(F.broadcast(spread)).select("user_id", F.array(*((F.col(f"x{i}") - F.col(f"m{i}")) / F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0) for i in range(5))).alias("prefer"))
    draws = one.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, int(0.3 * n)) - 1).cast("long")))).where(F.lit(n > 0))
    draws = draws.withColumn("place", nth_place(seed, [user, F.lit("rated")], F.col("i"), F.lit(max(n, 1))))
    dot = F.aggregate(F.zip_with("v", "prefer", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return draws.join(items.hint("merge"), "place").select("user_id", "track_id", F.greatest(F.lit(1), F.least(F.lit(5), F.round(3 + 2 * dot, 6).cast("int"))).alias("rating"))
