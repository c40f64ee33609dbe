"""Scalar functions, similarities and joins by name (FN, JN, SRC-02/03)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import pairs as A
from ..operators import protocol as P
from ..operators import ranking as R
from ..sources import tables as T
from .registry import INTER, RATED, TRACKS, UNIT, USERS, VECTORS, query


@query("SRC-01 SRC-02 SRC-03", "select p_partkey::varchar track_id, p_name title, 'audio/' || substr(lpad(p_partkey::varchar,6,'0'),1,3) || '/' || lpad(p_partkey::varchar,6,'0') || '.mp3' path from part where lower(trim(p_type))='medium' and trim(coalesce(p_name,''))<>'' and p_size>0")
def medium_tracks(spark, sf):
    t = T.tracks(spark, sf).where((F.lower(F.trim("genre")) == "medium") & (F.trim(F.coalesce("title", F.lit(""))) != "") & (F.col("duration") > 0))
    return t.select("track_id", "title", S.padded_path(F.col("track_id"), "audio").alias("path"))


@query("FN-01 FN-31", "select o_orderkey::varchar id, count(*) n from orders group by 1")
def normalised_ids(spark, sf):
    """Padded and blank-edged ids come back as the plain number."""
    raw = T.read(spark, sf, "orders").select(F.concat(F.lit("  "), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(" ")).alias("raw"))
    return raw.groupBy(P.normalise_id(F.col("raw")).alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("FN-02 FN-03 ML-01", f"with {TRACKS} select track_id, row_number() over (order by track_id)-1 position from tracks")
def index_map(spark, sf):
    return P.index_map(T.tracks(spark, sf), "track_id").withColumn("position", F.col("position").cast("long"))


@query("FN-05", f"with {USERS} select user_id, (('0x' || substr(sha256('42:' || user_id),1,16))::ubigint)::varchar seed from users")
def user_seeds(spark, sf):
    return T.users(spark, sf).select("user_id", P.user_seed(42, F.col("user_id")).alias("seed"))


@query("FN-06", f"with {TRACKS} select track_id, sha256('7' || chr(0) || 'global' || chr(0) || track_id) order_key, sha256('7' || chr(0) || genre) genre_seed from tracks")
def order_keys(spark, sf):
    zero = F.char(F.lit(0))
    return T.tracks(spark, sf).select("track_id", F.sha2(F.concat(F.lit("7"), zero, F.lit("global"), zero, F.col("track_id")), 256).alias("order_key"), F.sha2(F.concat(F.lit("7"), zero, F.col("genre")), 256).alias("genre_seed"))


@query("FN-07 SG-02", 'select d channels, o "order", (select sum(power(d,k))::bigint+1 from range(1,o+1) t(k)) dimension from range(1,39) a(d), range(1,4) b(o)')
def signature_dimensions(spark, sf):
    grid = spark.range(1, 39).select(F.col("id").alias("channels")).withColumn("order", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return grid.select("channels", F.col("order").cast("long").alias("order"), S.signature_dimension(F.col("channels"), F.col("order")).alias("dimension"))


@query("FN-08", "select vec_id, round(embedding[1]::double,6) c0, round(embedding[11]::double,6) c10, round(embedding[64]::double,6) c63 from embeddings")
def channel_slice(spark, sf):
    v = T.read(spark, sf, "embeddings").select("vec_id", S.channel_slice(F.col("embedding").cast("array<double>"), [0, 10, 63]).alias("s"))
    return v.select("vec_id", *(F.round(F.col("s")[i], 6).alias(n) for i, n in enumerate(("c0", "c10", "c63"))))


@query("FN-09", "with v as (select vec_id, embedding::double[] e from embeddings), g as (select vec_id, e, i, i*63/9.0 x from v, range(10) t(i)) select vec_id, i, round(e[floor(x)::int+1] + (e[least(floor(x)::int+1,63)+1]-e[floor(x)::int+1])*(x-floor(x)),6) \"value\" from g")
def resampled(spark, sf):
    v = T.vectors(spark, sf).select(F.col("track_id").cast("long").alias("vec_id"), F.posexplode(S.linear_resample(F.col("vec"), 10)).alias("i", "value"))
    return v.select("vec_id", F.col("i").cast("long").alias("i"), F.round("value", 6).alias("value"))


@query("FN-10 FN-11", f"with {UNIT} select track_id, round(u[1],6) first, round(u[64],6) last, round(list_sum(list_transform(u, lambda x: x*x)),6) square from unit")
def unit_vectors(spark, sf):
    u = T.vectors(spark, sf).select("track_id", F.transform_values(F.create_map(F.lit("v"), F.col("vec")), lambda k, v: R.safe_unit(v))["v"].alias("u"))
    return u.select("track_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"), F.round(R.dot(F.col("u"), F.col("u")), 6).alias("square"))


@query("FN-12", f"with {INTER}, e as (select *, exp((score - max(score) over (partition by user_id))/2) e from inter) select user_id, track_id, round(e/sum(e) over (partition by user_id),9) p from e")
def row_softmax(spark, sf):
    return T.interactions(spark, sf).select("user_id", "track_id", F.round(S.row_softmax(F.col("score"), ["user_id"], 2.0), 9).alias("p"))


_PAIR = f"{VECTORS}, pairs as (select a.track_id a, b.track_id b, a.vec x, b.vec y, a.genre ga, b.genre gb from vectors a join vectors b on a.track_id<b.track_id)"


def _grouped(spark, sf):
    return T.vectors(spark, sf).select("track_id", F.col("genre").alias("grp"), "vec")


def _similarities(a, b):
    x, y = a.matrix, b.matrix
    nx, ny = (np.sqrt((m * m).sum(1)) for m in (x, y))

    def get(at, upto):
        u = x[at:upto]
        cosine = u @ y.T / (nx[at:upto, None] * ny[None] + 1e-8)
        squares, sums = A.differences(u, y, np.square, np.abs)
        return [A.rounded(m, 6) for m in (cosine, 1 / (1 + np.sqrt(squares)), 1 / (1 + sums))]

    return get


@query("FN-13 FN-15 FN-16 ML-21 ML-25 JN-05", f"with {_PAIR} select a, b, round(list_sum(list_transform(list_zip(x,y), lambda p: p[1]*p[2]))/(sqrt(list_sum(list_transform(x, lambda t: t*t)))*sqrt(list_sum(list_transform(y, lambda t: t*t)))+1e-8),6) cosine, round(1/(1+sqrt(list_sum(list_transform(list_zip(x,y), lambda p: (p[1]-p[2])*(p[1]-p[2]))))),6) euclidean, round(1/(1+list_sum(list_transform(list_zip(x,y), lambda p: abs(p[1]-p[2])))),6) manhattan from pairs")
def pair_similarities(spark, sf):
    names = ["cosine", "euclidean", "manhattan"]
    return A.block_pairs(_grouped(spark, sf), None, A.pair_rows(_similarities, names), "a string, b string, cosine double, euclidean double, manhattan double")


_COS = "list_sum(list_transform(list_zip({0},{1}), lambda p: p[1]*p[2]))/(sqrt(list_sum(list_transform({0}, lambda t: t*t)))*sqrt(list_sum(list_transform({1}, lambda t: t*t))))"
_COMPOSITE = f"{_PAIR}, comp as (select a, b, 0.7*power({_COS.format('x[1:32]', 'y[1:32]')},2) + 0.2*{_COS.format('x[33:64]', 'y[33:64]')} + 0.1*(ga=gb)::int s from pairs)"


def _composite(then):
    """Scores of the composite, masked where a genre is null, through ``then``."""

    def score(a, b):
        s, t, p, q = a.part(0, 32), b.part(0, 32), a.part(32, 32), b.part(32, 32)
        g, h = A.codes(a.groups, b.groups)

        def get(at, upto):
            cosine = s[at:upto] @ t.T
            value = 0.7 * cosine * cosine + 0.2 * (p[at:upto] @ q.T) + 0.1 * (g[at:upto, None] == h[None])
            return [then(np.ma.array(value, mask=(g[at:upto, None] < 0) | (h[None] < 0)))]

        return get

    return score


def _tempered(s):
    """Null counts as 0, as SQL's greatest has it."""
    return 1 / (1 + np.exp(-5.0 * (np.sqrt(np.maximum(s.filled(0.0), 0.0)) - 0.5)))


@query("FN-17", f"with {_COMPOSITE} select a, b, round(s,6) s from comp")
def composite_similarity(spark, sf):
    score = _composite(lambda s: np.ma.array(A.rounded(s.data, 6), mask=s.mask))
    return A.block_pairs(_grouped(spark, sf), None, A.pair_rows(score, ["s"]), "a string, b string, s double")


@query("FN-18 ML-23 ML-26", f"with {_COMPOSITE}, t as (select a, b, 1/(1+exp(-5*(power(greatest(s,0),1/2.0)-0.5))) z from comp), m as (select min(z) lo, max(z) hi from t) select a, b, round((z-lo)/(hi-lo+1e-8),6) s from t, m")
def temperature_scaled(spark, sf):
    """Two passes, the first for the least and the largest value only."""
    v = _grouped(spark, sf)
    lo, hi = A.extremes(v, _composite(_tempered))
    if lo is None:
        return spark.createDataFrame([], "a string, b string, s double")
    score = _composite(lambda s: A.rounded((_tempered(s) - lo) / (hi - lo + 1e-8), 6))
    return A.block_pairs(v, None, A.pair_rows(score, ["s"]), "a string, b string, s double")


_PARTS = [(1, 20, 0.4), (21, 12, 0.3), (33, 8, 0.1), (41, 8, 0.1), (49, 8, 0.1)]
_WEIGHTED = "+".join(f"{w}*{_COS.format(f'x[{a}:{a + n - 1}]', f'y[{a}:{a + n - 1}]')}/{n}" for a, n, w in _PARTS)


def _weighted(a, b):
    parts = [(w / n, a.part(at - 1, n), b.part(at - 1, n)) for at, n, w in _PARTS]
    return lambda at, upto: [sum(w * (x[at:upto] @ y.T) for w, x, y in parts)]


@query("FN-19", f"with {_PAIR} select a, b, round({_WEIGHTED},6) s from pairs")
def weighted_similarity(spark, sf):
    """.4 and .3 for the two large blocks, .1 for three small ones; mean products of normalised blocks."""
    score = lambda a, b: (lambda get: lambda at, upto: [A.rounded(get(at, upto)[0], 6)])(_weighted(a, b))
    return A.block_pairs(_grouped(spark, sf), None, A.pair_rows(score, ["s"]), "a string, b string, s double")


@query("ML-27 FN-12", f"with {_PAIR}, s as (select a, b, {_WEIGHTED} s from pairs), f as (select a, b, s from s union all select b, a, s from s union all select track_id, track_id, 0 from vectors), e as (select *, exp(s - max(s) over (partition by a)) e from f) select a, b, round(e/sum(e) over (partition by a),6) p from e")
def weighted_row_softmax(spark, sf):
    """The diagonal is 0 before the softmax, so a track keeps some mass for itself."""
    v = _grouped(spark, sf)
    sums = A.block_pairs(v, v, A.row_sums(_weighted), "a string, top double, total double")
    top = sums.groupBy("a").agg(F.max("top").alias("top")).withColumnRenamed("a", "track_id")
    total = sums.join(top, sums["a"] == top["track_id"]).groupBy("track_id").agg(F.first(top["top"]).alias("high"), F.sum(sums["total"] * F.exp(sums["top"] - top["top"])).alias("total"))
    # a row's largest value and total travel behind its vector
    rows = v.join(total, "track_id").select("track_id", "grp", F.concat("vec", F.array("high", "total")).alias("vec"))

    def share(a, b):
        get, high, mass = _weighted(a, b), a.matrix[:, -2], a.matrix[:, -1]
        x, y = A.codes(a.ids.to_pylist(), b.ids.to_pylist())

        def shares(at, upto):
            s = np.where(x[at:upto, None] == y[None], 0.0, get(at, upto)[0])
            return [A.rounded(np.exp(s - high[at:upto, None]) / mass[at:upto, None], 6)]

        return shares

    return A.block_pairs(rows, v, A.pair_rows(share, ["p"], None), "a string, b string, p double")


@query("FN-20", f"with {_PAIR} select a, b, round(1/(1+exp((exp(-1.0)*list_sum(list_transform(list_zip(x[1:8],y[1:8]), lambda p: abs(p[1]-p[2])))+exp(-2.0)*list_sum(list_transform(list_zip(x[9:64],y[9:64]), lambda p: abs(p[1]-p[2]))))/(8*exp(-1.0)+56*exp(-2.0)))),6) s from pairs")
def depth_weighted(spark, sf):
    """Differences of the first level weigh e^-1, of the second e^-2."""
    w1, w2 = np.exp(-1.0), np.exp(-2.0)

    def score(a, b):
        x, y = a.matrix, b.matrix

        def get(at, upto):
            u = x[at:upto]
            mean = (w1 * A.differences(u[:, :8], y[:, :8])[0] + w2 * A.differences(u[:, 8:64], y[:, 8:64])[0]) / (8 * w1 + 56 * w2)
            return [A.rounded(1 / (1 + np.exp(mean)), 6)]

        return get

    return A.block_pairs(_grouped(spark, sf), None, A.pair_rows(score, ["s"]), "a string, b string, s double")


@query("FN-21", f"with {TRACKS} select track_id, round((count(*) over (partition by genre)/count(*) over () + count(*) over (partition by artist)/count(*) over ())/2,9) popularity from tracks")
def popularity(spark, sf):
    t = T.tracks(spark, sf)
    n = t.agg(F.count(F.lit(1)).alias("total"))
    share = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c)) / F.col("total")
    return t.join(F.broadcast(n)).select("track_id", F.round((share("genre") + share("artist")) / 2, 9).alias("popularity"))


@query("FN-22", f"with {INTER} select user_id, track_id, greatest(1,least(5,floor(1+4*score)))::int rating from inter")
def ratings(spark, sf):
    i = T.interactions(spark, sf)
    return i.select("user_id", "track_id", S.rating_of(F.col("score")).alias("rating"))


@query("FN-23 SG-05", "with s as (select event_id, (value-avg(value) over w)/nullif(stddev_pop(value) over w,0) z from events window w as (partition by user_id)) select event_id, round(coalesce(greatest(-5,least(5,z)),0),6) z from s")
def path_standardised(spark, sf):
    return T.frames(spark, sf).select("event_id", F.round(S.standardise(F.col("value"), ["track_id"]), 6).alias("z"))


@query("FN-24", "with f as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id)-1 i, count(*) over (partition by user_id) n from events), b as (select distinct user_id, j, j*(n-1)//29 i from f, range(30) t(j) where n>30) select f.user_id, f.event_id, f.i from f where n<=30 or exists (select 1 from b where b.user_id=f.user_id and b.i=f.i)")
def bounded_frames(spark, sf):
    """At most 30 frames of each path (the first and last among them)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = T.read(spark, sf, "events").select("user_id", "event_id", F.row_number().over(order).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"))
    f = f.withColumn("i", (F.col("r") - 1).cast("long"))
    # frame i is kept if i = j (n - 1) div 29 for some j; the only j that can be is ceil(29 i / (n - 1))
    j = F.ceil(29 * F.col("i") / (F.col("n") - 1))
    kept = (F.col("n") <= 30) | (F.floor(j * (F.col("n") - 1) / 29) == F.col("i"))
    return f.where(kept).select("user_id", "event_id", "i")


@query("FN-25 ML-05", f"with {RATED}, p as (select track_id, count(*)::double n from inter group by 1), b as (select user_id, r.track_id, score, n, stddev_pop(score) over w s1, stddev_pop(n) over w s2, avg(score) over w m1, avg(n) over w m2 from rated r join p on p.track_id=r.track_id window w as (partition by user_id)) select user_id, track_id, round(0.3*(score-m1)/s1+0.7*(n-m2)/s2,6) blended from b where s1>0 and s2>0")
def score_blend(spark, sf):
    i = T.interactions(spark, sf)
    n = i.groupBy("track_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows, w = i.join(n, "track_id"), Window.partitionBy("user_id")
    rows = rows.withColumns({"s1": F.stddev_pop("score").over(w), "s2": F.stddev_pop("n").over(w)}).where("s1 > 0 and s2 > 0")
    return rows.select("user_id", "track_id", F.round(S.blend(F.col("score"), F.col("n"), 0.3, ["user_id"]), 6).alias("blended"))


@query("FN-26 FN-27 FN-29", "select * from (values ('l_extended_price','Extended Price','0p5','better (p=0.0310)'), ('mfcc_mean_1','Mfcc Mean 1','10','worse (p=0.2000)'), ('k_x','X','1p25','tied (p=1.0000)')) t(raw, label, id, annotation)")
def labels(spark, sf):
    df = spark.createDataFrame([("l_extended_price", 0.5, 1, 0.031), ("mfcc_mean_1", 10.0, -1, 0.2), ("k_x", 1.25, 0, 1.0)], "raw string, v double, d int, p double")
    return df.select("raw", S.humanise(F.col("raw")).alias("label"), S.float_id(F.col("v")).alias("id"), S.verdict(F.col("d"), F.col("p")).alias("annotation"))


@query("FN-30", f"with {TRACKS} select track_id, title from tracks where genre='PROMO'")
def genre_filter(spark, sf):
    return T.tracks(spark, sf).where("genre = 'PROMO'").select("track_id", "title")


@query("JN-01", f"with {INTER}, {TRACKS} select user_id, track_id, genre, artist from inter join tracks using (track_id)")
def interactions_with_tracks(spark, sf):
    return T.interactions(spark, sf).join(T.tracks(spark, sf), "track_id").select("user_id", "track_id", "genre", "artist")


@query("JN-06 WK-14", f"with {_PAIR}, c as (select a, b, round({_COS.format('x', 'y')},6) s from pairs where ga<>gb) select a, b, s from c where s>=0.2 order by s desc, a, b limit 100")
def cross_genre_pairs(spark, sf):
    """The 100 most similar pairs of different genres."""
    found = A.block_pairs(_grouped(spark, sf), None, A.best_pairs(100, 0.2), "a string, b string, s double")
    return found.orderBy(F.desc("s"), "a", "b").limit(100)


@query("JN-12", f"with {TRACKS}, n as (select event_id, case event_id % 4 when 0 then user_id::varchar when 1 then user_id::varchar || ' - Title' when 2 then 'red widget' else 'nothing' end name from events), t as (select title, min(track_id) id from tracks group by title) select event_id, coalesce(a.track_id, b.track_id, t.id, 'Unknown') track_id from n left join tracks a on a.track_id=n.name left join tracks b on b.track_id=split_part(n.name,' - ',1) and contains(n.name,' - ') left join t on t.title=n.name")
def resolved_names(spark, sf):
    """By id, else by the id before " - ", else by title, else Unknown."""
    e, user = T.read(spark, sf, "events"), F.col("user_id").cast("string")
    kind = F.col("event_id") % 4
    name = F.when(kind == 0, user).when(kind == 1, F.concat(user, F.lit(" - Title"))).when(kind == 2, "red widget").otherwise("nothing")
    n = e.select("event_id", name.alias("name")).withColumn("head", F.when(F.col("name").contains(" - "), F.split_part("name", F.lit(" - "), F.lit(1))))
    t = T.tracks(spark, sf)
    by_id, by_head = t.select(F.col("track_id").alias("name"), F.col("track_id").alias("a")), t.select(F.col("track_id").alias("head"), F.col("track_id").alias("b"))
    by_title = t.groupBy(F.col("title").alias("name")).agg(F.min("track_id").alias("c"))
    return n.join(by_id, "name", "left").join(by_head, "head", "left").join(by_title, "name", "left").select("event_id", F.coalesce("a", "b", "c", F.lit("Unknown")).alias("track_id"))


@query("JN-13", f"with {TRACKS} select l_orderkey, l_linenumber, coalesce(title, l_partkey::varchar) title from lineitem left join tracks on track_id=l_partkey::varchar and genre<>'SMALL'")
def titles_or_ids(spark, sf):
    lines = T.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("track_id"))
    return lines.join(T.tracks(spark, sf).where("genre <> 'SMALL'").select("track_id", "title"), "track_id", "left").select("l_orderkey", "l_linenumber", F.coalesce("title", "track_id").alias("title"))
