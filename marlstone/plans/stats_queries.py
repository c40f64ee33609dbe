"""Exploratory statistics and data quality (AG)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import pairs as A
from ..operators import protocol as P
from ..operators import ranking as R
from ..operators import stats as S
from ..sources import tables as T
from .registry import COSINE, INTER, RATED, SPLIT, TRACKS, UNIT, USERS, query

_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = "long as (select feature, value from (select l_quantity, l_extendedprice, l_discount, l_tax from lineitem) unpivot include nulls (value for feature in (l_quantity, l_extendedprice, l_discount, l_tax)))"


def _long(spark, sf):
    return S.unpivot(T.read(spark, sf, "lineitem").select(*_FEATURES), [], _FEATURES)


def _rounded(df, keep, digits=4):
    return df.select(*keep, *(F.round(c, digits).alias(c) for c in df.columns if c not in keep))


@query("AG-01", "select count(*) n, count(distinct p_brand) artists, count(distinct p_type) genres, (select min(o_orderdate) from orders) first_date, (select max(o_orderdate) from orders) last_date from part")
def basic_stats(spark, sf):
    one = T.tracks(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("artist").alias("artists"), F.countDistinct("genre").alias("genres"))
    return one.join(T.read(spark, sf, "orders").agg(F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date")))


_SKEW = "(avg(value*value*value) - 3*avg(value)*avg(value*value) + 2*power(avg(value),3)) / power(var_pop(value),1.5)"


@query("AG-02 AG-14", f"with {_LONG} select feature, count(value) n, round(avg(value),4) mean, round(stddev_samp(value),4) std, round(min(value),4) min, round(quantile_cont(value,0.25),4) q1, round(quantile_cont(value,0.5),4) median, round(quantile_cont(value,0.75),4) q3, round(max(value),4) max, round({_SKEW},4) skew, round(kurtosis_pop(value),4) kurtosis from long group by feature")
def feature_stats(spark, sf):
    return _rounded(S.moments(_long(spark, sf), sample=True), ["feature", "n"])


@query("AG-03", "select round(avg(p_size),6) mean, round(stddev_samp(p_size),6) std, min(p_size)::double min, max(p_size)::double max, quantile_cont(p_size,0.5)::double median, count(*) filter (p_size<15) short, count(*) filter (p_size>=15 and p_size<35) medium, count(*) filter (p_size>=35) long from part")
def duration_stats(spark, sf):
    d = F.col("duration")
    return T.tracks(spark, sf).where(d.isNotNull()).agg(F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_samp(d), 6).alias("std"), F.min(d).alias("min"), F.max(d).alias("max"), F.percentile(d, F.lit(0.5)).alias("median"), F.count_if(d < 15).alias("short"), F.count_if((d >= 15) & (d < 35)).alias("medium"), F.count_if(d >= 35).alias("long"))


@query("AG-04 AG-39", "select p_type genre, count(*) n, round(100*count(*)/sum(count(*)) over (),6) percent from part group by 1")
def genre_distribution(spark, sf):
    return S.distribution(T.tracks(spark, sf), "genre").select("genre", "n", F.round("percent", 6).alias("percent"))


@query("AG-05", "with c as (select p_type genre, count(*) n from part group by 1) select arg_max(genre,(n,genre)) most, arg_min(genre,(n,genre)) least, round(max(n)/min(n),6) ratio, round(count(*)/sum(n),6) diversity from c")
def genre_balance(spark, sf):
    c = S.distribution(T.tracks(spark, sf), "genre")
    key = F.struct("n", "genre")
    return c.agg(F.max_by("genre", key).alias("most"), F.min_by("genre", key).alias("least"), F.round(F.max("n") / F.min("n"), 6).alias("ratio"), F.round(F.count(F.lit(1)) / F.sum("n"), 6).alias("diversity"))


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]


@query("AG-06", " union all ".join(f"select '{a}' a, '{b}' b, round(corr({a},{b}),6) r, abs(corr({a},{b}))>0.7 strong from lineitem" for a, b in _PAIRS))
def correlation_pairs(spark, sf):
    return S.correlations(T.read(spark, sf, "lineitem"), _FEATURES).select("a", "b", F.round("r", 6).alias("r"), (F.abs("r") > 0.7).alias("strong"))


@query("AG-07", "select 'l_quantity' a, 'same' b, null::double r union all select 'l_quantity', 'l_tax', round(corr(l_quantity,l_tax),6) from lineitem union all select 'same', 'l_tax', null")
def strict_correlation(spark, sf):
    df = T.read(spark, sf, "lineitem").withColumn("same", F.lit(1.0))
    return S.correlations(df, ["l_quantity", "same", "l_tax"]).select("a", "b", F.round("r", 6).alias("r"))


@query("AG-08 AG-11", f"with {_LONG}, s as (select feature, avg(value) mean, stddev_pop(value) std, quantile_cont(value,0.25) q1, quantile_cont(value,0.75) q3 from long group by 1) select l.feature, round(any_value(mean),4) mean, round(any_value(std),4) std, count(*) filter (value < q1-1.5*(q3-q1) or value > q3+1.5*(q3-q1)) outliers, round(100*count(*) filter (value < q1-1.5*(q3-q1) or value > q3+1.5*(q3-q1))/count(*),4) percent from long l join s using (feature) group by l.feature")
def strict_feature_stats(spark, sf):
    long = _long(spark, sf)
    both = S.moments(long, sample=False).select("feature", "mean", "std").join(S.outliers(long), "feature")
    return both.select("feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.col("iqr_outliers").alias("outliers"), F.round(100 * F.col("iqr_outliers") / F.col("n"), 4).alias("percent"))


@query("AG-09 AG-10", f"with {_LONG}, s as (select feature, avg(value) mean, stddev_pop(value) std, quantile_cont(value,0.25) q1, quantile_cont(value,0.75) q3 from long group by 1) select l.feature, count(*) n, count(*) filter (value is null) missing, count(*) filter (value < q1-1.5*(q3-q1) or value > q3+1.5*(q3-q1)) iqr_outliers, count(*) filter (abs(value-mean) > 3*std) z_outliers from long l join s using (feature) group by l.feature")
def iqr_outliers(spark, sf):
    return S.outliers(_long(spark, sf))


_TLONG = f"{TRACKS}, tl as (select genre, feature, value from (select genre, duration, price from tracks) unpivot (value for feature in (duration, price)))"


@query("AG-11", f"with {_TLONG} select genre, feature, count(*) n, round(avg(value),4) mean, round(stddev_pop(value),4) std from tl group by genre, feature")
def genre_features(spark, sf):
    long = S.unpivot(T.tracks(spark, sf).select("genre", "duration", "price"), ["genre"], ["duration", "price"])
    return long.groupBy("genre", "feature").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std"))


@query("AG-12", f"with {TRACKS}, g as (select avg(duration) m, stddev_samp(duration) s from tracks) select genre, count(*) n, round(any_value(m),4) mean, round(any_value(s),4) std from tracks, g group by genre")
def genre_features_global(spark, sf):
    """Counts per genre beside the statistics of the whole catalogue."""
    t = T.tracks(spark, sf)
    whole = t.agg(F.round(F.avg("duration"), 4).alias("mean"), F.round(F.stddev_samp("duration"), 4).alias("std"))
    return t.groupBy("genre").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(whole))


@query("AG-13", f"with {TRACKS}, f as (select genre, arg_min(duration+price, track_id) x from tracks group by genre) select a.genre a, b.genre b, round(a.x*b.x/(abs(a.x)*abs(b.x)),6) similarity from f a join f b on a.genre<=b.genre")
def genre_similarity_first(spark, sf):
    f = T.tracks(spark, sf).groupBy("genre").agg(F.min_by(F.col("duration") + F.col("price"), "track_id").alias("x"))
    a, b = f.select(F.col("genre").alias("a"), F.col("x").alias("x")), f.select(F.col("genre").alias("b"), F.col("x").alias("y"))
    return a.join(b, F.col("a") <= F.col("b")).select("a", "b", F.round(F.col("x") * F.col("y") / (F.abs("x") * F.abs("y")), 6).alias("similarity"))


@query("AG-15 AG-16", "select user_id::varchar track_id, round(avg(value),6) m0, round(avg(json_extract(props,'$.k')::double),6) m1, round(stddev_pop(value),6) s0, round(stddev_pop(json_extract(props,'$.k')::double),6) s1 from events group by 1")
def track_vectors(spark, sf):
    """Means of the channels, then their population stds, in fixed order."""
    f = T.frames(spark, sf).groupBy("track_id")
    return f.agg(F.round(F.avg("value"), 6).alias("m0"), F.round(F.avg("k"), 6).alias("m1"), F.round(F.stddev_pop("value"), 6).alias("s0"), F.round(F.stddev_pop("k"), 6).alias("s1"))


@query("AG-17 ML-06", f"with {TRACKS}, s as (select avg(duration) m1, nullif(stddev_pop(duration),0) s1, avg(price) m2, nullif(stddev_pop(price),0) s2 from tracks), z as (select track_id, (duration-m1)/coalesce(s1,1) a, (price-m2)/coalesce(s2,1) b from tracks, s) select track_id, round(a/sqrt(a*a+b*b),6) a, round(b/sqrt(a*a+b*b),6) b from z")
def catalogue_units(spark, sf):
    """z-scores by population std, rows of unit length."""
    t = T.tracks(spark, sf).select("track_id", "duration", "price")
    s = t.agg(*(f(c).alias(f"{n}_{c}") for c in ("duration", "price") for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)
    v = t.join(F.broadcast(s)).select("track_id", R.unit(F.array(z("duration"), z("price"))).alias("u"))
    return v.select("track_id", F.round(F.col("u")[0], 6).alias("a"), F.round(F.col("u")[1], 6).alias("b"))


@query("AG-18", f"with {TRACKS} select artist, count(*) n, count(distinct genre) genres, round(avg(duration),6) mean, round(stddev_pop(duration),6) std, min(duration) min, max(duration) max from tracks group by artist")
def artist_stats(spark, sf):
    d = F.col("duration")
    return T.tracks(spark, sf).groupBy("artist").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("genre").alias("genres"), F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_pop(d), 6).alias("std"), F.min(d).alias("min"), F.max(d).alias("max"))


@query("AG-19 AG-20", f"with {INTER}, u as (select user_id, count(*) n from inter group by 1) select (select count(*) from inter) interactions, (select count(*) from u) users, (select count(distinct track_id) from inter) items, round(avg(n),6) mean, round(stddev_pop(n),6) std, min(n) min, max(n) max, quantile_cont(n,0.5)::double median, round((select count(*) from inter)/(count(*)*(select count(distinct track_id) from inter)),9) density from u")
def interaction_summary(spark, sf):
    inter = T.interactions(spark, sf)
    per = inter.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    items = inter.agg(F.countDistinct("track_id").alias("items"))
    one = per.agg(F.sum("n").alias("interactions"), F.count(F.lit(1)).alias("users"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"), F.min("n").alias("min"), F.max("n").alias("max"), F.percentile("n", F.lit(0.5)).alias("median"))
    return one.join(items).withColumn("density", F.round(F.col("interactions") / (F.col("users") * F.col("items")), 9))


@query("AG-19 AG-22", f"with {RATED} select r rating, (select count(*) from rated where rating=r) n from range(1,6) t(r)")
def rating_histogram(spark, sf):
    bins = spark.range(1, 6).select(F.col("id").alias("rating"))
    counts = T.interactions(spark, sf).groupBy(F.col("rating").cast("long").alias("rating")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counts, "rating", "left").select("rating", F.coalesce("n", F.lit(0)).alias("n"))


@query("AG-21 JN-01", f"with {RATED}, {TRACKS}, {USERS} select u.user_id, count(r.track_id) n, round(coalesce(avg(rating),0),6) mean_rating, coalesce(string_agg(distinct genre, ',' order by genre),'') genres from users u left join rated r on r.user_id=u.user_id left join tracks t on t.track_id=r.track_id group by u.user_id")
def user_stats(spark, sf):
    inter = T.interactions(spark, sf).join(T.tracks(spark, sf).select("track_id", "genre"), "track_id")
    per = inter.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("m"), F.array_join(F.sort_array(F.collect_set("genre")), ",").alias("g"))
    all_users = T.users(spark, sf).select("user_id").join(per, "user_id", "left")
    return all_users.select("user_id", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("m", F.lit(0.0)), 6).alias("mean_rating"), F.coalesce("g", F.lit("")).alias("genres"))


@query("AG-22", f"with {SPLIT}, {USERS} select grp, count(*) filter (split='train') train, count(*) filter (split='validation') validation, count(*) filter (split='test') test from split join users using (user_id) group by grp")
def population_diagnostics(spark, sf):
    split = P.hash_split(T.interactions(spark, sf)).join(T.users(spark, sf).select("user_id", "grp"), "user_id")
    return split.groupBy("grp").pivot("split", ["train", "validation", "test"]).count()


_GENRES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("AG-23", f"with {RATED}, {TRACKS}, {USERS} select grp, " + ", ".join(f"round(avg(rating) filter (genre='{g}'),6) {g}" for g in _GENRES) + " from rated join tracks using (track_id) join users using (user_id) group by grp")
def archetype_genre_means(spark, sf):
    rows = T.interactions(spark, sf).join(T.tracks(spark, sf).select("track_id", "genre"), "track_id").join(T.users(spark, sf).select("user_id", "grp"), "user_id")
    return rows.groupBy("grp").pivot("genre", _GENRES).agg(F.round(F.avg("rating"), 6))


@query("AG-30", "select count(*) n, round(100*count(text)/count(*),4) text_coverage, round(100*count(lang)/count(*),4) lang_coverage, count(*) filter (trim(coalesce(text,''))='') blank, count(*)-count(distinct doc_id) repeated from documents")
def data_quality(spark, sf):
    d = T.read(spark, sf, "documents")
    share = lambda c: F.round(100 * F.count(c) / F.count(F.lit(1)), 4)
    return d.agg(F.count(F.lit(1)).alias("n"), share("text").alias("text_coverage"), share("lang").alias("lang_coverage"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"), (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("repeated"))


@query("AG-31 AG-32", "select event_type method, count(*) n, round(sum(value),4) total, round(avg(value),6) mean, min(value) min, max(value) max from events group by 1")
def timing_summary(spark, sf):
    v = F.col("value")
    return T.read(spark, sf, "events").groupBy(F.col("event_type").alias("method")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))


@query("AG-33 JN-05", f"with {COSINE}, p as (select score from scored where query_id<track_id) select count(*) n, round(avg(score),6) mean, round(stddev_pop(score),6) std, round(min(score),6) min, round(max(score),6) max, round(quantile_cont(score,0.5),6) median, round(count(*) filter (abs(score)<0.1)/count(*),6) sparsity from p")
def similarity_stats(spark, sf):
    v = T.vectors(spark, sf).select("track_id", F.col("genre").alias("grp"), "vec")
    found = A.cosine_summary(v)
    return found.select("n", *(F.round(c, 6).alias(c) for c in found.columns[1:]))


@query("AG-34", "with v as (select vec_id, embedding e from embeddings) select vec_id, list_position(list_transform(e, lambda x: abs(x)), list_max(list_transform(e, lambda x: abs(x)))) - 1 feature, round(e[list_position(list_transform(e, lambda x: abs(x)), list_max(list_transform(e, lambda x: abs(x))))]::double,6) weight from v")
def feature_importance(spark, sf):
    v = T.read(spark, sf, "embeddings").select("vec_id", "embedding", F.transform("embedding", lambda x: F.abs(x)).alias("m"))
    at = F.array_position("m", F.array_max("m"))
    return v.select("vec_id", (at - 1).alias("feature"), F.round(F.element_at("embedding", at.cast("int")).cast("double"), 6).alias("weight"))


@query("AG-35 AG-41", "select 'l_quantity' a, 'l_tax' b, round(greatest(-1,least(1,coalesce(corr(l_quantity,l_tax),0))),6) r from lineitem")
def report_correlation(spark, sf):
    """Constant and empty columns are dropped first; what is left undefined becomes 0."""
    df = T.read(spark, sf, "lineitem").withColumns({"same": F.lit(1.0), "none": F.lit(None).cast("double")})
    kept = S.varying_columns(df, ["l_quantity", "same", "none", "l_tax"])
    return S.correlations(df, kept).select("a", "b", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("r", F.lit(0.0)))), 6).alias("r"))


@query("AG-36 FN-04", f"with {TRACKS} select sha256('[' || string_agg('\"' || track_id || '\"', ',' order by track_id) || ']') digest from tracks")
def catalogue_hash(spark, sf):
    ids = T.tracks(spark, sf).agg(F.sort_array(F.collect_list("track_id")).alias("ids"))
    return ids.select(F.sha2(F.to_json("ids"), 256).alias("digest"))


@query("AG-37", f"with {_LONG}, e as (select feature, min(value) lo, max(value) hi from long group by 1) select l.feature, least(floor((value-lo)*20/(hi-lo))::bigint,19) bin, count(*) n from long l join e using (feature) where value is not null group by 1, 2")
def histogram_bins(spark, sf):
    return S.histogram(_long(spark, sf), 20)


@query("AG-38", "with c as (select p_brand artist, 100*count(*)/sum(count(*)) over () percent from part group by 1), g as (select count(*) filter (percent>=4) n from c) select artist, round(percent,6) percent from c, g where percent>=4 or n=0")
def artist_share(spark, sf):
    """Shares of 4 % and more; all of them if none is that large."""
    c = S.distribution(T.tracks(spark, sf), "artist").withColumn("big", F.count_if(F.col("percent") >= 4).over(Window.partitionBy()))
    return c.where((F.col("percent") >= 4) | (F.col("big") == 0)).select("artist", F.round("percent", 6).alias("percent"))


@query("AG-27 AG-28", f"with {COSINE}, c as (select query_genre t, genre p, row_number() over (partition by query_id order by score desc, track_id) rn from scored), m as (select t, p, count(*) n from c where rn=1 group by 1, 2), l as (select distinct genre g from vectors) select a.g y_true, b.g y_pred, coalesce(n,0) n, round(coalesce(100*coalesce(n,0)/nullif(sum(coalesce(n,0)) over (partition by a.g),0),0),6) percent from l a cross join l b left join m on m.t=a.g and m.p=b.g")
def nn_confusion(spark, sf):
    v = T.vectors(spark, sf)
    best = R.blocked_cosine_topk(v, v, 1)
    genre = lambda a, b: v.select(F.col("track_id").alias(a), F.col("genre").alias(b))
    counts = best.join(genre("query_id", "y_true"), "query_id").join(genre("track_id", "y_pred"), "track_id").groupBy("y_true", "y_pred").count()
    labels = v.select("genre").distinct()
    grid = labels.select(F.col("genre").alias("y_true")).join(labels.select(F.col("genre").alias("y_pred")))
    full = grid.join(counts, ["y_true", "y_pred"], "left").withColumn("n", F.coalesce("count", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("y_true"))
    return full.select("y_true", "y_pred", "n", F.round(F.coalesce(F.try_divide(100 * F.col("n"), total), F.lit(0.0)), 6).alias("percent"))
