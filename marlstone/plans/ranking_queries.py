"""Ranking, candidates, splits and ranking metrics (JN, WK, ST, SP, MT)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import pairs as A
from ..operators import protocol as P
from ..operators import ranking as R
from ..sources import tables as T
from ..storage import checkpoint
from .registry import COSINE, INTER, RANKED, RATED, SPLIT, TRACKS, UNIT, USERS, VECTORS, query


def _top10(spark, sf):
    v = T.vectors(spark, sf)
    top = R.blocked_cosine_topk(v, v, 10).withColumnRenamed("query_id", "user_id")
    return v, top


_METRICS = (
    RANKED
    + """, sizes as (select genre, count(*)-1 n from vectors group by genre),
 flagged as (select query_id, rank, (query_genre=t.genre)::int hit, n, sum((query_genre=t.genre)::int) over (partition by query_id order by rank) so_far
  from top10 t join sizes s on s.genre=t.query_genre),
 per_user as (select query_id user_id, k, sum(hit)/k "precision", coalesce(sum(hit)/nullif(any_value(n),0),0) recall, sum(hit/log2(rank+1)) dcg,
  coalesce(sum(hit/log2(rank+1)) / nullif(list_sum(list_transform(range(1, least(any_value(n),k)+1), lambda r: 1/log2(r+1))),0), 0) ndcg,
  coalesce(sum(hit*so_far/rank)/nullif(least(any_value(n),k),0),0) ap
  from flagged, (values (1),(5),(10)) ks(k) where rank<=k group by query_id, k)"""
)


@query("MT-01 MT-02 MT-03 MT-04 MT-05 JN-07", f'with {_METRICS} select user_id, k, round("precision",6) "precision", round(recall,6) recall, round(dcg,6) dcg, round(ndcg,6) ndcg, round(ap,6) ap from per_user')
def user_metrics(spark, sf):
    v, top = _top10(spark, sf)
    out = M.per_user(M.label_hits(top, v))
    return out.select("user_id", "k", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "dcg", "ndcg", "ap")))


@query("MT-06 MT-11 MT-12 MT-13", f'with {_METRICS} select k, round(avg("precision"),6) "precision", round(avg(recall),6) recall, round(avg(ndcg),6) ndcg, round(avg(ap),6) map, count(*) users from per_user group by k')
def ranking_metrics(spark, sf):
    v, top = _top10(spark, sf)
    out = M.per_user(M.label_hits(top, v))
    return out.groupBy("k").agg(*(F.round(F.avg(c), 6).alias(n) for c, n in (("precision", "precision"), ("recall", "recall"), ("ndcg", "ndcg"), ("ap", "map"))), F.count(F.lit(1)).alias("users"))


@query("WK-01 WK-02 WK-03 WK-04 JN-04 FN-14", f"with {RANKED} select query_id, track_id, rank, round(score,6) score from top10")
def cosine_topk(spark, sf):
    v = T.vectors(spark, sf)
    return R.blocked_cosine_topk(v, v, 10).select("query_id", "track_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("MT-10", f"with {RANKED} select k, round(count(distinct track_id)/(select count(*) from vectors),6) coverage from top10, (values (1),(5),(10)) ks(k) where rank<=k group by k")
def coverage_at_k(spark, sf):
    v, top = _top10(spark, sf)
    return M.coverage(top, v.count()).select("k", F.round("coverage", 6).alias("coverage"))


_LISTS = RANKED + ", pairs as (select a.query_id user_id, list_sum(list_transform(list_zip(x.u, y.u), lambda p: p[1]*p[2])) s from top10 a join top10 b on a.query_id=b.query_id and a.rank<b.rank join unit x on x.track_id=a.track_id join unit y on y.track_id=b.track_id where a.rank<=5 and b.rank<=5)"


@query("MT-07", f"with {_LISTS} select user_id, round(1-avg(s),6) diversity from pairs group by user_id")
def diversity_at_5(spark, sf):
    v, top = _top10(spark, sf)
    units = v.select("track_id", R.unit(F.col("vec")).alias("u"))
    return M.list_diversity(top, 5, units).select("user_id", F.round("diversity", 6).alias("diversity"))


@query("MT-08 AG-40", f"with {_LISTS}, d as (select user_id, avg(1-s) v from pairs group by user_id) select 'available' status, round(avg(v),6) \"value\", null::varchar reason_code from d union all select 'unavailable', null, 'no_distances'")
def optional_metrics(spark, sf):
    v, top = _top10(spark, sf)
    units = v.select("track_id", R.unit(F.col("vec")).alias("u"))
    found = M.list_diversity(top, 5, units).select(M.available(F.col("diversity")).alias("there"), M.unavailable("no_distances").alias("absent"))
    both = found.agg(M.optional_mean(F.col("there")).alias("a"), M.optional_mean(F.col("absent")).alias("b"))
    rows = both.select(F.explode(F.array("a", "b")).alias("m"))
    return rows.select("m.status", F.round("m.value", 6).alias("value"), "m.reason_code")


_POPULAR = SPLIT + ", pop as (select track_id, count(distinct user_id) n from split where split='train' group by track_id), n_users as (select count(distinct user_id) u from split)"
_POP_TOP = (
    _POPULAR
    + """, observed as (select user_id, track_id from split where split<>'test'),
 cand as (select o.user_id, p.track_id, p.n from (select distinct user_id from observed) o cross join pop p anti join observed x on x.user_id=o.user_id and x.track_id=p.track_id),
 ranked as (select *, row_number() over (partition by user_id order by n desc, track_id) rank from cand), top10 as (select * from ranked where rank<=10)"""
)


def _split(spark, sf):
    """Ids, score and part of each interaction, made once for all that reads them."""
    return checkpoint(P.hash_split(T.interactions(spark, sf)).select("user_id", "track_id", "score", "split"))


def _popular_top10(spark, sf):
    split = _split(spark, sf)
    popular = split.where("split = 'train'").groupBy("track_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    observed = split.where("split <> 'test'")
    return split, popular, P.unobserved_topk(popular, observed, 10)


@query("JN-02 ST-01 ST-02 WK-02 SP-01", f"with {_POP_TOP} select user_id, rank, track_id, n::double score from top10")
def popular_unobserved_topk(spark, sf):
    return _popular_top10(spark, sf)[2].withColumn("rank", F.col("rank").cast("long"))


@query("MT-09", f"with {_POP_TOP} select user_id, round(avg(1-n/(select u from n_users)),6) novelty from top10 group by user_id")
def novelty_at_10(spark, sf):
    split, popular, top = _popular_top10(spark, sf)
    n = split.select("user_id").distinct().count()
    return M.novelty(top.drop("score"), popular.select("track_id", (F.col("score") / n).alias("popularity"))).select("user_id", F.round("novelty", 6).alias("novelty"))


@query("JN-09 MT-16", f"with {_POP_TOP}, {TRACKS}, q as (select user_id, arg_min(track_id, (-score, track_id)) track_id from split where split<>'test' group by user_id), f as (select t.user_id, t.rank, (a.genre<>b.genre)::int other from top10 t join q on q.user_id=t.user_id join tracks a on a.track_id=q.track_id join tracks b on b.track_id=t.track_id) select user_id, k, round(sum(other)/k,6) cross_genre_rate from f, (values (5),(10)) ks(k) where rank<=k group by user_id, k")
def cross_genre_rate(spark, sf):
    split, _, top = _popular_top10(spark, sf)
    genre = T.tracks(spark, sf).select("track_id", "genre")
    q = P.query_items(split.where("split <> 'test'")).join(genre, "track_id").select("user_id", F.col("genre").alias("query_genre"))
    rows = top.join(genre, "track_id").join(q, "user_id").withColumn("k", F.explode(F.array(F.lit(5), F.lit(10)))).where("rank <= k")
    return rows.groupBy("user_id", "k").agg(F.round(F.sum((F.col("genre") != F.col("query_genre")).cast("int")) / F.first("k"), 6).alias("cross_genre_rate"))


_COLD = f", {TRACKS}, cold as (select track_id from tracks order by sha256('42:cold:' || track_id), track_id limit (select floor(0.15*count(*))::bigint from tracks))"


@query("SP-02", f"with {TRACKS}, cold as (select track_id from tracks order by sha256('42:cold:' || track_id), track_id limit (select floor(0.15*count(*))::bigint from tracks)) select track_id from cold")
def cold_tracks(spark, sf):
    return P.cold_items(T.tracks(spark, sf))


@query("JN-10 MT-17 SP-14", f"with {SPLIT}{_COLD}, held as (select s.*, c.track_id is not null is_cold, case when c.track_id is not null then 'test' else s.split end part from split s left join cold c on c.track_id=s.track_id) select user_id, part, count(*) n, sum(is_cold::int)::bigint n_cold from held group by user_id, part")
def withheld_split(spark, sf):
    held = P.withhold(P.hash_split(T.interactions(spark, sf)), P.cold_items(T.tracks(spark, sf)))
    return held.groupBy("user_id", F.col("split").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("cold").cast("int")).alias("n_cold"))


@query("MT-17", f"with {RANKED}, ids as (select track_id from vectors), cold as (select track_id from ids order by sha256('42:cold:' || track_id), track_id limit (select floor(0.15*count(*))::bigint from ids)), f as (select query_id user_id, (c.track_id is not null)::int is_cold, (query_genre=genre)::int hit from top10 t left join cold c on c.track_id=t.track_id where rank<=5) select user_id, round(sum(is_cold)/5,6) cold_share, round(sum(is_cold*hit)/5,6) cold_hits, round(sum((1-is_cold)*hit)/5,6) warm_hits, round(sum(hit)/5,6) \"precision\" from f group by user_id")
def cold_warm_decomposition(spark, sf):
    v, top = _top10(spark, sf)
    flagged = M.label_hits(top, v).where("rank <= 5").join(P.cold_items(v).withColumn("cold", F.lit(1)), "track_id", "left")
    cold = F.coalesce("cold", F.lit(0))
    share = lambda c: F.round(F.sum(c) / 5, 6)
    return flagged.groupBy("user_id").agg(share(cold).alias("cold_share"), share(cold * F.col("hit")).alias("cold_hits"), share((1 - cold) * F.col("hit")).alias("warm_hits"), share(F.col("hit")).alias("precision"))


@query("SP-01 ST-04", f"with {SPLIT} select user_id, track_id, split from split")
def hash_split(spark, sf):
    return P.hash_split(T.interactions(spark, sf)).select("user_id", "track_id", "split")


@query("WK-11", f"with {SPLIT}, r as (select *, row_number() over (partition by user_id order by score desc, track_id) rn from split where split<>'test') select user_id, track_id, score from r where rn=1")
def query_item(spark, sf):
    return P.query_items(P.hash_split(T.interactions(spark, sf)).where("split <> 'test'")).select("user_id", "track_id", "score")


@query("JN-02 JN-03 ST-04", f"with {SPLIT}, {TRACKS}, m as (select count(*) n from tracks) select user_id, (select n from m) - count(distinct track_id) filter (split<>'test') candidates, count(*) filter (split='test') relevant from split group by user_id")
def candidate_counts(spark, sf):
    """Candidates and relevant tracks of each user, without making the pairs."""
    split = P.hash_split(T.interactions(spark, sf)).join(T.tracks(spark, sf).select("track_id"), "track_id", "left_semi")
    n = T.tracks(spark, sf).count()
    test = F.col("split") == "test"
    return split.groupBy("user_id").agg((F.lit(n) - F.count(F.when(~test, 1))).alias("candidates"), F.count(F.when(test, 1)).alias("relevant"))


@query("JN-03", f"with {SPLIT}, {TRACKS}, small as (select track_id from tracks where genre<>'PROMO') select user_id, count(*) filter (s.track_id is not null) relevant, count(*) filter (s.track_id is null) out_of_catalogue from split left join small s using (track_id) where split='test' group by user_id")
def relevance_split(spark, sf):
    test = P.hash_split(T.interactions(spark, sf)).where("split = 'test'")
    small = T.tracks(spark, sf).where("genre <> 'PROMO'").select("track_id")
    inside = test.join(small, "track_id", "left_semi").withColumn("inside", F.lit(1))
    outside = test.join(small, "track_id", "left_anti").withColumn("inside", F.lit(0))
    return inside.unionByName(outside).groupBy("user_id").agg(F.sum("inside").alias("relevant"), F.sum(1 - F.col("inside")).alias("out_of_catalogue"))


@query("WK-05", f"with {COSINE}, r as (select *, row_number() over (partition by query_id order by score desc, track_id::bigint) rank from scored) select query_id, track_id, rank from r where rank<=5")
def engine_recommend(spark, sf):
    """Ties keep the order of the input (here the number of the vector)."""
    v = T.vectors(spark, sf)
    top = R.blocked_cosine_topk(v, v, 5, tie=int, ties=F.col("track_id").cast("long").asc())
    return top.select("query_id", "track_id", F.col("rank").cast("long").alias("rank"))


@query("WK-06", f"with {COSINE}, r as (select *, row_number() over (partition by query_id order by score desc, track_id::bigint desc) rank from scored) select query_id, track_id, rank from r where rank<=5")
def softmax_recommend(spark, sf):
    """Ties go to the later vector."""
    v = T.vectors(spark, sf)
    top = R.blocked_cosine_topk(v, v, 5, tie=lambda name: -int(name), ties=F.col("track_id").cast("long").desc())
    return top.select("query_id", "track_id", F.col("rank").cast("long").alias("rank"))


@query("WK-07", f"with {UNIT}, s as (select a.track_id query_id, b.track_id, round(list_sum(list_transform(list_zip(a.u,b.u), lambda p: p[1]*p[2])),9) score from unit a, unit b), r as (select *, row_number() over (partition by query_id order by score desc, track_id) rank from s) select query_id, track_id, rank, round(score,6) score from r where rank<=5 and score>0")
def content_similar(spark, sf):
    """Keeps the query itself (rank 1); cuts first, then drops scores of 0 and below."""
    v = T.vectors(spark, sf)
    own = v.select(F.col("track_id").alias("query_id"), "track_id", F.lit(1.0).alias("score"))
    scored = R.blocked_cosine_topk(v, v, 5).drop("rank").unionByName(own)
    return R.rank_scores(scored, ["query_id"], 5).where("score > 0").select("query_id", "track_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_LIKED = "liked as (select track_id from vectors where genre='3')"


@query("WK-08", f"with {COSINE}, {_LIKED} select track_id, round(avg(score),6) score from scored where query_id in (from liked) and track_id not in (from liked) group by track_id")
def liked_mean_similarity(spark, sf):
    """Mean cosine to the liked tracks: the mean of unit vectors is enough, no pairs are made."""
    units = T.vectors(spark, sf).select("track_id", "genre", R.unit(F.col("vec")).alias("u"))
    centre = units.where("genre = '3'").select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    mean = centre.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    return units.where("genre <> '3'").join(F.broadcast(mean)).select("track_id", F.round(R.dot(F.col("u"), F.col("c")), 6).alias("score"))


@query("WK-09", f"with {UNIT}, s as (select b.track_id, list_sum(list_transform(list_zip(a.u,b.u), lambda p: p[1]*p[2])) score from unit a, unit b), g as (select track_id, round(avg(score),6) score from s group by 1) select track_id, score from g")
def global_mean_similarity(spark, sf):
    units = T.vectors(spark, sf).select("track_id", R.unit(F.col("vec")).alias("u"))
    centre = units.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    mean = centre.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    return units.join(F.broadcast(mean)).select("track_id", F.round(R.dot(F.col("u"), F.col("c")), 6).alias("score"))


@query("WK-10", f"with {TRACKS}, n as (select *, row_number() over (partition by genre order by track_id) r from tracks), pairs as (select a.track_id, b.track_id similar_id, row_number() over (partition by a.track_id order by b.track_id) rank from n a join n b on a.genre=b.genre and a.track_id<>b.track_id where b.r<=6) select * from pairs where rank<=5")
def same_genre_tracks(spark, sf):
    """First five other tracks of the genre by id; only the first six of a genre can be among them."""
    t = T.tracks(spark, sf).select("track_id", "genre")
    heads = t.withColumn("r", F.row_number().over(Window.partitionBy("genre").orderBy("track_id"))).where("r <= 6")
    pairs = t.join(heads.select("genre", F.col("track_id").alias("similar_id")), "genre").where("track_id <> similar_id")
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy("similar_id"))
    return pairs.select("track_id", "similar_id", rank.cast("long").alias("rank")).where("rank <= 5")


@query("WK-12 ML-18", f"with {_METRICS}, arms as (select k, avg(ndcg) metric from per_user group by k) select arg_min(k, (-round(metric,9), k)) arm, round(max(metric),6) metric from arms")
def select_arm(spark, sf):
    v, top = _top10(spark, sf)
    arms = M.per_user(M.label_hits(top, v)).groupBy("k").agg(F.round(F.avg("ndcg"), 9).alias("metric"))
    return arms.agg(F.min_by("k", F.struct(-F.col("metric"), F.col("k"))).alias("arm"), F.round(F.max("metric"), 6).alias("metric"))


@query("WK-16", f"with {RATED}, m as (select track_id, round(avg(rating),6) v from rated group by track_id having count(*)>=5), b as (select max(v) top from m) select track_id, v from m, b where abs(v-top)<=1e-9")
def best_or_tied(spark, sf):
    means = T.interactions(spark, sf).groupBy("track_id").agg(F.round(F.avg("rating"), 6).alias("v"), F.count(F.lit(1)).alias("n")).where("n >= 5").drop("n")
    return means.join(F.broadcast(means.agg(F.max("v").alias("top")))).where(F.abs(F.col("v") - F.col("top")) <= 1e-9).select("track_id", "v")


@query("WK-17 JN-13", "select p_name title, min(p_partkey) kept, count(*) n from part group by p_name")
def first_per_title(spark, sf):
    p = T.read(spark, sf, "part")
    kept = R.first_by(p, ["p_name"], F.asc("p_partkey")).select(F.col("p_name").alias("title"), F.col("p_partkey").alias("kept"))
    return kept.join(p.groupBy(F.col("p_name").alias("title")).agg(F.count(F.lit(1)).alias("n")), "title")


@query("WK-13 ML-16 SP-08", f"with {COSINE}, f as (select track_id, (row_number() over (partition by genre order by sha256('42:' || track_id), track_id)) % 5 fold from vectors), c as (select s.*, row_number() over (partition by query_id order by score desc, s.track_id) rn from scored s join f a on a.track_id=s.query_id join f b on b.track_id=s.track_id where a.fold<>b.fold) select query_id, query_genre y_true, genre y_pred from c where rn=1")
def nearest_other_fold(spark, sf):
    return _nearest(spark, sf)


def _nearest(spark, sf):
    """1-NN among the vectors of other folds: one search in which a fold does not see itself."""
    v = T.vectors(spark, sf)
    order = Window.partitionBy("genre").orderBy(P.hash_order(42, F.col("track_id")), "track_id")
    v = v.withColumn("fold", F.row_number().over(order) % 5)
    out = R.blocked_cosine_topk(v, v, 1, apart="fold")
    truth, guess = v.select(F.col("track_id").alias("query_id"), F.col("genre").alias("y_true")), v.select("track_id", F.col("genre").alias("y_pred"))
    return out.join(truth, "query_id").join(guess, "track_id").select("query_id", "y_true", "y_pred")


@query("MT-21", f"with {_METRICS}, big as (select genre from vectors group by genre having count(*)>=45) select p.user_id, round(\"precision\",6) \"precision\", round(recall,6) recall from per_user p join vectors v on v.track_id=p.user_id join big using (genre) where k=5")
def same_genre_retrieval(spark, sf):
    v, top = _top10(spark, sf)
    big = v.groupBy("genre").agg(F.count(F.lit(1)).alias("n")).where("n >= 45").select("genre")
    users = v.join(big, "genre", "left_semi").select(F.col("track_id").alias("user_id"))
    return M.per_user(M.label_hits(top, v), (5,)).join(users, "user_id", "left_semi").select("user_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


_SEEDS = (
    COSINE
    + """, seeded as (select seed, query_id, query_genre, genre, track_id, round(score + 0.2*(('0x' || substr(sha256(seed || ':' || query_id || ':' || track_id),1,8))::ubigint / 4294967296.0), 9) score
  from scored, (values (1),(2),(3),(4),(5)) s(seed)),
 ranked as (select *, row_number() over (partition by seed, query_id order by score desc, track_id) rank from seeded),
 top as (select * from ranked where rank<=5),
 seed_user as (select seed, query_id user_id, sum((genre=query_genre)::int)/5 p from top group by seed, query_id)"""
)


def _seeded(spark, sf):
    """Five seeds of a perturbed scorer: the best five of each vector and seed."""
    v = T.vectors(spark, sf).select("track_id", F.col("genre").alias("grp"), "vec")
    cores = spark.sparkContext.defaultParallelism
    block = max(256, min(4096, -(-v.count() // (2 * cores))))
    fields = "seed int, a_track_id string, b_track_id string, a_genre string, b_genre string, score double"
    rows = A.block_pairs(v, v, A.perturbed_topk(5, [1, 2, 3, 4, 5]), fields, block, 2 * R.BLOCK)
    return v, R.rank_scores(rows, ["seed", "a_track_id"], 5, item="b_track_id")


@query("MT-14 AG-26 ST-05", f"with {_SEEDS}, u as (select user_id, avg(p) m from seed_user group by user_id), c as (select seed, count(distinct track_id)/(select count(*) from vectors) cov from top group by seed), s as (select seed, avg(p) m from seed_user group by seed) select round((select avg(m) from u),6) \"precision\", round((select avg(cov) from c),6) coverage, round((select stddev_pop(m) from s),6) variability")
def stochastic_aggregate(spark, sf):
    v, top = _seeded(spark, sf)
    top = checkpoint(top)  # read three times
    top = top.withColumn("hit", (F.col("a_genre") == F.col("b_genre")).cast("int"))
    per = top.groupBy("seed", "a_track_id").agg((F.sum("hit") / 5).alias("p"))
    users = per.groupBy("a_track_id").agg(F.avg("p").alias("m")).agg(F.round(F.avg("m"), 6).alias("precision"))
    cover = top.groupBy("seed").agg((F.countDistinct("b_track_id") / F.lit(v.count())).alias("c")).agg(F.round(F.avg("c"), 6).alias("coverage"))
    spread = per.groupBy("seed").agg(F.avg("p").alias("m")).agg(F.round(F.stddev_pop("m"), 6).alias("variability"))
    return users.join(cover).join(spread)


@query("AG-25", f"with {_SEEDS} select coalesce(seed::varchar,'all') run, round(avg(p),6) mean, round(stddev_pop(p),6) std, round(var_pop(p),6) var from seed_user group by rollup(seed)")
def stability_by_seed(spark, sf):
    _, top = _seeded(spark, sf)
    per = top.groupBy("seed", "a_track_id").agg((F.sum((F.col("a_genre") == F.col("b_genre")).cast("int")) / 5).alias("p"))
    out = per.rollup("seed").agg(F.round(F.avg("p"), 6).alias("mean"), F.round(F.stddev_pop("p"), 6).alias("std"), F.round(F.var_pop("p"), 6).alias("var"))
    return out.select(F.coalesce(F.col("seed").cast("string"), F.lit("all")).alias("run"), "mean", "std", "var")


@query("MT-18 MT-20", f'with {_METRICS}, again as (select query_id user_id, sum(hit)/5 p from flagged where rank<=5 group by 1) select count(*) checked, sum((abs(p-"precision")>1e-15)::int)::bigint differing from again join per_user using (user_id) where k=5')
def metric_audit(spark, sf):
    v, top = _top10(spark, sf)
    flagged = M.label_hits(top, v)
    again = flagged.where("rank <= 5").groupBy("user_id").agg((F.sum("hit") / 5).alias("p"))
    both = again.join(M.per_user(flagged, (5,)), "user_id")
    return both.agg(F.count(F.lit(1)).alias("checked"), F.sum((F.abs(F.col("p") - F.col("precision")) > 1e-15).cast("int")).alias("differing"))


@query("MT-19 AG-29", f"with {SPLIT}, a as (select user_id, list(track_id) l from split where split='train' group by 1), b as (select user_id, list(track_id) l from split where split='test' group by 1) select a.user_id, len(a.l) n_train, len(b.l) n_test, len(list_intersect(a.l, b.l)) overlap from a join b using (user_id)")
def overlap_report(spark, sf):
    split = P.hash_split(T.interactions(spark, sf))
    lists = split.groupBy("user_id").agg(F.collect_list(F.when(F.col("split") == "train", F.col("track_id"))).alias("a"), F.collect_list(F.when(F.col("split") == "test", F.col("track_id"))).alias("b"))
    return lists.select("user_id", *(F.size(c).cast("long").alias(n) for c, n in (("a", "n_train"), ("b", "n_test"))), F.size(F.array_intersect("a", "b")).cast("long").alias("overlap"))


@query("MT-22 ST-03", f"with {RANKED}, f as (select query_id, sum((query_genre=genre)::int)/5 p from top10 where rank<=5 group by query_id having count(distinct track_id)=5) select round(avg(p),6) mean_p5, count(*) users from f")
def mean_precision_5(spark, sf):
    v, top = _top10(spark, sf)
    flagged = M.label_hits(top.where("rank <= 5"), v)
    full = flagged.groupBy("user_id").agg(F.countDistinct("track_id").alias("n"), (F.sum("hit") / 5).alias("p"))
    p = full.where("n = 5")
    return p.agg(F.round(F.avg("p"), 6).alias("mean_p5"), F.count(F.lit(1)).alias("users"))


@query("JN-11 AG-24", f'with {_METRICS} select genre grp, count(*) n, round(avg(1-"precision"),6) mean, round(stddev_pop(1-"precision"),6) std from per_user p join vectors v on v.track_id=p.user_id where k=5 group by genre')
def group_errors(spark, sf):
    v, top = _top10(spark, sf)
    errors = M.per_user(M.label_hits(top, v), (5,)).select("user_id", (1 - F.col("precision")).alias("e"))
    named = errors.join(v.select(F.col("track_id").alias("user_id"), F.col("genre").alias("grp")), "user_id")
    return named.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("e"), 6).alias("mean"), F.round(F.stddev_pop("e"), 6).alias("std"))


@query("SP-15", f"with {TRACKS}, {SPLIT}, t as (select distinct track_id from split where split='train'), r as (select genre, track_id, row_number() over (partition by genre order by track_id) rn from tracks semi join t using (track_id)) select genre, track_id from r where rn<=5")
def genre_ground_truth(spark, sf):
    train = P.hash_split(T.interactions(spark, sf)).where("split = 'train'").select("track_id").distinct()
    known = T.tracks(spark, sf).select("genre", "track_id").join(train, "track_id", "left_semi")
    return known.withColumn("rn", F.row_number().over(Window.partitionBy("genre").orderBy("track_id"))).where("rn <= 5").select("genre", "track_id")


@query("SP-16", f"with {UNIT}, s as (select a.track_id query_id, b.track_id, round(list_sum(list_transform(list_zip(a.u,b.u), lambda p: p[1]*p[2])),9) score from unit a, unit b), r as (select *, row_number() over (partition by query_id order by score desc, track_id)-1 pos from s) select query_id, track_id, pos from r where pos between 1 and 5")
def similarity_ground_truth(spark, sf):
    """Positions 1 to 5 of the full row, position 0 being the vector itself."""
    v = T.vectors(spark, sf)
    own = v.select(F.col("track_id").alias("query_id"), "track_id", F.lit(1.0).alias("score"))
    ranked = R.rank_scores(R.blocked_cosine_topk(v, v, 6).drop("rank").unionByName(own), ["query_id"], 6)
    return ranked.select("query_id", "track_id", (F.col("rank") - 1).cast("long").alias("pos")).where("pos between 1 and 5")


@query("JN-08 MT-15", f"with {_SEEDS}, a as (select user_id, p from seed_user where seed=1), b as (select user_id, p from seed_user where seed=2) select a.user_id, round(a.p-b.p,6) d from a full join b on a.user_id=b.user_id")
def aligned_differences(spark, sf):
    _, top = _seeded(spark, sf)
    per = top.groupBy("seed", F.col("a_track_id").alias("user_id")).agg((F.sum((F.col("a_genre") == F.col("b_genre")).cast("int")) / 5).alias("p"))
    a, b = (per.where(F.col("seed") == s).select("user_id", F.col("p").alias(n)) for s, n in ((1, "a"), (2, "b")))
    return a.join(b, "user_id", "full").select("user_id", F.round(F.col("a") - F.col("b"), 6).alias("d"))
