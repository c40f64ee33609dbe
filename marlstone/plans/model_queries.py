"""Sampling, signatures, models and populations (SP, SG, ML)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import signature as G
from ..operators import models as M
from ..operators import population as N
from ..operators import protocol as P
from ..operators import ranking as R
from ..operators import sampling as S
from ..sources import files, sinks
from ..sources import tables as T
from ..storage import checkpoint
from .registry import INTER, RATED, TRACKS, USERS, VECTORS, query

_CAP = f"{TRACKS}, cap as (select genre, count(*) capacity from tracks group by genre)"


def _capacities(spark, sf):
    return T.tracks(spark, sf).groupBy("genre").agg(F.count(F.lit(1)).alias("capacity"))


_HAM = "{0}, e as (select *, {2}*{1}/sum({1}) over () x from {3}), f as (select *, floor(x)::bigint fl from e), o as (select *, row_number() over (order by (fl<{1})::int desc, x-fl desc, genre) rn, {2}-sum(fl) over () rest from f)"


@query("SP-03", f"with {_HAM.format(_CAP, 'capacity', 777, 'cap')} select genre, capacity, fl + (rn<=rest and fl<capacity)::int quota from o")
def hamilton_quota(spark, sf):
    return S.hamilton(_capacities(spark, sf), 777)


_BASE = "(select count(*)//20 from tracks)"
_RESIDUAL = f"{_CAP}, r as (select genre, capacity-least({_BASE},capacity) residual from cap where capacity>{_BASE})"
_LEFT = f"((select floor(0.39*count(*))::bigint from tracks)-(select sum(least({_BASE},capacity)) from cap))"


@query("SP-04", f"with {_HAM.format(_RESIDUAL, 'residual', _LEFT, 'r')} select c.genre, c.capacity, least({_BASE},c.capacity) + coalesce(fl + (rn<=rest and fl<residual)::int, 0) quota from cap c left join o using (genre)")
def genre_quotas(spark, sf):
    """39 % of the catalogue, a twentieth of it for each genre first."""
    n = T.tracks(spark, sf).count()
    return S.genre_quotas(_capacities(spark, sf), int(0.39 * n), n // 20)


_QUOTA = "q as (select genre, least(count(*),120) quota from tracks group by genre), good as (select t.track_id, t.genre, quota, row_number() over (partition by t.genre order by sha256('42:' || t.genre || ':' || t.track_id), t.track_id) nth from tracks t join q using (genre) where duration%5<>0 and not (t.genre='PROMO' and duration>20)), p as (select *, nth<=quota pr from good), w as (select (select sum(quota) from q) - (select count(*) from p where pr) missing), a as (select *, row_number() over (partition by pr order by sha256('42:global:' || track_id), track_id) place from p)"


@query("SP-05 SP-06 JN-10", f'with {TRACKS}, {_QUOTA} select track_id, genre, pr "primary" from a, w where pr or place<=missing')
def filled_quotas(spark, sf):
    t = T.tracks(spark, sf)
    quotas = t.groupBy("genre").agg(F.least(F.count(F.lit(1)), F.lit(120)).alias("quota"))
    ok = (F.col("duration") % 5 != 0) & ~((F.col("genre") == "PROMO") & (F.col("duration") > 20))
    return S.fill_quotas(t.select("track_id", "genre", ok.alias("ok")), quotas)


@query("SP-07", f"with {TRACKS}, n as (select *, row_number() over (partition by genre order by sha256('42:' || genre || ':' || track_id), track_id) nth from tracks) select track_id, genre from n order by case when nth<=20 then 0 else nth end, sha256('42:' || genre), nth limit 250")
def balanced_sample(spark, sf):
    return S.balanced_sample(T.tracks(spark, sf).select("track_id", "genre"), 250, 20)


@query("SP-08", f"with {VECTORS} select track_id, (row_number() over (partition by genre order by sha256('42:' || track_id), track_id)-1)%5 fold from vectors")
def stratified_folds(spark, sf):
    return S.stratified_folds(T.vectors(spark, sf).select("track_id", "genre"), "genre", "track_id", 5).select("track_id", F.col("fold").cast("long").alias("fold"))


@query("SP-09 SP-11", f"with {TRACKS}, n as (select track_id, row_number() over (order by sha256('42:' || track_id), track_id)-1 p, floor(count(*) over ()/7) s from tracks) select track_id, least(floor(p/s)::bigint,6) fold from n")
def shuffled_folds(spark, sf):
    return S.shuffled_folds(T.tracks(spark, sf).select("track_id"), "track_id", 7)


@query("SP-10", "with n as (select event_id, row_number() over (partition by event_type order by ts, event_id) r, count(*) over (partition by event_type) n from events) select event_id, case when r<=floor(n*0.8) then 'train' else 'test' end part from n")
def time_split(spark, sf):
    return S.time_split(T.read(spark, sf, "events"), ["ts", "event_id"], ["event_type"]).select("event_id", "part")


@query("SP-12", f"with {USERS}, r as (select seed, user_id, row_number() over (partition by seed order by sha256(seed || ':' || user_id), user_id) nth from users, (values (1),(2),(3)) s(seed)) select size, seed, user_id from r, (values (50),(100),(400)) z(size) where nth<=size")
def subsamples(spark, sf):
    return S.subsamples(T.users(spark, sf), [50, 100, 400], [1, 2, 3])


_PATH = "pts as (select user_id::varchar track_id, row_number() over (partition by user_id order by ts, event_id) t, value/100 x, json_extract(props,'$.k')::double/100 y from events), inc as (select *, coalesce(x-lag(x) over w,0) dx, coalesce(y-lag(y) over w,0) dy from pts window w as (partition by track_id order by t)), acc as (select *, coalesce(sum(dx) over b,0) ax, coalesce(sum(dy) over b,0) ay from inc window b as (partition by track_id order by t rows between unbounded preceding and 1 preceding))"


def _path(spark, sf):
    f = T.frames(spark, sf)
    t = F.row_number().over(Window.partitionBy("track_id").orderBy("ts", "event_id"))
    return f.select("track_id", t.alias("t"), (F.col("value") / 100).alias("x"), (F.col("k") / 100).alias("y"))


@query("SG-01 WK-15", f"with {_PATH} select track_id, round(sum(dx),10) s_x, round(sum(dy),10) s_y, round(sum(ax*dx+dx*dx/2),10) s_x_x, round(sum(ax*dy+dx*dy/2),10) s_x_y, round(sum(ay*dx+dy*dx/2),10) s_y_x, round(sum(ay*dy+dy*dy/2),10) s_y_y from acc group by track_id")
def path_signature_order2(spark, sf):
    s = G.signature_sql(_path(spark, sf), "track_id", ["t"], ["x", "y"], 2)
    return s.select("track_id", *(F.round(c, 10).alias(c) for c in s.columns if c not in ("track_id", "s")))


@query("SG-03 SG-08 SG-09 SG-10 FN-07", f"with {_PATH} select track_id, 15 length, round(sum(dx),4) x, round(sum(ax*dy+dx*dy/2),4) xy, 3 arm_length from acc group by track_id")
def signature_arms(spark, sf):
    """The kernel's signature of depth 3 once; an arm of one channel and depth 2 by projection."""
    p = _path(spark, sf)
    w = Window.partitionBy("track_id")
    p = p.withColumn("time", (F.col("t") - 1) / (F.max("t").over(w) - 1))
    s = G.signatures(p, ["time", "x", "y"], 3).where("reason_code is null")
    two = G.project_arm(F.col("signature"), G.arm_positions(3, [1, 2], 3))
    one = G.project_arm(F.col("signature"), G.arm_positions(3, [1], 2))
    return s.select("track_id", F.size(two).alias("length"), F.round(two[1], 4).alias("x"), F.round(two[4], 4).alias("xy"), F.size(one).alias("arm_length"))


@query("SG-04 SNK-09", "with p as (select user_id::varchar track_id, ts, event_id, lag(ts) over (partition by user_id order by event_id) prev from events) select track_id, case when count(*)<60 then 'too_few_rows' when bool_or(ts<prev) then 'time_not_monotone' end reason_code from p group by track_id")
def path_validation(spark, sf):
    p = T.frames(spark, sf).withColumn("prev", F.lag("ts").over(Window.partitionBy("track_id").orderBy("event_id")))
    bad = F.when(F.count(F.lit(1)) < 60, "too_few_rows").when(F.bool_or(F.col("ts") < F.col("prev")), "time_not_monotone")
    return p.groupBy("track_id").agg(bad.alias("reason_code"))


@query("SG-11 ST-05", f"with {TRACKS}, sig as (select distinct user_id::varchar track_id from events), vec as (select vec_id::varchar track_id from embeddings) select track_id, case when s.track_id is not null and v.track_id is not null then 'accepted' when s.track_id is null then 'no_signature' else 'no_vector' end outcome from tracks left join sig s using (track_id) left join vec v using (track_id)")
def catalogue_partition(spark, sf):
    sig = T.frames(spark, sf).select("track_id").distinct().withColumn("s", F.lit(True))
    vec = T.vectors(spark, sf).select("track_id", F.lit(True).alias("v"))
    both = T.tracks(spark, sf).join(sig, "track_id", "left").join(vec, "track_id", "left")
    return both.select("track_id", F.when(F.col("s") & F.col("v"), "accepted").when(F.col("s").isNull(), "no_signature").otherwise("no_vector").alias("outcome"))


@query("ML-01", f"with {INTER}, u as (select user_id, row_number() over (order by user_id)-1 user_ix from (select distinct user_id from inter)), i as (select track_id, row_number() over (order by track_id)-1 item_ix from (select distinct track_id from inter)) select user_ix, item_ix from inter join u using (user_id) join i using (track_id)")
def binary_matrix(spark, sf):
    return M.binary_matrix(T.interactions(spark, sf)).select(F.col("user_ix").cast("long").alias("user_ix"), F.col("item_ix").cast("long").alias("item_ix"))


_NEIGHBOURS = "norms as (select {0} i, sqrt(sum(rating*rating))+1e-12 n from rated group by 1), r as (select {1} o, {0} i, rating/n u from rated join norms on i={0}), p as (select a.i a, b.i b, sum(a.u*b.u) s from r a join r b on a.o=b.o and a.i<b.i group by 1, 2), k as (select a, b, round(s,6) similarity from p)"


@query("ML-09 ML-10", f"with {RATED}, {_NEIGHBOURS.format('track_id', 'user_id')}, t as (select *, row_number() over (partition by a order by similarity desc, b) rank from (select a, b, similarity from k union all select b, a, similarity from k)) select a, b, rank, similarity from t where rank<=5")
def item_neighbours(spark, sf):
    return M.top_neighbours(T.interactions(spark, sf), "track_id", "user_id", 5)


@query("ML-08", f"with {RATED}, {_NEIGHBOURS.format('user_id', 'track_id')}, t as (select *, row_number() over (partition by a order by similarity desc, b) rank from (select a, b, similarity from k union all select b, a, similarity from k)) select a, b, rank, similarity from t where rank<=5")
def user_neighbours(spark, sf):
    return M.top_neighbours(T.interactions(spark, sf), "user_id", "track_id", 5)


@query("ML-11", f"with {RATED}, a as (select user_id, track_id, score, row_number() over (partition by user_id order by score desc, track_id) r from rated), b as (select user_id, track_id, rating::double score, row_number() over (partition by user_id order by rating desc, track_id desc) r from rated), h as (select coalesce(x.user_id,y.user_id) user_id, coalesce(x.track_id,y.track_id) track_id, 0.7*coalesce(x.score,0)+0.3*coalesce(y.score,0) s from (from a where r<=10) x full join (from b where r<=10) y on x.user_id=y.user_id and x.track_id=y.track_id), t as (select *, row_number() over (partition by user_id order by round(s,9) desc, track_id) rank from h) select user_id, track_id, rank, round(s,6) score from t where rank<=5")
def hybrid_lists(spark, sf):
    i = T.interactions(spark, sf)
    a = R.rank_scores(i, ["user_id"], 10).select("user_id", "track_id", "score")
    b = R.rank_scores(i, ["user_id"], 10, score="rating", ties=F.col("track_id").desc()).select("user_id", "track_id", F.col("rating").cast("double").alias("score"))
    h = R.rank_scores(M.hybrid(a, b, 5).withColumn("score", F.round("score", 9)), ["user_id"], 5)
    return h.select("user_id", "track_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("ML-14", "with g as (select p_type genre, min(p_partkey) first from part group by 1), c as (select genre, row_number() over (order by first)-1 c from g) select genre, case when c<4 then c else 0 end category from c")
def label_categories(spark, sf):
    """The first four genres by appearance; the others share category 0."""
    g = T.read(spark, sf, "part").groupBy(F.col("p_type").alias("genre")).agg(F.min("p_partkey").alias("first"))
    c = (F.row_number().over(Window.partitionBy().orderBy("first")) - 1).cast("long")
    return g.withColumn("c", c).select("genre", F.when(F.col("c") < 4, F.col("c")).otherwise(0).alias("category"))


@query("ML-07", f"with {INTER}, {TRACKS}, asked as (select user_id, track_id from inter union all select user_id, 'none' from inter group by 1) select user_id, count(*) filter (i.track_id is not null) observed, count(*) filter (t.track_id is null) unknown from asked a left join inter i using (user_id, track_id) left join tracks t on t.track_id=a.track_id group by user_id")
def request_validation(spark, sf):
    i = T.interactions(spark, sf).select("user_id", "track_id")
    asked = i.unionByName(i.select("user_id").distinct().withColumn("track_id", F.lit("none")))
    seen = asked.join(i.withColumn("seen", F.lit(1)), ["user_id", "track_id"], "left").join(T.tracks(spark, sf).select("track_id", F.lit(1).alias("known")), "track_id", "left")
    return seen.groupBy("user_id").agg(F.count("seen").alias("observed"), F.count_if(F.col("known").isNull()).alias("unknown"))


@query("ML-02 ML-20")
def als_topk(spark, sf):
    m = M.binary_matrix(T.plays(spark, sf))
    model = M.als(m, rank=16, iterations=5)
    return M.recommend(model.userFactors, model.itemFactors, 10)


@query("ML-03")
def warp_topk(spark, sf):
    return M.warp_topk(M.binary_matrix(T.plays(spark, sf)), [1, 2], epochs=1)


@query("ML-04")
def warp_kos_topk(spark, sf):
    return M.warp_topk(M.binary_matrix(T.plays(spark, sf)), [1], epochs=1, kth=3)


@query("ML-12 ML-15")
def softmax_regression(spark, sf):
    return M.softmax_regression(T.vectors(spark, sf))


@query("ML-13")
def pseudo_categories(spark, sf):
    return M.pseudo_categories(T.vectors(spark, sf), 10)


@query("ML-17")
def pca_embedding(spark, sf):
    return M.pca_2d(T.vectors(spark, sf))


#: The six genres of the driver's table under the names that the archetypes prefer.
_MUSIC = {"STANDARD": "Rock", "PROMO": "Pop", "LARGE": "Electronic", "ECONOMY": "Hip-Hop", "MEDIUM": "Jazz", "SMALL": "Classical"}
_USERS_N, _FALLBACK_N = 200, 50


def _music(spark, sf):
    names = F.create_map(*(F.lit(x) for pair in _MUSIC.items() for x in pair))
    return T.tracks(spark, sf).select("track_id", F.coalesce(names[F.col("genre")], "genre").alias("genre"), "artist")


def _u(*parts):
    return "(('0x' || substr(sha256('2025:' || " + " || ':' || ".join(parts) + "),1,13))::bigint/4503599627370496.0)"


def _normal(*parts):
    return f"round(sqrt(-2*ln(1-{_u(*parts, chr(39) + 'u' + chr(39))}))*cos(2*pi()*{_u(*parts, chr(39) + 'v' + chr(39))}),9)"


def _choice(at, options):
    out, high = "case", 0.0
    for name, share in options[:-1]:
        high = round(high + share, 9)
        out += f" when {at}<{high} then '{name}'"
    return out + f" else '{options[-1][0]}' end"


def _place(parts, size):
    return f"(floor({_u(*parts, chr(39) + 'start' + chr(39))}*{size})::bigint + i*({N.STRIDES}::bigint[])[floor({_u(*parts, chr(39) + 'stride' + chr(39))}*{len(N.STRIDES)})::int+1]) % {size}"


_KINDS = ", ".join(f"('{a}', {e}::double, {d}::double, {n}::double, {b}::double, {r}::double, {f}::varchar[])" for a, _, e, d, n, b, r, f in N.ARCHETYPES)
_NOISY = ", ".join("least(1.0, greatest({0}, round({1}+0.1::double*{2},9)))::double {1}".format(0.1 if c == "engagement" else 0.0, c, _normal("user_id", f"'{c}'")) for c in N.PROFILE)
_PROFILES = f"""{TRACKS}, tr as (select track_id, case genre {' '.join(f"when '{a}' then '{b}'" for a, b in _MUSIC.items())} else genre end genre, artist from tracks),
 total as (select count(*) n from tr), genres as (select genre, count(*) size, row_number() over (order by genre)-1 genre_place from tr group by genre), g as (select count(*) g from genres),
 kinds(archetype, engagement, diversity, novelty, bias, rate, focus) as (values {_KINDS}),
 u0 as (select 'user_' || x user_id, {_choice(_u("'user_' || x", "'archetype'"), [a[:2] for a in N.ARCHETYPES])} archetype from range({_USERS_N}) t(x)),
 u1 as (select user_id, archetype, {_NOISY}, rate, focus from u0 join kinds using (archetype)),
 draws as (select user_id, unnest(range(least(floor(1+{_u('user_id', "'genres'")}*(greatest(2, least(4, g))-1)), g)::bigint)) i, g from u1, g where len(focus)=0),
 drawn as (select user_id, list(genre order by i) drawn from (select user_id, i, {_place(['user_id', "'genre'"], 'g')} genre_place from draws) join genres using (genre_place) group by user_id),
 users as (select user_id, archetype, engagement, diversity, novelty, bias, rate interaction_rate, coalesce(drawn, focus) preferred_genres, {_choice(_u('user_id', "'age'"), N.AGES)} age_group, {_choice(_u('user_id', "'frequency'"), N.FREQUENCIES)} listening_frequency,
  least(greatest(1, floor(floor(engagement*rate*n*0.3::double)*(0.5+{_u('user_id', "'count'")}))), n)::bigint declared from u1 left join drawn using (user_id), total)"""
_POPULATION = f"""{_PROFILES},
 items as (select track_id, genre, artist, row_number() over (order by genre, track_id)-1 place, row_number() over (partition by genre order by track_id)-1 in_genre, (count(*) over (partition by genre)/n + count(*) over (partition by artist)/n)/2 popularity from tr, total),
 own as (select user_id, declared, genre, size, sum(size) over (partition by user_id order by genre)::bigint upto, sum(size) over (partition by user_id)::bigint everything from (select user_id, declared, unnest(preferred_genres) genre from users) join genres using (genre)),
 ones as (select distinct user_id, least(floor(declared*0.7::double)::bigint, everything) n, everything from own),
 spots as (select user_id, {_place(['user_id', "'preferred'"], 'everything')} spot from (select user_id, everything, unnest(range(n)) i from ones)),
 chosen as (select user_id, place from spots join own using (user_id) join items on items.genre=own.genre and in_genre=spot-upto+size where spot<upto and spot>=upto-size),
 rest as (select user_id, declared, n, unnest(range(declared)) i from users, total),
 others as (select user_id, declared, i, {_place(['user_id', "'any'"], 'n')} place from rest),
 left_over as (select o.user_id, o.place, row_number() over (partition by o.user_id order by i) nth, declared - (select count(*) from chosen c where c.user_id=o.user_id) wanted from others o anti join chosen c on c.user_id=o.user_id and c.place=o.place),
 pairs as (select user_id, place from chosen union all select user_id, place from left_over where nth<=wanted),
 scored as (select user_id, track_id, genre, artist, least(1.0, round(bias*popularity + diversity*0.3::double*{_u('user_id', 'track_id', "'diversity'")} + novelty*0.2::double*{_u('user_id', 'track_id', "'novelty'")} + case when list_contains(preferred_genres, genre) then 0.3 else 0 end::double, 9))::double s from pairs join items using (place) join users using (user_id))"""


@query("SP-13", f"with {_PROFILES} select * from users")
def synthetic_users(spark, sf):
    """The profiles of the population."""
    return N.profiles(_music(spark, sf), _USERS_N)


@query("SP-13 SRC-14 SNK-08", f"with {_POPULATION} select user_id, track_id, greatest(1, least(5, floor(1+4*s)::int)) rating, s interaction_score, round({_u('user_id', 'track_id', chr(39) + 'time' + chr(39))},9) \"timestamp\", genre, artist from scored")
def synthetic_population(spark, sf):
    """The interactions of 200 users, exported and scanned again."""
    made = N.population(_music(spark, sf), _USERS_N)[1]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema)
    back = sinks.round_trip(spark, lambda p: sinks.write_new(made, p), lambda p: files.parquet(spark, p, kinds))
    return back.withColumn("timestamp", F.round("timestamp", 9))


@query("SP-17", "select ''::varchar rule, 0::bigint n where false")
def population_violations(spark, sf):
    tracks = _music(spark, sf)
    return N.violations(*(checkpoint(x) for x in N.population(tracks, _USERS_N)), tracks, _USERS_N)


_DOT = "+".join(f"v[{i + 1}]*p{i}" for i in range(5))


@query("SP-18", f"with {VECTORS}, items as (select track_id, vec v, row_number() over (order by track_id)-1 place, count(*) over () n from vectors), raw as (select 'user_' || x user_id, "
       + ", ".join(_normal("'user_' || x", f"'dim{i}'") + f" x{i}" for i in range(5))
       + f" from range({_FALLBACK_N}) t(x)), one as (select user_id, " + ", ".join(f"(x{i}-avg(x{i}) over ())/stddev_pop(x{i}) over () p{i}" for i in range(5))
       + f" from raw), draws as (select one.*, n, unnest(range(greatest(1, floor(0.3::double*n))::bigint)) i from one, (select any_value(n) n from items)), spots as (select *, {_place(['user_id', chr(39) + 'rated' + chr(39)], 'n')} place from draws) select user_id, track_id, greatest(1, least(5, trunc(round(3+2*({_DOT}),6))::int)) rating from spots join items using (place)")
def fallback_ratings(spark, sf):
    return N.fallback_ratings(T.vectors(spark, sf), _FALLBACK_N)
