"""Classification metrics and statistical inference (CL, IN, JN-14)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import classification as C
from ..operators import inference as I
from ..operators import protocol as P
from ..operators import ranking as R
from ..sources import tables as T
from .ranking_queries import _nearest
from .registry import COSINE, INTER, UNIT, VECTORS, query

_NN = f"{COSINE}, f as (select track_id, (row_number() over (partition by genre order by sha256('42:' || track_id), track_id)) % 5 fold from vectors), c as (select s.*, a.fold, row_number() over (partition by query_id order by score desc, s.track_id) rn from scored s join f a on a.track_id=s.query_id join f b on b.track_id=s.track_id where a.fold<>b.fold), p as (select query_id, query_genre y_true, genre y_pred, fold from c where rn=1)"
_CLASS = f"{_NN}, l as (select y_true label from p union select y_pred from p), k as (select label, count(*) filter (y_true=label) support, count(*) filter (y_pred=label) predicted, count(*) filter (y_true=label and y_pred=label) hits from l, p group by label), m as (select label, support, coalesce(hits/nullif(predicted,0),0) \"precision\", coalesce(hits/nullif(support,0),0) recall from k), pc as (select *, coalesce(2*\"precision\"*recall/nullif(\"precision\"+recall,0),0) f1 from m)"


@query("CL-01 CL-02 CL-03 CL-10 ML-19", f'with {_CLASS}, a as (select avg((y_true=y_pred)::int) acc from p) select count(*) classes, round(any_value(acc),6) accuracy, round(avg("precision"),6) macro_precision, round(avg(recall),6) macro_recall, round(avg(f1),6) macro_f1, round(sum("precision"*support)/sum(support),6) weighted_precision, round(sum(recall*support)/sum(support),6) weighted_recall, round(sum(f1*support)/sum(support),6) weighted_f1, round(any_value(acc),6) micro_f1 from pc, a')
def classification_summary(spark, sf):
    s = C.summary(_nearest(spark, sf).select("y_true", "y_pred"))
    return s.select("classes", *(F.round(c, 6).alias(c) for c in s.columns if c != "classes"))


@query("CL-05", f'with {_CLASS} select label, round("precision",6) "precision", round(recall,6) recall, round(f1,6) f1, support from pc')
def classification_report(spark, sf):
    c = C.per_class(_nearest(spark, sf).select("y_true", "y_pred"))
    return c.select("label", *(F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")), "support")


_LABELS = [str(i) for i in range(10)]


@query("CL-04", f"with {_NN} select y_true, " + ", ".join(f"count(*) filter (y_pred='{i}') p{i}" for i in _LABELS) + " from p group by y_true")
def confusion_matrix(spark, sf):
    m = _nearest(spark, sf).groupBy("y_true").pivot("y_pred", _LABELS).count().fillna(0)
    return m.select("y_true", *(F.col(i).alias(f"p{i}") for i in _LABELS))


_CENTRES = f"{UNIT}, x as (select genre, i, avg(u[i+1]) c from unit, range(64) t(i) group by 1, 2), cv as (select genre label, list(c order by i) c from x group by 1), sc as (select track_id, u.genre y_true, label, round(list_sum(list_transform(list_zip(u,c), lambda p: p[1]*p[2])),9) score from unit u, cv)"


def _centre_scores(spark, sf):
    """Each vector's product with the mean of every class."""
    u = T.vectors(spark, sf).select("track_id", "genre", R.unit(F.col("vec")).alias("u"))
    x = u.select("genre", F.posexplode("u").alias("i", "x")).groupBy("genre", "i").agg(F.avg("x").alias("c"))
    centres = x.groupBy(F.col("genre").alias("label")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda p: p["c"]).alias("c"))
    return u.join(F.broadcast(centres)).select("track_id", F.col("genre").alias("y_true"), "label", F.round(R.dot(F.col("u"), F.col("c")), 9).alias("score"))


@query("CL-06", f"with {_CENTRES}, r as (select *, rank() over (partition by label order by score) + (count(*) over (partition by label, score)-1)/2 rk from sc) select label, round((sum(rk) filter (y_true=label) - count(*) filter (y_true=label)*(count(*) filter (y_true=label)+1)/2)/(count(*) filter (y_true=label)*count(*) filter (y_true<>label)),6) auc, count(*) filter (y_true=label) support from r group by label")
def auc_per_class(spark, sf):
    return C.one_vs_rest_auc(_centre_scores(spark, sf)).withColumn("auc", F.round("auc", 6))


@query("ML-15 ML-16 WK-12", f"with {_CENTRES} select track_id, y_true, arg_min(label, (-score, label)) y_pred from sc group by 1, 2")
def centroid_prediction(spark, sf):
    s = _centre_scores(spark, sf)
    return s.groupBy("track_id", "y_true").agg(F.min_by("label", F.struct(-F.col("score"), F.col("label"))).alias("y_pred"))


@query("CL-08 SP-08 ML-19", f"with {_NN} select fold, count(*) n, round(avg((y_true=y_pred)::int),6) accuracy from p group by fold")
def fold_accuracy(spark, sf):
    v = T.vectors(spark, sf)
    order = Window.partitionBy("genre").orderBy(P.hash_order(42, F.col("track_id")), "track_id")
    folds = v.select(F.col("track_id").alias("query_id"), (F.row_number().over(order) % 5).cast("long").alias("fold"))
    return _nearest(spark, sf).join(folds, "query_id").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")), 6).alias("accuracy"))


@query("CL-09", "with m as (select event_type model, round(avg(value),6) score from events group by 1) select model, score, row_number() over (order by score desc, model) place from m")
def model_order(spark, sf):
    m = T.read(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.round(F.avg("value"), 6).alias("score"))
    return m.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "model")).cast("long"))


#: Mean value of each user by event type, paired with the next type.
_DIFF = "m as (select user_id, event_type, avg(value) v from events group by 1, 2), d as (select a.event_type || '-' || b.event_type pair, a.user_id, round(a.v-b.v,3) d from m a join m b on a.user_id=b.user_id and a.event_type<b.event_type)"


def _diffs(spark, sf):
    m = T.read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    a, b = (m.select("user_id", F.col("event_type").alias(f"{n}t"), F.col("v").alias(f"{n}v")) for n in "ab")
    rows = a.join(b, "user_id").where("at < bt")
    return rows.select(F.concat_ws("-", "at", "bt").alias("pair"), "user_id", F.round(F.col("av") - F.col("bv"), 3).alias("d"))


#: p values by Simpson's rule over the densities of Student's t and of the normal distribution.
_SIMPSON = "abs({0})/4000/3*list_sum(list_transform(range(0,4001), lambda i: (case when i=0 or i=4000 then 1 when i%2=1 then 4 else 2 end)*{1}))"
_T_P = "1-2*exp(lgamma(n/2)-lgamma((n-1)/2))/sqrt((n-1)*pi())*" + _SIMPSON.format("t", "power(1+power(t*i/4000,2)/(n-1),-n/2)")
_Z_P = "1-sqrt(2/pi())*" + _SIMPSON.format("z", "exp(-power(z*i/4000,2)/2)")


@query("IN-01 IN-04 IN-06 CL-07", f"with {_DIFF}, s as (select pair, count(*) n, avg(d) mean, stddev_samp(d) std from d group by pair), u as (select *, mean/std*sqrt(n) t from s) select pair, n, round(mean,6) mean, round(std,6) std, round(mean/std,6) cohens_d, round(t,6) t, round({_T_P},6) p_value from u")
def paired_t(spark, sf):
    t = I.paired_t(_diffs(spark, sf), ["pair"])
    return t.select("pair", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "cohens_d", "t", "p_value")))


#: Zeros and ties: differences rounded to whole tens.
_COARSE = _DIFF + ", e as (select pair, round(d/10)::double d from d), r as (select *, rank() over (partition by pair order by abs(d)) + (count(*) over (partition by pair, abs(d))-1)/2 rk, count(*) over (partition by pair, abs(d)) t from e), w as (select pair, count(*) n, count(*) filter (d=0) zeros, coalesce(sum(rk) filter (d>0),0)::double w_plus, coalesce(sum(rk) filter (d<0),0)::double w_minus, coalesce(sum(t::double*t-1) filter (d<>0),0) ties, quantile_cont(d,0.5) md, avg(d) mn from r group by pair), z as (select *, (least(w_plus,w_minus) - (n*(n+1)/4-zeros*(zeros+1)/4))/sqrt((n::double*(n+1)*(2*n+1) - zeros::double*(zeros+1)*(2*zeros+1) - ties/2)/24) z, case when md<>0 then sign(md) else sign(mn) end::int direction from w)"


def _wilcoxon(spark, sf):
    coarse = _diffs(spark, sf).select("pair", F.round(F.col("d") / 10).alias("d"))
    return I.wilcoxon_pratt(coarse, ["pair"])


@query("IN-03 IN-05", f"with {_COARSE} select pair, n, zeros, w_plus, w_minus, round(z,6) z, round(abs(z)/sqrt(n)*direction,6) r, direction, round({_Z_P},6) p_value from z")
def wilcoxon_z(spark, sf):
    return _wilcoxon(spark, sf).withColumns({c: F.round(c, 6) for c in ("z", "r", "p_value")})


@query("IN-07 IN-11", f"with {_COARSE}, p as (select pair, round({_Z_P},9) p from z), q as (select *, p*count(*) over ()/row_number() over (order by p) q from p) select pair, round(p,6) p, round(least(1,min(q) over (order by p range between current row and unbounded following)),6) adjusted, round(least(1, p*count(*) over ()),6) bonferroni from q")
def bh_adjust(spark, sf):
    """The whole family of Wilcoxon tests, corrected once."""
    p = _wilcoxon(spark, sf).select("pair", F.round("p_value", 9).alias("p"))
    whole = Window.partitionBy()
    both = I.benjamini_hochberg(p.withColumn("bonferroni", I.bonferroni(F.col("p"), whole)), [])
    return both.select("pair", *(F.round(c, 6).alias(c) for c in ("p", "adjusted", "bonferroni")))


@query("IN-02", "select round((select sum(sign(a.value-b.value)) from events a, events b where a.event_type='click' and b.event_type='view') / ((select count(*) from events where event_type='click')*(select count(*) from events where event_type='view')),9) delta")
def cliffs_delta(spark, sf):
    return I.cliffs_delta(T.read(spark, sf, "events"), "event_type", "value", "click", "view").select(F.round("delta", 9).alias("delta"))


_BOOT = "n as (select g, count(*) n from v group by g), draw as (select g, b, unnest(range(n)) position, n from n, range(50) x(b)), taken as (select g, b, ('0x' || substr(sha256('42:' || b || ':' || position),1,12))::bigint % n ix from draw), s as (select g, b, avg(value) s from taken join v using (g, ix) group by 1, 2)"


@query("IN-08 IN-10 JN-14", f"with v as (select event_type g, row_number() over (partition by event_type order by event_id)-1 ix, value from events where event_type in ('click','view')), {_BOOT} select g event_type, round(quantile_cont(s,0.025),4) low, round(quantile_cont(s,0.975),4) high from s group by g")
def bootstrap_ci_hash(spark, sf):
    """Each type over all of its own values."""
    e = T.read(spark, sf, "events").where("event_type in ('click', 'view')").select("event_type", "event_id", "value")
    v = P.running(e, ["event_type"], [F.col("event_id")], F.lit(1), "ix").select("event_type", F.col("ix").cast("long").alias("ix"), "value")
    ci = I.bootstrap_interval(v, ["event_type"], F.avg("value"), 50)
    return ci.select("event_type", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("IN-09", f"with {_DIFF}, v as (select 'all' g, row_number() over (order by user_id)-1 ix, d \"value\" from d where pair='click-view'), {_BOOT} select round(quantile_cont(s,0.025),4) low, round(quantile_cont(s,0.975),4) high from s")
def bootstrap_pairwise(spark, sf):
    """Differences of the users who have both types."""
    d = P.positions(_diffs(spark, sf).where("pair = 'click-view'"), F.col("user_id"), name="ix")
    ci = I.bootstrap_interval(d.select(F.lit("all").alias("g"), F.col("ix").cast("long").alias("ix"), F.col("d").alias("value")), ["g"], F.avg("value"), 50)
    return ci.select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("IN-12", f"with {_COARSE} select count(*) pairs, sum((abs(w_plus+w_minus-(n*(n+1)/2-zeros*(zeros+1)/2))>1e-6)::int)::bigint differing from z")
def inference_audit(spark, sf):
    """The two rank sums must add up to all ranks less those of the zeros."""
    w = _wilcoxon(spark, sf)
    n, z = F.col("n"), F.col("zeros")
    gap = F.abs(F.col("w_plus") + F.col("w_minus") - (n * (n + 1) / 2 - z * (z + 1) / 2))
    return w.agg(F.count(F.lit(1)).alias("pairs"), F.sum((gap > 1e-6).cast("int")).alias("differing"))
