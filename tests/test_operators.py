"""Known cases, tie rules, edge cases and brute force for the operators."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import signature as G
from marlstone.operators import classification, inference, metrics, models, pairs, population, protocol, ranking, sampling, stats


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_cosine_topk_known_cases(spark):
    v = spark.createDataFrame([("q", [2.0, 0.0]), ("a", [1.0, 1.0]), ("b", [1.0, 1.0]), ("o", [-3.0, 0.0])], "track_id string, vec array<double>")
    found = rows(ranking.blocked_cosine_topk(v, v.where("track_id = 'q'"), 3).orderBy("rank").select("track_id", "score"))
    assert [x for x, _ in found] == ["a", "b", "o"]
    assert found[0][1] == pytest.approx(2**-0.5, abs=1e-8) and found[2][1] == -1.0


def test_blocks_do_not_change_a_search(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(str(i), rng.normal(size=5).tolist()) for i in range(200)], "track_id string, vec array<double>")
    one = sorted(rows(ranking.blocked_cosine_topk(v, v, 4).select("query_id", "rank", "track_id", "score")))
    assert one == sorted(rows(ranking.blocked_cosine_topk(v.repartition(7), v, 4, blocks=5).select("query_id", "rank", "track_id", "score")))
    assert len(one) == 800
    assert rows(ranking.blocked_cosine_topk(v, v.limit(0), 4)) == []


def test_ties_go_by_string_id(spark):
    s = spark.createDataFrame([("u", "10", 1.0), ("u", "2", 1.0), ("u", "9", 0.5)], "user_id string, track_id string, score double")
    assert [r["track_id"] for r in ranking.rank_scores(s, ["user_id"]).orderBy("rank").collect()] == ["10", "2", "9"]


def test_zero_vector_is_an_error(spark):
    v = spark.createDataFrame([([0.0, 0.0],)], "v array<double>")
    with pytest.raises(Exception, match="zero vector"):
        v.select(ranking.unit(F.col("v"))).collect()
    assert rows(v.select(ranking.safe_unit(F.col("v")))) == [([0.0, 0.0],)]


def ranked(spark, lists):
    return spark.createDataFrame([(u, i + 1, t) for u, ts in lists.items() for i, t in enumerate(ts)], "user_id string, rank int, track_id string")


def relevant(spark, sets):
    return spark.createDataFrame([(u, t) for u, ts in sets.items() for t in ts], "user_id string, track_id string")


def test_metric_known_cases(spark):
    r = ranked(spark, {"a": ["x1", "x2", "n1", "n2", "n3"], "b": ["n1", "n2", "n3", "n4", "n5"], "c": ["y1", "n1", "y2"], "d": ["n1"]})
    t = relevant(spark, {"a": ["x1", "x2", "x3", "x4", "x5"], "b": ["z"], "c": ["y1", "y2", "y3", "y4", "y5"]})
    found = {(x["user_id"], x["k"]): x for x in metrics.per_user(metrics.hits(r, t), (5, 10)).collect()}
    assert found["a", 5]["precision"] == found["a", 5]["recall"] == 2 / 5
    assert found["a", 10]["ap"] == pytest.approx((1 + 2 / 2) / 5)
    assert found["b", 10]["ap"] == 0 and found["d", 5]["recall"] == found["d", 5]["ndcg"] == 0
    assert found["c", 5]["precision"] == 2 / 5
    assert found["c", 5]["ndcg"] == pytest.approx((1 + 1 / math.log2(4)) / sum(1 / math.log2(i + 1) for i in range(1, 6)))


def test_ap_compares_with_the_smaller_of_relevant_and_k(spark):
    names = [f"r{i}" for i in range(20)]
    found = metrics.per_user(metrics.hits(ranked(spark, {"u": names[:10]}), relevant(spark, {"u": names})), (10,)).collect()
    assert found[0]["ap"] == pytest.approx(1.0)


def test_missing_popularity_is_an_error(spark):
    pop = spark.createDataFrame([("x", 0.5)], "track_id string, popularity double")
    assert rows(metrics.novelty(ranked(spark, {"u": ["x"]}), pop)) == [("u", 0.5)]
    with pytest.raises(Exception, match="no popularity"):
        metrics.novelty(ranked(spark, {"u": ["x", "y"]}), pop).collect()


def test_unobserved_topk_equals_brute_force(spark):
    random.seed(3)
    items = [(f"t{i:03d}", float(random.randrange(6))) for i in range(60)]
    seen = [(f"u{u}", t) for u in range(12) for t, _ in random.sample(items, random.randrange(1, 58))] + [("full", t) for t, _ in items]
    s = spark.createDataFrame(items, "track_id string, score double")
    o = spark.createDataFrame(seen, "user_id string, track_id string")
    found = {(u, r): t for u, r, t, _ in rows(protocol.unobserved_topk(s, o, 10))}
    own, order = defaultdict(set), [t for t, _ in sorted(items, key=lambda x: (-x[1], x[0]))]
    for u, t in seen:
        own[u].add(t)
    expected = {(u, i + 1): t for u in own for i, t in enumerate([t for t in order if t not in own[u]][:10])}
    assert found == expected


def test_seeds_ids_and_index(spark):
    u = spark.createDataFrame([("user_7",)], "u string")
    assert rows(u.select(protocol.user_seed(42, F.col("u"))))[0][0].isdigit()
    ids = spark.createDataFrame([(" 007 ",), ("0",), ("00",), ("a0",)], "x string")
    assert sorted(r[0] for r in rows(ids.select(protocol.normalise_id(F.col("x"))))) == ["0", "0", "7", "a0"]
    for bad in ("-3", "  "):
        with pytest.raises(Exception, match="bad id"):
            spark.createDataFrame([(bad,)], "x string").select(protocol.normalise_id(F.col("x"))).collect()
    many = spark.createDataFrame([(str(i),) for i in range(500)], "track_id string").repartition(9)
    found = dict(rows(protocol.index_map(many, "track_id")))
    assert [k for k, _ in sorted(found.items(), key=lambda x: x[1])] == sorted(map(str, range(500)))


def test_split_of_twenty_and_of_six(spark):
    i = spark.createDataFrame([("a", f"t{k}", 1.0) for k in range(20)] + [("b", f"t{k}", 1.0) for k in range(6)], "user_id string, track_id string, score double")
    found = protocol.hash_split(i)
    assert {r["split"]: r["count"] for r in found.groupBy("split").count().collect()} == {"test": 3, "validation": 3, "train": 14}
    assert sorted(rows(found)) == sorted(rows(protocol.hash_split(i.repartition(5))))
    assert protocol.cold_items(spark.createDataFrame([(str(i),) for i in range(200)], "track_id string")).count() == 30


def brute_hamilton(capacity, places):
    total, names = sum(capacity.values()), sorted(capacity)
    exact = {g: places * capacity[g] / total for g in names}
    out = {g: math.floor(exact[g]) for g in names}
    left = places - sum(out.values())
    order = sorted(names, key=lambda g: (-(exact[g] - out[g]), g))
    while left:
        for g in order:
            if left and out[g] < capacity[g]:
                out[g] += 1
                left -= 1
    return out


def test_hamilton(spark):
    random.seed(1)
    for _ in range(6):
        c = {f"g{i}": random.randrange(1, 40) for i in range(7)}
        places = random.randrange(0, sum(c.values()) + 1)
        df = spark.createDataFrame(list(c.items()), "genre string, capacity long")
        assert {r["genre"]: r["quota"] for r in sampling.hamilton(df, places).collect()} == brute_hamilton(c, places)
    with pytest.raises(ValueError, match="below"):
        sampling.genre_quotas(df, 10_000)


def test_inference_known_cases(spark):
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.002,)], "p double")
    assert {r["p"]: round(r["adjusted"], 9) for r in inference.benjamini_hochberg(p, []).collect()} == {0.01: 0.02, 0.04: 0.04, 0.03: 0.04, 0.002: 0.008}
    tied = spark.createDataFrame([(0.02,), (0.02,)], "p double")
    assert {r["adjusted"] for r in inference.benjamini_hochberg(tied, []).collect()} == {0.02}

    def delta(x, y):
        df = spark.createDataFrame([("x", float(v)) for v in x] + [("y", float(v)) for v in y], "g string, v double")
        return inference.cliffs_delta(df, "g", "v", "x", "y").head()[0]

    assert [delta([1, 2], [1, 2]), delta([3, 4], [1, 2]), delta([1, 2], [3, 4])] == [0, 1, -1]
    d = spark.createDataFrame([("z", float(a - b)) for a, b in zip(range(8), [0, 0, 3, 1, 4, 2, 8, 7], strict=True)], "g string, d double")
    w = inference.wilcoxon_pratt(d, ["g"]).head()
    assert (w["w_plus"], w["w_minus"]) == (19, 11)
    assert w["z"] == pytest.approx(-0.5819, abs=1e-4) and w["p_value"] == pytest.approx(0.5606, abs=1e-4) and w["r"] == pytest.approx(0.2057, abs=1e-4)
    assert inference.compare_models(d, ["g"]).head() == w
    with pytest.raises(ValueError, match="family"):
        inference.compare_models(d, ["g"], correction="bh")
    up = spark.createDataFrame([("z", x) for x in [-0.5] + [0.1] * 5], "g string, d double")
    assert inference.wilcoxon_pratt(up, ["g"]).head()["direction"] == 1
    flat = spark.createDataFrame([("same", 0.0)] * 3 + [("shift", 1.0)] * 3, "g string, d double")
    assert {r["g"]: r["cohens_d"] for r in inference.paired_t(flat, ["g"]).collect()} == {"same": 0.0, "shift": None}


def test_classification_by_hand(spark):
    y = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("b", "d")], "y_true string, y_pred string")
    found = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in classification.per_class(y).collect()}
    assert found == {"a": (0.5, 0.5, 0.5, 2), "b": (0.5, 0.5, 0.5, 2), "c": (0.0, 0.0, 0.0, 1), "d": (0.0, 0.0, 0.0, 0)}
    s = classification.summary(y).head()
    assert (s["accuracy"], s["macro_f1"], s["weighted_f1"], s["micro_f1"]) == (0.4, 0.25, pytest.approx(0.4), 0.4)


def test_statistics_edge_cases(spark):
    df = spark.createDataFrame([(float(i), 1.0, None) for i in range(5)] + [(100.0, 1.0, None)], "x double, same double, none double")
    long = stats.unpivot(df, [], ["x", "same", "none"])
    found = {r["feature"]: r for r in stats.outliers(long).collect()}
    assert found["x"]["iqr_outliers"] == 1 and found["none"]["missing"] == 6 and found["same"]["iqr_outliers"] == 0
    assert all(r["r"] is None for r in stats.correlations(df, ["x", "same", "none"]).collect())
    assert stats.varying_columns(df, ["x", "same", "none"]) == ["x"]
    assert {r["feature"]: r["skew"] is None for r in stats.moments(long, True).collect()} == {"x": False, "same": True, "none": True}


def test_signatures_agree(spark):
    rng = np.random.default_rng(5)
    path = rng.normal(size=(12, 3)).cumsum(0)
    df = spark.createDataFrame([("p", i, *map(float, x)) for i, x in enumerate(path)], "track_id string, t int, a double, b double, c double")
    sql = G.signature_sql(df, "track_id", ["t"], ["a", "b", "c"], 3).drop("track_id").head()
    assert np.allclose(np.array(sql), G.signature_array(path, 3), atol=1e-9)
    assert len(sql) == 1 + 3 + 9 + 27
    sub = G.arm_positions(3, [0, 2], 2)
    assert np.allclose(G.signature_array(path, 2)[sub], G.signature_array(path[:, [0, 2]], 2))
    x = G.signature_array(path[:7], 3)
    assert x[0] == 1 and np.allclose(x[1:4], path[6] - path[0])


def test_failing_paths_are_set_apart(spark):
    data = [("ok", i, i / 4, float(i)) for i in range(5)] + [("short", 0, 0.0, 1.0)] + [("back", i, [0.0, 0.6, 0.5, 1.0][i], 1.0) for i in range(4)] + [("nan", i, i / 3, float("nan")) for i in range(4)]
    df = spark.createDataFrame(data, "track_id string, t int, c0 double, c1 double")
    found = {r["track_id"]: (r["signature"] is None, r["reason_code"]) for r in G.signatures(df, ["c0", "c1"], 2).collect()}
    assert found == {"ok": (False, None), "short": (True, "too_few_rows"), "back": (True, "time_not_monotone"), "nan": (True, "not_finite")}


def test_collaborative_scores_equal_matrices(spark):
    rng = np.random.default_rng(7)
    m = rng.integers(0, 6, (9, 11)) * (rng.random((9, 11)) < 0.5)
    df = spark.createDataFrame([(f"u{u}", f"t{i:02d}", int(m[u, i])) for u in range(9) for i in range(11) if m[u, i]], "user_id string, track_id string, rating int")
    cols = m / (np.linalg.norm(m, axis=0) + 1e-12)
    for u, i, s in rows(models.item_scores(df)):
        liked = m[int(u[1:])] > 0
        assert s == pytest.approx((cols[:, liked].T @ cols[:, int(i[1:])]).mean(), abs=1e-9)
    units = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)
    sims = units @ units.T - np.eye(9) * (units**2).sum(1)
    for u, i, s in rows(models.user_scores(df)):
        own = sims[int(u[1:])]
        assert s == pytest.approx(own @ m[:, int(i[1:])] / (np.abs(own).sum() + 1e-12), abs=1e-9)


def test_warp_learns_blocks():
    users = np.repeat(np.arange(20), 5)
    items = np.concatenate([np.arange(5) + 5 * (u % 2) for u in range(20)])
    _, u, v, b = models.warp_block(users, items, 10, 4, 30, seed=1)
    scores = u @ v.T + b
    good = [set(np.argsort(-scores[x])[:5].tolist()) == set(range(5 * (x % 2), 5 * (x % 2) + 5)) for x in range(20)]
    assert sum(good) >= 16


def test_population_is_sound(spark, sf):
    from marlstone.plans.model_queries import _music

    tracks = _music(spark, sf)
    users, inter = (x.cache() for x in population.population(tracks, 40))
    assert users.count() == 40 and rows(population.violations(users, inter, tracks, 40)) == []
    declared = {r["user_id"]: r["declared"] for r in users.collect()}
    assert dict(rows(inter.groupBy("user_id").count())) == declared
    broken = inter.withColumn("rating", F.lit(9)).unionByName(inter)
    assert {r["rule"] for r in population.violations(users, broken).collect()} == {"repeated_pair", "rating_range", "rating_of_score", "declared_count"}
    bad = users.withColumns({"archetype": F.lit("nobody"), "engagement": F.lit(0.05), "age_group": F.lit(None).cast("string"), "listening_frequency": F.lit("never")})
    assert {r["rule"] for r in population.violations(bad, inter).collect()} >= {"archetype", "profile_range", "age_group", "listening_frequency"}
    other = inter.withColumns({"track_id": F.concat(F.lit("x"), "track_id"), "timestamp": F.lit(2.0)})
    assert {r["rule"] for r in population.violations(users.where("user_id <> 'user_1'"), other, tracks, 40).collect()} == {"outside_catalogue", "timestamp_range", "unknown_user", "user_ids"}
    of_users = users.withColumn("preferred_genres", F.array(F.lit("Pop"), F.lit("Pop")))
    assert "preferred_genres" in {r["rule"] for r in population.violations(of_users, inter).collect()}


def test_every_user_gets_the_declared_number_whatever_the_genres(spark):
    """A rare preferred genre is taken whole, and the rest comes from all that is left."""
    tracks = spark.createDataFrame([(f"t{i}", "Rock" if i < 3 else "Folk", f"a{i % 7}") for i in range(400)], "track_id string, genre string, artist string")
    users, inter = population.population(tracks, 30)
    declared = {r["user_id"]: r["declared"] for r in users.collect()}
    assert dict(rows(inter.groupBy("user_id").count())) == declared and inter.count() == inter.dropDuplicates(["user_id", "track_id"]).count()
    rock = dict(rows(inter.where("genre = 'Rock'").groupBy("user_id").count()))
    assert all(rock[r["user_id"]] == 3 for r in users.where("archetype = 'genre_specialist' and declared >= 6").collect())


def test_p_values(spark):
    """Known values, and Simpson's rule over the density."""
    from math import erfc, exp, lgamma, pi, sqrt

    def by_density(t, n):
        f = lambda x: exp(lgamma((n + 1) / 2) - lgamma(n / 2)) / sqrt(n * pi) * (1 + x * x / n) ** (-(n + 1) / 2)
        h = t / 20_000
        return 1 - 2 * h / 3 * sum((1 if i in (0, 20_000) else 4 if i % 2 else 2) * f(i * h) for i in range(20_001))

    given = [(t, n) for n in (1, 2, 5, 30, 1000, 100_000) for t in (0.0, 0.01, 0.7, 1.5, 2.5, 4.0)]
    df = spark.createDataFrame(given, "t double, n int").select("t", "n", inference.student_p(F.col("t"), F.col("n")).alias("p"), inference.student_p(-F.col("t"), F.col("n")).alias("q"))
    for t, n, p, q in rows(df):
        assert p == q == pytest.approx(by_density(t, n) if t else 1.0, abs=1e-10), (t, n)
    large = rows(spark.createDataFrame([(12.706204736, 1), (2.228138852, 10), (8.0, 10**9), (30.0, 50)], "t double, n int").select(inference.student_p(F.col("t"), F.col("n"))))
    assert [r[0] for r in large[:2]] == pytest.approx([0.05, 0.05], abs=1e-9) and large[2][0] == pytest.approx(erfc(8 / sqrt(2)), rel=1e-5) and 0 < large[3][0] < 1e-30
    z = [0.0, 0.3, 1.0, 1.959964, 3.0, 3.5, 3.6, 6.0, 12.0]
    found = rows(spark.createDataFrame([(x,) for x in z], "z double").select(inference.normal_p(-F.col("z"))))
    assert [r[0] for r in found] == pytest.approx([erfc(x / sqrt(2)) for x in z], rel=1e-11)
    assert rows(spark.createDataFrame([(None, 3), (1.0, 0)], "t double, n int").select(inference.student_p(F.col("t"), F.col("n")))) == [(None,), (None,)]


def test_running_counts_cross_ranges(spark):
    random.seed(4)
    given = [(random.choice("abc"), i, random.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(given, "g string, x int, n int").repartition(5)
    found = {r["x"]: r["before"] for r in protocol.running(df, ["g"], [F.col("x")], F.col("n")).collect()}
    assert found == {x: sum(m for h, y, m in given if h == g and y < x) for g, x, _ in given}
    assert protocol.running(df.limit(0), ["g"], [F.col("x")], F.col("n")).count() == 0


def _joins(df):
    """Kinds of the joins of the plan with their lines."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [line.strip(" :+-") for line in plan.splitlines() if "Join" in line]


def test_bootstrap_draws_are_not_broadcast(spark):
    values = spark.createDataFrame([("a", i, float(i)) for i in range(40)], "g string, ix long, value double")
    drawn = [j for j in _joins(inference.bootstrap_interval(values, ["g"], F.avg("value"), 50)) if "ix" in j]
    assert drawn and all(j.startswith("ShuffledHashJoin") for j in drawn)


def _grouped(spark, n, dims, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dims))
    return m, spark.createDataFrame([(str(i), str(i % 3), m[i].tolist()) for i in range(n)], "track_id string, grp string, vec array<double>")


def test_perturbed_search_equals_brute_force(spark):
    """Several blocks; only pairs that noise can lift are hashed, and no pair table is made."""
    m, v = _grouped(spark, 150, 6)
    found = pairs.block_pairs(v, v, pairs.perturbed_topk(5, [1, 2], first=8), "seed int, a_track_id string, b_track_id string, a_genre string, b_genre string, score double", 40, 60)
    top = ranking.rank_scores(found, ["seed", "a_track_id"], 5, item="b_track_id").select("seed", "a_track_id", "b_track_id", "score")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    expected = set()
    for seed in (1, 2):
        for i in range(150):
            others = [j for j in range(150) if j != i]
            noise = pairs.noise(np.full(149, seed), [str(i)] * 149, [str(j) for j in others])
            scores = np.round(np.round(u[others] @ u[i], 9) + 0.2 * noise, 9)
            expected |= {(seed, str(i), str(j), s) for s, j in sorted(zip(scores.tolist(), others), key=lambda x: (-x[0], str(x[1])))[:5]}
    assert set(rows(top)) == expected


def test_seeded_queries_make_no_pair_table(spark, sf):
    from marlstone.plans import ranking_queries

    assert not any("NestedLoop" in j or "Cartesian" in j for j in _joins(ranking_queries._seeded(spark, sf)[1]))


def test_block_pairs_equal_brute_force(spark):
    m, v = _grouped(spark, 50, 64)
    score = lambda a, b: lambda at, upto: [a.matrix[at:upto] @ b.matrix.T]
    found = rows(pairs.block_pairs(v, None, pairs.pair_rows(score, ["s"]), "a string, b string, s double", 16))
    expected = {(str(i), str(j)): m[i] @ m[j] for i in range(50) for j in range(50) if str(i) < str(j)}
    assert len(found) == len(expected) and all(s == pytest.approx(expected[a, b]) for a, b, s in found)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    best = rows(pairs.block_pairs(v, None, pairs.best_pairs(7, 0.1), "a string, b string, s double", 16).orderBy(F.desc("s"), "a", "b").limit(7))
    brute = sorted(((str(i), str(j), float(np.round(u[i] @ u[j], 6))) for i in range(50) for j in range(50) if str(i) < str(j) and i % 3 != j % 3), key=lambda x: (-x[2], x[0], x[1]))
    assert best == brute[:7]


def test_null_groups_are_null(spark):
    from marlstone.plans import function_queries

    _, v = _grouped(spark, 6, 64)
    v = v.withColumn("grp", F.when(F.col("track_id") != "0", F.col("grp")))
    score = function_queries._composite(lambda s: s)
    found = rows(pairs.block_pairs(v, None, pairs.pair_rows(score, ["s"]), "a string, b string, s double", 2))
    assert len(found) == 15 and {a for a, b, s in found if s is None} == {"0"}


@pytest.mark.parametrize("name", ["pair_similarities", "composite_similarity", "temperature_scaled", "weighted_similarity", "weighted_row_softmax", "depth_weighted", "cross_genre_pairs"])
def test_pair_queries_make_no_joined_arrays(spark, sf, name):
    from marlstone import plans

    assert not any("NestedLoop" in j or "Cartesian" in j for j in _joins(plans.queries()[name](spark, sf)))


def test_population_draws_are_not_broadcast(spark):
    tracks = spark.createDataFrame([(f"t{i}", "Rock" if i % 2 else "Pop", f"a{i % 7}") for i in range(100)], "track_id string, genre string, artist string")
    users, inter = population.population(tracks, 10)
    for found in (inter, population.violations(users, inter, tracks, 10)):
        drawn = [j for j in _joins(found) if "place" in j or "[track_id" in j]
        assert drawn and all(j.startswith("SortMergeJoin") for j in drawn), drawn


def test_top_neighbours_equal_all_pairs(spark, monkeypatch):
    """Items with more products than a step sums, several blocks; no pairs are joined."""
    monkeypatch.setattr(models, "NEIGHBOUR_BLOCK", 20)
    monkeypatch.setattr(models, "PRODUCTS", 30)
    rng = np.random.default_rng(5)
    data = [(f"u{u}", f"t{i:02d}", int(rng.integers(1, 6))) for u in range(25) for i in range(15) if rng.random() < 0.5]
    df = spark.createDataFrame(data, "user_id string, track_id string, rating int")
    pairs_ = models.cosine_neighbours(df, "track_id", "user_id").withColumn("similarity", F.round("similarity", 6))
    both = pairs_.unionByName(pairs_.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    expected = ranking.rank_scores(both, ["a"], 4, score="similarity", item="b").select("a", "b", "rank", "similarity")
    found = models.top_neighbours(df, "track_id", "user_id", 4)
    assert {(a, b, r, round(s, 6)) for a, b, r, s in rows(found)} == {(a, b, r, round(s, 6)) for a, b, r, s in rows(expected)}
    assert sum("user_id" in j for j in _joins(found)) == 0


def test_best_places_are_those_of_a_full_sort():
    rng = np.random.default_rng(2)
    for n in (1, 5, 10, 300):
        s = rng.integers(0, 8, n).astype(float)
        s[rng.random(n) < 0.2] = -np.inf
        assert models.best_places(s, 10).tolist() == np.lexsort((np.arange(n), -s))[:10].tolist()


def test_cosine_summary_equals_all_pairs(spark, sf):
    from marlstone.plans import stats_queries

    m, v = _grouped(spark, 60, 5)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round((u @ u.T)[np.triu_indices(60, 1)], 9)
    found = rows(pairs.cosine_summary(v))[0]
    assert found == pytest.approx((len(s), s.mean(), s.std(), s.min(), s.max(), np.median(s), (np.abs(s) < 0.1).mean()), abs=1e-9)
    assert not any("NestedLoop" in j for j in _joins(stats_queries.similarity_stats(spark, sf)))


def test_recommend_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    u, v = rng.normal(size=(150, 4)).astype(np.float32), (rng.normal(size=(700, 4)) * rng.exponential(size=(700, 1))).astype(np.float32)
    u[7], v[50:60], u[20] = 0, v[3], -u[21]
    frame = lambda m: spark.createDataFrame([(10 * i, x.tolist()) for i, x in enumerate(m)], "id int, features array<float>").repartition(3)
    monkeypatch.setattr(models, "SEARCH_STEP", 16)
    s = (u.astype(float) @ v.T.astype(float)).astype(np.float32)
    expected = {(10 * x, n + 1, 10 * int(i)) for x in range(150) for n, i in enumerate(np.lexsort((np.arange(700), -s[x]))[:10])}
    found = rows(models.recommend(frame(u), frame(v), 10, per_task=40, chunk=32))
    assert len(found) == 1500 and {r[:3] for r in found} == expected
    assert all(abs(r[3] - s[r[0] // 10, r[2] // 10]) < 1e-5 for r in found)
    assert len(rows(models.recommend(frame(u), frame(v[:4]), 10))) == 600


def test_recommend_skips_items_that_cannot_enter():
    rng = np.random.default_rng(4)
    u, v = rng.normal(size=(50, 4)).astype(np.float32), rng.normal(size=(200, 4)).astype(np.float32)
    search = models._Search(np.arange(50), u, 10)
    search.meet(np.arange(200), v, float(np.linalg.norm(v, axis=1).max()))
    kept = search.best.copy()
    search.meet(np.arange(200, 400), np.full((200, 4), np.nan, np.float32), 1e-9)  # would spoil any list it met
    assert (search.best == kept).all()


def test_binary_matrix_reads_its_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    pairs = [("u2", "t1"), ("u1", "t10"), ("u1", "t2"), ("u1", "t2"), ("u10", "t1")]
    df = spark.createDataFrame(pairs, "user_id string, track_id string").mapInArrow(counted, "user_id string, track_id string")
    found = models.binary_matrix(df).select("user_ix", "item_ix", "value")
    assert sorted(rows(found)) == [(0, 1, 1.0), (0, 2, 1.0), (1, 0, 1.0), (2, 0, 1.0)]
    assert read.value == len(pairs)
    numbers = spark.createDataFrame([(2, 1), (1, 10), (1, 2), (10, 1)], "user_id long, track_id long")
    assert sorted(rows(models.binary_matrix(numbers).select("user_ix", "item_ix", "value"))) == sorted(rows(found))


def test_best_unseen_equals_brute_force():
    """Seen items, equal scores, users who have seen nearly all, several chunks and steps."""
    rng = np.random.default_rng(6)
    u, v, b = rng.normal(0, 0.3, (40, 4)), rng.normal(0, 0.3, (300, 4)), rng.normal(0, 0.3, 300)
    v[50:60], b[50:60], u[7] = v[3], b[3], 0
    seen = rng.random((40, 300)) < 0.1
    seen[5], seen[6, 4:] = True, True
    scores = np.where(seen, -np.inf, u @ v.T + b)
    who, nth, what, score = models.best_unseen(u, v, b, *np.nonzero(seen), 10, chunk=32, step=16)
    for x in range(40):
        best = [i for i in models.best_places(scores[x].round(12), 10).tolist() if not seen[x, i]]
        assert what[who == x].tolist() == best and nth[who == x].tolist() == list(range(1, len(best) + 1))
        assert np.allclose(score[who == x], scores[x, best])


def test_own_items_are_different_and_evenly_drawn():
    sizes = np.repeat([1, 2, 4, 9], 3000)
    found = models._own_items(np.random.default_rng(7), sizes, 4)
    for n in (1, 2, 4, 9):
        rows_ = found[sizes == n]
        assert all(len(set(r) - {-1}) == min(n, 4) == 4 - r.count(-1) for r in rows_.tolist())
        share = np.bincount(rows_[rows_ >= 0], minlength=n) / (3000 * min(n, 4))
        assert np.allclose(share, 1 / n, atol=0.02)


def test_warp_topk_deals_the_matrix_once(spark, monkeypatch):
    """Several blocks and seeds: every user's unseen items for each seed, without a copy of the cells for each seed."""
    monkeypatch.setattr(models, "WARP_BLOCK", 60)
    rng = np.random.default_rng(8)
    cells = [(u, i, 1.0) for u in range(30) for i in range(25) if rng.random() < 0.4 or i == 24]
    found = models.warp_topk(spark.createDataFrame(cells, "user_ix int, item_ix int, value float"), [1, 2], rank=4, kth=3, k=20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "InPandas" not in plan
    liked = {u: {i for x, i, _ in cells if x == u} for u in range(30)}
    lists = {}
    for seed, u, i, rank, score in rows(found.orderBy("seed", "user_ix", "rank")):
        lists.setdefault((seed, u), []).append((rank, i, score))
    assert len(lists) == 60
    for (_, u), got in lists.items():
        assert len(got) == min(20, 25 - len(liked[u])) and [r for r, _, _ in got] == list(range(1, len(got) + 1))
        assert not liked[u] & {i for _, i, _ in got} and [s for _, _, s in got] == sorted((s for _, _, s in got), reverse=True)


def test_differences_are_taken_once_for_all_measures(monkeypatch):
    """Tiles smaller than the rows; sums in order of the dimensions."""
    monkeypatch.setattr(pairs, "TILE", 40)
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(23, 7)), rng.normal(size=(17, 7))
    squares, sums = pairs.differences(a, b, np.square, np.abs)
    assert np.allclose(squares, ((a[:, None] - b[None]) ** 2).sum(2)) and np.allclose(sums, np.abs(a[:, None] - b[None]).sum(2))
    assert (pairs.differences(a, b)[0] == sums).all()
