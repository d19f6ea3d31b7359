import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import augment as U, novelty as N, sampling as S, trajectory as X


def series(spark, n=300):
    pdf = pd.DataFrame({"key": range(n)})
    return spark.createDataFrame(pdf).selectExpr(
        "key", "if(key % 3 = 0, 'hot', concat('d', key % 5)) AS domain", "concat('k', key % 4) AS dgp_class", "if(key % 2 = 0, 'daily', 'hourly') AS cadence")


def test_even_quotas_and_pick(spark):
    s = series(spark)
    q = S.equal_weight_quotas(s, 100)
    assert q.agg(F.sum("quota")).first()[0] == 100
    got = S.pick(s, q, ["domain", "dgp_class", "cadence"], "key", "x", 100)
    assert got.count() == 100
    assert got.select("key").distinct().count() == 100  # no duplicate while distinct series remain


def test_overflow_fills_with_duplicates(spark):
    s = series(spark, 6)
    q = s.select("domain").distinct().withColumn("quota", F.lit(10))
    got = S.pick(s, q, ["domain"], "key", "x", 30).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("k")).collect()
    assert all(r["n"] == 10 for r in got)


def test_draw_does_not_depend_on_partitioning(spark):
    s = series(spark)
    q = S.equal_weight_quotas(s, 60)
    one = {r["key"] for r in S.pick(s.repartition(1), q, ["domain", "dgp_class", "cadence"], "key", "s", 60).collect()}
    many = {r["key"] for r in S.pick(s.repartition(13), q, ["domain", "dgp_class", "cadence"], "key", "s", 60).collect()}
    assert one == many


@pytest.mark.parametrize("seed", ["a", "b", "c"])
def test_jittered_quotas_keep_every_domain(spark, seed):
    rows = S.jittered_quotas(series(spark), 128, seed).collect()
    assert sum(r["quota"] for r in rows) == 128
    assert min(r["quota"] for r in rows) >= S.MIN_CLASS_SLOTS
    few = S.jittered_quotas(series(spark), 7, seed).collect()
    assert sum(r["quota"] for r in few) == 7 and sum(r["quota"] > 0 for r in few) == 2


def test_class_rotation_clears_the_block(spark):
    q = S.jittered_quotas(series(spark), 60, "z")
    r = S.rotate_classes(series(spark), q, "z", 0.5).toPandas()
    assert r["quota"].sum() == 60 and r["quota"].min() >= S.MIN_CLASS_SLOTS


def test_near_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.normal(size=(120, 32)), axis=1)
    x = np.vstack([x, x[:30] * 1.5 + 3 + rng.normal(0, 0.05, (30, 32))])
    x = x - x.mean(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {(r["a"], r["b"]) for r in N.near_pairs(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), "a", "b", "vec", 32).collect() if r["a"] < r["b"]}
    g = x @ x.T
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if g[i, j] >= 0.985}
    assert got == want and len(want) >= 20
    c, h = df.where("id >= 100"), df.where("id < 100")
    seen = {r["id"] for r in N.seen_before(c, h, "id", "vec", 32).collect()}
    assert seen == {i for i in range(100, len(x)) if (g[i, :100] >= 0.985).any()}


def test_mass_of_copies_is_settled_whole(spark):
    v = (np.ones(32) / np.sqrt(32)).tolist()
    hot = spark.range(2000).select((F.col("id") + 10).alias("id"), F.array(*[F.lit(x) for x in v]).alias("vec"))
    h = spark.createDataFrame([(1, v)], "id long, vec array<double>")
    assert N.seen_before(hot, h, "id", "vec", 32).count() == 2000
    assert N.admit_batch(hot, h.where("id < 0"), "id", "vec", 32).collect()[0].asDict() == {"id": 10, "copies": 2000}


def test_signature_ignores_scale_and_level(spark):
    x = np.sin(np.arange(100) / 7)
    df = spark.createDataFrame([(x.tolist(), (5 * x + 100).tolist(), [3.0] * 50)], "a array<double>, b array<double>, c array<double>")
    r = df.select(*[F.expr(N.signature(c)).alias(c) for c in "abc"]).first()
    assert np.allclose(r["a"], r["b"]) and np.linalg.norm(r["a"]) == pytest.approx(1.0)
    assert np.allclose(r["c"], 0.0)


def test_nearest_distance_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(80, 2)), np.vstack([rng.normal(size=(40, 2)), [[50.0, 50.0]]])
    a[0] = [30.0, -20.0]  # far from everything: needs the grid to grow
    qa = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "id long, x double, y double")
    qb = spark.createDataFrame([(float(x), float(y)) for x, y in b], "x double, y double")
    got = {r["id"]: r["distance"] for r in N.nearest_distance(qa, qb, "id", ["x", "y"], 0.1).collect()}
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min(axis=1)
    assert len(got) == len(a) and all(got[i] == pytest.approx(w) for i, w in enumerate(want))


def test_augmentations_preserve_shape_and_history_only_cutout(spark):
    from test_skill import challenges
    ch = challenges(spark, 24)
    a = U.augment(ch, "s").join(ch.select("challenge_id", F.col("truth").alias("t0"), F.col("context").alias("c0")), "challenge_id").collect()
    assert {r["op"] for r in a} == set(U.OPS)
    for r in a:
        assert len(r["context"]) == 256 and len(r["truth"]) == 14 and np.isfinite(r["context"] + r["truth"]).all()
        if r["op"] == "history_cutout":
            assert r["truth"] == r["t0"]
        assert r["context"] + r["truth"] != r["c0"] + r["t0"]
        if r["op"] == "time_warp":
            assert max(r["context"] + r["truth"]) <= max(r["c0"] + r["t0"]) + 1e-9


def test_time_warp_reads_along_summed_speeds(spark):
    """Against prefix sums of the speed and linear reading, for windows of several lengths."""
    rng = np.random.default_rng(7)
    rows = [(f"w{k}", rng.normal(0, 0.6, 4).tolist(), np.cumsum(rng.normal(size=n)).tolist()) for k, n in enumerate([4, 5, 7, 31, 100, 257, 271, 600])]
    df = spark.createDataFrame(rows, "id string, knots array<double>, w array<double>").withColumn("wn", F.size("w"))
    df = df.withColumn("warp", F.expr(U._warp_pieces()))
    df = df.withColumn("warp_total", F.expr(U._elapsed("(wn - 1)")))
    got = {r.id: r.x for r in df.select("id", F.expr(f"transform(sequence(0, wn - 1), i -> {U._warped_value()})").alias("x")).collect()}
    for name, knots, w in rows:
        n = len(w)
        speed = np.interp(np.arange(n), np.linspace(0, n - 1, 4), np.clip(1 + np.array(knots), 0.2, None))
        cum = np.cumsum(speed)
        np.testing.assert_allclose(got[name], np.interp(np.arange(n), cum / cum[-1] * (n - 1), w), atol=1e-8)


def test_a_dropped_item_suppresses_nothing(spark):
    a = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))] + [0.0] * 30
    df = spark.createDataFrame([(0, a(0)), (1, a(8)), (2, a(16)), (3, a(24)), (4, a(90))], "id long, vec array<double>")
    got = {r.id for r in N.admit_batch(df, df.limit(0), "id", "vec", 32, float(np.cos(np.radians(9)))).collect()}
    assert got == {0, 2, 4}


def test_greedy_admission_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """A cluster of 300 near copies, a chain and single items: the walk in id order, without all pairs of the cluster."""
    rng = np.random.default_rng(12)
    centre = rng.normal(size=32)
    x = [centre + 0.01 * rng.normal(size=32) for _ in range(300)] + [rng.normal(size=32) for _ in range(40)]
    x += [centre * np.cos(t) + np.roll(centre, 1) * np.sin(t) for t in np.linspace(0.05, 1.2, 30)]
    x = [v / np.linalg.norm(v) for v in x]
    order = rng.permutation(len(x))
    rows = [(int(i), [float(q) for q in x[k]]) for i, k in enumerate(order)]
    t = 0.985
    admitted, want = [], set()
    for i, v in rows:
        if any(np.dot(v, w) >= t for w in admitted):
            want.add(i)
        else:
            admitted.append(v)
    made, whole = [], N.near_pairs
    monkeypatch.setattr(N, "near_pairs", lambda *a, **k: made.append(whole(*a, **k)) or made[-1])
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    assert {r.id for r in N.greedy_repeats(df, "id", "vec", 32, t).collect()} == want
    assert sum(p.count() for p in made) < 500


def test_mixture_draw_with_uneven_weights(spark):
    from tidemark.functions.hashing import uniform
    from tidemark.operators import sampling

    weights = [("a", 1e6), ("b", 0.0)] + [(f"f{k:03d}", 1.0 + k % 7) for k in range(200)] + [("z", 5e5)]
    df = spark.createDataFrame(weights, "feed string, weight double")
    got = {r.id: r.feed for r in sampling.mixture_draw(df, 5000, "s").collect()}
    ends = np.cumsum([w for _, w in sorted(weights)])
    names = [f for f, _ in sorted(weights)]
    u = [r.u for r in spark.range(5000).select("id", uniform("s", F.lit("mix"), F.col("id")).alias("u")).orderBy("id").collect()]
    want = [names[int(np.searchsorted(ends, x * ends[-1], side="right"))] for x in u]
    assert [got[k] for k in range(5000)] == want and "b" not in want
    assert sampling.mixture_draw(df.where("weight = 0"), 10, "s").collect() == []


def test_largest_exponent_of_a_cycle_and_of_chaos(spark):
    z, rows = 0.3, []
    for k in range(700):
        z = 3.9 * z * (1 - z)
        rows += [("chaos", k, z), ("cycle", k, float(np.sin(k / 9)))]
    points = X.delay_vectors(spark.createDataFrame(rows, "s string, t int, v double"), "s", "t", "v", 1)
    got = dict(X.largest_exponent(points, "s", steps=6).collect())
    assert got["chaos"] > 0.15 and abs(got["cycle"]) < 0.05


def test_features_of_known_series(spark):
    rows = [("flat", k, 1.0) for k in range(40)] + [("steps", k, float(k // 10)) for k in range(40)] + [("short", k, float(k)) for k in range(20)]
    got = X.feature_table(spark.createDataFrame(rows, "s string, t int, v double"), "s", "t", "v").collect()
    assert [(r.s, r.flat_spots) for r in got] == [("steps", 0.25)] and abs(got[0]["skew"]) < 1e-9 and got[0]["acf1"] > 0.8


def test_kaplan_yorke_known_spectra(spark):
    rows = [("lorenz", i, v) for i, v in enumerate((0.906, 0.0, -14.57))] + [("sink", i, v) for i, v in enumerate((-1.0, -2.0))] + [("full", i, v) for i, v in enumerate((1.0, 0.5))]
    r = {x["s"]: x["dimension"] for x in X.kaplan_yorke(spark.createDataFrame(rows, "s string, idx int, l double"), ["s"], "l").collect()}
    assert r["lorenz"] == pytest.approx(2.0622, abs=1e-3) and r["sink"] == 0.0 and r["full"] == 2.0


def test_spread_vectors_meet_block_by_block(spark, monkeypatch):
    """Blocks of 50 rows: first lower neighbours, matches and pairs equal brute force, and no row travels more often than there are blocks."""
    monkeypatch.setattr(N, "BLOCK", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(230, 32))
    x = np.vstack([x, x[:60] + 0.05 * rng.normal(size=(60, 32)), np.repeat(x[:1], 30, axis=0) + 0.02 * rng.normal(size=(30, 32))])
    x = x[rng.permutation(len(x))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "id long, vec array<double>")
    near = x @ x.T >= 0.985
    want = {i: int(np.flatnonzero(near[i, :i])[0]) for i in range(len(x)) if near[i, :i].any()}
    assert {r.id: r.low for r in N.lowest_like(df, "id", "vec", 32).collect()} == want and len(want) > 80
    assert {r.id for r in N.repeats_of_lower(df, "id", "vec", 32).collect()} == set(want)
    got = {r.id for r in N.like_any(df.where("id < 200"), df.where("id >= 200"), "id", "vec", 32).collect()}
    assert got == {i for i in range(200) if near[i, 200:].any()}
    pairs = N.near_pairs(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), "a", "b", "vec", 32, ordered=True).collect()
    assert sorted((r.a, r.b) for r in pairs) == [(i, j) for i in range(len(x)) for j in range(i) if near[i, j]]
    kept = []
    for i in range(len(x)):
        if not near[i, kept].any():
            kept.append(i)
    assert {r.id for r in N.greedy_repeats(df.where("id < 900"), "id", "vec", 32).collect()} == set(range(len(x))) - set(kept)
    rows, _ = N._units(df, None, "id", "vec", 32)
    assert rows.count() == len(x) * -(-len(x) // 50)
