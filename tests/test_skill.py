"""Forecasters, scores and tests of skill on constructed inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions import tails
from tidemark.operators import forecast as M, scoring as S, significance as E

FIELDS = ("challenge_id string, draw int, source_id string, series_key string, domain string, dgp_class string, cadence string, "
          "freq string, context_len int, horizon int, unseen_frac double, context array<double>, truth array<double>")


def challenges(spark, n=6, ctx=256, h=14, freq="P1D"):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        t = np.arange(ctx + h)
        x = 0.01 * t + np.sin(2 * np.pi * t / 24) + rng.normal(0, 0.1, ctx + h)
        rows.append((f"c{i}", 0, f"s{i % 2}", f"s{i}", "d", "k", "daily", freq, ctx, h, 0.5, x[:ctx].tolist(), x[ctx:].tolist()))
    return spark.createDataFrame(rows, FIELDS)


def test_column_models_on_known_series(spark):
    ch = challenges(spark, 3)
    got = {(r["model"], r["challenge_id"]): np.array(r["mean"]) for r in M.panel_forecasts(ch).collect()}
    for r in ch.collect():
        x, h, i = np.array(r["context"]), r["horizon"], r["challenge_id"]
        steps = np.arange(1, h + 1)
        assert np.allclose(got["naive", i], x[-1])
        assert np.allclose(got["drift", i], x[-1] + (x[-1] - x[0]) / (len(x) - 1) * steps)
        assert np.allclose(got["seasonal_naive", i], x[len(x) - 24:][(steps - 1) % 24])
        assert np.allclose(got["damped", i], x[-1] + (x[-1] - x[-13]) / 12 * np.cumsum(0.9 ** steps))
        # a line and a daily cycle with little noise: both decompositions and the matcher must follow it
        for model in ("hw_ar", "decomp", "context_parrot", "strong"):
            assert np.abs(got[model, i] - np.array(r["truth"])).mean() < 0.35


def test_backtest_takes_the_best_candidate_and_defaults_when_short(spark):
    line = [float(k) for k in range(120)]
    rows = [("up", 0, "s", "a", "d", "k", "daily", "P1D", 120, 12, 0.5, line, line[:12]), ("short", 0, "s", "b", "d", "k", "daily", "P1D", 20, 12, 0.5, line[:20], line[:12])]
    got = dict(M.backtest_choices(M.panel_rows(spark.createDataFrame(rows, FIELDS))).collect())
    assert got["short"] == "hw_ar" and got["up"] in ("decomp", "drift")


def test_perfect_forecast_scores_zero(spark):
    ch = M.with_context_stats(challenges(spark)).withColumn("model", F.lit("oracle")).withColumn("mean", F.col("truth"))
    q = ", ".join(f"named_struct('level', {lv}D, 'path', truth)" for lv in dims.DECILES)
    m = S.metrics_by(S.contributions(ch.withColumn("q", F.expr(f"array({q})"))), "model").first()
    assert max(m["mase"], m["wql"], m["crps"], m["wis"]) < 1e-9
    assert m["coverage_80"] == pytest.approx(1.0)


def test_better_model_ranks_first_and_strong_beats_drift(spark):
    ch = challenges(spark, 8)
    fc = M.panel_forecasts(ch)
    b = {r["model"]: r for r in S.leaderboard(S.contributions(M.gaussian_band(fc))).collect()}
    assert b["seasonal_naive"]["mase_rel"] == pytest.approx(1.0, abs=1e-6)
    assert b["strong"]["mase_rel"] < b["drift"]["mase_rel"]
    assert sorted(r["rank"] for r in b.values()) == list(range(1, len(b) + 1))


def test_gmean_drops_non_finite(spark):
    df = spark.createDataFrame([(1.0, 1.0), (4.0, 1.0), (float("nan"), 1.0), (9.0, 0.0)], "x double, w double")
    assert df.select(S.shifted_gmean(F.col("x"), F.col("w"))).first()[0] == pytest.approx(2.0, abs=1e-4)


def score_rows(spark, a, b, c=None):
    rows = [("a", f"c{i}", x) for i, x in enumerate(a)] + [("b", f"c{i}", x) for i, x in enumerate(b)]
    rows += [("seasonal_naive", f"c{i}", x) for i, x in enumerate(c or b)]
    return spark.createDataFrame(rows, "model string, challenge_id string, crps double")


def test_wilcoxon_statistic_with_ties_and_zeros(spark):
    a, b = [1, 2, 3, 4, 5, 6, 7, 8], [2, 2, 5, 3, 8, 9, 9, 9]
    s = score_rows(spark, [float(x) for x in a], [float(x) for x in b])
    r = E.paired_test(E.pairs_against(s, "crps", "challenge_id", None)).where("model_a = 'a' AND model_b = 'b'").first()
    d = np.array(a, float) - np.array(b, float)
    import pandas as pd
    nz = d[d != 0]
    ranks = pd.Series(np.abs(nz)).rank().to_numpy()
    assert r["wilcoxon_stat"] == pytest.approx(min(ranks[nz > 0].sum(), ranks[nz < 0].sum()))
    assert r["median_diff"] == pytest.approx(np.median(d))
    assert r["t_stat"] == pytest.approx(d.mean() / (d.std(ddof=1) / np.sqrt(len(d))))
    assert r["win_rate"] == pytest.approx((d < 0).mean())


def test_exact_tails_of_few_blocks(spark):
    """All sign patterns counted; Student's t against its integral and a table value."""
    import itertools

    for d, alternative in (([-1.0, -2.0, -3.0, -4.0, 5.0], "two-sided"), ([-1.0, -2.0, -3.0, -4.0, -5.0], "less"), ([3.0, -1.5, 2.5, 0.5, -4.0, 6.0, 7.0], "less")):
        s = score_rows(spark, d, [0.0] * len(d))
        r = E.paired_test(E.pairs_against(s, "crps", "challenge_id", None), alternative).where("model_a = 'a' AND model_b = 'b'").first()
        ranks = np.argsort(np.argsort(np.abs(d))) + 1
        plus = ranks[np.array(d) > 0].sum()
        sums = [np.dot(p, ranks) for p in itertools.product((0, 1), repeat=len(d))]
        low, high = np.mean(np.array(sums) <= plus), np.mean(np.array(sums) >= plus)
        assert r["wilcoxon_p"] == pytest.approx(low if alternative == "less" else min(1, 2 * min(low, high)), abs=1e-12)
    got = spark.createDataFrame([(2.7764451051977987, 4), (12.706204736432095, 1), (0.3, 7), (-1.2, 30), (5.0, 9), (0.0, 3), (1.0, 5000), (1.96, 10**7)], "t double, v int")
    rows = got.selectExpr("t", "v", f"{tails.t_two_sided('t', 'v')} p", f"{tails.t_less('t', 'v')} q").collect()
    assert [rows[0].p, rows[1].p] == pytest.approx([0.05, 0.05], abs=1e-9) and rows[5].p == 1.0 and rows[7].p == pytest.approx(0.0499958, abs=1e-6)
    for r in rows[2:5]:
        x = np.linspace(abs(r.t), 400, 4_000_001)
        y = (1 + x * x / r.v) ** (-(r.v + 1) / 2)
        whole = np.linspace(-400, 400, 4_000_001)
        area = np.trapezoid((1 + whole * whole / r.v) ** (-(r.v + 1) / 2), whole)
        assert r.p == pytest.approx(2 * np.trapezoid(y, x) / area, abs=1e-6) and r.q == pytest.approx(r.p / 2 if r.t <= 0 else 1 - r.p / 2)


def test_holm_and_bh(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    h = [r["h"] for r in E.holm(df, "p", "h").orderBy("i").collect()]
    b = [r["b"] for r in E.benjamini_hochberg(df, "p", "b").orderBy("i").collect()]
    assert h == pytest.approx([0.04, 0.09, 0.09, 0.5])
    assert b == pytest.approx([0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5])


def test_friedman_known_value(spark):
    mat = np.array([[1, 2, 3], [1, 3, 2], [1, 2, 3], [2, 1, 3]], float)
    rows = [(f"m{j}", f"c{i}", float(mat[i, j])) for i in range(4) for j in range(3)]
    r = E.friedman(spark.createDataFrame(rows, "model string, challenge_id string, crps double")).first()
    rj = mat.sum(axis=0)
    assert r["statistic"] == pytest.approx(12 / (4 * 3 * 4) * (rj**2).sum() - 3 * 4 * 4)
    assert r["df"] == 2


def test_user_forecaster_and_free_run(spark):
    ch = challenges(spark, 2)
    f = M.batch_forecasts(ch, {"mine": lambda c, h, s: np.full(h, 7.0)}).collect()
    assert all(set(r["mean"]) == {7.0} for r in f)
    runs = M.free_run(ch.select("series_key", "context"), "series_key", 50, 24).collect()
    assert all(len(r["generated"]) == 50 for r in runs)


def test_bootstrap_samples_have_as_many_rows_as_the_group(spark):
    rows = spark.createDataFrame([(m, f"c{i:02d}", 1.0, float(i)) for m, n in (("a", 37), ("b", 5), ("c", 1)) for i in range(n)], "model string, challenge_id string, one double, v double")
    got = S.bootstrap_totals(rows, "model", "challenge_id", ["one", "v"], "seed", 50).collect()
    assert len(got) == 150
    assert all(r.one == {"a": 37, "b": 5, "c": 1}[r.model] for r in got)
    assert len({r.v for r in got if r.model == "a"}) > 20  # the samples differ


def test_scores_equal_but_for_rounding_share_a_rank(spark):
    rows = [(m, "c", v) for m, v in (("a", 0.1 + 0.2), ("b", 0.3), ("c", 0.1), ("d", 0.30001))]
    got = {r.model: r.block_rank for r in E.block_ranks(spark.createDataFrame(rows, "model string, challenge_id string, crps double"), "crps").collect()}
    assert got == {"c": 1.0, "a": 2.5, "b": 2.5, "d": 4.0}


def test_sweeps_of_one_second_go_by_their_place_in_the_log(spark):
    from tidemark.operators import monitor as O

    line = "2024-01-01 00:00:0{},123 INFO sweep finished: 5 ok, {} failed, {} skipped of 9 in 1.5s"
    rows = [("x", k, line.format(1, k, k % 2)) for k in range(12)] + [("x", 99, line.format(0, 77, 1))]
    for order in (rows, rows[::-1], rows[6:] + rows[:6]):
        df = spark.createDataFrame(order, "log string, line_no long, line string").coalesce(1)
        got = O.recent_sweeps(O.parse_sweeps(df, "line", "log", "line_no"), ["log"], "line_no").collect()
        assert [(r.seen, r.skipping, r.skipped_last, r.failed_last, r.chronic) for r in got] == [(8, 4, 1, 11, False)]
