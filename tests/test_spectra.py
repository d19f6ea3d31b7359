"""Spectra, stationarity, regression of squares and mixtures against plain numerical code."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import mixture, spectrum as S, trajectory as X


def table(spark, series):
    return spark.createDataFrame(pd.DataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], columns=["s", "i", "v"]), "s string, i int, v double")


def series(seed=3):
    r = np.random.default_rng(seed)
    walk = np.cumsum(r.normal(size=700))
    calm = np.zeros(500)
    for t in range(1, 500):
        calm[t] = r.normal() * np.sqrt(0.2 + 0.7 * calm[t - 1] ** 2)
    return {"prime": r.normal(size=211), "power": r.normal(size=256), "odd": np.sin(np.arange(1023) / 5) + 0.1 * r.normal(size=1023), "tiny": r.normal(size=8),
            "walk": walk, "arch": calm, "short": r.normal(size=34)}


def test_power_of_any_length_in_rows_and_in_windows(spark):
    data = series()
    got = S.power_rows(table(spark, data | {"seven": np.arange(7)}), ["s"], "i", "v").toPandas()
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in data.items()], "s string, x array<double>")
    windows = {r.s: r.power for r in S.power_windows(rows, ["s"], "x").collect()}
    assert set(got.s) == set(data) == set(windows)
    for k, x in data.items():
        want = np.abs(np.fft.rfft(x)) ** 2
        np.testing.assert_allclose(got[got.s == k].sort_values("k").power, want, rtol=1e-7, atol=1e-9)
        np.testing.assert_allclose(windows[k], want, rtol=1e-7, atol=1e-9)


def plain_share(x, width=20):
    z = (x - x.mean()) / x.std()
    bell = np.exp(-0.5 * (np.arange(-3 * width, 3 * width + 1) / width) ** 2)
    p = np.convolve(np.abs(np.fft.rfft(z)) ** 2, bell / bell.sum(), mode="full")[3 * width:-3 * width]
    return p / p.sum()


def test_spectrum_distance(spark):
    data, other = series(), {k: np.append(x[1:] ** 2, 0.3) for k, x in series(5).items()}
    other["walk"] = other["walk"][:600]
    got = {r.s: r.d_h for r in S.spectrum_distance(table(spark, data), table(spark, other), ["s"], "i", "v").collect()}
    for k in data:
        a, b = plain_share(data[k]), plain_share(other[k])
        n = min(len(a), len(b))
        assert got[k] == pytest.approx(np.sqrt(max(0, 1 - np.sqrt(a[:n] * b[:n]).sum())), abs=1e-6) and 0 <= got[k] <= 1
    same = [r.d_h for r in S.spectrum_distance(table(spark, data), table(spark, data), ["s"], "i", "v").collect()]
    assert max(same) < 1e-6


def test_flatness(spark):
    data = series()

    def plain(x):
        t = np.arange(len(x))
        p = np.abs(np.fft.rfft((x - np.polyval(np.polyfit(t, x, 1), t)) * np.hanning(len(x)))) ** 2 + 1e-20
        return np.exp(np.log(p[1:]).mean()) / p[1:].mean()

    rows = {r.s: r.flatness for r in S.flatness_rows(table(spark, data), ["s"], "i", "v").collect()}
    odd = [("gaps", [None, float("nan"), float("inf"), *data["prime"].tolist()]), ("few", [1.0] * 7), ("none", []), ("null", None)]
    windows = spark.createDataFrame([(k, x.tolist()) for k, x in data.items()] + odd, "s string, x array<double>")
    got = {r.s: r.flatness for r in S.flatness_windows(windows, "s", "x").collect()}
    for k, x in data.items():
        assert rows[k] == pytest.approx(plain(x), rel=1e-5) and got[k] == pytest.approx(plain(x), rel=1e-5)
    assert got["gaps"] == pytest.approx(plain(data["prime"]), rel=1e-5) and all(np.isnan(got[k]) for k in ("few", "none", "null"))


def plain_arch(z):
    q = z ** 2
    m = min(12, len(q) // 4)
    y = q[m:]
    x = np.column_stack([np.ones(len(y))] + [q[m - i - 1:len(q) - i - 1] for i in range(m)])
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return 1 - e @ e / ((y - y.mean()) ** 2).sum()


def plain_kpss(z):
    n = len(z)
    c = [z @ z / n] + [2 * (z[i:] @ z[:-i]) / n for i in range(1, int(n ** (2 / 9)) + 1)]
    ratio = sum(i * v for i, v in enumerate(c)) / sum(c)
    lags = min(int(1.1447 * (ratio ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    spread = (z @ z + sum(2 * (z[i:] @ z[:-i]) * (1 - i / (lags + 1)) for i in range(1, lags + 1))) / n
    return (np.cumsum(z) ** 2).sum() / n ** 2 / spread


def test_six_features(spark):
    data = series()
    got = {r.s: r for r in X.feature_table(table(spark, data | {"flat": np.ones(50)}), "s", "i", "v").collect()}
    assert set(got) == set(data) - {"tiny"}
    for k, r in got.items():
        z = (data[k] - data[k].mean()) / data[k].std()
        p = np.abs(np.fft.rfft(z * np.hanning(len(z))))[1:] ** 2
        share = p / p.sum()
        assert r.arch_lm == pytest.approx(plain_arch(z), abs=1e-6) and r.kpss == pytest.approx(plain_kpss(z), rel=1e-6)
        assert r.spec_entropy == pytest.approx(-(share * np.log(share)).sum() / np.log(len(p)), abs=1e-6)
        assert r.acf1 == pytest.approx(z[:-1] @ z[1:] / (z @ z), abs=1e-9) and r["skew"] == pytest.approx((z ** 3).mean(), abs=1e-9)
    assert got["arch"].arch_lm > got["power"].arch_lm and got["walk"].kpss > 0.7 > got["power"].kpss


def test_squares_that_depend_on_each_other(spark):
    """Alternating series: all lagged squares are one column, the regression still has a result."""
    got = X.arch(table(spark, {"s": np.tile([1.0, -1.0], 40), "t": np.tile([2.0, 0.5, -1.0, -1.5], 30)}), ["s"], "i", "v")
    r = {x.s: x.arch_lm for x in got.collect()}
    assert r["s"] == 0.0 and r["t"] == pytest.approx(1.0, abs=1e-9)


def plain_mixture(x, start, rounds=100):
    """Expectation and maximisation from given means, in plain code."""
    n, d = x.shape
    m, v, w = start.copy(), np.tile(x.var(0) + 1e-6, (len(start), 1)), np.full(len(start), 1 / len(start))
    old = None
    for _ in range(rounds):
        log = np.log(w + 1e-12) - 0.5 * (d * np.log(2 * np.pi) + np.log(v).sum(1) + (((x[:, None] - m) ** 2) / v).sum(2))
        top = log.max(1, keepdims=True)
        ll = (top[:, 0] + np.log(np.exp(log - top).sum(1)))
        r = np.exp(log - ll[:, None])
        nk = r.sum(0) + 1e-12
        w, m = nk / n, (r.T @ x) / nk[:, None]
        v = np.stack([(r[:, k] @ (x - m[k]) ** 2) / nk[k] for k in range(len(m))]) + 1e-6
        if old is not None and abs(ll.sum() - old) <= 1e-4 * (abs(ll.sum()) + 1e-12):
            break
        old = ll.sum()
    return w, m, v


def test_mixtures_follow_plain_rounds(spark):
    r = np.random.default_rng(8)
    clouds = {"a": np.vstack([r.normal((0, 0), 0.3, (300, 2)), r.normal((4, 1), 0.5, (200, 2))]), "b": r.normal((1, -1), (2, 0.5), (400, 2)), "c": np.array([[1.0, 2.0], [3.0, 4.0]])}
    df = spark.createDataFrame(pd.DataFrame([(k, *p) for k, x in clouds.items() for p in x.tolist()], columns=["g", "x", "y"]))
    got = {q.g: q for q in mixture.fit(df, ["g"], ["x", "y"], 3).collect()}
    order = df.selectExpr("g", "x", "y", "xxhash64(0, x, y) h").toPandas()
    for k, x in clouds.items():
        start = order[order.g == k].sort_values(["h", "x", "y"])[["x", "y"]].to_numpy()[:3]
        w, m, v = plain_mixture(x, start)
        mix = got[k].mixture
        assert got[k].n == len(x) and len(mix) == len(start) and sum(c.w for c in mix) == pytest.approx(1, abs=1e-6)
        np.testing.assert_allclose([c.w for c in mix], w, rtol=1e-5, atol=1e-7)
        np.testing.assert_allclose([c.m for c in mix], m, rtol=1e-5, atol=1e-7)
        np.testing.assert_allclose([c.v for c in mix], v, rtol=1e-4, atol=1e-7)


def test_divergence_of_known_mixtures(spark):
    r = np.random.default_rng(9)
    here, again, there = r.normal(0, 1, (1500, 2)), r.normal(0, 1, (1500, 2)), r.normal(0, 1, (1500, 2)) + [3, 0]
    frame = lambda parts: spark.createDataFrame(pd.DataFrame([(k, *p) for k, x in parts.items() for p in x.tolist()], columns=["g", "x", "y"]))
    truth = frame({"self": here, "same": here, "far": here})
    got = {q.g: q.d_stsp for q in mixture.mixture_divergence(truth, frame({"self": here, "same": again, "far": there}), ["g"], ["x", "y"], 2, draws=1000).collect()}
    assert got["self"] == 0.0 and got["same"] < 0.05 and got["far"] == pytest.approx(4.5, rel=0.2)  # half the squared distance
