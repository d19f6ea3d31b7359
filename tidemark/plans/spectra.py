"""Spectra and mixtures of whole series: distances between truth and generated trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import mixture, series as Q, spectrum as S
from tidemark.plans.dynamics import _EMB, _generated
from tidemark.plans.views import BINS_SQL, R, rnd, series_bins
from tidemark.registry import query
from tidemark.session import freeze

_POWER = "pow(sum({y}*cos(2*pi()*((f*i)%n)/n)), 2) + pow(sum({y}*sin(2*pi()*((f*i)%n)/n)), 2)"


@query("spectrum_distance", "X6", f"""WITH {_EMB}, q AS (SELECT series_key, k, len(z) n, i, z[i+1] y FROM (SELECT *, unnest(range(0, len(z))) i FROM s2)),
fr AS (SELECT series_key, k, unnest(range(0, len(z)//2+1)) f FROM s2), pw AS MATERIALIZED (SELECT series_key, k, f, {_POWER.format(y='y')} p FROM q JOIN fr USING (series_key, k) GROUP BY 1, 2, 3),
sm AS (SELECT a.series_key, a.k, a.f, sum(b.p*exp(-0.5*pow((a.f-b.f)/20.0, 2))) s FROM pw a JOIN pw b ON a.series_key = b.series_key AND a.k = b.k AND b.f BETWEEN a.f-60 AND a.f+60 GROUP BY 1, 2, 3),
sh AS (SELECT series_key, k, f, s/sum(s) OVER (PARTITION BY series_key, k) s FROM sm)
SELECT t.series_key, {R('sqrt(greatest(0, 1 - sum(sqrt(t.s*g.s))))', 5)} d_h FROM sh t JOIN sh g ON t.series_key = g.series_key AND t.f = g.f WHERE t.k = 't' AND g.k = 'g' GROUP BY 1""")
def spectrum_distance(spark, sf):
    """Whole series against their distorted copies."""
    t, g = _generated(spark, sf)
    return S.spectrum_distance(t, freeze(g), ["series_key"], "ts", "value").withColumn("d_h", rnd(F.col("d_h"), 5))


@query("series_flatness", "Q2", f"""WITH {BINS_SQL}, q AS (SELECT series_key, row_number() OVER (PARTITION BY series_key ORDER BY ts) - 1 i, "value" v FROM bins),
l AS (SELECT series_key, count(*) n, regr_slope(v, i) s, regr_intercept(v, i) c FROM q GROUP BY 1 HAVING count(*) >= 8), y AS (SELECT series_key, n, i, (v - c - s*i)*(0.5 - 0.5*cos(2*pi()*i/(n-1))) y FROM q JOIN l USING (series_key)),
fr AS (SELECT series_key, unnest(range(1, n//2+1)) f FROM l), pw AS (SELECT series_key, f, {_POWER.format(y='y')} + 1e-20 p FROM y JOIN fr USING (series_key) GROUP BY 1, 2)
SELECT series_key, {R('exp(avg(ln(p)))/avg(p)', 5)} flatness FROM pw GROUP BY 1""")
def series_flatness(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("series_key").orderBy("ts")
    points = series_bins(spark, sf).select("series_key", (F.row_number().over(order) - 1).alias("i"), "value")
    return S.flatness_rows(freeze(points), ["series_key"], "i", "value").withColumn("flatness", rnd(F.col("flatness"), 5))


MIXTURE_ROUNDS = 8


@query("mixture_divergence", "X5")
def mixture_divergence(spark, sf):
    """Four delayed coordinates, where a histogram is too sparse; both series take the truth's delay. ``MIXTURE_ROUNDS`` rounds at most."""
    t, g = _generated(spark, sf)
    tau = freeze(Q.embedding_delay(t, ["series_key"], "ts", "value"))
    x = [f"x{k}" for k in range(4)]
    a, b = (freeze(Q.embed_points(df, ["series_key"], "ts", "value", tau, 4).select("series_key", *x)) for df in (t, g))
    return mixture.mixture_divergence(a, b, ["series_key"], x, components=4, rounds=MIXTURE_ROUNDS).withColumn("d_stsp", rnd(F.col("d_stsp"), 4))
