"""Feature space and long-trajectory comparison.

Bin counts, divergence sums, prediction times, exponents, features and spectra
dimensions are joins and aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark import dims
from tidemark.operators.bounded import running_total
from tidemark.operators.spectrum import entropy_rows
from tidemark.session import freeze

LAPLACE = 1e-6
DIVERGENCE_STEPS = 20
THEILER = 10


def state_divergence(truth: DataFrame, generated: DataFrame, keys: list[str], m: int = 3, bins: int = 20) -> DataFrame:
    """KL(true || generated) of binned embeddings on the truth's grid (5 % margin, Laplace-smoothed).

    Points outside the grid drop out; the empty cells of the full grid all
    contribute the same term, so they are counted and never materialised.
    """
    xs = [f"x{i}" for i in range(m)]
    rng = truth.groupBy(*keys).agg(*[F.min(x).alias(f"lo_{x}") for x in xs], *[F.max(x).alias(f"hi_{x}") for x in xs])

    def binned(df: DataFrame, name: str) -> DataFrame:
        j = df.join(rng, keys)
        cell = []
        for x in xs:
            span = f"(CASE WHEN hi_{x} - lo_{x} > {dims.EPS} THEN hi_{x} - lo_{x} ELSE 1D END)"
            lo, hi = f"(lo_{x} - 0.05D * {span})", f"(hi_{x} + 0.05D * {span})"
            j = j.withColumn(f"b_{x}", F.expr(f"CASE WHEN {x} >= {lo} AND {x} <= {hi} THEN least(CAST(floor(({x} - {lo}) / ({hi} - {lo}) * {bins}) AS INT), {bins - 1}) END"))
            cell.append(f"b_{x}")
        j = j.where(" AND ".join(f"{c} IS NOT NULL" for c in cell))
        return j.groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias(name))

    cells = binned(truth, "nt").join(binned(generated, "ng"), [*keys, *[f"b_{x}" for x in xs]], "full_outer").select(
        *keys, F.coalesce("nt", F.lit(0)).alias("nt"), F.coalesce("ng", F.lit(0)).alias("ng"))
    size = bins**m
    tot = cells.groupBy(*keys).agg(F.sum("nt").alias("t"), F.sum("ng").alias("g"), F.count(F.lit(1)).alias("k"))
    j = cells.join(tot, keys)
    pt, pg = f"((nt + {LAPLACE}D) / (t + {size} * {LAPLACE}D))", f"((ng + {LAPLACE}D) / (g + {size} * {LAPLACE}D))"
    seen = j.groupBy(*keys).agg(F.sum(F.expr(f"{pt} * ln({pt} / {pg})")).alias("seen"), F.first("t").alias("t"), F.first("g").alias("g"), F.first("k").alias("k"))
    zt, zg = f"({LAPLACE}D / (t + {size} * {LAPLACE}D))", f"({LAPLACE}D / (g + {size} * {LAPLACE}D))"
    return seen.select(*keys, F.expr(f"seen + ({size} - k) * {zt} * ln({zt} / {zg})").alias("d_stsp"))


def prediction_time(pairs: DataFrame, keys: list[str], threshold: float = 0.4, per: float | None = None) -> DataFrame:
    """First step whose error, in units of the truth's spread, passes the threshold; else the length."""
    sd = pairs.groupBy(*keys).agg(F.stddev_pop("truth").alias("_s"), F.count(F.lit(1)).alias("_n"))
    j = pairs.join(sd, keys).withColumn("_e", F.abs(F.col("pred") - F.col("truth")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0))
    v = j.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_e") > threshold, F.col("step"))), F.first("_n")).cast("double").alias("vpt"))
    return v.withColumn("vpt", F.col("vpt") / per) if per else v


def kaplan_yorke(spectrum: DataFrame, keys: list[str], exponent: str) -> DataFrame:
    """Cumulative-sum dimension of a table of exponents (a few rows per system)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(exponent), "idx")
    s = spectrum.select(*keys, F.col(exponent).alias("l"), F.sum(exponent).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"),
                        F.row_number().over(w).alias("j"), F.lead(exponent).over(w).alias("nx"))
    last = s.where("c >= 0").groupBy(*keys).agg(F.max(F.struct("j", "c", "nx")).alias("b"))
    d = F.when(F.col("b.nx").isNull(), F.col("b.j").cast("double")).otherwise(F.col("b.j") + F.col("b.c") / F.abs(F.col("b.nx")))
    return spectrum.select(*keys).distinct().join(last, keys, "left").select(*keys, F.coalesce(d, F.lit(0.0)).alias("dimension"))


def cloud_spread(points: DataFrame, label: str, pos: str, value: str, reference: int | str) -> DataFrame:
    """Trace of the covariance per cloud and distance of its centroid to the reference cloud."""
    per = points.groupBy(label, pos).agg(F.avg(value).alias("c"), F.var_samp(value).alias("v"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(pos)  # one row per cloud
    ref = F.max(F.when(F.col(label) == reference, F.col("c"))).over(w)
    per = per.withColumn("d2", (F.col("c") - ref) ** 2)
    return per.groupBy(label).agg(F.max("n").alias("n"), F.sum("v").alias("spread"), F.sqrt(F.sum("d2")).alias("centroid_distance"))


def robust_scale(long: DataFrame, feature: str, value: str, clip: float = 6.0) -> DataFrame:
    """(x - median) / IQR clipped; a zero IQR counts as one."""
    from tidemark.operators.bounded import exact_percentiles

    q = exact_percentiles(long, [feature], value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    iqr = F.when(F.col("q75") - F.col("q25") == 0, 1.0).otherwise(F.col("q75") - F.col("q25"))
    z = (F.col(value) - F.col("q50")) / iqr
    return long.join(q, feature).withColumn(value, F.least(F.greatest(z, F.lit(-clip)), F.lit(clip))).drop("q25", "q50", "q75")


def principal_components(wide: DataFrame, id_cols: list[str], features: list[str], k: int) -> DataFrame:
    """Projection on the first ``k`` components; the covariance is a distributed aggregate.

    The library's projection does not centre, so the columns are centred first.
    """
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    mu = wide.agg(*[F.avg(c).alias(f"_m_{c}") for c in features])
    c = wide.join(F.broadcast(mu)).select(*id_cols, *[(F.col(f) - F.col(f"_m_{f}")).alias(f) for f in features])  # one row of means
    v = VectorAssembler(inputCols=features, outputCol="_v").transform(c)
    p = PCA(k=k, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("_a", vector_to_array("_p"))
    return p.select(*id_cols, *[F.col("_a")[i].alias(f"pc{i + 1}") for i in range(k)])


def delay_vectors(bins: DataFrame, key: str, ts: str, value: str, tau: int) -> DataFrame:
    """(key, i, x0, x1, x2): standardised values at a point and ``tau`` and 2 ``tau`` later, points numbered from 0.

    ``bins`` holds clock bins, so a series is as long as its calendar span and never as its rows.
    """
    w, whole = Window.partitionBy(key).orderBy(ts), Window.partitionBy(key)
    z = bins.withColumn("_z", (F.col(value) - F.avg(value).over(whole)) / F.stddev_pop(value).over(whole))
    z = z.select(key, (F.row_number().over(w) - 1).alias("i"), F.col("_z").alias("x0"), F.lead("_z", tau).over(w).alias("x1"),
                 F.lead("_z", 2 * tau).over(w).alias("x2"))
    return z.where("x2 IS NOT NULL")


def largest_exponent(points: DataFrame, key: str, steps: int = DIVERGENCE_STEPS, apart: int = THEILER, per_time: float = 1.0,
                     block: int = 256) -> DataFrame:
    """(key, exponent): slope of the mean log distance between each point and its nearest neighbour as both move on.

    Neighbours are at least ``apart`` + 1 points away in time. Every pair of points of one series
    is compared, in blocks of ``block`` points that spread over tasks: the work is the square of
    the number of bins of a series, which its calendar span bounds. Ties take the earlier neighbour.
    """
    last = points.groupBy(key).agg((F.max("i") - steps).alias("_last"))
    live = points.join(last, key).where("i <= _last").drop("_last").withColumn("_b", F.floor(F.col("i") / block))
    other = live.select(key, F.col("i").alias("j"), *[F.col(f"x{k}").alias(f"y{k}") for k in range(3)])
    other = other.join(live.select(key, "_b").distinct(), key)
    d2 = sum((F.col(f"x{k}") - F.col(f"y{k}")) * (F.col(f"x{k}") - F.col(f"y{k}")) for k in range(3))
    near = (live.join(other, [key, "_b"]).where(F.abs(F.col("i") - F.col("j")) > apart)
            .groupBy(key, "i").agg(F.min_by("j", F.struct(d2.alias("d"), "j")).alias("j")))
    step = near.select(key, "i", "j", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("h"))
    p = points.select(key, (F.col("i")).alias("_p"), *[F.col(f"x{k}") for k in range(3)])
    q = points.select(key, (F.col("i")).alias("_q"), *[F.col(f"x{k}").alias(f"y{k}") for k in range(3)])
    moved = (step.withColumns({"_p": F.col("i") + F.col("h"), "_q": F.col("j") + F.col("h")}).join(p, [key, "_p"]).join(q, [key, "_q"])
             .select(key, "h", F.sqrt(d2).alias("d")).where(F.col("d") > dims.EPS))
    curve = moved.groupBy(key, "h").agg(F.avg(F.log("d")).alias("y"))
    return curve.groupBy(key).agg((F.regr_slope("y", "h") / per_time).alias("exponent"))


FEATURES = ("acf1", "arch_lm", "spec_entropy", "kpss", "flat_spots", "skew")
MIN_POINTS = 30
ARCH_LAGS = 12


def lag_sums(points: DataFrame, lags: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """(keys, _lag, _s): sums of value[i] * value[i + lag] for lag = 1 … ``_lags`` of ``lags`` (keys, _lags); a series and a lag have one row if any pair."""
    a = points.select(*keys, F.col(index).alias("_i"), F.col(value).alias("_a")).join(lags, keys)
    a = a.select(*keys, "_a", F.col("_i"), F.explode(F.sequence(F.lit(1), F.greatest(F.col("_lags"), F.lit(1)).cast("int"))).alias("_lag")).withColumn("_i", F.col("_i") + F.col("_lag"))
    b = points.select(*keys, F.col(index).alias("_i"), F.col(value).alias("_b"))
    return a.join(b, [*keys, "_i"]).groupBy(*keys, "_lag").agg(F.sum(F.col("_a") * F.col("_b")).alias("_s"))


def stationarity(points: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """(keys, kpss): squared partial sums of a centred series over its long-run variance, lags chosen from its autocovariances.

    ``index`` numbers a series from 0. Partial sums run over range pieces, lagged
    sums are joins, so a series need not lie in one task.
    """
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(value) * F.col(value)).alias("_s2"))
    few = n.select(*keys, F.floor(F.pow("_n", F.lit(2 / 9))).cast("int").alias("_lags"))
    half = lag_sums(points, few, keys, index, value).join(n, keys).groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.first("_s2").alias("_s2"), F.sum(F.col("_s") / (F.col("_n") / 2)).alias("_c0"), F.sum(F.col("_lag") * F.col("_s") / (F.col("_n") / 2)).alias("_c1"))
    ratio = F.col("_c1") / (F.col("_s2") / F.col("_n") + F.col("_c0"))
    auto = F.floor(1.1447 * F.pow(ratio * ratio, F.lit(1 / 3)) * F.pow("_n", F.lit(1 / 3)))
    lags = freeze(half.select(*keys, "_n", "_s2", F.least(F.coalesce(auto, F.lit(0)), F.col("_n") - 1).cast("int").alias("_lags")))
    long = lag_sums(points, lags.select(*keys, "_lags"), keys, index, value).join(lags.select(*keys, "_lags"), keys)
    long = long.where("_lag <= _lags").groupBy(*keys).agg(F.sum(2 * F.col("_s") * (1 - F.col("_lag") / (F.col("_lags") + 1))).alias("_more"))
    part = running_total(points.select(*keys, index, value), keys, index, value, "_sum").groupBy(*keys).agg(F.sum(F.col("_sum") * F.col("_sum")).alias("_eta"))
    j = lags.join(part, keys).join(long, keys, "left")
    spread = (F.col("_s2") + F.coalesce("_more", F.lit(0.0))) / F.col("_n")
    return j.select(*keys, (F.col("_eta") / F.col("_n") / F.col("_n") / spread).alias("kpss"))


def eliminated(matrix: str, columns: str) -> str:
    """SQL of a symmetric matrix (array of rows) after elimination of its first ``columns`` columns.

    What is left in a later diagonal place is the sum of squared residuals of
    that column regressed on those. A column that depends on earlier ones is passed over.
    """
    row = "if(r_ <= p_, row_, zip_with(row_, m_[p_], (x_, y_) -> x_ - row_[p_] / m_[p_][p_] * y_))"
    step = f"if(m_[p_][p_] <= 1e-10D * d_[p_][p_], m_, transform(m_, (row_, r_) -> {row}))"
    return f"transform(array({matrix}), d_ -> aggregate(sequence(0, {columns} - 1), d_, (m_, p_) -> {step}))[0]"


def arch(points: DataFrame, keys: list[str], index: str, value: str, lags: int = ARCH_LAGS) -> DataFrame:
    """(keys, arch_lm): R^2 of the squares of a standardised series regressed on their ``lags`` predecessors, a quarter of the series at most.

    One pass sums the products of all pairs of columns before the shuffle; the small matrix is then solved within its row.
    """
    w = Window.partitionBy(*keys).orderBy(index)
    sized = points.join(points.groupBy(*keys).agg(F.least(F.lit(lags), F.expr("count(1) div 4")).cast("int").alias("_m")), keys)
    y = sized.withColumn("_y", F.col(value) * F.col(value) - 1)
    cols = [F.when(F.col("_m") >= k, F.lag("_y", k).over(w)).otherwise(0.0).alias(f"_c{k}") for k in range(1, lags + 1)]
    x = y.select(*keys, index, "_m", F.lit(1.0).alias("_c0"), *cols, F.col("_y").alias(f"_c{lags + 1}")).where((F.col(index) >= F.col("_m")) & (F.col("_m") > 0))
    size = lags + 2
    sums = [F.sum(F.col(f"_c{a}") * F.col(f"_c{b}")).alias(f"g{a}_{b}") for a in range(size) for b in range(a, size)]
    matrix = F.array(*[F.array(*[F.col(f"g{min(a, b)}_{max(a, b)}") for b in range(size)]) for a in range(size)])
    m = x.groupBy(*keys).agg(*sums).select(*keys, matrix.alias("_g"))
    end = size - 1
    total = f"(_g[{end}][{end}] - _g[0][{end}] * _g[0][{end}] / _g[0][0])"
    fit = m.select(*keys, F.expr(total).alias("_t"), F.expr(f"{eliminated('_g', str(end))}[{end}][{end}]").alias("_r"))
    fit = fit.select(*keys, F.when(F.col("_t") > 1e-12, 1 - F.col("_r") / F.col("_t")).otherwise(0.0).alias("arch_lm"))
    return points.select(*keys).distinct().join(fit, keys, "left").select(*keys, F.coalesce("arch_lm", F.lit(0.0)).alias("arch_lm"))


def feature_table(points: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Six features of each series of clock bins or bounded windows.

    Lag-1 autocorrelation, dependence of squares on earlier squares, spectral
    entropy, stationarity statistic, longest constant stretch and skewness.
    Series under ``MIN_POINTS`` points or without variation give no row.
    """
    w, whole = Window.partitionBy(key).orderBy(order), Window.partitionBy(key)
    z = points.where(F.col(value).isNotNull()).withColumn("_z", F.col(value) - F.avg(value).over(whole))
    z = z.withColumns({"_next": F.lead("_z").over(w), "_new": (F.lag(value).over(w) != F.col(value)).cast("int"), "_i": F.row_number().over(w) - 1})
    z = freeze(z.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).select(key, "_i", "_z", "_next", "_run"))
    sums = z.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_z") * F.col("_z")).alias("s2"), F.avg(F.col("_z") * F.col("_z") * F.col("_z")).alias("m3"),
                              F.sum(F.col("_z") * F.col("_next")).alias("s1"))
    flat = z.groupBy(key, "_run").agg(F.count(F.lit(1)).alias("_len")).groupBy(key).agg(F.max("_len").alias("flat"))
    j = freeze(sums.join(flat, key).where((F.col("n") >= MIN_POINTS) & (F.col("s2") > 0)))
    x = freeze(z.join(j.select(key, F.sqrt(F.col("s2") / F.col("n")).alias("_sd")), key).select(key, "_i", (F.col("_z") / F.col("_sd")).alias("_x")))
    more = [arch(x, [key], "_i", "_x"), entropy_rows(x, [key], "_i", "_x"), stationarity(x, [key], "_i", "_x")]
    for f in more:
        j = j.join(f, key)
    return j.select(key, (F.col("s1") / F.col("s2")).alias("acf1"), "arch_lm", "spec_entropy", "kpss", (F.col("flat") / F.col("n")).alias("flat_spots"),
                    (F.col("m3") / F.pow(F.col("s2") / F.col("n"), F.lit(1.5))).alias("skew"))
