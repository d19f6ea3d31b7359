"""Power spectra of any length as joins and aggregates, and what is read from them.

A transform of length n goes through chirps (Bluestein): multiply by a chirp,
convolve with its conjugate, whose length may be the next power of two. A
transform over rows takes two grouped stages: each group is a residue class and
holds an array of about the square root of the length, transformed within its
row by a radix-2 expression; between the stages come twiddle factors and a
shuffle. So the cost is n log n and no group holds a series. For windows of
bounded length the same expression runs within one row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import arrays as A
from tidemark.session import freeze

SMOOTHING = 20
BLOCK = 256
LEAST = 8  # points that a spectrum needs
FLOOR = 1e-20  # added to every power before logarithms


def _complex(re: str, im: str) -> str:
    return f"named_struct('re', {re}, 'im', {im})"


ZERO = _complex("0D", "0D")


def fft(x: str) -> str:
    """SQL of the transform of an array of (re, im) structs whose size is a power of two.

    Each stage reads the array of the stage before and writes in sorted order, so
    no bits are reversed at the end.
    """
    low = "(o_ & (shiftleft(1, t_) - 1)) + shiftleft(1, t_) * shiftright(o_, t_ + 1)"
    pair = f"transform(array({low}), i_ -> named_struct('a', f_[i_], 'b', f_[i_ + size(f_) div 2]))"
    turn = "(-2D * pi() * shiftright(o_, t_ + 1) * shiftleft(1, t_) / size(f_))"
    less = f"transform(array(named_struct('re', g_.a.re - g_.b.re, 'im', g_.a.im - g_.b.im, 'c', cos({turn}), 's', sin({turn}))), d_ -> {_complex('d_.re * d_.c - d_.im * d_.s', 'd_.re * d_.s + d_.im * d_.c')})[0]"
    one = f"if((shiftright(o_, t_) & 1) = 0, {_complex('g_.a.re + g_.b.re', 'g_.a.im + g_.b.im')}, {less})"
    stage = f"transform(sequence(0, size(f_) - 1), o_ -> transform({pair}, g_ -> {one})[0])"
    return A.let("z_", x, f"if(size(z_) < 2, z_, aggregate(sequence(0, CAST(round(log2(size(z_))) AS INT) - 1), z_, (f_, t_) -> {stage}))")


def fft_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bits, k, re, im): transform of length 2^bits of each group's values at j = 0, 1, 2, … (keys, bits, j, re, im).

    Places behind the last j are zero. A group needs at least 2^(bits div 2) rows.
    """
    keys = [*keys, "bits"]
    a, b = "shiftleft(1L, bits div 2)", "shiftleft(1L, bits - bits div 2)"
    first = (rows.withColumn("q", F.expr(f"j % {a}")).groupBy(*keys, "q")
             .agg(F.array_sort(F.collect_list(F.struct(F.expr(f"j div {a}").alias("r"), "re", "im"))).alias("x"))
             .withColumn("x", F.expr(f"concat(transform(x, e_ -> {_complex('e_.re', 'e_.im')}), array_repeat({ZERO}, CAST({b} AS INT) - size(x)))")))
    mid = first.select(*keys, "q", F.posexplode(F.expr(fft("x"))).alias("v", "y"))
    turn = F.expr("-2D * pi() * ((q * v) % shiftleft(1L, bits)) / shiftleft(1L, bits)")
    mid = mid.select(*keys, "q", "v", turn.alias("w"), F.col("y.re").alias("re"), F.col("y.im").alias("im"))
    mid = mid.select(*keys, "v", F.struct("q", F.expr("re * cos(w) - im * sin(w)").alias("re"), F.expr("re * sin(w) + im * cos(w)").alias("im")).alias("e"))
    last = mid.groupBy(*keys, "v").agg(F.array_sort(F.collect_list("e")).alias("x"))
    last = last.withColumn("x", F.expr(f"transform(x, e_ -> {_complex('e_.re', 'e_.im')})"))
    out = last.select(*keys, "v", F.posexplode(F.expr(fft("x"))).alias("u", "y"))
    return out.select(*keys, F.expr(f"{b} * u + v").alias("k"), F.col("y.re").alias("re"), F.col("y.im").alias("im"))


def _bits(n: str) -> str:
    return f"CAST(ceil(log2(2 * {n} - 1)) AS INT)"


def _chirp(j: str, n: str) -> str:
    """Angle of the chirp, reduced before it is multiplied by pi."""
    return f"(-pi() * (({j} * {j}) % (2L * {n})) / {n})"


def power_rows(points: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """(keys, n, k, power): |X_k|^2, k = 0 … n div 2, of each series of n values numbered from 0 without gaps.

    Series under ``LEAST`` points, and null values, give no row.
    """
    sized = points.join(points.groupBy(*keys).agg(F.count(value).alias("n")), keys).where(f"n >= {LEAST} AND {value} IS NOT NULL")
    sized = freeze(sized.select(*keys, "n", F.expr(_bits("n")).alias("bits"), F.col(index).cast("bigint").alias("j"), F.col(value).cast("double").alias("x")))
    chirped = sized.select(*keys, "n", "bits", "j", F.expr(f"x * cos({_chirp('j', 'n')})").alias("re"), F.expr(f"x * sin({_chirp('j', 'n')})").alias("im"))
    place = sized.select("n", "bits").distinct().select("n", "bits", F.explode(F.expr("sequence(0L, shiftleft(1L, bits) - 1)")).alias("j"))
    place = place.withColumn("i", F.expr("least(j, shiftleft(1L, bits) - j)"))
    inside = F.col("i") < F.col("n")
    kernel = place.select("n", "bits", "j", F.when(inside, F.expr(f"cos({_chirp('i', 'n')})")).otherwise(0.0).alias("re"),
                          F.when(inside, F.expr(f"-sin({_chirp('i', 'n')})")).otherwise(0.0).alias("im"))
    kernel = fft_rows(kernel, ["n"]).select("n", "k", F.col("re").alias("br"), F.col("im").alias("bi"))
    both = fft_rows(chirped, [*keys, "n"]).join(kernel, ["n", "k"])
    both = both.select(*keys, "n", "bits", F.col("k").alias("j"), F.expr("re * br - im * bi").alias("re"), F.expr("-(re * bi + im * br)").alias("im"))
    back = fft_rows(both, [*keys, "n"]).where("k <= n div 2")
    return back.select(*keys, "n", "k", F.expr("(re * re + im * im) / pow(2D, 2 * bits)").alias("power"))


def power_windows(windows: DataFrame, keep: list[str], values: str) -> DataFrame:
    """``keep`` with power, the array |X_k|^2 for k = 0 … n div 2 of the array ``values`` (no nulls): one row, one window.

    The chirp's own transform is made once per length and joined. Windows under ``LEAST`` values give no row.
    """
    size = {"n": "s_.n", "m": "shiftleft(1, s_.bits)"}
    w = windows.select(*keep, F.col(values).alias("_x"), F.size(values).alias("n")).where(f"n >= {LEAST}").withColumn("bits", F.expr(_bits("n")))
    given = "named_struct('n', n, 'bits', bits)"  # bound: an alias inside a lambda may be computed again for every element
    i = f"least(j_, {size['m']} - j_)"
    angle = _chirp(f"CAST({i} AS BIGINT)", size["n"])
    back = f"transform(sequence(0, {size['m']} - 1), j_ -> if({i} < {size['n']}, {_complex(f'cos({angle})', f'-sin({angle})')}, {ZERO}))"
    plain = "(n & (n - 1)) = 0"  # a power of two needs no chirp
    kernel = w.where(f"NOT ({plain})").select("n", "bits").distinct().select("n", F.expr(fft(A.let("s_", given, back))).alias("_b"))
    turn = _chirp("CAST(j_ AS BIGINT)", size["n"])
    chirped = f"concat(transform(x_, (v_, j_) -> {_complex(f'v_ * cos({turn})', f'v_ * sin({turn})')}), array_repeat({ZERO}, {size['m']} - {size['n']}))"
    direct = f"transform(_x, v_ -> {_complex('v_', '0D')})"
    w = w.select(*keep, "n", "bits", F.expr(fft(f"if({plain}, {direct}, {A.let('s_', given, A.let('x_', '_x', chirped))})")).alias("_a")).join(kernel, "n", "left")
    both = f"zip_with(_a, _b, (p_, q_) -> {_complex('p_.re * q_.re - p_.im * q_.im', '-(p_.re * q_.im + p_.im * q_.re)')})"
    kept = f"slice(if({plain}, _a, {fft(both)}), 1, n div 2 + 1)"
    scale = f"if({plain}, 1D, pow(2D, 2 * bits))"
    return w.select(*keep, "n", F.expr(A.let("s_", scale, f"transform({kept}, c_ -> (c_.re * c_.re + c_.im * c_.im) / s_)")).alias("power"))


def hann(index: str, n: str) -> str:
    return f"(0.5D - 0.5D * cos(2D * pi() * {index} / ({n} - 1)))"


def detrended(x: str) -> str:
    """SQL of an array less its straight line, tapered at both ends; empty under ``LEAST`` values."""
    # for 0 … n-1 the mean place is (n-1)/2 and the squares about it sum to n (n^2 - 1) / 12
    mean = "(aggregate(y_, 0D, (a_, v_) -> a_ + v_) / size(y_))"
    slope = ("(aggregate(zip_with(y_, sequence(0, size(y_) - 1), (v_, t_) -> v_ * (t_ - (size(y_) - 1) / 2D)), 0D, (a_, v_) -> a_ + v_)"
             " * 12D / (CAST(size(y_) AS DOUBLE) * (CAST(size(y_) AS DOUBLE) * size(y_) - 1)))")
    taken = f"(x_ - l_.m - l_.s * (t_ - (size(y_) - 1) / 2D)) * {hann('t_', 'size(y_)')}"
    line = A.let("l_", f"named_struct('m', {mean}, 's', {slope})", f"transform(y_, (x_, t_) -> {taken})")
    return A.let("y_", x, f"if(size(y_) < {LEAST}, CAST(array() AS ARRAY<DOUBLE>), {line})")


def flatness_windows(windows: DataFrame, key: str, values: str) -> DataFrame:
    """(key, flatness): geometric over arithmetic mean of the power of each detrended, tapered window.

    Nulls and values that are not finite are left out first; fewer than ``LEAST`` give NaN.
    """
    finite = f"filter({values}, f_ -> f_ IS NOT NULL AND NOT isnan(f_) AND abs(f_) < double('infinity'))"
    w = windows.select(key, F.expr(finite).alias("_f"))
    p = power_windows(w.select(key, F.expr(detrended("_f")).alias("_y")), [key], "_y")
    floor = f"transform(slice(power, 2, size(power)), p_ -> p_ + {FLOOR}D)"
    ratio = "exp(aggregate(w_, 0D, (a_, p_) -> a_ + ln(p_)) / size(w_)) / (aggregate(w_, 0D, (a_, p_) -> a_ + p_) / size(w_))"
    p = p.select(key, F.expr(A.let("w_", floor, ratio)).alias("flatness"))
    return w.select(key).join(p, key, "left").select(key, F.coalesce("flatness", F.lit(float("nan"))).alias("flatness"))


def flatness_rows(points: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """(keys, flatness) of whole series numbered from 0; see ``flatness_windows``."""
    t, v = F.col(index).cast("double"), F.col(value)
    line = points.groupBy(*keys).agg(F.regr_slope(v, t).alias("_s"), F.regr_intercept(v, t).alias("_i"), F.count(v).alias("_n"))
    y = points.join(line, keys).withColumn("_y", F.expr(f"({value} - _i - _s * {index}) * {hann(index, '_n')}"))
    p = power_rows(y, keys, index, "_y").where("k > 0").withColumn("power", F.col("power") + FLOOR)
    return p.groupBy(*keys).agg((F.exp(F.avg(F.log("power"))) / F.avg("power")).alias("flatness"))


def entropy_rows(points: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """(keys, spec_entropy): entropy of the tapered series' power without its constant, over the logarithm of the number of frequencies."""
    sized = points.join(points.groupBy(*keys).agg(F.count(value).alias("_n")), keys)
    p = power_rows(sized.withColumn("_y", F.expr(f"{value} * {hann(index, '_n')}")), keys, index, "_y").where("k > 0")
    total = p.groupBy(*keys).agg(F.sum("power").alias("_t"), F.count(F.lit(1)).alias("_m"))
    share = p.join(total, keys).withColumn("_p", F.col("power") / F.col("_t"))
    e = share.groupBy(*keys).agg((-F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.log("_p"))) / F.log(F.first("_m"))).alias("e"), F.first("_t").alias("_t"))
    return e.select(*keys, F.when(F.col("_t") > 0, F.col("e")).otherwise(1.0).alias("spec_entropy"))


def smoothed(power: DataFrame, keys: list[str], width: int = SMOOTHING) -> DataFrame:
    """(keys, k, share): the power under a Gaussian of ``width`` frequencies (cut at three widths, zero outside), summing to one.

    Frequencies go to their block and, near its border, to the next, so each
    block of an array finds its neighbours without a join.
    """
    radius = 3 * width if width > 1 else 0
    bell = [math.exp(-0.5 * (d / width) ** 2) if radius else 1.0 for d in range(-radius, radius + 1)]
    weights = "array(" + ", ".join(f"{w / sum(bell)!r}D" for w in bell) + ")"
    spread = power.select(*keys, "k", "power", F.explode(F.expr(f"sequence(greatest(0L, (k - {radius}) div {BLOCK}), (k + {radius}) div {BLOCK})")).alias("_b"))
    block = spread.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(F.struct("k", "power"))).alias("_x")).withColumn("_w", F.expr(weights))
    first, last = "_x[0].k", "element_at(_x, -1).k"
    inner = (f"aggregate(sequence(greatest(k_ - {radius}, {first}), least(k_ + {radius}, {last})), 0D, "
             f"(a_, u_) -> a_ + _w[CAST(u_ - k_ + {radius} AS INT)] * _x[CAST(u_ - {first} AS INT)].power)")
    own = block.where(f"{last} >= _b * {BLOCK}")
    out = own.select(*keys, F.explode(F.expr(
        f"transform(sequence(_b * {BLOCK}, least({last}, _b * {BLOCK} + {BLOCK - 1})), k_ -> named_struct('k', k_, 's', {inner}))")).alias("e"))
    out = out.select(*keys, F.col("e.k").alias("k"), F.col("e.s").alias("_s"))
    total = out.groupBy(*keys).agg(F.sum("_s").alias("_t"))
    return out.join(total, keys).select(*keys, "k", F.when(F.col("_t") > 1e-12, F.col("_s") / F.col("_t")).otherwise(F.col("_s")).alias("share"))


def standardised(points: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, i, z): values less their mean over their spread, numbered from 0; without spread they are zero."""
    whole = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(whole)
    z = (F.col(value) - F.avg(value).over(whole)) / F.when(sd > 1e-12, sd).otherwise(1.0)
    return points.where(F.col(value).isNotNull()).select(*keys, (F.row_number().over(whole.orderBy(order)) - 1).alias("i"), z.alias("z"))


def spectrum_distance(truth: DataFrame, generated: DataFrame, keys: list[str], order: str, value: str, width: int = SMOOTHING) -> DataFrame:
    """(keys, d_h): Hellinger distance of the smoothed power spectra of two sets of standardised series, from 0 to 1.

    Where lengths differ the lower frequencies both have are compared.
    """
    def shares(df: DataFrame, name: str) -> DataFrame:
        p = smoothed(power_rows(standardised(df, keys, order, value), keys, "i", "z"), keys, width)
        return p.withColumnRenamed("share", name)

    both = shares(truth, "_t").join(shares(generated, "_g"), [*keys, "k"])
    return both.groupBy(*keys).agg(F.sqrt(F.greatest(F.lit(0.0), 1 - F.sum(F.sqrt(F.col("_t") * F.col("_g"))))).alias("d_h"))


def mean_distance(distances: DataFrame, keys: list[str]) -> DataFrame:
    """Average over the dimensions of multivariate series: ``distances`` has one row per (keys, dimension)."""
    return distances.groupBy(*keys).agg(F.avg("d_h").alias("d_h"))


