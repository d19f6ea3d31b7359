"""Truth-preserving augmentation: one hash-chosen operation per challenge, and flat-context redraw."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark import dims
from tidemark.functions import arrays as A
from tidemark.functions.hashing import uniform

OPS = ("magnitude_warp", "time_warp", "history_cutout", "jitter")
KNOTS = 4


def _normal(seed: str, *parts) -> F.Column:
    u1 = F.greatest(uniform(seed, *parts, F.lit("n1")), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * F.pi() * uniform(seed, *parts, F.lit("n2")))


def _warp_pieces() -> str:
    """SQL of the pieces between knots: first place s, speed c0 + c1 * place, and p, the time elapsed before the piece.

    Speed is linear between knots, so elapsed time is quadratic there.
    """
    y = [f"greatest(1 + knots[{j}], 0.2D)" for j in range(KNOTS)]
    first = [f"(({j} * (wn - 1) + {KNOTS - 2}) div {KNOTS - 1})" for j in range(KNOTS - 1)]
    made, before = [], "0D"
    for j in range(KNOTS - 1):
        rise = f"({y[j + 1]} - {y[j]})"
        c0, c1 = f"({y[j]} - {rise} * {j})", f"({rise} * {KNOTS - 1}D / (wn - 1))"
        made.append(f"named_struct('s', {first[j]}, 'c0', {c0}, 'c1', {c1}, 'p', {before})")
        if j < KNOTS - 2:
            n, k = f"({first[j + 1]} - {first[j]})", f"({first[j + 1]} - 1)"
            before = f"({before} + {c0} * {n} + {c1} * ({k} * ({k} + 1) - {first[j]} * ({first[j]} - 1)) / 2D)"
    return f"array({', '.join(made)})"


def _elapsed(k: str, piece: str | None = None) -> str:
    """SQL of the warped time up to and including place ``k``."""
    g = piece or "warp[" + "CASE " + " ".join(f"WHEN {k} < warp[{j}].s THEN {j - 1}" for j in range(1, KNOTS - 1)) + f" ELSE {KNOTS - 2} END]"
    one = f"g_.p + g_.c0 * ({k} - g_.s + 1) + g_.c1 * (CAST({k} AS DOUBLE) * ({k} + 1) - CAST(g_.s AS DOUBLE) * (g_.s - 1)) / 2D"
    return f"transform(array({g}), g_ -> {one})[0]"


def _warped_value() -> str:
    """SQL of the window ``w`` read at time ``i``: the piece that reaches the time, the root of its quadratic, then one step up or down against rounding."""
    t = "(i * warp_total / (wn - 1))"
    ends = [_elapsed(f"(warp[{j + 1}].s - 1)", f"warp[{j}]") for j in range(KNOTS - 2)]
    piece = "warp[CASE " + " ".join(f"WHEN {e} > {t} THEN {j}" for j, e in enumerate(ends)) + f" ELSE {KNOTS - 2} END]"
    e = "(h_.p - h_.c0 * (h_.s - 1) - h_.c1 * CAST(h_.s AS DOUBLE) * (h_.s - 1) / 2D)"
    b = "(h_.c0 + h_.c1 / 2D)"
    root = f"transform(array({piece}), h_ -> CAST(floor(2 * ({t} - {e}) / ({b} + sqrt(greatest(0D, {b} * {b} + 2 * h_.c1 * ({t} - {e}))))) AS INT))[0]"
    time = lambda k: f"({_elapsed(k)} / warp_total * (wn - 1))"
    near = f"filter(sequence(greatest(0, r_ - 1), least(wn - 1, r_ + 3)), k_ -> {time('k_')} > i)"
    at = f"transform(array({root}), r_ -> coalesce(get({near}, 0), wn))[0]"
    value = f"w[k - 1] + (w[k] - w[k - 1]) * (i - {time('(k - 1)')}) / ({time('k')} - {time('(k - 1)')})"
    return f"transform(array({at}), k -> CASE WHEN k = 0 THEN w[0] WHEN k >= wn THEN w[wn - 1] ELSE {value} END)[0]"


def augment(ch: DataFrame, seed: str, severity: float = 0.3) -> DataFrame:
    """Apply one operation to each challenge's whole window; the cutout touches history only.

    Draw-level randomness (knots, start) is hashed once per challenge; only the
    jitter hashes per point.
    """
    if severity <= 0:
        return ch.withColumn("op", F.lit("none"))
    key = F.col("challenge_id")
    df = ch.withColumn("op", F.element_at(F.array(*[F.lit(o) for o in OPS]), (F.floor(uniform(seed, key, F.lit("op")) * len(OPS)) + 1).cast("int")))
    df = df.withColumn("w", F.concat("context", "truth")).withColumn("wn", F.size("w"))
    df = df.withColumn("knots", F.array(*[_normal(seed, key, F.lit(f"k{i}")) * severity for i in range(KNOTS)]))
    df = df.withColumn("span", F.floor(F.lit(severity) * F.col("context_len") * 0.5).cast("int"))
    df = df.withColumn("cut", F.floor(uniform(seed, key, F.lit("cut")) * F.greatest(F.lit(1), F.col("context_len") - F.col("span"))).cast("int"))
    pos = f"(i * {KNOTS - 1}D / (wn - 1))"
    lo = f"least(CAST(floor({pos}) AS INT), {KNOTS - 2})"
    curve = f"(1 + knots[{lo}] + (knots[{lo} + 1] - knots[{lo}]) * ({pos} - {lo}))"
    df = df.withColumn("warp", F.expr(f"if(op = 'time_warp', {_warp_pieces()}, NULL)"))
    df = df.withColumn("warp_total", F.expr(f"if(op = 'time_warp', {_elapsed('(wn - 1)')}, NULL)"))
    read = f"transform(sequence(0, wn - 1), i -> {_warped_value()})"
    u = lambda tag: f"(CAST(conv(substr(md5(concat_ws('|', '{seed}', challenge_id, i, '{tag}')), 1, 8), 16, 10) AS BIGINT) / 4294967296.0D)"
    noise = f"sqrt(-2 * ln(greatest({u('j1')}, 1e-12D))) * cos(2 * pi() * {u('j2')})"
    df = df.withColumn("w_sd", F.expr(A.std_pop("w")))
    out = f"""CASE op WHEN 'magnitude_warp' THEN transform(w, (v, i) -> v * {curve})
      WHEN 'time_warp' THEN {read}
      WHEN 'history_cutout' THEN if(span < 1, w, transform(w, (v, i) -> if(i >= cut AND i < cut + span, w[cut], v)))
      ELSE transform(w, (v, i) -> v + {severity}D * (w_sd + {dims.EPS}D) * {noise}) END"""
    df = df.withColumn("w", F.expr(out))
    return df.withColumn("context", F.expr("slice(w, 1, context_len)")).withColumn("truth", F.expr("slice(w, context_len + 1, horizon)")).drop(
        "w", "wn", "knots", "span", "cut", "warp", "warp_total", "w_sd")


def first_lively(attempts: DataFrame, key: str = "challenge_id", order: str = "attempt") -> DataFrame:
    """Keep the first attempt whose context varies, else the last one (attempts are bounded rows)."""
    ok = (F.expr(A.std_pop("context")) > dims.EPS).cast("int")
    w = Window.partitionBy(key).orderBy(F.desc("_ok"), F.when(F.col("_ok") == 1, F.col(order)).otherwise(-F.col(order)))
    return attempts.withColumn("_ok", ok).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_ok", "_r")
