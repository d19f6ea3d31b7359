"""Distribution tails as Columns (Spark has no erf), with their SQL text twins.

The complementary error function uses the Chebyshev fit with fractional error
below 1.2e-7 everywhere, so tiny tail probabilities keep their magnitude.
"""

from __future__ import annotations

# --- fixed values: Chebyshev coefficients of the erfc fit ----------------------
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: str) -> str:
    """Text valid in Spark SQL and DuckDB alike."""
    t = f"(1.0/(1.0+0.5*abs({x})))"
    poly = f"({ERFC[-1]})"
    for c in reversed(ERFC[:-1]):
        poly = f"({c}+{t}*{poly})"
    body = f"({t}*exp(-({x})*({x})+{poly}))"
    return f"(CASE WHEN {x} >= 0 THEN {body} ELSE 2.0-{body} END)"


def normal_sf(z: str) -> str:
    return f"(0.5*{erfc(f'(({z})/sqrt(2.0))')})"


def normal_two_sided(z: str) -> str:
    return f"least(1.0, {erfc(f'(abs({z})/sqrt(2.0))')})"


def chi2_sf(x: str, df: str) -> str:
    """Wilson-Hilferty upper tail."""
    z = f"((pow(({x})/({df}), 1.0/3.0) - (1.0-2.0/(9.0*({df})))) / sqrt(2.0/(9.0*({df}))))"
    return f"(CASE WHEN {x} <= 0 OR {df} <= 0 THEN 1.0 ELSE {normal_sf(z)} END)"


def t_to_z(t: str, df: str) -> str:
    """Student t to an equivalent normal deviate."""
    return f"(({t})*(1.0-1.0/(4.0*({df})))/sqrt(1.0+({t})*({t})/(2.0*({df}))))"


# --- exact small-sample tails: Spark SQL only ---------------------------------------

BETA_STEPS = 1000  # half steps of the continued fraction; enough for LARGE_DF, which needs about 2 sqrt(df)
LARGE_DF = 100_000  # beyond it the equivalent normal deviate has more digits than the fraction


def lgamma(z: str) -> str:
    """Logarithm of the gamma function for z > 0: Stirling's series eight places higher up."""
    y = f"({z} + 8D)"
    down = " * ".join(f"({z} + {k}D)" for k in range(8))
    series = f"1D / (12D * {y}) - 1D / (360D * pow({y}, 3)) + 1D / (1260D * pow({y}, 5)) - 1D / (1680D * pow({y}, 7))"
    return f"(({y} - 0.5D) * ln({y}) - {y} + 0.9189385332046727D + {series} - ln({down}))"


def beta_fraction(a: str, b: str, x: str) -> str:
    """Regularised incomplete beta function where x < (a + 1) / (a + b + 2)."""
    even = f"(k_ div 2) * ({b} - (k_ div 2)) * {x} / (({a} - 1D + k_) * ({a} + k_))"
    odd = f"-({a} + (k_ div 2)) * ({a} + {b} + (k_ div 2)) * {x} / (({a} + (k_ - 1)) * ({a} + k_))"
    d, c = "(1D / (1D + e_ * s_.d))", "(1D + e_ / s_.c)"
    step = f"transform(array(if(k_ % 2 = 0, {even}, {odd})), e_ -> named_struct('c', {c}, 'd', {d}, 'h', s_.h * {d} * {c}))[0]"
    first = f"(1D / (1D - ({a} + {b}) * {x} / ({a} + 1D)))"
    run = f"aggregate(sequence(2, {BETA_STEPS}), named_struct('c', 1D, 'd', {first}, 'h', {first}), (s_, k_) -> {step}).h"
    front = f"exp({lgamma(f'({a} + {b})')} - {lgamma(a)} - {lgamma(b)} + {a} * ln({x}) + {b} * ln(1D - {x})) / {a}"
    return f"({front} * {run})"


def t_two_sided(t: str, df: str) -> str:
    """Both tails of Student's t with ``df`` degrees of freedom, null where either is null."""
    a, x = "g_.a", "g_.x"
    low, high = beta_fraction(a, "0.5D", x), beta_fraction("0.5D", a, f"(1D - {x})")
    p = f"CASE WHEN {x} >= 1D THEN 1D WHEN {x} < ({a} + 1D) / ({a} + 2.5D) THEN {low} ELSE 1D - {high} END"
    given = f"named_struct('a', CAST({df} AS DOUBLE) / 2D, 'x', CAST({df} AS DOUBLE) / ({df} + CAST({t} AS DOUBLE) * {t}))"
    exact = f"transform(array({given}), g_ -> {p})[0]"
    return f"(CASE WHEN {t} IS NULL OR {df} IS NULL THEN NULL WHEN {df} > {LARGE_DF} THEN {normal_two_sided(t_to_z(t, df))} ELSE {exact} END)"


def t_less(t: str, df: str) -> str:
    """Lower tail of Student's t."""
    return f"(CASE WHEN {t} <= 0 THEN {t_two_sided(t, df)} / 2D ELSE 1D - {t_two_sided(t, df)} / 2D END)"


def signed_rank_cdf(w: str, m: str) -> str:
    """P(W <= w) of the sum of a random half of the ranks 1 … m: subsets counted by sum, one rank at a time; exact up to m = 52."""
    grow = "zip_with(concat(c_, array_repeat(0D, k_)), concat(array_repeat(0D, k_), c_), (u_, v_) -> u_ + v_)"
    counts = f"aggregate(sequence(1, CAST({m} AS INT)), array(1D), (c_, k_) -> {grow})"
    return f"(aggregate(slice({counts}, 1, CAST(floor({w}) AS INT) + 1), 0D, (a_, u_) -> a_ + u_) / pow(2D, {m}))"
