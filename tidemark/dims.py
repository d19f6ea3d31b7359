"""Label taxonomies, profile shapes, thresholds.

Everything here must equal the published benchmark definition for results to
agree, so the values are stated plainly and in their natural order.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: domains and cadence bands ---------------------------------
DOMAINS = ("nature", "econ_fin", "transport", "energy", "sales", "healthcare", "web_cloudops")
CADENCE_BANDS = (
    "sub-min", "few-min", "half-hour", "hourly", "daily",
    "weekly", "monthly", "quarterly", "yearly", "irregular",
)
HIGH_VALUE_BANDS = ("sub-min", "few-min", "half-hour", "irregular")
TARGET_PER_CELL = 2
TARGET_PER_HIGH_VALUE_CELL = 3

# --- fixed values: frequency label -> cadence band ---------------------------
FREQ_BAND = {
    "PT30S": "sub-min", "PT1M": "sub-min", "PT2M30S": "sub-min",
    "PT5M": "few-min", "PT6M": "few-min", "PT10M": "few-min", "PT15M": "few-min",
    "PT30M": "half-hour", "PT1H": "hourly", "PT8H": "hourly",
    "P1D": "daily", "P1W": "weekly", "P1M": "monthly", "P1Q": "quarterly", "P1Y": "yearly",
}
# upper bound in seconds -> band, for frequencies the table does not name
BAND_LADDER = (
    (59, "sub-min"), (900, "few-min"), (1800, "half-hour"), (10800, "hourly"),
    (3 * 86400, "daily"), (14 * 86400, "weekly"), (45 * 86400, "monthly"),
    (200 * 86400, "quarterly"),
)

# --- fixed values: (context, horizon) per band; season length per frequency ---
PROFILES = {
    "sub-min": (512, 48), "few-min": (512, 48), "half-hour": (512, 48), "hourly": (512, 24),
    "daily": (256, 14), "weekly": (128, 8), "monthly": (128, 12),
    "quarterly": (64, 8), "yearly": (64, 8),
}
DEFAULT_PROFILE = (256, 48)
FREQ_SEASON = {
    "PT30S": 120, "PT1M": 1440, "PT2M30S": 576, "PT5M": 288, "PT6M": 240, "PT10M": 144,
    "PT15M": 96, "PT30M": 48, "PT1H": 24, "PT8H": 3,
    "P1D": 1, "P1W": 1, "P1M": 12, "P1Q": 4, "P1Y": 1,
}
SEASONAL_PERIODS = (12, 24, 36)
K_DRAWS = 5
MIN_MOTIF_LENGTH = 128
UNSEEN_WEIGHT_FLOOR = 0.25

# --- fixed values: scoring grids and epsilons ---------------------------------
DECILES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
CRPS_LEVELS = tuple(round(0.05 * i, 2) for i in range(1, 20))
WIS_PAIRS = ((0.1, 0.9), (0.2, 0.8), (0.3, 0.7), (0.4, 0.6))
EPS = 1e-8
EPS_REL = 1e-12
GMEAN_SHIFT = 1e-5
PERIOD_THRESHOLD = 0.2
DUP_COSINE = 0.985

# --- fixed values: contamination denylist -------------------------------------
DENYLIST = (
    "ett", "etth1", "etth2", "ettm1", "ettm2",
    "electricity", "ecl", "electricityloaddiagrams",
    "traffic", "pems", "weather", "exchange", "exchange_rate",
    "ili", "illness", "m1", "m2", "m3", "m4", "m5", "monash",
    "wikipedia web traffic", "web-traffic-time-series", "wikipedia pageviews dataset",
    "tourism", "solar-energy", "solar_al", "solar 10-minute",
    "london smart meters", "smart meters in london",
    "gluonts", "darts dataset", "sktime dataset", "lotsa",
)
DENYLIST_ALLOW = (
    "metar", "open-meteo", "open_meteo", "noaa", "nws", "ndbc", "metoffice",
    "aemet", "dwd", "jma", "ecmwf", "meteostat", "synop",
)
DENYLIST_SOFT = ("weather", "solar-energy")
MODEL_CUTOFFS = {
    "chronos": "2024-01-01", "timesfm": "2024-02-01", "moirai": "2024-03-01",
    "timegpt": "2023-12-01", "lag-llama": "2023-06-01",
}

# --- fixed values: candidate schema -------------------------------------------
CANDIDATE_FIELDS = (
    "name", "domain", "frequency", "access_method", "url_or_endpoint", "license",
    "estimated_series_count", "estimated_length", "first_available_date",
    "supports_live_future_tasks", "contamination_risk", "contamination_reasoning",
    "gap_filled", "difficulty_note", "adapter_notes", "confidence", "verify",
)
ACCESS_METHODS = ("open_api", "bulk_download", "live_stream", "licensed", "scrape")
RISK_LEVELS = ("low", "medium", "high")
CONFIDENCE_LEVELS = ("high", "medium", "low")
NOVELTY_RISK = {"clean": "low", "partial": "medium", "contaminated": "high", "unknown": "medium"}

# --- fixed values: duration units, calendar fixed at 365 / 30 days ------------
DURATION_UNITS = {"Y": 31536000, "M": 2592000, "W": 604800, "D": 86400, "H": 3600, "m": 60, "S": 1}


def lookup(key: Column, table: dict, default=None) -> Column:
    """A small fixed table as one literal map; missing keys give ``default``."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    got = F.try_element_at(F.create_map(*pairs), key)
    return got if default is None else F.coalesce(got, F.lit(default))


def sql_case(expr: str, table: dict, default: str = "NULL") -> str:
    """The same fixed table as a SQL CASE, for the DuckDB twins."""

    def lit(v) -> str:
        return f"'{v}'" if isinstance(v, str) else str(v)

    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"(CASE {expr} {arms} ELSE {default} END)"
