"""Scalar Column expressions (all JVM-side, inside whole-stage codegen).

Each function takes and returns ``Column`` objects so it can be used inside
any projection, filter or aggregate.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal_map(mapping: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


# ------------------------------------------------------------------ geo / math

def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km."""
    la1, lo1, la2, lo2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((la2 - la1) / 2), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def erf(x) -> Column:
    """Abramowitz–Stegun 7.1.26 approximation of erf (|error| ≤ 1.5e-7);
    Spark has no erf function."""
    x = _c(x)
    t = 1.0 / (1.0 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    y = 1.0 - poly * F.exp(-x * x)
    return F.signum(x) * y


def normal_cdf(z) -> Column:
    return 0.5 * (1.0 + erf(_c(z) / F.sqrt(F.lit(2.0))))


def safe_div(num, den, default=None) -> Column:
    d = F.lit(default) if default is not None else F.lit(None).cast("double")
    return F.when(_c(den) == 0, d).otherwise(_c(num) / _c(den))


# ------------------------------------------------------------------ rules

def risk_level(prob) -> Column:
    p = _c(prob)
    return F.when(p > 0.7, "High").when(p > 0.3, "Medium").otherwise("Low")


def sentiment_label(compound) -> Column:
    c = _c(compound)
    return F.when(c >= 0.05, "positive").when(c <= -0.05, "negative").otherwise("neutral")


def sentiment_confidence(compound) -> Column:
    a = F.abs(_c(compound))
    return (F.when(a > 0.75, 0.9 + (a - 0.75) * 0.4)
             .when(a > 0.5, 0.7 + (a - 0.5) * 0.8)
             .when(a > 0.25, 0.5 + (a - 0.25) * 0.8)
             .otherwise(0.3 + a * 0.8))


def rfm_score(r, f, m) -> Column:
    return _c(r) * 100 + _c(f) * 10 + _c(m)


def ordinal_encode(col, categories) -> Column:
    """Position of the value in ``categories`` (0-based), −1 when unknown."""
    cats = F.array(*[F.lit(c) for c in categories])
    return (F.array_position(cats, _c(col)) - 1).cast("int")


def clean_bool(col) -> Column:
    s = F.lower(F.trim(_c(col).cast("string")))
    return F.when(s.isin("true", "1", "1.0", "yes"), F.lit(True)) \
            .when(s.isin("false", "0", "0.0", "no"), F.lit(False))


def clean_numeric(col, default=0.0) -> Column:
    """to_numeric(errors='coerce').fillna(default)."""
    return F.coalesce(F.expr(f"try_cast({col} AS DOUBLE)") if isinstance(col, str)
                      else _c(col).try_cast("double"), F.lit(default))


def clean_numeric_alpha(col) -> Column:
    """Null any value that contains a letter, coerce, fill 0, round half to
    even to a whole number."""
    s = _c(col).cast("string")
    v = F.when(s.rlike("[a-zA-Z]"), F.lit(None)).otherwise(s).try_cast("double")
    return F.bround(F.coalesce(v, F.lit(0.0)), 0).cast("long")


# ------------------------------------------------------------------ dates

def date_features(date_col) -> dict[str, Column]:
    """day_of_week (Mon=0), month, day, year, quarter, is_weekend,
    is_month_start, is_month_end."""
    d = F.to_date(_c(date_col))
    return {
        "day_of_week": F.weekday(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "year": F.year(d),
        "quarter": F.quarter(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "is_month_end": (d == F.last_day(d)).cast("int"),
    }


def season_weather(date_col) -> Column:
    """Month → weather code: Dec–Feb 4, Mar–May 2, Jun–Aug 1, else 3."""
    m = F.month(_c(date_col))
    return F.when(m.isin(12, 1, 2), 4).when(m.isin(3, 4, 5), 2).when(m.isin(6, 7, 8), 1).otherwise(3)


# US holidays used by the demand forecast (2023–2025).
US_HOLIDAYS = [
    "2023-01-01", "2023-01-16", "2023-02-20", "2023-05-29",
    "2023-06-19", "2023-07-04", "2023-09-04", "2023-10-09",
    "2023-11-11", "2023-11-23", "2023-12-25",
    "2024-01-01", "2024-01-15", "2024-02-19", "2024-05-27",
    "2024-06-19", "2024-07-04", "2024-09-02", "2024-10-14",
    "2024-11-11", "2024-11-28", "2024-12-25",
    "2025-01-01", "2025-01-20", "2025-02-17", "2025-05-26",
    "2025-06-19", "2025-07-04", "2025-09-01", "2025-10-13",
    "2025-11-11", "2025-11-27", "2025-12-25",
]


def is_holiday(date_col, holidays=US_HOLIDAYS) -> Column:
    d = F.to_date(_c(date_col))
    return (F.weekday(d) >= 5) | F.date_format(d, "yyyy-MM-dd").isin(*holidays)


def whole_days_between(later, earlier) -> Column:
    """floor((later − earlier) / 1 day) on timestamps (timedelta.days)."""
    secs = F.unix_timestamp(_c(later).cast("timestamp")) - F.unix_timestamp(_c(earlier).cast("timestamp"))
    return F.floor(secs / 86400).cast("long")


# ------------------------------------------------------------------ supply

# Delay multipliers (unknown → 1.0).
WEATHER_FACTORS = {"normal": 1.0, "rain": 1.3, "snow": 1.8, "storm": 2.5, "fog": 1.4}
TRAFFIC_FACTORS = {"light": 0.9, "normal": 1.0, "heavy": 1.5, "congested": 2.0}
VEHICLE_FACTORS = {"truck": 1.2, "van": 1.0, "motorcycle": 0.8, "drone": 0.6}


def factor(mapping: dict, key) -> Column:
    return F.coalesce(literal_map(mapping)[F.lower(_c(key))], F.lit(1.0))
