"""Row-wise functions as native Spark columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- time


def parse_day_first(date: ColumnLike, time: ColumnLike) -> Column:
    """``dd/MM/yyyy`` + ``HH.mm.ss`` (or ``HH:mm:ss``) to TIMESTAMP_NTZ; anything else is missing.

    The text is rearranged to ISO order and cast, so the session time zone plays no part.
    """
    text = F.concat(_col(date), F.lit(" "), F.replace(_col(time), F.lit("."), F.lit(":")))
    iso = F.regexp_replace(text, r"^(\d{1,2})/(\d{1,2})/(\d{4}) ", "$3-$2-$1 ")
    return iso.try_cast("timestamp_ntz")


def hour_of(ts: ColumnLike) -> Column:
    return F.hour(_col(ts))


def weekday_of(ts: ColumnLike) -> Column:
    """Monday 0 to Sunday 6."""
    return F.weekday(_col(ts))


def month_of(ts: ColumnLike) -> Column:
    return F.month(_col(ts))


def is_weekend(ts: ColumnLike) -> Column:
    return (F.weekday(_col(ts)) >= 5).cast("int")


def season_of(ts: ColumnLike) -> Column:
    """0 for December to February, then 1, 2, 3."""
    return F.floor((F.month(_col(ts)) % 12) / 3).cast("int")


def lookup(key: ColumnLike, mapping: Mapping) -> Column:
    """Value of a small fixed mapping, missing for unknown keys."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), _col(key))


def cyclical(value: ColumnLike, period: float) -> tuple[Column, Column]:
    """Sine and cosine of the position within a period."""
    angle = _col(value) * (2 * math.pi) / period
    return F.sin(angle), F.cos(angle)


def epoch_seconds(ts: ColumnLike) -> Column:
    """Seconds since 1970-01-01 of a zone-free timestamp."""
    t = _col(ts)
    day = F.unix_date(F.to_date(t)).cast("long") * 86_400
    return day + F.hour(t) * 3_600 + F.minute(t) * 60 + F.second(t)


def time_bucket(ts: ColumnLike, minutes: int) -> Column:
    """Index of the refresh bucket that holds ``ts``; the width is at least one minute."""
    return F.floor(epoch_seconds(ts) / (max(1, int(minutes)) * 60))


def to_date(ts: ColumnLike) -> Column:
    return F.to_date(_col(ts))


# ---------------------------------------------------------------- numbers


def coerce_number(c: ColumnLike) -> Column:
    """Text to DOUBLE with ``,`` or ``.`` as decimal sign; unparseable and NaN are missing."""
    number = F.replace(F.trim(_col(c)), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(number), number)


def null_if(c: ColumnLike, sentinel: float) -> Column:
    return F.nullif(_col(c), F.lit(sentinel))


def exceeds(c: ColumnLike, threshold: float) -> Column:
    """1 when strictly above the threshold, else 0; a missing value is not above it."""
    return F.coalesce((_col(c) > threshold).cast("int"), F.lit(0))


def classify_at(score: ColumnLike, threshold: ColumnLike | float) -> Column:
    """1 when the score reaches the threshold (inclusive)."""
    return (_col(score) >= threshold).cast("int")


def bucketize(c: ColumnLike, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed intervals, lowest edge included, missing outside."""
    v = _col(c)
    out = F.when((v >= edges[0]) & (v <= edges[1]), F.lit(labels[0]))
    for low, high, label in zip(edges[1:], edges[2:], labels[1:]):
        out = out.when((v > low) & (v <= high), F.lit(label))
    return out


def bucket_ordinal(c: ColumnLike, labels: Sequence[str]) -> Column:
    """Position of an ordered category (0 first)."""
    return lookup(c, {label: i for i, label in enumerate(labels)})


def standardize(values: Sequence[str], fitted: Column) -> dict[str, Column]:
    """``(x - mean) / population std`` per column; a constant column is divided by 1.

    ``fitted`` is the struct column made by ``operators.scaling.scaler_stats``.
    """
    out = {}
    for v in values:
        std = fitted[f"std_{v}"]
        out[v] = (F.col(v) - fitted[f"mean_{v}"]) / F.when(std > 0, std).otherwise(F.lit(1.0))
    return out


def correlation(a: ColumnLike, b: ColumnLike) -> Column:
    """Pearson aggregate over pairs with both values; missing (no error) for a constant."""
    return F.try_divide(F.regr_sxy(a, b), F.sqrt(F.regr_sxx(a, b)) * F.sqrt(F.regr_syy(a, b)))


def linspace(df: DataFrame, start: str, stop: str, n: int, name: str = "x") -> DataFrame:
    """One row per grid point between two columns; the last point equals ``stop`` exactly."""
    i = F.col("i")
    step = (F.col(stop) - F.col(start)) / (n - 1)
    point = F.when(i == n - 1, F.col(stop)).otherwise(F.col(start) + i * step)
    grid = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.withColumn(name, point)


def threshold_grid(n: int = 100, start: float = 0.01, stop: float = 0.99) -> list[float]:
    """Evenly spaced decision thresholds."""
    step = (stop - start) / (n - 1)
    return [start + i * step for i in range(n - 1)] + [stop]


# ---------------------------------------------------------------- text


def format_metric(c: ColumnLike) -> Column:
    """Three decimals; a missing value becomes an em dash."""
    v = _col(c).cast("double")
    text = F.call_function("format_number", v, F.lit("0.000"))
    return F.when(v.isNull(), F.lit("—")).when(F.isnan(v), F.lit("nan")).otherwise(text)


def title_case(c: ColumnLike) -> Column:
    """Underscores to spaces, then every run of letters capitalised."""
    runs = F.regexp_extract_all(F.replace(_col(c), F.lit("_"), F.lit(" ")), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 2**31 - 1)))),
        "",
    )


def place_label(
    name: ColumnLike, admin1: ColumnLike, country: ColumnLike, lat: ColumnLike, lon: ColumnLike
) -> Column:
    """Non-empty place parts joined by a comma, then the coordinates if both are numbers."""
    first = F.coalesce(F.nullif(_col(name), F.lit("")), F.lit("Unknown"))
    parts = F.filter(F.array(first, _col(admin1), _col(country)), lambda p: p.isNotNull() & (p != ""))
    lat4, lon4 = (F.call_function("format_number", _col(c).try_cast("double"), F.lit("0.0000")) for c in (lat, lon))
    suffix = F.coalesce(F.concat(F.lit(" — ("), lat4, F.lit(", "), lon4, F.lit(")")), F.lit(""))
    return F.concat(F.array_join(parts, ", "), suffix)
