"""Weather payloads: JSON documents with parallel arrays, to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Payload section names, shown variables and the default rejection text.
CURRENT_LABELS = {
    "temperature_2m": "Temperature",
    "relative_humidity_2m": "Humidity",
    "wind_speed_10m": "Wind Speed",
}
DEFAULT_REASON = "Open-Meteo error"
FALSY = ("false", "0", "0.0", "", "null", "[]", "{}")


def _series(df: DataFrame, payload_col: str, section: str, variables: Sequence[str], keep: Sequence[str]) -> DataFrame:
    fields = ", ".join(["time: array<string>", *[f"`{v}`: array<double>" for v in variables]])
    parsed = df.select(*keep, F.from_json(payload_col, f"{section} struct<{fields}>")[section].alias("p"))
    time = F.col("p.time")
    arrays = [time.alias("time")]
    for v in variables:
        # arrays_zip of a missing array is missing as a whole, so pad with nulls
        arrays.append(F.coalesce(F.col(f"p.`{v}`"), F.array_repeat(F.lit(None).cast("double"), F.size(time))).alias(v))
    # arrays_zip names fields after plain columns only, hence the projection first
    parsed = parsed.filter(F.size(time) > 0).select(*keep, *arrays)
    return parsed.select(*keep, F.inline(F.arrays_zip("time", *[F.col(f"`{v}`") for v in variables])))


def hourly_payload_to_rows(
    df: DataFrame, payload_col: str, variables: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per ``hourly.time`` entry with a column per variable; no times, no rows."""
    rows = _series(df, payload_col, "hourly", variables, keep)
    return rows.withColumn("time", F.col("time").try_cast("timestamp_ntz"))


def daily_payload_to_rows(
    df: DataFrame, payload_col: str, variables: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """The same for ``daily``, keyed by date."""
    rows = _series(df, payload_col, "daily", variables, keep)
    return rows.withColumn("time", F.to_date(F.col("time").try_cast("timestamp_ntz"))).withColumnRenamed("time", "date")


def current_conditions(df: DataFrame, payload_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(variable, reading)`` per present current value, as text with its unit."""
    fields = ", ".join(f"{v}: string" for v in [*CURRENT_LABELS, "time"])
    p = F.from_json(payload_col, f"current struct<{fields}>, current_units struct<{fields}>")
    parsed = df.select(*keep, p.alias("p"))
    cells = []
    for v, label in CURRENT_LABELS.items():
        value, unit = F.col(f"p.current.{v}"), F.col(f"p.current_units.{v}")
        cells.append(F.struct(F.lit(label).alias("variable"), value.alias("value"), unit.alias("unit")))
    cells.append(
        F.struct(F.lit("Time").alias("variable"), F.col("p.current.time").alias("value"), F.lit("").alias("unit"))
    )
    rows = parsed.select(*keep, F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
    return rows.select(*keep, "variable", F.trim(F.concat_ws(" ", "value", "unit")).alias("reading"))


def geocode_matches(df: DataFrame, payload_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Search results that carry both coordinates."""
    schema = (
        "results array<struct<name: string, admin1: string, country: string, latitude: double, longitude: double>>"
    )
    rows = df.select(*keep, F.inline(F.from_json(payload_col, schema)["results"]))
    return rows.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def payload_error(payload: Column | str) -> Column:
    """The rejection reason of a payload, missing for a good one."""
    p = F.from_json(payload, "error string, reason string")
    bad = p["error"].isNotNull() & ~p["error"].isin(*FALSY)
    return F.when(bad, F.coalesce(p["reason"], F.lit(DEFAULT_REASON)))


def split_payloads(df: DataFrame, payload_col: str) -> tuple[DataFrame, DataFrame]:
    """Good payloads, and rejected ones with their ``reason``."""
    marked = df.withColumn("reason", payload_error(payload_col))
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def to_series(df: DataFrame, variable: str, name: str = "value") -> DataFrame:
    """One variable under the common name, rows without it kept."""
    return df.withColumnRenamed(variable, name)


def to_long(df: DataFrame, ids: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """``(ids, variable, value)`` rows of several variables."""
    return df.unpivot(list(ids), list(variables), "variable", "value")
