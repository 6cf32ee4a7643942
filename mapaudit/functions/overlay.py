"""Positions and times read from the text a camera prints into the picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text patterns, in order of preference.
LAT_HEMISPHERE = r"(?i)([NS])\s*(\d+\.?\s*\d+)"
LON_HEMISPHERE = r"(?i)([EW])\s*(\d+\.?\s*\d+)"
LAT_LABEL = r"(?i)lat[:\s]+(-?\d+\.?\d*)"
LON_LABEL = r"(?i)lon[:\s]+(-?\d+\.?\d*)"
SPEED = r"(?i)(\d+)\s*KM/H"
HEADING = r"(?i)h(?:ea)?d(?:ing)?[:\s]+(\d+\.?\d*)"
TIME_PATTERNS = (
    r"(\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2})",
    r"(\d{4}[-/]\d{2}[-/]\d{2}\s+\d{2}:\d{2}:\d{2})",
    r"(\d{2}/\d{2}/\d{4})",
    r"(\d{4}[-/]\d{2}[-/]\d{2})",
)
# The test position of a frame without a readable one.
FALLBACK_LAT, FALLBACK_LON = 43.79, -79.314


def _group(text: Column, pattern: str, n: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def _number(text: Column) -> Column:
    return F.regexp_replace(text, "[ \n]", "").try_cast("double")


def _coordinate(text: Column, hemisphere: str, label: str, negative: str) -> Column:
    size = _number(_group(text, hemisphere, 2))
    side = F.upper(_group(text, hemisphere, 1))
    return F.coalesce(F.when(side == negative, -F.abs(size)).otherwise(size), _number(_group(text, label)))


def parse_overlay(df: DataFrame, gps_col: str = "gps_text", ts_col: str = "ts_text",
                  fallback: bool = True, frame_col: str = "frame_number") -> DataFrame:
    """Adds ``lat, lon, speed_or_heading, recording_timestamp``. With ``fallback`` a
    frame without a readable position gets the slowly drifting test position and
    a blank time, and ``is_fallback`` tells it apart."""
    gps, ts = F.col(gps_col), F.col(ts_col)
    out = (
        df.withColumn("lat", _coordinate(gps, LAT_HEMISPHERE, LAT_LABEL, "S"))
        .withColumn("lon", _coordinate(gps, LON_HEMISPHERE, LON_LABEL, "W"))
        .withColumn("speed_or_heading", F.coalesce(_number(_group(gps, SPEED)), _number(_group(gps, HEADING))))
        .withColumn("recording_timestamp", F.coalesce(*[_group(ts, p) for p in TIME_PATTERNS]))
    )
    if not fallback:
        return out
    lost = F.col("lat").isNull() | F.col("lon").isNull()
    drift = F.col(frame_col) / 10000 * 0.0001
    return (
        out.withColumn("is_fallback", lost)
        .withColumn("lat", F.when(F.col("is_fallback"), F.lit(FALLBACK_LAT) + drift).otherwise(F.col("lat")))
        .withColumn("lon", F.when(F.col("is_fallback"), F.lit(FALLBACK_LON) + drift).otherwise(F.col("lon")))
        .withColumn("recording_timestamp",
                    F.when(F.col("is_fallback"), "").otherwise(F.coalesce("recording_timestamp", F.lit(""))))
    )


def best_text(df: DataFrame, keys=("frame_number",), text: str = "gps_text", variant: str = "variant") -> DataFrame:
    """Of several readings of a frame the one with most digits, the first on ties."""
    digits = F.regexp_count(F.col(text), F.lit("[0-9]"))
    return df.groupBy(*keys).agg(F.max_by(F.col(text), F.struct(digits, -F.col(variant))).alias(text))
