"""Classification columns: data quality, node type, audit status, review priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapaudit.config import MIN_CONFIDENCE, RECORDING_FORMAT


def quality_flag(lat: Column, lon: Column, confidence: Column, cls: Column) -> Column:
    return (
        F.when(lat.isNull() | lon.isNull(), "missing_coordinates")
        .when((lat < -90) | (lat > 90), "invalid_latitude")
        .when((lon < -180) | (lon > 180), "invalid_longitude")
        .when(confidence < MIN_CONFIDENCE, "low_confidence")
        .when(cls.isNull(), "missing_class")
        .otherwise("valid")
    )


def normalized_type(osm_type: Column) -> Column:
    kind = F.lower(osm_type)
    return (
        F.when(kind == "traffic_signals", "traffic light")
        .when(kind == "stop", "stop sign")
        .when(kind.like("%crossing%"), "pedestrian crossing")
        .otherwise(kind)
    )


def audit_status(distance: Column, detected: Column, mapped: Column, threshold_m: float) -> Column:
    close = distance <= threshold_m
    return (
        F.when(distance.isNull(), "NEW_DISCOVERY")
        .when(close & (F.lower(detected) == F.lower(mapped)), "VERIFIED")
        .when(close & (F.lower(detected) != F.lower(mapped)), "CLASS_MISMATCH")
        .when(distance > threshold_m, "NEW_DISCOVERY")
        .otherwise("UNKNOWN")
    )


def action_priority(status: Column, distance: Column, confidence: Column) -> Column:
    mismatch = status == "CLASS_MISMATCH"
    return (
        F.when(mismatch & (distance <= 5), "HIGH")
        .when((status == "NEW_DISCOVERY") & (confidence >= 0.8), "MEDIUM")
        .when(mismatch & (distance > 5), "LOW")
        .otherwise("INFO")
    )


def priority_order(priority: Column) -> Column:
    return F.when(priority == "HIGH", 1).when(priority == "MEDIUM", 2).when(priority == "LOW", 3).otherwise(4)


def recorded_at(text: Column) -> Column:
    """Timestamp of a ``DD/MM/YYYY HH:MM:SS`` string; null when it does not parse."""
    return F.try_to_timestamp(text, F.lit(RECORDING_FORMAT))


def rate_pct(part: Column, whole: Column) -> Column:
    """part / whole in percent as double, null for an empty whole."""
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0)).cast("double")


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")
