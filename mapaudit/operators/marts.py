"""Summaries and review queues over the audit fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapaudit.functions.labels import action_priority, count_if, priority_order, rate_pct, recorded_at


def _is(status: str):
    return F.col("audit_status") == status


def audit_summary(fct: DataFrame) -> DataFrame:
    """Per (date, class, status): counts, confidence, distances, verification rate."""
    return (
        fct.groupBy(F.to_date(recorded_at(F.col("recording_timestamp"))).alias("audit_date"),
                    "detected_class", "audit_status")
        .agg(
            F.count(F.lit(1)).alias("detection_count"),
            F.avg("confidence").alias("avg_confidence"),
            F.avg("distance_meters").alias("avg_distance_meters"),
            F.min("distance_meters").alias("min_distance_meters"),
            F.max("distance_meters").alias("max_distance_meters"),
            F.round(rate_pct(count_if(_is("VERIFIED")), F.count(F.lit(1))), 2).alias("verification_rate_pct"),
        )
        .orderBy(F.desc_nulls_first("audit_date"), "detected_class", "audit_status")
    )


def summary_metrics(fct: DataFrame) -> DataFrame:
    total, verified = F.count(F.lit(1)), count_if(_is("VERIFIED"))
    return fct.agg(
        total.alias("total_detections"), verified.alias("verified_count"),
        count_if(_is("NEW_DISCOVERY")).alias("new_discovery_count"),
        count_if(_is("CLASS_MISMATCH")).alias("class_mismatch_count"),
        rate_pct(verified, total).alias("avg_verification_rate"),
    )


def class_breakdown(fct: DataFrame) -> DataFrame:
    return fct.groupBy(F.col("detected_class").alias("class_name"),
                       F.col("audit_status").alias("verification_status")).agg(F.count(F.lit(1)).alias("count"))


def verification_trend(fct: DataFrame, n: int = 30) -> DataFrame:
    """The n latest dates that have data."""
    return (
        fct.groupBy(F.to_date(recorded_at(F.col("recording_timestamp"))).alias("detection_date"))
        .agg(F.count(F.lit(1)).alias("total_detections"),
             rate_pct(count_if(_is("VERIFIED")), F.count(F.lit(1))).alias("verification_rate"))
        .where(F.col("detection_date").isNotNull())
        .orderBy(F.desc("detection_date")).limit(n)
    )


def _review_rows(fct: DataFrame) -> DataFrame:
    return (
        fct.where(F.col("audit_status").isin("CLASS_MISMATCH", "NEW_DISCOVERY"))
        .select(
            "video_name", "frame_number", "recording_timestamp", "detected_class", "confidence", "detected_lat",
            "detected_lon", "osm_class", "osm_lat", "osm_lon", "distance_meters", "audit_status",
            action_priority(F.col("audit_status"), F.col("distance_meters"), F.col("confidence"))
            .alias("action_priority"),
            "detection_id", "nearest_osm_node_id",
        )
    )


def _review_order():
    # the trailing ids make the order total and keep the range partitions even
    return [priority_order(F.col("action_priority")), F.desc_nulls_first("confidence"),
            F.asc_nulls_last("distance_meters"), "video_name", "frame_number", "detection_id", "nearest_osm_node_id"]


def discrepancy_details(fct: DataFrame) -> DataFrame:
    """Mismatches and discoveries with their review priority, most urgent first."""
    return _review_rows(fct).orderBy(*_review_order()).drop("detection_id", "nearest_osm_node_id")


def high_priority(fct: DataFrame, n: int = 10) -> DataFrame:
    rows = _review_rows(fct).where(F.col("action_priority") == "HIGH")
    return rows.orderBy(*_review_order()).limit(n)


def map_points(fct: DataFrame, south=43.5, north=44.0, west=-79.6, east=-79.0, n: int = 50_000) -> DataFrame:
    """Points of a map window. Taken in id order so that the limit is repeatable."""
    inside = F.col("detected_lat").between(south, north) & F.col("detected_lon").between(west, east)
    return (
        fct.where(inside)
        .select(F.col("detected_lat").alias("lat"), F.col("detected_lon").alias("lon"),
                F.col("detected_class").alias("class_name"), F.col("audit_status").alias("verification_status"),
                "confidence", "detection_id", "nearest_osm_node_id")
        .orderBy("detection_id", "nearest_osm_node_id").limit(n)
        .drop("nearest_osm_node_id")
    )
