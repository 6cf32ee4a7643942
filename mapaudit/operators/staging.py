"""Typed staging views over the raw detections and the reference nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapaudit.functions.geo import wkt_point
from mapaudit.functions.labels import normalized_type, quality_flag


def field(name: str, kind: str) -> Column:
    """One typed field of the message; null when absent or not castable."""
    return F.try_variant_get("record_content", f"$.{name}", kind)


def flatten_detections(raw: DataFrame) -> DataFrame:
    """``timestamp_ms`` holds seconds: the name is part of the published schema."""
    return raw.where(F.col("record_content").isNotNull()).select(
        field("detection_id", "string").alias("detection_id"),
        field("video_name", "string").alias("video_name"),
        field("frame_number", "int").alias("frame_number"),
        field("timestamp_sec", "double").alias("timestamp_ms"),
        field("class_name", "string").alias("object_class"),
        field("confidence", "double").alias("confidence"),
        field("vehicle_lat", "double").alias("latitude"),
        field("vehicle_lon", "double").alias("longitude"),
        field("vehicle_id", "string").alias("vehicle_id"),
        field("recording_timestamp", "string").alias("recording_timestamp"),
        F.col("ingested_at"),
    )


def from_typed(det: DataFrame) -> DataFrame:
    """The flattened columns taken from detections that are already typed."""
    return det.select(
        "detection_id", "video_name", "frame_number", F.col("timestamp_sec").alias("timestamp_ms"),
        F.col("class_name").alias("object_class"), "confidence",
        F.col("vehicle_lat").alias("latitude"), F.col("vehicle_lon").alias("longitude"),
        "vehicle_id", "recording_timestamp", "ingested_at",
    )


def stage_detections(flat: DataFrame) -> DataFrame:
    """Adds the point and the quality flag; keeps rows with coordinates in range."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return (
        flat.withColumn("data_quality_flag", quality_flag(lat, lon, F.col("confidence"), F.col("object_class")))
        .where(lat.between(-90, 90) & lon.between(-180, 180))
        .withColumn("detection_location", wkt_point("longitude", "latitude"))
    )


def stage_nodes(nodes: DataFrame) -> DataFrame:
    """Typed nodes with the class name used for matching. ``tags`` is optional."""
    def tag(key: str) -> Column:
        return F.try_element_at("tags", F.lit(key)) if "tags" in nodes.columns else F.lit(None).cast("string")

    return nodes.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        "osm_id",
        F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"),
        normalized_type(F.col("osm_type")).alias("normalized_type"),
        F.col("osm_type").alias("original_osm_type"),
        wkt_point(F.col("longitude").cast("double"), F.col("latitude").cast("double")).alias("osm_location"),
        tag("name").alias("location_name"), tag("crossing").alias("crossing_type"),
    )


def detections_flat(raw: DataFrame, number_mode: str = "double") -> DataFrame:
    """Flat view with ids, pixels, point and topic metadata.

    ``number_mode="integer"`` rounds every number to a whole one, as a cast to a
    scale-free decimal does; the default keeps the fractions.
    """
    def number(name: str) -> Column:
        value = field(name, "double")
        return value.cast("decimal(38,0)") if number_mode == "integer" else value

    lat, lon = number("vehicle_lat"), number("vehicle_lon")
    return raw.where(F.col("record_content").isNotNull()).select(
        field("detection_id", "string").alias("detection_id"),
        field("vehicle_id", "string").alias("vehicle_id"),
        field("session_id", "string").alias("session_id"),
        F.expr("try_cast(try_variant_get(record_content, '$.ingested_at', 'string') as timestamp)")
        .cast("timestamp_ntz").alias("detection_timestamp"),
        number("frame_number").cast("int").alias("frame_number"),
        number("timestamp_sec").alias("timestamp_sec"),
        number("pixel_u").alias("pixel_u"), number("pixel_v").alias("pixel_v"),
        number("confidence").alias("confidence"),
        field("class_name", "string").alias("class_name"),
        wkt_point(lon, lat).alias("vehicle_location"),
        lat.alias("vehicle_lat"), lon.alias("vehicle_lon"),
        number("heading").alias("heading"),
        "kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp", "ingested_at",
    )


def gps_sample(raw: DataFrame, n: int) -> DataFrame:
    """First ``n`` located detections by id: a stable sample."""
    return (
        raw.select(
            field("detection_id", "string").alias("detection_id"), field("class_name", "string").alias("class_name"),
            field("vehicle_lat", "double").alias("vehicle_lat"), field("vehicle_lon", "double").alias("vehicle_lon"),
            field("recording_timestamp", "string").alias("recording_timestamp"),
            field("confidence", "double").alias("confidence"), "ingested_at",
        )
        .where(F.col("vehicle_lat").isNotNull() & F.col("vehicle_lon").isNotNull())
        .orderBy("detection_id").limit(n)
    )
