"""From boxes in video frames to detections, and from pixels to positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapaudit.config import DEFAULT, MIN_CONFIDENCE, TARGET_CLASSES, AuditConfig
from mapaudit.functions.geo import destination, pixel_distance
from mapaudit.operators.skew import lookup_join


def extract_detections(boxes: DataFrame, fps: int = 30, sample_fps: int = 1, conf: float = MIN_CONFIDENCE,
                       classes=TARGET_CLASSES, width: int = 2560, height: int = 1440) -> DataFrame:
    """Sampled, confident boxes of the target classes with their ground pixel
    (bottom centre) and the clamped square window around the box centre."""
    interval = max(1, fps // sample_fps)
    x1, y1, x2, y2 = map(F.col, ("x1", "y1", "x2", "y2"))
    centre_x, centre_y = F.floor((x1 + x2) / 2), F.floor((y1 + y2) / 2)
    half = F.floor(F.greatest(x2 - x1, y2 - y1) / 2)
    kept = boxes.where(
        (F.col("frame_number") % interval == 0) & (F.col("confidence") >= conf) & F.col("class_name").isin(*classes))
    return kept.select(
        "video_name", "frame_number", (F.col("frame_number") / fps).alias("timestamp_sec"),
        ((x1 + x2) / 2).alias("u"), y2.cast("double").alias("v"), "confidence", "class_name",
        F.greatest(F.lit(0), centre_x - half).cast("int").alias("roi_x1"),
        F.greatest(F.lit(0), centre_y - half).cast("int").alias("roi_y1"),
        F.least(F.lit(width), centre_x + half).cast("int").alias("roi_x2"),
        F.least(F.lit(height), centre_y + half).cast("int").alias("roi_y2"),
        *[c for c in boxes.columns if c not in
          ("video_name", "frame_number", "x1", "y1", "x2", "y2", "confidence", "class_name")],
    )


def track_lookup(det: DataFrame, track: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Detections with the vehicle pose of their frame; frames without a pose drop out."""
    return lookup_join(det, track, ["video_name", "frame_number"], "inner", cfg)


def project_detections(det: DataFrame, track: DataFrame, image_height: int = 1440, camera_height: float = 1.4,
                       fov_deg: float = 92.0, horizon: float | None = None, fixed_m: float = 30.0,
                       cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Object position of each detection from its pixel row and the vehicle pose.

    Rows at or above the horizon have no ground distance and drop out, unless
    every detection is above it: then all use ``fixed_m``.
    """
    level = image_height / 2 if horizon is None else horizon
    all_above = det.agg(F.coalesce(F.max("v") <= level, F.lit(True)).alias("x")).scalar()
    ground = pixel_distance("v", image_height, camera_height, fov_deg, horizon)
    posed = track_lookup(det, track, cfg).withColumn(
        "distance", F.when(all_above, F.lit(fixed_m)).otherwise(ground))
    lat, lon = destination("lat", "lon", "heading", "distance")
    return (
        posed.where(F.col("distance") < float("inf"))
        .withColumn("object_lat", lat).withColumn("object_lon", lon)
    )


def pixel_profile(det: DataFrame, horizon: float = 720.0) -> DataFrame:
    """Row range, counts around the horizon, frame range and class list."""
    below = F.col("v") > horizon
    return det.agg(
        F.min("v").alias("min_v"), F.max("v").alias("max_v"),
        F.count(F.when(below, 1)).alias("below_horizon"), F.count(F.when(~below, 1)).alias("above_horizon"),
        F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame"),
        F.array_join(F.sort_array(F.collect_set("class_name")), ",").alias("classes"),
    )
