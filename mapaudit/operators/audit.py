"""The audit fact: each frame's nearest mapped node and its verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapaudit.config import DEFAULT, AuditConfig
from mapaudit.functions.geo import wkt_point
from mapaudit.functions.labels import audit_status
from mapaudit.operators.skew import DICE, keep_rank_one, lookup_join, with_dice
from mapaudit.operators.spatial import NEAR_CELLS, measure_sites, nearest_and_answers, radius_join

FRAME = ["video_name", "frame_number"]


def _node_columns(staged_nodes: DataFrame) -> DataFrame:
    return staged_nodes.select(
        F.col("osm_id").alias("nearest_osm_node_id"), F.col("normalized_type").alias("osm_class"),
        F.col("latitude").alias("osm_lat"), F.col("longitude").alias("osm_lon"),
    )


def nearest_within_radius(staged: DataFrame, staged_nodes: DataFrame, cfg: AuditConfig = DEFAULT,
                          per: str = "frame") -> DataFrame:
    """Left radius join, then ``rank() = 1`` by distance per (video, frame). Ties all stay.

    Where nodes are sparse the pairs go straight into the rank, which keeps each
    task's best before its shuffle. A pair that is not the closest of its own
    detection cannot be the closest of its frame, so where many nodes crowd a
    radius each detection is first reduced to its nearest positions.
    ``per="detection"`` stops after that step.
    """
    nodes, staged = _node_columns(staged_nodes), with_dice(staged)
    size = measure_sites(nodes.select(F.col("osm_lat").alias("s_lat"), F.col("osm_lon").alias("s_lon")),
                         cfg.search_radius_m)
    if per == "frame" and size.densest * NEAR_CELLS <= cfg.pair_nodes:
        pairs = radius_join(staged, nodes, cfg.search_radius_m, "left", cfg=cfg, node_rows=size.rows)
        pairs = pairs.withColumnRenamed("distance_m", "distance_meters")
        return keep_rank_one(pairs, FRAME, "distance_meters", staged, cfg.hot_rows).drop(DICE)
    near, answers = nearest_and_answers(staged, nodes, "nearest_osm_node_id", radius_m=cfg.search_radius_m, ties=True, cfg=cfg)
    at_site = {"s_lat": "osm_lat", "s_lon": "osm_lon"}
    near = near.drop("site").withColumnsRenamed({"distance_m": "distance_meters", **at_site})
    best = keep_rank_one(near, FRAME, "distance_meters", staged, cfg.hot_rows) if per == "frame" else near
    # every node at a nearest position is a match; equal doubles, so an equi-join
    asked = None if answers is None else answers.withColumnsRenamed(at_site)
    return lookup_join(best, nodes, ["osm_lat", "osm_lon"], "left", cfg, near, asked).drop(DICE)


def fct_map_audit(staged: DataFrame, staged_nodes: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    # the point text follows from the coordinates: made after the shuffle, not carried through it
    valid = staged.where(F.col("data_quality_flag") == "valid").drop("detection_location")
    matched = nearest_within_radius(valid, staged_nodes, cfg)
    status = audit_status(F.col("distance_meters"), F.col("object_class"), F.col("osm_class"), cfg.audit_threshold_m)
    return matched.select(
        "detection_id", "video_name", "frame_number", "timestamp_ms", F.col("object_class").alias("detected_class"),
        "confidence", F.col("latitude").alias("detected_lat"), F.col("longitude").alias("detected_lon"),
        "vehicle_id", "recording_timestamp", wkt_point("longitude", "latitude").alias("detection_location"),
        "nearest_osm_node_id", "osm_class", "osm_lat", "osm_lon", "distance_meters",
        status.alias("audit_status"),
    )
