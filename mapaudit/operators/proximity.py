"""Proximity reports: pairs, match counts, closest nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapaudit.config import DEFAULT, AuditConfig
from mapaudit.functions.geo import haversine_m
from mapaudit.functions.labels import count_if
from mapaudit.operators.spatial import nearest, radius_join, radius_join_sorted

VEHICLE_AT = ("vehicle_lat", "vehicle_lon")


def node_side(nodes: DataFrame) -> DataFrame:
    return nodes.withColumnsRenamed({"latitude": "osm_lat", "longitude": "osm_lon"})


def located(det: DataFrame) -> DataFrame:
    return det.where(F.col("vehicle_lat").isNotNull() & F.col("vehicle_lon").isNotNull())


def matches(det: DataFrame, nodes: DataFrame, radius_m: float = 50.0, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """All pairs within the radius, distance to the centimetre."""
    pairs = radius_join(located(det), node_side(nodes), radius_m, point_at=VEHICLE_AT, cfg=cfg)
    extra = [c for c in ("tags",) if c in nodes.columns]
    return pairs.select(
        "detection_id", F.col("class_name").alias("detected_class"), *VEHICLE_AT, "recording_timestamp", "confidence",
        "osm_id", "osm_type", "osm_lat", "osm_lon", F.round("distance_m", 2).alias("distance_meters"), *extra)


def proximity_pairs(det: DataFrame, nodes: DataFrame, radius_m: float, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Pairs strictly closer than the radius, by detection and distance."""
    slim = located(det).select("detection_id", "class_name", *VEHICLE_AT)
    at = node_side(nodes).select("osm_id", "osm_type", "osm_lat", "osm_lon")
    pairs = radius_join_sorted(slim, at, radius_m, ["detection_id", "distance_m", "osm_id"],
                               point_at=VEHICLE_AT, strict=True, cfg=cfg)
    return pairs.select(
        "detection_id", "class_name", *VEHICLE_AT, "osm_id", "osm_type", "osm_lat", "osm_lon",
        F.col("distance_m").alias("distance_meters"))


def match_counts(det: DataFrame, nodes: DataFrame, radius_m: float = 50.0, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Nodes within the radius per (detection, class), zeros kept.

    Nodes at one position count as one weighted node, so copies of a node never
    multiply the pairs. Only the columns needed travel; pairs are added up
    map-side, next to the join, so a pair is never shuffled.
    """
    slim = located(det).select("detection_id", "class_name", *VEHICLE_AT)
    at = (
        node_side(nodes).where(F.col("osm_lat").isNotNull() & F.col("osm_lon").isNotNull())
        .groupBy("osm_lat", "osm_lon").agg(F.count("osm_id").alias("copies"))
    )
    pairs = radius_join(slim, at, radius_m, how="left", point_at=VEHICLE_AT, cfg=cfg)
    total = F.sum(F.coalesce("copies", F.lit(0))).alias("num_nearby_osm_nodes")
    return pairs.groupBy("detection_id", "class_name").agg(total)


def most_matched_first(counts: DataFrame) -> DataFrame:
    # the id keeps range partitions even: most detections share a few counts
    return counts.orderBy(F.desc("num_nearby_osm_nodes"), "detection_id", "class_name")


def match_summary(counts: DataFrame) -> DataFrame:
    n = F.col("num_nearby_osm_nodes")
    return counts.agg(
        F.count(F.lit(1)).alias("total_detections"),
        count_if(n > 0).alias("detections_with_matches"), count_if(n == 0).alias("detections_without_matches"),
        F.round(F.avg(n), 2).alias("avg_matches_per_detection"), F.max(n).alias("max_matches"),
    )


def match_rate(summary: DataFrame) -> DataFrame:
    total, matched = F.col("total_detections"), F.col("detections_with_matches")
    rate = F.when(total > 0, matched / total * 100.0).otherwise(0.0)
    return summary.select("total_detections", "detections_with_matches", rate.alias("match_rate_pct"))


def nearest_nodes(det: DataFrame, nodes: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """The one nearest node of every located detection, however far."""
    found = nearest(located(det).select("detection_id", "class_name", *VEHICLE_AT), node_side(nodes), "osm_id",
                    payload=("osm_type",), point_at=VEHICLE_AT, cfg=cfg)
    return found.select(
        "detection_id", F.col("class_name").alias("detection_class"), *VEHICLE_AT, F.col("site.osm_id").alias("osm_id"),
        F.col("site.osm_type").alias("osm_type"), F.col("s_lat").alias("osm_lat"), F.col("s_lon").alias("osm_lon"),
        F.col("distance_m").alias("distance_meters"))


def nearest_to_point(nodes: DataFrame, lat: float = 43.79, lon: float = -79.314, n: int = 5) -> DataFrame:
    return (
        nodes.select("osm_id", "osm_type", "latitude", "longitude",
                     haversine_m("latitude", "longitude", lat, lon).alias("distance_from_detection_meters"))
        .orderBy("distance_from_detection_meters", "osm_id").limit(n)
    )


def closest(pairs: DataFrame, n: int) -> DataFrame:
    """The n shortest pairs; a per-task top-n, nothing else is shuffled."""
    return pairs.orderBy("distance_meters", "detection_id", "osm_id").limit(n)
