"""Two-way comparison of detected positions with mapped positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapaudit.config import DEFAULT, AuditConfig
from mapaudit.operators.spatial import nearest_both, with_answers

# The status texts of the exported comparison.
REPORT_STATUS = {"verified": "Verified", "new": "New Sign Detected", "missing": "Missing Sign on Road"}


def compare(det: DataFrame, nodes: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """``det(detection_id, latitude, longitude)`` against ``nodes(osm_id, osm_lat, osm_lon)``.

    A detection is verified when its nearest node is closer than
    ``verify_below_m``, else new. A node is missing when its nearest detection is
    ``missing_from_m`` away or more; nodes in between are in no list. Distances
    are null where the other side is empty. One descent of both sides' cells answers both directions.
    """
    det = det.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    nodes = nodes.where(F.col("osm_lat").isNotNull() & F.col("osm_lon").isNotNull())
    columns = ["status", "detection_id", "detected_lat", "detected_lon", "osm_id", "osm_lat", "osm_lon", "distance_m"]

    det, nodes = det.select("detection_id", "latitude", "longitude"), nodes.select("osm_id", "osm_lat", "osm_lon")
    by_place, by_site = nearest_both(det, nodes, "detection_id", "osm_id")
    here, there = ("latitude", "longitude"), ("osm_lat", "osm_lon")

    seen = with_answers(det, here, by_place, ("p_lat", "p_lon"), cfg)
    seen = (
        seen.withColumn("status", F.when(F.col("distance_m") < cfg.verify_below_m, "verified").otherwise("new"))
        .withColumn("osm_id", F.col("site.osm_id"))
        .withColumnsRenamed({"latitude": "detected_lat", "longitude": "detected_lon", "s_lat": "osm_lat", "s_lon": "osm_lon"})
    )
    missing = with_answers(nodes, there, by_site, ("s_lat", "s_lon"), cfg)
    missing = (
        missing.where(F.coalesce(F.col("distance_m"), F.lit(float("inf"))) >= cfg.missing_from_m)
        .withColumn("status", F.lit("missing"))
        .withColumn("detection_id", F.col("site.detection_id"))
        .withColumnsRenamed({"p_lat": "detected_lat", "p_lon": "detected_lon"})
    )
    return seen.select(*columns).unionByName(missing.select(*columns))


def comparison_counts(cmp: DataFrame) -> DataFrame:
    return cmp.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def comparison_report(cmp: DataFrame) -> DataFrame:
    """Text columns of the exported comparison. A missing node's detected position
    is printed in full, every other coordinate with 6 decimals."""
    def fixed(name: str, digits: int):
        return F.format_string(f"%.{digits}f", F.col(name))

    missing = F.col("status") == "missing"
    alone = F.col("distance_m").isNull()
    status = F.create_map(*[F.lit(x) for kv in REPORT_STATUS.items() for x in kv])

    def detected(name: str):
        raw = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.when(missing, raw).otherwise(fixed(name, 6))

    def mapped(name: str):
        return F.when(~missing & alone, "").otherwise(fixed(name, 6))

    return cmp.select(
        status[F.col("status")].alias("Status"),
        detected("detected_lat").alias("Detected_Lat"), detected("detected_lon").alias("Detected_Lon"),
        mapped("osm_lat").alias("OSM_Lat"), mapped("osm_lon").alias("OSM_Lon"),
        F.when(alone, "N/A").otherwise(fixed("distance_m", 2)).alias("Distance_m"),
    )
