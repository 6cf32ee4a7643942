"""Every registered query: name -> function of (spark, sf_dir).

Distances are rounded to the millimetre and means to six places, so that two
engines with different math libraries give equal values.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapaudit import inputs
from mapaudit.config import AUDIT_STATUSES, TARGET_CLASSES, AuditConfig
from mapaudit.functions import geo, labels, overlay
from mapaudit.operators import audit, compare, coverage, marts, projection, proximity, quality, signs, spatial, staging, stats
from mapaudit.plans.build import build_all, materialize
from mapaudit.session import new_path
from mapaudit.sources import detections as det_files
from mapaudit.sources import messages, osm_xml
from mapaudit.streaming import delivery, jobs, metrics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
T10 = AuditConfig(audit_threshold_m=10.0)
# The city area, south-west and north-east corner.
CITY = (43.58, -79.64, 43.86, -79.12)


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _staged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    det = staging.stage_detections(staging.from_typed(inputs.detections(spark, d)))
    return det, staging.stage_nodes(inputs.osm_nodes(spark, d))


def _fct(spark: SparkSession, d: str, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """The fact table, built once per session and read like the stored table it is."""
    name = f"fct-{cfg.audit_threshold_m:g}"
    path = inputs.stored_files(spark, d, name, lambda p: audit.fct_map_audit(*_staged(spark, d), cfg).write.parquet(p))
    return spark.read.parquet(path)


def prepare(spark: SparkSession, d: str) -> None:
    """Writes the stored tables and files that queries read, so that a timing shows the query alone."""
    inputs.raw_detections(spark, d)
    for cfg in (AuditConfig(), T10):
        _fct(spark, d, cfg)
    _det_csv(spark, d)


def _det_osm(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return inputs.detections(spark, d), inputs.osm_nodes(spark, d)


def _compared(spark: SparkSession, d: str) -> DataFrame:
    det, osm = _det_osm(spark, d)
    det = det.withColumnsRenamed({"vehicle_lat": "latitude", "vehicle_lon": "longitude"})
    return compare.compare(det, proximity.node_side(osm))


# ---- sources and sinks -------------------------------------------------------

def _det_csv(spark: SparkSession, d: str) -> str:
    """Detections as CSV files in which every 101st frame number and every 103rd
    confidence is unreadable and some positions are blank."""
    def write(path: str) -> None:
        det = inputs.detections(spark, d)
        bad_frame, bad_conf = F.col("event_id") % 101 == 0, F.col("event_id") % 103 == 0
        text = det.select(
            "video_name",
            F.when(bad_frame, "INVALID").otherwise(F.col("frame_number").cast("string")).alias("frame_number"),
            "timestamp_sec", "u", "v",
            F.when(bad_conf, "high").otherwise(F.col("confidence").cast("string")).alias("confidence"),
            "class_name", "vehicle_lat", "vehicle_lon", "recording_timestamp")
        text.write.option("header", True).csv(path)

    return inputs.stored_files(spark, d, "det_csv", write)


def _bbox_csv(spark: SparkSession, d: str) -> str:
    def write(path: str) -> None:
        boxes = inputs.boxes(spark, d)
        boxes.select("frame_number", (F.col("frame_number") / 30).alias("timestamp_sec"), F.col("x1").alias("bbox_x1"),
                     F.col("y1").alias("bbox_y1"), F.col("x2").alias("bbox_x2"), F.col("y2").alias("bbox_y2"),
                     "confidence", "class_name").write.option("header", True).csv(path)

    return inputs.stored_files(spark, d, "bbox_csv", write)


def _det_messages(spark: SparkSession, d: str) -> DataFrame:
    return messages.to_messages(inputs.as_message_columns(inputs.detections(spark, d)))


def _nodes_xml(spark: SparkSession, d: str) -> str:
    return inputs.stored_files(
        spark, d, "osm_xml", lambda p: osm_xml.write_osm_xml(inputs.tagged_nodes(spark, d), p))


@query("read_detections_csv")
def _(spark, d):
    return det_files.read_detections_csv(spark, _det_csv(spark, d))[0]


@query("read_detections_rejected")
def _(spark, d):
    rejected = det_files.read_detections_csv(spark, _det_csv(spark, d))[1]
    return rejected.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("read_detections_bbox")
def _(spark, d):
    good, _bad = det_files.read_detections_csv(spark, _bbox_csv(spark, d))
    return good.select("frame_number", "u", "v", "confidence", "class_name")


@query("read_detections_strict")
def _(spark, d):
    good, _bad = det_files.read_detections_csv(spark, _bbox_csv(spark, d), mode="failfast")
    return good.groupBy("class_name").agg(F.count(F.lit(1)).alias("n"), F.sum("frame_number").alias("frames"))


@query("gather_detection_files")
def _(spark, d):
    rows, _bad = det_files.gather_detections(spark, _det_csv(spark, d))
    return rows


def _video_files(spark: SparkSession, d: str) -> str:
    """A CSV file for each video; those of every 4th video are in an encoding that the reader does not know."""
    def write(path: str) -> None:
        rows = inputs.detections(spark, d).withColumn("video", F.floor(F.col("event_id") / 1000).cast("int"))
        rows = rows.select("video", "video_name", "frame_number", "timestamp_sec", "u", "v", "confidence", "class_name")
        other = F.col("video") % 4 == 3
        for part, encoding in ((rows.where(~other), "UTF-8"), (rows.where(other), "UTF-16")):
            # tasks move their own files: with very many, the driver would move them one after the other
            (part.repartition("video").write.mode("append").partitionBy("video").option("header", True).option("encoding", encoding)
             .option("mapreduce.fileoutputcommitter.algorithm.version", "2").csv(path))

    return inputs.stored_files(spark, d, "video_csv", write)


@query("gather_readable_files")
def _(spark, d):
    rows, _bad = det_files.gather_detections(spark, _video_files(spark, d), skip_unreadable=True)
    return rows.select("video_name", "frame_number", "u", "v", "confidence", "class_name")


@query("gather_failed_files")
def _(spark, d):
    failed = det_files.gather_failures(spark, _video_files(spark, d))
    return failed.select(F.regexp_extract("source_file", r"video=(\d+)", 1).cast("int").alias("video"),
                         F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason"))


@query("enrich_detections")
def _(spark, d):
    det = inputs.detections(spark, d).withColumns({
        "source_file": F.col("video_name"), "block_start": F.lit(0), "line_in_block": F.col("event_id")})
    rows = det_files.enrich(det, "vehicle-7", "session-9", deterministic_id=True)
    return rows.select("vehicle_id", "session_id", "detection_id", "video_name", "frame_number", "pixel_u",
                       "pixel_v", "confidence", "class_name", "vehicle_lat", "vehicle_lon", "recording_timestamp")


@query("detection_to_message")
def _(spark, d):
    m = _det_messages(spark, d)
    header = F.element_at("headers", 1)
    return m.select("key", F.size("headers").alias("n_headers"), header["key"].alias("first_header"),
                    F.decode(header["value"], "UTF-8").alias("first_value"),
                    F.json_array_length(F.to_json(F.json_object_keys("value"))).alias("n_fields"))


@query("message_to_detection")
def _(spark, d):
    back = messages.from_messages(_det_messages(spark, d))
    return back.select("detection_id", "vehicle_id", "video_name", "frame_number", "timestamp_sec", "pixel_u", "pixel_v",
                       "confidence", "class_name", "vehicle_lat", "vehicle_lon", "recording_timestamp")


@query("load_raw_detections")
def _(spark, d):
    raw = inputs.raw_detections(spark, d)
    return raw.select(
        F.try_variant_get("record_metadata", "$.key", "string").alias("message_key"),
        staging.field("class_name", "string").alias("class_name"), staging.field("vehicle_lat", "double").alias("vehicle_lat"),
        "kafka_topic", F.col("kafka_partition").cast("int").alias("kafka_partition"), "kafka_timestamp")


@query("raw_time_window")
def _(spark, d):
    """A day and a half of the raw table, read from the days' folders alone."""
    stored = inputs.stored_files(spark, d, "raw_clustered", lambda path: messages.cluster_raw(inputs.raw_detections(spark, d), path))
    rows = messages.raw_between(spark.read.parquet(stored), "2024-01-10 06:00:00", "2024-01-11 18:30:00")
    return rows.select(F.try_variant_get("record_metadata", "$.key", "string").alias("message_key"), "kafka_timestamp")


@query("read_osm_xml")
def _(spark, d):
    nodes = osm_xml.read_osm_nodes(spark, _nodes_xml(spark, d))
    return nodes.select("osm_id", "osm_type", "latitude", "longitude", osm_xml.tag("name").alias("name"),
                        osm_xml.tag("crossing").alias("crossing"), F.size("tags").alias("n_tags"))


@query("osm_nodes_by_tag")
def _(spark, d):
    nodes = inputs.tagged_nodes(spark, d)
    exact = osm_xml.nodes_by_tag(nodes, "highway", "traffic_signals").withColumn("type", F.lit(None).cast("string"))
    return exact.unionByName(osm_xml.nodes_by_tag(nodes, "crossing"))


@query("append_osm_reference")
def _(spark, d):
    def write(path: str) -> None:
        for part in ("first.xml", "second.xml"):
            osm_xml.append_nodes(inputs.tagged_nodes(spark, d), part, path)

    loaded = spark.read.parquet(inputs.stored_files(spark, d, "ref_nodes", write))
    return loaded.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_distinct("osm_type").alias("types"))


@query("write_osm_xml")
def _(spark, d):
    back = osm_xml.read_nodes(spark, _nodes_xml(spark, d))
    return back.select("osm_id", "latitude", "longitude", F.array_join(F.sort_array(F.map_keys("tags")), ",").alias("keys"))


def _round_trip(spark: SparkSession, d: str, name: str, df: Callable[[], DataFrame]) -> DataFrame:
    path = inputs.stored_files(spark, d, name, lambda p: det_files.write_csv(df(), p))
    return spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path)


@query("export_comparison")
def _(spark, d):
    return compare.comparison_report(_compared(spark, d))


@query("export_detections")
def _(spark, d):
    report = _round_trip(spark, d, "export_det", lambda: det_files.detections_report(
        inputs.detections(spark, d)))
    return report.fillna("").withColumn("frame_number", F.col("frame_number").cast("int"))


@query("export_filtered")
def _(spark, d):
    back = _round_trip(spark, d, "export_filtered", lambda: stats.filter_detections(
        inputs.detections(spark, d), ["stop sign"], 0.5).select("detection_id", "class_name", "confidence"))
    return back.withColumn("confidence", F.col("confidence").cast("double"))


@query("materialize")
def _(spark, d):
    stored = materialize(stats.class_counts(inputs.detections(spark, d)), "marts", "class_counts", new_path(spark, "wh"))
    return stored.select("class_name", "count")


# ---- projections, filters, predicates ----------------------------------------

_FLAT = ["video_name", "frame_number", "timestamp_ms", "object_class", "confidence", "latitude", "longitude",
         "vehicle_id", "recording_timestamp", "ingested_at"]


@query("stg_perception_flatten")
def _(spark, d):
    return staging.flatten_detections(inputs.raw_detections(spark, d)).select(*_FLAT)


@query("stg_perception_data")
def _(spark, d):
    flat = staging.flatten_detections(inputs.raw_detections(spark, d))
    return staging.stage_detections(flat).select(*_FLAT, "data_quality_flag")


@query("quality_flag_counts")
def _(spark, d):
    flat = staging.flatten_detections(inputs.raw_detections(spark, d))
    flag = labels.quality_flag(F.col("latitude"), F.col("longitude"), F.col("confidence"), F.col("object_class"))
    return flat.groupBy(flag.alias("data_quality_flag")).agg(F.count(F.lit(1)).alias("n"))


def _flat_view(spark: SparkSession, d: str, mode: str) -> DataFrame:
    numbers = ["timestamp_sec", "pixel_u", "pixel_v", "confidence", "vehicle_lat", "vehicle_lon"]
    view = staging.detections_flat(inputs.raw_detections(spark, d), mode)
    return view.withColumns({c: F.col(c).cast("double") for c in numbers}).select(
        "detection_id", "vehicle_id", "session_id", "detection_timestamp", "frame_number", *numbers, "class_name",
        F.col("vehicle_location").isNotNull().alias("has_location"), "kafka_topic", "kafka_timestamp")


@query("vw_detections_flat")
def _(spark, d):
    return _flat_view(spark, d, "double")


@query("vw_detections_flat_integer")
def _(spark, d):
    return _flat_view(spark, d, "integer")


@query("stg_osm_ground_truth")
def _(spark, d):
    return staging.stage_nodes(inputs.tagged_nodes(spark, d)).drop("osm_location")


@query("raw_gps_sample")
def _(spark, d):
    return staging.gps_sample(inputs.raw_detections(spark, d), 5)


@query("audit_status")
def _(spark, d):
    return _fct(spark, d, T10).groupBy("audit_status").agg(F.count(F.lit(1)).alias("n"))


@query("action_priority")
def _(spark, d):
    return marts.discrepancy_details(_fct(spark, d, T10)).groupBy("audit_status", "action_priority").agg(
        F.count(F.lit(1)).alias("n"))


@query("map_points")
def _(spark, d):
    return marts.map_points(_fct(spark, d))


@query("filter_class_confidence")
def _(spark, d):
    return stats.filter_detections(inputs.detections(spark, d), ["stop sign"], 0.5).select(
        "detection_id", "class_name", "confidence")


@query("frame_time_window")
def _(spark, d):
    return stats.at_time(inputs.detections(spark, d), 30.0).select("detection_id", "timestamp_sec", "class_name")


@query("osm_selector")
def _(spark, d):
    found = osm_xml.select_nodes(inputs.tagged_nodes(spark, d), osm_xml.INFRASTRUCTURE, bbox=(43.6, -79.5, 43.8, -79.2))
    return found.select("osm_id", "osm_type", "latitude", "longitude")


@query("osm_selector_around")
def _(spark, d):
    found = osm_xml.select_nodes(inputs.tagged_nodes(spark, d), osm_xml.SIGNALS_AND_STOPS, around=(9000, 43.7, -79.4))
    return found.select("osm_id", "osm_type")


@query("osm_selector_by_place")
def _(spark, d):
    """The same search in a table kept in order of place, whose far row groups the scan skips."""
    path = inputs.stored_files(spark, d, "osm_by_place", lambda p: osm_xml.write_nodes_by_place(inputs.tagged_nodes(spark, d), p))
    found = osm_xml.select_nodes(spark.read.parquet(path), osm_xml.SIGNALS_AND_STOPS, around=(9000, 43.7, -79.4))
    return found.select("osm_id", "osm_type")


@query("osm_selector_tiles")
def _(spark, d):
    found = osm_xml.select_nodes(inputs.tagged_nodes(spark, d), osm_xml.SIGNS_AND_STOPS, bbox=CITY)
    tile = coverage.tile_of(F.col("latitude"), F.col("longitude"), CITY)
    return found.groupBy(tile.alias("tile_no")).agg(F.count(F.lit(1)).alias("nodes"))


@query("extract_detections")
def _(spark, d):
    return projection.extract_detections(inputs.boxes(spark, d))


@query("filter_traffic_nodes")
def _(spark, d):
    return osm_xml.filter_traffic(inputs.tagged_nodes(spark, d)).select("osm_id", "osm_type")


@query("parse_overlay")
def _(spark, d):
    parsed = overlay.parse_overlay(inputs.overlay_texts(spark, d))
    return rounded(parsed.select("event_id", "lat", "lon", "speed_or_heading", "recording_timestamp"), lat=9, lon=9)


@query("overlay_fallbacks")
def _(spark, d):
    """Frames whose position is made up, by time found or not."""
    parsed = overlay.parse_overlay(inputs.overlay_texts(spark, d))
    return parsed.groupBy("is_fallback").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("recording_timestamp") != "").alias("with_time"))


@query("best_overlay_text")
def _(spark, d):
    return overlay.best_text(inputs.overlay_readings(spark, d))


# ---- geometry ----------------------------------------------------------------

@query("make_point")
def _(spark, d):
    osm = inputs.osm_nodes(spark, d)
    point = geo.wkt_point(F.col("longitude").cast("decimal(10,7)"), F.col("latitude").cast("decimal(10,7)"))
    return osm.select("osm_id", point.alias("point"))


@query("haversine_m")
def _(spark, d):
    det = proximity.located(inputs.detections(spark, d))
    dist = geo.haversine_m("vehicle_lat", "vehicle_lon", 43.79, -79.314)
    return det.select("detection_id", F.round(dist, 3).alias("distance_m"))


@query("destination_point")
def _(spark, d):
    lat, lon = geo.destination("lat", "lon", "heading", 100.0)
    return inputs.track(spark, d).select("video_name", "frame_number", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query("pixel_to_distance")
def _(spark, d):
    det = inputs.detections(spark, d)
    return det.select("detection_id", "v", F.round(geo.pixel_distance("v"), 6).alias("distance"))


def _projected(spark: SparkSession, d: str, **camera) -> DataFrame:
    out = projection.project_detections(inputs.detections(spark, d), inputs.track(spark, d), **camera)
    return rounded(out.select("detection_id", "distance", "object_lat", "object_lon"), distance=6, object_lat=9, object_lon=9)


@query("project_detections")
def _(spark, d):
    return _projected(spark, d)


@query("project_detections_all_above")
def _(spark, d):
    return _projected(spark, d, horizon=5000.0)


@query("coverage_bbox")
def _(spark, d):
    return rounded(coverage.coverage_bbox(inputs.detections(spark, d), "vehicle_lat", "vehicle_lon"),
                   min_lat=9, min_lon=9, max_lat=9, max_lon=9)


@query("tile_grid")
def _(spark, d):
    box = coverage.coverage_bbox(inputs.detections(spark, d), "vehicle_lat", "vehicle_lon")
    return rounded(coverage.tiles(box), south=9, west=9, north=9, east=9)


@query("nodes_per_tile")
def _(spark, d):
    tile = coverage.tile_of(F.col("latitude"), F.col("longitude"), CITY)
    return inputs.osm_nodes(spark, d).groupBy(tile.alias("tile_no")).agg(F.count(F.lit(1)).alias("nodes"))


@query("merge_tiles")
def _(spark, d):
    return coverage.merge_tiles(inputs.tile_nodes(spark, d))


def _tile_files(spark: SparkSession, d: str) -> str:
    """An XML extract for each map tile; of every 5th tile the end is missing."""
    def write(path: str) -> None:
        nodes = inputs.tile_nodes(spark, d).repartition("tile_no")
        cut_off = F.col("tile_no") % 5 == 0
        tags = F.array(F.struct(F.lit("highway").alias("_k"), F.col("osm_type").alias("_v")))
        (nodes.where(~cut_off).select(F.col("osm_id").alias("_id"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"),
                                      tags.alias("tag"), "tile_no")
         .write.partitionBy("tile_no").format("xml").option("rowTag", "node").option("rootTag", 'osm version="0.6"').save(path))
        line = F.format_string('<osm><node id="%s" lat="%s" lon="%s"/>', "osm_id", F.col("latitude").cast("string"), F.col("longitude").cast("string"))
        nodes.where(cut_off).select("tile_no", line).write.mode("append").partitionBy("tile_no").text(path)

    return inputs.stored_files(spark, d, "tile_xml", write)


@query("merge_tiles_xml")
def _(spark, d):
    nodes, _failed = coverage.merge_tile_files(spark, _tile_files(spark, d))
    return nodes.select("osm_id", F.element_at("tags", "highway").alias("osm_type"), "latitude", "longitude",
                        F.regexp_extract("source_file", r"tile_no=(\d+)", 1).cast("int").alias("tile_no"))


@query("merge_tiles_failed")
def _(spark, d):
    _nodes, failed = coverage.merge_tile_files(spark, _tile_files(spark, d))
    return failed.select(F.regexp_extract("source_file", r"tile_no=(\d+)", 1).cast("int").alias("tile_no"), "reason")


@query("tile_counts")
def _(spark, d):
    return coverage.tile_counts(inputs.tile_nodes(spark, d))


@query("centroid")
def _(spark, d):
    return rounded(coverage.centroid(inputs.osm_nodes(spark, d)), center_lat=9, center_lon=9)


# ---- joins -------------------------------------------------------------------

@query("radius_join_left")
def _(spark, d):
    det, osm = _det_osm(spark, d)
    pairs = spatial.radius_join(det, proximity.node_side(osm), 100.0, "left", proximity.VEHICLE_AT)
    return pairs.select("detection_id", "class_name", "osm_id", "osm_type", F.round("distance_m", 3).alias("distance_m"))


@query("radius_join_inner")
def _(spark, d):
    return proximity.matches(*_det_osm(spark, d), 50.0).select(
        "detection_id", "detected_class", "recording_timestamp", "confidence", "osm_id", "osm_type", "distance_meters")


def _pairs(spark: SparkSession, d: str, radius: float) -> DataFrame:
    pairs = proximity.proximity_pairs(*_det_osm(spark, d), radius)
    return pairs.select("detection_id", "class_name", "osm_id", "osm_type", F.round("distance_meters", 3).alias("distance_meters"))


@query("proximity_pairs")
def _(spark, d):
    return _pairs(spark, d, 50.0)


@query("proximity_pairs_100m")
def _(spark, d):
    return _pairs(spark, d, 100.0)


@query("nearest_node")
def _(spark, d):
    found = proximity.nearest_nodes(*_det_osm(spark, d))
    return rounded(found.select("detection_id", "detection_class", "osm_id", "osm_type", "distance_meters"), distance_meters=3)


@query("nearest_node_far")
def _(spark, d):
    """Detections that stand 60 km north of where they were made, so no node is near."""
    det, osm = _det_osm(spark, d)
    found = proximity.nearest_nodes(det.withColumn("vehicle_lat", F.col("vehicle_lat") + 0.54), osm)
    return rounded(found.select("detection_id", "detection_class", "osm_id", "osm_type", "distance_meters"), distance_meters=3)


@query("nearest_within_radius")
def _(spark, d):
    det, osm = _staged(spark, d)
    near = audit.nearest_within_radius(det, osm)
    return rounded(near.select("detection_id", "video_name", "frame_number", "nearest_osm_node_id", "distance_meters"),
                   distance_meters=3)


@query("nearest_within_radius_ties")
def _(spark, d):
    """Detections midway between an east and a west node, on a grid whose steps are exact in binary."""
    grid = spark.read.parquet(f"{d}/events.parquet").selectExpr(
        "event_id", "(40 * 4096 + event_id % 81920) / 4096D as latitude", "(-79 * 4096 + 8 * ((event_id * 37) % 5000)) / 4096D as longitude")
    sides = grid.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    nodes = sides.select(F.concat_ws("-", "event_id", "side").alias("osm_id"), F.col("latitude").alias("osm_lat"),
                         (F.col("longitude") + F.col("side") / 4096.0).alias("osm_lon"))
    near = spatial.nearest(grid, nodes, "osm_id", radius_m=100.0, ties=True)
    return rounded(near.select("event_id", F.col("s_lat").alias("osm_lat"), F.col("s_lon").alias("osm_lon"), "distance_m"), distance_m=3)


@query("nearest_within_radius_per_detection")
def _(spark, d):
    near = audit.nearest_within_radius(*_staged(spark, d), per="detection")
    return rounded(near.select("detection_id", "nearest_osm_node_id", "distance_meters"), distance_meters=3)


@query("compare_bidirectional")
def _(spark, d):
    return rounded(_compared(spark, d).select("status", "detection_id", "osm_id", "distance_m"), distance_m=3)


@query("track_lookup")
def _(spark, d):
    joined = projection.track_lookup(inputs.detections(spark, d), inputs.track(spark, d))
    return joined.select("detection_id", "video_name", "frame_number", "heading")


def _fact_query(spark: SparkSession, d: str, cfg: AuditConfig) -> DataFrame:
    return rounded(audit.fct_map_audit(*_staged(spark, d), cfg).drop("detection_location"), distance_meters=3)


@query("fct_map_audit")
def _(spark, d):
    return _fact_query(spark, d, AuditConfig())


@query("fct_map_audit_t10")
def _(spark, d):
    return _fact_query(spark, d, T10)


# ---- aggregations ------------------------------------------------------------

def _summary(fct: DataFrame) -> DataFrame:
    return rounded(marts.audit_summary(fct), avg_confidence=6, avg_distance_meters=6, min_distance_meters=3,
                   max_distance_meters=3)


@query("audit_summary_metrics")
def _(spark, d):
    return _summary(audit.fct_map_audit(*_staged(spark, d)))


@query("audit_summary_metrics_t10")
def _(spark, d):
    return _summary(audit.fct_map_audit(*_staged(spark, d), T10))


@query("summary_metrics")
def _(spark, d):
    return rounded(marts.summary_metrics(_fct(spark, d)), avg_verification_rate=6)


@query("class_breakdown")
def _(spark, d):
    return marts.class_breakdown(_fct(spark, d, T10))


@query("verification_trend")
def _(spark, d):
    return rounded(marts.verification_trend(_fct(spark, d)), verification_rate=6)


@query("matches_per_detection")
def _(spark, d):
    return proximity.most_matched_first(proximity.match_counts(*_det_osm(spark, d)))


@query("match_summary")
def _(spark, d):
    return proximity.match_summary(proximity.match_counts(*_det_osm(spark, d)))


@query("match_rate")
def _(spark, d):
    summary = proximity.match_summary(proximity.match_counts(*_det_osm(spark, d)))
    return rounded(proximity.match_rate(summary), match_rate_pct=6)


@query("detections_by_class")
def _(spark, d):
    return stats.class_counts(inputs.detections(spark, d))


@query("osm_type_top20")
def _(spark, d):
    return stats.type_counts(inputs.osm_nodes(spark, d))


@query("ingestion_status")
def _(spark, d):
    loaded = inputs.osm_nodes(spark, d).withColumn(
        "uploaded_at", F.expr("timestamp_ntz'2024-01-31 00:00:00' + make_dt_interval(0, 0, 0, cast(osm_id as int))"))
    return stats.ingestion_status({"detections": (inputs.raw_detections(spark, d), "kafka_timestamp"),
                                   "ground_truth": (loaded, "uploaded_at")})


@query("osm_load_summary")
def _(spark, d):
    return stats.load_summary(inputs.osm_nodes(spark, d))


@query("detection_stats")
def _(spark, d):
    return rounded(stats.detection_stats(inputs.detections(spark, d)), avg_confidence=6)


@query("confidence_histogram")
def _(spark, d):
    return stats.confidence_histogram(inputs.detections(spark, d))


@query("detections_over_time")
def _(spark, d):
    return stats.detections_over_time(inputs.detections(spark, d))


@query("class_counts_over_time")
def _(spark, d):
    return stats.class_counts_over_time(inputs.detections(spark, d))


@query("comparison_counts")
def _(spark, d):
    return compare.comparison_counts(_compared(spark, d))


@query("window_class_conf")
def _(spark, d):
    window = stats.at_time(inputs.detections(spark, d), 30.0)
    return rounded(stats.class_confidence(window), avg_confidence=6)


@query("per_video_counts")
def _(spark, d):
    return stats.video_counts(inputs.detections(spark, d))


@query("per_video_summary")
def _(spark, d):
    return rounded(stats.video_summary(stats.video_counts(inputs.detections(spark, d))), avg_per_video=6)


@query("top_videos")
def _(spark, d):
    return stats.top_videos(stats.video_counts(inputs.detections(spark, d)))


@query("pixel_profile")
def _(spark, d):
    return projection.pixel_profile(inputs.detections(spark, d))


@query("unique_signs")
def _(spark, d):
    return signs.unique_signs(inputs.detections(spark, d))


@query("frames_per_sign")
def _(spark, d):
    det = inputs.detections(spark, d)
    return rounded(stats.frames_per_sign(stats.detection_stats(det), signs.unique_signs(det)), avg_confidence=6,
                   avg_frames_per_sign=6)


@query("run_metrics")
def _(spark, d):
    good, bad = det_files.read_detections_csv(spark, _det_csv(spark, d), keep_place=True)
    rows = det_files.enrich(good, deterministic_id=True).withColumn("reject_reason", F.lit(None).cast("string"))
    failed = bad.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[:-1]], "reject_reason")
    run = metrics.send_batch(rows.unionByName(failed), {"path": new_path(spark, "topic")}, fmt="json")
    return spark.range(1).select(
        F.lit(run.sent).alias("sent"), F.lit(run.acked).alias("acked"), F.lit(run.failed).alias("failed"),
        F.lit(run.rejected).alias("rejected"), F.lit(run.pending).alias("pending"), F.round(F.lit(run.success_rate_pct), 6).alias("success_rate_pct"))


def _refusing():
    """A client that never accepts the messages of every 50th frame and accepts those of each 7th at the second try."""
    def client():  # nested, so that tasks get it by value
        seen = set()

        def send(batch):
            out = []
            for key, value in batch:
                frame = json.loads(value)["frame_number"]
                late = frame % 7 == 0 and key not in seen
                seen.add(key)
                out.append("refused" if frame % 50 == 0 else "busy" if late else None)
            return out

        return send

    return client


def _sent_table(spark, d):
    return messages.to_messages(inputs.as_message_columns(inputs.detections(spark, d))).select("key", "value")


@query("run_metrics_refused")
def _(spark, d):
    """Counts from the client's answers, with retries; what stays refused is kept."""
    path = inputs.stored_files(spark, d, "answers", lambda p: delivery.deliver(_sent_table(spark, d), _refusing(), p, pause_seconds=0.01))
    return delivery.delivery_counts(spark.read.schema(delivery.ANSWERS).parquet(path))


@query("dead_letters")
def _(spark, d):
    """The same as a stream: messages that were never accepted, with their values."""
    def run(folder: str) -> None:
        topic = new_path(spark, "topic")
        _sent_table(spark, d).write.parquet(topic)
        source = jobs.topic_source(spark, {"path": topic}, "parquet", "key string, value string")
        delivery.stream_delivery(source, _refusing(), folder, new_path(spark, "cp"), attempts=2, once=True).awaitTermination()

    answers = delivery.stored_answers(spark, inputs.stored_files(spark, d, "stream_answers", run))
    refused = answers.where(~F.col("acked"))
    return refused.select("key", F.get_json_object("value", "$.frame_number").cast("long").alias("frame_number"), "attempts", "reason")


@query("run_metrics_stream")
def _(spark, d):
    counter = metrics.StreamCounter()
    spark.streams.addListener(counter)
    try:
        sent = jobs.csv_to_topic(spark, _det_csv(spark, d), det_files.OUTPUT, {"path": new_path(spark, "topic")},
                                 new_path(spark, "cp"), fmt="json", once=True)
        sent.awaitTermination()
        run = counter.metrics(sent)
    finally:
        spark.streams.removeListener(counter)
    return spark.range(1).select(
        F.lit(run.sent).alias("sent"), F.lit(run.acked).alias("acked"), F.lit(run.failed).alias("failed"),
        F.lit(run.rejected).alias("rejected"), F.lit(run.pending).alias("pending"))


# ---- order, limit, union -----------------------------------------------------

@query("discrepancy_details")
def _(spark, d):
    return rounded(marts.discrepancy_details(_fct(spark, d)), distance_meters=3)


@query("high_priority_top10")
def _(spark, d):
    top = marts.high_priority(_fct(spark, d, T10))
    return rounded(top.select("detection_id", "confidence", "distance_meters", "nearest_osm_node_id"), distance_meters=3)


@query("nearest_to_point")
def _(spark, d):
    return rounded(proximity.nearest_to_point(inputs.osm_nodes(spark, d)), distance_from_detection_meters=3)


def _rounded_pairs(pairs: DataFrame) -> DataFrame:
    return rounded(pairs, distance_meters=2).select("detection_id", "osm_id", "distance_meters")


@query("closest_pairs")
def _(spark, d):
    det, osm = _det_osm(spark, d)
    pairs = spatial.radius_join(det, proximity.node_side(osm), 100.0, point_at=proximity.VEHICLE_AT, strict=True)
    return proximity.closest(_rounded_pairs(pairs.withColumnRenamed("distance_m", "distance_meters")), 10)


@query("closest_detections")
def _(spark, d):
    return proximity.closest(_rounded_pairs(proximity.nearest_nodes(*_det_osm(spark, d))), 5)


@query("closest_matches_50")
def _(spark, d):
    return proximity.closest(_rounded_pairs(proximity.matches(*_det_osm(spark, d))), 50)


@query("recent_detections")
def _(spark, d):
    return stats.recent_detections(inputs.detections(spark, d))


@query("recent_detections_top10")
def _(spark, d):
    return stats.recent_detections(inputs.detections(spark, d), 10)


@query("osm_sample")
def _(spark, d):
    sample = stats.node_sample(inputs.tagged_nodes(spark, d), "traffic_signals", 5)
    return sample.select("*", osm_xml.tag("name").alias("name"), F.size("tags").alias("n_tags")).drop("tags")


@query("osm_sample_any")
def _(spark, d):
    sample = stats.node_sample(inputs.tagged_nodes(spark, d), None, 10_000)
    return sample.select("*", osm_xml.tag("name").alias("name"), osm_xml.tag("crossing").alias("crossing"), F.size("tags").alias("n_tags")).drop("tags")


@query("table_row_counts")
def _(spark, d):
    return stats.row_counts({"detections": inputs.raw_detections(spark, d), "nodes": inputs.osm_nodes(spark, d)})


# ---- data checks -------------------------------------------------------------

@query("dq_not_null")
def _(spark, d):
    flat = staging.flatten_detections(inputs.raw_detections(spark, d))
    return quality.not_null_summary(
        flat, ["video_name", "frame_number", "object_class", "confidence", "latitude", "longitude"], "detections")


@query("dq_not_null_rows")
def _(spark, d):
    flat = staging.flatten_detections(inputs.raw_detections(spark, d))
    return quality.not_null(flat, ["object_class"]).select("detection_id")


@query("dq_unique")
def _(spark, d):
    return quality.unique(inputs.tile_nodes(spark, d), "osm_id")


@query("dq_accepted_values")
def _(spark, d):
    return quality.accepted_values(inputs.boxes(spark, d), "class_name", TARGET_CLASSES)


@query("dq_accepted_values_status")
def _(spark, d):
    return quality.accepted_values(_fct(spark, d), "audit_status", AUDIT_STATUSES[:2])


@query("dq_accepted_range")
def _(spark, d):
    fct = _fct(spark, d)
    low = quality.accepted_range(fct, "confidence", 0.3, 0.9)
    far = quality.accepted_range(fct, "distance_meters", 0.0, 90.0, F.col("distance_meters").isNotNull())
    return low.withColumn("check_name", F.lit("confidence")).unionByName(
        far.withColumn("check_name", F.lit("distance"))).select("check_name", "detection_id", "nearest_osm_node_id")


@query("dq_verification_rate")
def _(spark, d):
    return quality.verification_rate(_fct(spark, d, T10))


@query("dq_future_dates")
def _(spark, d):
    return quality.future_dates(_fct(spark, d), F.expr("timestamp'2024-01-25 00:00:00'"))


@query("dq_all_checks")
def _(spark, d):
    return quality.run_checks(inputs.raw_detections(spark, d), inputs.osm_nodes(spark, d), _fct(spark, d, T10),
                              F.expr("timestamp'2024-01-25 00:00:00'"))


# ---- streaming: each drains the stored table through a real query ------------

def _stream(spark: SparkSession, df: DataFrame, d: str, name: str, build) -> DataFrame:
    """Streams the files of a stored table."""
    path = inputs.stored_files(spark, d, name, build)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


def _det_stream(spark: SparkSession, d: str) -> DataFrame:
    det = inputs.detections(spark, d)
    by_video = det.repartition("video_name")  # a frame's rows stay in one file
    return _stream(spark, det, d, "det_stream", lambda p: by_video.write.parquet(p))


def _topic_rows(topic: DataFrame) -> DataFrame:
    return messages.from_messages(topic).select(
        "vehicle_id", "video_name", "frame_number", "pixel_u", "pixel_v", "confidence", "class_name", "vehicle_lat", "vehicle_lon")


@query("stream_csv_to_topic")
def _(spark, d):
    def run(path: str) -> None:
        jobs.csv_to_topic(spark, _det_csv(spark, d), det_files.OUTPUT, {"path": path}, new_path(spark, "cp"),
                          fmt="json", session_id="s", once=True).awaitTermination()

    topic = spark.read.schema("key string, value string").json(inputs.stored_files(spark, d, "topic_stream", run))
    return _topic_rows(topic)


@query("stream_csv_rejected")
def _(spark, d):
    """The rows that the stream to the topic leaves out, by reason."""
    def run(path: str) -> None:
        jobs.csv_rejects(spark, _det_csv(spark, d), det_files.OUTPUT, path, new_path(spark, "cp"), once=True).awaitTermination()

    rejected = spark.read.parquet(inputs.stored_files(spark, d, "csv_rejects", run))
    return rejected.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("stream_csv_topic_raw")
def _(spark, d):
    """Both streams in a row: files to topic, topic to raw table."""
    def run(path: str) -> None:
        topic = new_path(spark, "topic")
        jobs.csv_to_topic(spark, _det_csv(spark, d), det_files.OUTPUT, {"path": topic}, new_path(spark, "cp"),
                          fmt="json", session_id="s", once=True).awaitTermination()
        source = jobs.topic_source(spark, {"path": topic}, "json", "key string, value string")
        jobs.topic_to_raw(source, "detections", path, new_path(spark, "cp"), once=True).awaitTermination()

    raw = spark.read.parquet(inputs.stored_files(spark, d, "raw_two_streams", run))
    return staging.flatten_detections(raw).select("video_name", "frame_number", "confidence", "object_class", "latitude")


@query("batch_csv_to_topic")
def _(spark, d):
    def run(path: str) -> None:
        good, _bad = det_files.read_detections_csv(spark, _det_csv(spark, d), keep_place=True)
        jobs.batch_to_topic(det_files.enrich(good, deterministic_id=True), {"path": path}, fmt="json")

    topic = spark.read.schema("key string, value string").json(inputs.stored_files(spark, d, "topic_batch", run))
    return _topic_rows(topic)


@query("stream_topic_to_raw")
def _(spark, d):
    def run(path: str) -> None:
        sent = messages.to_messages(inputs.as_message_columns(_det_stream(spark, d))).drop("message")
        jobs.topic_to_raw(sent, "detections", path, new_path(spark, "cp"), once=True).awaitTermination()

    raw = spark.read.parquet(inputs.stored_files(spark, d, "raw_stream", run))
    return staging.flatten_detections(raw).select("detection_id", "video_name", "frame_number", "object_class", "latitude")


@query("stream_audit")
def _(spark, d):
    """The two detections of a frame come in different files and batches."""
    det = inputs.detections(spark, d)

    def split(path: str) -> None:
        for k in (0, 1):
            det.where(F.col("event_id") % 2 == k).coalesce(2).write.mode("append").parquet(path)

    def run(path: str) -> None:
        jobs.stream_audit(jobs.stage_typed_stream(_stream(spark, det, d, "det_split", split)), _staged(spark, d)[1], path,
                          new_path(spark, "cp"), once=True).awaitTermination()

    fct = jobs.current_facts(spark, inputs.stored_files(spark, d, "fct_stream", run))
    return rounded(fct.drop("detection_location"), distance_meters=3)


@query("stream_status_counts")
def _(spark, d):
    def run(path: str) -> None:
        def sink(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

        jobs.status_counts(_det_stream(spark, d), sink, new_path(spark, "cp"), once=True).awaitTermination()

    updates = spark.read.parquet(inputs.stored_files(spark, d, "counts_stream", run))
    return updates.groupBy("class_name").agg(F.max_by("count", "batch").alias("count"))


def _dedup_table(spark: SparkSession, d: str) -> str:
    """A topic in which a third of the messages come again, some are broken and some have no id, as ``drop_repeats`` stores it."""
    det = inputs.detections(spark, d)

    def topic(path: str) -> None:
        sent = messages.to_messages(inputs.as_message_columns(det)).select("key", "value")
        again = messages.to_messages(inputs.as_message_columns(det.where("event_id % 3 = 0"))).select("key", "value")
        broken = det.where("event_id % 50 = 0").select(F.lit("k").alias("key"), F.concat(F.lit("{broken "), "event_id").alias("value"))
        nameless = det.where("event_id % 70 = 0").select(F.lit("k").alias("key"), F.concat(F.lit('{"frame_number":'), "frame_number", F.lit("}")).alias("value"))
        for part in (sent, again.unionByName(broken), nameless):
            part.coalesce(4).write.mode("append").json(path)

    def run(path: str) -> None:
        source = spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", 4).json(inputs.stored_files(spark, d, "topic_repeats", topic))
        jobs.drop_repeats(source, path, new_path(spark, "cp"), once=True).awaitTermination()

    return inputs.stored_files(spark, d, "dedup_stream", run)


@query("stream_dedup")
def _(spark, d):
    return spark.read.parquet(_dedup_table(spark, d)).select("detection_id", "frame_number", "class_name")


@query("stream_unreadable")
def _(spark, d):
    return jobs.unreadable(spark, _dedup_table(spark, d)).select("value", "frame_number")


# ---- the whole build ---------------------------------------------------------

@query("build_all")
def _(spark, d):
    built = build_all(spark, inputs.raw_detections(spark, d), inputs.osm_nodes(spark, d), new_path(spark, "warehouse"))
    return stats.row_counts({k: built[k] for k in
                             ("stg_perception_data", "stg_osm_ground_truth", "fct_map_audit",
                              "audit_summary_metrics", "discrepancy_details", "checks")})


@query("build_all_summary")
def _(spark, d):
    """The summary mart as the daily build stores it."""
    built = build_all(spark, inputs.raw_detections(spark, d), inputs.osm_nodes(spark, d), new_path(spark, "warehouse"))
    return rounded(built["audit_summary_metrics"], avg_confidence=6, avg_distance_meters=6, min_distance_meters=3, max_distance_meters=3)


@query("build_all_facts")
def _(spark, d):
    """The fact table as the daily build stores it."""
    built = build_all(spark, inputs.raw_detections(spark, d), inputs.osm_nodes(spark, d), new_path(spark, "warehouse"))
    return rounded(built["fct_map_audit"].drop("detection_location"), distance_meters=3)


@query("build_all_published")
def _(spark, d):
    """The summary mart as the current build's schema shows it, after a later run that failed."""
    warehouse, prefix = new_path(spark, "warehouse"), "published_"
    raw, nodes = inputs.raw_detections(spark, d), inputs.osm_nodes(spark, d)
    build_all(spark, raw, nodes, warehouse, schema_prefix=prefix)
    broken = nodes.withColumn("latitude", F.raise_error(F.lit("no position")).cast("double"))
    try:
        build_all(spark, raw, broken, warehouse, schema_prefix=prefix)
    except SparkRuntimeException as error:
        if "no position" not in str(error):
            raise
    return rounded(spark.table(f"{prefix}marts.audit_summary_metrics"),
                   avg_confidence=6, avg_distance_meters=6, min_distance_meters=3, max_distance_meters=3)
