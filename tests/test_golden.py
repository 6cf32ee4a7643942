"""Known answers."""

import math

import pytest
from pyspark.sql import functions as F

from mapaudit.functions import geo, labels
from mapaudit.functions.overlay import best_text, parse_overlay
from mapaudit.operators.compare import compare, comparison_counts, comparison_report
from mapaudit.operators.coverage import coverage_bbox, tile_grid
from mapaudit.operators.projection import project_detections
from mapaudit.operators.quality import future_dates, verification_rate
from mapaudit.operators.staging import detections_flat, flatten_detections
from mapaudit.sources import messages

DET = [(37.7749, -122.4194), (37.7750, -122.4195), (37.7755, -122.4200), (37.7760, -122.4205)]
OSM = [(37.77492, -122.41938), (37.77501, -122.41952), (37.77595, -122.42048), (37.7770, -122.4210)]


def _sides(spark):
    det = spark.createDataFrame([(f"d{i}", *p) for i, p in enumerate(DET, 1)], "detection_id string, latitude double, longitude double")
    osm = spark.createDataFrame([(f"o{i}", *p) for i, p in enumerate(OSM, 1)], "osm_id string, osm_lat double, osm_lon double")
    return det, osm


def test_compare(spark):
    out = compare(*_sides(spark)).collect()
    seen = {r.detection_id: (r.status, r.osm_id, round(r.distance_m, 3)) for r in out if r.status != "missing"}
    assert seen == {"d1": ("verified", "o1", 2.835), "d2": ("verified", "o2", 2.080),
                    "d3": ("new", "o3", 65.449), "d4": ("verified", "o3", 5.831)}
    assert [(r.osm_id, round(r.distance_m, 3)) for r in out if r.status == "missing"] == [("o4", 119.564)]


def test_compare_without_nodes_and_without_detections(spark):
    det, osm = _sides(spark)
    alone = compare(det, osm.limit(0))
    assert {(r.status, r.distance_m) for r in alone.collect()} == {("new", None)} and alone.count() == 4
    report = comparison_report(alone).first()
    assert (report.Status, report.OSM_Lat, report.Distance_m) == ("New Sign Detected", "", "N/A")
    assert {r.status: r.n for r in comparison_counts(compare(det.limit(0), osm)).collect()} == {"missing": 4}


def test_pixel_distance(spark):
    df = spark.createDataFrame([(float(v),) for v in (720, 500, 761, 900, 1000, 1440)], "v double")
    got = [r.d for r in df.select(geo.pixel_distance("v").alias("d")).collect()]
    assert got[:2] == [math.inf, math.inf]
    assert got[2:] == pytest.approx([23.7418, 5.4079, 3.4765, 1.3520], abs=1e-4)


def test_destination(spark):
    df = spark.createDataFrame([(float(b),) for b in (0, 90, 180, 270, 45)], "b double")
    lat, lon = geo.destination(F.lit(37.7749), F.lit(-122.4194), "b", 100.0)
    got = [(round(r.lat, 6), round(r.lon, 6)) for r in df.select(lat.alias("lat"), lon.alias("lon")).collect()]
    assert got == [(37.775799, -122.4194), (37.7749, -122.418262), (37.774001, -122.4194),
                   (37.7749, -122.420538), (37.775536, -122.418595)]


def test_haversine_of_null_is_null(spark):
    row = spark.sql("select cast(null as double) a").select(geo.haversine_m("a", 1.0, 2.0, 3.0).alias("d")).first()
    assert row.d is None


def test_projection_drops_high_rows_unless_all_are_high(spark):
    track = spark.createDataFrame([("v", 1, 43.0, -79.0, 0.0)], "video_name string, frame_number int, lat double, lon double, heading double")
    det = spark.createDataFrame([("v", 1, 500.0), ("v", 1, 900.0), ("v", 2, 900.0)], "video_name string, frame_number int, v double")
    assert [round(r.distance, 4) for r in project_detections(det, track).collect()] == [5.4079]
    assert [r.distance for r in project_detections(det.where("v < 720"), track).collect()] == [30.0]


OVERLAY = [
    ("56 KM/H N43.800114 W79.317977", "18/01/2026 19:15:12", (43.800114, -79.317977, "18/01/2026 19:15:12")),
    ("N43. 792879 W79. 314193", "2026-01-18 19:15:12", (43.792879, -79.314193, "2026-01-18 19:15:12")),
    ("lat: -12.5 lon: 130.25", "on 2026/01/18", (-12.5, 130.25, "2026/01/18")),
    ("s33.86 e151.2", "", (-33.86, 151.2, "")),
    ("N43.8 only", "18/01/2026 19:15:12", (43.79 + 1e-4, -79.314 + 1e-4, "")),
]


def test_overlay(spark):
    df = spark.createDataFrame([(10000, g, t) for g, t, _ in OVERLAY], "frame_number int, gps_text string, ts_text string")
    got = [(r.lat, r.lon, r.recording_timestamp) for r in parse_overlay(df).collect()]
    for g, (_, _, w) in zip(got, OVERLAY):
        assert g[:2] == pytest.approx(w[:2], abs=1e-9) and g[2] == w[2]
    assert parse_overlay(df, fallback=False).collect()[4].lon is None
    assert parse_overlay(df).collect()[4].is_fallback and not parse_overlay(df).collect()[0].is_fallback


def test_best_text_prefers_digits_then_first(spark):
    df = spark.createDataFrame([(1, 1, "a1"), (1, 2, "b22"), (1, 3, "c33")], "frame_number int, variant int, gps_text string")
    assert best_text(df).first().gps_text == "b22"


def test_tiles(spark):
    grid = tile_grid(spark, (43.58, -79.64, 43.86, -79.12), 0.02)
    assert grid.count() == 364 and grid.agg(F.max("tile_no")).first()[0] == 364
    edge = tile_grid(spark, (0.0, 0.0, 0.05, 0.03), 0.02)
    assert edge.count() == 6 and edge.agg(F.max("north"), F.max("east")).first()[:] == (0.05, 0.03)


def test_bbox_without_rows(spark):
    row = coverage_bbox(spark.createDataFrame([], "latitude double, longitude double")).first()
    assert row.min_lat is None and row.total_detections == 0


def test_quality_flag_order(spark):
    rows = [(None, 1.0, 0.1, None), (91.0, 1.0, 0.9, "a"), (1.0, 181.0, 0.9, "a"), (1.0, 1.0, 0.2, None),
            (1.0, 1.0, None, None), (1.0, 1.0, None, "a"), (1.0, 1.0, 0.25, "a")]
    df = spark.createDataFrame(rows, "lat double, lon double, conf double, cls string")
    flag = labels.quality_flag(*map(F.col, ("lat", "lon", "conf", "cls")))
    assert [r.f for r in df.select(flag.alias("f")).collect()] == [
        "missing_coordinates", "invalid_latitude", "invalid_longitude", "low_confidence", "missing_class", "valid", "valid"]


def test_audit_status_and_priority(spark):
    rows = [(None, "stop sign", "x"), (10.0, "Stop Sign", "stop sign"), (10.0, "stop sign", "traffic light"),
            (10.1, "stop sign", "stop sign"), (5.0, None, "stop sign")]
    df = spark.createDataFrame(rows, "d double, a string, b string")
    got = [r.s for r in df.select(labels.audit_status(F.col("d"), F.col("a"), F.col("b"), 10.0).alias("s")).collect()]
    assert got == ["NEW_DISCOVERY", "VERIFIED", "CLASS_MISMATCH", "NEW_DISCOVERY", "UNKNOWN"]
    rows = [("CLASS_MISMATCH", 5.0, 0.1), ("NEW_DISCOVERY", None, 0.8), ("CLASS_MISMATCH", 5.1, 0.9), ("NEW_DISCOVERY", None, 0.7)]
    df = spark.createDataFrame(rows, "s string, d double, c double")
    got = [r.p for r in df.select(labels.action_priority(F.col("s"), F.col("d"), F.col("c")).alias("p")).collect()]
    assert got == ["HIGH", "MEDIUM", "LOW", "INFO"]


def test_rate_check_passes_on_no_rows_and_future_dates_ignore_bad_text(spark):
    schema = "confidence double, audit_status string, recording_timestamp string, video_name string, frame_number int"
    assert verification_rate(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(0.9, "NEW_DISCOVERY", t, "v", 1) for t in ("01/01/2999 00:00:00", "31/02/2999 00:00:00", "", None)], schema)
    assert verification_rate(df).first().verification_rate_pct == 0.0
    assert future_dates(df).count() == 1


def test_messages_drop_nulls_and_come_back(spark):
    det = spark.createDataFrame([("t-1", "v-1", "s-1", 75, 0.5249, "stop sign", None, None), ("t-2", "v-1", "s-1", 76, 0.6, "stop sign", 43.79, -79.314)],
                                "detection_id string, vehicle_id string, session_id string, frame_number int, confidence double, class_name string, vehicle_lat double, vehicle_lon double")
    sent = messages.to_messages(det).orderBy("key")
    first = sent.first()
    assert "vehicle_lat" not in first.value and [h.key for h in first.headers] == ["vehicle_id", "session_id", "class_name"]
    back = {r.detection_id: r for r in messages.from_messages(sent).collect()}
    assert back["t-1"].vehicle_lat is None and (back["t-2"].vehicle_lat, back["t-2"].vehicle_lon) == (43.79, -79.314)


def test_raw_table_survives_bad_json_and_rounds_in_integer_mode(spark):
    good = '{"detection_id":"a","vehicle_lat":43.5,"vehicle_lon":-79.5,"confidence":0.5,"frame_number":"x"}'
    sent = spark.createDataFrame([("a", good), ("b", "{broken")], "key string, value string")
    raw = messages.to_raw(sent, "detections")
    assert raw.where("record_content is null").count() == 1
    row = flatten_detections(raw).first()
    assert (row.latitude, row.frame_number) == (43.5, None)
    row = detections_flat(raw, "integer").first()
    assert (int(row.vehicle_lat), int(row.vehicle_lon), int(row.confidence)) == (44, -80, 1)
