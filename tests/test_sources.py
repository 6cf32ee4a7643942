"""CSV and XML readers and writers."""

import pytest
from pyspark.sql import functions as F

from mapaudit.sources import detections as d
from mapaudit.sources import osm_xml

SHORT = "frame_number,timestamp_sec,u,v,confidence,class_name\n"
GOOD = SHORT + "75,2.500,1737.28,630.06,0.5249,stop sign\n76,2.533,1737.00,630.00,0.61,stop sign\n77,2.567,1730.11,629.5,0.7,traffic light\n"


def test_good_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text(GOOD)
    good, bad = d.read_detections_csv(spark, str(tmp_path / "a.csv"))
    rows = d.enrich(good, "vehicle-9", "session-9").orderBy("frame_number").collect()
    assert len(rows) == 3 and bad.count() == 0
    assert (rows[0].frame_number, rows[0].class_name, rows[0].confidence) == (75, "stop sign", 0.5249)
    assert rows[0].vehicle_id == "vehicle-9" and rows[0].session_id == "session-9" and rows[0].detection_id
    assert rows[0].video_name == "" and rows[0].vehicle_lat is None


BAD = {
    "INVALID,1.0,1,1,0.5,a": "invalid frame_number", "7.0,1.0,1,1,0.5,a": "invalid frame_number",
    " 7,1.0,1,1,0.5,a": "invalid frame_number", "1,INVALID,1,1,0.5,a": "invalid timestamp_sec",
    "1,1.0,x,1,0.5,a": "invalid u", "1,1.0,1,,0.5,a": "invalid v", "1,1.0,1,1,1d,a": "invalid confidence",
    "1,1.0,1,1,0.5": "wrong number of fields", "1,1.0,1,1,0.5,a,b": "wrong number of fields",
}


def test_bad_rows_are_kept_apart_with_their_reason(spark, tmp_path):
    (tmp_path / "a.csv").write_text(SHORT + "\n".join(BAD) + "\n1,1.0,1,1,1e-1,\"a,\"\"b\"\"\"\n")
    good, bad = d.read_detections_csv(spark, str(tmp_path))
    assert [(r.confidence, r.class_name) for r in good.collect()] == [(0.1, 'a,"b"')]
    assert sorted(r.reject_reason for r in bad.collect()) == sorted(BAD.values())


def test_layouts_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text(GOOD)
    (tmp_path / "b.csv").write_text("class_name,confidence,bbox_x1,bbox_y1,bbox_x2,bbox_y2,timestamp_sec,frame_number,heading,vehicle_lat,vehicle_lon\n"
                                    "stop sign,0.9,10,20,30,50,1.5,45,7,43.79,oops\n")
    (tmp_path / "c.csv").write_text("frame_number,timestamp_sec,confidence,class_name\n1,1.0,0.5,a\n")
    good, bad = d.read_detections_csv(spark, str(tmp_path))
    box = good.where("frame_number = 45").first()
    assert (box.u, box.v, box.vehicle_lat, box.vehicle_lon) == (20.0, 35.0, 43.79, None)
    assert good.count() == 4 and [r.reject_reason for r in bad.collect()] == ["missing pixel coordinates"]


def test_failfast(spark, tmp_path):
    (tmp_path / "a.csv").write_text(GOOD)
    assert d.read_detections_csv(spark, str(tmp_path), mode="failfast")[0].agg(F.sum("frame_number")).first()[0] == 228
    (tmp_path / "a.csv").write_text(SHORT + "x,1,1,1,1,a\n")
    with pytest.raises(Exception, match="bad detection row"):
        d.read_detections_csv(spark, str(tmp_path), mode="failfast")[0].collect()


def test_gather_names_videos_after_files(spark, tmp_path):
    (tmp_path / "clip 1.csv").write_text(GOOD)
    (tmp_path / "clip2.csv").write_text("video_name," + SHORT + "own.MP4,1,1.0,1,1,0.5,a\n")
    (tmp_path / "notes.txt").write_text("not a csv")
    got = {(r.video_name, r["count"]) for r in d.gather_detections(spark, str(tmp_path))[0].groupBy("video_name").count().collect()}
    assert got == {("clip 1", 3), ("own.MP4", 1)}


def test_deterministic_ids_repeat(spark, tmp_path):
    (tmp_path / "a.csv").write_text(GOOD)
    ids = [sorted(r.detection_id for r in d.enrich(d.read_detections_csv(spark, str(tmp_path))[0], deterministic_id=True).collect())
           for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 3


NODES = """<?xml version="1.0"?><osm version="0.6">
<node id="1" lat="43.1" lon="-79.1"/>
<node id="2" lat="43.2" lon="-79.2"><tag k="traffic_sign" v=""/><tag k="highway" v="stop"/></node>
<node id="3" lat="43.3" lon="-79.3"><tag k="highway" v="crossing"/><tag k="traffic_sign" v="stop"/></node>
<node id="4" lat="43.4" lon="-79.4"><tag k="highway" v="a"/><tag k="highway" v="b"/></node>
<node id="5" lat="43.5" lon="-79.5"><tag k="shop" v="x"/></node>
<node id="6" lat="43.6" lon="-79.6"><tag k="traffic_sign" v=""/></node>
<node id="7" lat="43.7" lon="-79.7"><tag k="direction" v="n"/><tag k="highway" v="street_lamp"/></node>
</osm>"""


def test_nodes(spark, tmp_path):
    (tmp_path / "a.xml").write_text(NODES)
    got = {r.osm_id: r.osm_type for r in osm_xml.read_osm_nodes(spark, str(tmp_path / "a.xml")).collect()}
    assert got == {"2": "stop", "3": "stop", "4": "b", "6": "unknown", "7": "street_lamp"}
    every = osm_xml.read_nodes(spark, str(tmp_path / "a.xml"))
    assert every.count() == 7
    ids = lambda df: sorted(r.osm_id for r in df.collect())
    assert ids(osm_xml.nodes_by_tag(every, "traffic_sign")) == ["2", "3", "6"]
    assert ids(osm_xml.nodes_by_tag(every, "highway", "stop")) == ["2"]
    assert ids(osm_xml.filter_traffic(every)) == ["2", "3", "6"]
    assert ids(osm_xml.select_nodes(every, osm_xml.INFRASTRUCTURE)) == ["2", "3", "6", "7"]
    assert ids(osm_xml.select_nodes(every, osm_xml.SIGNALS_AND_STOPS, around=(20000, 43.2, -79.2))) == ["2", "3"]
    osm_xml.write_osm_xml(every, str(tmp_path / "out"))
    key = lambda r: (r.osm_id, r.latitude, r.longitude, sorted((r.tags or {}).items()))
    assert sorted(map(key, osm_xml.read_nodes(spark, str(tmp_path / "out")).collect())) == sorted(map(key, every.collect()))


def test_file_without_nodes(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?>\n<osm version="0.6">\n  <note>none</note>\n</osm>')
    assert osm_xml.read_osm_nodes(spark, str(tmp_path / "a.xml")).count() == 0


def test_strict_reader_fails_whatever_is_read(spark, tmp_path):
    import pytest

    (tmp_path / "a.csv").write_text("frame_number,timestamp_sec,u,v,confidence,class_name\n1,2.5,1,2,0.5,stop sign\nx,2.5,1,2,0.5,stop sign\n")
    good, _ = d.read_detections_csv(spark, str(tmp_path), mode="failfast")
    for ask in (lambda: good.count(), lambda: good.select("class_name", "confidence").collect()):
        with pytest.raises(Exception, match="bad detection row"):
            ask()


def test_repeated_tag_key(spark, tmp_path):
    """Any entry of a repeated key can match; the first is the type."""
    (tmp_path / "r.xml").write_text(
        '<osm><node id="1" lat="1" lon="2"><tag k="highway" v="stop"/><tag k="highway" v="crossing"/></node>'
        '<node id="2" lat="1" lon="2"><tag k="highway" v="give_way"/></node><node id="3" lat="1" lon="2"/></osm>')
    nodes = osm_xml.read_nodes(spark, str(tmp_path / "r.xml"), keep_entries=True)
    assert [[r.osm_id for r in osm_xml.nodes_by_tag(nodes, "highway", v).collect()] for v in ("stop", "crossing", "none")] == [["1"], ["1"], []]
    assert sorted((r.osm_id, r.type) for r in osm_xml.nodes_by_tag(nodes, "highway").collect()) == [("1", "stop"), ("2", "give_way")]
    assert {r.osm_id: r.tags.get("highway") for r in nodes.collect()} == {"1": "crossing", "2": "give_way", "3": None}


def test_odd_lines_keep_their_place(spark, tmp_path):
    """Quotes, blank lines, other line ends and short lines: one pass and the split scan give the same rows."""
    text = ("﻿" + SHORT.replace("\n", "\r\n") + '1,1.0,1,1,0.5,"a, ""b"""\r\n\r\n   \r\n2,1.0,1\r\n3,1.0,1,1,0.5,\r\n4,1.0,1,1,0.5,"open\r\n5,1.0,1,1,0.5,é')
    (tmp_path / "odd.csv").write_text(text, newline="")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text(SHORT)
    key = lambda rows: sorted(((r.source_file, r.block_start, r.line_in_block, r.frame_number, r.u, r.class_name) for r in rows))
    whole, rejected = d.read_detections_csv(spark, str(tmp_path), keep_place=True)
    split, rejected_too = d.read_detections_csv(spark, str(tmp_path), keep_place=True, whole_bytes=-1)
    assert key(whole.collect()) == key(split.collect())
    assert [(r.line_in_block, r.frame_number, r.class_name) for r in whole.orderBy("line_in_block").collect()] == [
        (0, 1, 'a, "b"'), (2, 3, ""), (3, 4, "open"), (4, 5, "é")]
    assert [(r.reject_reason, r.line) for r in rejected.collect()] == [(r.reject_reason, r.line) for r in rejected_too.collect()] \
        == [("wrong number of fields", "2,1.0,1")]


def test_broken_files_are_listed(spark, tmp_path):
    import gzip

    (tmp_path / "good.csv").write_text(GOOD)
    (tmp_path / "latin.csv").write_bytes(GOOD.encode() + b"\xff\xfe")
    (tmp_path / "empty.csv").write_text("\n \n")
    rows, rejected = d.gather_detections(spark, str(tmp_path), skip_unreadable=True)
    assert {r.video_name for r in rows.collect()} == {"good"} and rejected.count() == 0
    failed = {r.source_file.rsplit("/", 1)[1]: r.reason for r in d.gather_failures(spark, str(tmp_path)).collect()}
    assert set(failed) == {"latin.csv", "empty.csv"} and failed["empty.csv"] == "ValueError: no header" and "UnicodeDecodeError" in failed["latin.csv"]
    packed = tmp_path / "packed"
    packed.mkdir()
    (packed / "a.csv.gz").write_bytes(gzip.compress(GOOD.encode()))
    assert d.read_detections_csv(spark, str(packed))[0].count() == 3
    (packed / "b.csv.gz").write_bytes(gzip.compress(GOOD.encode())[:40])
    with pytest.raises(Exception, match="b.csv.gz"):
        d.read_detections_csv(spark, str(packed))[0].count()


def test_broken_tiles_are_listed(spark, tmp_path):
    from mapaudit.operators.coverage import merge_tile_files

    node = '<node id="{}" lat="{}" lon="2"><tag k="highway" v="{}"/></node>'
    head = '<?xml version="1.0"?>\n<osm version="0.6">'
    (tmp_path / "t1.xml").write_text(head + node.format(1, 1.5, "stop") + node.format(2, 2.5, "a") + "</osm>")
    (tmp_path / "t2.xml").write_text(head + node.format(2, 9.5, "b") + node.format(3, 3.5, "c") + "</osm>")
    (tmp_path / "t3.xml").write_text(head + node.format(4, 4.5, "d") + '<node id="5" lat="1')
    (tmp_path / "t4.xml").write_text("rate limited, try again")
    (tmp_path / "t5.xml").write_text("\n")
    (tmp_path / "t6.xml").write_text('<osm version="0.6"><note>none</note></osm>')
    nodes, failed = merge_tile_files(spark, str(tmp_path))
    assert sorted((r.osm_id, r.latitude, r.tags["highway"]) for r in nodes.collect()) == [("1", 1.5, "stop"), ("2", 2.5, "a"), ("3", 3.5, "c")]
    assert sorted(r.source_file[-6:] for r in failed.collect()) == ["t3.xml", "t4.xml", "t5.xml"]


def test_around_is_pushed_into_the_scan(spark, tmp_path):
    """The bounds reach the scan, skip files, and lose nothing at the date line, at a pole or on the circle itself."""
    import random

    from mapaudit.functions.geo import haversine_m

    rng = random.Random(5)
    at = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(3000)] + [(rng.uniform(-20, 20), rng.choice([-180.0, 180.0, 179.9, -179.9])) for _ in range(500)]
    nodes = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate([*at, (None, None), (1.0, 181.5)])], "osm_id string, latitude double, longitude double")
    nodes = nodes.withColumn("tags", F.create_map(F.lit("highway"), F.lit("stop")))
    osm_xml.write_nodes_by_place(nodes, str(tmp_path / "n"), files=16)
    stored = spark.read.parquet(str(tmp_path / "n"))
    assert stored.count() == nodes.count() and stored.columns == nodes.columns
    for metres, lat, lon in ((2e6, 0.0, 179.5), (1e6, 88.0, 10.0), (5e5, 43.7, -79.4), (2.1e7, 10.0, 10.0), (3e6, -60.0, -170.0)):
        found = osm_xml.select_nodes(stored, osm_xml.SIGNALS_AND_STOPS[1:2], around=(metres, lat, lon))
        want = nodes.where(haversine_m("latitude", "longitude", lat, lon) <= metres)
        assert sorted(r.osm_id for r in found.collect()) == sorted(r.osm_id for r in want.collect())
    near = osm_xml.select_nodes(stored, osm_xml.SIGNALS_AND_STOPS[1:2], around=(5e5, 43.7, -79.4))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = near._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(latitude" in pushed and "LessThanOrEqual(longitude" in pushed
    extent = stored.groupBy(F.input_file_name().alias("f")).agg(*[g(c) for c in ("latitude", "longitude") for g in (F.min, F.max)]).collect()
    assert sum(r[1] is not None and r[1] <= 48.2 and r[2] >= 39.2 and r[3] <= -73 and r[4] >= -86 for r in extent) <= 6


def test_failures_are_found_without_the_rows(spark, tmp_path):
    """Listing broken files sends a row for each file out of the tasks, not the files' lines."""
    from mapaudit.sources.files import csv_status, open_files

    texts = {"a.csv": b"frame_number,u\n" + b"1,2\n" * 500, "b.csv": "frame_number,u\n1,2\n".encode("utf-16"), "c.csv": b"\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    found = csv_status(open_files(spark, [str(tmp_path)], "*.csv"), ["frame_number", "u"], "strict").collect()
    reasons = {r.source_file.rsplit("/", 1)[-1]: (r.failure or "").split(":")[0] for r in found}
    assert len(found) == 3 and reasons == {"a.csv": "", "b.csv": "UnicodeDecodeError", "c.csv": "ValueError"}
