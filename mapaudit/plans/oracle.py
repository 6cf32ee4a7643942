"""The same results in plain SQL, for an independent engine.

Spatial joins are brute force here on purpose: nothing is shared with the grid.
"""

from __future__ import annotations

from mapaudit.functions.overlay import (
    FALLBACK_LAT, FALLBACK_LON, HEADING, LAT_HEMISPHERE, LAT_LABEL, LON_HEMISPHERE, LON_LABEL, SPEED, TIME_PATTERNS,
)
from mapaudit.inputs import BOXES_SQL, DET_DUCK, OSM_SQL, OVERLAY_SQL, READINGS_SQL, TILE_NODES_SQL, TRACK_SQL


def hav(a: str, b: str, c: str, d: str) -> str:
    return (f"(2 * 6371000e0 * asin(least(1e0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * "
            f"cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))")


_CTES = {
    "det": DET_DUCK,
    "osm": OSM_SQL,
    "track": TRACK_SQL,
    "boxes": BOXES_SQL,
    "overlay": OVERLAY_SQL,
    "readings": READINGS_SQL,
    "tile_nodes": TILE_NODES_SQL,
    "tagged": """
select o.*, p.p_name as name, case when o.osm_type = 'crossing' then p.p_brand end as crossing
from osm o join part p on o.osm_id = cast(p.p_partkey as varchar)""",
    "flagged": """
select *, case when vehicle_lat is null or vehicle_lon is null then 'missing_coordinates'
  when vehicle_lat < -90 or vehicle_lat > 90 then 'invalid_latitude'
  when vehicle_lon < -180 or vehicle_lon > 180 then 'invalid_longitude'
  when confidence < 25e-2 then 'low_confidence'
  when class_name is null then 'missing_class' else 'valid' end as data_quality_flag
from det""",
    "nodes": """
select osm_id, latitude, longitude, osm_type, case when lower(osm_type) = 'traffic_signals' then 'traffic light'
  when lower(osm_type) = 'stop' then 'stop sign' when lower(osm_type) like '%crossing%' then 'pedestrian crossing'
  else lower(osm_type) end as normalized_type
from osm""",
    "located": "select * from det where vehicle_lat is not null and vehicle_lon is not null",
    "every_pair": f"""
select d.*, o.osm_id, o.osm_type, o.latitude as osm_lat, o.longitude as osm_lon,
  {hav('d.vehicle_lat', 'd.vehicle_lon', 'o.latitude', 'o.longitude')} as dist
from located d cross join osm o""",
    "pairs100": "select * from every_pair where dist <= 100",
    "nearest": """
select * from (select *, row_number() over (partition by detection_id order by dist, osm_id) as rn from every_pair) t
where rn = 1""",
    "matched": f"""
select d.*, o.osm_id, o.normalized_type, o.latitude as osm_lat, o.longitude as osm_lon,
  case when o.osm_id is not null then {hav('d.vehicle_lat', 'd.vehicle_lon', 'o.latitude', 'o.longitude')} end as dist
from (select * from flagged where data_quality_flag = 'valid') d
left join nodes o on {hav('d.vehicle_lat', 'd.vehicle_lon', 'o.latitude', 'o.longitude')} <= 100""",
    "ranked": """
select *, rank() over (partition by video_name, frame_number order by dist asc nulls last) as rk from matched""",
    "counts": f"""
select d.detection_id, d.class_name, count(o.osm_id) as n from located d left join osm o
on {hav('d.vehicle_lat', 'd.vehicle_lon', 'o.latitude', 'o.longitude')} <= 50 group by 1, 2""",
    "compared": f"""
select case when dist < 10 then 'verified' else 'new' end as status, detection_id,
  vehicle_lat as detected_lat, vehicle_lon as detected_lon, osm_id, osm_lat, osm_lon, dist from nearest
union all
select 'missing', detection_id, vehicle_lat, vehicle_lon, osm_id, osm_lat, osm_lon, dist from (
  select *, row_number() over (partition by osm_id order by dist, detection_id) as rn from every_pair) t
where rn = 1 and dist >= 15""",
}
# Which tables each one is built on.
_NEEDS = {
    "track": ["det"], "boxes": ["det"], "overlay": ["det"], "readings": ["det"], "tile_nodes": ["osm"], "tagged": ["osm"],
    "flagged": ["det"], "nodes": ["osm"], "located": ["det"], "every_pair": ["located", "osm"], "pairs100": ["every_pair"],
    "nearest": ["every_pair"], "matched": ["flagged", "nodes"], "ranked": ["matched"], "counts": ["located", "osm"],
    "compared": ["nearest", "every_pair"],
}


def _fct(threshold: int) -> str:
    return f"""
select detection_id, video_name, frame_number, timestamp_sec as timestamp_ms, class_name as detected_class, confidence,
  vehicle_lat as detected_lat, vehicle_lon as detected_lon, vehicle_id, recording_timestamp,
  osm_id as nearest_osm_node_id, normalized_type as osm_class, osm_lat, osm_lon, dist as distance_meters,
  case when dist is null then 'NEW_DISCOVERY'
    when dist <= {threshold} and lower(class_name) = lower(normalized_type) then 'VERIFIED'
    when dist <= {threshold} and lower(class_name) <> lower(normalized_type) then 'CLASS_MISMATCH'
    when dist > {threshold} then 'NEW_DISCOVERY' else 'UNKNOWN' end as audit_status
from ranked where rk = 1"""


_CTES["fct"], _CTES["fct10"] = _fct(100), _fct(10)
_NEEDS["fct"] = _NEEDS["fct10"] = ["ranked"]
_PRIORITY = """case when audit_status = 'CLASS_MISMATCH' and distance_meters <= 5 then 'HIGH'
  when audit_status = 'NEW_DISCOVERY' and confidence >= 8e-1 then 'MEDIUM'
  when audit_status = 'CLASS_MISMATCH' and distance_meters > 5 then 'LOW' else 'INFO' end"""
for _name in ("", "10"):
    _CTES["review" + _name] = f"""
select *, {_PRIORITY} as action_priority from fct{_name} where audit_status in ('CLASS_MISMATCH', 'NEW_DISCOVERY')"""
    _NEEDS["review" + _name] = ["fct" + _name]


def using(tables: str, select: str) -> str:
    """``select`` with the named tables, and what they need, as CTEs."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in tables.split():
        need(name)
    return "with " + ",\n".join(f"{n} as ({_CTES[n]})" for n in order) + "\n" + select


_DATE = "cast(try_strptime(recording_timestamp, '%d/%m/%Y %H:%M:%S') as date)"
_GOOD = "event_id % 101 <> 0 and event_id % 103 <> 0"
_TOPIC = f"""select 'vehicle-001' as vehicle_id, video_name, frame_number, u as pixel_u, v as pixel_v, confidence,
  coalesce(class_name, '') as class_name, vehicle_lat, vehicle_lon from det where {_GOOD}"""
_CSV_COLUMNS = """video_name, frame_number, timestamp_sec, u, v, confidence, coalesce(class_name, '') as class_name,
  vehicle_lat, vehicle_lon, recording_timestamp"""


def _rate(condition: str, total: str = "count(*)") -> str:
    return f"1e2 * cast(sum(case when {condition} then 1 else 0 end) as double) / nullif({total}, 0)"


def _n(condition: str) -> str:
    return f"cast(coalesce(sum(case when {condition} then 1 else 0 end), 0) as bigint)"


def _summary(fct: str) -> str:
    return using(fct, f"""
select {_DATE} as audit_date, detected_class, audit_status, count(*) as detection_count,
  round(avg(confidence), 6) as avg_confidence, round(avg(distance_meters), 6) as avg_distance_meters,
  round(min(distance_meters), 3) as min_distance_meters, round(max(distance_meters), 3) as max_distance_meters,
  round({_rate("audit_status = 'VERIFIED'")}, 2) as verification_rate_pct
from {fct} group by 1, 2, 3""")


def _fact(fct: str) -> str:
    return using(fct, f"select * replace (round(distance_meters, 3) as distance_meters) from {fct}")


def _flat(mode: str) -> str:
    def num(c: str, name: str) -> str:
        return f"round({c}) + 0e0 as {name}" if mode == "integer" else f"{c} as {name}"

    return using("det", f"""
select detection_id, vehicle_id, 'session-1' as session_id, date_trunc('millisecond', ingested_at) as detection_timestamp,
  frame_number, {num('timestamp_sec', 'timestamp_sec')}, {num('u', 'pixel_u')}, {num('v', 'pixel_v')},
  {num('confidence', 'confidence')}, {num('vehicle_lat', 'vehicle_lat')}, {num('vehicle_lon', 'vehicle_lon')},
  class_name, vehicle_lat is not null as has_location, 'detections' as kafka_topic, ingested_at as kafka_timestamp
from det""")


def _point(lat: str, lon: str, bearing: str, metres: str) -> tuple[str, str]:
    delta = f"({metres} / 6371000e0)"
    lat2 = (f"asin(sin(radians({lat})) * cos({delta}) + cos(radians({lat})) * sin({delta}) * cos(radians({bearing})))")
    lon2 = (f"radians({lon}) + atan2(sin(radians({bearing})) * sin({delta}) * cos(radians({lat})), "
            f"cos({delta}) - sin(radians({lat})) * sin({lat2}))")
    return f"round(degrees({lat2}), 9)", f"round(degrees({lon2}), 9)"


def _ground(v: str, horizon: str = "72e1") -> str:
    return (f"case when {v} - {horizon} <= 0 then cast('inf' as double) else "
            f"14e-1 / tan(atan((({v} - {horizon}) / 72e1) * tan(radians(46e0)))) end")


def _project(horizon: str) -> str:
    lat, lon = _point("lat", "lon", "heading", "distance")
    return using("track", f"""
select detection_id, round(distance, 6) as distance, {lat} as object_lat, {lon} as object_lon from (
  select d.detection_id, t.lat, t.lon, t.heading,
    case when (select max(v) from det) <= {horizon} then 3e1 else {_ground('d.v', horizon)} end as distance
  from det d join track t on d.video_name = t.video_name and d.frame_number = t.frame_number) p
where distance < cast('inf' as double)""")


def _number(text: str) -> str:
    return f"try_cast(replace(replace({text}, ' ', ''), chr(10), '') as double)"


def _found(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"


def _coordinate(hemisphere: str, label: str, negative: str) -> str:
    size = _number(_found("gps_text", hemisphere, 2))
    return (f"coalesce(case when upper(regexp_extract(gps_text, '{hemisphere}', 1)) = '{negative}' then -abs({size}) "
            f"else {size} end, {_number(_found('gps_text', label))})")


_BOX = """select min(vehicle_lat) as a, max(vehicle_lat) as b, min(vehicle_lon) as c, max(vehicle_lon) as d, count(*) as n
from det where vehicle_lat is not null"""
_WIDE = f"""select a - (b - a) * 1e-1 as min_lat, c - (d - c) * 1e-1 as min_lon, b + (b - a) * 1e-1 as max_lat,
  d + (d - c) * 1e-1 as max_lon, n as total_detections from ({_BOX}) box"""
_TRAFFIC = "osm_type in ('traffic_signals', 'stop', 'give_way', 'speed_camera')"


def _pairs(radius: int) -> str:
    return using("every_pair", f"""
select detection_id, class_name, osm_id, osm_type, round(dist, 3) as distance_meters from every_pair where dist < {radius}""")


_HISTOGRAM_EDGES = [f"{i} * 1e-1" for i in range(1, 10)]
_BIN = " + ".join(f"case when confidence >= {e} then 1 else 0 end" for e in _HISTOGRAM_EDGES)
_TIME_BIN = " + ".join(f"case when timestamp_sec > lo + step * {i} then 1 else 0 end" for i in range(20))

_PARSED = f"""(select *, lat is null or lon is null as lost from (
  select event_id, frame_number, {_coordinate(LAT_HEMISPHERE, LAT_LABEL, 'S')} as lat,
    {_coordinate(LON_HEMISPHERE, LON_LABEL, 'W')} as lon,
    coalesce({_number(_found('gps_text', SPEED))}, {_number(_found('gps_text', HEADING))}) as speed_or_heading,
    coalesce({', '.join(_found('ts_text', p) for p in TIME_PATTERNS)}) as stamp
  from overlay) a)"""

ORACLE: dict[str, str] = {
    "read_detections_csv": using("det", f"select {_CSV_COLUMNS} from det where {_GOOD}"),
    "read_detections_rejected": using("det", f"""
select case when event_id % 101 = 0 then 'invalid frame_number' else 'invalid confidence' end as reject_reason,
  count(*) as n from det where not ({_GOOD}) group by 1"""),
    "read_detections_bbox": using("boxes", """
select frame_number, (x1 + x2) / 2e0 as u, (y1 + y2) / 2e0 as v, confidence, class_name from boxes"""),
    "read_detections_strict": using("boxes", """
select class_name, count(*) as n, cast(sum(frame_number) as bigint) as frames from boxes group by 1"""),
    "gather_detection_files": using("det", f"select {_CSV_COLUMNS} from det where {_GOOD}"),
    "gather_readable_files": using("det", """
select video_name, frame_number, u, v, confidence, coalesce(class_name, '') as class_name from det
where cast(floor(event_id / 1000) as int) % 4 <> 3"""),
    "gather_failed_files": using("det", """
select distinct cast(floor(event_id / 1000) as int) as video, 'UnicodeDecodeError' as reason from det
where cast(floor(event_id / 1000) as int) % 4 = 3"""),
    "enrich_detections": using("det", """
select 'vehicle-7' as vehicle_id, 'session-9' as session_id,
  sha256(concat_ws(chr(10), 'vehicle-7', 'session-9', video_name, '0', cast(event_id as varchar))) as detection_id, video_name, frame_number, u as pixel_u, v as pixel_v,
  confidence, class_name, vehicle_lat, vehicle_lon, recording_timestamp from det"""),
    "detection_to_message": using("det", """
select detection_id as key, 3 as n_headers, 'vehicle_id' as first_header, vehicle_id as first_value,
  11 + case when class_name is null then 0 else 1 end + case when vehicle_lat is null then 0 else 2 end as n_fields
from det"""),
    "message_to_detection": using("det", """
select detection_id, vehicle_id, video_name, frame_number, timestamp_sec, u as pixel_u, v as pixel_v, confidence,
  class_name, vehicle_lat, vehicle_lon, recording_timestamp from det"""),
    "load_raw_detections": using("det", """
select detection_id as message_key, class_name, vehicle_lat, 'detections' as kafka_topic, 0 as kafka_partition,
  ingested_at as kafka_timestamp from det"""),
    "raw_time_window": using("det", """
select detection_id as message_key, ingested_at as kafka_timestamp from det
where ingested_at >= timestamp '2024-01-10 06:00:00' and ingested_at < timestamp '2024-01-11 18:30:00'"""),
    "read_osm_xml": using("tagged", """
select osm_id, osm_type, latitude, longitude, name, crossing, case when crossing is null then 2 else 3 end as n_tags
from tagged"""),
    "osm_nodes_by_tag": using("tagged", """
select osm_id, latitude, longitude, cast(null as varchar) as type from tagged where osm_type = 'traffic_signals'
union all select osm_id, latitude, longitude, crossing from tagged where crossing is not null"""),
    "append_osm_reference": using("osm", """
select f as source_file, count(*) as nodes, count(distinct osm_type) as types
from osm cross join (select 'first.xml' as f union all select 'second.xml') s group by 1"""),
    "write_osm_xml": using("tagged", """
select osm_id, latitude, longitude,
  case when crossing is null then 'highway,name' else 'crossing,highway,name' end as keys from tagged"""),
    "export_comparison": using("compared", """
select case status when 'verified' then 'Verified' when 'new' then 'New Sign Detected' else 'Missing Sign on Road' end as "Status",
  case when status = 'missing' then cast(detected_lat as varchar) else printf('%.6f', detected_lat) end as "Detected_Lat",
  case when status = 'missing' then cast(detected_lon as varchar) else printf('%.6f', detected_lon) end as "Detected_Lon",
  printf('%.6f', osm_lat) as "OSM_Lat", printf('%.6f', osm_lon) as "OSM_Lon", printf('%.2f', dist) as "Distance_m"
from compared"""),
    "export_detections": using("det", """
select video_name, frame_number, printf('%.3f', timestamp_sec) as timestamp_sec, printf('%.2f', u) as u,
  printf('%.2f', v) as v, printf('%.4f', confidence) as confidence, coalesce(class_name, '') as class_name,
  coalesce(printf('%.6f', vehicle_lat), '') as vehicle_lat, coalesce(printf('%.6f', vehicle_lon), '') as vehicle_lon,
  recording_timestamp from det"""),
    "export_filtered": using("det", """
select detection_id, class_name, confidence from det where class_name = 'stop sign' and confidence >= 5e-1"""),
    "materialize": using("det", "select class_name, count(*) as count from det group by 1"),

    "stg_perception_flatten": using("det", """
select video_name, frame_number, timestamp_sec as timestamp_ms, class_name as object_class, confidence,
  vehicle_lat as latitude, vehicle_lon as longitude, vehicle_id, recording_timestamp, ingested_at from det"""),
    "stg_perception_data": using("flagged", """
select video_name, frame_number, timestamp_sec as timestamp_ms, class_name as object_class, confidence,
  vehicle_lat as latitude, vehicle_lon as longitude, vehicle_id, recording_timestamp, ingested_at, data_quality_flag
from flagged where vehicle_lat between -90 and 90 and vehicle_lon between -180 and 180"""),
    "quality_flag_counts": using("flagged", "select data_quality_flag, count(*) as n from flagged group by 1"),
    "vw_detections_flat": _flat("double"),
    "vw_detections_flat_integer": _flat("integer"),
    "stg_osm_ground_truth": using("tagged nodes", """
select t.osm_id, t.latitude, t.longitude, n.normalized_type, t.osm_type as original_osm_type, t.name as location_name,
  t.crossing as crossing_type from tagged t join nodes n on t.osm_id = n.osm_id"""),
    "raw_gps_sample": using("located", """
select detection_id, class_name, vehicle_lat, vehicle_lon, recording_timestamp, confidence, ingested_at
from located order by detection_id limit 5"""),
    "audit_status": using("fct10", "select audit_status, count(*) as n from fct10 group by 1"),
    "action_priority": using("review10", """
select audit_status, action_priority, count(*) as n from review10 group by 1, 2"""),
    "map_points": using("fct", """
select detected_lat as lat, detected_lon as lon, detected_class as class_name, audit_status as verification_status,
  confidence, detection_id from fct
where detected_lat between 435e-1 and 44e0 and detected_lon between -796e-1 and -79e0
order by detection_id, nearest_osm_node_id nulls first limit 50000"""),
    "filter_class_confidence": using("det", """
select detection_id, class_name, confidence from det where class_name = 'stop sign' and confidence >= 5e-1"""),
    "frame_time_window": using("det", """
select detection_id, timestamp_sec, class_name from det where timestamp_sec between 295e-1 and 305e-1"""),
    "osm_selector": using("osm", f"""
select osm_id, osm_type, latitude, longitude from osm where {_TRAFFIC}
  and latitude between 436e-1 and 438e-1 and longitude between -795e-1 and -792e-1"""),
    "osm_selector_around": using("tagged", f"""
select osm_id, osm_type from tagged where (osm_type in ('traffic_signals', 'stop') or crossing = 'traffic_signals')
  and {hav('latitude', 'longitude', '437e-1', '-794e-1')} <= 9000"""),
    "osm_selector_by_place": using("tagged", f"""
select osm_id, osm_type from tagged where (osm_type in ('traffic_signals', 'stop') or crossing = 'traffic_signals')
  and {hav('latitude', 'longitude', '437e-1', '-794e-1')} <= 9000"""),
    "osm_selector_tiles": using("osm", """
select cast(floor((latitude - 4358e-2) / 2e-2) * 26 + floor((longitude + 7964e-2) / 2e-2) + 1 as bigint) as tile_no, count(*) as nodes
from osm where latitude between 4358e-2 and 4386e-2 and longitude between -7964e-2 and -7912e-2
  and osm_type in ('traffic_signals', 'stop', 'give_way') group by 1"""),
    "extract_detections": using("boxes", """
select video_name, frame_number, frame_number / 30e0 as timestamp_sec, (x1 + x2) / 2e0 as u, cast(y2 as double) as v,
  confidence, class_name,
  cast(greatest(0, floor((x1 + x2) / 2e0) - half) as int) as roi_x1, cast(greatest(0, floor((y1 + y2) / 2e0) - half) as int) as roi_y1,
  cast(least(2560, floor((x1 + x2) / 2e0) + half) as int) as roi_x2, cast(least(1440, floor((y1 + y2) / 2e0) + half) as int) as roi_y2,
  event_id
from (select *, floor(greatest(x2 - x1, y2 - y1) / 2e0) as half from boxes) b
where frame_number % 30 = 0 and confidence >= 25e-2 and class_name in ('stop sign', 'traffic light')"""),
    "filter_traffic_nodes": using("osm", f"select osm_id, osm_type from osm where {_TRAFFIC}"),
    "parse_overlay": using("overlay", f"""
select event_id, round(case when lost then {FALLBACK_LAT!r} + frame_number / 1e4 * 1e-4 else lat end, 9) as lat,
  round(case when lost then {FALLBACK_LON!r} + frame_number / 1e4 * 1e-4 else lon end, 9) as lon, speed_or_heading,
  case when lost then '' else coalesce(stamp, '') end as recording_timestamp
from {_PARSED} b"""),
    "overlay_fallbacks": using("overlay", f"""
select lost as is_fallback, count(*) as frames, cast(sum(case when not lost and stamp is not null then 1 else 0 end) as bigint) as with_time
from {_PARSED} b group by 1"""),
    "best_overlay_text": using("readings", """
select frame_number, gps_text from (select *, row_number() over (partition by frame_number
  order by length(regexp_replace(gps_text, '[^0-9]', '', 'g')) desc, variant) as rn from readings) r where rn = 1"""),

    "make_point": using("osm", """
select osm_id, concat('POINT(', cast(cast(longitude as decimal(10,7)) as varchar), ' ',
  cast(cast(latitude as decimal(10,7)) as varchar), ')') as point from osm"""),
    "haversine_m": using("located", f"""
select detection_id, round({hav('vehicle_lat', 'vehicle_lon', '4379e-2', '-79314e-3')}, 3) as distance_m from located"""),
    "destination_point": using("track", "select video_name, frame_number, {} as lat, {} as lon from track".format(
        *_point("lat", "lon", "heading", "1e2"))),
    "pixel_to_distance": using("det", f"select detection_id, v, round({_ground('v')}, 6) as distance from det"),
    "project_detections": _project("72e1"),
    "project_detections_all_above": _project("5e3"),
    "coverage_bbox": using("det", f"""
select round(min_lat, 9) as min_lat, round(min_lon, 9) as min_lon, round(max_lat, 9) as max_lat,
  round(max_lon, 9) as max_lon, total_detections from ({_WIDE}) w"""),
    "tile_grid": using("det", f"""
select r * n + c + 1 as tile_no, round(min_lat + r * 2e-2, 9) as south, round(min_lon + c * 2e-2, 9) as west,
  round(least(min_lat + r * 2e-2 + 2e-2, max_lat), 9) as north, round(least(min_lon + c * 2e-2 + 2e-2, max_lon), 9) as east
from (select *, unnest(range(cast(n as bigint))) as c from (
  select *, cast(ceil(round((max_lon - min_lon) / 2e-2, 9)) as bigint) as n,
    unnest(range(cast(ceil(round((max_lat - min_lat) / 2e-2, 9)) as bigint))) as r from ({_WIDE}) w) x) y"""),
    "nodes_per_tile": using("osm", """
select cast(floor((latitude - 4358e-2) / 2e-2) * 26 + floor((longitude + 7964e-2) / 2e-2) + 1 as bigint) as tile_no, count(*) as nodes
from osm where latitude between 4358e-2 and 4386e-2 and longitude between -7964e-2 and -7912e-2 group by 1
union all select null, count(*) from osm
where not (latitude between 4358e-2 and 4386e-2 and longitude between -7964e-2 and -7912e-2) having count(*) > 0"""),
    "merge_tiles": using("tile_nodes", """
select osm_id, osm_type, latitude, longitude, tile_no from (
  select *, row_number() over (partition by osm_id order by tile_no, osm_type) as rn from tile_nodes) t where rn = 1"""),
    "merge_tiles_xml": using("tile_nodes", """
select osm_id, osm_type, latitude, longitude, tile_no from (
  select *, row_number() over (partition by osm_id order by cast(tile_no as varchar)) as rn
  from tile_nodes where tile_no % 5 <> 0) t where rn = 1"""),
    "merge_tiles_failed": using("tile_nodes", """
select distinct tile_no, 'no well-formed XML' as reason from tile_nodes where tile_no % 5 = 0"""),
    "tile_counts": using("tile_nodes", """
select tile_no, count(*) as node_count from tile_nodes group by 1
union all select null, count(distinct osm_id) from tile_nodes"""),
    "centroid": using("osm", """
select round(avg(latitude), 9) as center_lat, round(avg(longitude), 9) as center_lon from osm"""),

    "radius_join_left": using("pairs100", """
select d.detection_id, d.class_name, p.osm_id, p.osm_type, round(p.dist, 3) as distance_m
from det d left join pairs100 p on d.detection_id = p.detection_id"""),
    "radius_join_inner": using("every_pair", """
select detection_id, class_name as detected_class, recording_timestamp, confidence, osm_id, osm_type,
  round(dist, 2) as distance_meters from every_pair where dist <= 50"""),
    "proximity_pairs": _pairs(50),
    "proximity_pairs_100m": _pairs(100),
    "nearest_node": using("nearest", """
select detection_id, class_name as detection_class, osm_id, osm_type, round(dist, 3) as distance_meters from nearest"""),
    "nearest_node_far": using("located osm", f"""
select detection_id, class_name as detection_class, osm_id, osm_type, round(dist, 3) as distance_meters from (
  select *, row_number() over (partition by detection_id order by dist, osm_id) as rn from (
    select d.*, o.osm_id, o.osm_type, {hav('(d.vehicle_lat + 0.54)', 'd.vehicle_lon', 'o.latitude', 'o.longitude')} as dist
    from located d cross join osm o) p) t where rn = 1"""),
    "nearest_within_radius": using("located nodes", f"""
select detection_id, video_name, frame_number, osm_id as nearest_osm_node_id, round(dist, 3) as distance_meters from (
  select *, rank() over (partition by video_name, frame_number order by dist asc nulls last) as rk from (
    select d.*, o.osm_id, case when o.osm_id is not null then
      {hav('d.vehicle_lat', 'd.vehicle_lon', 'o.latitude', 'o.longitude')} end as dist
    from located d left join nodes o on {hav('d.vehicle_lat', 'd.vehicle_lon', 'o.latitude', 'o.longitude')} <= 100) m) r
where rk = 1"""),
    "nearest_within_radius_per_detection": using("located nodes", f"""
select detection_id, osm_id as nearest_osm_node_id, round(dist, 3) as distance_meters from (
  select *, rank() over (partition by detection_id order by dist asc nulls last) as rk from (
    select d.*, o.osm_id, case when o.osm_id is not null then
      {hav('d.vehicle_lat', 'd.vehicle_lon', 'o.latitude', 'o.longitude')} end as dist
    from located d left join nodes o on {hav('d.vehicle_lat', 'd.vehicle_lon', 'o.latitude', 'o.longitude')} <= 100) m) r
where rk = 1"""),
    "compare_bidirectional": using("compared", """
select status, detection_id, osm_id, round(dist, 3) as distance_m from compared"""),
    "track_lookup": using("track", """
select d.detection_id, d.video_name, d.frame_number, t.heading from det d
join track t on d.video_name = t.video_name and d.frame_number = t.frame_number"""),
    "fct_map_audit": _fact("fct"),
    "fct_map_audit_t10": _fact("fct10"),

    "audit_summary_metrics": _summary("fct"),
    "audit_summary_metrics_t10": _summary("fct10"),
    "summary_metrics": using("fct", f"""
select count(*) as total_detections, {_n("audit_status = 'VERIFIED'")} as verified_count,
  {_n("audit_status = 'NEW_DISCOVERY'")} as new_discovery_count,
  {_n("audit_status = 'CLASS_MISMATCH'")} as class_mismatch_count,
  round({_rate("audit_status = 'VERIFIED'")}, 6) as avg_verification_rate from fct"""),
    "class_breakdown": using("fct10", """
select detected_class as class_name, audit_status as verification_status, count(*) as count from fct10 group by 1, 2"""),
    "verification_trend": using("fct", f"""
select {_DATE} as detection_date, count(*) as total_detections,
  round({_rate("audit_status = 'VERIFIED'")}, 6) as verification_rate
from fct where {_DATE} is not null group by 1 order by 1 desc limit 30"""),
    "matches_per_detection": using("counts", "select detection_id, class_name, n as num_nearby_osm_nodes from counts"),
    "match_summary": using("counts", f"""
select count(*) as total_detections, {_n('n > 0')} as detections_with_matches, {_n('n = 0')} as detections_without_matches,
  round(avg(n), 2) as avg_matches_per_detection, max(n) as max_matches from counts"""),
    "match_rate": using("counts", f"""
select count(*) as total_detections, {_n('n > 0')} as detections_with_matches,
  round(case when count(*) > 0 then {_rate('n > 0')} else 0 end, 6) as match_rate_pct from counts"""),
    "detections_by_class": using("det", "select class_name, count(*) as count from det group by 1"),
    "osm_type_top20": using("osm", """
select osm_type, count(*) as count from osm group by 1 order by 2 desc, 1 limit 20"""),
    "ingestion_status": using("det osm", """
select 'detections' as source, count(*) as record_count, min(ingested_at) as earliest, max(ingested_at) as latest from det
union all select 'ground_truth', count(*), min(timestamp '2024-01-31 00:00:00' + to_seconds(cast(osm_id as int))),
  max(timestamp '2024-01-31 00:00:00' + to_seconds(cast(osm_id as int))) from osm"""),
    "osm_load_summary": using("osm", "select count(*) as total_nodes, count(distinct osm_type) as unique_types from osm"),
    "detection_stats": using("det", """
select count(distinct frame_number) as frames_with_detections, max(frame_number) as last_frame,
  count(*) as total_detections, max(timestamp_sec) as duration_sec, round(avg(confidence), 6) as avg_confidence,
  min(confidence) as min_confidence, max(confidence) as max_confidence from det"""),
    "confidence_histogram": using("det", f"""
select c.class_name, b.bin, printf('%.2f-%.2f', b.bin * 1e-1, (b.bin + 1) * 1e-1) as range, count(d.confidence) as count
from (select distinct class_name from det where class_name is not null) c
cross join (select cast(unnest(range(10)) as int) as bin) b
left join (select class_name, confidence, {_BIN} as bin from det where confidence between 0 and 1) d
  on d.class_name = c.class_name and d.bin = b.bin
group by 1, 2, 3"""),
    "detections_over_time": using("det", f"""
select time_bin, count(case when class_name = 'stop sign' then 1 end) as "stop sign",
  count(case when class_name = 'traffic light' then 1 end) as "traffic light"
from (select class_name, greatest(1, {_TIME_BIN}) as time_bin from (
  select d.*, s.lo, (s.hi - s.lo) / 20 as step from det d
  cross join (select min(timestamp_sec) as lo, max(timestamp_sec) as hi from det) s) t where class_name is not null) x
group by 1"""),
    "class_counts_over_time": using("det", f"""
select time_bin, class_name, count(*) as count
from (select class_name, greatest(1, {_TIME_BIN}) as time_bin from (
  select d.*, s.lo, (s.hi - s.lo) / 20 as step from det d
  cross join (select min(timestamp_sec) as lo, max(timestamp_sec) as hi from det) s) t where class_name is not null) x
group by 1, 2"""),
    "comparison_counts": using("compared", "select status, count(*) as n from compared group by 1"),
    "window_class_conf": using("det", """
select class_name, count(*) as count, round(avg(confidence), 6) as avg_confidence from det
where timestamp_sec between 295e-1 and 305e-1 and class_name is not null group by 1"""),
    "per_video_counts": using("det", "select video_name, count(*) as detections from det group by 1"),
    "per_video_summary": using("det", """
select count(*) as videos, cast(sum(n) as bigint) as total_detections, round(avg(n), 6) as avg_per_video
from (select video_name, count(*) as n from det group by 1) v"""),
    "top_videos": using("det", """
select video_name, count(*) as detections from det group by 1 order by 2 desc, 1 limit 5"""),
    "pixel_profile": using("det", """
select min(v) as min_v, max(v) as max_v, count(case when v > 720 then 1 end) as below_horizon,
  count(case when v <= 720 then 1 end) as above_horizon, min(frame_number) as first_frame,
  max(frame_number) as last_frame, string_agg(distinct class_name, ',' order by class_name) as classes from det"""),
    "run_metrics": using("det", f"""
select {_n(_GOOD)} as sent, {_n(_GOOD)} as acked, cast(0 as bigint) as failed, {_n('not (' + _GOOD + ')')} as rejected,
  cast(0 as bigint) as pending, 1e2 as success_rate_pct from det"""),
    "run_metrics_refused": using("det", f"""
select count(*) as sent, {_n('frame_number % 50 <> 0')} as acked, {_n('frame_number % 50 = 0')} as failed,
  {_n('frame_number % 50 = 0 or frame_number % 7 = 0')} as retried,
  round(100.0 * {_n('frame_number % 50 <> 0')} / count(*), 6) as success_rate_pct from det"""),
    "dead_letters": using("det", """
select detection_id as key, cast(frame_number as bigint) as frame_number, cast(2 as integer) as attempts, 'refused' as reason
from det where frame_number % 50 = 0"""),
    "run_metrics_stream": using("det", f"""
select {_n(_GOOD)} as sent, {_n(_GOOD)} as acked, cast(0 as bigint) as failed, {_n('not (' + _GOOD + ')')} as rejected,
  cast(0 as bigint) as pending from det"""),

    "discrepancy_details": using("review", """
select video_name, frame_number, recording_timestamp, detected_class, confidence, detected_lat, detected_lon, osm_class,
  osm_lat, osm_lon, round(distance_meters, 3) as distance_meters, audit_status, action_priority from review"""),
    "high_priority_top10": using("review10", """
select detection_id, confidence, round(distance_meters, 3) as distance_meters, nearest_osm_node_id from review10
where action_priority = 'HIGH' order by confidence desc nulls first, distance_meters asc nulls last, video_name,
  frame_number, detection_id, nearest_osm_node_id limit 10"""),
    "nearest_to_point": using("osm", f"""
select osm_id, osm_type, latitude, longitude,
  round({hav('latitude', 'longitude', '4379e-2', '-79314e-3')}, 3) as distance_from_detection_meters
from osm order by {hav('latitude', 'longitude', '4379e-2', '-79314e-3')}, osm_id limit 5"""),
    "closest_pairs": using("every_pair", """
select detection_id, osm_id, round(dist, 2) as distance_meters from every_pair where dist < 100
order by 3, 1, 2 limit 10"""),
    "closest_detections": using("nearest", """
select detection_id, osm_id, round(dist, 2) as distance_meters from nearest order by 3, 1, 2 limit 5"""),
    "closest_matches_50": using("every_pair", """
select detection_id, osm_id, round(dist, 2) as distance_meters from every_pair where dist <= 50
order by 3, 1, 2 limit 50"""),
    "recent_detections": using("located", """
select detection_id, class_name, vehicle_lat as lat, vehicle_lon as lon, recording_timestamp as timestamp, confidence,
  ingested_at from located order by ingested_at desc, detection_id limit 1000"""),
    "recent_detections_top10": using("located", """
select detection_id, class_name, vehicle_lat as lat, vehicle_lon as lon, recording_timestamp as timestamp, confidence,
  ingested_at from located order by ingested_at desc, detection_id limit 10"""),
    "osm_sample": using("tagged", """
select osm_id, osm_type, latitude, longitude, name, 2 as n_tags from tagged where osm_type = 'traffic_signals' order by osm_id limit 5"""),
    "osm_sample_any": using("tagged", """
select osm_id, osm_type, latitude, longitude, name, crossing, case when crossing is null then 2 else 3 end as n_tags
from tagged order by osm_id limit 10000"""),
    "table_row_counts": using("det osm", """
select 'detections' as table_name, count(*) as row_count from det union all select 'nodes', count(*) from osm"""),

    "dq_not_null": using("det", "\nunion all\n".join(
        f"select 'detections.{name}' as check_name, {_n(f'{column} is null')} as failures from det"
        for name, column in (("video_name", "video_name"), ("frame_number", "frame_number"), ("object_class", "class_name"),
                             ("confidence", "confidence"), ("latitude", "vehicle_lat"), ("longitude", "vehicle_lon")))),
    "dq_not_null_rows": using("det", "select detection_id from det where class_name is null"),
    "dq_unique": using("tile_nodes", """
select osm_id, count(*) as n_records from tile_nodes group by 1 having count(*) > 1"""),
    "dq_accepted_values": using("boxes", """
select class_name as value_field, count(*) as n_records from boxes
where class_name not in ('stop sign', 'traffic light') group by 1"""),
    "dq_accepted_values_status": using("fct", """
select audit_status as value_field, count(*) as n_records from fct
where audit_status not in ('VERIFIED', 'NEW_DISCOVERY') group by 1"""),
    "dq_accepted_range": using("fct", """
select 'confidence' as check_name, detection_id, nearest_osm_node_id from fct where confidence < 3e-1 or confidence > 9e-1
union all select 'distance', detection_id, nearest_osm_node_id from fct where distance_meters < 0 or distance_meters > 90"""),
    "dq_verification_rate": using("fct10", f"""
select * from (select count(*) as total_detections, {_n("audit_status = 'VERIFIED'")} as verified_count,
  round({_rate("audit_status = 'VERIFIED'")}, 2) as verification_rate_pct from fct10 where confidence >= 7e-1) t
where verification_rate_pct < 30"""),
    "dq_future_dates": using("fct", """
select video_name, frame_number, recording_timestamp from fct
where try_strptime(recording_timestamp, '%d/%m/%Y %H:%M:%S') > timestamp '2024-01-25 00:00:00'"""),
    "dq_all_checks": using("fct10", f"""
select 'raw.not_null.record_content' as check_name, cast(0 as bigint) as failures
union all select unnest(['osm.not_null.osm_id', 'osm.not_null.latitude', 'osm.not_null.longitude', 'osm.unique.osm_id',
  'fct.not_null.video_name', 'fct.not_null.frame_number', 'fct.not_null.detected_class', 'fct.not_null.confidence',
  'fct.not_null.audit_status', 'fct.accepted_values.detected_class', 'fct.accepted_range.confidence',
  'fct.accepted_range.distance_meters', 'fct.accepted_values.audit_status']), 0
union all select 'fct.high_verification_rate',
  case when round({_rate("audit_status = 'VERIFIED'")}, 2) < 30 then 1 else 0 end from fct10 where confidence >= 7e-1
union all select 'fct.no_future_dates', count(*) from fct10
where try_strptime(recording_timestamp, '%d/%m/%Y %H:%M:%S') > timestamp '2024-01-25 00:00:00'"""),

    "stream_csv_rejected": using("det", f"""
select case when event_id % 101 = 0 then 'invalid frame_number' else 'invalid confidence' end as reject_reason,
  count(*) as n from det where not ({_GOOD}) group by 1"""),
    "stream_csv_to_topic": using("det", f"""
{_TOPIC}"""),
    "stream_csv_topic_raw": using("det", f"""
select video_name, frame_number, confidence, coalesce(class_name, '') as object_class, vehicle_lat as latitude
from det where {_GOOD}"""),
    "batch_csv_to_topic": using("det", f"""
{_TOPIC}"""),
    "stream_topic_to_raw": using("det", """
select detection_id, video_name, frame_number, class_name as object_class, vehicle_lat as latitude from det"""),
    "stream_audit": _fact("fct"),
    "build_all_facts": _fact("fct"),
    "build_all_summary": _summary("fct"),
    "build_all_published": _summary("fct"),
    "stream_status_counts": using("det", "select class_name, count(*) as count from det group by 1"),
    "stream_dedup": using("det", "select detection_id, frame_number, class_name from det"),
    "stream_unreadable": using("det", """
select concat('{broken ', event_id) as value, cast(null as integer) as frame_number from det where event_id % 50 = 0
union all select concat('{"frame_number":', frame_number, '}'), frame_number from det where event_id % 70 = 0"""),
    "build_all": using("flagged fct review", f"""
select 'stg_perception_data' as table_name, count(*) as row_count from flagged where vehicle_lat is not null
union all select 'stg_osm_ground_truth', count(*) from osm
union all select 'fct_map_audit', count(*) from fct
union all select 'audit_summary_metrics', count(*) from (select distinct {_DATE}, detected_class, audit_status from fct) s
union all select 'discrepancy_details', count(*) from review
union all select 'checks', 16"""),
}

# Signs by the sequential rule: step k looks at row k of every (video, class) and at the signs that are
# still in reach.
_SIGNS = """, numbered as (
  select video_name, class_name, cast(frame_number as integer) as frame_number, u, v, detection_id,
    row_number() over (partition by video_name, class_name order by frame_number, detection_id) as k
  from det where class_name is not null),
walk(video_name, class_name, frame_number, u, v, detection_id, k, is_sign, held) as (
  select video_name, class_name, frame_number, u, v, detection_id, k, true, [{'f': frame_number, 'u': u, 'v': v}]
  from numbered where k = 1
  union all
  select video_name, class_name, frame_number, u, v, detection_id, k, not covered,
    case when covered then near else list_append(near, {'f': frame_number, 'u': u, 'v': v}) end
  from (select *, len(list_filter(near, lambda s: abs(s.u - u) < 200 and abs(s.v - v) < 100)) > 0 as covered
        from (select n.*, list_filter(w.held, lambda s: n.frame_number - s.f < 100) as near
              from walk w join numbered n on w.video_name = n.video_name and w.class_name = n.class_name and n.k = w.k + 1) c) d),
signs as (
  select video_name, class_name, frame_number, u, v, detection_id from walk where is_sign
  union all
  select video_name, class_name, cast(frame_number as integer), u, v, detection_id from det where class_name is null)
"""


def _with_signs(select: str) -> str:
    return using("det", _SIGNS + select).replace("with det", "with recursive det", 1)


ORACLE["unique_signs"] = _with_signs("select * from signs")
ORACLE["frames_per_sign"] = _with_signs("""
select count(distinct frame_number) as frames_with_detections, max(frame_number) as last_frame,
  count(*) as total_detections, max(timestamp_sec) as duration_sec, round(avg(confidence), 6) as avg_confidence,
  min(confidence) as min_confidence, max(confidence) as max_confidence,
  (select count(*) from signs) as unique_signs, round(count(*) * 1e0 / (select count(*) from signs), 6) as avg_frames_per_sign
from det""")

ORACLE["nearest_within_radius_ties"] = f"""
with grid as (select event_id, (40 * 4096 + event_id % 81920) / 4096e0 as la, (-79 * 4096 + 8 * ((event_id * 37) % 5000)) / 4096e0 as lo from events),
spots as (select distinct la as osm_lat, lo + side / 4096e0 as osm_lon from grid cross join (values (-1), (1)) s(side)),
pairs as (select event_id, osm_lat, osm_lon, {hav('la', 'lo', 'osm_lat', 'osm_lon')} as m
          from grid join spots on osm_lat between la - 1e-3 and la + 1e-3 and osm_lon between lo - 25e-4 and lo + 25e-4)
select event_id, osm_lat, osm_lon, round(m, 3) as distance_m from pairs where m <= 100
qualify m = min(m) over (partition by event_id)"""
