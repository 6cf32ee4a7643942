"""Detections, map nodes, tracks, boxes and overlay texts derived from the test tables.

Each table is one SELECT text that Spark and the SQL oracle both run; the only
difference is the date format call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapaudit.session import new_path

OSM_SQL = """
with n as (select p_partkey, cast(floor(p_partkey / 3) as bigint) as m from part)
select cast(p_partkey as varchar(20)) as osm_id,
  case p_partkey % 6 when 0 then 'stop' when 1 then 'traffic_signals' when 2 then 'crossing'
       when 3 then 'TRAFFIC_SIGNALS' when 4 then 'give_way' else 'stop' end as osm_type,
  4.358e1 + ((m * 7919) % 28000) * 1e-5 + (p_partkey % 3) * 8e-5 as latitude,
  -7.964e1 + ((m * 104729) % 52000) * 1e-5 + (p_partkey % 3) * 11e-5 as longitude
from n"""

_DET_SQL = """
with f0 as (select event_id, ts, user_id, cast(floor(event_id / 2) as bigint) as f from events),
f1 as (select *, 1 + (f % 60) as m,
  case f % 3 when 0 then 2e-6 when 1 then 1e-5 else 4e-5 end as sc from f0)
select event_id,
  concat('det-', cast(event_id as varchar(20))) as detection_id,
  concat('vehicle-', cast(user_id % 5 as varchar(5))) as vehicle_id,
  concat('video_', cast(cast(floor(f / 500) as bigint) as varchar(10)), '.MP4') as video_name,
  cast((f % 500) * 30 as int) as frame_number,
  (f % 500) * 1e0 as timestamp_sec,
  ((f * 37) % 2560) * 1e0 as u,
  ((f * 11) % 1000 + (event_id % 2) * 400) * 1e0 as v,
  (20 + (event_id * 37) % 80) / 1e2 as confidence,
  case when event_id % 97 = 0 then null when f % 20 < 6 then 'stop sign' else 'traffic light' end as class_name,
  case when f % 53 = 0 then null else 4.358e1 + ((m * 7919) % 28000) * 1e-5 + ((f * 13) % 41 - 20) * sc
       + case when f % 10 = 9 then 1.37e-2 else 0e0 end end as vehicle_lat,
  case when f % 53 = 0 then null else -7.964e1 + ((m * 104729) % 52000) * 1e-5 + ((f * 17) % 41 - 20) * sc end as vehicle_lon,
  case when event_id % 89 = 0 then 'bad timestamp' else {fmt} end as recording_timestamp,
  ts as ingested_at
from f1"""

DET_SPARK = _DET_SQL.format(fmt="date_format(ts, 'dd/MM/yyyy HH:mm:ss')")
DET_DUCK = _DET_SQL.format(fmt="strftime(ts, '%d/%m/%Y %H:%M:%S')")

TRACK_SQL = """
select video_name, frame_number, min(vehicle_lat) as lat, min(vehicle_lon) as lon,
  ((frame_number / 30 * 7) % 360) * 1e0 as heading
from det
where vehicle_lat is not null and (cast(floor(event_id / 2) as bigint)) % 13 <> 0
group by video_name, frame_number"""

BOXES_SQL = """
select video_name, cast(frame_number + shift as int) as frame_number,
  cast(u - 20 as int) as x1, cast(v - 60 as int) as y1, cast(u + 20 as int) as x2, cast(v as int) as y2,
  confidence, coalesce(class_name, 'car') as class_name, event_id
from det cross join (select 0 as shift union all select 1 union all select 7) s"""

# What a text reader may return for the printed position and time of a frame.
OVERLAY_SQL = """
select event_id, frame_number, detection_id,
  case event_id % 5
    when 0 then concat('56 KM/H N43.', dd, ' W79.', dd)
    when 1 then concat('N43. ', dd, ' W79. ', dd)
    when 2 then concat('s12.', dd, ' e151.', dd, ' hdg: 45')
    when 3 then concat('lat: -43.', dd, ' lon: 79.', dd)
    else 'no fix' end as gps_text,
  case event_id % 4
    when 0 then concat('cam 18/01/2026 19:15:', cast(10 + event_id % 50 as varchar(2)))
    when 1 then concat('2026-01-18 19:15:', cast(10 + event_id % 50 as varchar(2)))
    when 2 then concat('date ', cast(10 + event_id % 19 as varchar(2)), '/02/2026')
    else 'unreadable' end as ts_text
from (select event_id, frame_number, detection_id,
        cast(100000 + (event_id * 7919) % 900000 as varchar(6)) as dd from det) t"""

# Three readings per frame of one text; the digits of some are lost.
READINGS_SQL = """
select event_id as frame_number, variant,
  case when (event_id + variant) % 3 = 0 then concat('N43.', cast(event_id as varchar(20)))
       when (event_id + variant) % 3 = 1 then concat('N43.', cast(event_id as varchar(20)), ' v', cast(variant as varchar(2)))
       else 'N4?' end as gps_text
from det cross join (select 1 as variant union all select 2 union all select 3) s"""

# One node can lie on the edge of two map tiles and is then delivered by both.
TILE_NODES_SQL = """
select osm_id, osm_type, latitude, longitude, 1 + cast(floor((latitude - 4.358e1) / 2e-2) as int) as tile_no from osm
union all
select osm_id, concat(osm_type, '-copy'), latitude, longitude,
  2 + cast(floor((latitude - 4.358e1) / 2e-2) as int) as tile_no
from osm where cast(osm_id as bigint) % 4 = 0"""


_stored: dict[tuple[str, str, str], str] = {}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def spread(df: DataFrame) -> DataFrame:
    """Deals a small input over all cores; an input with enough splits is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _table(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table, written once per session and folder, then scanned like any
    stored table (so filters and columns are pushed into the scan)."""
    return spark.read.parquet(stored_files(spark, sf_dir, name, lambda path: build().write.parquet(path)))


def stored_files(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Folder that ``write(path)`` filled, once per session and input folder."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _stored:
        path = new_path(spark, name)
        write(path)
        _stored[at] = path
    return _stored[at]


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        events = spread(tables(spark, sf_dir, "events")["events"].select("event_id", "ts", "user_id"))
        return spark.sql(DET_SPARK.replace("from events", "from {events}"), events=events)

    return _table(spark, sf_dir, "det", build)


def osm_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "osm", lambda: spark.sql(
        OSM_SQL.replace("from part", "from {part}"), **tables(spark, sf_dir, "part")))


def tagged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with a tag map: highway = type, name = part name, crossing = brand."""
    part = tables(spark, sf_dir, "part")["part"]
    named = osm_nodes(spark, sf_dir).join(part, F.col("osm_id") == F.col("p_partkey").cast("string"))
    tags = F.create_map(
        F.lit("highway"), F.col("osm_type"), F.lit("name"), F.col("p_name"),
        F.lit("crossing"), F.when(F.col("osm_type") == "crossing", F.col("p_brand")))
    return named.select("osm_id", "osm_type", "latitude", "longitude",
                        F.map_filter(tags, lambda k, v: v.isNotNull()).alias("tags"))


def as_message_columns(det: DataFrame) -> DataFrame:
    """Detection rows under the field names of the topic message."""
    return det.select(
        "detection_id", "vehicle_id", F.lit("session-1").alias("session_id"), "ingested_at", "video_name",
        "frame_number", "timestamp_sec", F.col("u").alias("pixel_u"), F.col("v").alias("pixel_v"),
        "confidence", "class_name", "vehicle_lat", "vehicle_lon", "recording_timestamp",
    )


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table: detections as JSON messages in a VARIANT column."""
    from mapaudit.sources.messages import to_messages, to_raw

    def build():
        messages = to_messages(as_message_columns(detections(spark, sf_dir)))
        return to_raw(messages, topic="detections", kafka_time=F.col("message.ingested_at"))

    return _table(spark, sf_dir, "raw", build)


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRACK_SQL.replace("from det", "from {det}"), det=detections(spark, sf_dir))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir).withColumn("shift", F.explode(F.array(*map(F.lit, (0, 1, 7)))))
    return det.select(
        "video_name", (F.col("frame_number") + F.col("shift")).cast("int").alias("frame_number"),
        (F.col("u") - 20).cast("int").alias("x1"), (F.col("v") - 60).cast("int").alias("y1"),
        (F.col("u") + 20).cast("int").alias("x2"), F.col("v").cast("int").alias("y2"),
        "confidence", F.coalesce("class_name", F.lit("car")).alias("class_name"), "event_id",
    )


def overlay_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OVERLAY_SQL.replace("from det)", "from {det})"), det=detections(spark, sf_dir))


def overlay_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir).select("event_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("variant"))
    return spark.sql(READINGS_SQL[:READINGS_SQL.index("from det")] + "from {det}", det=det)


def tile_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TILE_NODES_SQL.replace("from osm", "from {osm}"), osm=osm_nodes(spark, sf_dir))
