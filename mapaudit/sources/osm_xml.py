"""Map nodes from and to OSM XML, and tag filters over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapaudit.functions.geo import haversine_m, within_box
from mapaudit.sources.files import WHOLE_BYTES, open_files

NODE_SCHEMA = "_id string, _lat double, _lon double, tag array<struct<_k string, _v string>>"
# Highway values that count as traffic infrastructure.
TRAFFIC_HIGHWAYS = ("traffic_signals", "stop", "give_way", "speed_camera")
# Tag selectors of the map extracts, as (key, value or None) that must all hold.
INFRASTRUCTURE = (
    (("traffic_sign", None),),
    (("highway", "traffic_signals"),),
    (("highway", "stop"),),
    (("highway", "give_way"),),
    (("highway", "speed_camera"),),
    (("traffic_sign:forward", None),),
    (("traffic_sign:backward", None),),
    (("direction", None), ("highway", "street_lamp")),
)
SIGNS_AND_STOPS = (
    (("traffic_sign", None),),
    (("highway", "traffic_signals"),),
    (("highway", "stop"),),
    (("highway", "give_way"),),
)
SIGNS_AND_LIMITS = (
    (("highway", "speed_limit"),),
    (("traffic_sign", None),),
)
SIGNALS_AND_STOPS = (
    (("highway", "traffic_signals"),),
    (("highway", "stop"),),
    (("traffic_sign", "stop"),),
    (("crossing", "traffic_signals"),),
)


def _last_values(entries: Column) -> Column:
    last = F.filter(entries, lambda t, i: ~F.exists(
        F.slice(entries, i + 2, F.size(entries) + 1), lambda later: later["_k"] == t["_k"]))
    return F.map_from_entries(last)


def read_nodes(spark: SparkSession, path, skip_unreadable: bool = False, keep_entries: bool = False) -> DataFrame:
    """Every node as (osm_id, latitude, longitude, tags). A repeated key keeps its last value there;
    ``keep_entries`` adds ``entries``, all of a node's (k, v) in file order.

    An unreadable extract fails the job, as a shorter ground truth would pass for new
    discoveries; with ``skip_unreadable`` it counts as empty."""
    nodes = (
        spark.read.format("xml").option("rowTag", "node").option("ignoreCorruptFiles", str(skip_unreadable).lower())
        .schema(NODE_SCHEMA).load(path)
    )
    entries = F.coalesce(F.col("tag"), F.array().cast("array<struct<_k string, _v string>>"))
    return nodes.select(
        F.col("_id").alias("osm_id"), F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"),
        _last_values(entries).alias("tags"),
        *([F.transform(entries, lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))).alias("entries")] if keep_entries else []))


def read_tile_nodes(spark: SparkSession, folder, whole_bytes: int = WHOLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(nodes, status) of a folder of map tiles, each opened on its own: (source_file, osm_id, latitude, longitude,
    tags) of the readable ones, and (source_file, failure) of all that could be opened. Tiles longer than
    ``whole_bytes`` are scanned in parts, and one of these that is broken fails the job."""
    text = F.decode("content", "UTF-8")
    # the record has no name of its own here, so a text that is no XML has neither nodes nor an error
    tile = F.from_xml(text, f"node array<struct<{NODE_SCHEMA}>>, _broken string",
                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    opened = open_files(spark, folder, largest=whole_bytes, skip_unreadable=True).select("source_file", text.alias("text"), tile.alias("tile"))
    broken = F.col("tile").isNull() | F.col("tile._broken").isNotNull() | ~F.col("text").rlike(r"^\s*(\ufeff)?\s*<")
    status = opened.select("source_file", F.when(broken, "no well-formed XML").alias("failure"))
    found = opened.where(~broken).select("source_file", F.explode("tile.node").alias("n")).select("source_file", "n.*")
    long = (
        spark.read.format("xml").option("rowTag", "node").schema(NODE_SCHEMA).load(folder)
        .where(F.col("_metadata.file_size") > whole_bytes).select(F.col("_metadata.file_path").alias("source_file"), "_id", "_lat", "_lon", "tag"))
    entries = F.coalesce(F.col("tag"), F.array().cast("array<struct<_k string, _v string>>"))
    nodes = found.unionByName(long).select(
        "source_file", F.col("_id").alias("osm_id"), F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"),
        _last_values(entries).alias("tags"))
    return nodes, status


def tag(key: str) -> Column:
    return F.try_element_at("tags", F.lit(key))


def typed_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with a sign or highway tag; the type is the first non-empty of the two."""
    kind = F.coalesce(F.nullif(tag("traffic_sign"), F.lit("")), tag("highway"), F.lit("unknown"))
    has = F.map_contains_key("tags", "traffic_sign") | F.map_contains_key("tags", "highway")
    return nodes.where(has).select("osm_id", kind.alias("osm_type"), "latitude", "longitude", "tags")


def read_osm_nodes(spark: SparkSession, path) -> DataFrame:
    return typed_nodes(read_nodes(spark, path))


def nodes_by_tag(nodes: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Nodes with the tag, of one value or of any; then the value is the type.

    Of a key that a node repeats, any entry may have the value, and the first one is the type, if ``nodes`` have
    ``entries``; else the value in ``tags`` counts."""
    if "entries" in nodes.columns:
        of_key = F.filter("entries", lambda t: t["k"] == key)
        if value is not None:
            return nodes.where(F.exists(of_key, lambda t: t["v"] == value)).select("osm_id", "latitude", "longitude")
        return nodes.where(F.size(of_key) > 0).select("osm_id", "latitude", "longitude", F.get(of_key, F.lit(0))["v"].alias("type"))
    if value is not None:
        return nodes.where(tag(key) == value).select("osm_id", "latitude", "longitude")
    return nodes.where(F.map_contains_key("tags", key)).select("osm_id", "latitude", "longitude", tag(key).alias("type"))


def select_nodes(nodes: DataFrame, selectors, bbox=None, around=None) -> DataFrame:
    """Nodes matching any selector, inside (south, west, north, east) or within
    (metres, lat, lon). Both are bounds of columns first, so a scan of nodes stored in order of place
    (``write_nodes_by_place``) reads the row groups near by only."""
    def holds(key: str, value: str | None) -> Column:
        return F.map_contains_key("tags", key) if value is None else F.coalesce(tag(key) == value, F.lit(False))

    alternatives = [reduce(lambda a, b: a & b, [holds(k, v) for k, v in s]) for s in selectors]
    out = nodes.where(reduce(lambda a, b: a | b, alternatives))
    if bbox is not None:
        south, west, north, east = bbox
        out = out.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))
    if around is not None:
        metres, lat, lon = around
        out = out.where(within_box("latitude", "longitude", metres, lat, lon) & (haversine_m("latitude", "longitude", lat, lon) <= metres))
    return out


def filter_traffic(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.coalesce(tag("highway").isin(*TRAFFIC_HIGHWAYS), F.lit(False))
                       | F.map_contains_key("tags", "traffic_sign"))


def with_load_columns(nodes: DataFrame, source_file: str) -> DataFrame:
    return nodes.withColumn("uploaded_at", F.current_timestamp()).withColumn("source_file", F.lit(source_file))


def append_nodes(nodes: DataFrame, source_file: str, path: str) -> None:
    """Appends a load to the reference table kept at ``path``."""
    with_load_columns(nodes, source_file).write.mode("append").parquet(path)


def write_nodes_by_place(nodes: DataFrame, path: str, files: int | None = None, cell_degrees: float = 0.01) -> None:
    """Nodes as a table in order of place: cells of about a kilometre along a curve that interleaves the bits of row and
    column, so that a file and each of its row groups cover a compact area. ``files`` as the session's shuffle partitions
    unless given; rows without a position come first."""
    row = F.floor((F.col("latitude") + 90) / cell_degrees).cast("long")
    col = F.floor((F.col("longitude") + 180) / cell_degrees).cast("long")

    def spread(c: Column) -> Column:
        # 32 bits, a free one in front of each
        for shift in (16, 8, 4, 2, 1):
            mask = sum(((1 << shift) - 1) << at for at in range(0, 63, 2 * shift))
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    placed = nodes.withColumn("_place", F.shiftleft(spread(row), 1).bitwiseOR(spread(col)))
    by = ["_place", "latitude", "longitude", "osm_id"]
    dealt = placed.repartitionByRange(files, *by) if files else placed.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).drop("_place").write.mode("overwrite").parquet(path)


def write_osm_xml(nodes: DataFrame, path: str) -> None:
    tags = F.transform(F.map_entries("tags"), lambda e: F.struct(e["key"].alias("_k"), e["value"].alias("_v")))
    (
        nodes.select(F.col("osm_id").alias("_id"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"),
                     tags.alias("tag"))
        .write.mode("overwrite").format("xml").option("rowTag", "node").option("rootTag", 'osm version="0.6"').save(path)
    )
