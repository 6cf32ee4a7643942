"""Coverage of an area: bounding box, tiles, merged tile extracts, centre."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapaudit.sources.files import WHOLE_BYTES, failed_files, list_files
from mapaudit.sources.osm_xml import read_tile_nodes


def coverage_bbox(df: DataFrame, lat: str = "latitude", lon: str = "longitude", buffer: float = 0.1) -> DataFrame:
    """Bounding box widened by ``buffer`` of its span on each side; nulls without rows."""
    located = df.where(F.col(lat).isNotNull())
    box = located.agg(F.min(lat).alias("a"), F.max(lat).alias("b"), F.min(lon).alias("c"), F.max(lon).alias("d"),
                      F.count(F.lit(1)).alias("n"))
    dlat, dlon = (F.col("b") - F.col("a")) * buffer, (F.col("d") - F.col("c")) * buffer
    return box.select(
        (F.col("a") - dlat).alias("min_lat"), (F.col("c") - dlon).alias("min_lon"),
        (F.col("b") + dlat).alias("max_lat"), (F.col("d") + dlon).alias("max_lon"),
        F.col("n").alias("total_detections"),
    )


def tiles(box: DataFrame, size: float = 0.02) -> DataFrame:
    """Tiles of each (min_lat, min_lon, max_lat, max_lon) row, clipped at the far
    edges and numbered row by row from the south-west corner."""
    def steps(lo: str, hi: str):
        n = F.ceil(F.round((F.col(hi) - F.col(lo)) / size, 9)).cast("int")
        return F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)), n

    rows, _ = steps("min_lat", "max_lat")
    cols, n_cols = steps("min_lon", "max_lon")
    grid = (
        box.where((F.col("max_lat") > F.col("min_lat")) & (F.col("max_lon") > F.col("min_lon")))
        .withColumn("_r", rows).withColumn("_n", n_cols).withColumn("_c", cols)
    )
    south, west = F.col("min_lat") + F.col("_r") * size, F.col("min_lon") + F.col("_c") * size
    return grid.select(
        (F.col("_r") * F.col("_n") + F.col("_c") + 1).alias("tile_no"),
        south.alias("south"), west.alias("west"),
        F.least(south + size, F.col("max_lat")).alias("north"), F.least(west + size, F.col("max_lon")).alias("east"),
    )


def tile_grid(spark: SparkSession, bbox: tuple[float, float, float, float], size: float = 0.02) -> DataFrame:
    names = ("min_lat", "min_lon", "max_lat", "max_lon")
    return tiles(spark.range(1).select(*[F.lit(float(v)).alias(n) for n, v in zip(names, bbox)]), size)


def tile_of(lat, lon, bbox: tuple[float, float, float, float], size: float = 0.02):
    """tile_no of a point as an expression: no join with the tile table."""
    min_lat, min_lon, max_lat, max_lon = bbox
    n_rows = max(1, math.ceil(round((max_lat - min_lat) / size, 9)))
    n_cols = max(1, math.ceil(round((max_lon - min_lon) / size, 9)))
    row = F.least(F.floor((lat - min_lat) / size), F.lit(n_rows - 1))
    col = F.least(F.floor((lon - min_lon) / size), F.lit(n_cols - 1))
    inside = lat.between(min_lat, max_lat) & lon.between(min_lon, max_lon)
    return F.when(inside, row * n_cols + col + 1)


def merge_tiles(tile_nodes: DataFrame, key: str = "osm_id", order: str = "tile_no") -> DataFrame:
    """One row per node: the copy from the first tile. A combining aggregate, so any
    number of copies of one node shrinks before the shuffle. Copies of one tile are
    ordered by their other columns, maps (which have no order) by their text."""
    rest = [f for f in tile_nodes.schema.fields if f.name not in (key, order)]
    by = [F.to_json(f.name) if "map" in f.dataType.simpleString() else F.col(f.name) for f in rest]
    first = F.min_by(F.struct(order, *(f.name for f in rest)), F.struct(order, *by)).alias("_first")
    return tile_nodes.groupBy(key).agg(first).select(key, "_first.*").select(*tile_nodes.columns)


def merge_tile_files(spark: SparkSession, folder: str, whole_bytes: int = WHOLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(nodes, failed): every node of a folder of tile extracts once, from the first file by name that has it, and
    (source_file, reason) of the tiles that could not be read. Nothing of a broken tile is taken."""
    found, status = read_tile_nodes(spark, folder, whole_bytes)
    return merge_tiles(found, order="source_file"), failed_files(list_files(spark, folder, largest=whole_bytes), status)


def tile_counts(tile_nodes: DataFrame, order: str = "tile_no") -> DataFrame:
    """Nodes per tile and, with a null tile number, in total after merging."""
    per_tile = tile_nodes.groupBy(order).agg(F.count(F.lit(1)).alias("node_count"))
    total = tile_nodes.agg(F.count_distinct("osm_id").alias("node_count"))
    return per_tile.unionByName(total.withColumn(order, F.lit(None).cast("int")))


def centroid(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.agg(F.avg(lat).alias("center_lat"), F.avg(lon).alias("center_lon"))
