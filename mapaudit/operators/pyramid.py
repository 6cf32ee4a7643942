"""Nearest search without a radius, cell against cell, down a pyramid of nested cells.

Positions are reduced to occupied cells of a few hundred metres, with the greatest distance of a member from the cell's
centre; cells four times as wide hold them, and so on up to cells of 45 degrees. The search goes down both pyramids
at once. With c the distance of two centres and h the greatest distances of the members, no member of the one
cell is nearer to one of the other than c - h1 - h2, and every member of the first has one of the second
within c + h1 + h2. So the least c + h2 that a cell meets bounds its members' answers, and pairs beyond that bound
are given up before their children are looked at. What is left per cell does not depend on how far apart the
two sides are: near pairs are told apart by small cells, distant ones by wide cells already.

Bounds are great-circle distances between real members, so nothing special happens at poles or the date line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapaudit.functions.geo import haversine_m
from mapaudit.session import cut

TOP_DEGREES = 45.0
_BITS = 2  # a cell has 4 x 4 children
_FINEST = 14  # about 2 cm
_START = 7  # about 300 m
_SITES, _PLACES = 64, 4096  # most positions of a finest cell, where that can be reached
_FIRST_PAIRS = 4096  # the search begins on the last level with at most about so many pairs of cells
_SLACK_M = 1e-3
_HALF_EARTH_M = 2.1e7
_LOW = (1 << 32) - 1


def _cell(lat: str, lon: str, level: int) -> Column:
    size = TOP_DEGREES / 4**level
    row, column = F.floor((F.col(lat) + 90.0) / size), F.floor((F.col(lon) + 180.0) / size)
    return F.shiftleft(row.cast("long"), 32).bitwiseOR(column.cast("long"))


def _above(cell: Column, levels: int) -> Column:
    """The cell ``levels`` up that holds ``cell``."""
    bits = _BITS * levels
    row, column = F.shiftright(cell, 32 + bits), F.shiftright(cell.bitwiseAND(F.lit(_LOW)), bits)
    return F.shiftleft(row, 32).bitwiseOR(column)


def _centre(cell: Column, level: int) -> tuple[Column, Column]:
    size = TOP_DEGREES / 4**level
    lat = (F.shiftright(cell, 32) + 0.5) * size - 90.0
    return F.least(F.lit(90.0), lat), (cell.bitwiseAND(F.lit(_LOW)) + 0.5) * size - 180.0


class Pyramid:
    """Occupied cells of every level of a table of positions, from one stored table of the finest."""

    def __init__(self, positions: DataFrame, lat: str, lon: str, finest: int):
        self.finest = finest
        cells = positions.select(_cell(lat, lon, finest).alias("cell"), lat, lon)
        at = _centre(F.col("cell"), finest)
        cells = cells.withColumn("_lat", at[0]).withColumn("_lon", at[1])
        self.cells = cut(cells.groupBy("cell").agg(F.max(haversine_m(lat, lon, "_lat", "_lon")).alias("half")), "cells")

    def counts(self) -> list[int]:
        """About how many cells each level has."""
        ask = [F.approx_count_distinct(_above(F.col("cell"), self.finest - k)) for k in range(self.finest + 1)]
        return [int(n) for n in self.cells.agg(*(c.alias(f"n{k}") for k, c in enumerate(ask))).first()]

    def level(self, k: int, prefix: str) -> DataFrame:
        """Cells with the cell above, the centre, and the greatest distance of a member from it."""
        names = {x: f"{prefix}_{x}" for x in ("cell", "above", "lat", "lon", "half")}
        if k == self.finest:
            rows = self.cells
        else:
            low, up = _centre(F.col("cell"), self.finest), _above(F.col("cell"), self.finest - k)
            rows = self.cells.withColumns({"_lat": low[0], "_lon": low[1], "_up": up})
            high = _centre(F.col("_up"), k)
            rows = rows.withColumns({"lat": high[0], "lon": high[1]}).groupBy(F.col("_up").alias("cell")).agg(
                F.max(haversine_m("_lat", "_lon", "lat", "lon") + F.col("half")).alias("half"))
        at = _centre(F.col("cell"), k)
        rows = rows.select("cell", _above(F.col("cell"), 1).alias("above"), at[0].alias("lat"), at[1].alias("lon"), "half")
        return rows.withColumnsRenamed(names)


def _finest_level(positions: DataFrame, lat: str, lon: str, most: int) -> int:
    """The first level, from about 300 m on, of which no cell holds more than ``most`` positions."""
    for level in range(_START, _FINEST):
        densest = positions.groupBy(_cell(lat, lon, level).alias("cell")).count().agg(F.max("count")).first()[0]
        if (densest or 0) <= most:
            return level
    return _FINEST


def descend(places: DataFrame, sites: DataFrame, limit_m: float | None = None, both: bool = False,
            trace: list[tuple[int, int, int]] | None = None) -> tuple[DataFrame, int] | None:
    """(pairs, level): ``p_cell, s_cell, for_p, for_s`` of finest cells. The nearest site of every place lies in a cell that
    its own cell is paired with under ``for_p``, unless it is farther than ``limit_m``; with ``both`` the nearest place
    of every site likewise under ``for_s``. None if a side is empty.

    ``places`` have ``p_lat, p_lon`` and ``sites`` ``s_lat, s_lon``, stored tables of distinct positions without nulls.
    ``trace`` receives (level, cells of places, pairs) of every level.
    """
    if places.isEmpty() or sites.isEmpty():
        return None
    finest = max(_finest_level(places, "p_lat", "p_lon", _SITES if both else _PLACES), _finest_level(sites, "s_lat", "s_lon", _SITES))
    p_side, s_side = Pyramid(places, "p_lat", "p_lon", finest), Pyramid(sites, "s_lat", "s_lon", finest)
    sizes = [a * b for a, b in zip(p_side.counts(), s_side.counts())]
    start = max(k for k in range(finest + 1) if k == 0 or sizes[k] <= _FIRST_PAIRS)
    pairs = None
    for k in range(start, finest + 1):
        p, s = p_side.level(k, "p"), s_side.level(k, "s")
        if pairs is None:  # everything lies below one root
            met = p.withColumn("p_above", F.lit(0)).join(s.withColumn("s_above", F.lit(0)), F.col("p_above") == F.col("s_above"))
        else:
            above = pairs.select(F.col("p_cell").alias("p_above"), F.col("s_cell").alias("s_above"))
            met = above.join(p, "p_above").join(s, "s_above")
        met = met.select("p_cell", "s_cell", "p_half", "s_half", haversine_m("p_lat", "p_lon", "s_lat", "s_lon").alias("c"))
        least = F.col("c") - F.col("p_half") - F.col("s_half")
        met = cut(met.where(least <= F.lit(_HALF_EARTH_M if limit_m is None else limit_m) + _SLACK_M), "met")
        bound = met.groupBy("p_cell").agg(F.min(F.col("c") + F.col("s_half")).alias("p_bound"))
        met = met.join(bound, "p_cell").withColumn("for_p", least <= F.col("p_bound") + F.col("p_half") + _SLACK_M)
        if both:
            bound = met.groupBy("s_cell").agg(F.min(F.col("c") + F.col("p_half")).alias("s_bound"))
            met = met.join(bound, "s_cell").withColumn("for_s", least <= F.col("s_bound") + F.col("s_half") + _SLACK_M)
        else:
            met = met.withColumn("for_s", F.lit(False))
        pairs = cut(met.where("for_p or for_s").select("p_cell", "s_cell", "for_p", "for_s"), "pairs")
        if trace is not None:
            trace.append((k, pairs.select("p_cell").distinct().count(), pairs.count()))
    return pairs, finest


def opened(places: DataFrame, sites: DataFrame, pairs: DataFrame, level: int, wanted: str) -> DataFrame:
    """Places and sites of the paired cells, with ``distance_m``."""
    near = places.withColumn("p_cell", _cell("p_lat", "p_lon", level)).join(pairs.where(wanted).select("p_cell", "s_cell"), "p_cell")
    near = near.join(sites.withColumn("s_cell", _cell("s_lat", "s_lon", level)), "s_cell")
    return near.drop("p_cell", "s_cell").withColumn("distance_m", haversine_m("p_lat", "p_lon", "s_lat", "s_lon"))
