"""Equal-area-ish latitude/longitude grid used as the join key of every spatial join.

Rows of cells ("bands") are one search radius high; each band is cut into the
largest whole number of cells at least one radius wide. A point has one cell.
The cover of a point is every cell its search circle can touch, so an equi-join
of points with covers on (band, cell) sees every pair within the radius exactly
once, with no duplicates, across the date line and over the poles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapaudit.config import EARTH_RADIUS_M

_GUARD = 1 + 1e-7  # keeps rounding from dropping a pair at exactly the radius
CELL = ["_band", "_cell"]


def band_height(radius_m: float) -> float:
    return math.degrees(radius_m / EARTH_RADIUS_M) * _GUARD


def _cells_in_band(band: Column, radius_m: float) -> Column:
    height = band_height(radius_m)
    poleward = F.least(F.lit(90.0), F.greatest(F.abs(band * height), F.abs((band + 1) * height)))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(poleward)) / height)).cast("long")


def _cell_at(lon: Column, n: Column) -> Column:
    return F.floor((lon + 180.0) / (F.lit(360.0) / n))


def with_cell(df: DataFrame, lat: str, lon: str, radius_m: float) -> DataFrame:
    """Adds the (_band, _cell) of each point; null coordinates give null cells."""
    band = F.floor(F.col(lat) / band_height(radius_m)).cast("long")
    df = df.withColumn("_band", F.when(F.col(lon).isNotNull(), band))
    n = _cells_in_band(F.col("_band"), radius_m)
    return df.withColumn("_cell", F.pmod(_cell_at(F.col(lon), n), n).cast("long"))


def with_cover(df: DataFrame, lat: str, lon: str, radius_m: float) -> DataFrame:
    """One row per cell the circle around the point can touch (usually 9)."""
    height = band_height(radius_m)
    la, lo = F.col(lat), F.col(lon)
    bands = df.where(la.isNotNull() & lo.isNotNull()).withColumn(
        "_band",
        F.explode(F.sequence(F.floor((la - height) / height).cast("long"),
                             F.floor((la + height) / height).cast("long"))),
    )
    n = _cells_in_band(F.col("_band"), radius_m)
    half_width = F.degrees(F.asin(F.least(
        F.lit(1.0), F.lit(math.sin(min(radius_m / EARTH_RADIUS_M, math.pi / 2))) / F.cos(F.radians(la))
    ))) * _GUARD
    first, last = _cell_at(lo - half_width, n), _cell_at(lo + half_width, n)
    around = (F.abs(la) + height >= 90) | (last - first + 1 >= n)
    cells = F.when(around, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.sequence(first, last))
    return (
        bands.withColumn("_band_cells", n)
        .withColumn("_cell", F.explode(cells))
        .withColumn("_cell", F.pmod("_cell", "_band_cells").cast("long"))
        .drop("_band_cells")
    )


def cell_center(band: Column, cell: Column, radius_m: float) -> tuple[Column, Column]:
    n = _cells_in_band(band, radius_m)
    lat = F.greatest(F.lit(-90.0), F.least(F.lit(90.0), (band + 0.5) * band_height(radius_m)))
    return lat, (cell + 0.5) * (F.lit(360.0) / n) - 180.0
