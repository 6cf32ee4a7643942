"""Radius joins and nearest-node searches on the grid (see grid.py)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapaudit.config import DEFAULT, EARTH_RADIUS_M, AuditConfig
from mapaudit.functions.geo import haversine_m, unit_vector
from mapaudit.operators.grid import CELL, with_cell, with_cover
from mapaudit.operators.pyramid import descend, opened
from mapaudit.operators.skew import (
    ROW_BYTES, Meeting, dealt_evenly, fits_broadcast, matrix_join, measure, meet_counts, only_met, salted_join, with_dice,
)
from mapaudit.session import cut

_MOST_CELLS = 60  # no circle touches more cells, even at a pole (usually 9)
NEAR_CELLS = 16  # more cells than can hold the sites whose circles touch one cell
_SORTED_WORK = 2_000_000  # pairs compared by a task that also sorts those it keeps, so that they stay in its memory
_WHOLE_EARTH_M = 2.1e7  # more than half the circumference
_POINT_UNIT, _NODE_UNIT = ["_px", "_py", "_pz"], ["_nx", "_ny", "_nz"]
_ADDED = ["distance_m", "site", "s_lat", "s_lon"]


@dataclass(frozen=True)
class SiteSize:
    rows: int
    densest: int


def measure_sites(found: DataFrame, step: float) -> SiteSize:
    """Number of sites and the most in one cell: two numbers from a map-side aggregation."""
    row = (
        with_cell(found, "s_lat", "s_lon", step).groupBy(*CELL).count()
        .agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0)))
        .first()
    )
    return SiteSize(int(row[0]), int(row[1]))


def _chord() -> Column:
    return reduce(lambda a, b: a + b, [(F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(_POINT_UNIT, _NODE_UNIT)])


def _chord_limit(radius_m: float) -> tuple[float, float]:
    """The squared chord of the radius and what rounding may add or take (see ``_nearest_in_cell``), with room to spare."""
    c = (2 * math.sin(min(radius_m / (2 * EARTH_RADIUS_M), math.pi / 2))) ** 2
    return c, math.sqrt(c) * 1e-12 + c * 1e-8 + 1e-26


def _clearly_near(radius_m: float) -> Column:
    c, slack = _chord_limit(radius_m)
    return _chord() < c - slack


def _maybe_near(radius_m: float) -> Column:
    c, slack = _chord_limit(radius_m)
    return _chord() <= c + slack


def radius_join(points: DataFrame, nodes: DataFrame, radius_m: float, how: str = "inner",
                point_at=("latitude", "longitude"), node_at=("osm_lat", "osm_lon"),
                strict: bool = False, cfg: AuditConfig = DEFAULT, node_rows: int | None = None) -> DataFrame:
    """Every (point, node) pair within the radius, with ``distance_m``.

    ``nodes`` is the side that is copied to its cover cells. While that copy is
    below the broadcast limit the points are not shuffled at all; beyond it, the copies in cells without a point are
    dropped, and if the rest is below the limit the points are dealt evenly over tasks by the pairs to compare. Else both
    sides are shuffled by cell, and a cell with many points, many nodes or both is cut into a
    grid of tasks. With ``how="left"``
    unmatched points stay, with nulls. Column names must not overlap. A caller
    that knows the node count passes it and saves the count. Pairs are told by their squared chord; the distance
    decides where that is as close to the radius as rounding allows, and is computed for the pairs that stay.
    """
    return _radius_join(points, nodes, radius_m, how, point_at, node_at, strict, cfg, node_rows, None)[0]


def radius_join_sorted(points: DataFrame, nodes: DataFrame, radius_m: float, order: list[str],
                       point_at=("latitude", "longitude"), node_at=("osm_lat", "osm_lon"),
                       strict: bool = False, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """The pairs of ``radius_join`` sorted by ``order``, whose first column is one of the points.

    Where the nodes are broadcast, the points are put in ranges of that column before they meet them, so each
    task sorts its own pairs and no pair is shuffled. Else, or if one value of that column has more pairs than
    a task should take, the pairs themselves are sorted.
    """
    joined, ranged = _radius_join(points, nodes, radius_m, "inner", point_at, node_at, strict, cfg, None, order[0])
    if not ranged:
        return joined.orderBy(*order)
    # where each value is one row, its number orders the pairs as it does, without comparing texts
    first = "_number" if "_number" in joined.columns else order[0]
    return joined.sortWithinPartitions(first, *order[1:]).drop("_number")


def _radius_join(points: DataFrame, nodes: DataFrame, radius_m: float, how: str, point_at, node_at, strict: bool,
                 cfg: AuditConfig, node_rows: int | None, lead: str | None) -> tuple[DataFrame, bool]:
    """The pairs, and whether their partitions are ranges of the points' column ``lead``."""
    cover = with_cover(nodes, *node_at, radius_m)
    points = with_cell(points, *point_at, radius_m)
    distance = haversine_m(*point_at, *node_at)
    near = _clearly_near(radius_m) | (_maybe_near(radius_m) & (distance < radius_m if strict else distance <= radius_m))
    at_point, at_node = dict(zip(_POINT_UNIT, unit_vector(*point_at))), dict(zip(_NODE_UNIT, unit_vector(*node_at)))
    auto, width = cfg.join_strategy == "auto", ROW_BYTES
    if auto and node_rows is None:
        node_rows, width = measure(nodes)
    bound = (node_rows or 0) * _MOST_CELLS
    small = fits_broadcast(bound, cfg, width) or (auto and fits_broadcast(cover.count(), cfg, width))
    meeting, ranged = None, False
    if lead is not None or not small:
        meeting = meet_counts(points, cover, CELL)
    if auto and not small:
        cover = only_met(cover, CELL, meeting)
        small = fits_broadcast(meeting.right_rows, cfg, width)
    if small:
        if lead is not None:
            most = points.groupBy(lead).count().agg(F.max("count")).first()[0] or 0
            ranged = most * meeting.densest <= cfg.task_pairs
        if meeting is not None:
            spread = points.sparkSession.sparkContext.defaultParallelism
            points = (points.repartitionByRange(meeting.tasks(spread, _SORTED_WORK), lead) if ranged
                      else dealt_evenly(points, meeting.tasks(spread)))
        if ranged and most == 1:
            points = points.sortWithinPartitions(lead).withColumn("_number", F.monotonically_increasing_id())
        for k in CELL:
            cover = cover.withColumnRenamed(k, f"_n{k}")
        match = (F.col("_band") == F.col("_n_band")) & (F.col("_cell") == F.col("_n_cell")) & near
        joined = points.withColumns(at_point).join(F.broadcast(cover.withColumns(at_node)), match, how)
    else:
        joined = matrix_join(points, cover, CELL, how, near, list(point_at), cfg, at_point, at_node, meeting)
    dropped = [*CELL, *[f"_n{k}" for k in CELL], *_POINT_UNIT, *_NODE_UNIT]
    return joined.withColumn("distance_m", distance).drop(*dropped), ranged


def sites(nodes: DataFrame, node_at, key: str, payload=()) -> DataFrame:
    """Distinct node positions; each keeps the node with the lowest key."""
    lat, lon = node_at
    return (
        nodes.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        .groupBy(F.col(lat).alias("s_lat"), F.col(lon).alias("s_lon"))
        .agg(F.min(F.struct(key, *payload)).alias("site"))
    )


def _nearest_in_cell(points: DataFrame, cover: DataFrame, point_at, radius_m: float, ties: bool,
                     meeting: Meeting | None, cfg: AuditConfig) -> DataFrame:
    """Nearest site within the radius from one equi-join, one output row per point
    (per tied site with ``ties``). The sites of a cell arrive as one short array,
    so no pairs are emitted and nothing is shuffled after the join.

    Candidates are ranked by squared chord, three multiplications each; the
    great-circle distance is computed for the winner only, unless chords are as
    close as rounding allows: those are decided by distance, then key. A component
    of a unit vector is off by less than 1e-15 and a difference of two by twice
    that, so a squared chord c is off by less than 1e-14 * sqrt(c) + 2e-29. The
    allowance is ten times that, with room for the distance's own relative error.

    Without a ``meeting`` the cover is broadcast whole. With one, only the sites in cells that have a point are used; they
    are broadcast if they fit, and the points are dealt over tasks by the counted pairs. Else a cell's points are dealt out
    when they have more pairs than a task should take, however few rows they are.
    """
    sx, sy, sz = unit_vector("s_lat", "s_lon")
    entry = F.struct(sx.alias("x"), sy.alias("y"), sz.alias("z"), "s_lat", "s_lon", "site")
    if meeting is not None and cfg.join_strategy == "auto":
        cover = only_met(cover, CELL, meeting)
    per_cell = cover.groupBy(*CELL).agg(F.collect_list(entry).alias("_sites"))
    px, py, pz = unit_vector(*point_at)
    kept = points.columns
    points = with_cell(points, *point_at, radius_m).withColumns({"_x": px, "_y": py, "_z": pz})
    tasks = meeting and meeting.tasks(points.sparkSession.sparkContext.defaultParallelism)
    if meeting is None:
        joined = points.join(F.broadcast(per_cell), CELL, "left")
    elif fits_broadcast(meeting.right_rows, cfg):
        joined = dealt_evenly(points, tasks).join(F.broadcast(per_cell), CELL, "left")
    else:
        joined = salted_join(points, per_cell, CELL, "left", cfg.hot_rows, fan=meeting.fan(CELL, cfg, tasks), tasks=tasks)

    def chord(s):
        dx, dy, dz = s["x"] - F.col("_x"), s["y"] - F.col("_y"), s["z"] - F.col("_z")
        return dx * dx + dy * dy + dz * dz

    def away(s):
        return haversine_m(*map(F.col, point_at), s["s_lat"], s["s_lon"])

    ranked = joined.withColumn("_chords", F.transform("_sites", chord)).withColumn("_least", F.array_min("_chords"))
    least = F.col("_least")
    limit = least + F.sqrt(least) * 1e-13 + least * 1e-12 + 1e-27
    first = F.get("_sites", (F.array_position("_chords", least) - 1).cast("int"))
    rivals = F.filter("_sites", lambda s, i: F.get("_chords", i) <= limit)
    clear = least.isNull() | (F.size(F.filter("_chords", lambda c: c <= limit)) == 1)
    if ties:
        level = F.array_min(F.transform(rivals, away))
        tied = F.filter(rivals, lambda s: away(s) == level)
        joined = ranked.withColumn("_hit", F.explode_outer(
            F.when(least.isNull(), F.lit(None)).when(clear, F.array(first)).otherwise(tied)))
    else:
        closest = F.array_min(F.transform(rivals, lambda s: F.struct(
            away(s).alias("d"), s["site"].alias("site"), s.alias("s"))))["s"]
        joined = ranked.withColumn("_hit", F.when(clear, first).otherwise(closest))
    distance = haversine_m(*point_at, F.col("_hit.s_lat"), F.col("_hit.s_lon"))
    joined = joined.withColumn("distance_m", distance).withColumn(
        "_hit", F.when(F.col("distance_m") <= radius_m, F.col("_hit")))
    return joined.select(
        *kept, F.when(F.col("distance_m") <= radius_m, F.col("distance_m")).alias("distance_m"),
        F.col("_hit.site").alias("site"), F.col("_hit.s_lat").alias("s_lat"), F.col("_hit.s_lon").alias("s_lon"))


def nearest(points: DataFrame, nodes: DataFrame, key: str, payload=(), radius_m: float | None = None,
            point_at=("latitude", "longitude"), node_at=("osm_lat", "osm_lon"),
            ties: bool = False, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Nearest node of every point, within ``radius_m`` or with no limit.

    Adds ``distance_m, site, s_lat, s_lon``: null when nothing is in range. On
    equal distance the lowest key wins, or with ``ties`` one row per tied position.

    The search asks once for each distinct position of the points, and its answers are joined back by position.
    Without a limit, the positions go through ``_far``. With one, most are settled by one grid join at that radius,
    which is lowered until no neighbourhood can hold more than ``cfg.cell_sites`` sites; those without a hit then go
    through ``_far``.
    """
    return nearest_and_answers(points, nodes, key, payload, radius_m, point_at, node_at, ties, cfg)[0]


def nearest_and_answers(points: DataFrame, nodes: DataFrame, key: str, payload=(), radius_m: float | None = None,
                        point_at=("latitude", "longitude"), node_at=("osm_lat", "osm_lon"),
                        ties: bool = False, cfg: AuditConfig = DEFAULT) -> tuple[DataFrame, DataFrame | None]:
    """``nearest`` and the stored answers it was made from, one row a place; None where there are no sites or no places."""
    out = [*points.columns, *_ADDED]
    points, found_sites = with_dice(points), cut(sites(nodes, node_at, key, payload), "sites")
    at = [F.col(c) for c in point_at]
    places = points.where(at[0].isNotNull() & at[1].isNotNull()).select(at[0].alias("p_lat"), at[1].alias("p_lon")).distinct()
    places = cut(places, "places")
    if radius_m is None:
        answers = _far(places, found_sites, _WHOLE_EARTH_M, ties)
    else:
        answers = _near(places, found_sites, radius_m, ties, cfg)
    if answers is None:
        types = {"distance_m": "double", **{f.name: f.dataType for f in found_sites.schema}}
        return points.withColumns({c: F.lit(None).cast(types[c]) for c in _ADDED}).select(*out), None
    return with_answers(points, point_at, answers, ("p_lat", "p_lon"), cfg).select(*out), answers


def _near(places: DataFrame, found_sites: DataFrame, radius_m: float, ties: bool, cfg: AuditConfig) -> DataFrame:
    """Nearest site within the radius of each place that has one. Both tables are stored."""
    step = radius_m
    while True:
        size = measure_sites(found_sites, step)
        if size.densest * NEAR_CELLS <= cfg.cell_sites or step < 0.01:
            break
        step /= 4
    cover = with_cover(found_sites, "s_lat", "s_lon", step)
    small = fits_broadcast(size.rows * _MOST_CELLS, cfg) or (
        cfg.join_strategy == "auto" and fits_broadcast(cover.count(), cfg))
    meeting = None if small else meet_counts(with_cell(places, "p_lat", "p_lon", step), cover, CELL)
    local = cut(_nearest_in_cell(places, cover, ("p_lat", "p_lon"), step, ties, meeting, cfg), "local")
    hits = local.where(F.col("distance_m").isNotNull())
    if step == radius_m:
        return hits
    missed = cut(local.where(F.col("distance_m").isNull()).select("p_lat", "p_lon"), "places")
    far = _far(missed, found_sites, radius_m, ties) if missed.limit(1).count() else None
    return hits if far is None else hits.unionByName(far)


def _far(places: DataFrame, found_sites: DataFrame, limit_m: float, ties: bool) -> DataFrame | None:
    """Nearest site of each place, by descent of both pyramids (see pyramid.py). Both tables are stored."""
    found = descend(places, found_sites, limit_m)
    if found is None:
        return None
    pairs = opened(places, found_sites, *found, "for_p").where(F.col("distance_m") <= limit_m)
    place = ["p_lat", "p_lon"]
    if not ties:
        best = pairs.groupBy(*place).agg(F.min(F.struct("distance_m", "site", "s_lat", "s_lon")).alias("_b"))
        return cut(best.select(*place, "_b.*"), "answers")
    best = cut(pairs.groupBy(*place).agg(F.min("distance_m").alias("_least")), "least")
    tied = pairs.join(best, place).where(F.col("distance_m") == F.col("_least"))
    return cut(tied.select(*place, "distance_m", "site", "s_lat", "s_lon"), "answers")


def nearest_both(crowd: DataFrame, nodes: DataFrame, crowd_key: str, node_key: str,
                 crowd_at=("latitude", "longitude"), node_at=("osm_lat", "osm_lon")) -> tuple[DataFrame, DataFrame]:
    """(nearest node of every crowd position, nearest crowd position of every node position) by one descent.

    The first has ``p_lat, p_lon``, the second ``s_lat, s_lon``; both have the other side's position, ``distance_m``, and the
    lowest key at the nearest position as ``site``. Empty where a side is empty. Positions must not be null.
    """
    places = cut(sites(crowd, crowd_at, crowd_key).select(F.col("s_lat").alias("p_lat"), F.col("s_lon").alias("p_lon"), F.col("site").alias("p_site")), "places")
    found = cut(sites(nodes, node_at, node_key).withColumnRenamed("site", "s_site"), "sites")
    down = descend(places, found, both=True)
    if down is None:
        both = {f.name: f.dataType for f in [*places.schema, *found.schema]}
        none = places.limit(0).select(*(F.lit(None).cast(t).alias(c) for c, t in both.items()), F.lit(None).cast("double").alias("distance_m"))
        return (none.select("p_lat", "p_lon", "distance_m", F.col("s_site").alias("site"), "s_lat", "s_lon"),
                none.select("s_lat", "s_lon", "distance_m", F.col("p_site").alias("site"), "p_lat", "p_lon"))

    def best(of: str, other: str) -> DataFrame:
        here, there = [f"{of}_lat", f"{of}_lon"], [f"{other}_lat", f"{other}_lon"]
        pairs = opened(places, found, *down, f"for_{of}")
        least = pairs.groupBy(*here).agg(F.min(F.struct("distance_m", F.col(f"{other}_site").alias("site"), *there)).alias("_b"))
        return cut(least.select(*here, "_b.*"), "answers")

    return best("p", "s"), best("s", "p")


def with_answers(rows: DataFrame, at, answers: DataFrame, answer_at, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """``rows`` with the answers for their positions, nulls where there are none. Positions that very many rows share are dealt out."""
    answers = answers.withColumnsRenamed(dict(zip(answer_at, at)))
    if fits_broadcast(answers.count(), cfg):
        return rows.join(F.broadcast(answers), list(at), "left")
    return salted_join(rows, answers, list(at), "left", cfg.hot_rows)


def nearest_of_many(anchors: DataFrame, crowd: DataFrame, key: str, anchor_key: str,
                    anchor_at=("osm_lat", "osm_lon"), crowd_at=("latitude", "longitude"),
                    start_m: float = 100.0, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Nearest row of a large ``crowd`` for each row of a small ``anchors`` table.

    The anchors are copied to cells and broadcast; the crowd is scanned once and
    reduced to one candidate per anchor before anything is shuffled.
    """
    lat, lon = crowd_at
    pairs = radius_join(crowd.select(F.col(lat).alias("s_lat"), F.col(lon).alias("s_lon"), F.struct(key).alias("site")),
                        anchors.select(anchor_key, *anchor_at), start_m,
                        point_at=("s_lat", "s_lon"), node_at=anchor_at, cfg=cfg)
    best = pairs.groupBy(anchor_key).agg(F.min(F.struct("distance_m", "site", "s_lat", "s_lon")).alias("_b"))
    close = cut(best.select(anchor_key, "_b.*"), "close")
    rest = anchors.join(close.select(anchor_key), anchor_key, "left_anti")
    places = rest.select(F.col(anchor_at[0]).alias("p_lat"), F.col(anchor_at[1]).alias("p_lon")).distinct()
    places = cut(places, "places")
    answers = None
    if places.limit(1).count():
        answers = _far(places, cut(sites(crowd, crowd_at, key), "sites"), _WHOLE_EARTH_M, False)
    near = anchors.join(close, anchor_key)
    if answers is None:
        empty = [F.lit(None).cast(close.schema[c].dataType).alias(c) for c in close.columns if c != anchor_key]
        return near.unionByName(rest.select("*", *empty))
    answers = answers.withColumnsRenamed({"p_lat": anchor_at[0], "p_lon": anchor_at[1]})
    return near.unionByName(rest.join(answers, list(anchor_at), "left").select(*near.columns))
