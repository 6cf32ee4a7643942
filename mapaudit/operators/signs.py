"""Distinct physical signs from repeated detections.

Rows are walked in (frame, id) order per video and class; a row that no earlier
sign covers becomes a sign, and a sign covers rows less than 100 frames, 200
pixels across and 100 pixels down away. The rule is sequential, but a row only
depends on earlier signs inside that box, so the walk splits:

* exact copies collapse first (a copy is always covered by, or like, its first);
* a gap of 100 frames separates independent islands, found on a table of
  100-frame blocks that is aggregated map-side;
* islands of ordinary size are packed into tasks and walked whole;
* a larger one is cut into bricks of (frames, u, v). Every brick is walked with
  the signs its neighbours found in the round before, until no sign changes.
  Statuses that agree everywhere with the rule are unique, so the fixed point is
  the sequential answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapaudit.config import DEFAULT, AuditConfig
from mapaudit.operators.skew import DICE, lookup_join
from mapaudit.session import cut

# Reach of one sign.
FRAME_REACH, U_REACH, V_REACH = 100, 200.0, 100.0
_BRICK = {"frame_number": 3000, "u": 800, "v": 400}
_PACK_ROWS = 20_000
_GROUP = ["video_name", "class_name"]
_COLUMNS = ["video_name", "class_name", "frame_number", "u", "v", "detection_id"]
_SCHEMA = "video_name string, class_name string, frame_number int, u double, v double, detection_id string"


def _walk_many(rows: pd.DataFrame) -> pd.DataFrame:
    """Walks several (video, class) groups in one go, their frames set far apart."""
    group = rows.groupby(_GROUP, sort=False).ngroup().to_numpy()
    real = rows["frame_number"].to_numpy()
    gap = np.int64(real.max()) - np.int64(real.min()) + FRAME_REACH
    found = _walk(rows.assign(frame_number=real + group * gap, _real=real))
    return found.assign(frame_number=found.pop("_real").astype("int32"))


def _walk(rows: pd.DataFrame, earlier: pd.DataFrame | None = None) -> pd.DataFrame:
    """Signs among ``rows``, given signs found outside of them."""
    rows = rows.sort_values(["frame_number", "detection_id"], kind="stable").reset_index(drop=True)
    frame, u, v = (rows[c].to_numpy(float) for c in ("frame_number", "u", "v"))
    free = np.ones(len(rows), bool)

    def cover(f: float, su: float, sv: float, start: int) -> None:
        stop = np.searchsorted(frame, f + FRAME_REACH, "left")
        part = slice(start, stop)
        free[part] &= ~((np.abs(u[part] - su) < U_REACH) & (np.abs(v[part] - sv) < V_REACH))

    if earlier is not None and len(earlier):
        ids = rows["detection_id"].to_numpy(object)
        for f, su, sv, key in earlier[["frame_number", "u", "v", "detection_id"]].itertuples(index=False):
            start = np.searchsorted(frame, f, "left")
            while start < len(rows) and frame[start] == f and ids[start] <= key:
                start += 1
            cover(f, su, sv, start)
    chosen = []
    for i in range(len(rows)):
        if free[i]:
            chosen.append(i)
            cover(frame[i], u[i], v[i], i + 1)
    return rows.iloc[chosen][[c for c in (*_COLUMNS, "_real") if c in rows]]


def _islands(rows: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Rows with their island's row count and a pack number: consecutive islands of
    a (video, class) share a pack until it holds ``_PACK_ROWS``."""
    block = F.floor(F.col("frame_number") / FRAME_REACH).alias("_block")
    blocks = rows.groupBy(*_GROUP, block).agg(
        F.min("frame_number").alias("_first"), F.max("frame_number").alias("_last"), F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*_GROUP).orderBy("_block")
    opens = F.coalesce(F.col("_first") - F.lag("_last").over(order) >= FRAME_REACH, F.lit(True))
    numbered = blocks.withColumn("_opens", opens.cast("int")).withColumn("_island", F.sum("_opens").over(order))
    island = Window.partitionBy(*_GROUP, "_island")
    before = F.sum("_n").over(order) - F.col("_n")
    sized = (
        numbered.withColumn("_before", before).withColumn("_size", F.sum("_n").over(island))
        .withColumn("_pack", F.floor(F.min("_before").over(island) / _PACK_ROWS))
        .select(*_GROUP, "_block", "_pack", "_size")
    )
    # rows are distinct, so a hash of the row is a fair and repeatable die
    dice = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)) / float(1 << 20)
    keyed = rows.withColumn("_block", block).withColumn(DICE, dice)
    return lookup_join(keyed, cut(sized, "blocks"), [*_GROUP, "_block"], "inner", cfg).drop("_block", DICE)


def _bricks(rows: DataFrame) -> DataFrame:
    keys = [*_GROUP, "_f", "_u", "_v"]
    names = dict(zip(("frame_number", "u", "v"), ("_f", "_u", "_v")))
    placed = cut(rows.select(*_COLUMNS, *[F.floor(F.col(c) / _BRICK[c]).alias(k) for c, k in names.items()]), "bricks")

    def outside(signs: DataFrame) -> DataFrame:
        def span(column: str, back: float, ahead: float):
            size = _BRICK[column]
            return F.explode(F.sequence(F.floor((F.col(column) - back) / size), F.floor((F.col(column) + ahead) / size)))

        own = [F.floor(F.col(c) / _BRICK[c]).alias("_own" + k) for c, k in names.items()]
        spread = (
            signs.select(*_COLUMNS, *own)
            .withColumn("_f", span("frame_number", 0, FRAME_REACH - 1))
            .withColumn("_u", span("u", U_REACH, U_REACH)).withColumn("_v", span("v", V_REACH, V_REACH))
        )
        home = (F.col("_f") == F.col("_own_f")) & (F.col("_u") == F.col("_own_u")) & (F.col("_v") == F.col("_own_v"))
        return spread.where(~home).drop("_own_f", "_own_u", "_own_v")

    signs = cut(placed.groupBy(*keys).applyInPandas(lambda pdf: _walk(pdf), _SCHEMA), "signs")
    while True:
        again = cut(
            placed.groupBy(*keys).cogroup(outside(signs).groupBy(*keys)).applyInPandas(_walk, _SCHEMA), "signs")
        changed = again.join(signs, _COLUMNS, "left_anti").unionByName(signs.join(again, _COLUMNS, "left_anti"))
        if changed.isEmpty():
            return again
        signs = again


def unique_signs(det: DataFrame, island_rows: int = 200_000, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """One row per sign: (video, class, frame, u, v, detection_id) of its first detection.

    A row with an unknown class, frame or pixel resembles nothing and stands alone.
    """
    rows = det.select("video_name", "class_name", F.col("frame_number").cast("int").alias("frame_number"),
                      F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"), "detection_id")
    known = (F.col("class_name").isNotNull() & F.col("frame_number").isNotNull()
             & F.col("u").isNotNull() & F.col("v").isNotNull())
    distinct = (
        rows.where(known).withColumn("video_name", F.coalesce("video_name", F.lit("")))
        .groupBy("video_name", "class_name", "frame_number", "u", "v")
        .agg(F.min("detection_id").alias("detection_id"))
    )
    numbered = cut(_islands(distinct, cfg), "islands")
    small = numbered.where(F.col("_size") <= island_rows)
    tasks = numbered.count() // _PACK_ROWS + 1
    bucket = F.pmod(F.xxhash64(*_GROUP, "_pack"), F.lit(tasks)).alias("_bucket")
    # the walk is work per row: as many partitions as the rows ask for, and small data not in one task
    parts = max(tasks, int(det.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = small.select(*_COLUMNS, bucket).repartition(parts, "_bucket")
    signs = packed.groupBy("_bucket").applyInPandas(_walk_many, _SCHEMA)
    large = numbered.where(F.col("_size") > island_rows)
    if not large.isEmpty():
        signs = signs.unionByName(_bricks(large))
    return signs.unionByName(rows.where(~known))
