"""Joins and rankings that keep working when one key holds a large share of the rows."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapaudit.config import DEFAULT, AuditConfig
from mapaudit.session import cut

ROW_BYTES = 128  # generous size of one row of a broadcast table
_HELD = 3  # the driver holds a broadcast as collected rows, as a hash table and as the blocks it sends
_TASK_WORK = 5_000_000  # pairs compared by a task of a shuffled join; a row counts as _ROW_WORK pairs
_ROW_WORK = 16
_MOST_TASKS = 10_000
_LEAST_PAIRS = 1_000_000  # keys with fewer pairs are not cut
_NULL_FAN = 1024  # rows with a null key match nothing: spread them evenly


DICE = "_dice"


def with_dice(df: DataFrame) -> DataFrame:
    """Adds the number in [0, 1) that salting uses.

    It is drawn once, where the rows are still in scan order, and travels with
    the row: a task that is run again after a lost executor deals every row to
    the same place, also behind a shuffle, and exact copies still spread.
    """
    return df if DICE in df.columns else df.withColumn(DICE, F.rand(11))


def _throw(df: DataFrame) -> Column:
    """The drawn number, or else one from the row's content, which a task run again gives again."""
    if DICE in df.columns:
        return F.col(DICE)
    plain = [f.name for f in df.schema.fields if "map" not in f.dataType.simpleString()]
    return F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in plain)), F.lit(1 << 30)) / float(1 << 30)


def fits_broadcast(rows: int, cfg: AuditConfig, row_bytes: int = ROW_BYTES) -> bool:
    if cfg.join_strategy != "auto":
        return cfg.join_strategy == "broadcast"
    return rows * row_bytes * _HELD <= cfg.broadcast_bytes


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str, cfg: AuditConfig,
                sized_by: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Equi-join that broadcasts ``small`` only when its counted size allows it.

    ``asked`` is a stored table whose ``keys`` include all those of ``big``: where ``small`` is too large, its rows under
    other keys, which an inner or left join cannot use, are dropped first. Hot keys are counted on ``sized_by``, an input
    that is cheaper to make than ``big`` and has no fewer rows of any key.
    """
    auto = cfg.join_strategy == "auto"
    fits = fits_broadcast(small.count() if auto else 0, cfg)
    if asked is not None and auto and not fits:
        wanted = asked.select(*keys).distinct()
        by_list = fits_broadcast(wanted.count(), cfg)
        small = cut(small.join(F.broadcast(wanted) if by_list else wanted.hint("merge"), keys, "left_semi"), "asked")
        fits = fits_broadcast(small.count(), cfg)
    if fits:
        return big.join(F.broadcast(small), keys, how)
    fan = None if sized_by is None else cut(hot_keys(sized_by.select(*keys), keys, cfg.hot_rows), "hot")
    return salted_join(big, small, keys, how, cfg.hot_rows, fan=fan)


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """(keys, _fan) for keys with more than ``hot_rows`` rows.

    Counts are combined map-side. At most rows / hot_rows keys can qualify, so
    the result is small enough to broadcast whatever the input size.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_fan"))
    )


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str, hot_rows: int,
                condition: Column | None = None, fan: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Shuffle equi-join of ``big`` with ``small`` ("inner" or "left").

    Rows of a hot key are dealt out over several tasks and the matching rows of
    ``small`` are copied to each, so no task gets a whole hot key. A ``big`` that
    went through a shuffle carries its dice (see ``with_dice``). The hint keeps Spark from a broadcast that it
    would choose by the size of the files ``small`` comes from: rows made since, such as cover cells, are not in it.
    A caller that has counted the work gives the ``fan`` of each hot key and the number of ``tasks``.
    """
    by_list = fan is None or fits_broadcast(fan.count(), DEFAULT)
    fan = hot_keys(big.select(*keys), keys, hot_rows) if fan is None else fan
    fan = F.broadcast(fan) if by_list else fan.hint("merge")
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    left = big.join(fan, keys, "left").withColumn(
        "_salt",
        F.when(no_key, F.floor(_throw(big) * _NULL_FAN))
        .otherwise(F.floor(_throw(big) * F.coalesce("_fan", F.lit(1)))).cast("int"),
    ).drop("_fan")
    right = (
        small.join(fan, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1)))
        .drop("_fan")
    )
    on = keys + ["_salt"]
    if tasks is not None:  # a number that is given is not merged again by bytes
        left, right = left.repartition(tasks, *on), right.repartition(tasks, *on)
    if condition is None:
        return left.join(right.hint("merge"), on, how).drop("_salt")
    for k in on:
        right = right.withColumnRenamed(k, f"_r{k}")
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_r{k}") for k in on])
    return left.join(right.hint("merge"), match & condition, how).drop("_salt", *[f"_r{k}" for k in on])


def measure(df: DataFrame) -> tuple[int, int]:
    """Number of rows and the mean bytes that one takes in a broadcast, from one scan."""
    sizes = [F.octet_length(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() == "string"]
    sizes += [F.octet_length(F.to_json(F.struct(f"`{f.name}`"))) for f in df.schema.fields if f.dataType.typeName() in ("map", "array", "struct")]
    width = sum((F.coalesce(s, F.lit(0)) for s in sizes), F.lit(0)).cast("double")
    rows, mean = df.agg(F.count(F.lit(1)), F.coalesce(F.avg(width), F.lit(0.0))).first()
    return rows, max(ROW_BYTES, 64 + 16 * len(df.columns) + math.ceil(mean))


def pair_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _p, _q): rows of each key on the left and on the right. Stored."""
    counts = [side.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
              for side, name in ((left, "_p"), (right, "_q"))]
    both = counts[0].join(counts[1], keys, "full").select(
        *keys, F.coalesce("_p", F.lit(0)).cast("double").alias("_p"), F.coalesce("_q", F.lit(0)).cast("double").alias("_q"))
    return cut(both, "counts")


@dataclass(frozen=True)
class Meeting:
    """What a join on ``keys`` has to do, from the stored counts of both sides."""
    counts: DataFrame
    pairs: float
    rows: float
    right_rows: int  # on the right under a key that the left has too
    densest: int  # most of them under one key

    def tasks(self, spread: int, work: int | None = None) -> int:
        return min(_MOST_TASKS, max(spread, math.ceil((self.pairs + _ROW_WORK * self.rows) / (work or _TASK_WORK))))

    def fan(self, keys: list[str], cfg: AuditConfig, tasks: int) -> DataFrame:
        """(keys, _fan): the parts that the left rows of a key are dealt to so that none has more pairs or rows than a
        fraction of a task. A part has at least as many left rows as the right, so the copies are no more than the left."""
        p, q = F.col("_p"), F.col("_q")
        pairs = min(float(cfg.task_pairs), max(float(_LEAST_PAIRS), self.pairs / (8 * tasks)))
        parts = F.least(F.ceil(p * q / pairs), F.greatest(F.lit(1), F.floor(p / F.greatest(q, F.lit(1.0)))))
        parts = F.greatest(parts, F.ceil(p / cfg.hot_rows)).cast("int")
        return self.counts.where((p > 0) & (q > 0)).select(*keys, parts.alias("_fan")).where("_fan > 1")


def meet_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> Meeting:
    counts = pair_counts(left, right, keys)
    p, q = F.col("_p"), F.col("_q")
    met = F.when(p > 0, q).otherwise(F.lit(0.0))
    row = counts.agg(*(F.coalesce(f, F.lit(0.0)) for f in (F.sum(p * q), F.sum(p + q), F.sum(met), F.max(met)))).first()
    return Meeting(counts, row[0], row[1], int(row[2]), int(row[3]))


def only_met(right: DataFrame, keys: list[str], meeting: Meeting) -> DataFrame:
    """The rows of the right under keys that the left has: all that an inner or left join can use."""
    met = meeting.counts.where((F.col("_p") > 0) & (F.col("_q") > 0)).select(*keys)
    by_list = fits_broadcast(met.count(), DEFAULT)
    return right.join(F.broadcast(met) if by_list else met.hint("merge"), keys, "left_semi")


def dealt_evenly(df: DataFrame, tasks: int) -> DataFrame:
    """The rows in ``tasks`` partitions by their dice, for joins whose work per row is large."""
    return df.repartition(tasks, F.floor(_throw(df) * float(1 << 30)))


def pair_grid(left: DataFrame, right: DataFrame, keys: list[str], cfg: AuditConfig, counts: DataFrame | None = None) -> DataFrame:
    """(keys, _rows, _cols) for keys that are too much for one task.

    That is more than ``hot_rows`` rows on a side or more than ``task_pairs`` pairs. Left rows are dealt to ``_rows``
    parts, right rows to ``_cols``, and each (row, column) holds at most about ``task_pairs`` pairs. A listed key has at
    least sqrt(task_pairs) rows on a side; should the list still not fit a broadcast, larger tasks are allowed.
    """
    both = pair_counts(left, right, keys) if counts is None else counts
    p, q, hot, pairs = F.col("_p"), F.col("_q"), cfg.hot_rows, float(cfg.task_pairs)
    both = both.where((p > hot) | (q > hot) | (p * q > pairs))
    heavy = both
    while not fits_broadcast(heavy.count(), replace(cfg, join_strategy="auto")):
        hot, pairs = 4 * hot, 16 * pairs
        heavy = both.where((p > hot) | (q > hot) | (p * q > pairs))
    side = math.sqrt(pairs)

    def parts(mine, other):
        even = F.when(other <= side, mine * other / pairs).when(mine <= side, F.lit(1.0)).otherwise(mine / side)
        return F.greatest(F.lit(1), F.ceil(even), F.ceil(mine / hot)).cast("int")

    return heavy.select(*keys, parts(p, q).alias("_rows"), parts(q, p).alias("_cols"))


def deal_pairs(left: DataFrame, right: DataFrame, keys: list[str], grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with (_row, _col): a left row gets one row of its key's grid and a copy for each column, a right row
    one column and a copy for each row, so every pair of equal keys meets exactly once."""
    grid = F.broadcast(grid)
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])

    def place(df: DataFrame, parts: str) -> Column:
        return F.floor(_throw(df) * F.coalesce(parts, F.lit(1))).cast("int")

    def every(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))

    dealt = left.join(grid, keys, "left").withColumn("_row", F.when(no_key, F.floor(_throw(left) * _NULL_FAN).cast("int")).otherwise(place(left, "_rows")))
    dealt = dealt.withColumn("_wide", F.coalesce(F.col("_cols") > 1, F.lit(False))).withColumn("_col", every("_cols")).drop("_rows", "_cols")
    across = right.join(grid, keys, "left").withColumn("_col", place(right, "_cols")).withColumn("_row", every("_rows")).drop("_rows", "_cols")
    return dealt, across


def matrix_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, condition: Column, at: list[str], cfg: AuditConfig,
                left_made: dict[str, Column] | None = None, right_made: dict[str, Column] | None = None,
                meeting: Meeting | None = None) -> DataFrame:
    """Shuffle equi-join ("inner" or "left") in which a heavy key is many tasks' work whichever side is heavy.

    The counted pairs, not the bytes of the rows, decide the number of tasks, and keys are cut until each task has
    several parts, so that tasks are even. ``at`` names the left columns that ``condition`` reads; ``left_made`` and
    ``right_made`` are columns for it that are made behind the shuffle. With "left", a left row of a key cut into several
    columns is kept without a match if none of its columns has one, which is asked by the distinct ``at`` of the rows that have.
    """
    meeting = meet_counts(left, right, keys) if meeting is None else meeting
    tasks = meeting.tasks(left.sparkSession.sparkContext.defaultParallelism)
    finer = replace(cfg, task_pairs=int(min(cfg.task_pairs, max(_LEAST_PAIRS, meeting.pairs / (8 * tasks)))))
    grid = cut(pair_grid(left, right, keys, finer, meeting.counts), "grid")
    dealt, across = deal_pairs(left, right, keys, grid)
    on = [*keys, "_row", "_col"]
    across = across.withColumnsRenamed({k: f"_r{k}" for k in on})
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_r{k}") for k in on]) & condition
    left_made, right_made = left_made or {}, right_made or {}
    # a number of partitions that is given is not merged again by their bytes
    across = across.repartition(tasks, *(f"_r{k}" for k in on)).withColumns(right_made).hint("merge")

    def meet(rows: DataFrame, kind: str) -> DataFrame:
        return rows.repartition(tasks, *on).withColumns(left_made).join(across, match, kind)

    drop = ["_row", "_col", "_wide", *(f"_r{k}" for k in on), *left_made, *right_made]
    if how == "inner" or grid.where("_cols > 1").isEmpty():
        return meet(dealt, how).drop(*drop)
    wide = dealt.where("_wide")
    hits = meet(wide.select(*on, *at), "left_semi").select(*keys, "_row", *at).distinct()
    lone = wide.where("_col = 0").join(hits, [*keys, "_row", *at], "left_anti").drop(*drop)
    found = meet(dealt.where("not _wide"), "left").unionByName(meet(wide, "inner"))
    return found.drop(*drop).unionByName(lone, allowMissingColumns=True)


def keep_rank_one(df: DataFrame, keys: list[str], value: str, sized_by: DataFrame, hot_rows: int) -> DataFrame:
    """Rows with ``rank() over (partition by keys order by value nulls last) = 1``.

    Ordinary groups go through the window. For a group with more than
    ``hot_rows`` rows (counted on ``sized_by``, a narrow input holding the same
    groups) the minimum is aggregated map-side first, losers are dropped before
    the shuffle and the tied winners are ranked in several parts.
    """
    hot = F.broadcast(hot_keys(sized_by.select(*keys), keys, hot_rows))
    renamed = [F.col(k).alias(f"_h{k}") for k in keys]

    def same(prefix: str = "_h") -> Column:
        return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])

    hot_best = (
        df.select(*keys, value)
        .join(F.broadcast(hot.select(*renamed, "_fan")), same())
        .groupBy(*[f"_h{k}" for k in keys], "_fan")
        .agg(F.min(value).alias("_hot_best"))
    )
    window = Window.partitionBy(*keys, "_salt").orderBy(F.asc_nulls_last(value))
    return (
        df.join(F.broadcast(hot_best), same(), "left")
        .where(F.col("_fan").isNull() | F.col(value).eqNullSafe(F.col("_hot_best")))
        .withColumn("_salt", F.floor(_throw(df) * F.coalesce("_fan", F.lit(1))).cast("int"))
        .withColumn("_rank", F.rank().over(window))
        .where(F.col("_rank") == 1)
        .drop("_rank", "_salt", "_fan", "_hot_best", *[f"_h{k}" for k in keys])
    )
