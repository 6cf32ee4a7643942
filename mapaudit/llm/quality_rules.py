"""Quality rules: base limits, then robust multivariate outliers per language and source.

Each text becomes a vector of transformed statistics. For every (lang, source) the minimum covariance
determinant estimate of mean and covariance is found by concentration from two starts (medians and absolute
deviations, without and with the correlations of spatial signs): the half of the rows with the smallest distance
gives the next mean and covariance, until its limit stays; the start that ends with the smaller determinant
counts. Rows far away by the resulting Mahalanobis distance are rejected. A (lang, source) of few rows is judged
by the estimate over all rows of its language, and where those are few too, by that over all rows; every
row that passes the base limits has a distance. All of it is DataFrame expressions; a step is two combining
aggregates and a join with one small row per pool.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapaudit.session import cut


@dataclass(frozen=True)
class RuleConfig:
    least_words: int = 20
    most_repeated: int = 30  # percent of words in repeated windows
    window: int = 8
    core: float = 0.5  # part of a group that the estimate rests on
    most_steps: int = 30  # concentration steps of a start whose limit does not stay before
    cutoff: float = 45.0  # squared distance; about 4e-9 of clean normal rows lie beyond
    least_rows: int = 50  # a smaller group is judged by the pool of its language, or of all rows
    broadcast_groups: int = 50_000


DEFAULT = RuleConfig()

#: Transformed statistics with the least standard deviation that each is given, so that a statistic that
#: most rows share (no symbols at all) does not make a lone one an outlier.
FEATURES = {
    "mean_length": ("ln(word_chars / n_words)", 0.05),
    "symbols": ("ln(0.002 + n_symbols / word_chars)", 0.4),
    "repeated": ("ln(0.02 + n_repeat_words / n_words)", 0.6),
    "words": ("ln(n_words)", 0.25),
}
SCALE = 4096  # statistics are whole multiples of one part of this
_P = len(FEATURES)
_X = list(FEATURES)
#: Distances on a scale of 1024 steps for each doubling of 1 + d2: some 60,000 values at most.
_STEP = "cast(floor(log2(1 + d2) * 1024) as long)"
_KEY = ["g_level", "g_lang", "g_source"]  # level 0: a group, 1: a language, 2: all rows


def _chi2(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees: one minus a Poisson sum."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def consistency(core: float) -> float:
    """Factor that makes the covariance of the core right for normal data."""
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2(middle, _P) < core else (low, middle)
    return core / _chi2(low, _P + 2)


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("lang", "source"), window: int = 8) -> DataFrame:
    """``doc_id``, the columns of ``keep`` and the base statistics of every row's whole text.

    Words are runs outside space and \\t to \\r. Null and empty texts count 0 everywhere.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *keep, text.alias("text"),
                       F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "").alias("words"),
                       F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("lines"))
    some = F.size("words") > window
    rows = rows.select(
        "doc_id", *keep, F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(some, F.transform(F.sequence(F.lit(1), F.size("words") - (window - 1)),
                                 lambda i: F.xxhash64(F.slice("words", i, window)))).alias("windows"))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("sorted", F.when(twice, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.drop("windows").withColumn("places", F.sort_array(F.filter(
        F.transform("sorted", _repeated), lambda i: i.isNotNull())))
    covered = F.aggregate(
        F.transform("places", lambda i, k: F.least(F.lit(window), F.coalesce(F.get("places", k + 1) - i, F.lit(window)))),
        F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("sorted", "places")


def _repeated(x: Column, k: Column) -> Column:
    """The place of a window whose hash its neighbour in sorted order has too."""
    before, after = F.get("sorted", k - 1)["h"], F.get("sorted", k + 1)["h"]
    return F.when(F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False)), x["i"])


def _with_groups(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if few else groups, _KEY)


def _distance(rows: DataFrame) -> DataFrame:
    """Adds ``d2`` by forward substitution through the group's triangular factor."""
    for i, x in enumerate(_X):
        inner = F.col(f"x_{x}") - F.col(f"m{i}")
        for j in range(i):
            inner = inner - F.col(f"l{i}{j}") * F.col(f"z{j}")
        rows = rows.withColumn(f"z{i}", inner / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, _P)), F.col("z0") * F.col("z0")))


def _factor(groups: DataFrame, *more: str) -> DataFrame:
    """From ``c{i}{j}`` (covariance) to ``l{i}{j}`` (its Cholesky factor), floors added."""
    for i, x in enumerate(_X):
        for j in range(i + 1):
            value = F.col(f"c{i}{j}") + (FEATURES[x][1] ** 2 if i == j else 0.0)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            groups = groups.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l{j}{j}"))
    return groups.select(*_KEY, *more, *(f"m{i}" for i in range(_P)), *(f"l{i}{j}" for i in range(_P) for j in range(i + 1)))


def _pools(rows: DataFrame, cfg: RuleConfig) -> DataFrame:
    """``g_lang, g_source, judge, pools`` of every group: the pool that judges it and those that its rows count in."""
    def pool(level, lang, source):
        return F.struct(F.lit(level).alias("g_level"), F.col("g_lang") if lang else F.lit("").alias("g_lang"),
                        F.col("g_source") if source else F.lit("").alias("g_source"))

    counts = cut(rows.groupBy("g_lang", "g_source").agg(F.count("*").alias("rows")), "counts")
    small = F.col("rows") < cfg.least_rows
    langs = cut(counts.groupBy("g_lang").agg(F.sum("rows").alias("lang_rows"), F.max(small).alias("asked")), "counts")
    poor = F.col("lang_rows") < cfg.least_rows
    all_asked = not langs.where(poor).isEmpty()
    own, lang, every = pool(0, True, True), pool(1, True, False), pool(2, False, False)
    few = langs.count() <= cfg.broadcast_groups
    return counts.join(F.broadcast(langs) if few else langs, "g_lang").select(
        "g_lang", "g_source", F.when(~small, own).when(~poor, lang).otherwise(every).alias("judge"),
        F.filter(F.array(F.when(~small, own), F.when(F.col("asked") & ~poor, lang), every if all_asked else F.lit(None)),
                 lambda p: p.isNotNull()).alias("pools"))


def _limits(counted: DataFrame, key: list[str], value: str, share: float) -> DataFrame:
    """``key, limit``: the least value that at least ``share`` of a key's rows do not exceed, from ``n`` rows per value.

    Exact, so it does not depend on how rows are dealt. A key's window holds one row per distinct value, and values
    come from a bounded scale.
    """
    window = Window.partitionBy(*key)
    ranked = counted.select(*key, value, F.sum("n").over(window.orderBy(value)).alias("upto"), F.sum("n").over(window).alias("all"))
    return ranked.where(F.col("upto") >= share * F.col("all")).groupBy(*key).agg(F.min(value).alias("limit"))


def _medians(rows: DataFrame, values: list[Column], name: str) -> DataFrame:
    """``{name}{i}``: the lower median of each value per pool."""
    each = rows.select(*_KEY, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(values)))).alias("e"))
    found = _limits(each.groupBy(*_KEY, "e.i", "e.v").agg(F.count("*").alias("n")), [*_KEY, "i"], "v", 0.5)
    return found.groupBy(*_KEY).agg(*(F.max(F.when(F.col("i") == i, F.col("limit"))).alias(f"{name}{i}") for i in range(_P)))


def _halves(a: Column, b: Column, name: str) -> list[Column]:
    """The exact sum of products of whole numbers, as two sums that do not overflow."""
    return [F.sum(F.shiftright(a * b, 16)).alias(f"{name}h"), F.sum((a * b).bitwiseAND(F.lit(65535))).alias(f"{name}l")]


def _whole_sum(name: str) -> Column:
    return F.col(f"{name}h") * F.lit(65536.0) + F.col(f"{name}l")


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(_P) for j in range(i + 1)]


def _starts(rows: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Two first estimates of every pool: ``start`` 0 from medians and absolute deviations alone, 1 with the
    correlations of the spatial signs (scaled rows brought to length 1) as well."""
    q = [F.col(f"q{i}") for i in range(_P)]
    middle = cut(_medians(rows, q, "o"), "groups")
    few = middle.count() <= cfg.broadcast_groups
    middle = cut(middle.join(_medians(_with_groups(rows, middle, few), [F.abs(q[i] - F.col(f"o{i}")) for i in range(_P)], "s"), _KEY), "groups")
    width = [F.sqrt(F.pow(1.4826 * F.col(f"s{i}"), 2) + (FEATURES[x][1] * SCALE) ** 2) for i, x in enumerate(_X)]
    signs = _with_groups(rows, middle, few).select(*_KEY, *(((q[i] - F.col(f"o{i}")) / width[i]).alias(f"z{i}") for i in range(_P)))
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, _P)), F.col("z0") * F.col("z0")))
    signs = signs.withColumn("length", length).select(*_KEY, *(
        F.when(F.col("length") > 0, F.floor(F.col(f"z{i}") / F.col("length") * SCALE + 0.5)).otherwise(0).cast("long").alias(f"u{i}") for i in range(_P)))
    turned = signs.groupBy(*_KEY).agg(F.count("*").alias("n"), *(h for i, j in _pairs() for h in _halves(F.col(f"u{i}"), F.col(f"u{j}"), f"t{i}{j}")))
    groups = middle.join(turned, _KEY).select(
        *_KEY, F.explode(F.array(F.lit(0), F.lit(1))).alias("start"), *(F.col(f"o{i}") / SCALE for i in range(_P)),
        *(F.when(F.col("start") == 1, _whole_sum(f"t{i}{j}") / F.col("n") * _P / SCALE**4 * width[i] * width[j])
          .otherwise(F.pow(1.4826 * F.col(f"s{i}") / SCALE, 2) if i == j else F.lit(0.0)) for i, j in _pairs()))
    return _factor(groups.toDF(*_KEY, "start", *(f"m{i}" for i in range(_P)), *(f"c{i}{j}" for i, j in _pairs())), "start")


def _concentrated(rows: DataFrame, groups: DataFrame, cfg: RuleConfig, few: bool) -> DataFrame:
    """One step: the ``cfg.core`` of a pool's rows with the smallest distance gives its next mean and factor.

    ``limit`` is the last distance inside the core, ``settled`` whether the step before had the same.
    """
    key = [*_KEY, "start"]
    far = _distance(_with_groups(rows, groups, few)).withColumn("step", F.expr(_STEP))
    limits = cut(_limits(far.groupBy(*key, "step").agg(F.count("*").alias("n")), key, "step", cfg.core), "limits")
    bounded = groups.withColumnRenamed("limit", "before").join(limits, key)
    core = _distance(_with_groups(rows, bounded, few)).where(F.expr(_STEP) <= F.col("limit"))
    q = [F.col(f"q{i}") for i in range(_P)]
    sums = core.groupBy(*key, "limit", "before").agg(
        F.count("*").alias("n"), *(F.sum(v).alias(f"t{i}") for i, v in enumerate(q)), *(h for i, j in _pairs() for h in _halves(q[i], q[j], f"t{i}{j}")))
    scale = consistency(cfg.core) / SCALE**2
    mean = [F.col(f"t{i}") / F.col("n") for i in range(_P)]
    moved = sums.select(*key, "limit", F.coalesce(F.col("limit") == F.col("before"), F.lit(False)).alias("settled"),
                        *((m / SCALE).alias(f"m{i}") for i, m in enumerate(mean)),
                        *(((_whole_sum(f"t{i}{j}") / F.col("n") - mean[i] * mean[j]) * scale).alias(f"c{i}{j}") for i, j in _pairs()))
    return _factor(moved, "start", "limit", "settled")


def estimates(rows: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """Mean ``m{i}`` and Cholesky factor ``l{i}{j}`` that judge each (g_lang, g_source): its own ones from
    ``cfg.least_rows`` rows on, else those of its language from as many rows on, else those of all rows.

    Both starts of a pool take concentration steps until the core's limit stays; the one with the smaller
    determinant is taken. Statistics are whole multiples of 1 / SCALE, all sums, medians and limits are exact, so
    the result does not depend on the number of partitions. Distances on one step of the scale are ties, and ties
    with the limit belong to the core.
    """
    pools = cut(_pools(rows, cfg), "pools")
    held = pools.select("g_lang", "g_source", "pools")
    rows = rows.join(F.broadcast(held) if held.count() <= cfg.broadcast_groups else held, ["g_lang", "g_source"])
    rows = rows.withColumn("pool", F.explode("pools")).select("pool.*", *(F.floor(F.col(f"x_{x}") * SCALE + 0.5).cast("long").alias(f"q{i}") for i, x in enumerate(_X)))
    rows = cut(rows, "vectors")
    rows = rows.select("*", *((F.col(f"q{i}") / SCALE).alias(f"x_{x}") for i, x in enumerate(_X)))
    groups = _starts(rows, cfg).withColumns({"limit": F.lit(None).cast("long"), "settled": F.lit(False)})
    groups = cut(groups, "groups")
    few = groups.count() <= cfg.broadcast_groups
    for _ in range(cfg.most_steps):
        moving = groups.where("not settled")
        if moving.isEmpty():
            break
        moved = _concentrated(rows, moving, cfg, few)
        groups = cut(groups.where("settled").unionByName(moved), "groups")
    values = [c for c in groups.columns if c[0] in "ml" and c[1:].isdigit()]
    volume = F.col("l00")
    for i in range(1, _P):
        volume = volume * F.col(f"l{i}{i}")
    best = groups.groupBy(*_KEY).agg(F.min(F.struct(volume.alias("volume"), "start", *values)).alias("best"))
    found = best.select(F.struct(*_KEY).alias("pool"), *(f"best.{c}" for c in values))
    judged = pools.select("g_lang", "g_source", F.col("judge").alias("pool"))
    return cut(judged.join(F.broadcast(found) if few else found, "pool").drop("pool"), "groups")


def quality_rules(docs: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance``.

    kept is false if base_failed, else whether the squared distance is within the cutoff; distance is null
    only if base_failed. A group of fewer than ``cfg.least_rows`` rows is judged by the pool of its language, or
    of all rows (see ``estimates``). A null lang or source is a group of its own kind. Repeated rows and null
    ids stay.
    """
    null = F.lit("\u0000")
    stats = statistics(docs, window=cfg.window)
    failed = (F.col("n_words") < cfg.least_words) | (100 * F.col("n_repeat_words") > cfg.most_repeated * F.col("n_words"))
    stats = stats.select("doc_id", F.coalesce(F.col("lang").cast("string"), null).alias("g_lang"), F.coalesce(F.col("source").cast("string"), null).alias("g_source"),
                         "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))
    stats = cut(stats, "statistics")
    vectors = stats.where("not base_failed")
    shown = [F.expr(e).alias(f"x_{x}") for x, (e, _) in FEATURES.items()]
    groups = estimates(vectors.select("g_lang", "g_source", *shown), cfg)
    few = groups.count() <= cfg.broadcast_groups
    rows = stats.select("*", *(F.when(~F.col("base_failed"), F.floor(c * SCALE + 0.5) / SCALE).alias(f"x_{x}") for c, x in zip(shown, _X)))
    rows = rows.join(F.broadcast(groups) if few else groups, ["g_lang", "g_source"], "left")
    return _distance(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                                  (~F.col("base_failed") & F.coalesce(F.col("d2") <= cfg.cutoff, F.lit(False))).alias("kept"), F.sqrt("d2").alias("distance"))
