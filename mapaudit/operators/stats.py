"""Counts, histograms and samples over detections and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapaudit.config import TARGET_CLASSES


def class_counts(det: DataFrame) -> DataFrame:
    return det.groupBy("class_name").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "class_name")


def type_counts(nodes: DataFrame, n: int = 20) -> DataFrame:
    counts = nodes.groupBy("osm_type").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "osm_type").limit(n)


def ingestion_status(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per named source: rows, earliest and latest value of its time column."""
    parts = [
        df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("record_count"),
               F.min(at).alias("earliest"), F.max(at).alias("latest"))
        for name, (df, at) in sources.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def row_counts(named: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for n, df in named.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def load_summary(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("total_nodes"), F.count_distinct("osm_type").alias("unique_types"))


def detection_stats(det: DataFrame) -> DataFrame:
    return det.agg(
        F.count_distinct("frame_number").alias("frames_with_detections"),
        F.max("frame_number").alias("last_frame"), F.count(F.lit(1)).alias("total_detections"),
        F.max("timestamp_sec").alias("duration_sec"), F.avg("confidence").alias("avg_confidence"),
        F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"),
    )


def frames_per_sign(stats: DataFrame, signs: DataFrame) -> DataFrame:
    """Mean number of detections per clustered sign; 0 without signs."""
    n = signs.agg(F.count(F.lit(1)).alias("n")).scalar()
    rate = F.when(n > 0, F.col("total_detections") / n).otherwise(0.0)
    return stats.withColumn("unique_signs", n).withColumn("avg_frames_per_sign", rate)


def confidence_histogram(det: DataFrame, bins: int = 10) -> DataFrame:
    """Counts per class in equal bins of [0, 1]; the last bin is closed, empty bins
    are shown, values outside are left out.

    The bin is the number of inner edges ``i * (1 / bins)`` at or below the value;
    those edges are floats, so ``floor(c * bins)`` would misplace 0.3, 0.6 and 0.7.
    """
    c = F.col("confidence")
    step = 1.0 / bins
    inner = sum((F.when(c >= i * step, 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    counted = (
        det.where(c.between(0, 1) & F.col("class_name").isNotNull())
        .groupBy("class_name", inner.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    frame = (
        det.where(F.col("class_name").isNotNull()).select("class_name").distinct()
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    )
    labels = F.array(*[F.lit(f"{i * step:.2f}-{(i + 1) * step:.2f}") for i in range(bins)])
    return frame.join(counted, ["class_name", "bin"], "left").select(
        "class_name", "bin", F.element_at(labels, F.col("bin") + 1).alias("range"),
        F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def detections_over_time(det: DataFrame, bins: int = 20, classes=TARGET_CLASSES) -> DataFrame:
    """Counts per time bin and given class, one column per class, zeros filled.

    Bins are equal parts of [min, max], closed on the right; the first also takes
    the minimum. Only bins with rows are listed. ``class_counts_over_time`` has the classes not given.
    """
    return (
        _time_bins(det, bins)
        .groupBy("time_bin").pivot("class_name", list(classes)).agg(F.count(F.lit(1))).fillna(0)
    )


def class_counts_over_time(det: DataFrame, bins: int = 20) -> DataFrame:
    """``time_bin, class_name, count`` of every class there is, in the bins of ``detections_over_time``.

    Only pairs with rows are listed.
    """
    return _time_bins(det, bins).groupBy("time_bin", "class_name").agg(F.count(F.lit(1)).alias("count"))


def _time_bins(det: DataFrame, bins: int) -> DataFrame:
    span = det.agg(F.min("timestamp_sec").alias("lo"), F.max("timestamp_sec").alias("hi"))
    span = span.select(F.struct("lo", ((F.col("hi") - F.col("lo")) / bins).alias("step"))).scalar()
    timed = det.where(F.col("class_name").isNotNull()).withColumn("_lo", span["lo"]).withColumn("_step", span["step"])
    passed = sum(
        (F.when(F.col("timestamp_sec") > F.col("_lo") + F.col("_step") * i, 1).otherwise(0) for i in range(bins)),
        F.lit(0))
    return timed.withColumn("time_bin", F.greatest(F.lit(1), passed))


def filter_detections(det: DataFrame, classes, min_conf: float) -> DataFrame:
    return det.where(F.col("class_name").isin(*classes) & (F.col("confidence") >= min_conf))


def at_time(det: DataFrame, t: float, half: float = 0.5) -> DataFrame:
    return det.where(F.col("timestamp_sec").between(t - half, t + half))


def class_confidence(det: DataFrame) -> DataFrame:
    return (
        det.where(F.col("class_name").isNotNull()).groupBy("class_name")
        .agg(F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("avg_confidence"))
    )


def video_counts(det: DataFrame) -> DataFrame:
    return det.groupBy("video_name").agg(F.count(F.lit(1)).alias("detections"))


def video_summary(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count(F.lit(1)).alias("videos"), F.sum("detections").alias("total_detections"),
                      F.avg("detections").alias("avg_per_video"))


def top_videos(counts: DataFrame, n: int = 5) -> DataFrame:
    return counts.orderBy(F.desc("detections"), "video_name").limit(n)


def recent_detections(det: DataFrame, n: int = 1000) -> DataFrame:
    return (
        det.where(F.col("vehicle_lat").isNotNull() & F.col("vehicle_lon").isNotNull())
        .select("detection_id", "class_name", F.col("vehicle_lat").alias("lat"), F.col("vehicle_lon").alias("lon"),
                F.col("recording_timestamp").alias("timestamp"), "confidence", "ingested_at")
        .orderBy(F.desc("ingested_at"), "detection_id").limit(n)
    )


def node_sample(nodes: DataFrame, osm_type: str | None = None, n: int = 5) -> DataFrame:
    """First n nodes by id, of one type or of any, with their tags where ``nodes`` have them."""
    chosen = nodes if osm_type is None else nodes.where(F.col("osm_type") == osm_type)
    shown = ["osm_id", "osm_type", "latitude", "longitude", *(c for c in ("tags",) if c in nodes.columns)]
    return chosen.select(*shown).orderBy("osm_id").limit(n)
