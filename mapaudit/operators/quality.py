"""Data checks. Row checks return the failing rows (empty = pass); ``not_null`` and
``accepted_range`` have a summary form that tests many columns in one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapaudit.config import AUDIT_STATUSES, TARGET_CLASSES
from mapaudit.functions.labels import count_if, rate_pct, recorded_at


def _long(counts: DataFrame, names: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"`{n}`").alias("failures")) for n in names])
    return counts.select(F.explode(pairs).alias("c")).select("c.*")


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def not_null_summary(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    names = [f"{label}.{c}" for c in columns]
    return _long(df.agg(*[count_if(F.col(c).isNull()).alias(n) for c, n in zip(columns, names)]), names)


def unique(df: DataFrame, key: str) -> DataFrame:
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_records"))
    return counts.where(F.col("n_records") > 1)


def accepted_values(df: DataFrame, column: str, values) -> DataFrame:
    """Values outside the list with their counts (aggregated before any shuffle)."""
    outside = df.where(~F.col(column).isin(*values))
    return outside.groupBy(F.col(column).alias("value_field")).agg(F.count(F.lit(1)).alias("n_records"))


def accepted_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None,
                   where: Column | None = None) -> DataFrame:
    bad: Column = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return df.where(bad if where is None else bad & where)


def verification_rate(fct: DataFrame, min_rate: float = 30.0, min_confidence: float = 0.7) -> DataFrame:
    """One row when fewer than ``min_rate`` percent of confident rows are verified."""
    totals = fct.where(F.col("confidence") >= min_confidence).agg(
        F.count(F.lit(1)).alias("total_detections"),
        count_if(F.col("audit_status") == "VERIFIED").alias("verified_count"))
    rated = totals.withColumn(
        "verification_rate_pct", F.round(rate_pct(F.col("verified_count"), F.col("total_detections")), 2))
    return rated.where(F.col("verification_rate_pct") < min_rate)


def future_dates(fct: DataFrame, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return fct.where(recorded_at(F.col("recording_timestamp")) > now).select(
        "video_name", "frame_number", "recording_timestamp")


def run_checks(raw: DataFrame, nodes: DataFrame, fct: DataFrame, now: Column | None = None) -> DataFrame:
    """All sixteen checks as (check_name, failures): one scan of each table, plus
    one aggregation for uniqueness."""
    now = F.current_timestamp() if now is None else now
    status, cls = F.col("audit_status"), F.col("detected_class")
    high = F.col("confidence") >= 0.7
    verified = count_if(high & (status == "VERIFIED"))
    facts = {
        **{f"fct.not_null.{c}": count_if(F.col(c).isNull())
           for c in ("video_name", "frame_number", "detected_class", "confidence", "audit_status")},
        "fct.accepted_values.detected_class": count_if(~cls.isin(*TARGET_CLASSES)),
        "fct.accepted_range.confidence": count_if(~F.col("confidence").between(0, 1)),
        "fct.accepted_range.distance_meters": count_if(F.col("distance_meters") < 0),
        "fct.accepted_values.audit_status": count_if(~status.isin(*AUDIT_STATUSES)),
        "fct.high_verification_rate": F.coalesce(
            F.when(F.round(rate_pct(verified, count_if(high)), 2) < 30, 1).otherwise(0), F.lit(0)).cast("long"),
        "fct.no_future_dates": count_if(recorded_at(F.col("recording_timestamp")) > now),
    }
    on_fct = _long(fct.agg(*[expr.alias(n) for n, expr in facts.items()]), list(facts))
    on_raw = not_null_summary(raw, ["record_content"], "raw.not_null")
    on_nodes = not_null_summary(nodes, ["osm_id", "latitude", "longitude"], "osm.not_null")
    copies = unique(nodes, "osm_id").agg(F.lit("osm.unique.osm_id").alias("check_name"),
                                         F.count(F.lit(1)).alias("failures"))
    return on_raw.unionByName(on_nodes).unionByName(copies).unionByName(on_fct)
