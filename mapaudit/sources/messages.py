"""Topic messages and the raw landing table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DETECTION_SCHEMA = T.StructType([
    T.StructField("detection_id", T.StringType()),
    T.StructField("vehicle_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("video_name", T.StringType()),
    T.StructField("frame_number", T.IntegerType()),
    T.StructField("timestamp_sec", T.DoubleType()),
    T.StructField("pixel_u", T.DoubleType()),
    T.StructField("pixel_v", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("class_name", T.StringType()),
    T.StructField("vehicle_lat", T.DoubleType()),
    T.StructField("vehicle_lon", T.DoubleType()),
    T.StructField("recording_timestamp", T.StringType()),
    T.StructField("object_lat", T.DoubleType()),
    T.StructField("object_lon", T.DoubleType()),
    T.StructField("distance", T.DoubleType()),
    T.StructField("roi_image_path", T.StringType()),
])


def to_messages(detections: DataFrame) -> DataFrame:
    """(key, value, headers, message): JSON without null fields, keyed by detection
    id, in the column layout the Kafka sink takes (drop ``message`` to write)."""
    present = [f.name for f in DETECTION_SCHEMA if f.name in detections.columns]
    message = F.struct(*present)
    headers = F.array(*[
        F.struct(F.lit(k).alias("key"), F.encode(F.coalesce(F.col(k), F.lit("")), "UTF-8").alias("value"))
        for k in ("vehicle_id", "session_id", "class_name")
    ])
    return detections.select(
        F.col("detection_id").alias("key"), F.to_json(message).alias("value"),
        headers.alias("headers"), message.alias("message"),
    )


def from_messages(messages: DataFrame, value: str = "value", keep: str | None = None) -> DataFrame:
    """Message JSON back to detection columns; absent keys become null, JSON that can't be read becomes a row of nulls.
    ``keep`` names a column for the message text."""
    text = F.col(value).cast("string")
    rest = [text.alias(keep)] if keep else []
    return messages.select(F.from_json(text, DETECTION_SCHEMA).alias("d"), *rest).select("d.*", *([keep] if keep else []))


def to_raw(messages: DataFrame, topic: str, kafka_time: Column | None = None,
           partition: Column | None = None, offset: Column | None = None) -> DataFrame:
    """Landing rows: message JSON as VARIANT plus topic metadata. Bad JSON lands as null content."""
    at = kafka_time if kafka_time is not None else F.current_timestamp()
    part = partition if partition is not None else F.lit(0)
    off = offset if offset is not None else F.lit(None)
    out = messages.select(
        F.try_parse_json(F.col("value").cast("string")).alias("record_content"),
        at.cast("timestamp_ntz").alias("ingested_at"),
        F.lit(topic).alias("kafka_topic"),
        part.cast("decimal(10,0)").alias("kafka_partition"),
        off.cast("decimal(38,0)").alias("kafka_offset"),
        at.cast("timestamp_ntz").alias("kafka_timestamp"),
        F.col("key").cast("string").alias("_key"),
    )
    metadata = F.try_parse_json(F.to_json(F.struct(
        F.col("_key").alias("key"), F.col("kafka_topic").alias("topic"),
        F.col("kafka_partition").cast("long").alias("partition"), F.col("kafka_offset").cast("long").alias("offset"))))
    return out.select(
        metadata.alias("record_metadata"), "record_content", "ingested_at", "kafka_topic",
        "kafka_partition", "kafka_offset", "kafka_timestamp",
    )


def with_topic_date(raw: DataFrame) -> DataFrame:
    """Adds ``topic_date``, the day of the topic time, by which the raw table is partitioned."""
    return raw.withColumn("topic_date", F.to_date("kafka_timestamp"))


def cluster_raw(raw: DataFrame, path: str) -> None:
    """Writes raw rows as a table partitioned by topic date, in few files whose rows are in topic time.

    Rows are dealt by ranges of (time, partition, offset), so a busy day is many tasks' work and each file holds one
    stretch of time, which its row group bounds then show. It also compacts the small files that a stream leaves.
    """
    order = ["kafka_timestamp", "kafka_partition", "kafka_offset"]
    dealt = with_topic_date(raw).repartitionByRange("topic_date", *order)
    dealt.sortWithinPartitions("topic_date", *order).write.partitionBy("topic_date").mode("errorifexists").parquet(path)


def raw_between(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Raw rows with a topic time from ``start`` to before ``end``; only the folders of those days are listed as input."""
    first, last = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    at = F.col("kafka_timestamp")
    return raw.where(F.col("topic_date").between(F.to_date(first), F.to_date(last)) & (at >= first) & (at < last))
