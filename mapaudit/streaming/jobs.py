"""Streaming jobs: files to topic, topic to raw table, continuous audit and counts.

Every job returns the started query. ``trigger=once`` drains what is there and
stops; the default keeps running. Progress lives in the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mapaudit.config import DEFAULT, AuditConfig
from mapaudit.operators.audit import FRAME, fct_map_audit
from mapaudit.operators.skew import keep_rank_one
from mapaudit.operators.staging import flatten_detections, from_typed, stage_detections
from mapaudit.sources.detections import enrich, stream_detections_csv, stream_rows_csv
from mapaudit.sources.messages import from_messages, to_messages, to_raw, with_topic_date


_ASIDE = "_unreadable"
_STATE_KEY = "spark.sql.streaming.stateStore.providerClass"
_STATE_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(writer, once: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if once else writer).start()


def topic_source(spark: SparkSession, options: dict[str, str], fmt: str = "kafka", schema: str | None = None) -> DataFrame:
    """Messages as a stream: a topic, or files of (key, value) rows with ``fmt`` and ``schema``."""
    reader = spark.readStream.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load()


def csv_to_topic(spark: SparkSession, folder: str, layout: list[str], target: dict[str, str], checkpoint: str,
                 fmt: str = "kafka", vehicle_id: str = "vehicle-001", session_id: str | None = None,
                 once: bool = False) -> StreamingQuery:
    """Detection files to messages as they arrive.

    Ids are derived from the rows' places, so a batch that is retried writes the same
    keys and equal rows have different ones. ``target`` are the sink's options (topic and servers, or a path).
    """
    rows = enrich(stream_detections_csv(spark, folder, layout, keep_place=True), vehicle_id, session_id, deterministic_id=True)
    out = to_messages(rows).drop("message")
    writer = out.writeStream.format(fmt).options(**target).option("checkpointLocation", checkpoint).outputMode("append")
    return _start(writer, once)


def csv_rejects(spark: SparkSession, folder: str, layout: list[str], table_path: str, checkpoint: str,
                once: bool = False) -> StreamingQuery:
    """The rows that ``csv_to_topic`` leaves out, with their reason and file, appended to a table. A query of its own with
    its own progress: it parses the files again, so that neither sink waits for the other or writes twice for it."""
    rows = stream_rows_csv(spark, folder, layout).where(F.col("reject_reason").isNotNull())
    writer = rows.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint)
    return _start(writer.outputMode("append"), once)


def batch_to_topic(detections: DataFrame, target: dict[str, str], fmt: str = "kafka") -> None:
    """The whole table to messages in one job."""
    to_messages(detections).drop("message").write.format(fmt).options(**target).mode("append").save()


def topic_to_raw(messages: DataFrame, topic: str, table_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Messages to the raw table, partitioned by topic date. Kafka's own partition, offset and timestamp are kept when
    present. ``cluster_raw`` orders and compacts what has landed."""
    have = set(messages.columns)
    raw = to_raw(
        messages, topic,
        kafka_time=F.col("timestamp") if "timestamp" in have else None,
        partition=F.col("partition") if "partition" in have else None,
        offset=F.col("offset") if "offset" in have else None,
    )
    writer = with_topic_date(raw).writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint)
    return _start(writer.partitionBy("topic_date").outputMode("append"), once)


def _run_id(batch: DataFrame) -> str:
    """Id of the query that a micro-batch belongs to. It lives in the checkpoint, so a restart has it again and a new
    checkpoint has another; folders named by it are never overwritten by another run."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def stream_audit(staged_source: DataFrame, staged_nodes: DataFrame, fact_path: str, checkpoint: str,
                 cfg: AuditConfig = DEFAULT, once: bool = False) -> StreamingQuery:
    """Audits every micro-batch by itself; ``current_facts`` reads the audit of all of them.

    The rank of a frame keeps its least distance, and the least of several parts is the least of their least. So
    a batch stores the winners among its own rows and reads nothing that was stored before: its cost depends on its
    rows alone, however long the stream runs. Facts are written under run and batch, so a retry replaces its own rows
    and a new checkpoint loses none.
    """
    def audit(batch: DataFrame, batch_id: int) -> None:
        facts = fct_map_audit(batch, staged_nodes, cfg)
        facts.write.mode("overwrite").parquet(f"{fact_path}/facts/run={_run_id(batch)}/batch_id={batch_id}")

    writer = staged_source.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint)
    return _start(writer, once)


def current_facts(spark: SparkSession, fact_path: str, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """The facts of ``stream_audit``: of every frame the nearest of its batches' winners, ties included. Where several
    runs have audited a detection, because a new checkpoint read it again, one of them counts."""
    facts = spark.read.parquet(f"{fact_path}/facts")
    runs = facts.select("run").distinct().limit(2).count()  # from folder names
    if runs > 1:
        last = facts.groupBy(F.col("detection_id").alias("_id")).agg(F.max("run").alias("_run"))
        facts = facts.join(last, F.col("detection_id").eqNullSafe(F.col("_id")) & (F.col("run") == F.col("_run")), "left_semi")
    facts = facts.drop("run", "batch_id")
    return keep_rank_one(facts, FRAME, "distance_meters", facts, cfg.hot_rows)


def stage_typed_stream(det: DataFrame) -> DataFrame:
    return stage_detections(from_typed(det))


def stage_raw_stream(raw: DataFrame) -> DataFrame:
    return stage_detections(flatten_detections(raw))


def status_counts(det: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                  once: bool = False) -> StreamingQuery:
    """Running counts by class; state is one row per class. Changed rows go to ``sink``."""
    counts = det.groupBy("class_name").agg(F.count(F.lit(1)).alias("count"))
    writer = counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return _start(writer, once)


def drop_repeats(messages: DataFrame, table_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Stores the first copy of each detection id to arrive, however late it is, and sets unreadable messages aside.

    The ids that were seen are the query's keyed state, on disk beside the checkpoint, so a batch costs what its own
    rows cost. No watermark decides, so no first copy is lost. Rows are written under run and batch: a retry replaces
    its own rows, and a new checkpoint over the same table adds to it. Such a run has no state of the ids before it and
    reads those of the older runs; ids stored there are not stored again. Messages that are not JSON or have no id are
    repeats of nothing: all of them go to a side table (``unreadable``).
    """
    if "value" in messages.columns:
        rows = from_messages(messages.select("value"), keep="value")
    else:
        rows = messages.withColumn("value", F.lit(None).cast("string"))
    no_id = F.col("detection_id").isNull()
    firsts = rows.where(~no_id).withColumn("value", F.lit(None).cast("string")).dropDuplicates(["detection_id"])
    out = firsts.unionByName(rows.where(no_id))
    spark = messages.sparkSession
    older: dict[str, DataFrame | None] = {}

    def insert(batch: DataFrame, batch_id: int) -> None:
        run = _run_id(batch)
        if run not in older:
            older[run] = _stored_ids(batch.sparkSession, table_path, run)
        place = f"run={run}/batch_id={batch_id}"
        batch = batch.persist(StorageLevel.DISK_ONLY)  # two writes, but the state is read and updated once
        try:
            batch.where(F.col("detection_id").isNull()).write.mode("overwrite").parquet(f"{table_path}/{_ASIDE}/{place}")
            fresh = batch.where(F.col("detection_id").isNotNull()).drop("value")
            if older[run] is not None:
                fresh = fresh.join(older[run], "detection_id", "left_anti")
            fresh.write.mode("overwrite").parquet(f"{table_path}/{place}")
        finally:
            batch.unpersist()

    before = spark.conf.get(_STATE_KEY)
    spark.conf.set(_STATE_KEY, _STATE_ON_DISK)
    try:
        return _start(out.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint), once)
    finally:
        spark.conf.set(_STATE_KEY, before)


def _stored_ids(spark: SparkSession, table_path: str, run: str) -> DataFrame | None:
    """Ids that runs other than ``run`` have stored; None if there is no such run."""
    try:
        stored = spark.read.option("basePath", table_path).parquet(f"{table_path}/run=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    stored = stored.where(F.col("run") != run)
    return stored.select("detection_id") if stored.select("run").limit(1).count() else None


def unreadable(spark: SparkSession, table_path: str) -> DataFrame:
    """``value`` and the columns that could be read of the messages that ``drop_repeats`` set aside."""
    return spark.read.parquet(f"{table_path}/{_ASIDE}").drop("run", "batch_id")
