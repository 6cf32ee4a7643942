"""Messages sent through a client of the user's, with an answer for each message."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Takes (key, value) messages and gives for each None, or the reason why it was not accepted.
Send = Callable[[list[tuple[str, str]]], list[str | None]]
ANSWERS = "key string, value string, acked boolean, attempts int, reason string"


def deliver(messages: DataFrame, open_client: Callable[[], Send], path: str, attempts: int = 3, pause_seconds: float = 0.1) -> DataFrame:
    """Sends every (key, value) message from the tasks and stores one answer for each at ``path``, which is returned.

    A task opens one client. What it refuses is sent again up to ``attempts`` times, after pauses that double; a client that
    raises has refused all it was given. Messages that were never accepted keep their value: they are the dead letters. A
    task that is run again sends its messages again, but stores one answer for each.
    """
    def send(batches):
        client = open_client()
        for batch in batches:
            keys, values = (batch.column(c).to_pylist() for c in ("key", "value"))
            reasons, tries, left = [None] * len(keys), [0] * len(keys), list(range(len(keys)))
            for attempt in range(attempts):
                if attempt:
                    time.sleep(pause_seconds * 2 ** (attempt - 1))
                try:
                    answers = client([(keys[i], values[i]) for i in left])
                except Exception as error:  # the client's own failure is an answer too
                    answers = [f"{type(error).__name__}: {error}"] * len(left)
                for i, answer in zip(left, answers, strict=True):
                    reasons[i], tries[i] = answer, attempt + 1
                left = [i for i in left if reasons[i] is not None]
                if not left:
                    break
            acked = [r is None for r in reasons]
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.string()), pa.array([None if a else v for a, v in zip(acked, values)], pa.string()),
                pa.array(acked, pa.bool_()), pa.array(tries, pa.int32()), pa.array(reasons, pa.string()),
            ], ["key", "value", "acked", "attempts", "reason"])

    spark = messages.sparkSession
    text = messages.select(F.col("key").cast("string"), F.col("value").cast("string"))
    text.mapInArrow(send, ANSWERS).write.mode("overwrite").parquet(path)
    return spark.read.schema(ANSWERS).parquet(path)


def stream_delivery(messages: DataFrame, open_client: Callable[[], Send], folder: str, checkpoint: str, attempts: int = 3,
                    once: bool = False) -> StreamingQuery:
    """``deliver`` for each micro-batch. Answers lie under the query's id and the batch, so a batch that is retried
    replaces its own answers and a new checkpoint overwrites none."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        deliver(batch, open_client, f"{folder}/run={run}/batch_id={batch_id}", attempts)

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stored_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The answers of all runs and batches below a stream's folder."""
    return spark.read.schema(ANSWERS).option("basePath", folder).parquet(f"{folder}/run=*/batch_id=*").select("key", "value", "acked", "attempts", "reason")


def delivery_counts(answers: DataFrame) -> DataFrame:
    """``sent, acked, failed, retried, success_rate_pct`` in one row; the rate is null when nothing was sent."""
    n = F.count(F.lit(1))
    acked = F.count(F.when(F.col("acked"), 1))
    return answers.agg(
        n.alias("sent"), acked.alias("acked"), (n - acked).alias("failed"), F.count(F.when(F.col("attempts") > 1, 1)).alias("retried"),
        F.round(F.when(n > 0, 100.0 * acked / n), 6).alias("success_rate_pct"))
