"""Streaming jobs on file sources, drained once."""

import json

from pyspark.sql import functions as F

from mapaudit import inputs
from mapaudit.operators.audit import fct_map_audit
from mapaudit.operators.staging import from_typed, stage_detections, stage_nodes
from mapaudit.sources import detections as d
from mapaudit.sources import messages
from mapaudit.streaming import delivery, jobs, metrics

LAYOUT = ["frame_number", "timestamp_sec", "u", "v", "confidence", "class_name"]
LINE = "{},2.5,17.28,63.06,0.52,stop sign\n"


def _topic(spark, path):
    return spark.read.schema("key string, value string").json(path)


def test_csv_to_topic_goes_on_where_it_stopped(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    counter = metrics.StreamCounter()
    spark.streams.addListener(counter)
    for name, frames in (("a.csv", (1, 2)), ("b.csv", (3, "x"))):
        (tmp_path / "in" / name).write_text(",".join(LAYOUT) + "\n" + "".join(LINE.format(f) for f in frames))
        query = jobs.csv_to_topic(spark, src, LAYOUT, {"path": out}, cp, fmt="json", once=True)
        query.awaitTermination()
    sent = messages.from_messages(_topic(spark, out)).collect()
    assert sorted(r.frame_number for r in sent) == [1, 2, 3] and len({r.detection_id for r in sent}) == 3
    run = counter.metrics(query)
    spark.streams.removeListener(counter)
    assert (run.sent, run.acked, run.rejected, run.failed) == (1, 1, 1, 0) and run.success_rate_pct == 100.0


def test_metrics_count_rejected_rows_and_never_divide_by_zero(spark, tmp_path):
    det = inputs.as_message_columns(inputs.detections(spark, "/root/testdata/sf0.001"))
    rows = det.withColumn("reject_reason", F.when(F.col("frame_number") == 0, "bad"))
    run = metrics.send_batch(rows, {"path": str(tmp_path / "t")}, fmt="json")
    assert (run.sent, run.rejected, run.failed) == (998, 2, 0) and run.acked == _topic(spark, str(tmp_path / "t")).count()
    empty = metrics.RunMetrics(0, 0, 0, 0.0)
    assert empty.success_rate_pct is None and empty.throughput is None and empty.pending == 0


def test_stream_audit_equals_batch(spark, sf, tmp_path):
    det, osm = inputs.detections(spark, sf), stage_nodes(inputs.osm_nodes(spark, sf))
    det.repartition("video_name").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(det.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.stream_audit(jobs.stage_typed_stream(stream), osm, str(tmp_path / "fct"), str(tmp_path / "cp"), once=True).awaitTermination()
    want = fct_map_audit(stage_detections(from_typed(det)), osm)
    key = ["detection_id", "nearest_osm_node_id", "audit_status"]
    got = jobs.current_facts(spark, str(tmp_path / "fct")).select(*key)
    assert got.count() == want.count() and got.exceptAll(want.select(*key)).isEmpty()


def test_raw_keeps_topic_position(spark, tmp_path):
    rows = [(b"k1", b'{"detection_id":"k1"}', 3, 17), (b"k2", b"broken", 0, 5)]
    df = spark.createDataFrame(rows, "key binary, value binary, partition int, offset long").withColumn(
        "timestamp", F.expr("timestamp'2026-01-18 19:15:12'"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.topic_to_raw(stream, "detections", str(tmp_path / "raw"), str(tmp_path / "cp"), once=True).awaitTermination()
    raw = {int(r.kafka_offset): r for r in spark.read.parquet(str(tmp_path / "raw")).collect()}
    assert raw[17].kafka_partition == 3 and raw[5].record_content is None and raw[17].kafka_timestamp.year == 2026


def test_time_window_reads_its_days_only(spark, tmp_path):
    """Landing and clustered table are partitioned by topic date; files of the latter are in topic time."""
    df = spark.range(4000).select(
        F.col("id").cast("string").alias("key"), F.lit('{"detection_id":"k"}').alias("value"), F.col("id").alias("offset"),
        F.when(F.col("id") != 7, F.expr("timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, (id * 7919) % 4000 * 200)")).alias("timestamp"))
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    jobs.topic_to_raw(stream, "detections", str(tmp_path / "raw"), str(tmp_path / "cp"), once=True).awaitTermination()
    landed = spark.read.parquet(str(tmp_path / "raw"))
    messages.cluster_raw(landed.drop("topic_date"), str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    assert landed.count() == table.count() == 4000
    for raw in (landed, table):
        rows = messages.raw_between(raw, "2026-01-03 12:00:00", "2026-01-04 12:00:00")
        got = sorted(int(r.kafka_offset) for r in rows.select("kafka_offset").collect())
        assert got == sorted(i for i in range(4000) if i != 7 and 216_000 <= i * 7919 % 4000 * 200 < 302_400)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(topic_date" in plan
    days = {f.split("topic_date=")[1].split("/")[0] for f in table.where("topic_date = '2026-01-03'").inputFiles()}
    assert "2026-01-03" in days and table.where("topic_date is null").count() == 1
    spans = table.groupBy(F.input_file_name(), "topic_date").agg(F.min("kafka_timestamp").alias("a"), F.max("kafka_timestamp").alias("b")).where("a is not null").collect()
    spans = sorted((r.a, r.b) for r in spans)
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_late_first_copies_are_kept(spark, tmp_path):
    """Five batches, one hours late, with repeats within and across batches."""
    (tmp_path / "in").mkdir()
    times = ["12:00", "12:10", "12:20", "09:00", "12:30"]
    schema = "detection_id string, ingested_at timestamp"
    for i, t in enumerate(times):
        ids = [f"d{i}", f"d{i}", f"e{i}", "d0"]
        (tmp_path / "in" / f"{i}.json").write_text("".join(f'{{"detection_id":"{x}","ingested_at":"2026-01-18 {t}:00"}}\n' for x in ids))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        jobs.drop_repeats(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = sorted(r.detection_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted([f"d{i}" for i in range(5)] + [f"e{i}" for i in range(5)])


def _drain(spark, tmp_path, checkpoint, lines):
    k = len(list((tmp_path / "in").glob("*.json")))
    (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"key": "k", "value": v}) + "\n" for v in lines))
    stream = spark.readStream.schema("key string, value string").json(str(tmp_path / "in"))
    jobs.drop_repeats(stream, str(tmp_path / "out"), str(tmp_path / checkpoint), once=True).awaitTermination()


def test_a_new_checkpoint_adds_to_the_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ids = lambda *names: [json.dumps({"detection_id": x}) for x in names]
    _drain(spark, tmp_path, "cp", ids("a", "b", "a"))
    _drain(spark, tmp_path, "cp", ids("b", "c", "d"))
    _drain(spark, tmp_path, "cp2", ids("e", "a"))  # reads all three files again
    _drain(spark, tmp_path, "cp2", ids("f", "e"))
    _drain(spark, tmp_path, "cp", ids("g"))  # the first run goes on beside the other's rows
    stored = sorted(r.detection_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert stored == ["a", "b", "c", "d", "e", "f", "g"]


def test_unreadable_messages_are_all_set_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    bad = ["{broken", "{broken", "", "{}", '{"frame_number":3}', "[]"]
    _drain(spark, tmp_path, "cp", [*bad, '{"detection_id":"a"}', '{"detection_id":"a"}'])
    aside = jobs.unreadable(spark, str(tmp_path / "out"))
    assert sorted(r.value for r in aside.collect()) == sorted(bad)
    assert [r.detection_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]


def test_audit_batches_read_no_history_and_survive_a_new_checkpoint(spark, tmp_path):
    """A frame in many batches; every file of facts is written once and none is read by a later batch."""
    sf = "/root/testdata/sf0.001"
    det, osm = inputs.detections(spark, sf).where("event_id < 120"), stage_nodes(inputs.osm_nodes(spark, sf))
    rows = det.withColumn("frame_number", (F.col("event_id") % 7).cast("int")).withColumn("video_name", F.lit("v"))
    rows.repartition(12, "event_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    want = fct_map_audit(stage_detections(from_typed(rows)), osm)
    key = ["detection_id", "nearest_osm_node_id", "audit_status"]
    for checkpoint in ("cp", "cp", "cp2"):
        jobs.stream_audit(jobs.stage_typed_stream(stream), osm, str(tmp_path / "fct"), str(tmp_path / checkpoint), once=True).awaitTermination()
        got = jobs.current_facts(spark, str(tmp_path / "fct")).select(*key)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(*key).collect()), key=str)


def test_equal_rows_of_a_file_are_two_messages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.csv", "b.csv"):
        (tmp_path / "in" / name).write_text(",".join(LAYOUT) + "\n" + LINE.format(1) + LINE.format("x") + LINE.format(1) + LINE.format(2))
    out = []
    for k in range(2):  # two runs write the same keys
        jobs.csv_to_topic(spark, str(tmp_path / "in"), LAYOUT, {"path": str(tmp_path / f"out{k}")}, str(tmp_path / f"cp{k}"), fmt="json", once=True).awaitTermination()
        out.append(sorted(r.key for r in _topic(spark, str(tmp_path / f"out{k}")).collect()))
    assert out[0] == out[1] and len(set(out[0])) == 6
    read = lambda s: d.enrich(d.read_detections_csv(spark, str(tmp_path / "in"), keep_place=True)[0], session_id=s, deterministic_id=True)
    one, two = ({r.detection_id for r in read(s).collect()} for s in ("s1", "s2"))
    assert len(one) == len(two) == 6 and not one & two
    table = d.read_detections_csv(spark, str(tmp_path / "in"))[0]
    ids = [sorted(r.detection_id for r in d.enrich(table.repartition(n), deterministic_id=True).collect()) for n in (1, 3)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 6


def test_delivery_counts_what_the_client_answers(spark, tmp_path):
    """Refused, late and raised answers, null values and no messages at all."""
    def client():
        calls = []

        def send(messages):
            calls.append(len(messages))
            if any(v == "boom" for _, v in messages):
                raise ValueError("down")
            return ["no" if v == "bad" else "busy" if v == "late" and len(calls) == 1 else None for _, v in messages]

        return send

    def run(values):
        rows = spark.createDataFrame(list(enumerate(values)), "key long, value string").coalesce(1)
        return delivery.deliver(rows, client, str(tmp_path / f"a{len(values)}"), attempts=3, pause_seconds=0.0)

    answers = {r.key: r for r in run(["ok", "bad", "late", None]).collect()}
    assert [(answers[k].acked, answers[k].attempts, answers[k].reason) for k in "0123"] == [
        (True, 1, None), (False, 3, "no"), (True, 2, None), (True, 1, None)]
    assert answers["1"].value == "bad" and answers["0"].value is None
    lost = run(["ok", "boom"]).collect()
    assert [(r.acked, r.value, r.reason) for r in lost] == [(False, "ok", "ValueError: down"), (False, "boom", "ValueError: down")]
    assert tuple(delivery.delivery_counts(run([])).first()) == (0, 0, 0, 0, None)


def test_a_batch_is_worked_out_once(spark, tmp_path):
    """Both tables of ``drop_repeats`` are written from one pass through the keyed state."""
    from mapaudit.streaming.jobs import drop_repeats

    rows = [("k", f'{{"detection_id":"d{i % 40}","frame_number":{i}}}') for i in range(60)] + [("k", "{broken")] * 5
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.json(f"{tmp_path}/topic")
    read = spark.sparkContext.accumulator(0)

    def seen(value):
        read.add(1)
        return value

    source = spark.readStream.schema("key string, value string").json(f"{tmp_path}/topic").withColumn("value", F.udf(seen)("value"))
    drop_repeats(source, f"{tmp_path}/table", f"{tmp_path}/cp", once=True).awaitTermination()
    assert spark.read.option("basePath", f"{tmp_path}/table").parquet(f"{tmp_path}/table/run=*").count() == 40
    assert read.value <= 3 * len(rows)  # a plan reads a message in more than one branch, but is run once
