"""Statistics over detections, in cases that the derived tables do not hold."""

from mapaudit.operators import stats


def test_every_class_is_counted_over_time(spark):
    rows = [(float(i), c) for i, c in enumerate(["stop sign", "bench", "bench", "traffic light", None, "stop sign", "bench", "dog"])]
    det = spark.createDataFrame(rows, "timestamp_sec double, class_name string")
    long = {(r.time_bin, r.class_name): r["count"] for r in stats.class_counts_over_time(det, 2).collect()}
    assert long == {(1, "stop sign"): 1, (1, "bench"): 2, (1, "traffic light"): 1, (2, "stop sign"): 1, (2, "bench"): 1, (2, "dog"): 1}
    wide = {r.time_bin: (r["stop sign"], r["traffic light"]) for r in stats.detections_over_time(det, 2).collect()}
    assert wide == {1: (1, 1), 2: (1, 0)}
    assert stats.class_counts_over_time(det.limit(0)).count() == 0
