"""The distributed sign walk against the sequential rule."""

import random

import pytest

from mapaudit.operators.signs import unique_signs


def sequential(rows):
    done, signs = set(), []
    rows = sorted(rows, key=lambda r: (r[2], r[5]))
    for i, r in enumerate(rows):
        if i in done:
            continue
        signs.append(r[5])
        done |= {j for j, o in enumerate(rows) if o[:2] == r[:2] and abs(o[2] - r[2]) < 100
                 and abs(o[3] - r[3]) < 200 and abs(o[4] - r[4]) < 100}
    return sorted(signs)


def sample(n, seed, frames):
    rng = random.Random(seed)
    return [(f"v{rng.randrange(2)}", rng.choice(["stop sign", "traffic light"]), rng.randrange(0, frames, 10),
             float(rng.randrange(0, 2560, 80)), float(rng.randrange(0, 1400, 50)), f"d{i:05d}") for i in range(n)]


SCHEMA = "video_name string, class_name string, frame_number int, u double, v double, detection_id string"


@pytest.mark.parametrize("frames,island_rows", [(40000, 200_000), (1500, 200_000), (9000, 10)])
def test_equals_sequential(spark, frames, island_rows):
    rows = sample(900, frames, frames)
    rows += [(*r[:5], r[5] + "-copy") for r in rows[:50]]
    got = unique_signs(spark.createDataFrame(rows, SCHEMA), island_rows=island_rows).collect()
    assert sorted(r.detection_id for r in got) == sequential(rows)


def test_unknown_class_stands_alone(spark):
    rows = [("v", None, 1, 1.0, 1.0, "a"), ("v", None, 1, 1.0, 1.0, "b"), ("v", "stop sign", 1, 1.0, 1.0, "c"), ("v", "stop sign", 2, 1.0, 1.0, "d")]
    assert sorted(r.detection_id for r in unique_signs(spark.createDataFrame(rows, SCHEMA)).collect()) == ["a", "b", "c"]


def test_empty(spark):
    assert unique_signs(spark.createDataFrame([], SCHEMA)).count() == 0
