"""Number columns that travel through a shuffle as blocks.

Rows of few 64-bit numbers would carry as many bytes of row format again, and hashes do not compress. A block is one
row for up to ``BLOCK_ROWS`` of them: each column as the differences of neighbours, their bytes by significance, so that
what a sorted or slowly changing column does not use is runs of zeros. Blocks are dealt by part; a task reads the
parts it was dealt one after another, so it holds one part, a fixed share of all rows, at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapaudit.llm.text import U64

BLOCK_ROWS = 1 << 12
#: Parts for every shuffle partition.
PARTS_PER_TASK = 2
SCHEMA = "part int, kind int, block binary"


def part_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions")) * PARTS_PER_TASK


def _encode(x: np.ndarray) -> bytes:
    step = np.diff(x.view(np.int64), prepend=np.int64(0))
    step = (step << 1) ^ (step >> 63)  # small steps down are small numbers too
    return step.view(np.uint8).reshape(-1, 8).T.tobytes()


def _decode(raw: np.ndarray) -> np.ndarray:
    step = np.ascontiguousarray(raw.reshape(8, -1).T).view(U64).ravel()
    step = (step >> U64(1)) ^ (U64(0) - (step & U64(1)))
    return np.cumsum(step, dtype=U64)


def write(part: np.ndarray, kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Blocks of rows that are in order of ``part``; columns are 64-bit numbers."""
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    parts, blocks = [], []
    for a, b in zip(edge.tolist(), np.append(edge[1:], len(part)).tolist()):
        for k in range(a, b, BLOCK_ROWS):
            parts.append(int(part[a]))
            blocks.append(b"".join(_encode(c[k : min(b, k + BLOCK_ROWS)]) for c in columns))
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([kind] * len(parts), pa.int32()), pa.array(blocks, pa.binary())], ["part", "kind", "block"])


def deal(rows: DataFrame) -> DataFrame:
    """Blocks by part, the parts of a task in order."""
    tasks = part_count(rows.sparkSession) // PARTS_PER_TASK
    return rows.repartitionById(tasks, (F.col("part") % tasks).cast("int")).sortWithinPartitions("part", "kind")


def read(batches: Iterator[pa.RecordBatch], width: dict[int, int], compact=None, limit: int = 1 << 21):
    """(kind, columns) of every part and kind. ``width`` has the number of columns of each kind. Where more than ``limit``
    rows come together, ``compact`` may make them fewer."""
    now, columns, rows = None, [], 0

    def joined():
        return [np.concatenate(c) for c in zip(*columns)]

    for batch in batches:
        data = batch.column("block")
        for i, (part, kind) in enumerate(zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist())):
            if (part, kind) != now:
                if columns:
                    yield now[1], joined()
                now, columns, rows = (part, kind), [], 0
            raw = np.frombuffer(data[i].as_buffer(), np.uint8).reshape(width[kind], -1)
            columns.append([_decode(c) for c in raw])
            rows += len(columns[-1][0])
            if compact and rows > limit:
                columns = [compact(joined())]
                rows = len(columns[0][0])
                limit = max(limit, 2 * rows)
    if columns:
        yield now[1], joined()
