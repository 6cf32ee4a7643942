"""Whole text columns as flat byte arrays, and 64-bit hashes of their words, for use inside tasks.

A batch of texts is one numpy byte array with offsets, so a step costs one pass over bytes rather than
a Python call per row or word. ``chunks`` bounds what such a pass holds: rows are taken until their
bytes reach the limit, and a longer text makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

CHUNK_BYTES = 1 << 19
#: Rows that Spark hands to Python at once; texts are long, so fewer than its default of 10,000.
BATCH_ROWS = 2000
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of later jobs of this session, unless they are set lower."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and its n + 1 offsets. Null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES):
    """Slices of the batches, each with its bytes and offsets, of at most ``limit`` bytes or one row."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over the whole word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes (or of 64-bit values): differences of one running polynomial sum."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def runs(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of one kind (0: between stretches) inside each text."""
    if not len(kinds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.empty(len(kinds) + 1, bool)
    fresh[0] = fresh[-1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=fresh[1:-1])
    fresh[offsets] = True
    edges = np.flatnonzero(fresh)
    real = kinds[edges[:-1]] != 0
    return edges[:-1][real], edges[1:][real]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the words ``[^\\x20\\x09-\\x0D]+``."""
    starts, ends = runs((~SPACE[data]).view(np.uint8), offsets)
    return starts, ends, rows_of(offsets, starts)


def rows_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, at, "right") - 1


def row_edges(rows: np.ndarray, n: int) -> np.ndarray:
    """n + 1 bounds of each row's stretch in a sorted row column."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle of ``width`` lower-cased words; a shorter text is one shingle."""
    data = LOWER[data]
    starts, ends, row = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    factor = mix(np.arange(1, width + 1, dtype=U64)) | U64(1)
    full = max(0, len(hashes) - width + 1)
    whole = np.flatnonzero(row[:full] == row[width - 1 :]) if full else np.zeros(0, np.int64)
    grams = np.zeros(len(whole), U64)
    for k in range(width):
        grams += hashes[whole + k] * factor[k]
    edges = row_edges(row, len(offsets) - 1)
    count = np.diff(edges)
    short = np.flatnonzero((count > 0) & (count < width))
    brief = np.zeros(len(short), U64)
    for k in range(width - 1):
        there = count[short] > k
        brief[there] += hashes[edges[short[there]] + k] * factor[k]
    brief += count[short].astype(U64)
    return mix(np.concatenate([grams, brief])), np.concatenate([row[whole], short])


def code_points(data: np.ndarray) -> np.ndarray:
    """Running number of code points before each byte, with one more entry for the end."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
