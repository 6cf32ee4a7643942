"""Files opened one by one, so that a broken one is reported and costs nothing but itself."""

from __future__ import annotations

import csv

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files up to this length are opened whole by one task. Tasks get files up to spark.sql.files.maxPartitionBytes together.
WHOLE_BYTES = 32 << 20
_ROWS_A_BATCH = 10_000
_CODECS = {"gz": "gzip", "bz2": "bz2", "zst": "zstd"}


def _files(spark: SparkSession, paths, glob: str, skip_unreadable: bool) -> DataFrame:
    skip = str(skip_unreadable).lower()
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("ignoreCorruptFiles", skip).option("ignoreMissingFiles", skip).load(paths))


def list_files(spark: SparkSession, paths, glob: str = "*", largest: int | None = None) -> DataFrame:
    """(source_file, length) of every file that is not empty; none is opened. Spark's readers pass over files of no bytes."""
    files = _files(spark, paths, glob, False)
    if largest is not None:
        files = files.where(F.col("length") <= largest)
    return files.select(F.col("_metadata.file_path").alias("source_file"), "length")


def open_files(spark: SparkSession, paths, glob: str = "*", largest: int = WHOLE_BYTES, skip_unreadable: bool = False) -> DataFrame:
    """(source_file, content), a row for each file up to ``largest`` bytes. One that can't be opened fails the
    job, or with ``skip_unreadable`` has no row (``failed_files`` finds it by that)."""
    files = _files(spark, paths, glob, skip_unreadable).where(F.col("length") <= largest)
    return files.select(F.col("_metadata.file_path").alias("source_file"), "content")


def failed_files(listed: DataFrame, status: DataFrame) -> DataFrame:
    """(source_file, reason) of the listed files that have no row in ``status`` or one with a ``failure``.

    ``status`` has one row for each file that was opened: no file's contents are in this join."""
    seen = status.select("source_file", "failure", F.lit(True).alias("_opened"))
    reason = F.when(F.col("_opened").isNull(), "could not be opened").otherwise(F.col("failure"))
    return (listed.select("source_file").join(seen, "source_file", "left").select("source_file", reason.alias("reason"))
            .where(F.col("reason").isNotNull()))


def csv_status(opened: DataFrame, names: list[str], errors: str = "replace") -> DataFrame:
    """(source_file, failure) of all opened CSV files: each is read whole as by ``read_csv_files``, its rows stay in the task."""
    schema = T.StructType([T.StructField("source_file", T.StringType()), T.StructField("failure", T.StringType())])

    def run(batches):
        for batch in batches:
            failures = []
            for file, content in zip(batch.column(0), batch.column(1)):
                try:
                    csv_columns(file.as_py(), content.as_py(), names, errors)
                    failures.append(None)
                except Exception as error:  # whatever is wrong with one file is that file's failure
                    failures.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(failures, pa.string())], schema.names)

    return opened.mapInArrow(run, schema)


def _fields(line: str) -> list[str]:
    return next(csv.reader([line]))


def _text(source_file: str, content: bytes, errors: str) -> str:
    codec = _CODECS.get(source_file.rsplit(".", 1)[-1])
    if codec:
        content = pa.CompressedInputStream(pa.BufferReader(content), codec).read()
    return content.decode("utf-8-sig", errors).replace("\r\n", "\n").replace("\r", "\n")


def csv_columns(source_file: str, content: bytes, names: list[str], errors: str = "replace"):
    """(header, columns): the columns ``names`` of a CSV text as string arrays, null where the header lacks them, and
    ``line``, the whole line where its number of fields is not the header's. Lines without a character are left out,
    a record ends with its line. Raises ValueError if there is no header."""
    lines = pc.list_flatten(pc.split_pattern(pa.array([_text(source_file, content, errors)], pa.large_string()), "\n")).cast(pa.string())
    lines = lines.filter(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(lines)), 0))
    if not len(lines):
        raise ValueError("no header")
    header = [c.strip().strip('"') for c in lines[0].as_py().split(",")]
    lines = lines.slice(1)
    parts, width = pc.split_pattern(lines, ","), len(header)
    quoted = pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)
    whole = (pc.list_value_length(parts).to_numpy(zero_copy_only=False) == width) & ~quoted
    flat = pc.list_flatten(parts.filter(pa.array(whole)))
    # lines with quotes or with another number of fields, one by one
    other = np.flatnonzero(~whole)
    read = [_fields(line) if q else line.split(",") for line, q in zip(lines.take(pa.array(other)).to_pylist(), quoted[other])]
    broken = np.zeros(len(lines), bool)
    broken[other] = [len(r) != width for r in read]
    place = np.empty(len(lines), np.int64)
    place[whole], place[other] = np.arange(whole.sum()), whole.sum() + np.arange(len(other))
    columns = {}
    for name in names:
        if name not in header:
            columns[name] = pa.nulls(len(lines), pa.string())
            continue
        i = header.index(name)
        values = flat.take(pa.array(np.arange(i, len(flat), width)))
        rest = pa.array([r[i] if i < len(r) else None for r in read], pa.string())
        columns[name] = pa.concat_arrays([values, rest]).take(pa.array(place)) if len(other) else values
    columns["line"] = lines.take(pa.array(np.arange(len(lines)), mask=~broken))
    return header, columns


def read_csv_files(opened: DataFrame, names: list[str], flags: dict[str, str], errors: str = "replace") -> DataFrame:
    """Rows of all opened CSV files, each with its own header, in one pass: the columns ``names`` as text, ``line``,
    a boolean column for each of ``flags`` (column: the header name that it reports), ``source_file`` and
    ``line_in_block``, the row's number in its file. In front of its rows each file has one with ``is_status``,
    whose ``failure`` is null if the file could be read."""
    text = [*names, "line"]
    schema = T.StructType(
        [T.StructField("source_file", T.StringType()), T.StructField("is_status", T.BooleanType()), T.StructField("failure", T.StringType())]
        + [T.StructField(c, T.StringType()) for c in text] + [T.StructField(c, T.BooleanType()) for c in flags]
        + [T.StructField("line_in_block", T.LongType())])

    def rows_of(file: str, content: bytes) -> dict:
        failure = None
        try:
            header, columns = csv_columns(file, content, names, errors)
        except Exception as error:  # whatever is wrong with one file is that file's failure
            failure, header = f"{type(error).__name__}: {error}", []
            columns = {c: pa.nulls(0, pa.string()) for c in text}
        n = len(columns["line"])
        first = np.arange(n + 1) == 0
        none = pa.nulls(1, pa.string())
        return ([pa.array([file] * (n + 1), pa.string()), pa.array(first), pa.concat_arrays([pa.array([failure], pa.string()), pa.nulls(n, pa.string())])]
                + [pa.concat_arrays([none, columns[c]]) for c in text]
                + [pa.array(np.full(n + 1, name in header)) for name in flags.values()] + [pa.array(np.arange(-1, n), pa.int64())])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                held.append(pa.RecordBatch.from_arrays(rows_of(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), schema.names))
                count += held[-1].num_rows
                if count >= _ROWS_A_BATCH:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches(_ROWS_A_BATCH)
                    held, count = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(_ROWS_A_BATCH)

    return opened.mapInArrow(run, schema)
