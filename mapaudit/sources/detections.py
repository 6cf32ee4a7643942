"""Detection CSV files in and out."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapaudit.sources.files import WHOLE_BYTES, csv_status, failed_files, list_files, open_files, read_csv_files

_BROKEN = "_broken_line"
_INTEGER = r"^[+-]?[0-9]+$"
_FLOAT = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"
BBOX = ("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")
OUTPUT = ["video_name", "frame_number", "timestamp_sec", "u", "v", "confidence", "class_name",
          "vehicle_lat", "vehicle_lon", "recording_timestamp"]
#: Every column that a detection file may have.
COLUMNS = ["video_name", "frame_number", "timestamp_sec", "u", "v", *BBOX, "confidence", "class_name",
           "vehicle_lat", "vehicle_lon", "recording_timestamp"]
#: What a header decides, where files with different ones are read together: column of flags -> header name.
HEADS = {"_has_pixel": "u", "_has_box": "bbox_x1", "_has_class": "class_name"}

#: Where a row stands: its file, the first byte of the block that a task reads, and its number in that block.
PLACE = ["source_file", "block_start", "line_in_block"]


def _integer(c: Column) -> Column:
    return F.when(c.rlike(_INTEGER), c.try_cast("int"))


def _float(c: Column) -> Column:
    return F.when(c.rlike(_FLOAT), c.try_cast("double"))


def text_schema(layout: list[str]) -> T.StructType:
    """All-text schema of one header layout plus the column for broken lines."""
    return T.StructType([T.StructField(c, T.StringType()) for c in [*layout, _BROKEN]])


def parse_rows(text: DataFrame, layout: list[str] | None) -> DataFrame:
    """Typed columns and ``reject_reason`` (null = good) for text rows of one layout, or, with layout None, for rows
    that have all COLUMNS and say by the flags HEADS what their file's header has.

    Works on batch and streaming input alike: plain column expressions.
    """
    have = set(COLUMNS if layout is None else layout)

    def raw(name: str) -> Column:
        return F.col(f"`{name}`") if name in have else F.lit(None).cast("string")

    pixel, box, named = (F.col(flag) if layout is None else F.lit(name in have) for flag, name in HEADS.items())
    frame, seconds, conf = _integer(raw("frame_number")), _float(raw("timestamp_sec")), _float(raw("confidence"))
    u, v = _float(raw("u")), _float(raw("v"))
    corners = [_float(raw(c)) for c in BBOX]
    checks: list[tuple[Column, str]] = [
        (F.col(_BROKEN).isNotNull(), "wrong number of fields"),
        (frame.isNull(), "invalid frame_number"), (seconds.isNull(), "invalid timestamp_sec"),
        (pixel & u.isNull(), "invalid u"), (pixel & v.isNull(), "invalid v"),
        *((~pixel & box & value.isNull(), f"invalid {c}") for value, c in zip(corners, BBOX)),
        (~pixel & ~box, "missing pixel coordinates"), (conf.isNull(), "invalid confidence"), (~named, "missing class_name")]
    reason = reduce(lambda acc, c: acc.when(c[0], c[1]), checks[1:], F.when(*checks[0]))
    x1, y1, x2, y2 = corners
    stamp = F.nullif(raw("recording_timestamp"), F.lit(""))
    if layout is None:
        place = [F.col("source_file"), F.lit(0).cast("long").alias("block_start"), F.col("line_in_block")]
    else:
        place = [F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block_start")]
    return text.select(
        F.coalesce(raw("video_name"), F.lit("")).alias("video_name"), frame.alias("frame_number"), seconds.alias("timestamp_sec"),
        F.when(pixel, u).when(box, (x1 + x2) / 2.0).alias("u"), F.when(pixel, v).when(box, (y1 + y2) / 2.0).alias("v"),
        conf.alias("confidence"), F.coalesce(raw("class_name"), F.lit("")).alias("class_name"),
        _float(raw("vehicle_lat")).alias("vehicle_lat"), _float(raw("vehicle_lon")).alias("vehicle_lon"),
        stamp.alias("recording_timestamp"), reason.alias("reject_reason"), F.col(_BROKEN).alias("line"), *place)


def with_place(rows: DataFrame) -> DataFrame:
    """Adds ``line_in_block`` to rows as they are read, batch or stream, before any of them is dropped. A task reads a block
    from its first row to its last, so the number is the same whenever the block is read again."""
    def number(batches):
        last, count = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            files, blocks = (batch.column(c).to_numpy(zero_copy_only=False) for c in PLACE[:2])
            fresh = np.ones(n, bool)
            fresh[1:] = (files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])
            fresh[0] = (files[0], blocks[0]) != last
            at = np.arange(n)
            first = np.maximum.accumulate(np.where(fresh, at, -1))
            line = np.where(first < 0, count + at, at - first)
            last, count = (files[-1], blocks[-1]), int(line[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(line)], [*batch.schema.names, PLACE[2]])

    schema = T.StructType([*rows.schema.fields, T.StructField(PLACE[2], T.LongType())])
    return rows.mapInArrow(number, schema)


def find_layouts(spark: SparkSession, paths, longer_than: int = -1, glob: str = "*") -> dict[tuple[str, ...], list[str]]:
    """Header layout -> files, of the files longer than so many bytes. One pass over these that keeps a single line per file."""
    lines = (
        spark.read.option("pathGlobFilter", glob).text(paths).where(F.col("_metadata.file_size") > longer_than).select(
            F.col("_metadata.file_path").alias("file"),
            F.struct(F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("id"), F.col("value")).alias("line")))
    heads = lines.groupBy("file").agg(F.min("line").alias("line")).select("file", "line.value")
    layouts: dict[tuple[str, ...], list[str]] = {}
    for row in heads.orderBy("file").toLocalIterator():
        names = tuple(c.strip().strip('"') for c in row["value"].lstrip("\ufeff").split(","))
        layouts.setdefault(names, []).append(unquote(row["file"]))
    return layouts


def _csv(reader, layout: list[str]):
    return (
        reader.schema(text_schema(layout)).option("header", True).option("enforceSchema", True)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN).option("escape", '"')
    )


def _whole_files(spark: SparkSession, paths, glob: str, whole_bytes: int, skip_unreadable: bool) -> DataFrame:
    """Text rows and status rows of the files up to ``whole_bytes``."""
    opened = open_files(spark, paths, glob, whole_bytes, skip_unreadable)
    # where a broken file counts, text that is no UTF-8 is one
    errors = "strict" if skip_unreadable else "replace"
    return read_csv_files(opened, COLUMNS, HEADS, errors).withColumnRenamed("line", _BROKEN)


def _any_layout(spark: SparkSession, paths, glob: str, whole_bytes: int, keep_place: bool, skip_unreadable: bool) -> DataFrame:
    """Parsed rows of files with any headers: in one pass up to ``whole_bytes`` a file, by a scan for each header beyond."""
    text = _whole_files(spark, paths, glob, whole_bytes, skip_unreadable)
    if not skip_unreadable:
        # a file of no line has no rows and is no failure here
        broken = F.col("failure").isNotNull() & (F.col("failure") != "ValueError: no header")
        fail = F.raise_error(F.concat(F.lit("unreadable "), F.col("source_file"), F.lit(": "), F.col("failure"))).cast("boolean")
        text = text.where(F.when(broken, fail).otherwise(~F.col("is_status")))
    else:
        text = text.where(~F.col("is_status"))
    small = parse_rows(text, None)
    reader = {"ignoreCorruptFiles": str(skip_unreadable).lower(), "ignoreMissingFiles": str(skip_unreadable).lower()}
    large = [parse_rows(_csv(spark.read.options(**reader), list(names)).csv(files), list(names))
             for names, files in find_layouts(spark, paths, whole_bytes, glob).items()]
    if keep_place:
        large = [with_place(rows) for rows in large]
    else:
        small = small.drop(PLACE[2])
    return reduce(DataFrame.unionByName, large, small)


def read_detections_csv(spark: SparkSession, paths, mode: str = "permissive", layout: list[str] | None = None,
                        keep_place: bool = False, whole_bytes: int = WHOLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) rows of detection CSV files, columns found by header name.

    Files may have different headers. Those up to ``whole_bytes`` are each opened whole, header and rows in one pass;
    longer ones are split, one scan a layout after a pass for the headers. Give ``layout`` when all files share a
    known one, and all are split without that pass. Rejected rows carry their reason. With ``mode="failfast"`` any
    bad row fails the job and nothing is rejected. ``keep_place`` adds the columns PLACE to the good rows.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    columns = OUTPUT + PLACE if keep_place else OUTPUT
    if layout:
        rows = parse_rows(_csv(spark.read, list(layout)).csv(paths), list(layout))
        rows = with_place(rows) if keep_place else rows
    else:
        rows = _any_layout(spark, paths, "*", whole_bytes, keep_place, False)
    if mode == "failfast":
        # a filter runs whichever columns are read
        fail = F.raise_error(F.concat(F.lit("bad detection row: "), F.col("reject_reason"))).cast("boolean")
        rows = rows.where(F.when(F.col("reject_reason").isNotNull(), fail).otherwise(F.lit(True)))
        return rows.select(*columns), rows.where(F.lit(False))
    good = rows.where(F.col("reject_reason").isNull()).select(*columns)
    return good, rows.where(F.col("reject_reason").isNotNull())


def stream_detections_csv(spark: SparkSession, folder: str, layout: list[str], files_per_trigger: int = 1000,
                          keep_place: bool = False) -> DataFrame:
    """Good rows of CSV files as they arrive in a folder; the layout is fixed per stream."""
    rows = stream_rows_csv(spark, folder, layout, files_per_trigger)
    if keep_place:
        rows = with_place(rows)
    return rows.where(F.col("reject_reason").isNull()).select(*OUTPUT, *(PLACE if keep_place else []))


def stream_rows_csv(spark: SparkSession, folder: str, layout: list[str], files_per_trigger: int = 1000) -> DataFrame:
    """Good and rejected rows, the latter with their reason, of CSV files as they arrive; both are
    counted in the query's observed metrics ``csv_rows``."""
    text = _csv(spark.readStream, layout).option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    bad = F.col("reject_reason").isNotNull()
    return parse_rows(text, layout).observe("csv_rows", F.count(F.lit(1)).alias("rows"), F.count(F.when(bad, 1)).alias("rejected"))


def gather_detections(spark: SparkSession, folder: str, layout: list[str] | None = None,
                      skip_unreadable: bool = False, whole_bytes: int = WHOLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) rows of all per-video CSVs of a folder. A file without a video
    column gets its own name. An unreadable file fails the job; with ``skip_unreadable`` it is left out, and
    ``gather_failures`` lists it."""
    if layout:
        skip = str(skip_unreadable).lower()
        options = {"ignoreCorruptFiles": skip, "ignoreMissingFiles": skip, "pathGlobFilter": "*.csv"}
        rows = parse_rows(_csv(spark.read.options(**options), list(layout)).csv(folder), list(layout))
    else:
        rows = _any_layout(spark, [folder], "*.csv", whole_bytes, False, skip_unreadable)
    # the path is percent-encoded; a plus sign in it is a plus sign
    stem = F.regexp_extract("source_file", r"([^/]+?)(\.csv)?$", 1)
    name = F.url_decode(F.replace(stem, F.lit("+"), F.lit("%2B")))
    rows = rows.withColumn("video_name", F.when(F.col("video_name") == "", name).otherwise(F.col("video_name")))
    return rows.where(F.col("reject_reason").isNull()).select(*OUTPUT), rows.where(F.col("reject_reason").isNotNull())


def gather_failures(spark: SparkSession, folder: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(source_file, reason) of the CSVs of a folder that ``gather_detections(skip_unreadable=True)`` leaves out:
    those that can't be opened, are no UTF-8 text or have no header. Files of no bytes are not seen, files longer than ``whole_bytes`` are not looked at."""
    status = csv_status(open_files(spark, [folder], "*.csv", whole_bytes, True), COLUMNS, "strict")
    return failed_files(list_files(spark, folder, "*.csv", whole_bytes), status)


def enrich(df: DataFrame, vehicle_id: str = "vehicle-001", session_id: str | None = None,
           deterministic_id: bool = False) -> DataFrame:
    """Adds ids and the ingest time, with pixels under their message names.

    ``deterministic_id`` derives the id from the row, so that reading a file again gives the same ids and duplicates
    can be dropped. Rows that carry their place (PLACE) take it from vehicle, session (if one is given), file, block
    and line: two rows of a file never share an id. Rows of a table have no place; there the id comes from the content
    and, as equal rows of a batch are told apart by nothing else, from a count of them. A stream without places can't
    count, so its equal rows share an id.
    """
    import uuid

    session = session_id or str(uuid.uuid4())
    source = [F.lit(vehicle_id), F.lit(session_id or "")]
    if not deterministic_id:
        key = F.expr("uuid()")
    elif set(PLACE) <= set(df.columns):
        key = F.sha2(F.concat_ws("\n", *source, *(F.col(c).cast("string") for c in PLACE)), 256)
    else:
        row = F.to_json(F.struct(source[0].alias("vehicle_id"), source[1].alias("session_id"), *OUTPUT))
        df = df.withColumn("_row", F.sha2(row, 256))
        if df.isStreaming:
            key = F.col("_row")
        else:
            copy = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
            key = F.when(copy == 1, F.col("_row")).otherwise(F.sha2(F.concat_ws("\n", "_row", copy.cast("string")), 256))
    return df.select(
        key.alias("detection_id"), F.lit(vehicle_id).alias("vehicle_id"), F.lit(session).alias("session_id"),
        F.current_timestamp().alias("ingested_at"), "video_name", "frame_number", "timestamp_sec",
        F.col("u").alias("pixel_u"), F.col("v").alias("pixel_v"), "confidence", "class_name",
        "vehicle_lat", "vehicle_lon", "recording_timestamp")


def detections_report(det: DataFrame) -> DataFrame:
    """The ten export columns as text with fixed decimals; blanks for nulls."""
    def fixed(name: str, digits: int) -> Column:
        return F.coalesce(F.when(F.col(name).isNotNull(), F.format_string(f"%.{digits}f", F.col(name))),
                          F.lit("")).alias(name)

    return det.select(
        "video_name", "frame_number", fixed("timestamp_sec", 3), fixed("u", 2), fixed("v", 2), fixed("confidence", 4),
        F.coalesce("class_name", F.lit("")).alias("class_name"), fixed("vehicle_lat", 6), fixed("vehicle_lon", 6),
        F.coalesce("recording_timestamp", F.lit("")).alias("recording_timestamp"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
