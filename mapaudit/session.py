"""Session helpers: the shared working folder and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER_KEY = "spark.checkpoint.dir"
_own_folder: dict[str, str] = {}


def working_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is set, a private one in local mode, where
    driver and executors share it; elsewhere an error, as executors would each write to their own disk."""
    folder = spark.conf.get(_FOLDER_KEY, None) or spark.sparkContext.getConf().get(_FOLDER_KEY)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_FOLDER_KEY} to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folder:
            _own_folder[app] = tempfile.mkdtemp(prefix="mapaudit-")
        folder = _own_folder[app]
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{working_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends
    there and a lost executor costs a re-read, not a re-run of earlier rounds."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
