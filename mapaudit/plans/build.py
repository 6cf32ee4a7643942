"""The daily build: staging views, the audit fact, two marts, sixteen checks.

Every run writes its tables beside those of earlier runs. Only when all of them are written does it become the current
build: first as rows of the table ``builds`` of the warehouse folder, then as views in one schema a layer. A run that
fails leaves both as they were, and readers of the former tables are not disturbed. Folders of old runs are left to
the warehouse's own clean-up.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapaudit.config import DEFAULT, AuditConfig
from mapaudit.operators import marts, quality, staging
from mapaudit.operators.audit import fct_map_audit

_BUILDS = "run string, layer string, name string, path string, published_at timestamp"


def materialize(df: DataFrame, layer: str, name: str, warehouse: str, run: str | None = None) -> DataFrame:
    """Staging stays a view; core and marts are written once and read back. With ``run`` the table goes to that run's
    own folder, which must be new; without it the former table is overwritten."""
    if layer == "staging":
        df.createOrReplaceTempView(f"{layer}_{name}")
        return df
    path = f"{warehouse}/{layer}/{name}" + (f"/run-{run}" if run else "")
    df.write.mode("errorifexists" if run else "overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(spark: SparkSession, warehouse: str, run: str, tables: list[tuple[str, str]], schema_prefix: str = "") -> None:
    """Makes a run's (layer, name) tables the current ones. Its rows of ``builds`` are one file of one commit, so a reader
    of the folder sees all of them or none; the views follow one by one."""
    rows = [(run, layer, name, f"{warehouse}/{layer}/{name}/run-{run}") for layer, name in tables]
    log = spark.createDataFrame(rows, "run string, layer string, name string, path string")
    log.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{warehouse}/builds")
    register(spark, warehouse, schema_prefix)


def current_tables(spark: SparkSession, warehouse: str) -> DataFrame:
    """The rows of ``builds`` of the last published run."""
    builds = spark.read.schema(_BUILDS).parquet(f"{warehouse}/builds")
    last = builds.agg(F.max_by("run", F.struct("published_at", "run")).alias("run"))
    return builds.join(F.broadcast(last), "run", "left_semi")


def register(spark: SparkSession, warehouse: str, schema_prefix: str = "") -> None:
    """The current tables as views ``<prefix><layer>.<name>``, a schema for each layer; also for a session that
    opens a warehouse built by another."""
    for row in current_tables(spark, warehouse).collect():  # a handful of models
        schema = f"`{schema_prefix}{row.layer}`"
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema} LOCATION '{warehouse}/{row.layer}'")
        spark.sql(f"CREATE OR REPLACE VIEW {schema}.`{row['name']}` AS SELECT * FROM parquet.`{row.path}`")


def build_all(spark: SparkSession, raw: DataFrame, nodes: DataFrame, warehouse: str,
              cfg: AuditConfig = DEFAULT, schema_prefix: str = "") -> dict[str, DataFrame]:
    """Every model in dependency order, under the folder ``warehouse``, published at the end. The fact is written once;
    marts and checks read it."""
    run, stored = uuid.uuid4().hex, []

    def store(df: DataFrame, layer: str, name: str) -> DataFrame:
        stored.append((layer, name))
        return materialize(df, layer, name, warehouse, run)

    det = materialize(staging.stage_detections(staging.flatten_detections(raw)), "staging", "stg_perception_data", warehouse)
    osm = materialize(staging.stage_nodes(nodes), "staging", "stg_osm_ground_truth", warehouse)
    fct = store(fct_map_audit(det, osm, cfg), "core", "fct_map_audit")
    built = {
        "stg_perception_data": det,
        "stg_osm_ground_truth": osm,
        "fct_map_audit": fct,
        "audit_summary_metrics": store(marts.audit_summary(fct), "marts", "audit_summary_metrics"),
        "discrepancy_details": store(marts.discrepancy_details(fct), "marts", "discrepancy_details"),
        "checks": quality.run_checks(raw, nodes, fct),
    }
    publish(spark, warehouse, run, stored, schema_prefix)
    return built
