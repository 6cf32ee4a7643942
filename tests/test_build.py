"""The daily build: what readers see after runs that succeed and runs that fail."""

import pytest
from pyspark.sql import functions as F

from mapaudit import inputs
from mapaudit.operators import marts
from mapaudit.plans import build
from mapaudit.session import new_path


def test_a_run_that_fails_in_a_mart_changes_nothing(spark, sf, monkeypatch):
    warehouse, prefix = new_path(spark, "warehouse"), "t_build_"
    raw, nodes = inputs.raw_detections(spark, sf), inputs.osm_nodes(spark, sf)
    build.build_all(spark, raw, nodes, warehouse, schema_prefix=prefix)
    paths = lambda: sorted((r.layer, r["name"], r.path) for r in build.current_tables(spark, warehouse).collect())
    shown = lambda: sorted(map(str, spark.table(f"{prefix}marts.audit_summary_metrics").collect()))
    before, rows = paths(), shown()
    reader = spark.table(f"{prefix}core.fct_map_audit")
    facts = reader.count()
    assert [p[:2] for p in before] == [("core", "fct_map_audit"), ("marts", "audit_summary_metrics"), ("marts", "discrepancy_details")]

    with monkeypatch.context() as m:
        m.setattr(marts, "discrepancy_details", lambda fct: fct.select(F.raise_error(F.lit("mart broke")).cast("int").alias("x")))
        with pytest.raises(Exception, match="mart broke"):
            build.build_all(spark, raw.limit(10), nodes, warehouse, schema_prefix=prefix)
    assert paths() == before and shown() == rows

    build.build_all(spark, raw.limit(10), nodes, warehouse, schema_prefix=prefix)
    after = paths()
    assert len(after) == 3 and not set(after) & set(before) and shown() != rows
    assert reader.count() == facts  # a reader of the former run goes on


def test_a_new_schema_replaces_the_old_one(spark):
    warehouse = new_path(spark, "warehouse")
    for run, names in (("a", ["x"]), ("b", ["x", "y"])):
        build.materialize(spark.range(3).select(*[F.col("id").alias(n) for n in names]), "marts", "m", warehouse, run)
        build.publish(spark, warehouse, run, [("marts", "m")], "t_schema_")
    assert spark.table("t_schema_marts.m").columns == ["x", "y"]
    spark.sql("DROP VIEW t_schema_marts.m")
    build.register(spark, warehouse, "t_schema_")
    assert spark.table("t_schema_marts.m").count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        build.materialize(spark.range(1), "marts", "m", warehouse, "a")
