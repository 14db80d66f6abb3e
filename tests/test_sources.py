"""Readers, names, catalogs and the registry, as far as they go without a database."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantfuse.operators import load
from plantfuse.plans import load_job, steps, summaries
from plantfuse.session import shared_path
from plantfuse.sources import (
    SourceError,
    Sources,
    TableSource,
    catalogs,
    rows_frame,
    values_frame,
)
from plantfuse.sources.factory import (
    FACTORY_SOURCES,
    Names,
    catalog_sources,
    factory_source,
    file_sources,
)
from plantfuse.sources.readers import JDBC_PRODUCTS, jdbc_url, storable_schema
from tests.factory_data import factory_frames

# Rows the factory tables are declared to hold.
DECLARED_ROWS = {
    "glue": {"sensors": 20, "machines": 10, "quality_inspections": 50},
    "redshift": {"sensor_readings": 100, "production_events": 30, "quality_inspections": 40},
    "postgres": {"machines": None, "maintenance_logs": 30, "work_orders": 25},
    "synapse": {"shift_schedules": 40, "energy_consumption": 50},
    "bigquery": {"downtime_records": 35, "cost_allocation": 30},
    "onelake": {"production_plans": 20, "inventory_levels": 30},
    "snowflake": {"equipment_specs": 10, "spare_parts_inventory": 30},
    "snowflake_iceberg": {"operational_metrics": 50, "safety_incidents": 20},
}


def test_registry_holds_every_source():
    assert {
        s.key: {t.name: t.expected_rows for t in s.tables} for s in FACTORY_SOURCES
    } == DECLARED_ROWS


def test_three_level_names():
    names = Names("q", "c", "db")
    master = names.table(factory_source("glue"), "machines")
    assert master == "`c_glue`.`db_factory_master`.`machines`"
    assert names.table(factory_source("redshift"), "t") == "`q_redshift`.`db`.`t`"
    assert names.table(factory_source("bigquery"), "t") == "`q_bigquery`.`db_factory`.`t`"
    assert names.table(factory_source("onelake"), "t") == "`c_onelake`.`default`.`t`"
    assert catalogs.qualified(None, "a`b", "c") == "`a``b`.`c`"


def test_missing_catalogs_fail_and_sources_that_are_off_leave_no_step(spark):
    sources = catalog_sources(spark)
    assert len(sources.names()) == 19
    with pytest.raises(SourceError, match="redshift.sensor_readings: "):
        steps.runnable_steps(sources)
    off = catalog_sources(spark, off=[s.key for s in FACTORY_SOURCES])
    assert steps.runnable_steps(off) == {} and len(off.absent) == 19
    with pytest.raises(LookupError, match="glue.machines"):
        off.first("glue.machines", "postgres.machines")


@pytest.mark.parametrize(
    "load_table",
    [
        lambda spark: TableSource.delta("/x").load(spark),
        lambda spark: TableSource.jdbc("jdbc:x", "t", "u", "p", "no.Driver").load(spark),
        lambda spark: TableSource.parquet("/nowhere").load(spark),
        lambda spark: TableSource.table("no_catalog.no_schema.t").load(spark),
    ],
)
def test_a_source_that_is_on_and_fails_is_never_passed_over(spark, load_table):
    sources = Sources({"a.t": lambda: load_table(spark), "b.t": lambda: spark.range(3)})
    for ask in (lambda: sources.first("a.t", "b.t"), lambda: sources.live("a.t", "b.t")):
        with pytest.raises(SourceError, match="^a.t: "):
            ask()
    assert sources.without("a").first("a.t", "b.t").count() == 3


def test_a_mistyped_path_leaves_the_stored_tables_as_they_were(spark):
    frames = factory_frames(spark)
    loaders = {name: lambda frame=frame: frame for name, frame in frames.items()}
    stored = steps.store_summaries(spark, Sources(loaders), "kept_summaries")
    before = {name: sorted(map(str, frame.collect())) for name, frame in stored.items()}
    wrong = loaders | {
        "glue.quality_inspections": lambda: TableSource.parquet("/mistyped").load(spark)
    }
    with pytest.raises(SourceError, match="glue.quality_inspections"):
        steps.store_summaries(spark, Sources(wrong), "kept_summaries")
    for name, rows in before.items():
        table = spark.table(f"kept_summaries.{name}")
        assert sorted(map(str, table.collect())) == rows
    assert set(before) == {"machine_health_summary", "factory_operations_union"}


def test_declared_counts_are_reconciled_with_the_live_tables(spark):
    frames = factory_frames(spark)
    loaders = {name: lambda frame=frame: frame for name, frame in frames.items()}

    def broken():
        raise RuntimeError("no connection " + "x" * 500)

    loaders["redshift.sensor_readings"] = lambda: frames["redshift.sensor_readings"].limit(99)
    loaders["synapse.shift_schedules"] = lambda: TableSource.parquet("/nowhere").load(spark)
    loaders["postgres.work_orders"] = broken
    off = [s.key for s in FACTORY_SOURCES if s.key in ("onelake", "snowflake", "snowflake_iceberg")]
    report = load_job.reconcile_sources(spark, FACTORY_SOURCES, Sources(loaders, off), off)
    found = {row.table_name: row for row in report.collect()}
    assert found["redshift.sensor_readings"].status == "MISMATCH"
    assert (found["redshift.sensor_readings"].expected_rows, found["redshift.sensor_readings"].actual_rows) == (100, 99)
    assert found["synapse.shift_schedules"].status == "FAIL"
    assert found["postgres.work_orders"].status == "ERROR"
    assert len(found["postgres.work_orders"].message) > 500
    assert found["postgres.maintenance_logs"].status == "PASS"
    assert not any(name.split(".")[0] in off for name in found)


def test_a_file_that_lacks_a_declared_column_is_refused(spark):
    path = shared_path(spark, "lacking")
    load.overwrite_files(spark.range(3).toDF("machine_id"), path)
    with pytest.raises(ValueError, match="status"):
        TableSource.parquet(path, "machine_id BIGINT, status STRING").load(spark)


def test_splits_reach_the_reader_of_a_catalog_table(spark):
    source = TableSource.table("c.s.t", ("id", "0", "1000", 16))
    assert source.options == {
        "partitionColumn": "id", "lowerBound": "0", "upperBound": "1000", "numPartitions": "16",
    }
    load.create_schema(spark, "split_schema")
    load.create_table(spark, "split_schema.t", "id INT")
    source = TableSource.table("split_schema.t", ("id", "0", "9", 2))
    analyzed = source.load(spark)._jdf.queryExecution().logical().toString()
    assert "numPartitions=2" in analyzed.replace(" ", "")


def test_factory_files_are_read_in_their_declared_types(spark):
    folder = shared_path(spark, "factory")
    for name, frame in factory_frames(spark).items():
        source, table = name.split(".")
        declared = storable_schema(factory_source(source).table(table).ddl)
        lacking = {
            f.name: F.lit(None).cast(f.dataType) for f in declared if f.name not in frame.columns
        }
        load.overwrite_files(frame.withColumns(lacking), f"{folder}/{source}/{table}")
    sources = file_sources(spark, folder, off=("glue",))
    machines = sources.first("glue.machines", "postgres.machines")
    assert dict(machines.dtypes)["machine_name"] == "string"
    assert machines.schema["machine_id"].metadata["comment"]
    assert set(steps.runnable_steps(sources)) == {s.name for s in steps.STEPS}
    health = summaries.machine_health_summary(sources).where("machine_id = 8").first()
    assert (health.sensor_critical_count, health.total_defect_count) == (2, 12)
    with pytest.raises(SourceError, match="onelake.production_plans: "):
        sources.first("onelake.production_plans")


def test_turned_off_sources_are_not_loaded(spark):
    def never():
        raise AssertionError("loaded a source that is off")

    sources = Sources({"a.t": never, "b.t": lambda: spark.range(1)}, off=("a",))
    assert sources.first("a.t", "b.t").count() == 1
    assert not sources.without("b").has("b.t")


def test_declared_schema_prunes_and_converts_nothing(spark):
    path = shared_path(spark, "declared")
    load.overwrite_files(spark.sql("SELECT 1 AS a, 'x' AS b, 2.5D AS c"), path)
    frame = TableSource.parquet(path, "a INT COMMENT 'first', c DOUBLE").load(spark)
    assert [tuple(r) for r in frame.collect()] == [(1, 2.5)]
    assert frame.schema["a"].metadata["comment"] == "first"
    orc = load.overwrite_files(frame, path + "-orc", "orc")
    assert orc.count() == 1


def test_jdbc_options():
    driver = JDBC_PRODUCTS["postgresql"][1]
    url = jdbc_url("postgresql", "h", "d")
    assert url == "jdbc:postgresql://h:5432/d"
    assert jdbc_url("redshift", "h", "d") == "jdbc:redshift://h:5439/d"
    assert "trustServerCertificate=true" in jdbc_url("sqlserver", "h", "d")
    whole = TableSource.jdbc(url, "s.t", "u", "p", driver)
    assert "partitionColumn" not in whole.options and whole.options["fetchsize"] == "10000"
    split = TableSource.jdbc(url, "s.t", "u", "p", driver, split=("id", "0", "1000", 16))
    assert split.options["numPartitions"] == "16" and split.options["partitionColumn"] == "id"


def test_connector_options():
    bq = TableSource.bigquery("p", "d.t", "key")
    assert bq.format == "bigquery" and bq.options["parentProject"] == "p"
    sf = TableSource.snowflake("h", "u", "p", "w", "d", "s", "t")
    assert sf.options["sfWarehouse"] == "w" and sf.options["dbtable"] == "t"


def test_catalog_settings(spark):
    catalogs.register_jdbc_catalog(spark, "q_pg", "jdbc:x", "u", "p", "drv")
    assert spark.conf.get("spark.sql.catalog.q_pg") == catalogs.JDBC_CATALOG
    assert spark.conf.get("spark.sql.catalog.q_pg.pushDownAggregate") == "true"
    catalogs.register_iceberg_catalog(spark, "ice", "s3://b/w", "impl", "io")
    assert spark.conf.get("spark.sql.catalog.ice.catalog-impl") == "impl"
    assert spark.conf.get("spark.sql.catalog.ice.io-impl") == "io"


def test_listing(spark):
    load.create_schema(spark, "plant_demo_factory")
    load.create_table(spark, "plant_demo_factory.machines", "id INT")
    load.create_table(spark, "plant_demo_factory.sensors", "id INT")
    found = catalogs.tables_like(spark, "plant_demo_factory", "mach*").collect()
    assert [r.tableName for r in found] == ["machines"]
    assert catalogs.schemas_like(spark, "plant_*_factory").count() == 1
    load.drop_schema(spark, "plant_demo_factory")
    assert catalogs.schemas_like(spark, "plant_*_factory").count() == 0


def test_inline_values_keep_their_types(spark):
    frame = values_frame(
        spark, "(1, DATE '2025-01-01', CAST(8 AS DECIMAL(4,1)))", "shift_id, shift_date, hours"
    )
    assert dict(frame.dtypes) == {"shift_id": "int", "shift_date": "date", "hours": "decimal(4,1)"}


def test_rows_and_pandas_frames_take_the_declared_schema(spark):
    schema = "id BIGINT, name STRING, done BOOLEAN"
    pandas = pd.DataFrame({"id": [1, 2], "name": ["a", None], "done": [True, False]})
    rows = [(1, "a", True), (2, None, False)]
    made = [rows_frame(spark, source, schema) for source in (rows, pandas)]
    assert made[0].collect() == made[1].collect()
    assert made[0].schema == made[1].schema
    path = shared_path(spark, "from-pandas")
    assert load.overwrite_files(made[1], path).orderBy("id").first().name == "a"
