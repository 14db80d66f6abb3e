"""Writing tables."""

import subprocess
import sys
import time
from types import SimpleNamespace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plantfuse.operators import checks, keys, load
from plantfuse.plans import load_job, star_model
from plantfuse.plans.star_queries import star_queries
from plantfuse.session import shared_path
from plantfuse.sources import TableDef, catalogs
from plantfuse.sources.factory import FACTORY_SOURCES, factory_source
from tests.factory_data import MACHINES, work_tables


@pytest.fixture
def schema(spark, request):
    name = "s_" + "".join(c if c.isalnum() else "_" for c in request.node.name)
    load.create_schema(spark, name)
    yield name
    load.drop_schema(spark, name)


def test_shared_path_lies_in_the_configured_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_path(spark, "a").startswith(base)
    assert shared_path(spark, "a") != shared_path(spark, "a")


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local[4]"])
def test_a_session_without_a_shared_folder_is_refused(master):
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: default),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None),
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(session, "a")


def test_overwrite_replaces_and_keeps_partitions(spark):
    path = shared_path(spark, "t")
    load.overwrite_files(spark.range(5), path)
    back = load.overwrite_files(spark.range(100).repartition(3), path)
    assert back.count() == 100
    assert len(back.inputFiles()) == 3
    by_kind = spark.range(10).withColumn("kind", F.col("id") % 2)
    split = load.overwrite_files(by_kind, path + "-p", partition_by=["kind"])
    assert split.where("kind = 1").count() == 5


def test_every_factory_table_is_created_as_declared(spark, schema):
    names = 0
    for source in FACTORY_SOURCES:
        for table in source.tables:
            name = f"{schema}.{source.key}_{table.name}"
            load.create_table(
                spark, name, table.ddl, comment=table.comment, defaults=table.defaults
            )
            comments = load.column_comments(spark, name)
            assert set(comments) == set(spark.table(name).columns)
            names += 1
    assert names == 19
    assert catalogs.tables_like(spark, schema, "snowflake_*").count() == 4


def test_defaults_fill_columns_left_out(spark, schema):
    table = factory_source("redshift").table("sensor_readings")
    name = f"{schema}.readings"
    load.create_table(spark, name, table.ddl, defaults=table.defaults)
    rows = spark.sql(
        "SELECT 1 AS reading_id, 1 AS sensor_id, 1 AS machine_id,"
        " TIMESTAMP_NTZ '2025-01-15 08:00:00' AS reading_time, 2.50 AS value"
    )
    load.append_rows(rows, name)
    load.append_rows(rows.withColumn("status", F.lit("critical")), name)
    assert sorted(r.status for r in spark.table(name).collect()) == ["critical", "normal"]
    with pytest.raises(Exception, match="EXCEED_LIMIT_LENGTH"):
        load.append_rows(rows.withColumn("status", F.lit("x" * 21)), name)


def test_apply_defaults(spark):
    frame = spark.createDataFrame([(1, None), (2, "x")], "id INT, s STRING")
    filled = load.apply_defaults(frame, {"s": "normal", "n": 0})
    assert [tuple(r) for r in filled.orderBy("id").collect()] == [(1, "normal", 0), (2, "x", 0)]


def test_reload_is_repeatable_and_keeps_the_definition(spark, schema):
    name = f"{schema}.t"
    load.create_table(spark, name, "id BIGINT COMMENT 'number'", comment="a table")
    load.append_rows(spark.range(3), name)
    for _ in range(2):
        load.reload_table(spark.range(10, 14), name)
        assert sorted(r.id for r in spark.table(name).collect()) == [10, 11, 12, 13]
    assert load.column_comments(spark, name) == {"id": "number"}


def test_insert_if_absent(spark, schema):
    name = f"{schema}.t"
    load.create_table(spark, name, "k INT, v STRING, at INT")
    load.append_rows(spark.createDataFrame([(1, "old", 0)], "k INT, v STRING, at INT"), name)
    incoming = spark.createDataFrame(
        [(1, "new", 1), (2, "later", 2), (2, "first", 1), (3, None, 1)], "k INT, v STRING, at INT"
    )
    expected = [(1, "old", 0), (2, "first", 1), (3, None, 1)]
    for _ in range(2):
        stored = load.insert_if_absent(incoming, name, ["k"], [F.col("at")])
        assert sorted(map(tuple, stored.collect())) == expected
    with_null = spark.createDataFrame([(None, "x", 1)], "k INT, v STRING, at INT")
    with pytest.raises(Exception, match="NULL in column k"):
        load.insert_if_absent(with_null, name, ["k"], [F.col("at")])
    assert spark.table(name).count() == 3


row = st.tuples(st.integers(0, 6), st.sampled_from("abc"), st.integers(0, 3))


@settings(
    max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(target=st.sets(st.integers(0, 6)), incoming=st.lists(row, max_size=20))
def test_rows_to_insert_by_brute_force(spark, target, incoming):
    columns = "k INT, v STRING, at INT"
    stored = spark.createDataFrame([(k, "old", 0) for k in target], columns)
    frame = spark.createDataFrame(incoming, columns)
    new = load.rows_to_insert(frame, stored, ["k"], [F.col("at")])
    expected = {}
    for k, v, at in incoming:
        if k not in target:
            expected[k] = min(expected.get(k, (at, v)), (at, v))
    assert {r.k: (r.at, r.v) for r in new.collect()} == expected


def test_a_hot_key_is_combined_before_the_shuffle(spark):
    frame = spark.range(0, 3000, 1, 6).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(0).alias("k"), F.col("id").alias("at")
    )
    first = load.first_per_key(frame, ["k"], [F.col("at")])
    assert first.count() == 2001
    assert first.where("k = 0").first().at == 0
    text = first._jdf.queryExecution().executedPlan().toString()
    assert text.index("partial_min") > text.index("Exchange hashpartitioning")
    assert "Window" not in text


def test_external_table_outlives_its_drop(spark, schema):
    path = shared_path(spark, "ext")
    load.overwrite_files(spark.range(4), path)
    name = f"{schema}.ext"
    load.create_table(
        spark, name, "id BIGINT COMMENT 'number'", location=path, properties={"keeper": "plant's"}
    )
    load.set_properties(spark, name, {"tier": "gold"})
    load.comment_table(spark, name, "it's external")
    load.comment_columns(spark, name, {"id": "new comment"})
    assert load.column_comments(spark, name) == {"id": "new comment"}
    properties = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    assert (properties["keeper"], properties["tier"]) == ("plant's", "gold")
    detail = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    assert detail["Comment"] == "it's external" and detail["Type"] == "EXTERNAL"
    load.drop_table(spark, name)
    assert not spark.catalog.tableExists(name)
    assert spark.read.parquet(path).count() == 4


def test_summary_is_created_and_replaced(spark, schema):
    name = f"{schema}.summary"
    assert load.save_summary(spark.range(3), name).count() == 3
    replaced = load.save_summary(spark.range(2).withColumn("x", F.lit("a")), name)
    assert replaced.columns == ["id", "x"] and replaced.count() == 2
    versioned = load.create_versioned_table(
        spark.range(2), f"{schema}.versioned", "parquet", {"format-version": "2"}
    )
    assert versioned.count() == 2


def test_generated_key_numbers_all_rows_in_order(spark):
    # A third of the rows share their first order column.
    frame = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 10).alias("day"),
        (F.col("id") * 7919 % 3001).alias("n"),
    )
    path = shared_path(spark, "numbered")
    numbered = keys.with_generated_key(frame, "log_id", ["day", "n"], path).collect()
    in_order = sorted(numbered, key=lambda r: (r.day, r.n))
    assert [r.log_id for r in in_order] == list(range(1, 3001))
    started = keys.with_generated_key(frame, "i", ["day", "n"], path + "-2", start=100)
    assert started.agg(F.min("i")).first()[0] == 100


def test_load_job_numbers_counts_and_repeats(spark, schema):
    orders = factory_source("postgres").table("work_orders")
    frame = spark.createDataFrame(
        [
            (m, "LOW", status, "2025-01-01", "2025-01-02", "x")
            for _, m, status in work_tables()[1]
        ],
        "machine_id INT, priority STRING, status STRING, created_date STRING, due_date STRING,"
        " assigned_to STRING",
    ).withColumns({c: F.col(c).cast("date") for c in ("created_date", "due_date")})
    machines = factory_source("postgres").table("machines")
    master = spark.createDataFrame(
        MACHINES, "machine_id INT, machine_name STRING, production_line STRING, factory STRING,"
        " status STRING"
    )
    for _ in range(2):
        report = load_job.load_tables(spark, schema, [(orders, frame), (machines, master)])
        assert {tuple(r)[:4] for r in report.collect()} == {
            ("work_orders", 25, 25, "PASS"),
            ("machines", 10, 10, "PASS"),
        }
        assert checks.all_passed(report).first()[0] is True
    numbers = [r.order_id for r in spark.table(f"{schema}.work_orders").collect()]
    assert sorted(numbers) == list(range(1, 26))


def test_load_job_stops_at_a_null(spark, schema):
    table = TableDef("t", "id BIGINT NOT NULL")
    frame = spark.sql("SELECT CAST(NULL AS BIGINT) AS id")
    with pytest.raises(Exception, match="NULL in column id"):
        load_job.load_tables(spark, schema, [(table, frame)])


def test_a_repeated_key_or_other_columns_stop_the_load(spark):
    table = TableDef("machines", "machine_id INT NOT NULL, name VARCHAR(3)", key=("machine_id",))
    schema = "keys_checked"
    load.create_schema(spark, schema)
    good = spark.createDataFrame([(1, "a"), (2, "b")], "machine_id INT, name STRING")
    assert load_job.load_table(spark, schema, table, good).count() == 2
    with pytest.raises(load_job.LoadError, match="PRIMARY KEY machine_id: 1"):
        load_job.load_table(spark, schema, table, good.union(good.limit(1)))
    other = TableDef("machines", "machine_id INT, place STRING")
    with pytest.raises(load_job.LoadError, match="place"):
        load_job.load_table(spark, schema, other, good)


def test_rows_sent_are_counted_as_they_are_written(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    frame = spark.range(50).mapInArrow(counted, "id BIGINT")
    report = load_job.load_tables(spark, "observed", [(TableDef("t", "id BIGINT"), frame)])
    assert [tuple(r)[:4] for r in report.collect()] == [("t", 50, 50, "PASS")]
    assert reads.value == 50


def test_null_status_is_loaded_like_any_other(spark, tmp_path):
    orders = star_model.star_table(spark, "/root/testdata/sf0.001", "orders").limit(20)
    status = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus"))
    folder = str(tmp_path)
    orders.withColumn("o_orderstatus", status).write.parquet(f"{folder}/orders.parquet")
    assert star_queries()["sink_append"](spark, folder).count() == 20
    orders.withColumn("o_orderdate", F.lit(None).cast("timestamp_ntz")).write.parquet(
        f"{folder}/undated.parquet"
    )
    undated = star_model.star_table(spark, folder, "undated")
    sides = [star_model.inspections(undated, early=e).count() for e in (True, False)]
    assert sides == [0, 20]


def test_what_was_written_on_the_way_goes_with_the_session(tmp_path):
    """In a process of its own: the folder is empty of it once the driver has ended."""
    script = """
import sys
from plantfuse.session import local_session, removed_at_exit, shared_path
spark = local_session("exit", 1, **{"spark.checkpoint.dir": sys.argv[1]})
path = removed_at_exit(spark, (spark.range(3).write.parquet(p := shared_path(spark, "t")), p)[1])
print(spark.read.parquet(path).count())
spark.stop()
"""
    run = subprocess.run(
        [sys.executable, "-c", script, str(tmp_path)], capture_output=True, text=True, timeout=120
    )
    assert run.stdout.split()[-1] == "3"
    deadline = time.time() + 20
    while list(tmp_path.rglob("*.parquet")) and time.time() < deadline:
        time.sleep(0.2)
    assert not list(tmp_path.rglob("*.parquet"))
