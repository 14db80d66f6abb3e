"""Reconciliation, constraints, profiles, copies and provenance."""

from pyspark.sql import functions as F

from plantfuse.operators import checks, combine
from plantfuse.plans import star_model
from plantfuse.sources import TableSource
from tests.factory_data import factory_frames


def test_reconcile_reports_each_outcome(spark):
    def broken():
        raise RuntimeError("no connection")

    counts = checks.table_counts(
        spark,
        {
            "whole": lambda: spark.range(10),
            "one_dropped": lambda: spark.range(9),
            "absent": lambda: TableSource.parquet("/nowhere/at/all").load(spark),
            "unsupported": lambda: spark.read.format("no_such_format").load("/x"),
            "broken": broken,
        },
    )
    expected = spark.createDataFrame(
        [(t, 10) for t in ("whole", "one_dropped", "absent", "unsupported", "broken", "unknown")],
        "table_name STRING, expected_rows BIGINT",
    )
    report = checks.reconcile(counts, expected)
    assert {r.table_name: r.status for r in report.collect()} == {
        "whole": "PASS",
        "one_dropped": "MISMATCH",
        "absent": "FAIL",
        "unsupported": "ERROR",
        "broken": "ERROR",
        "unknown": "MISMATCH",
    }
    message = report.where("table_name = 'broken'").first().message
    assert message == "no connection"
    assert checks.all_passed(report).first()[0] is False
    assert checks.all_passed(report.where("status = 'PASS'")).first()[0] is True


def test_counting_one_by_one_isolates_an_unreadable_table(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    spark.range(4).write.parquet(str(good))
    bad.mkdir()
    (bad / "part.parquet").write_bytes(b"not a parquet file")
    counts = checks.table_counts_one_by_one(
        spark,
        {
            t.name: lambda t=t: TableSource.parquet(str(t), "id BIGINT").load(spark)
            for t in (good, bad, tmp_path / "absent")
        },
    )
    assert {(r.table_name, r.actual_rows, r.failure) for r in counts.collect()} == {
        ("good", 4, None),
        ("bad", None, "ERROR"),
        ("absent", None, "FAIL"),
    }


def test_constraint_violations(spark):
    frame = spark.createDataFrame(
        [(1, "abc"), (1, "abcd"), (1, None), (2, "a"), (None, "a"), (None, "b")], "k INT, s STRING"
    )
    found = checks.constraint_violations(
        frame, "t", "k INT NOT NULL, s VARCHAR(3) NOT NULL", key=["k"]
    )
    assert {(r.rule, r.violations) for r in found.collect()} == {
        ("NOT NULL k", 2),
        ("NOT NULL s", 1),
        ("VARCHAR(3) s", 1),
        ("PRIMARY KEY k", 3),
    }
    empty = checks.constraint_violations(frame.limit(0), "t", "k INT NOT NULL", key=["k"])
    assert {r.violations for r in empty.collect()} == {0}


def test_data_dictionary(spark):
    frame = spark.createDataFrame([(1, "a"), (1, None), (2, "a"), (None, None)], "k INT, s STRING")
    found = checks.data_dictionary(frame, "t", "k INT COMMENT 'key', s VARCHAR(9)")
    assert {tuple(r) for r in found.collect()} == {
        ("t", "k", "int", "key", 4, 1, 2),
        ("t", "s", "varchar(9)", None, 4, 2, 1),
    }
    empty = checks.data_dictionary(frame.limit(0), "t", "k INT").first()
    assert tuple(empty)[4:] == (0, 0, 0)


def test_copy_differences(spark):
    machines = factory_frames(spark)["postgres.machines"]
    copy = (
        machines.where("machine_id <> 3")
        .withColumn("status", F.when(F.col("machine_id") == 5, None).otherwise(F.col("status")))
        .withColumn(
            "factory", F.when(F.col("machine_id").isin(5, 6), "D").otherwise(F.col("factory"))
        )
        .unionByName(machines.where("machine_id = 1").withColumn("machine_id", F.lit(11)))
    )
    columns = ["machine_name", "factory", "status"]
    found = combine.copy_differences(machines, copy, "machine_id", columns)
    assert {tuple(r) for r in found.collect()} == {
        (3, "only_left", None),
        (5, "values", "factory,status"),
        (6, "values", "factory"),
        (11, "only_right", None),
    }
    assert combine.copy_differences(machines, machines, "machine_id", columns).count() == 0
    twice = machines.unionByName(machines.where("machine_id IN (2, 3)"))
    again = combine.copy_differences(twice, machines, "machine_id", columns)
    assert {tuple(r) for r in again.collect()} == {(2, "repeated", None), (3, "repeated", None)}


def test_union_keeps_provenance(spark):
    a = spark.createDataFrame([(1, "x", 0)], "k INT, s STRING, extra INT")
    b = spark.createDataFrame([("y", 2), ("x", 1)], "s STRING, k INT")
    union = combine.union_with_source({"a": a, "b": b}, ["k", "s"])
    assert {tuple(r) for r in union.collect()} == {("a", 1, "x"), ("b", 2, "y"), ("b", 1, "x")}


def test_inspection_sources_split_the_orders(spark):
    orders = star_model.star_table(spark, "/root/testdata/sf0.001", "orders")
    early, late = (star_model.inspections(orders, early=e) for e in (True, False))
    assert early.count() + late.count() == orders.count()
    assert early.count() > 0 and late.count() > 0
