"""What the plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plantfuse.operators import load
from plantfuse.plans.star_queries import star_queries

SF_DIR = "/root/testdata/sf0.001"

# Queries whose work is in a write; their plans are those of the read-back.
WRITES = {
    "sink_parquet_overwrite",
    "sink_external_table",
    "sink_append",
    "reload_full",
    "insert_if_absent",
    "surrogate_key",
    "summary_table",
    "operations_table",
    "stored_questions",
    "load_and_check",
}


@pytest.fixture(scope="module")
def shuffled(spark):
    """The plans with no join side small enough to broadcast unasked."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda name: plan(spark, name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(spark, name):
    frame = entry.queries()[name](spark, SF_DIR)
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(star_queries()) - WRITES))
def test_no_cross_joins_and_no_python(shuffled, name):
    text = shuffled(name)
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert unwanted not in text


def exchanges(text):
    return len(re.findall(r"Exchange (hash|range)partitioning", text))


@pytest.mark.parametrize(
    "name, expected",
    [
        # one for the machines, one for each fact; the second for early and late
        # inspections together
        ("machine_health_summary", 4),
        ("fallback_source", 4),
        # ten sides, one more each for the lines and orders behind the energy
        # records, one for the final order
        ("factory_operations_union", 13),
        ("fanout_maintenance", 4),
        ("group_count", 1),
        ("union_all_quality", 1),
        ("master_diff", 1),
        ("scan_parquet", 0),
        ("classify_bands", 0),
        ("apply_defaults", 0),
        ("secured_view", 0),
        ("generate_plans", 0),
        ("generate_inspections", 0),
    ],
)
def test_each_table_is_shuffled_once(shuffled, name, expected):
    assert exchanges(shuffled(name)) == expected


# Queries with a hint, each behind a bound: one offset for each task of the
# generator of keys, ``bands.FEW_BOUNDS`` bounds, three medians.
HINTED = {"surrogate_key", "load_and_check", "bands_by_table", "column_profile"}


def test_nothing_is_broadcast_unless_small(shuffled):
    for name in sorted(set(star_queries()) - HINTED):
        assert "Broadcast" not in shuffled(name), name


def test_key_offsets_are_broadcast(shuffled):
    assert "BroadcastHashJoin" in shuffled("surrogate_key")


def test_inserting_shuffles_each_side_once(spark, shuffled):
    rows = spark.range(10).select((F.col("id") % 3).alias("k"), "id")
    new = load.rows_to_insert(rows, spark.range(2).toDF("k"), ["k"], [F.col("id")])
    # Apart from the words of the filter of keys, which is a subquery.
    text = new._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(k#", text)) == 2
    assert [tuple(r) for r in new.collect()] == [(2, 2)]


def test_filters_and_columns_reach_the_files(spark):
    text = plan(spark, "secured_view")
    assert "GreaterThanOrEqual(c_acctbal,0.0)" in text
    assert "EqualTo(c_nationkey,7)" in plan(spark, "q_filter_factory")
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in plan(
        spark, "param_identifier"
    )
    assert "ReadSchema: struct<user_id:bigint>" in plan(spark, "factory_operations_union")
    assert "ReadSchema: struct<>" in plan(spark, "row_count_reconcile")


def ran(spark, name):
    """The physical plans of all statements that a query ran to write its tables."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    entry.queries()[name](spark, SF_DIR).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    listed = store.executionsList(int(before), 1000)
    return [listed.apply(n).physicalPlanDescription() for n in range(listed.size())]


@pytest.mark.parametrize("name", sorted(WRITES))
def test_what_is_written_has_no_cross_join_and_no_python(spark, name):
    plans = ran(spark, name)
    assert any("InsertIntoHadoopFsRelation" in text for text in plans)
    for text in plans:
        for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "Pandas"):
            assert unwanted not in text


def test_one_factory_moves_only_its_machines(spark, shuffled):
    text = shuffled("q_filter_factory")
    # Each fact loses other machines' rows before its totals.
    assert len(re.findall(r"LeftSemi", text)) >= 9
    assert text.index("LeftSemi") > text.index("HashAggregate")


def test_constraints_take_one_scan_of_each_table(spark):
    assert plan(spark, "constraint_check").count("FileScan") == 4


def test_top_machine_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, "q_top_anomaly")
