"""Joins reduced by a filter of keys, and rows graded by bands of a table."""

import bisect

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plantfuse.operators import bands, key_filter, load

relaxed = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def test_a_filter_never_loses_a_partner_and_drops_most_others(spark):
    large = spark.range(100_000).withColumn("word", F.concat(F.lit("k"), "id"))
    small = large.where("id % 1000 = 7").select(F.col("id").alias("a"), F.col("word").alias("b"))
    passed = key_filter.with_partner(large, ["id", "word"], small, ["a", "b"])
    ids = {row.id for row in passed.select("id").collect()}
    assert set(range(7, 100_000, 1000)) <= ids
    assert len(ids) < 100 + 0.05 * 100_000
    text = passed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text.split("Subquery")[0]


@relaxed
@given(keys=st.sets(st.one_of(st.none(), st.integers(-50, 50)), max_size=20))
def test_exact_joins_after_the_filter(spark, keys):
    frame = spark.range(-50, 51).unionByName(spark.range(-5, 5))
    small = spark.createDataFrame([(k,) for k in keys], "k long")
    passed = key_filter.with_partner(frame, ["id"], small, ["k"])
    joined = passed.join(small, F.col("id") == F.col("k"), "left_semi")
    expected = [n for n in [*range(-50, 51), *range(-5, 5)] if n in keys]
    assert sorted(r.id for r in joined.collect()) == sorted(expected)


def test_a_full_filter_lets_all_pass(spark):
    frame = spark.range(20_000)
    passed = key_filter.with_partner(frame, ["id"], frame, ["id"], keys=1)
    assert passed.count() == 20_000


def test_insert_shuffles_only_rows_that_may_be_known(spark):
    target = spark.range(200_000).withColumnRenamed("id", "k")
    incoming = spark.range(199_900, 200_100).select(F.col("id").alias("k"), F.lit(1).alias("at"))
    new = load.rows_to_insert(incoming, target, ["k"], [F.col("at")])
    assert sorted(r.k for r in new.collect()) == list(range(200_000, 200_100))
    # Of the target little more than the hundred keys that are incoming.
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "shiftright" in plan and "Subquery" in plan


KINDS = {"a": [0.0, 1.5, 1.5, 9.0], "b": [5.0], "c": np.linspace(-3, 3, 700).tolist()}


@pytest.mark.parametrize("few_bounds", [bands.FEW_BOUNDS, 0])
def test_bands_are_found_as_by_bisection(spark, few_bounds):
    rows = [(k, b, f"{k}{n:04d}") for k, bounds in KINDS.items() for n, b in enumerate(bounds)]
    rows += [("a", None, "x"), (None, 1.0, "x"), ("b", 6.0, None)]
    table = spark.createDataFrame(rows, "kind STRING, bound DOUBLE, label STRING")
    values = [(k, v / 7) for k in ("a", "b", "c", "d", None) for v in range(-30, 80)]
    values += [("a", None), ("c", float("nan"))] + [("a", 1.5)] * 3
    frame = spark.createDataFrame(values, "kind STRING, bound DOUBLE")
    found = bands.graded(frame, "kind", "bound", table, few_bounds=few_bounds)
    assert found.columns == ["kind", "bound", "band"]

    def expected(kind, value):
        bounds = KINDS.get(kind)
        if bounds is None or value is None:
            return None
        at = len(bounds) if value != value else bisect.bisect_right(bounds, value)
        return f"{kind}{at - 1:04d}" if at else None

    # As text, since NaN is not equal to itself.
    got = sorted(str((r.kind, r.bound, r.band)) for r in found.collect())
    assert got == sorted(str((k, v, expected(k, v))) for k, v in values)


def test_no_bands_and_no_values(spark):
    table = spark.createDataFrame([], "kind STRING, bound DOUBLE, label STRING")
    frame = spark.createDataFrame([("a", 1.0)], "kind STRING, v DOUBLE")
    assert [tuple(r) for r in bands.graded(frame, "kind", "v", table).collect()] == [("a", 1.0, None)]
    assert bands.graded(frame.where("false"), "kind", "v", table).count() == 0
