"""Sums of floating amounts that do not depend on the order of tasks."""

import math
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plantfuse.functions import exact_sum
from plantfuse.operators.totals import Fact, totals_by_key

amounts = st.floats(width=64, allow_nan=False, allow_infinity=False, max_value=1e18, min_value=-1e18)


def total(spark, values, parts=3):
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(parts)
    return frame.agg(exact_sum(F.col("v"))).first()[0]


def bits(value):
    return struct.pack(">d", value)


def test_same_bits_over_any_partitioning(spark):
    # 400,000 amounts with a total of some 1e15.
    rows = spark.range(400_000).select(
        (F.xxhash64("id") % 1_000_000_007 * 5.37 + F.lit(0.01) * (F.col("id") % 97)).alias("v")
    )
    rows = rows.withColumn("v", F.abs("v"))
    found, plain = set(), set()
    for parts in (1, 3, 7, 16):
        shuffled = rows.repartition(parts, F.xxhash64("v"))
        row = shuffled.agg(exact_sum(F.col("v")), F.sum("v")).first()
        found.add(bits(row[0]))
        plain.add(bits(row[1]))
    assert len(found) == 1 and len(plain) > 1
    exact = math.fsum(row.v for row in rows.collect())
    assert exact > 1e14
    assert abs(struct.unpack(">d", found.pop())[0] - exact) <= math.ulp(exact)


@settings(
    max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(amounts, min_size=1, max_size=30))
def test_totals_are_those_of_exact_addition(spark, values):
    # Below 2^-77 an amount is rounded, each by half of that at most.
    exact = math.fsum(values)
    assert abs(total(spark, values) - exact) <= 2 * math.ulp(exact) + len(values) * 2.0**-77


@pytest.mark.parametrize(
    "values, expected",
    [
        ([0.1] * 10, 1.0),
        ([-0.1, 0.3, -0.2], math.fsum([-0.1, 0.3, -0.2])),
        ([1e15, 0.01, -1e15], 0.01),
        ([-1e18, 1e18, -3.5], -3.5),
        ([None, 2.5, None], 2.5),
        ([None, None], None),
        ([math.inf, 1.0], math.inf),
        ([math.inf, -math.inf, 1.0], math.nan),
        ([math.nan, 1.0], math.nan),
        ([1e300, 1e300, 1.0], 2e300),
        ([2.0**64, 2.0**63, 1.0], 2.0**64 + 2.0**63 + 1.0),
        ([0.0, -0.0], 0.0),
        ([5e-324, 1.0], 1.0),
    ],
)
def test_odd_amounts(spark, values, expected):
    found = total(spark, values)
    assert found == expected or (expected is not None and math.isnan(expected) and math.isnan(found))


def test_no_rows(spark):
    assert total(spark, [1.0]) == 1.0
    empty = spark.createDataFrame([], "v double")
    assert empty.agg(exact_sum(F.col("v"))).first()[0] is None
    assert empty.groupBy("v").agg(exact_sum(F.col("v"))).count() == 0


def test_totals_by_key_use_it_and_stay_in_generated_code(spark):
    frame = spark.range(1000).select(
        (F.col("id") % 3).alias("k"), (F.col("id") * 0.1).alias("v"), F.lit(1).alias("n")
    )
    found = totals_by_key("k", Fact(frame, "k", {"v": F.col("v"), "n": F.col("n")}))
    for row in found.collect():
        assert row.v == pytest.approx(math.fsum(i * 0.1 for i in range(row.k, 1000, 3)), abs=1e-12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
