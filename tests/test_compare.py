"""Copies compared by hashes of key ranges."""

import pytest
from pyspark.sql import functions as F

from plantfuse.operators import compare
from plantfuse.operators.combine import copy_differences


def copies(spark, rows=20_000):
    left = spark.range(rows).select("id", (F.col("id") % 7).alias("a"), F.lit("x").alias("b"))
    right = left.where("id <> 77").withColumn("a", F.when(F.col("id") != 500, F.col("a")))
    right = right.unionByName(left.where("id = 900"))
    return left, right.unionByName(left.where("id = 3").withColumn("id", F.lit(-3).cast("long")))


def as_rows(frame):
    return sorted(map(tuple, frame.collect()))


WANTED = [(-3, "only_right", None), (77, "only_left", None), (500, "values", "a"), (900, "repeated", None)]


@pytest.mark.parametrize("few_rows", [1_000_000, 100, 0])
def test_differences_are_those_of_a_whole_comparison(spark, few_rows):
    left, right = copies(spark)
    found = compare.differences_by_range(left, right, "id", ["a", "b"], few_rows)
    assert as_rows(found) == WANTED == as_rows(copy_differences(left, right, "id", ["a", "b"]))


def test_rows_of_equal_ranges_are_not_brought_together(spark):
    left, right = copies(spark, 200_000)
    # 2^14 ranges of 12 rows: the four that differ hold some 50 rows of each copy.
    for side in compare.differing_rows(left, right, "id", ["a", "b"]):
        assert 1 <= side.count() < 120
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # A second level leaves hardly more than the rows that differ.
    for side in compare.differing_rows(left, right, "id", ["a", "b"], few_rows=10):
        assert side.count() <= 5


def test_copies_that_differ_all_over_are_compared_at_once(spark):
    left = spark.range(50_000).withColumn("a", F.lit(1))
    right = left.withColumn("a", F.lit(2))
    assert compare.differences_by_range(left, right, "id", ["a"], 0).count() == 50_000


def test_digests_add_up_to_those_of_the_level_above(spark):
    left, _ = copies(spark)
    fine = compare.range_digests(left, "id", ["a", "b"], 2)
    assert as_rows(compare.coarser(fine)) == as_rows(compare.range_digests(left, "id", ["a", "b"]))
    assert compare.differing_ranges(fine, fine).count() == 0


def test_nulls_repeats_and_empty_copies(spark):
    ddl = "k STRING, a INT, b INT"
    left = spark.createDataFrame([("p", None, 1), (None, 1, 1), ("q", 2, 2), ("q", 2, 2)], ddl)
    right = spark.createDataFrame([("p", 1, None), (None, 1, 1), ("q", 2, 2)], ddl)
    found = compare.differences_by_range(left, right, "k", ["a", "b"])
    assert as_rows(found) == [("p", "values", "a,b"), ("q", "repeated", None)]
    empty = left.where("false")
    assert compare.differences_by_range(empty, empty, "k", ["a"]).count() == 0
    assert compare.differences_by_range(left, empty, "k", ["a"]).count() == 3
