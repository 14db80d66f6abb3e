"""Profiles of columns that are merged load by load."""

import pytest
from pyspark.sql import functions as F

from plantfuse.operators import load, profile
from plantfuse.session import shared_path

COLUMNS = ["n", "v", "s", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(60_000).select(
        (F.col("id") % 5000).alias("n"),
        F.when(F.col("id") % 10 > 0, F.col("id") * 0.5).alias("v"),
        F.concat(F.lit("s"), F.col("id") % 7).alias("s"),
        F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("d"),
        "id",
    )


def said(frame):
    return {row.column_name: row for row in profile.estimates(frame).collect()}


def test_two_loads_merged_are_one_load_of_both(spark, rows):
    batches = [rows.where(f"id % 3 {sign} 0") for sign in ("=", ">")]
    stored = []
    for batch in batches:
        path = shared_path(spark, "profile")
        stored.append(load.overwrite_files(profile.column_profile(batch, COLUMNS), path))
    parts = said(profile.merged(*stored))
    whole = said(profile.merged(profile.column_profile(rows, COLUMNS)))
    for name, exact in {"n": 5000, "v": 54_000, "s": 7, "d": 300}.items():
        assert parts[name].distinct_count == whole[name].distinct_count
        assert abs(whole[name].distinct_count / exact - 1) < 0.05
        assert parts[name].row_count == 60_000
    assert parts["v"].null_count == 6000 and parts["s"].null_count == 0
    for at, value in enumerate((7500, 15_000, 22_500)):
        assert abs(parts["v"].quantiles[at] - value) < 0.02 * 30_000
    assert parts["s"].quantiles is None and parts["d"].quantiles is None


def test_empty_and_null_columns(spark):
    frame = spark.createDataFrame([(None, None)] * 3, "n INT, s STRING")
    found = said(profile.merged(profile.column_profile(frame, ["n", "s"])))
    assert [tuple(found[c])[1:] for c in ("n", "s")] == [(3, 3, 0, None)] * 2
    found = said(profile.column_profile(frame.where("false"), ["n", "s"]))
    assert [tuple(found[c])[1:] for c in ("n", "s")] == [(0, 0, 0, None)] * 2


def test_one_scan(spark, rows):
    plan = profile.column_profile(rows, COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1
