"""Totals before joining against the joins they stand for."""

import random

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plantfuse.functions import flag, rounded_sum
from plantfuse.operators.totals import (
    Fact,
    distinct_ids,
    joined_totals,
    one,
    totals_by_key,
    with_totals,
)

LEFT = "k INT, id INT, state STRING"
RIGHT = "k BIGINT, amount DECIMAL(8,2)"

LITERAL = """
    SELECT d.k, COUNT(l.id) AS ids, COUNT(CASE WHEN l.state = 'open' THEN 1 END) AS open_ids,
           SUM(r.amount) AS amount, COUNT(DISTINCT l.id) AS distinct_ids
    FROM {d} d LEFT JOIN {l} l ON d.k = l.k LEFT JOIN {r} r ON d.k = r.k GROUP BY d.k
"""


def by_key(frame):
    return {r.k: r for r in frame.collect()}


def check(spark, keys, left, right):
    d = spark.createDataFrame([(k,) for k in keys], "k INT")
    l = spark.createDataFrame(left, LEFT)
    r = spark.createDataFrame(right, RIGHT)
    expected = by_key(spark.sql(LITERAL, d=d, l=l, r=r))
    amounts = Fact(r, "k", {"amount": F.col("amount")})
    ids = {"ids": flag(F.col("id").isNotNull()), "open_ids": flag(F.col("state") == "open")}
    plain = by_key(joined_totals(d, "k", Fact(l, "k", ids), amounts, counts=tuple(ids)))
    distinct = by_key(
        joined_totals(
            d,
            "k",
            Fact(distinct_ids(l, "k", "id"), "k", {"distinct_ids": flag(F.col("id").isNotNull())}),
            amounts,
            counts=("distinct_ids",),
            per_entity=("distinct_ids",),
            left_rows=F.col("id_rows"),
        )
    )
    assert set(plain) == set(expected) == set(distinct)
    for k, e in expected.items():
        assert (plain[k].ids, plain[k].open_ids, plain[k].amount) == (e.ids, e.open_ids, e.amount)
        assert (distinct[k].distinct_ids, distinct[k].amount) == (e.distinct_ids, e.amount)


keys = st.one_of(st.none(), st.integers(0, 5))
amounts = st.one_of(st.none(), st.decimals(-1000, 1000, places=2))


@settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    left=st.lists(
        st.tuples(
            keys, st.one_of(st.none(), st.integers(0, 4)), st.sampled_from(["open", "done", None])
        ),
        max_size=15,
    ),
    right=st.lists(st.tuples(keys, amounts), max_size=15),
)
def test_joined_totals_match_the_join(spark, left, right):
    check(spark, range(4), left, right)


def test_joined_totals_with_a_hot_key(spark):
    rng = random.Random(1)
    left = [(0 if i % 3 else rng.randint(0, 9), i, "open") for i in range(300)]
    right = [(0 if i % 3 else rng.randint(0, 9), None) for i in range(200)]
    check(spark, range(12), left, right)


def test_facts_with_the_same_measures_add_up(spark):
    a = spark.createDataFrame([(1, 2), (1, 3), (None, 9)], "k INT, n INT")
    b = spark.createDataFrame([(1, 5), (2, None)], "k BIGINT, n INT")
    facts = [Fact(f, "k", {"rows": one(), "n": F.col("n")}) for f in (a, b)]
    totals = totals_by_key("k", *facts)
    assert {tuple(r) for r in totals.collect()} == {(1, 3, 10), (2, 1, None), (None, 1, 9)}
    d = spark.createDataFrame([(1,), (2,), (3,)], "k INT")
    some = with_totals(d, "k", [totals], zero=("rows",))
    assert {tuple(r) for r in some.collect()} == {(1, 3, 10), (2, 1, None), (3, 0, None)}


def test_keys_may_be_text(spark):
    d = spark.createDataFrame([("a",), ("b",)], "k STRING")
    fact = Fact(spark.createDataFrame([("a",), ("a",)], "k STRING"), "k", {"n": one()})
    joined = with_totals(d, "k", [totals_by_key("k", fact)])
    assert {tuple(r) for r in joined.collect()} == {("a", 2), ("b", 0)}


@pytest.mark.parametrize("partitions", [1, 5, 8])
def test_sums_are_rounded_when_complete(spark, partitions):
    def total(values, places=4):
        frame = spark.createDataFrame([(v,) for v in values], "v DOUBLE").repartition(partitions)
        return frame.agg(rounded_sum(F.col("v"), places).alias("s")).first().s

    assert total([0.00004] * 10) == 0.0004
    assert total([1e15, 1.0, 2e14] * 3) == 3.6e15 + 3
    assert total([12.34, 5.67, 1234.5678, None] * 700) == round(700 * 1252.5778, 4)
    assert math.isnan(total([1.0, math.nan])) and total([1.0, math.inf]) == math.inf
    assert total([None]) is None and total([]) is None
    assert total([0.125] * 9, 2) == 1.13


def test_a_null_key_is_a_group_of_its_own(spark):
    rows = [(1, 2), (None, 3), (None, 4), (1, None)]
    fact = Fact(spark.createDataFrame(rows, "k INT, v INT"), "k", {"n": one(), "s": F.col("v")})
    totals = totals_by_key("k", fact)
    assert {tuple(r) for r in totals.collect()} == {(1, 2, 2), (None, 2, 7)}
    machines = spark.createDataFrame([(1,), (2,), (None,)], "k INT")
    joined = with_totals(machines, "k", [totals])
    assert sorted(map(tuple, joined.collect()), key=str) == [(1, 2, 2), (2, 0, 0), (None, 0, 0)]
