"""Totals per entity from any number of fact tables.

Each fact is aggregated before anything is joined. Map-side partial aggregation
leaves at most one row per key and task, whatever share of the rows one key
holds, and the joins then meet one row per key. All sides are partitioned by
the same key, so joining them shuffles no fact a second time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantfuse.functions import exact_sum, zero_if_null


@dataclass(frozen=True)
class Fact:
    """What each row of a table adds to the measures of its entity.

    A count adds 1, a conditional count 0 or 1, a sum its amount.
    """

    frame: DataFrame
    key: str
    adds: Mapping[str, Column]


def one() -> Column:
    return F.lit(1).cast("long")


def wide_key(frame: DataFrame, key: str) -> Column:
    """The key, whole numbers as BIGINT: sources declare the same key INT or BIGINT."""
    whole = isinstance(frame.schema[key].dataType, T.IntegralType)
    return F.col(key).cast("long") if whole else F.col(key)


def totals_by_key(key: str, *facts: Fact) -> DataFrame:
    """One row per key, NULL one of them. Several facts with the same measures count as
    their ``UNION ALL``.

    The key is widened before grouping: a cast at the join instead would need
    the totals shuffled again. Sums of floating amounts have the same bits
    whatever the order of tasks.
    """
    rows = reduce(
        DataFrame.unionByName,
        [
            f.frame.select(
                wide_key(f.frame, f.key).alias(key),
                *[added.alias(measure) for measure, added in f.adds.items()],
            )
            for f in facts
        ],
    )
    floating = {f.name for f in rows.schema if isinstance(f.dataType, T.FractionalType)} - {
        f.name for f in rows.schema if isinstance(f.dataType, T.DecimalType)
    }
    return rows.groupBy(key).agg(
        *[(exact_sum(F.col(m)) if m in floating else F.sum(m)).alias(m) for m in facts[0].adds]
    )


def with_totals(
    dimension: DataFrame, key: str, totals: Sequence[DataFrame], zero: Sequence[str] | None = None
) -> DataFrame:
    """Every dimension row with its totals; measures in ``zero`` (or all) read 0 where absent.

    The dimension holds one row per entity, which ``constraint_violations`` can check.
    Rows without a key are nobody's; Spark leaves them out below the totals.
    No broadcast hint: all sides grow with the data, so the choice is left to
    Spark, which knows their sizes.
    """
    wide = dimension.withColumn("_key", wide_key(dimension, key))
    measures = []
    for t in totals:
        keyed = t.withColumnRenamed(key, "_total_key")
        wide = wide.join(keyed, F.col("_key") == F.col("_total_key"), "left").drop("_total_key")
        measures += [m for m in t.columns if m != key]
    return wide.select(
        *dimension.columns,
        *[
            (zero_if_null(F.col(m)) if zero is None or m in zero else F.col(m)).alias(m)
            for m in measures
        ],
    )


def distinct_ids(frame: DataFrame, key: str, id_column: str, rows: str = "id_rows") -> DataFrame:
    """One row per (key, id) with its row count.

    Grouping by both columns spreads the ids of a hot key over all tasks.
    """
    return frame.groupBy(key, id_column).agg(F.count("*").alias(rows))


LEFT_ROWS, RIGHT_ROWS = "_left_rows", "_right_rows"


def joined_totals(
    dimension: DataFrame,
    key: str,
    left: Fact,
    right: Fact,
    counts: Sequence[str],
    per_entity: Sequence[str] = (),
    left_rows: Column | None = None,
) -> DataFrame:
    """Aggregates over ``dimension LEFT JOIN left LEFT JOIN right``, without the pairs.

    Joining two facts on the entity repeats each row of one for every row of
    the other. Per entity with n rows on one side, a sum over the other side is
    therefore its plain total times max(n, 1), so both are totalled first and
    multiplied. Measures in ``counts`` read 0 where there are no rows, others
    NULL, as COUNT and SUM do; those in ``per_entity`` (distinct counts) are
    not repeated by the join. ``left_rows`` says how many rows of the left fact
    one row of its frame stands for.
    """
    rows = one() if left_rows is None else left_rows
    sides = [
        Fact(left.frame, left.key, {**left.adds, LEFT_ROWS: rows}),
        Fact(right.frame, right.key, {**right.adds, RIGHT_ROWS: one()}),
    ]
    totals = [totals_by_key(key, side) for side in sides]
    joined = with_totals(dimension, key, totals, zero=(LEFT_ROWS, RIGHT_ROWS))
    repeats = {m: RIGHT_ROWS for m in left.adds} | {m: LEFT_ROWS for m in right.adds}

    def measure(name: str) -> Column:
        value = F.col(name)
        if name not in per_entity:
            value = value * F.greatest(F.col(repeats[name]), one())
        return (zero_if_null(value) if name in counts else value).alias(name)

    return joined.select(*dimension.columns, *[measure(m) for m in repeats])
