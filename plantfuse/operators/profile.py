"""Column profiles that can be added to, load by load.

A profile is one row for each column: counts, a sketch of the different values
and, for numbers, one of their spread. It is some kilobytes a column, whatever
the number of rows, so it is stored with each load. Profiles of several loads
are merged without their rows being read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hashes that a sketch of different values keeps, as a power of two: an error of
#: 1.6 %. It keeps the least ones, so that merged sketches keep what one would.
DISTINCT_BITS = 12

#: Accuracy of a sketch of a spread: an error of some 0.7 % of the rows.
SPREAD_SIZE = 400


def column_profile(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, row_count, null_count, distinct, spread) of each column, in one scan.

    ``spread`` is NULL for columns that are not numbers. NaN is no part of it.
    """
    rows = []
    for name in columns:
        kind, value = frame.schema[name].dataType, F.col(f"`{name}`")
        spread: Column = F.lit(None).cast("binary")
        if isinstance(kind, T.NumericType):
            number = value.cast("double")
            spread = F.kll_sketch_agg_double(F.when(~F.isnan(number), number), F.lit(SPREAD_SIZE))
        # Other types by their text: a sketch takes whole numbers and strings.
        whole = isinstance(kind, (T.IntegerType, T.LongType, T.StringType))
        sketched = value if whole else value.cast("string")
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count("*").alias("row_count"),
                F.count_if(value.isNull()).alias("null_count"),
                F.theta_sketch_agg(sketched, DISTINCT_BITS).alias("distinct"),
                spread.alias("spread"),
            )
        )
    return frame.agg(F.array(*rows).alias("of")).select(F.inline("of"))


def merged(*profiles: DataFrame) -> DataFrame:
    """One profile of the rows of all.

    Counts of different values are those of one profile of all rows, merged
    too. Quantiles have the same error but are not the same: their sketch draws
    at random.
    """
    every = profiles[0]
    for profile in profiles[1:]:
        every = every.unionByName(profile)
    return every.groupBy("column_name").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("null_count").alias("null_count"),
        F.theta_union_agg("distinct", DISTINCT_BITS).alias("distinct"),
        F.kll_merge_agg_double("spread").alias("spread"),
    )


def estimates(profile: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column_name, row_count, null_count, distinct_count, quantiles): what a profile says."""
    wanted = F.array(*[F.lit(float(q)) for q in quantiles])
    has_numbers = F.coalesce(F.kll_sketch_get_n_double("spread"), F.lit(0)) > 0
    return profile.select(
        "column_name",
        "row_count",
        "null_count",
        F.theta_sketch_estimate("distinct").alias("distinct_count"),
        F.when(has_numbers, F.kll_sketch_get_quantile_double("spread", wanted)).alias("quantiles"),
    )
