"""Unions that keep provenance, and comparison of two copies of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantfuse.functions import flag


def union_with_source(
    tables: Mapping[str, DataFrame], columns: Sequence[str], source: str = "source"
) -> DataFrame:
    """``UNION ALL`` of the given columns, each row tagged with where it came from."""
    tagged = [t.select(F.lit(name).alias(source), *columns) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, tagged)


def with_file_source(
    frame: DataFrame, file: str = "source_file", written: str = "source_time"
) -> DataFrame:
    """Rows of a scan of files with the file each one was read from, and when it was written.

    Spark knows both of every file it reads; nothing is stored beside the rows.
    """
    return frame.select(
        "*",
        F.col("_metadata.file_path").alias(file),
        F.col("_metadata.file_modification_time").alias(written),
    )


def copy_differences(
    left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """Keys on which two copies of a table disagree, and how.

    ``difference`` is only_left, only_right, repeated (a copy holds the key more
    than once) or values; ``changed`` then lists the columns whose values
    differ, NULL counting as a value. Both copies are stacked and grouped in one
    shuffle: joined, a key that is repeated in both would give all its pairs.
    """
    stacked = union_with_source({"left": left, "right": right}, [key, *columns], "_copy")
    copies = {c: F.col("_copy") == c for c in ("left", "right")}
    values = [
        F.max(F.when(here, F.col(c))).alias(f"_{copy}_{c}")
        for copy, here in copies.items()
        for c in columns
    ]
    rows = [F.sum(flag(here)).alias(f"_{copy}") for copy, here in copies.items()]
    per_key = stacked.groupBy(key).agg(*rows, *values)
    differs = {c: ~F.col(f"_left_{c}").eqNullSafe(F.col(f"_right_{c}")) for c in columns}
    difference = (
        F.when(F.col("_right") == 0, "only_left")
        .when(F.col("_left") == 0, "only_right")
        .when(F.greatest("_left", "_right") > 1, "repeated")
        .when(reduce(lambda a, b: a | b, differs.values()), "values")
    )
    changed = F.concat_ws(",", *[F.when(d, F.lit(c)) for c, d in differs.items()])
    return per_key.select(
        key,
        difference.alias("difference"),
        F.when(difference == "values", changed).alias("changed"),
    ).where(F.col("difference").isNotNull())
