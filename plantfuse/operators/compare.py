"""Comparing two copies of a table by hashes of key ranges.

Each copy is reduced to one digest for each range of its keys' hashes. Digests
add up: that of a range is the sum of those of its rows, in any order, so a
level of the tree is a sum over the level below. Where both copies have the same
digest nothing more is read of the range; ranges that differ are cut finer, and
only rows of the last ranges that differ are brought together.

Ranges are of hashes and not of the keys themselves, so they are of even size
for keys of any type and spread. Digests can be stored beside a copy: two sites
then compare tables by some thousand rows and send rows of what differs alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantfuse.operators.combine import copy_differences

#: Bits by which each level cuts the ranges of the level above, and how many
#: levels there are at most.
BITS, LEVELS = 14, 3

#: What a digest adds up.
NUMBERS = ("row_count", "low", "middle", "high")

#: Rows in differing ranges that are compared without a further level.
FEW_ROWS = 1_000_000


def range_of(key: Column, level: int) -> Column:
    """The range of a key: its hash's first bits, so many for each level."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - BITS * level)


def _row_hash(columns: Sequence[str]) -> Column:
    """A hash of values in which NULLs count; Spark's own hash passes over them."""
    present = [F.col(f"`{c}`").isNotNull() for c in columns]
    return F.xxhash64(*present, *[F.col(f"`{c}`") for c in columns])


def range_digests(frame: DataFrame, key: str, columns: Sequence[str], level: int = 1) -> DataFrame:
    """(range, row_count, low, middle, high): a range's rows, and the sums of their hashes.

    Three parts of a hash are summed apart, so that 2^41 rows of a range fit. A
    repeated row counts as often as it is there, which an exclusive or of
    hashes would not see.
    """
    hashed = frame.select(
        range_of(F.col(f"`{key}`"), level).alias("range"), _row_hash([key, *columns]).alias("hash")
    )
    part = F.lit(2**22 - 1)
    return hashed.groupBy("range").agg(
        F.count("*").alias("row_count"),
        F.sum(F.col("hash").bitwiseAND(part)).alias("low"),
        F.sum(F.shiftrightunsigned("hash", 22).bitwiseAND(part)).alias("middle"),
        F.sum(F.shiftrightunsigned("hash", 44)).alias("high"),
    )


def coarser(digests: DataFrame, levels: int = 1) -> DataFrame:
    """Digests of the level above, from those of a level."""
    above = F.shiftrightunsigned("range", BITS * levels).alias("range")
    return digests.groupBy(above).agg(*[F.sum(n).alias(n) for n in NUMBERS])


def differing_ranges(left: DataFrame, right: DataFrame) -> DataFrame:
    """(range, row_count): ranges whose digests differ, and their rows in both copies."""
    sides = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(-1)))
    return (
        sides.groupBy("range")
        .agg(
            F.sum("row_count").alias("both"),
            *[F.sum(F.col(n) * F.col("_side")).alias(n) for n in NUMBERS],
        )
        .where(" OR ".join(f"{n} <> 0" for n in NUMBERS))
        .select("range", F.col("both").alias("row_count"))
    )


def rows_of_ranges(frame: DataFrame, key: str, ranges: DataFrame, level: int) -> DataFrame:
    """The rows whose key lies in one of the ranges.

    There are as many ranges as a level has at most; Spark sends them to the
    rows if they are few enough, and the rows of other ranges go no further.
    """
    found = ranges.select(F.col("range").alias("_range"))
    return frame.join(found, range_of(frame[f"`{key}`"], level) == F.col("_range"), "left_semi")


def differing_rows(
    left: DataFrame,
    right: DataFrame,
    key: str,
    columns: Sequence[str],
    few_rows: int = FEW_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The rows of both copies in ranges that differ, after as many levels as it takes.

    A level is worth another reading of the copies while it leaves out most
    ranges: copies that differ all over are compared at once.
    """
    copies = [frame.select(key, *columns) for frame in (left, right)]
    for level in range(1, LEVELS + 1):
        found = differing_ranges(*[range_digests(c, key, columns, level) for c in copies])
        found = found.checkpoint()
        ranges, rows = found.agg(F.count("*"), F.coalesce(F.sum("row_count"), F.lit(0))).first()
        copies = [rows_of_ranges(c, key, found, level) for c in copies]
        if rows <= few_rows or ranges > 2 ** (BITS * level) // 4:
            break
    return copies[0], copies[1]


def differences_by_range(
    left: DataFrame,
    right: DataFrame,
    key: str,
    columns: Sequence[str],
    few_rows: int = FEW_ROWS,
) -> DataFrame:
    """As ``copy_differences``, with only the rows of ranges that differ brought together.

    Copies of a range that differ have equal digests once in some 2^64 ranges.
    """
    return copy_differences(*differing_rows(left, right, key, columns, few_rows), key, columns)
