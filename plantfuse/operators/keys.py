"""Generated keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

# Fixed value: monotonically_increasing_id() keeps the row number in its low 33
# bits and the partition number above them.
ROW_BITS = 33


def with_generated_key(
    frame: DataFrame,
    name: str,
    order: Sequence[str],
    path: str,
    start: int = 1,
    seen: Observation | None = None,
) -> DataFrame:
    """Numbers the rows from ``start`` without gaps, in the order of the given columns.

    The order must be total. Rows are range-partitioned by it, which also
    splits a frequent first column by the next, and numbered within their
    partition. That stage is written to ``path``: range bounds come from a
    sample, so only a written table gives the same partitions to both steps,
    and a lost executor cannot change them. Each partition's offset is then a
    running sum over one row per partition, which is also what is broadcast.

    ``seen`` counts the rows as ``n`` where they are written: before, the
    sample for the bounds would count some of them twice.
    """
    spark = frame.sparkSession
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    if seen is not None:
        ranged = ranged.observe(seen, F.count("*").alias("n"))
    ranged.withColumn("_position", F.monotonically_increasing_id()).write.mode(
        "overwrite"
    ).parquet(path)
    numbered = (
        spark.read.parquet(path)
        .withColumn("_part", F.shiftright("_position", ROW_BITS))
        .withColumn("_row", F.col("_position").bitwiseAND((1 << ROW_BITS) - 1))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_part")
        .agg(F.count("*").alias("n"))
        .select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    )
    return numbered.join(F.broadcast(offsets), "_part").select(
        (F.col("_offset") + F.col("_row") + start).alias(name), *frame.columns
    )
