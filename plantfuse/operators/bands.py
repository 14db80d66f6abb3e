"""Values graded by bands that a table holds.

A band begins at its bound and ends before the next of its kind. Each kind's
bounds are one sorted array, in which a value is searched by halving. While the
bounds are few their arrays are sent to all tasks. Many bounds are cut into
chunks: first bounds of chunks are sent, a value finds its chunk in them, and
joins the chunk's own bounds by kind and chunk. So a kind with a third of all
values is spread over its chunks, and what is sent is a hundredth of the bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantfuse.session import removed_at_exit, shared_path

#: Bounds that are sent to all tasks at most, and bounds of a chunk beyond that.
FEW_BOUNDS, CHUNK = 100_000, 256


def last_not_above(bounds: Column, value: Column, most: int) -> Column:
    """Place of the last bound not above a value, from 1; 0 if all are above.

    ``bounds`` is in order and holds ``most`` at most. Every step of the search
    halves what is left.
    """
    steps = F.array(*[F.lit(1 << n) for n in reversed(range(max(1, most).bit_length()))])
    return F.reduce(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) <= value), at + step
        ).otherwise(at),
    )


def _arrays(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: the bounds in order, and their labels in the same order."""
    ordered = F.array_sort(F.collect_list(F.struct("bound", "label")))
    return bands.groupBy(*keys).agg(ordered.alias("of")).select(
        *keys, F.col("of.bound").alias("bounds"), F.col("of.label").alias("labels")
    )


def graded(
    values: DataFrame,
    kind: str,
    value: str,
    bands: DataFrame,
    result: str = "band",
    few_bounds: int = FEW_BOUNDS,
) -> DataFrame:
    """Every row with the label of the band its value falls in.

    ``bands`` has ``kind``, ``bound`` and ``label``; bands with a NULL are none,
    and of two with one bound the greater label counts. NULL below all bounds
    of a kind, for a kind without bands and for a NULL value.
    """
    bands = (
        bands.select("kind", "bound", "label")
        .dropna()
        .groupBy("kind", "bound")
        .agg(F.max("label").alias("label"))
    )
    spark = bands.sparkSession
    path = removed_at_exit(spark, shared_path(spark, "bands"))
    bands.write.parquet(path)
    bands = spark.read.schema(bands.schema).parquet(path)
    most = bands.groupBy("kind").count().agg(F.sum("count"), F.max("count")).first()
    number, longest = (most[0] or 0), (most[1] or 0)
    columns = [values[f"`{c}`"] for c in values.columns]
    of_kind, of_value = values[f"`{kind}`"], values[f"`{value}`"]
    if number <= few_bounds:
        held = F.broadcast(_arrays(bands, ["kind"]).withColumnRenamed("kind", "_kind"))
        joined = values.join(held, of_kind == F.col("_kind"), "left")
        at = last_not_above(F.col("bounds"), of_value, longest)
        return joined.select(*columns, F.get("labels", at - 1).alias(result))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("bound")) - 1
    cut = bands.withColumn("chunk", F.floor(place / CHUNK).cast("int"))
    firsts = cut.groupBy("kind", "chunk").agg(F.min("bound").alias("bound"))
    firsts = firsts.groupBy(F.col("kind").alias("_kind")).agg(
        F.array_sort(F.collect_list("bound")).alias("_firsts")
    )
    chunks = _arrays(cut, ["kind", "chunk"]).select(
        F.col("kind").alias("_of_kind"), F.col("chunk").alias("_of_chunk"), "bounds", "labels"
    )
    # A hundredth of the bounds; above Spark's own limit it sorts and merges.
    found = values.join(firsts, of_kind == F.col("_kind"), "left")
    chunk = last_not_above(F.col("_firsts"), of_value, -(-longest // CHUNK)) - 1
    found = found.withColumn("_chunk", chunk)
    joined = found.join(
        chunks,
        (of_kind == F.col("_of_kind")) & (F.col("_chunk") == F.col("_of_chunk")),
        "left",
    )
    at = last_not_above(F.col("bounds"), of_value, CHUNK)
    return joined.select(*columns, F.get("labels", at - 1).alias(result))
