"""Row-count reconciliation, constraint violations and column profiles."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantfuse.functions import flag

VIOLATIONS = "table_name STRING, rule STRING, violations BIGINT"
COUNTED = "table_name STRING, actual_rows BIGINT, failure STRING, message STRING"


def table_counts(spark: SparkSession, loaders: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """Rows of each table, all counted in one job.

    A table that cannot be resolved gets a FAIL row, any other trouble in
    loading it an ERROR row, each with its message. A table that resolves but
    cannot be read fails the job; ``table_counts_one_by_one`` reports it instead.
    """
    counted, failed = [], []
    for name, load in loaders.items():
        try:
            counted.append(
                load()
                .agg(F.count("*").alias("actual_rows"))
                .select(
                    F.lit(name).alias("table_name"),
                    "actual_rows",
                    F.lit(None).cast("string").alias("failure"),
                    F.lit(None).cast("string").alias("message"),
                )
            )
        except Exception as error:
            failed.append(_failed_count(name, error))
    if failed:
        counted.append(spark.createDataFrame(failed, COUNTED))
    return reduce(DataFrame.unionByName, counted)


def table_counts_one_by_one(
    spark: SparkSession, loaders: Mapping[str, Callable[[], DataFrame]]
) -> DataFrame:
    """As ``table_counts``, with a job for each table, so that each can fail alone.

    Spark counts; only the one number of each table comes back.
    """
    rows = []
    for name, load in loaders.items():
        try:
            rows.append((name, load().count(), None, None))
        except Exception as error:
            rows.append(_failed_count(name, error))
    return spark.createDataFrame(rows, COUNTED)


def _failed_count(name: str, error: Exception) -> tuple:
    unresolved = isinstance(error, AnalysisException) or isinstance(
        error.__cause__, AnalysisException
    )
    outcome = "FAIL" if unresolved else "ERROR"
    return name, None, outcome, str(error)


def reconcile(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """PASS, MISMATCH, FAIL or ERROR for each (table_name, expected_rows)."""
    return expected.join(counts, "table_name", "left").select(
        "table_name",
        "expected_rows",
        "actual_rows",
        F.when(F.col("failure").isNotNull(), F.col("failure"))
        .when(F.col("actual_rows") == F.col("expected_rows"), "PASS")
        .otherwise("MISMATCH")
        .alias("status"),
        "message",
    )


def all_passed(reconciled: DataFrame) -> DataFrame:
    return reconciled.agg(F.every(F.col("status") == "PASS").alias("all_passed"))


def declared_columns(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def constraint_violations(
    frame: DataFrame, table: str, ddl: str, key: Sequence[str] = ()
) -> DataFrame:
    """Violations of the declared key, NOT NULL and VARCHAR(n), one row for each.

    One scan: the NULL and length counts go along with the groups that count
    rows beyond the first of each key. Repeated keys are combined before the
    shuffle, so a hot one costs a row per task.
    """
    declared = T.StructType.fromDDL(ddl)
    per_row = [
        (f"NOT NULL {f.name}", F.col(f.name).isNull()) for f in declared if not f.nullable
    ] + [
        (f"VARCHAR({f.dataType.length}) {f.name}", F.length(f.name) > f.dataType.length)
        for f in declared
        if isinstance(f.dataType, T.VarcharType)
    ]
    names = [f"c{i}" for i in range(len(per_row))]
    rules = [label for label, _ in per_row]
    if not rules and not key:
        return frame.sparkSession.createDataFrame([], VIOLATIONS)
    grouped = frame.groupBy(*key) if key else frame.groupBy()
    counted = grouped.agg(
        F.count("*").alias("n"), *[F.sum(flag(p)).alias(n) for n, (_, p) in zip(names, per_row)]
    )
    if key:
        rules.append("PRIMARY KEY " + ",".join(key))
        names.append("repeated")
        counted = counted.withColumn("repeated", F.col("n") - 1).agg(
            *[F.sum(n).alias(n) for n in names]
        )
    found = [
        F.struct(F.lit(rule).alias("rule"), F.coalesce(n, F.lit(0)).alias("violations"))
        for n, rule in zip(names, rules)
    ]
    return counted.select(F.inline(F.array(*found))).select(
        F.lit(table).alias("table_name"), "rule", "violations"
    )


def data_dictionary(frame: DataFrame, table: str, ddl: str) -> DataFrame:
    """Type, comment, rows, NULLs and distinct values of each declared column.

    Each column is grouped on its own: its branch reads that column alone and
    shuffles its distinct values only, where one query for all columns would
    copy every row once per column.
    """
    branches = []
    for f in T.StructType.fromDDL(ddl):
        values = frame.groupBy(F.col(f.name).alias("v")).agg(F.count("*").alias("n"))
        branches.append(
            values.agg(
                F.sum("n").alias("row_count"),
                F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
                F.count("v").alias("distinct_count"),
            ).select(
                F.lit(table).alias("table_name"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(f.metadata.get("comment")).alias("comment"),
                *[
                    F.coalesce(c, F.lit(0)).alias(c)
                    for c in ("row_count", "null_count", "distinct_count")
                ],
            )
        )
    return reduce(DataFrame.unionByName, branches)
