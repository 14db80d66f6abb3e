"""Writing tables: overwrite, append, reload, insert-if-absent, defaults, comments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantfuse.operators.key_filter import with_partner
from plantfuse.session import shared_path
from plantfuse.sources.catalogs import qualified


def overwrite_files(
    frame: DataFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = ()
) -> DataFrame:
    """Replaces the files at a path and reads them back.

    The files follow the partitions of the frame: gathering them into one file
    would send the whole table through one task.
    """
    writer = frame.write.format(format).mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return frame.sparkSession.read.format(format).schema(frame.schema).load(path)


def create_schema(spark: SparkSession, schema: str, path: str | None = None) -> None:
    """A schema if there is none, its tables kept under the shared folder."""
    path = path or shared_path(spark, schema)
    name = qualified(None, "", schema)
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name} LOCATION {literal(path)}")


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def drop_schema(spark: SparkSession, schema: str) -> None:
    spark.sql(f"DROP SCHEMA IF EXISTS {qualified(None, '', schema)} CASCADE")


def create_table(
    spark: SparkSession,
    table: str,
    ddl: str,
    format: str = "parquet",
    location: str | None = None,
    comment: str = "",
    defaults: Mapping[str, object] | None = None,
    properties: Mapping[str, str] | None = None,
) -> None:
    """Creates a table from declared columns, with their comments and defaults.

    With a location it is external: the files stay when it is dropped.
    """
    defaults = defaults or {}
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}"
        + ("" if f.nullable else " NOT NULL")
        + (f" DEFAULT {literal(defaults[f.name])}" if f.name in defaults else "")
        + (f" COMMENT {literal(f.metadata['comment'])}" if "comment" in f.metadata else "")
        for f in T.StructType.fromDDL(ddl)
    )
    clauses = [f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING {format}"]
    if location:
        clauses.append(f"LOCATION {literal(location)}")
    if comment:
        clauses.append(f"COMMENT {literal(comment)}")
    if properties:
        pairs = ", ".join(f"{literal(k)} = {literal(v)}" for k, v in properties.items())
        clauses.append(f"TBLPROPERTIES ({pairs})")
    spark.sql(" ".join(clauses))


def save_summary(frame: DataFrame, table: str, format: str = "parquet") -> DataFrame:
    """Creates or replaces a table from a query and reads it back.

    Table formats replace it in one commit. Plain files cannot: readers may find
    the table missing until the write ends.
    """
    if format in ("delta", "iceberg"):
        frame.writeTo(table).using(format).createOrReplace()
    else:
        frame.write.format(format).mode("overwrite").saveAsTable(table)
    return frame.sparkSession.table(table)


def create_versioned_table(
    frame: DataFrame, table: str, format: str, properties: Mapping[str, str]
) -> DataFrame:
    """Creates a table in a catalog that takes table properties, such as Iceberg's."""
    writer = frame.writeTo(table).using(format)
    for name, value in properties.items():
        writer = writer.tableProperty(name, value)
    writer.create()
    return frame.sparkSession.table(table)


def append_rows(frame: DataFrame, table: str) -> DataFrame:
    """``INSERT INTO table (columns)``; columns left out take their defaults."""
    return _insert(frame, table, "INTO")


def reload_table(frame: DataFrame, table: str) -> DataFrame:
    """Replaces all rows of a table, keeping its definition. Repeating it changes nothing."""
    return _insert(frame, table, "OVERWRITE")


def _insert(frame: DataFrame, table: str, verb: str) -> DataFrame:
    columns = ", ".join(f"`{c}`" for c in frame.columns)
    frame.sparkSession.sql(
        f"INSERT {verb} {table} ({columns}) SELECT {columns} FROM {{rows}}", rows=frame
    )
    return frame.sparkSession.table(table)


def first_per_key(frame: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order.

    An aggregate, not a window: copies of a hot key are combined before the
    shuffle, so none of them gathers in one task.
    """
    rest = [c for c in frame.columns if c not in key]
    ranked = F.struct(
        F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"),
        F.struct(*rest).alias("r"),
    )
    first = frame.groupBy(*key).agg(F.min(ranked).alias("first"))
    return first.select(*key, *[F.col(f"first.r.{c}").alias(c) for c in rest]).select(
        *frame.columns
    )


def rows_to_insert(
    incoming: DataFrame, target: DataFrame, key: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """The incoming rows whose key the target lacks, the first of each key.

    A NULL in the key stops the job, as a primary key would. Both sides are
    reduced to one row per key before the join that leaves out the known ones.
    Of the target only keys that may be incoming are shuffled.
    """
    checked = incoming.withColumns({k: _required(k) for k in key})
    known = with_partner(target.select(*key), key, incoming, key).distinct()
    return first_per_key(checked, key, order).join(known, list(key), "left_anti")


def insert_if_absent(
    incoming: DataFrame, table: str, key: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """Inserts the rows whose key the table lacks. Repeating it changes nothing."""
    target = incoming.sparkSession.table(table)
    return append_rows(rows_to_insert(incoming, target, key, order), table)


def apply_defaults(frame: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Fills missing columns, and NULLs in present ones, with their defaults."""
    return frame.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value)) if name in frame.columns else F.lit(value)
            for name, value in defaults.items()
        }
    )


def not_null_checked(frame: DataFrame, ddl: str) -> DataFrame:
    """Stops the job at a NULL in a column declared NOT NULL, as a database would."""
    required = [f.name for f in T.StructType.fromDDL(ddl) if not f.nullable]
    return frame.withColumns({c: _required(c) for c in required if c in frame.columns})


def _required(column: str) -> Column:
    missing = F.raise_error(F.lit(f"NULL in column {column}"))
    return F.when(F.col(column).isNotNull(), F.col(column)).otherwise(missing)


def column_comments(spark: SparkSession, table: str) -> dict[str, str]:
    return {
        f.name: f.metadata["comment"] for f in spark.table(table).schema if "comment" in f.metadata
    }


def comment_table(spark: SparkSession, table: str, comment: str) -> None:
    spark.sql(f"COMMENT ON TABLE {table} IS {literal(comment)}")


def comment_columns(spark: SparkSession, table: str, comments: Mapping[str, str]) -> None:
    for column, comment in comments.items():
        spark.sql(f"ALTER TABLE {table} ALTER COLUMN `{column}` COMMENT {literal(comment)}")


def set_properties(spark: SparkSession, table: str, properties: Mapping[str, str]) -> None:
    pairs = ", ".join(f"{literal(k)} = {literal(v)}" for k, v in properties.items())
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({pairs})")


def literal(value: object) -> str:
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return str(value)
