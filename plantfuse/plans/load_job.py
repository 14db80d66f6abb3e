"""Loading a source: create, stage, check, publish and count what arrived."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plantfuse.operators import checks, keys, load, publish
from plantfuse.session import removed_at_exit, shared_path
from plantfuse.sources import SourceDef, Sources, TableDef
from plantfuse.sources.catalogs import qualified


class LoadError(RuntimeError):
    """Rows that break a table's declaration."""


def stage_table(
    spark: SparkSession,
    schema: str,
    table: TableDef,
    frame: DataFrame,
    catalog: str | None = None,
    seen: Observation | None = None,
) -> publish.Stage:
    """Creates the declared table if need be and stages rows that keep its declaration.

    Columns the frame lacks take their declared defaults. A key the source
    generates is numbered in the order of the other columns. A table of the
    name with other columns or types, and rows that repeat a declared key or
    break a NOT NULL or a length, stop the job before the table changes.
    ``seen`` counts the rows sent as ``n``, without reading them again.
    """
    name = qualified(catalog, schema, table.name)
    load.create_table(spark, name, table.ddl, comment=table.comment, defaults=table.defaults)
    _same_columns(spark, name, table)
    rows = load.not_null_checked(frame, table.ddl)
    generated = table.generated_key
    if generated and generated not in frame.columns:
        path = shared_path(spark, f"{table.name}-numbered")
        rows = keys.with_generated_key(rows, generated, frame.columns, path, seen=seen)
        removed_at_exit(spark, path)
        key_type = spark.table(name).schema[generated].dataType
        rows = rows.withColumn(generated, F.col(generated).cast(key_type))
    elif seen is not None:
        rows = rows.observe(seen, F.count("*").alias("n"))
    staged = publish.stage(rows, name, table.ddl, table.defaults)
    broken = checks.constraint_violations(staged.rows(spark), table.name, table.ddl, table.key)
    found = [f"{row.rule}: {row.violations}" for row in broken.where("violations > 0").collect()]
    if found:
        publish.discard(spark, staged)
        raise LoadError(f"{table.name} breaks {'; '.join(found)}")
    return staged


def load_table(
    spark: SparkSession,
    schema: str,
    table: TableDef,
    frame: DataFrame,
    catalog: str | None = None,
) -> DataFrame:
    """Replaces the rows of the declared table, once they are written and checked."""
    return publish.publish(spark, stage_table(spark, schema, table, frame, catalog))


def _same_columns(spark: SparkSession, name: str, table: TableDef) -> None:
    declared = {f.name: f.dataType.simpleString() for f in checks.declared_columns(table.ddl)}
    stored = spark.table(name).schema
    # A stored length is kept beside the type, which then reads as a string.
    lengths = {
        f.name: f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", f.dataType.simpleString())
        for f in stored
    }
    if declared != lengths:
        differing = sorted({name for name, _ in declared.items() ^ lengths.items()})
        raise LoadError(f"{name} has other columns than declared: {differing}")


def load_tables(
    spark: SparkSession, schema: str, tables: Sequence[tuple[TableDef, DataFrame]]
) -> DataFrame:
    """Loads the tables into a schema and compares rows sent with rows stored.

    Rows are counted as they are written: no input is read again for it. All
    tables are staged and checked before the first is published, so a table
    that is refused leaves all of them as they were.
    """
    load.create_schema(spark, schema)
    staged, sent = [], []
    try:
        for table, frame in tables:
            seen = Observation(f"sent-{table.name}")
            staged.append(stage_table(spark, schema, table, frame, seen=seen))
            sent.append((table.name, seen.get["n"]))
    except Exception:
        for stage in staged:
            publish.discard(spark, stage)
        raise
    stored = {}
    for (table, _), stage in zip(tables, staged):
        shown = publish.publish(spark, stage)
        stored[table.name] = lambda shown=shown: shown
    expected = spark.createDataFrame(sent, "table_name STRING, expected_rows BIGINT")
    return checks.reconcile(checks.table_counts(spark, stored), expected)


def reconcile_sources(
    spark: SparkSession, declared: Sequence[SourceDef], sources: Sources, off: Collection[str] = ()
) -> DataFrame:
    """Every table whose rows are declared against the live one, counted in one job.

    Tables are named ``source.table``; those of sources that are off are left out.
    """
    wanted = [
        (f"{source.key}.{table.name}", table.expected_rows)
        for source in declared
        for table in source.tables
        if table.expected_rows is not None and source.key not in off
    ]
    counts = checks.table_counts(
        spark, {name: lambda name=name: sources.first(name) for name, _ in wanted}
    )
    expected = spark.createDataFrame(wanted, "table_name STRING, expected_rows BIGINT")
    return checks.reconcile(counts, expected)
