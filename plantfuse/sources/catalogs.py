"""Named catalogs, and listing what they hold."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

JDBC_CATALOG = "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"
ICEBERG_CATALOG = "org.apache.iceberg.spark.SparkCatalog"


def register_catalog(
    spark: SparkSession, name: str, implementation: str, options: Mapping[str, str]
) -> None:
    """Make ``name.schema.table`` resolvable for the rest of the session."""
    prefix = f"spark.sql.catalog.{name}"
    spark.conf.set(prefix, implementation)
    for option, value in options.items():
        spark.conf.set(f"{prefix}.{option}", value)


def register_jdbc_catalog(
    spark: SparkSession, name: str, url: str, user: str, password: str, driver: str
) -> None:
    """A database as a catalog, with filters, aggregates and limits sent to it."""
    options = {
        "url": url,
        "user": user,
        "password": password,
        "driver": driver,
        "pushDownAggregate": "true",
        "pushDownLimit": "true",
    }
    register_catalog(spark, name, JDBC_CATALOG, options)


def register_iceberg_catalog(
    spark: SparkSession, name: str, warehouse: str, catalog_impl: str, io_impl: str | None = None
) -> None:
    """An Iceberg catalog: metadata from the catalog service, files read by Spark."""
    options = {"warehouse": warehouse, "catalog-impl": catalog_impl}
    if io_impl:
        options["io-impl"] = io_impl
    register_catalog(spark, name, ICEBERG_CATALOG, options)


def qualified(catalog: str | None, schema: str, table: str) -> str:
    """A quoted name of two or three levels; the target schema is the caller's choice."""
    parts = [p for p in (catalog, schema, table) if p]
    return ".".join(f"`{p.replace('`', '``')}`" for p in parts)


def tables_like(spark: SparkSession, schema: str, pattern: str = "*") -> DataFrame:
    """Tables of a schema whose names match the pattern (``*`` and ``|``)."""
    quoted = pattern.replace("'", "\\'")
    return spark.sql(f"SHOW TABLES IN {qualified(None, '', schema)} LIKE '{quoted}'").where(
        "NOT isTemporary"
    )


def schemas_like(spark: SparkSession, pattern: str = "*") -> DataFrame:
    quoted = pattern.replace("'", "\\'")
    return spark.sql(f"SHOW SCHEMAS LIKE '{quoted}'")


def properties(spark: SparkSession, table: str) -> DataFrame:
    """(key, value) of the properties set on a table."""
    return spark.sql(f"SHOW TBLPROPERTIES {table}").select("key", "value")
