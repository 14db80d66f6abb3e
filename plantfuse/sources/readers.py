"""One description per physical form of a table; each loads as a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Default port and JDBC driver class of each database product.
JDBC_PRODUCTS = {
    "redshift": (5439, "com.amazon.redshift.jdbc42.Driver"),
    "postgresql": (5432, "org.postgresql.Driver"),
    "sqlserver": (1433, "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
}


#: Tables whose files were seen to have all declared columns, by session.
_columns_found: set[tuple[str, str, str | None, str]] = set()


@dataclass(frozen=True)
class TableSource:
    """A data source format with its options, or the name of a catalog table."""

    format: str
    options: Mapping[str, str] = field(default_factory=dict)
    path: str | None = None
    schema: str | T.StructType | None = None
    remote: bool = False

    def load(self, spark: SparkSession) -> DataFrame:
        if self.format == "table":
            return spark.read.options(**self.options).table(self.path)
        reader = spark.read.format(self.format).options(**self.options)
        if self.schema is None:
            return reader.load(self.path) if self.path else reader.load()
        declared = storable_schema(self.schema)
        # Reading what columns the files have is a job, so once a session must do.
        known = (spark.sparkContext.applicationId, self.format, self.path, declared.simpleString())
        if known not in _columns_found:
            missing = [f.name for f in declared if f.name not in reader.load(self.path).columns]
            if missing:
                raise ValueError(f"{self.path} lacks the declared columns {', '.join(missing)}")
            _columns_found.add(known)
        return reader.schema(declared).load(self.path)

    @staticmethod
    def parquet(path: str, schema: str | T.StructType | None = None) -> TableSource:
        return TableSource("parquet", path=path, schema=schema)

    @staticmethod
    def orc(path: str, schema: str | T.StructType | None = None) -> TableSource:
        return TableSource("orc", path=path, schema=schema)

    @staticmethod
    def delta(path: str) -> TableSource:
        """Needs the Delta package on the cluster."""
        return TableSource("delta", path=path)

    @staticmethod
    def table(name: str, split: tuple[str, str, str, int] | None = None) -> TableSource:
        """A catalog table by its three-level name, such as an Iceberg or JDBC catalog's.

        ``split`` goes to the catalog as options of the read, as a JDBC
        catalog takes them; without it one task reads what is not pushed down.
        """
        return TableSource("table", _split_options(split), path=name)

    @staticmethod
    def jdbc(
        url: str,
        table: str,
        user: str,
        password: str,
        driver: str,
        split: tuple[str, str, str, int] | None = None,
        fetch_rows: int = 10_000,
    ) -> TableSource:
        """A table read over JDBC.

        ``split`` is (column, lower, upper, partitions). Without it one task
        reads the whole table, which only suits a small one.
        """
        options = {
            "url": url,
            "dbtable": table,
            "user": user,
            "password": password,
            "driver": driver,
            "fetchsize": str(fetch_rows),
        }
        return TableSource("jdbc", options | _split_options(split), remote=True)

    @staticmethod
    def bigquery(project: str, table: str, credentials: str) -> TableSource:
        """Needs the BigQuery connector on the cluster."""
        options = {"parentProject": project, "table": table, "credentials": credentials}
        return TableSource("bigquery", options, remote=True)

    @staticmethod
    def snowflake(
        host: str, user: str, password: str, warehouse: str, database: str, schema: str, table: str
    ) -> TableSource:
        """Needs the Snowflake connector on the cluster."""
        options = {
            "sfURL": host,
            "sfUser": user,
            "sfPassword": password,
            "sfWarehouse": warehouse,
            "sfDatabase": database,
            "sfSchema": schema,
            "dbtable": table,
        }
        return TableSource("snowflake", options, remote=True)


def _split_options(split: tuple[str, str, str, int] | None) -> dict[str, str]:
    if not split:
        return {}
    column, lower, upper, partitions = split
    return {
        "partitionColumn": column,
        "lowerBound": lower,
        "upperBound": upper,
        "numPartitions": str(partitions),
    }


def storable_schema(declared: str | T.StructType) -> T.StructType:
    """The declared columns as files hold them: VARCHAR(n) as text, comments kept."""
    columns = T.StructType.fromDDL(declared) if isinstance(declared, str) else declared
    return T.StructType(
        [
            T.StructField(
                f.name,
                T.StringType() if isinstance(f.dataType, T.VarcharType) else f.dataType,
                f.nullable,
                f.metadata,
            )
            for f in columns
        ]
    )


def jdbc_url(product: str, host: str, database: str, port: int | None = None) -> str:
    port = port or JDBC_PRODUCTS[product][0]
    if product == "sqlserver":
        return f"jdbc:sqlserver://{host}:{port};databaseName={database};trustServerCertificate=true"
    return f"jdbc:{product}://{host}:{port}/{database}"


def values_frame(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """An inline ``VALUES`` table. Spark knows its exact size, so joins to it broadcast."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def rows_frame(
    spark: SparkSession, rows: Sequence[tuple] | pd.DataFrame, schema: T.StructType | str
) -> DataFrame:
    """A short list of rows, or a small pandas frame, under a declared schema."""
    return spark.createDataFrame(rows, schema)
