"""Publishing the rows of a table: written beside it, checked, then put in its place.

A load writes to a fresh folder and the catalog learns of it by one change of
the table's location. Until then readers see the rows of before; a load that
fails or is refused leaves them as they are. A reader that has begun goes on
with the files it knows, so folders of earlier loads stay until they are expired.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from plantfuse.operators import load

VERSIONS = "_versions"


class StaleStage(RuntimeError):
    """The table was published by someone else since the stage was begun."""


@dataclass(frozen=True)
class Stage:
    """Rows written for a table that does not show them yet.

    ``name`` is a table over the rows; ``replaces`` is where the table's own
    rows lay when the stage was begun.
    """

    table: str
    name: str
    path: str
    replaces: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)


def location(spark: SparkSession, table: str) -> str:
    """Where the catalog says a table's rows are."""
    detail = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Location'")
    return detail.select("data_type").first()[0]


def _versions_folder(spark: SparkSession, table: str) -> str:
    """The folder of a table's loads: beside its first, whichever it shows now."""
    shown = location(spark, table).rstrip("/")
    parent, _, last = shown.rpartition("/")
    return parent if parent.endswith(VERSIONS) else f"{parent}/{last}{VERSIONS}"


def stage(
    frame: DataFrame, table: str, ddl: str, defaults: Mapping[str, object] | None = None
) -> Stage:
    """Writes rows for a table, under its declared types and defaults.

    Columns left out take their defaults; a value that its column cannot hold
    stops the write. A write that fails leaves a folder that ``expire`` removes.
    """
    spark = frame.sparkSession
    moment = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    label = f"v{moment}_{uuid.uuid4().hex[:8]}"
    path = f"{_versions_folder(spark, table)}/{label}"
    schema, _, _ = table.rpartition(".")
    name = f"{schema}.`staged_{label}`" if schema else f"`staged_{label}`"
    begun = Stage(table, name, path, location(spark, table))
    load.create_table(spark, name, ddl, location=path, defaults=defaults)
    try:
        load.append_rows(frame, name)
    except Exception:
        load.drop_table(spark, name)
        raise
    return begun


def publish(spark: SparkSession, staged: Stage) -> DataFrame:
    """Shows a stage's rows as the table's, by one change in the catalog."""
    if location(spark, staged.table) != staged.replaces:
        discard(spark, staged)
        raise StaleStage(f"{staged.table} was published since the stage was begun")
    path = load.literal(staged.path)
    spark.sql(f"ALTER TABLE {staged.table} SET LOCATION {path}")
    load.drop_table(spark, staged.name)
    return spark.table(staged.table)


def discard(spark: SparkSession, staged: Stage) -> None:
    """Removes a stage; the table stays as it is."""
    load.drop_table(spark, staged.name)
    place = _path(spark, staged.path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def versions(spark: SparkSession, table: str) -> list[str]:
    """The folders of a table's loads, oldest first, published or not."""
    place = _path(spark, _versions_folder(spark, table))
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    return sorted(found.getPath().getName() for found in files.listStatus(place))


def expire(spark: SparkSession, table: str, keep: int = 1) -> list[str]:
    """Removes the loads before the shown one, but for the last ``keep``.

    Later ones may be stages that are still written, and stay. The caller
    chooses ``keep`` so that no query still reads what goes.
    """
    shown = location(spark, table).rstrip("/").rpartition("/")[2]
    earlier = [version for version in versions(spark, table) if version < shown]
    gone = earlier[: max(0, len(earlier) - keep)]
    for version in gone:
        place = _path(spark, f"{_versions_folder(spark, table)}/{version}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return gone


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)
