"""Classification, alerts and secured views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# For each kind of sensor where warning begins, beyond what a
# value is critical, and whether low values are the bad ones.
SENSOR_BANDS = {
    "temperature": (85.0, 95.0, False),
    "pressure": (4.0, 4.5, False),
    "vibration": (7.0, 9.0, False),
    "humidity": (70.0, 75.0, False),
    "flow_rate": (10.0, 5.0, True),
    "rotation": (4000.0, 4500.0, False),
}

Bands = Mapping[str, tuple[float, float, bool]]


def band(kind: Column, value: Column, bands: Bands) -> Column:
    """critical beyond its limit, warning at or beyond its own, else normal.

    NULL where the kind has no bands or there is no value. Readings have few
    kinds, so a join on the kind would pile them up in a few tasks; the bands
    become one expression instead and nothing is shuffled or broadcast.
    """

    def level(warning_at: float, critical_beyond: float, low_is_bad: bool) -> Column:
        critical = value < critical_beyond if low_is_bad else value > critical_beyond
        warning = value <= warning_at if low_is_bad else value >= warning_at
        graded = F.when(critical, "critical").when(warning, "warning")
        return graded.when(value.isNotNull(), "normal")

    by_kind = [(kind == name, level(*limits)) for name, limits in bands.items()]
    return reduce(lambda c, branch: c.when(*branch), by_kind[1:], F.when(*by_kind[0]))


def at_or_below_reorder_point(stock: DataFrame, on_hand: str, reorder_point: str) -> DataFrame:
    return stock.where(F.col(on_hand) <= F.col(reorder_point))


def secured_view(
    frame: DataFrame,
    name: str,
    visible: Column,
    masks: Mapping[str, Column],
    hidden: Sequence[str] = (),
) -> DataFrame:
    """A view showing only the visible rows, with some columns masked or left out.

    The row filter is a plain predicate, so it still reaches the file scan.
    """
    shown = frame.where(visible).select(
        *[masks[c].alias(c) if c in masks else F.col(c) for c in frame.columns if c not in hidden]
    )
    shown.createOrReplaceTempView(name)
    return frame.sparkSession.table(name)


def stored_secured_view(
    spark: SparkSession,
    view: str,
    table: str,
    grants: str,
    visible: str,
    masks: Mapping[str, str],
    hidden: Sequence[str] = (),
) -> None:
    """A view kept in the catalog, whose rows and masks hang on who reads it.

    ``grants`` is a table with ``user_name``, ``least`` and ``unmasked``. A
    reader sees the rows whose ``visible`` expression is at least their least
    one, and the columns in ``masks`` by those expressions unless they are
    unmasked. Of several grants of a reader the widest counts; a reader without
    one sees no row. Both are looked up when the view is read, in any session.
    """
    mine = f"FROM {grants} WHERE user_name = current_user()"
    unmasked = f"coalesce((SELECT bool_or(unmasked) {mine}), false)"
    columns = [
        f"CASE WHEN {unmasked} THEN `{c}` ELSE {masks[c]} END AS `{c}`" if c in masks else f"`{c}`"
        for c in spark.table(table).columns
        if c not in hidden
    ]
    spark.sql(
        f"CREATE OR REPLACE VIEW {view} AS SELECT {', '.join(columns)} FROM {table}"
        f" WHERE {visible} >= (SELECT min(least) {mine})"
    )
