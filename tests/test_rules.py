"""Classification, alerts, secured views and generators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plantfuse.operators import combine, generate, load, rules
from plantfuse.session import shared_path
from plantfuse.sources import values_frame


@pytest.mark.parametrize(
    "kind, value, band",
    [
        ("temperature", 84.9, "normal"),
        ("temperature", 85.0, "warning"),
        ("temperature", 95.0, "warning"),
        ("temperature", 95.1, "critical"),
        ("pressure", 4.2, "warning"),
        ("vibration", 9.1, "critical"),
        ("humidity", 69.9, "normal"),
        ("rotation", 4000.0, "warning"),
        ("flow_rate", 22.5, "normal"),
        ("flow_rate", 8.5, "warning"),
        ("flow_rate", 5.0, "warning"),
        ("flow_rate", 4.2, "critical"),
        ("flow_rate", None, None),
        ("unheard_of", 1.0, None),
    ],
)
def test_bands(spark, kind, value, band):
    reading = spark.createDataFrame([(kind, value)], "sensor_type STRING, value DOUBLE")
    graded = rules.band(F.col("sensor_type"), F.col("value"), rules.SENSOR_BANDS)
    assert reading.select(graded).first()[0] == band


def test_reorder_point_itself_alerts(spark):
    stock = values_frame(spark, "(1, 5, 5), (2, 6, 5), (3, 4, 5), (4, NULL, 5)", "id, n, r")
    alerts = rules.at_or_below_reorder_point(stock, "n", "r")
    assert sorted(r.id for r in alerts.collect()) == [1, 3]


def test_secured_view(spark):
    frame = spark.createDataFrame([(1, "secret", 5), (2, "x", -5)], "id INT, name STRING, n INT")
    view = rules.secured_view(
        frame, "shown", F.col("n") > 0, {"name": F.lit("***")}, hidden=("n",)
    )
    assert [tuple(r) for r in view.collect()] == [(1, "***")]
    assert spark.table("shown").columns == ["id", "name"]


def index(spark, n, parts=4):
    return spark.range(1, n + 1, 1, parts)


def test_plans(spark):
    rows = generate.production_plans(index(spark, 20)).orderBy("plan_id").collect()
    assert tuple(rows[0]) == (1, 1, "Widget-A", "2024-01-08", 115, 108, "completed")
    assert tuple(rows[19]) == (20, 10, "Shaft-S1", "2024-02-15", 400, 380, "in_progress")
    assert sum(r.status == "completed" for r in rows) == 15


def test_inventory(spark):
    rows = generate.inventory_levels(index(spark, 40)).orderBy("inventory_id").collect()
    assert tuple(rows[0]) == (1, 1, "Steel-Rod", "2024-01-10", 488, 100, "kg", "WH-B")
    assert tuple(rows[4])[2:] == ("Bearing-6205", "2024-01-14", 440, 100, "pcs", "WH-B")
    assert rows[3].unit == "pcs" and rows[39].quantity_on_hand == 50


def test_inspections_are_repeatable_and_spread(spark):
    made = generate.quality_inspections(index(spark, 6000)).orderBy("inspection_id").collect()
    again = generate.quality_inspections(index(spark, 6000, 7)).orderBy("inspection_id").collect()
    assert made == again
    other = generate.quality_inspections(index(spark, 6000), seed=7).orderBy("inspection_id")
    assert other.collect() != made
    share = {r: sum(m.result == r for m in made) / 6000 for r in ("pass", "fail", "warning")}
    assert share["pass"] == pytest.approx(4 / 6, abs=0.03)
    assert share["fail"] == pytest.approx(1 / 6, abs=0.03)
    assert {m.machine_id for m in made} == set(range(1, 11))
    per_machine = [sum(m.machine_id == k for m in made) for k in range(1, 11)]
    assert min(per_machine) > 480 and max(per_machine) < 720
    assert all((m.defect_count == 0) == (m.result == "pass") for m in made)
    assert {m.defect_count for m in made} == set(range(6))
    assert all(m.notes in generate.NOTES[m.result] for m in made)
    first, last = dt.datetime(2025, 1, 15, 6), dt.datetime(2025, 2, 14, 6)
    assert all(first <= m.inspection_time <= last for m in made)


@pytest.mark.parametrize("days", [0, 364, 365 * 400, 2_000_000, 2_932_896, 4_000_000_000, 2 * 10**12])
def test_days_far_ahead(spark, days):
    shown = spark.range(1).select(generate.day_after("2024-01-08", F.lit(days).cast("long"))).first()[0]
    cycles, rest = divmod(days, 146_097)
    near = dt.date(2024, 1, 8) + dt.timedelta(rest)
    assert shown == f"{near.year + 400 * cycles}-{near:%m-%d}"


def test_a_stored_view_asks_who_reads_it(spark):
    load.create_schema(spark, "stored_views", shared_path(spark, "stored_views"))
    rows = spark.createDataFrame(
        [(1, "Ann Able", 5.0), (2, "Bob Baker", -1.0), (3, None, 9.0), (4, "Cy Cole", None)],
        "id INT, name STRING, worth DOUBLE",
    )
    load.save_summary(rows, "stored_views.people")
    grants = "stored_views.grants"
    load.create_table(spark, grants, "user_name STRING, least DOUBLE, unmasked BOOLEAN")
    rules.stored_secured_view(
        spark,
        "stored_views.seen",
        "stored_views.people",
        grants,
        visible="worth",
        masks={"name": "concat(left(name, 1), '***')"},
        hidden=("worth",),
    )

    def seen():
        found = spark.newSession().table("stored_views.seen")
        assert found.columns == ["id", "name"]
        return sorted(map(tuple, found.collect()))

    def grant(user, least, unmasked):
        row = spark.sql("SELECT current_user() AS user_name" if user is None else f"SELECT '{user}' AS user_name")
        load.append_rows(
            row.withColumns({"least": F.lit(float(least)), "unmasked": F.lit(unmasked)}), grants
        )

    assert seen() == []
    grant("someone else", -100, True)
    assert seen() == []
    grant(None, 0, False)
    assert seen() == [(1, "A***"), (3, None)]
    grant(None, -5, True)
    assert seen() == [(1, "Ann Able"), (2, "Bob Baker"), (3, None)]
    load.drop_schema(spark, "stored_views")


def test_rows_know_the_file_they_came_from(spark):
    path = shared_path(spark, "batches")
    for batch in range(3):
        frame = spark.range(batch * 10, batch * 10 + 5).withColumn("batch", F.lit(batch))
        frame.coalesce(1).write.mode("append").parquet(path)
    found = combine.with_file_source(spark.read.parquet(path))
    assert found.columns == ["id", "batch", "source_file", "source_time"]
    by_file = found.groupBy("source_file").agg(F.collect_set("batch").alias("of"), F.count("*").alias("n"))
    rows = by_file.collect()
    assert len(rows) == 3 and all(len(row.of) == 1 and row.n == 5 for row in rows)
    assert found.where("source_time IS NULL").count() == 0
