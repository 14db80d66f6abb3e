"""The summaries on the factory data, against results worked out by hand."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plantfuse.plans import questions, steps, summaries
from plantfuse.sources import Sources
from tests.factory_data import EVENTS, INSPECTIONS, READINGS, WORK, factory_frames, factory_sources


@pytest.fixture(scope="module")
def sources(spark):
    return factory_sources(spark)


@pytest.fixture(scope="module")
def health(sources):
    return summaries.machine_health_summary(sources).cache()


@pytest.fixture(scope="module")
def operations(sources):
    return summaries.factory_operations_union(sources).cache()


def rows(frame, *columns):
    return {r[0]: tuple(r)[1:] for r in frame.select(*columns).collect()}


# machine: pass rate of its inspections
PASS_RATES = {1: 80, 2: 60, 3: 75, 4: 75, 5: 25, 6: 100, 7: 25, 8: 20, 9: "66.7", 10: 100}


def test_health_summary(health):
    actual = rows(
        health,
        "machine_id",
        "sensor_warning_count",
        "sensor_critical_count",
        "error_event_count",
        "total_maintenance_minutes",
        "total_inspection_count",
        "passed_inspection_count",
        "failed_inspection_count",
        "total_defect_count",
        "quality_pass_rate_pct",
    )
    expected = {
        m: (*READINGS[m][1:], *EVENTS[m][1:], *INSPECTIONS[m], Decimal(PASS_RATES[m]))
        for m in PASS_RATES
    }
    assert actual == expected
    assert health.columns[:5] == [
        "machine_id",
        "machine_name",
        "production_line",
        "factory",
        "machine_status",
    ]
    assert len(health.columns) == 14


def test_operations_summary(operations):
    actual = rows(
        operations,
        "machine_id",
        "sensor_reading_count",
        "production_event_count",
        "maintenance_log_count",
        "work_order_count",
        "open_work_orders",
        "shift_count",
        "total_hours_worked",
        "total_energy_kwh",
        "energy_cost_usd",
        "downtime_incidents",
        "allocated_cost_usd",
    )
    expected = {
        m: (
            READINGS[m][0],
            EVENTS[m][0],
            *w[:4],
            *(Decimal(v) for v in w[4:7]),
            w[7],
            Decimal(w[8]),
        )
        for m, w in WORK.items()
    }
    assert actual == expected
    assert len(operations.columns) == 21


# machine: logs, work orders, open, kWh, energy USD, downtimes, allocated USD, as
# the join of both tables repeats them
REPEATED = {
    1: (9, 9, 3, "6192.50", "743.10", 15, 32500),
    2: (6, 6, 0, "6257.60", "750.92", 12, 35400),
    3: (9, 9, 3, "3818.40", "458.24", 12, 41160),
    4: (9, 9, 3, "2377.20", "285.27", 9, 22680),
    5: (9, 9, 3, "8560.40", "1027.24", 12, 54000),
    6: (9, 9, 3, "5633.20", "676.00", 9, 22590),
    7: (6, 6, 0, "2696.00", "323.52", 9, 9780),
    8: (6, 6, 0, "4034.00", "484.08", 9, 23940),
    9: (6, 6, 3, "1804.80", "216.56", 9, 7020),
    10: (6, 6, 3, "3379.20", "405.52", 9, 23010),
}


def test_adhoc_summaries_repeat_as_the_join_does(sources):
    maintenance = summaries.maintenance_summary(sources).drop("machine_name")
    energy = summaries.energy_summary(sources).drop("machine_name")
    downtime = summaries.downtime_summary(sources).drop("machine_name")
    assert rows(maintenance, "*") == {m: r[:3] for m, r in REPEATED.items()}
    assert rows(energy, "*") == {
        m: (WORK[m][3], Decimal(r[3]), Decimal(r[4])) for m, r in REPEATED.items()
    }
    assert rows(downtime, "*") == {m: (r[5], Decimal(r[6])) for m, r in REPEATED.items()}


def test_adhoc_summaries_are_ordered(sources):
    ordered = [r.open_work_orders for r in summaries.maintenance_summary(sources).collect()]
    assert ordered == sorted(ordered, reverse=True)
    costs = [r.total_energy_cost_usd for r in summaries.energy_summary(sources).collect()]
    assert costs == sorted(costs, reverse=True)


def test_questions(health, operations):
    assert questions.most_anomalies(operations).first().machine_id == 7
    by_line = rows(questions.pass_rate_by_line(health), "production_line", "quality_pass_rate_pct")
    assert by_line == {
        "ライン1": (Decimal("71.4"),),
        "ライン2": (Decimal("63.6"),),
        "ライン3": (Decimal("46.7"),),
    }
    assert questions.longest_maintenance(health).first().machine_id == 10
    assert questions.highest_energy_cost(operations).first().machine_id == 5
    building = operations.where(F.col("factory") == "A棟").select("machine_id").collect()
    assert sorted(r[0] for r in building) == [1, 2, 3]
    ranked = [
        (r.sensor_critical_count, r.error_event_count)
        for r in questions.health_ranked(health).collect()
    ]
    assert ranked == sorted(ranked, reverse=True)


def test_master_source_is_preferred_and_its_inspections_added(spark):
    frames = factory_frames(spark)
    frames["glue.machines"] = frames["postgres.machines"].where("machine_id <= 2")
    frames["glue.quality_inspections"] = frames["redshift.quality_inspections"]
    both = Sources({n: lambda f=f: f for n, f in frames.items()})
    health = summaries.machine_health_summary(both)
    totals = rows(health, "machine_id", "total_inspection_count", "quality_pass_rate_pct")
    assert totals == {1: (10, Decimal(80)), 2: (10, Decimal(60))}
    fallback = summaries.machine_health_summary(both.without("glue"))
    assert fallback.count() == 10


def test_machines_without_facts(spark):
    frames = factory_frames(spark)
    extra = spark.createDataFrame([(11, "n", "l", "f", "s")], frames["postgres.machines"].schema)
    frames["postgres.machines"] = frames["postgres.machines"].unionByName(extra)
    orphan = spark.createDataFrame(
        [(99, None, "open"), (98, 77, "open")], "order_id INT, machine_id INT, status STRING"
    )
    frames["postgres.work_orders"] = frames["postgres.work_orders"].unionByName(orphan)
    sources = Sources({n: lambda f=f: f for n, f in frames.items()})
    health = summaries.machine_health_summary(sources)
    assert health.count() == 11
    new = health.where("machine_id = 11").first()
    assert new.quality_pass_rate_pct is None
    assert (new.sensor_warning_count, new.total_maintenance_minutes) == (0, 0)
    maintenance = summaries.maintenance_summary(sources)
    assert tuple(maintenance.where("machine_id = 11").first())[2:] == (0, 0, 0)
    energy = summaries.energy_summary(sources).where("machine_id = 11").first()
    assert tuple(energy)[2:] == (0, None, None)
    assert maintenance.agg(F.sum("work_order_count")).first()[0] == sum(
        r[1] for r in REPEATED.values()
    )


def test_stored_summaries_are_replaced(spark):
    sources = factory_sources(spark)
    for _ in range(2):
        stored = steps.store_summaries(spark, sources, "analysis")
        assert {n: f.count() for n, f in stored.items()} == {
            "machine_health_summary": 10,
            "factory_operations_union": 10,
        }
    assert spark.table("analysis.machine_health_summary").columns[0] == "machine_id"
    assert steps.store_summaries(spark, sources.without("redshift"), "analysis") == {}


ALL_STEPS = {s.name for s in steps.STEPS}


@pytest.mark.parametrize(
    "off, left_out",
    [
        ((), set()),
        (("redshift",), {"machine_health_summary", "factory_operations_union"}),
        (("synapse",), {"energy_summary", "factory_operations_union"}),
        (("bigquery",), {"downtime_summary", "factory_operations_union"}),
        (("postgres",), ALL_STEPS),
    ],
)
def test_steps_follow_the_sources(spark, off, left_out):
    assert set(steps.runnable_steps(factory_sources(spark, off))) == ALL_STEPS - left_out


def test_one_building_is_the_same_from_its_own_rows_and_from_all(sources, operations):
    chosen = summaries.factory_operations_union(sources, F.col("factory") == "A棟")
    whole = operations.where(F.col("factory") == "A棟")
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, whole.collect()))
    assert chosen.count() > 0


@pytest.mark.parametrize(
    "summary, keys",
    [
        (summaries.maintenance_summary, ["-open_work_orders", "machine_id"]),
        (summaries.energy_summary, ["-total_energy_cost_usd", "machine_id"]),
        (summaries.downtime_summary, ["-downtime_incidents", "machine_id"]),
        (
            lambda s: questions.health_ranked(summaries.machine_health_summary(s)),
            ["-sensor_critical_count", "-error_event_count", "machine_id"],
        ),
        (
            lambda s: questions.longest_maintenance(summaries.machine_health_summary(s)),
            ["-total_maintenance_minutes", "machine_id"],
        ),
        (
            lambda s: questions.highest_energy_cost(summaries.factory_operations_union(s)),
            ["-energy_cost_usd", "machine_id"],
        ),
    ],
)
def test_every_row_is_in_its_order(sources, summary, keys):
    rows = summary(sources).collect()

    def place(row):
        return [-row[k[1:]] if k.startswith("-") else row[k] for k in keys]

    assert [place(row) for row in rows] == sorted(place(row) for row in rows)
    assert len(rows) == 10
