"""Per-machine summaries built from whichever sources are live."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantfuse.functions import flag, pass_rate
from plantfuse.operators.totals import (
    Fact,
    distinct_ids,
    joined_totals,
    one,
    totals_by_key,
    with_totals,
)
from plantfuse.sources import Sources

KEY = "machine_id"
MACHINES = ("glue.machines", "postgres.machines")
INSPECTIONS = ("glue.quality_inspections", "redshift.quality_inspections")


def inspection_facts(sources: Sources) -> list[Fact]:
    """Both inspection tables, adding to the same measures."""
    result = F.col("result")
    return [
        Fact(
            frame,
            KEY,
            {
                "total_inspection_count": one(),
                "passed_inspection_count": flag(result == "pass"),
                "failed_inspection_count": flag(result == "fail"),
                "total_defect_count": F.col("defect_count"),
            },
        )
        for frame in sources.live(*INSPECTIONS)
    ]


def machine_health_summary(sources: Sources) -> DataFrame:
    """Sensor alarms, errors, maintenance time and inspection results of each machine."""
    status, event = F.col("status"), F.col("event_type")
    sensors = Fact(
        sources.first("redshift.sensor_readings"),
        KEY,
        {
            "sensor_warning_count": flag(status == "warning"),
            "sensor_critical_count": flag(status == "critical"),
        },
    )
    events = Fact(
        sources.first("redshift.production_events"),
        KEY,
        {
            "error_event_count": flag(event == "error"),
            "total_maintenance_minutes": F.when(
                event == "maintenance", F.col("duration_minutes")
            ).otherwise(0),
        },
    )
    summary = with_totals(
        _machines(sources),
        KEY,
        [
            totals_by_key(KEY, sensors),
            totals_by_key(KEY, events),
            totals_by_key(KEY, *inspection_facts(sources)),
        ],
    )
    rate = pass_rate(F.col("passed_inspection_count"), F.col("total_inspection_count"))
    return summary.withColumns(
        {
            "total_maintenance_minutes": F.round("total_maintenance_minutes", 2),
            "quality_pass_rate_pct": rate,
        }
    )


def operations_facts(sources: Sources) -> list[Fact]:
    """The nine tables of the operations summary, with the measures each one gives."""
    status = F.col("status")
    return [
        Fact(
            sources.first(*INSPECTIONS),
            KEY,
            {"glue_inspection_count": one(), "glue_defect_count": F.col("defect_count")},
        ),
        Fact(
            sources.first("redshift.sensor_readings"),
            KEY,
            {
                "sensor_reading_count": one(),
                "sensor_warnings": flag(status == "warning"),
                "sensor_criticals": flag(status == "critical"),
            },
        ),
        Fact(
            sources.first("redshift.production_events"),
            KEY,
            {
                "production_event_count": one(),
                "error_event_count": flag(F.col("event_type") == "error"),
            },
        ),
        Fact(sources.first("postgres.maintenance_logs"), KEY, {"maintenance_log_count": one()}),
        Fact(
            sources.first("postgres.work_orders"),
            KEY,
            {"work_order_count": one(), "open_work_orders": flag(status == "open")},
        ),
        Fact(
            sources.first("synapse.shift_schedules"),
            KEY,
            {"shift_count": one(), "total_hours_worked": F.col("hours_worked")},
        ),
        Fact(
            sources.first("synapse.energy_consumption"),
            KEY,
            {"total_energy_kwh": F.col("kwh_consumed"), "energy_cost_usd": F.col("cost_usd")},
        ),
        Fact(sources.first("bigquery.downtime_records"), KEY, {"downtime_incidents": one()}),
        Fact(
            sources.first("bigquery.cost_allocation"),
            KEY,
            {"allocated_cost_usd": F.col("amount_usd")},
        ),
    ]


def factory_operations_union(sources: Sources, chosen: Column | None = None) -> DataFrame:
    """Volumes, alarms, work, energy and cost of each machine from all five sources.

    With ``chosen``, a condition on the machines' columns, only those: other
    machines' rows leave each fact before it is totalled.
    """
    machines, facts = _machines(sources), operations_facts(sources)
    if chosen is not None:
        machines = machines.where(chosen)
        ids = machines.select(F.col(KEY).alias("chosen_id"))
        facts = [
            replace(f, frame=f.frame.join(ids, F.col(f.key) == F.col("chosen_id"), "left_semi"))
            for f in facts
        ]
    totals = [totals_by_key(KEY, fact) for fact in facts]
    return with_totals(machines, KEY, totals).withColumns(
        {
            "total_hours_worked": F.round("total_hours_worked", 1),
            "total_energy_kwh": F.round("total_energy_kwh", 2),
            "energy_cost_usd": F.round("energy_cost_usd", 2),
            "allocated_cost_usd": F.round("allocated_cost_usd", 2),
        }
    )


def maintenance_summary(sources: Sources) -> DataFrame:
    """Logs and work orders per machine, as the join of both tables counts them."""
    return joined_totals(
        _named_machines(sources),
        KEY,
        Fact(
            sources.first("postgres.maintenance_logs"),
            KEY,
            {"maintenance_log_count": flag(F.col("log_id").isNotNull())},
        ),
        Fact(
            sources.first("postgres.work_orders"),
            KEY,
            {
                "work_order_count": flag(F.col("order_id").isNotNull()),
                "open_work_orders": flag(F.col("status") == "open"),
            },
        ),
        counts=("maintenance_log_count", "work_order_count", "open_work_orders"),
    ).orderBy(F.desc("open_work_orders"), KEY)


def energy_summary(sources: Sources) -> DataFrame:
    """Distinct shifts, and energy as the join with the shifts repeats it."""
    shifts = distinct_ids(sources.first("synapse.shift_schedules"), KEY, "shift_id")
    return (
        joined_totals(
            _named_machines(sources),
            KEY,
            Fact(shifts, KEY, {"total_shifts": flag(F.col("shift_id").isNotNull())}),
            Fact(
                sources.first("synapse.energy_consumption"),
                KEY,
                {"total_kwh": F.col("kwh_consumed"), "total_energy_cost_usd": F.col("cost_usd")},
            ),
            counts=("total_shifts",),
            per_entity=("total_shifts",),
            left_rows=F.col("id_rows"),
        )
        .withColumns({m: F.round(m, 2) for m in ("total_kwh", "total_energy_cost_usd")})
        .orderBy(F.desc("total_energy_cost_usd"), KEY)
    )


def downtime_summary(sources: Sources) -> DataFrame:
    """Downtimes and allocated cost, as the join of both tables repeats them."""
    return (
        joined_totals(
            _named_machines(sources),
            KEY,
            Fact(
                sources.first("bigquery.downtime_records"),
                KEY,
                {"downtime_incidents": flag(F.col("record_id").isNotNull())},
            ),
            Fact(
                sources.first("bigquery.cost_allocation"),
                KEY,
                {"total_allocated_cost_usd": F.col("amount_usd")},
            ),
            counts=("downtime_incidents",),
        )
        .withColumn("total_allocated_cost_usd", F.round("total_allocated_cost_usd", 2))
        .orderBy(F.desc("downtime_incidents"), KEY)
    )


def _machines(sources: Sources) -> DataFrame:
    return sources.first(*MACHINES).select(
        KEY,
        "machine_name",
        "production_line",
        "factory",
        F.col("status").alias("machine_status"),
    )


def _named_machines(sources: Sources) -> DataFrame:
    return sources.first(*MACHINES).select(KEY, "machine_name")
