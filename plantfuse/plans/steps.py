"""Which summaries can be built from the sources that are live."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plantfuse.operators import load
from plantfuse.plans import summaries
from plantfuse.sources import Sources
from plantfuse.sources.catalogs import qualified


@dataclass(frozen=True)
class Step:
    """A summary, and the tables it needs; of a tuple of tables any one will do.

    A stored one is kept as a table, the others are asked for as needed.
    """

    name: str
    build: Callable[[Sources], DataFrame]
    needs: tuple[tuple[str, ...], ...]
    stored: bool = False

    def can_run(self, sources: Sources) -> bool:
        return all(sources.has(*alternatives) for alternatives in self.needs)


STEPS = (
    Step(
        "machine_health_summary",
        summaries.machine_health_summary,
        (
            summaries.MACHINES,
            ("redshift.sensor_readings",),
            ("redshift.production_events",),
            ("redshift.quality_inspections",),
        ),
        stored=True,
    ),
    Step(
        "maintenance_summary",
        summaries.maintenance_summary,
        (summaries.MACHINES, ("postgres.maintenance_logs",), ("postgres.work_orders",)),
    ),
    Step(
        "energy_summary",
        summaries.energy_summary,
        (summaries.MACHINES, ("synapse.shift_schedules",), ("synapse.energy_consumption",)),
    ),
    Step(
        "downtime_summary",
        summaries.downtime_summary,
        (summaries.MACHINES, ("bigquery.downtime_records",), ("bigquery.cost_allocation",)),
    ),
    Step(
        "factory_operations_union",
        summaries.factory_operations_union,
        (
            summaries.MACHINES,
            summaries.INSPECTIONS,
            ("redshift.sensor_readings",),
            ("redshift.production_events",),
            ("postgres.maintenance_logs",),
            ("postgres.work_orders",),
            ("synapse.shift_schedules",),
            ("synapse.energy_consumption",),
            ("bigquery.downtime_records",),
            ("bigquery.cost_allocation",),
        ),
        stored=True,
    ),
)


def runnable_steps(sources: Sources) -> dict[str, DataFrame]:
    """The summaries none of whose inputs is off; the others are left out."""
    return {step.name: step.build(sources) for step in STEPS if step.can_run(sources)}


def store_summaries(
    spark: SparkSession, sources: Sources, schema: str, catalog: str | None = None
) -> dict[str, DataFrame]:
    """Creates or replaces the stored summaries that can be built, and reads them back.

    All of them are planned, and so all their inputs found, before any is replaced.
    """
    planned = {
        step.name: step.build(sources)
        for step in STEPS
        if step.stored and step.can_run(sources)
    }
    if catalog is None:
        load.create_schema(spark, schema)
    return {
        name: load.save_summary(frame, qualified(catalog, schema, name))
        for name, frame in planned.items()
    }
