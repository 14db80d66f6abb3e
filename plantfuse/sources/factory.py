"""The factory data set: eight sources, nineteen tables, one shared machine key.

Names, types, keys, lengths and defaults are fixed values of the data model.
Key columns are INT in some sources and BIGINT in others; the operators widen
them to BIGINT. Dates held as text stay text here and are cast where used.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import SparkSession

from plantfuse.sources.catalogs import qualified
from plantfuse.sources.readers import TableSource
from plantfuse.sources.registry import SourceDef, Sources, TableDef

MACHINES_DDL = """
    machine_id INT NOT NULL COMMENT 'identifies the machine in every source',
    machine_name VARCHAR(80) NOT NULL COMMENT 'display name',
    production_line VARCHAR(40) NOT NULL COMMENT 'line the machine stands on',
    factory VARCHAR(40) NOT NULL COMMENT 'building',
    status VARCHAR(20) NOT NULL COMMENT 'running, under maintenance or stopped'
"""

INSPECTIONS_DDL = """
    inspection_id INT NOT NULL COMMENT 'inspection number',
    machine_id INT NOT NULL COMMENT 'machine inspected',
    inspector_name VARCHAR(50) NOT NULL COMMENT 'who inspected',
    inspection_time TIMESTAMP NOT NULL COMMENT 'when',
    result VARCHAR(20) NOT NULL COMMENT 'pass, fail or warning',
    defect_count INT NOT NULL COMMENT 'defects found, 0 on a pass',
    notes VARCHAR(500) COMMENT 'remarks'
"""

FACTORY_SOURCES = (
    SourceDef(
        "glue",
        "Master data on object storage",
        "files",
        (
            TableDef(
                "sensors",
                """
                sensor_id INT NOT NULL COMMENT 'sensor number',
                sensor_name STRING NOT NULL COMMENT 'model code',
                sensor_type STRING NOT NULL COMMENT 'quantity measured',
                unit STRING NOT NULL COMMENT 'unit of the value',
                location STRING NOT NULL COMMENT 'building and line',
                installed_date STRING NOT NULL COMMENT 'ISO date as text'
                """,
                ("sensor_id",),
                "sensor register",
                expected_rows=20,
            ),
            TableDef("machines", MACHINES_DDL, ("machine_id",), "machine master", expected_rows=10),
            TableDef(
                "quality_inspections",
                INSPECTIONS_DDL,
                ("inspection_id",),
                "inspections recorded with the master data",
                expected_rows=50,
            ),
        ),
    ),
    SourceDef(
        "redshift",
        "Shop-floor transactions",
        "query",
        (
            TableDef(
                "sensor_readings",
                """
                reading_id INT NOT NULL COMMENT 'reading number',
                sensor_id INT NOT NULL COMMENT 'sensor read',
                machine_id INT NOT NULL COMMENT 'machine the sensor is on',
                reading_time TIMESTAMP_NTZ NOT NULL COMMENT 'when',
                value DECIMAL(10,2) NOT NULL COMMENT 'value in the unit of the sensor',
                status VARCHAR(20) NOT NULL COMMENT 'normal, warning or critical'
                """,
                ("reading_id",),
                "sensor readings over time",
                defaults={"status": "normal"},
                expected_rows=100,
            ),
            TableDef(
                "production_events",
                """
                event_id INT NOT NULL COMMENT 'event number',
                machine_id INT NOT NULL COMMENT 'machine concerned',
                event_type VARCHAR(30) NOT NULL
                    COMMENT 'start, stop, maintenance, error or calibration',
                event_time TIMESTAMP_NTZ NOT NULL COMMENT 'when',
                duration_minutes INT COMMENT 'NULL for events without duration',
                description VARCHAR(200) COMMENT 'what happened'
                """,
                ("event_id",),
                "starts, stops, errors and maintenance",
                expected_rows=30,
            ),
            TableDef(
                "quality_inspections",
                INSPECTIONS_DDL.replace("TIMESTAMP", "TIMESTAMP_NTZ"),
                ("inspection_id",),
                "inspections recorded on the line",
                defaults={"defect_count": 0},
                expected_rows=40,
            ),
        ),
    ),
    SourceDef(
        "postgres",
        "Maintenance operations",
        "query",
        (
            TableDef("machines", MACHINES_DDL, ("machine_id",), "copy of the machine master"),
            TableDef(
                "maintenance_logs",
                """
                log_id INT NOT NULL COMMENT 'log number',
                machine_id INT NOT NULL COMMENT 'machine serviced',
                log_date DATE NOT NULL COMMENT 'day of the work',
                action VARCHAR(100) NOT NULL COMMENT 'work done',
                technician VARCHAR(80) NOT NULL COMMENT 'who did it',
                duration_min INT NOT NULL COMMENT 'minutes taken',
                notes STRING COMMENT 'remarks'
                """,
                ("log_id",),
                "maintenance done",
                generated_key="log_id",
                expected_rows=30,
            ),
            TableDef(
                "work_orders",
                """
                order_id INT NOT NULL COMMENT 'order number',
                machine_id INT NOT NULL COMMENT 'machine concerned',
                priority VARCHAR(10) NOT NULL COMMENT 'CRITICAL, HIGH, MEDIUM or LOW',
                status VARCHAR(20) NOT NULL COMMENT 'open, in_progress or completed',
                created_date DATE NOT NULL COMMENT 'day raised',
                due_date DATE NOT NULL COMMENT 'day due',
                assigned_to VARCHAR(80) NOT NULL COMMENT 'who is to do it'
                """,
                ("order_id",),
                "maintenance planned",
                generated_key="order_id",
                expected_rows=25,
            ),
        ),
    ),
    SourceDef(
        "synapse",
        "Workforce and energy",
        "query",
        (
            TableDef(
                "shift_schedules",
                """
                shift_id INT COMMENT 'shift number',
                machine_id INT COMMENT 'machine staffed',
                operator_name STRING COMMENT 'operator',
                shift_date DATE COMMENT 'day',
                shift_type STRING COMMENT 'day or night',
                hours_worked DECIMAL(4,1) COMMENT 'hours'
                """,
                ("shift_id",),
                "who worked when on which machine",
                expected_rows=40,
            ),
            TableDef(
                "energy_consumption",
                """
                record_id INT COMMENT 'record number',
                machine_id INT COMMENT 'machine metered',
                measure_date DATE COMMENT 'day',
                kwh_consumed DECIMAL(8,2) COMMENT 'energy in kWh',
                peak_demand_kw DECIMAL(6,2) COMMENT 'peak demand in kW',
                cost_usd DECIMAL(8,2) COMMENT 'cost in USD'
                """,
                ("record_id",),
                "daily energy per machine",
                expected_rows=50,
            ),
        ),
    ),
    SourceDef(
        "bigquery",
        "Downtime and cost",
        "query",
        (
            TableDef(
                "downtime_records",
                """
                record_id BIGINT NOT NULL COMMENT 'record number',
                machine_id BIGINT NOT NULL COMMENT 'machine that stood still',
                start_time TIMESTAMP NOT NULL COMMENT 'from',
                end_time TIMESTAMP NOT NULL COMMENT 'to',
                reason STRING NOT NULL COMMENT 'cause',
                category STRING NOT NULL COMMENT 'planned, failure, maintenance or other'
                """,
                ("record_id",),
                "times a machine stood still",
                expected_rows=35,
            ),
            TableDef(
                "cost_allocation",
                """
                allocation_id BIGINT NOT NULL COMMENT 'allocation number',
                machine_id BIGINT NOT NULL COMMENT 'machine charged',
                cost_category STRING NOT NULL COMMENT 'power, maintenance, supplies or labour',
                amount_usd DOUBLE NOT NULL COMMENT 'amount in USD',
                fiscal_quarter STRING NOT NULL COMMENT 'such as 2025-Q1'
                """,
                ("allocation_id",),
                "cost charged to each machine",
                expected_rows=30,
            ),
        ),
    ),
    SourceDef(
        "onelake",
        "Planning",
        "files",
        (
            TableDef(
                "production_plans",
                """
                plan_id BIGINT COMMENT 'plan number',
                machine_id BIGINT COMMENT 'machine planned',
                product_name STRING COMMENT 'product',
                plan_date STRING COMMENT 'ISO date as text',
                target_quantity BIGINT COMMENT 'pieces planned',
                actual_quantity BIGINT COMMENT 'pieces made',
                status STRING COMMENT 'completed or in_progress'
                """,
                ("plan_id",),
                "planned and made quantities",
                expected_rows=20,
            ),
            TableDef(
                "inventory_levels",
                """
                inventory_id BIGINT COMMENT 'record number',
                machine_id BIGINT COMMENT 'machine supplied',
                material_name STRING COMMENT 'material',
                record_date STRING COMMENT 'ISO date as text',
                quantity_on_hand BIGINT COMMENT 'quantity in stock',
                reorder_point BIGINT COMMENT 'order at or below this',
                unit STRING COMMENT 'pcs or kg',
                warehouse_location STRING COMMENT 'warehouse'
                """,
                ("inventory_id",),
                "material in stock",
                expected_rows=30,
            ),
        ),
    ),
    SourceDef(
        "snowflake",
        "Equipment and parts",
        "query",
        (
            TableDef(
                "equipment_specs",
                """
                spec_id INT NOT NULL COMMENT 'record number',
                machine_id INT NOT NULL COMMENT 'machine described',
                manufacturer VARCHAR(50) NOT NULL COMMENT 'maker',
                model_number VARCHAR(30) NOT NULL COMMENT 'model',
                max_rpm DECIMAL(8,1) COMMENT 'highest speed',
                weight_kg DECIMAL(8,1) COMMENT 'weight in kg',
                power_kw DECIMAL(8,1) COMMENT 'rated power in kW',
                install_year INT COMMENT 'year installed'
                """,
                ("spec_id",),
                "technical data of each machine",
                expected_rows=10,
            ),
            TableDef(
                "spare_parts_inventory",
                """
                part_id INT NOT NULL COMMENT 'part record',
                machine_id INT NOT NULL COMMENT 'machine it fits',
                part_name VARCHAR(60) NOT NULL COMMENT 'part',
                part_number VARCHAR(30) NOT NULL COMMENT 'order number',
                quantity_on_hand INT NOT NULL COMMENT 'pieces in stock',
                reorder_point INT NOT NULL COMMENT 'order at or below this',
                unit_cost_usd DECIMAL(10,2) COMMENT 'price per piece in USD',
                last_ordered DATE COMMENT 'last order'
                """,
                ("part_id",),
                "spare parts in stock",
                expected_rows=30,
            ),
        ),
    ),
    SourceDef(
        "snowflake_iceberg",
        "Operating metrics and safety",
        "files",
        (
            TableDef(
                "operational_metrics",
                """
                metric_id INT COMMENT 'record number',
                machine_id INT COMMENT 'machine measured',
                metric_date DATE COMMENT 'day',
                oee_score DOUBLE COMMENT 'overall effectiveness',
                availability_pct DOUBLE COMMENT 'availability',
                performance_pct DOUBLE COMMENT 'performance',
                quality_pct DOUBLE COMMENT 'share of good pieces'
                """,
                ("metric_id",),
                "daily effectiveness",
                expected_rows=50,
            ),
            TableDef(
                "safety_incidents",
                """
                incident_id INT COMMENT 'record number',
                machine_id INT COMMENT 'machine concerned',
                incident_date DATE COMMENT 'day',
                severity STRING COMMENT 'HIGH, MEDIUM or LOW',
                description STRING COMMENT 'what happened',
                corrective_action STRING COMMENT 'what was done',
                resolved BOOLEAN COMMENT 'whether it is closed'
                """,
                ("incident_id",),
                "safety incidents",
                expected_rows=20,
            ),
        ),
    ),
)


def factory_source(key: str) -> SourceDef:
    return next(s for s in FACTORY_SOURCES if s.key == key)


@dataclass(frozen=True)
class Names:
    """Prefixes that make up the three-level name of every factory table."""

    query_prefix: str = "query"
    catalog_prefix: str = "files"
    db_prefix: str = "plant"

    def catalog(self, source: SourceDef) -> str:
        prefix = self.catalog_prefix if source.access == "files" else self.query_prefix
        return f"{prefix}_{source.key}"

    def schema(self, source: SourceDef) -> str:
        # Sources whose schema is not the plain prefix.
        special = {
            "glue": f"{self.db_prefix}_factory_master",
            "bigquery": f"{self.db_prefix}_factory",
            "onelake": "default",
        }
        return special.get(source.key, self.db_prefix)

    def table(self, source: SourceDef, table: str) -> str:
        return qualified(self.catalog(source), self.schema(source), table)


def catalog_sources(
    spark: SparkSession, names: Names | None = None, off: Collection[str] = ()
) -> Sources:
    """All factory tables through the catalogs registered in the session."""
    names = names or Names()
    return _sources(spark, lambda s, t: TableSource.table(names.table(s, t.name), t.split), off)


def file_sources(spark: SparkSession, folder: str, off: Collection[str] = ()) -> Sources:
    """All factory tables as Parquet under ``folder/source/table``, in their declared types."""
    return _sources(
        spark, lambda s, t: TableSource.parquet(f"{folder}/{s.key}/{t.name}", t.ddl), off
    )


def _sources(
    spark: SparkSession,
    reader: Callable[[SourceDef, TableDef], TableSource],
    off: Collection[str],
) -> Sources:
    return Sources(
        {
            f"{s.key}.{t.name}": lambda s=s, t=t: reader(s, t).load(spark)
            for s in FACTORY_SOURCES
            for t in s.tables
        },
        off,
    )
