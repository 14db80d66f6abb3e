"""The questions the summary tables are there to answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantfuse.functions import pass_rate


def health_ranked(health: DataFrame) -> DataFrame:
    return health.orderBy(
        F.desc("sensor_critical_count"), F.desc("error_event_count"), "machine_id"
    )


def most_anomalies(operations: DataFrame, top: int = 1) -> DataFrame:
    """The machines with most critical readings and errors together."""
    return (
        operations.select(
            "machine_id",
            "machine_name",
            (F.col("sensor_criticals") + F.col("error_event_count")).alias("anomaly_count"),
        )
        .orderBy(F.desc("anomaly_count"), "machine_id")
        .limit(top)
    )


def pass_rate_by_line(health: DataFrame) -> DataFrame:
    """From the counts: averaging the machines' percentages would weigh them alike."""
    return (
        health.groupBy("production_line")
        .agg(
            F.sum("passed_inspection_count").alias("passed_inspection_count"),
            F.sum("total_inspection_count").alias("total_inspection_count"),
        )
        .withColumn(
            "quality_pass_rate_pct",
            pass_rate(F.col("passed_inspection_count"), F.col("total_inspection_count")),
        )
    )


def longest_maintenance(health: DataFrame) -> DataFrame:
    return health.select("machine_id", "machine_name", "total_maintenance_minutes").orderBy(
        F.desc("total_maintenance_minutes"), "machine_id"
    )


def highest_energy_cost(operations: DataFrame) -> DataFrame:
    return operations.select("machine_id", "machine_name", "energy_cost_usd").orderBy(
        F.desc("energy_cost_usd"), "machine_id"
    )
