"""The factory model over star-schema tables, for measuring and checking at scale.

The tables hold customers, orders, order lines and user events. Each factory
table is a projection of one of them (energy: of lines and their orders).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantfuse.functions import exact_sum
from plantfuse.sources import Sources, TableSource
from plantfuse.sources.star import STAR_DDL

# Inspections before this day belong to the master source, later ones to the line.
SPLIT_DAY = "1998-04-25"


def star_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return TableSource.parquet(f"{sf_dir}/{name}.parquet", STAR_DDL.get(name)).load(spark)


def star_sources(spark: SparkSession, sf_dir: str, off: tuple[str, ...] = ()) -> Sources:
    def table(name: str) -> DataFrame:
        return star_table(spark, sf_dir, name)

    return Sources(
        {
            "glue.machines": lambda: machines(table("customer")),
            "glue.quality_inspections": lambda: inspections(table("orders"), early=True),
            "redshift.quality_inspections": lambda: inspections(table("orders"), early=False),
            "redshift.sensor_readings": lambda: sensor_readings(table("events")),
            "redshift.production_events": lambda: production_events(table("events")),
            "postgres.machines": lambda: machines(table("customer")),
            "postgres.maintenance_logs": lambda: maintenance_logs(table("orders")),
            "postgres.work_orders": lambda: work_orders(table("events")),
            "synapse.shift_schedules": lambda: shift_schedules(table("orders")),
            "synapse.energy_consumption": lambda: energy_consumption(
                table("lineitem"), table("orders")
            ),
            "bigquery.downtime_records": lambda: downtime_records(table("events")),
            "bigquery.cost_allocation": lambda: cost_allocation(table("orders")),
        },
        off,
    )


def nation_sources(spark: SparkSession, sf_dir: str) -> Sources:
    """Nations as machines: few keys, each with a large share of the fact rows."""

    def table(name: str) -> DataFrame:
        return star_table(spark, sf_dir, name)

    return Sources(
        {
            "glue.machines": lambda: table("nation").select(
                F.col("n_nationkey").alias("machine_id"), F.col("n_name").alias("machine_name")
            ),
            "bigquery.downtime_records": lambda: table("supplier").select(
                F.col("s_suppkey").alias("record_id"), F.col("s_nationkey").alias("machine_id")
            ),
            "bigquery.cost_allocation": lambda: table("customer").select(
                F.col("c_nationkey").alias("machine_id"), F.col("c_acctbal").alias("amount_usd")
            ),
        }
    )


def machines(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("machine_id"),
        F.col("c_name").alias("machine_name"),
        F.col("c_mktsegment").alias("production_line"),
        F.col("c_nationkey").alias("factory"),
        F.when(F.col("c_acctbal") < 0, "stopped").otherwise("running").alias("status"),
    )


def inspections(orders: DataFrame, early: bool) -> DataFrame:
    """The orders of one source as inspections; those without a day are the line's."""
    is_early = F.coalesce(
        F.col("o_orderdate") < F.lit(SPLIT_DAY).cast("timestamp_ntz"), F.lit(False)
    )
    return orders.where(is_early if early else ~is_early).select(
        F.col("o_orderkey").alias("inspection_id"),
        F.col("o_custkey").alias("machine_id"),
        inspection_result().alias("result"),
        F.when(F.col("o_orderstatus") == "F", 0)
        .otherwise(F.substring("o_orderpriority", 1, 1).cast("int"))
        .alias("defect_count"),
    )


def inspection_result():
    status = F.col("o_orderstatus")
    return F.when(status == "F", "pass").when(status == "O", "fail").otherwise("warning")


def reading_status():
    kind = F.col("event_type")
    return F.when(kind == "click", "warning").when(kind == "error", "critical").otherwise("normal")


def sensor_readings(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("reading_id"),
        F.col("user_id").alias("machine_id"),
        "value",
        reading_status().alias("status"),
    )


def production_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        "event_id",
        F.col("user_id").alias("machine_id"),
        F.when(kind == "purchase", "maintenance").otherwise(kind).alias("event_type"),
        F.col("value").alias("duration_minutes"),
    )


def maintenance_logs(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("log_id"), F.col("o_custkey").alias("machine_id")
    )


def work_orders(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("order_id"),
        F.col("user_id").alias("machine_id"),
        F.when(kind == "error", "open")
        .when(kind == "view", "in_progress")
        .otherwise("completed")
        .alias("status"),
    )


def shift_schedules(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("shift_id"),
        F.col("o_custkey").alias("machine_id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") + 4)
        .cast("decimal(4,1)")
        .alias("hours_worked"),
    )


def energy_consumption(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One record per order, from its lines.

    The lines are added up by order before the join, which then needs no
    further shuffle of them and meets one row per order, however many lines an
    order has.
    """
    per_order = lineitem.groupBy("l_orderkey").agg(
        exact_sum(F.col("l_quantity")).alias("kwh_consumed"),
        exact_sum(F.col("l_extendedprice")).alias("cost_usd"),
    )
    return per_order.join(
        orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_custkey").alias("machine_id"),
        "kwh_consumed",
        "cost_usd",
    )


def downtime_records(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("record_id"), F.col("user_id").alias("machine_id")
    )


def cost_allocation(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("allocation_id"),
        F.col("o_custkey").alias("machine_id"),
        F.col("o_totalprice").alias("amount_usd"),
    )
