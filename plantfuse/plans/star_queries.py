"""Every operator as a query over the star-schema tables of a folder.

Each takes (spark, folder) and returns a DataFrame of BIGINT, DOUBLE, STRING
and BOOLEAN columns over the whole of the tables it names.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantfuse.functions import exact_sum, flag, pass_rate, rounded_sum
from plantfuse.operators import (
    bands,
    checks,
    combine,
    compare,
    generate,
    key_filter,
    keys,
    load,
    profile,
    rules,
    totals,
)
from plantfuse.plans import load_job, questions, steps, summaries
from plantfuse.plans.star_model import nation_sources, star_sources, star_table
from plantfuse.session import removed_at_exit, shared_path
from plantfuse.sources import TableDef, TableSource, catalogs, values_frame
from plantfuse.sources.star import STAR_DDL

# Rows expected of each table: a declared number, or what another table leads to
# expect: one row for each key up to the greatest that rows refer to, or a
# declared number of rows for each of the other's. None is counted from the table
# itself. One event per customer and day, a label and half a conversation turn
# per document are declared and not what there is; shipments are declared and not
# delivered.
EXPECTED_ROWS = {
    "region": 5,
    "nation": 25,
    "customer": ("orders", "max(o_custkey) + 1"),
    "supplier": ("lineitem", "max(l_suppkey) + 1"),
    "part": ("lineitem", "max(l_partkey) + 1"),
    "orders": ("lineitem", "max(l_orderkey) + 1"),
    "lineitem": ("orders", "count(*) * 4"),
    "events": ("orders", "count(DISTINCT o_custkey, to_date(o_orderdate))"),
    "documents": ("customer", "greatest(200, count(*) * 2 div 3)"),
    "embeddings": ("documents", "count(*)"),
    "pages": ("documents", "count(*) div 4"),
    "benchmark": ("documents", "greatest(40, count(*) div 50)"),
    "labels": ("documents", "count(*)"),
    "conversations": ("documents", "count(*) div 2"),
    "shipments": ("orders", "max(o_orderkey) + 1"),
}

# Declared constraints, tighter than the data in places.
CONSTRAINTS = {
    "customer": (
        "c_custkey BIGINT NOT NULL, c_name VARCHAR(18) NOT NULL, c_mktsegment VARCHAR(9) NOT NULL",
        ("c_custkey",),
    ),
    "orders": (
        "o_orderkey BIGINT NOT NULL, o_custkey BIGINT NOT NULL, o_orderpriority VARCHAR(10)",
        ("o_orderkey",),
    ),
    "lineitem": (
        "l_orderkey BIGINT NOT NULL, l_linenumber INT NOT NULL",
        ("l_orderkey", "l_linenumber"),
    ),
    "events": ("event_id BIGINT NOT NULL, event_type VARCHAR(5) NOT NULL", ("event_id",)),
}

EVENT_GROUPS = """
    ('click',    'browse',  CAST(1.0 AS DECIMAL(4,1))),
    ('view',     'browse',  CAST(0.5 AS DECIMAL(4,1))),
    ('signup',   'account', CAST(2.0 AS DECIMAL(4,1))),
    ('purchase', 'account', CAST(5.0 AS DECIMAL(4,1)))
"""

EVENT_BANDS = {
    "click": (20.0, 100.0, False),
    "view": (50.0, 200.0, False),
    "purchase": (100.0, 300.0, False),
    "error": (10.0, 5.0, True),
}


def plain(frame: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, decimals as DOUBLE, days and times as text."""

    def column(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return c.cast("long").alias(f.name)
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            return c.cast("string").alias(f.name)
        return c

    return frame.select(*map(column, frame.schema))


# Scans and sources


def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_table(spark, sf_dir, "lineitem")


def cross_source_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a catalog's table with their events, which another source has as files.

    The table is declared over the given files; neither side is copied.
    """
    table = fresh_table(spark, "customer_of_catalog")
    load.create_table(
        spark, table, STAR_DDL["customer"], location=f"{sf_dir}/customer.parquet"
    )
    per_user = totals.totals_by_key(
        "c_custkey",
        totals.Fact(
            star_table(spark, sf_dir, "events"),
            "user_id",
            {"event_count": totals.one(), "total_value": F.col("value")},
        ),
    )
    customers = TableSource.table(table).load(spark).select("c_custkey", "c_name")
    return totals.with_totals(
        customers, "c_custkey", [per_user], zero=("event_count",)
    ).withColumn("total_value", F.round("total_value", 4))


def join_by_key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the urgent open orders of customers in debt, by a filter of these orders' keys.

    The orders are a small part of all; few other lines reach the exact join.
    """
    in_debt = star_table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    orders = star_table(spark, sf_dir, "orders").where(
        "o_orderstatus = 'O' AND o_orderpriority LIKE '1%'"
    )
    urgent = orders.join(in_debt, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(
        "o_orderkey", "o_custkey"
    )
    lines = star_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_extendedprice", "l_quantity"
    )
    near = key_filter.with_partner(lines, ["l_orderkey"], urgent, ["o_orderkey"])
    return (
        near.join(urgent, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(
            F.count("*").alias("line_count"),
            rounded_sum(F.col("l_extendedprice"), 2).alias("price"),
            rounded_sum(F.col("l_quantity"), 2).alias("quantity"),
        )
    )


def inline_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events weighed by a typed inline table; types it lacks are a group without weight."""
    groups = values_frame(spark, EVENT_GROUPS, "event_type, event_group, weight")
    per_type = (
        star_table(spark, sf_dir, "events")
        .groupBy("event_type")
        .agg(F.count("*").alias("n"), exact_sum(F.col("value")).alias("v"))
    )
    return (
        per_type.join(groups, "event_type", "left")
        .groupBy(F.coalesce("event_group", F.lit("other")).alias("event_group"))
        .agg(
            F.sum("n").alias("event_count"),
            rounded_sum(F.col("v") * F.col("weight")).alias("weighted_value"),
        )
    )


# Sinks


def sink_parquet_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "orders")
    stored = load.overwrite_files(star_table(spark, sf_dir, "orders"), path)
    removed_at_exit(spark, path)
    return stored


def sink_external_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "customer")
    load.overwrite_files(star_table(spark, sf_dir, "customer"), path)
    removed_at_exit(spark, path)
    table = fresh_table(spark, "customer_external")
    load.create_table(
        spark, table, STAR_DDL["customer"], location=path, comment="customers kept outside"
    )
    return spark.table(table)


def sink_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inserts by column list; the column they leave out takes its default."""
    table = fresh_table(spark, "order_log")
    load.create_table(
        spark,
        table,
        "o_orderkey BIGINT, o_orderstatus STRING, channel STRING",
        defaults={"channel": "normal"},
    )
    orders = star_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    is_held = F.col("o_orderstatus").eqNullSafe("P")
    load.append_rows(orders.where(is_held).withColumn("channel", F.lit("held")), table)
    return load.append_rows(orders.where(~is_held), table)


def reload_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = fresh_table(spark, "customer_reload")
    load.create_table(spark, table, STAR_DDL["customer"])
    customer = star_table(spark, sf_dir, "customer")
    load.append_rows(customer.where("c_acctbal < 0"), table)
    return load.reload_table(customer, table)


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt are there already; two batches bring everyone."""
    table = fresh_table(spark, "customer_insert")
    load.create_table(spark, table, "c_custkey BIGINT, c_name STRING, batch INT")
    customer = star_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")

    def batch(frame: DataFrame, number: int, label: str) -> DataFrame:
        return frame.select(
            "c_custkey",
            F.concat(F.lit(label), "c_name").alias("c_name"),
            F.lit(number).alias("batch"),
        )

    load.append_rows(batch(customer.where("c_acctbal < 0"), 0, "kept "), table)
    incoming = batch(customer, 2, "second ").unionByName(batch(customer, 1, "first "))
    return load.insert_if_absent(incoming, table, ["c_custkey"], [F.col("batch")])


def surrogate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = star_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    path = shared_path(spark, "orders-by-day")
    numbered = keys.with_generated_key(orders, "log_id", ["o_orderdate", "o_orderkey"], path)
    removed_at_exit(spark, path)
    return numbered.select("log_id", "o_orderkey")


def apply_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    readings = star_table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "click", "warning").when(kind == "error", "critical").alias("status"),
    )
    return load.apply_defaults(readings, {"status": "normal", "defect_count": 0})


def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health summary as a table created or replaced by its query."""
    table = fresh_table(spark, "machine_health_summary")
    return load.save_summary(machine_health_summary(spark, sf_dir), table)


def operations_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations summary as a table created or replaced by its query."""
    table = fresh_table(spark, "factory_operations_union")
    return load.save_summary(_operations(spark, sf_dir), table)


def stored_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five questions asked of the two stored tables, one row for each answer."""
    health = summary_table(spark, sf_dir)
    operations = operations_table(spark, sf_dir)
    answers = {
        "top_anomaly": questions.most_anomalies(operations).select(
            F.col("machine_name").alias("subject"), F.col("anomaly_count").alias("answer")
        ),
        "pass_rate_by_line": questions.pass_rate_by_line(health).select(
            F.col("production_line").alias("subject"), F.col("quality_pass_rate_pct").alias("answer")
        ),
        "top_maintenance": questions.longest_maintenance(health).limit(1).select(
            F.col("machine_name").alias("subject"),
            F.col("total_maintenance_minutes").alias("answer"),
        ),
        "top_energy": questions.highest_energy_cost(operations).limit(1).select(
            F.col("machine_name").alias("subject"), F.col("energy_cost_usd").alias("answer")
        ),
        "filter_factory": operations.where("factory = 7").select(
            F.col("machine_name").alias("subject"), F.col("sensor_reading_count").alias("answer")
        ),
    }
    return reduce(
        DataFrame.unionByName,
        [
            answer.select(F.lit(name).alias("question"), "subject", F.col("answer").cast("double"))
            for name, answer in answers.items()
        ],
    )


def load_and_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tables created, loaded, checked and counted, and what they then hold.

    Log numbers are given on the way in. ``key_sum`` and ``value_sum`` add up a
    key and what depends on it, so that a wrong row shows.
    """
    orders, events = (star_table(spark, sf_dir, t) for t in ("orders", "events"))
    logs = TableDef(
        "logs",
        "log_id BIGINT NOT NULL, machine_id BIGINT NOT NULL, order_id BIGINT NOT NULL",
        key=("log_id",),
        generated_key="log_id",
    )
    readings = TableDef(
        "readings",
        "reading_id BIGINT NOT NULL, machine_id BIGINT NOT NULL, status VARCHAR(20)",
        key=("reading_id",),
        defaults={"status": "normal"},
    )
    tables = [
        (
            logs,
            orders.select(
                F.col("o_custkey").alias("machine_id"), F.col("o_orderkey").alias("order_id")
            ),
        ),
        (
            readings,
            events.select(
                F.col("event_id").alias("reading_id"), F.col("user_id").alias("machine_id")
            ),
        ),
        *[
            (TableDef(t, STAR_DDL[t], key=(key,)), star_table(spark, sf_dir, t))
            for t, key in (("part", "p_partkey"), ("supplier", "s_suppkey"))
        ],
    ]
    schema = f"plantfuse_load_{uuid.uuid4().hex}"
    report = load_job.load_tables(spark, schema, tables).drop("message")
    held = {
        "logs": ("log_id", "log_id * 3 + machine_id * 2 + order_id"),
        "readings": ("reading_id", "reading_id * 2 + machine_id + length(status)"),
        "part": ("p_partkey", "p_partkey * 2 + p_size + length(p_name) + length(p_brand)"),
        "supplier": ("s_suppkey", "s_suppkey * 2 + s_nationkey + length(s_name)"),
    }
    found = reduce(
        DataFrame.unionByName,
        [
            spark.table(f"{schema}.{name}")
            .agg(
                F.min(key).cast("long").alias("least_key"),
                F.max(key).cast("long").alias("greatest_key"),
                F.count_distinct(key).alias("distinct_keys"),
                F.sum(F.expr(value).cast("long")).alias("checksum"),
            )
            .withColumn("table_name", F.lit(name))
            for name, (key, value) in held.items()
        ],
    )
    return report.join(found, "table_name")


def reload_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three loads of one table, the middle one refused, and what the table shows after each.

    The second batch holds every customer in debt twice. The rows of the first
    are still shown after it, and read from the first load's own files after
    the third.
    """
    accounts = TableDef(
        "accounts",
        "c_custkey BIGINT NOT NULL, c_name VARCHAR(30) NOT NULL, c_acctbal DOUBLE, origin STRING",
        key=("c_custkey",),
        defaults={"origin": "loaded"},
    )
    customer = star_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    in_debt = customer.where("c_acctbal < 0")
    batches = {
        "first": customer.where("c_acctbal >= 0"),
        "repeated": in_debt.unionByName(in_debt),
        "all": customer.withColumn("origin", F.lit("all")),
    }
    schema = f"plantfuse_load_{uuid.uuid4().hex}"
    load.create_schema(spark, schema)
    shown = []
    for name, batch in batches.items():
        try:
            load_job.load_table(spark, schema, accounts, batch)
            outcome = "published"
        except load_job.LoadError as refusal:
            outcome = str(refusal)
        shown.append(
            spark.table(f"{schema}.accounts").agg(
                F.lit(name).alias("batch"),
                F.lit(outcome).alias("outcome"),
                F.count("*").alias("row_count"),
                F.count_distinct("c_custkey").alias("key_count"),
                F.sum("c_custkey").alias("key_sum"),
                rounded_sum(F.col("c_acctbal"), 2).alias("balance"),
                F.sum(flag(F.col("origin") == "loaded")).alias("by_default"),
            )
        )
    return reduce(DataFrame.unionByName, shown)


def fresh_table(spark: SparkSession, name: str) -> str:
    """A table name not used before, in a schema under the shared folder."""
    load.create_schema(spark, "plantfuse")
    return f"plantfuse.{name}_{uuid.uuid4().hex}"


# Checks and metadata


def constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            checks.constraint_violations(star_table(spark, sf_dir, t), t, ddl, key)
            for t, (ddl, key) in CONSTRAINTS.items()
        ],
    )


def data_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [_stored_dictionary(spark, sf_dir, t) for t in ("customer", "orders")],
    )


def _stored_dictionary(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Of a table made with comments over the given files; types and comments are read back."""
    table = fresh_table(spark, f"{name}_commented")
    load.create_table(spark, table, STAR_DDL[name], location=f"{sf_dir}/{name}.parquet")
    stored = spark.table(table)
    comments = load.column_comments(spark, table)
    ddl = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()} COMMENT {load.literal(comments.get(f.name, ''))}"
        for f in stored.schema
    )
    return checks.data_dictionary(stored, name, ddl)


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of lines, kept by two loads and merged, beside exact counts.

    A sketch is held to its error: 5 % of the different values, 2 % of the rows
    below the median. Two loads merged must say what one profile of both says.
    """
    columns = ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]
    lines = star_table(spark, sf_dir, "lineitem").select(columns)
    kept = []
    for load_number in range(2):
        path = shared_path(spark, "line-profile")
        batch = lines.where(F.col("l_orderkey") % 2 == load_number)
        kept.append(load.overwrite_files(profile.column_profile(batch, columns), path))
        removed_at_exit(spark, path)
    whole = profile.merged(profile.column_profile(lines, columns))
    at_once = profile.estimates(whole).select(
        F.col("column_name").alias("of_column"), F.col("distinct_count").alias("at_once")
    )
    found = profile.estimates(profile.merged(*kept), [0.5]).join(
        at_once, F.col("column_name") == F.col("of_column")
    )
    exact = reduce(
        DataFrame.unionByName,
        [
            lines.groupBy(F.col(c).alias("v"))
            .agg(F.count("*").alias("n"))
            .agg(F.count("v").alias("exact_count"))
            .withColumn("exact_column", F.lit(c))
            for c in columns
        ],
    )
    medians = found.where("quantiles IS NOT NULL").select(
        F.col("column_name").alias("median_column"), F.get("quantiles", F.lit(0)).alias("median")
    )
    # Each number against its column's median: three rows, whatever the table.
    numbers = lines.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v"))
                    for c in ("l_orderkey", "l_quantity", "l_extendedprice")
                ]
            )
        )
    )
    ranks = (
        numbers.join(F.broadcast(medians), F.col("c") == F.col("median_column"))
        .groupBy("c")
        .agg(
            F.avg((F.col("v") < F.col("median")).cast("int")).alias("below"),
            F.avg((F.col("v") <= F.col("median")).cast("int")).alias("up_to"),
        )
    )
    return (
        found.join(exact, F.col("column_name") == F.col("exact_column"))
        .join(ranks, F.col("column_name") == F.col("c"), "left")
        .select(
            "column_name",
            "row_count",
            "null_count",
            "exact_count",
            (F.col("distinct_count") == F.col("at_once")).alias("merged_as_at_once"),
            (F.abs(F.col("distinct_count") - F.col("exact_count")) <= 0.05 * F.col("exact_count"))
            .alias("distinct_within"),
            ((F.col("below") <= 0.52) & (F.col("up_to") >= 0.48)).alias("median_within"),
        )
    )


def row_count_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables against the rows that are declared or that the keys given out lead to expect."""
    counts = checks.table_counts(
        spark, {t: lambda t=t: star_table(spark, sf_dir, t) for t in EXPECTED_ROWS}
    )
    expected = []
    for name, wanted in EXPECTED_ROWS.items():
        if isinstance(wanted, int):
            rows = spark.range(1).select(F.lit(wanted).cast("long").alias("expected_rows"))
        else:
            other, number = wanted
            rows = star_table(spark, sf_dir, other).agg(
                F.expr(number).cast("long").alias("expected_rows")
            )
        expected.append(rows.select(F.lit(name).alias("table_name"), "expected_rows"))
    report = checks.reconcile(counts, reduce(DataFrame.unionByName, expected))
    # The message of what failed is Spark's own, with paths in it.
    return report.drop("message")


def master_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers read as two copies of one numbered master table."""
    left = star_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("nation"),
        (F.col("c_acctbal") < 0).alias("in_debt"),
    )
    right = star_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_nationkey").alias("nation"),
        (F.col("s_acctbal") < 0).alias("in_debt"),
    )
    return combine.copy_differences(left, right, "id", ["nation", "in_debt"])


def copies_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a stored copy that lost, changed and gained a few of them.

    Only rows of key ranges whose hashes differ are brought together.
    """
    columns = ["o_custkey", "o_totalprice", "o_orderstatus"]
    orders = star_table(spark, sf_dir, "orders").select("o_orderkey", *columns)
    key = F.col("o_orderkey")
    amended = orders.where(key % 991 != 3).withColumns(
        {
            "o_totalprice": F.when(key % 997 == 5, F.col("o_totalprice") + 1).otherwise(
                F.col("o_totalprice")
            ),
            "o_orderstatus": F.when(key % 1013 != 8, F.col("o_orderstatus")),
        }
    )
    gained = orders.where(key % 983 == 11).withColumn("o_orderkey", -key)
    path = shared_path(spark, "orders-amended")
    stored = load.overwrite_files(amended.unionByName(gained), path)
    removed_at_exit(spark, path)
    return compare.differences_by_range(orders, stored, "o_orderkey", columns)


# Names and parameters


def param_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table named by session variables."""
    prefix = _name_lineitem(spark, sf_dir)
    return spark.sql(
        f"""
        SELECT l_returnflag, l_linestatus, COUNT(*) AS line_count
        FROM IDENTIFIER({prefix}_name || '_' || {prefix}_fact)
        GROUP BY l_returnflag, l_linestatus
        """
    )


def execute_immediate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement put together from session variables."""
    prefix = _name_lineitem(spark, sf_dir)
    return spark.sql(
        f"""
        EXECUTE IMMEDIATE
        'SELECT l_returnflag,
                SUM(CASE WHEN l_linestatus = \\'O\\' THEN 1 ELSE 0 END) AS open_lines,
                SUM(CAST(rint(l_quantity) AS BIGINT)) AS total_quantity
         FROM ' || {prefix}_name || '_' || {prefix}_fact || '
         GROUP BY l_returnflag'
        """
    )


def _name_lineitem(spark: SparkSession, sf_dir: str) -> str:
    """A view of lineitem and variables that name it, under names no caller has."""
    prefix = f"plantfuse_{uuid.uuid4().hex}"
    star_table(spark, sf_dir, "lineitem").createOrReplaceTempView(f"{prefix}_lineitem")
    spark.sql(f"DECLARE VARIABLE {prefix}_name STRING DEFAULT '{prefix}'")
    spark.sql(f"DECLARE VARIABLE {prefix}_fact STRING DEFAULT 'lineitem'")
    return prefix


# Aggregates and unions


def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        star_table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.count("*").alias("event_count"), rounded_sum(F.col("value")).alias("total_value"))
    )


def conditional_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return (
        star_table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            F.sum(flag(kind == "click")).alias("warnings"),
            F.sum(flag(kind == "error")).alias("criticals"),
            rounded_sum(F.when(kind == "purchase", F.col("value")).otherwise(0)).alias(
                "purchase_value"
            ),
        )
    )


def pass_rate_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        star_table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count("*").alias("total"), F.sum(flag(F.col("o_orderstatus") == "F")).alias("passed")
        )
        .withColumn("pass_rate_pct", pass_rate(F.col("passed"), F.col("total")))
    )


def union_all_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = summaries.inspection_facts(star_sources(spark, sf_dir))
    return totals.totals_by_key("machine_id", *facts)


def union_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = star_sources(spark, sf_dir)
    tables = {name.split(".")[0]: sources.first(name) for name in summaries.INSPECTIONS}
    return (
        combine.union_with_source(tables, ["machine_id", "result", "defect_count"])
        .groupBy("source", "result")
        .agg(F.count("*").alias("inspection_count"), F.sum("defect_count").alias("defect_count"))
    )


def file_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written in three batches, counted by the files that Spark reads them from."""
    path = removed_at_exit(spark, shared_path(spark, "orders-by-batch"))
    orders = star_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    for status in ("F", "O", "P"):
        orders.where(F.col("o_orderstatus") == status).write.mode("append").parquet(path)
    stored = combine.with_file_source(spark.read.schema(orders.schema).parquet(path))
    by_file = stored.groupBy("source_file", "source_time").agg(
        F.count("*").alias("row_count"),
        F.sum("o_orderkey").alias("key_sum"),
        F.min("o_orderstatus").alias("batch"),
        F.count_distinct("o_orderstatus").alias("batches"),
    )
    return by_file.groupBy("batch").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("key_sum").alias("key_sum"),
        F.sum(flag(F.col("batches") > 1)).alias("mixed_files"),
        (F.min("source_time") > F.lit("2000-01-01").cast("timestamp")).alias("dated"),
    )


# Summary tables


def machine_health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.machine_health_summary(star_sources(spark, sf_dir))


def health_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.health_ranked(machine_health_summary(spark, sf_dir))


def factory_operations_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _operations(spark, sf_dir).orderBy("machine_id")


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.factory_operations_union(star_sources(spark, sf_dir))


def fanout_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.maintenance_summary(star_sources(spark, sf_dir))


def fanout_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.energy_summary(star_sources(spark, sf_dir))


def fanout_downtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.downtime_summary(nation_sources(spark, sf_dir))


def fallback_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.machine_health_summary(star_sources(spark, sf_dir, off=("glue",)))


# One measure of each step, to be added up over all machines.
STEP_MEASURE = {
    "machine_health_summary": "total_inspection_count",
    "maintenance_summary": "work_order_count",
    "energy_summary": "total_kwh",
    "downtime_summary": "total_allocated_cost_usd",
    "factory_operations_union": "sensor_reading_count",
}


def steps_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps that run without some sources, each with a total to show for it."""
    rows = []
    for label, off in {"no_master": ("glue",), "no_lines": ("redshift", "bigquery")}.items():
        runnable = steps.runnable_steps(star_sources(spark, sf_dir, off))
        for name, frame in runnable.items():
            measure = rounded_sum(F.col(STEP_MEASURE[name]), 2).alias("measure_total")
            rows.append(
                frame.agg(F.count("*").alias("machine_count"), measure).select(
                    F.lit(label).alias("sources"), F.lit(name).alias("step"), "*"
                )
            )
    return reduce(DataFrame.unionByName, rows)


# Questions


def q_top_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.most_anomalies(_operations(spark, sf_dir))


def q_pass_rate_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.pass_rate_by_line(machine_health_summary(spark, sf_dir))


def q_top_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.longest_maintenance(machine_health_summary(spark, sf_dir))


def q_top_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.highest_energy_cost(_operations(spark, sf_dir))


def q_filter_factory(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = star_sources(spark, sf_dir)
    return summaries.factory_operations_union(sources, F.col("factory") == 7)


# Rules


def classify_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = rules.band(F.col("event_type"), F.col("value"), EVENT_BANDS)
    return star_table(spark, sf_dir, "events").select("event_id", graded.alias("band"))


def bands_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the part whose price is the next not above theirs, among parts of one type.

    The bands are the different prices of each type of part.
    """
    part = star_table(spark, sf_dir, "part")
    priced = part.groupBy(F.col("p_type").alias("kind"), F.col("p_retailprice").alias("bound"))
    prices = priced.agg(F.min("p_partkey").alias("label"))
    lines = star_table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice")
    typed = lines.join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    # A hundredth of a line price, so that prices of lines and parts overlap.
    found = bands.graded(
        typed.withColumn("price", F.col("l_extendedprice") / 100), "p_type", "price", prices
    )
    return found.groupBy("p_type", "band").agg(F.count("*").alias("line_count"))


def reorder_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_type")
    stock = star_table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_size").alias("quantity_on_hand"),
        F.when(kind == "ECONOMY", 10).when(kind == "PROMO", 20).otherwise(5).alias("reorder_point"),
    )
    return rules.at_or_below_reorder_point(stock, "quantity_on_hand", "reorder_point")


def secured_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.secured_view(
        star_table(spark, sf_dir, "customer"),
        f"customer_secured_{uuid.uuid4().hex}",
        visible=F.col("c_acctbal") >= 0,
        masks={"c_name": F.concat(F.lit("***"), F.right("c_name", F.lit(3)))},
        hidden=("c_acctbal",),
    )


def stored_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers behind a kept view, read by another session of the same user.

    The user's grant shows balances from 0 on, without names.
    """
    table, grants, view = (
        fresh_table(spark, name) for name in ("customer_kept", "customer_grants", "customer_view")
    )
    load.create_table(spark, table, STAR_DDL["customer"], location=f"{sf_dir}/customer.parquet")
    load.create_table(spark, grants, "user_name STRING, least DOUBLE, unmasked BOOLEAN")
    load.append_rows(
        spark.range(1).select(
            F.current_user().alias("user_name"),
            F.lit(0.0).alias("least"),
            F.lit(False).alias("unmasked"),
        ),
        grants,
    )
    rules.stored_secured_view(
        spark,
        view,
        table,
        grants,
        visible="c_acctbal",
        masks={"c_name": "concat('***', right(c_name, 3))"},
        hidden=("c_acctbal",),
    )
    return spark.newSession().table(view)


def table_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table from its making to its drop, as the catalog tells it.

    Each step is a row with what the catalog says then: whether the table is
    listed, its tier, and its rows.
    """
    nations = star_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    table = fresh_table(spark, "nation_life")
    name = table.partition(".")[2]
    told = []

    def tell(step: str) -> None:
        listed = catalogs.tables_like(spark, "plantfuse", name).count()
        tier = rows = None
        if listed:
            found = catalogs.properties(spark, table).where("key = 'tier'").first()
            tier = found.value if found else None
            rows = spark.table(table).count()
        told.append((step, listed, tier, rows))

    tell("before")
    load.create_versioned_table(
        nations.where("n_nationkey < 10"), table, "parquet", {"tier": "bronze"}
    )
    tell("created")
    load.append_rows(nations.where("n_nationkey >= 10"), table)
    load.set_properties(spark, table, {"tier": "silver"})
    tell("appended")
    load.reload_table(nations.where("n_nationkey >= 20"), table)
    tell("reloaded")
    load.drop_table(spark, table)
    tell("dropped")
    return spark.createDataFrame(told, "step STRING, listed BIGINT, tier STRING, row_count BIGINT")


# Generators, one row per row of a table


def generate_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.production_plans(_index(spark, sf_dir, "part", "p_partkey"))


def generate_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.inventory_levels(_index(spark, sf_dir, "customer", "c_custkey"))


def generate_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.quality_inspections(_index(spark, sf_dir, "events", "event_id"))


def _index(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    return star_table(spark, sf_dir, table).select((F.col(key) + 1).alias("id"))


QUERIES = {
    "scan_parquet": scan_parquet,
    "cross_source_join": cross_source_join,
    "join_by_key_filter": join_by_key_filter,
    "inline_values": inline_values,
    "sink_parquet_overwrite": sink_parquet_overwrite,
    "sink_external_table": sink_external_table,
    "sink_append": sink_append,
    "reload_full": reload_full,
    "insert_if_absent": insert_if_absent,
    "surrogate_key": surrogate_key,
    "apply_defaults": apply_defaults,
    "summary_table": summary_table,
    "operations_table": operations_table,
    "stored_questions": stored_questions,
    "load_and_check": load_and_check,
    "reload_checked": reload_checked,
    "constraint_check": constraint_check,
    "data_dictionary": data_dictionary,
    "column_profile": column_profile,
    "row_count_reconcile": row_count_reconcile,
    "master_diff": master_diff,
    "copies_by_range": copies_by_range,
    "param_identifier": param_identifier,
    "execute_immediate": execute_immediate,
    "group_count": group_count,
    "conditional_agg": conditional_agg,
    "pass_rate": pass_rate_by_customer,
    "union_all_quality": union_all_quality,
    "union_provenance": union_provenance,
    "file_provenance": file_provenance,
    "machine_health_summary": machine_health_summary,
    "health_ranked": health_ranked,
    "factory_operations_union": factory_operations_union,
    "fanout_maintenance": fanout_maintenance,
    "fanout_energy": fanout_energy,
    "fanout_downtime": fanout_downtime,
    "fallback_source": fallback_source,
    "steps_by_source": steps_by_source,
    "q_top_anomaly": q_top_anomaly,
    "q_pass_rate_by_line": q_pass_rate_by_line,
    "q_top_maintenance": q_top_maintenance,
    "q_top_energy": q_top_energy,
    "q_filter_factory": q_filter_factory,
    "classify_bands": classify_bands,
    "bands_by_table": bands_by_table,
    "reorder_alert": reorder_alert,
    "secured_view": secured_view,
    "stored_view": stored_view,
    "table_life": table_life,
    "generate_plans": generate_plans,
    "generate_inventory": generate_inventory,
    "generate_inspections": generate_inspections,
}


def star_queries():
    def checked(query):
        return lambda spark, sf_dir: plain(query(spark, sf_dir))

    return {name: checked(query) for name, query in QUERIES.items()}
