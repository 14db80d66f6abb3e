"""Rows made by formula from an index column, in parallel and repeatably."""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the generated tables.
PLAN_START = "2024-01-08"
PRODUCTS = ["Widget-A", "Widget-B", "Gear-X", "Gear-Y", "Shaft-S1"]
PLANS_COMPLETED = 15

STOCK_START = "2024-01-10"
MATERIALS = [
    "Steel-Rod",
    "Copper-Wire",
    "Aluminum-Sheet",
    "Rubber-Seal",
    "Bearing-6205",
    "Lubricant-G3",
]
MIN_STOCK = 50
REORDER_POINT = 100

MACHINE_COUNT = 10

INSPECTION_START = "2025-01-15 06:00:00"
INSPECTION_HOURS = 720
INSPECTORS = ["田中", "鈴木", "山本", "渡辺", "小林"]
RESULTS = ["pass", "pass", "pass", "pass", "fail", "warning"]
MAX_DEFECTS = 5
NOTES = {
    "pass": [
        "全パラメータが許容範囲内",
        "不良なし",
        "品質OK",
        "目視・寸法検査合格",
        "表面仕上げ良好",
    ],
    "fail": ["寸法公差超過", "表面欠陥を検出", "材料硬度が仕様未満", "溶接強度不足"],
    "warning": [
        "軽微な表面傷あり",
        "振動値がボーダーライン",
        "わずかな変色を確認",
        "工具摩耗が限界に近い",
    ],
}


# The Gregorian calendar's cycle.
CYCLE_YEARS, CYCLE_DAYS = 400, 146_097


def cycle(index: Column, values: list[str]) -> Column:
    """The value at a 1-based index, starting over after the last."""
    place = F.pmod(index - 1, F.lit(len(values))).cast("int") + 1
    return F.element_at(F.array(*map(F.lit, values)), place)


def day_after(start: str, days: Column) -> Column:
    """The day as text, for a BIGINT number of days not before 1970; years past
    9999 have more digits.

    The calendar repeats every 400 years, so the day is that of the first such
    cycle, which any DATE can hold, with the cycles' years added.
    """
    since = F.unix_date(F.lit(start).cast("date")).cast("long") + days
    first = F.date_from_unix_date(F.pmod(since, F.lit(CYCLE_DAYS)).cast("int"))
    year = F.year(first) + F.floor(since / CYCLE_DAYS) * CYCLE_YEARS
    return F.concat(year.cast("string"), F.date_format(first, "-MM-dd"))


def production_plans(index: DataFrame, i: str = "id") -> DataFrame:
    """A plan per index 1, 2, ...: machine and product in turn, every other day."""
    n = F.col(i).cast("long")
    target = 100 + n * 15
    return index.select(
        n.alias("plan_id"),
        (F.pmod(n - 1, F.lit(MACHINE_COUNT)) + 1).alias("machine_id"),
        cycle(n, PRODUCTS).alias("product_name"),
        day_after(PLAN_START, (n - 1) * 2).alias("plan_date"),
        target.alias("target_quantity"),
        (target - F.pmod(n * 7, F.lit(30))).alias("actual_quantity"),
        F.when(n <= PLANS_COMPLETED, "completed").otherwise("in_progress").alias("status"),
    )


def inventory_levels(index: DataFrame, i: str = "id") -> DataFrame:
    """A stock record per index 1, 2, ...: falling stock, never below a minimum."""
    n = F.col(i).cast("long")
    material = cycle(n, MATERIALS)
    by_piece = material.contains("Bearing") | material.contains("Seal")
    return index.select(
        n.alias("inventory_id"),
        (F.pmod(n - 1, F.lit(MACHINE_COUNT)) + 1).alias("machine_id"),
        material.alias("material_name"),
        day_after(STOCK_START, n - 1).alias("record_date"),
        F.greatest(500 - n * 12, F.lit(MIN_STOCK).cast("long")).alias("quantity_on_hand"),
        F.lit(REORDER_POINT).cast("long").alias("reorder_point"),
        F.when(by_piece, "pcs").otherwise("kg").alias("unit"),
        F.concat(F.lit("WH-"), F.char(F.lit(65) + F.pmod(n, F.lit(4)))).alias("warehouse_location"),
    )


def quality_inspections(index: DataFrame, seed: int = 42, i: str = "id") -> DataFrame:
    """A random-looking inspection per index.

    The draws come from a hash of seed and index, so a row is the same however
    the index is partitioned and whenever a task is repeated. Passes are four
    times as likely as fails or warnings; only the latter have defects.
    """
    n = F.col(i).cast("long")
    text = F.concat_ws(":", F.lit(seed).cast("string"), n.cast("string"))
    # Fifteen hex digits make a whole number below 2**60; its digits in a mixed
    # base are the draws.
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    bases = {
        "machine": MACHINE_COUNT,
        "inspector": len(INSPECTORS),
        "hours": INSPECTION_HOURS + 1,
        "result": len(RESULTS),
        "defects": MAX_DEFECTS,
        "note": lcm(*map(len, NOTES.values())),
    }
    taken, draw = 1, {}
    for name, base in bases.items():
        draw[name] = F.expr(f"number DIV {taken} % {base}")
        taken *= base

    drawn = index.select(n.alias("inspection_id"), number.alias("number")).select(
        "inspection_id",
        (draw["machine"] + 1).alias("machine_id"),
        cycle(draw["inspector"] + 1, INSPECTORS).alias("inspector_name"),
        F.timestamp_add(
            "HOUR", draw["hours"], F.lit(INSPECTION_START).cast("timestamp_ntz")
        ).alias("inspection_time"),
        cycle(draw["result"] + 1, RESULTS).alias("result"),
        (draw["defects"] + 1).alias("defects"),
        (draw["note"] + 1).alias("note"),
    )
    result = F.col("result")
    return drawn.select(
        "inspection_id",
        "machine_id",
        "inspector_name",
        "inspection_time",
        "result",
        F.when(result == "pass", 0).otherwise(F.col("defects")).alias("defect_count"),
        F.coalesce(
            *[F.when(result == r, cycle(F.col("note"), notes)) for r, notes in NOTES.items()]
        ).alias("notes"),
    )
