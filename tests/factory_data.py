"""Factory tables made from what each machine's rows add up to.

Every table below is expanded from per-machine counts, so the expected results
in the tests follow from the counts by hand.
"""

from decimal import Decimal

from plantfuse.sources import Sources, rows_frame

# Fixed values of the machine master and of what its facts add up to.
MACHINES = [
    (1, "CNCミル 01", "ライン1", "A棟", "稼働中"),
    (2, "CNCミル 02", "ライン1", "A棟", "稼働中"),
    (3, "CNC旋盤 01", "ライン1", "A棟", "稼働中"),
    (4, "組立ロボット 01", "ライン2", "B棟", "稼働中"),
    (5, "組立ロボット 02", "ライン2", "B棟", "メンテナンス中"),
    (6, "溶接ステーション 01", "ライン2", "B棟", "稼働中"),
    (7, "プレス機 01", "ライン3", "C棟", "稼働中"),
    (8, "プレス機 02", "ライン3", "C棟", "停止中"),
    (9, "検査ユニット 01", "ライン3", "C棟", "稼働中"),
    (10, "梱包ユニット 01", "ライン3", "C棟", "稼働中"),
]

# machine: readings, warnings, criticals
READINGS = {
    1: (24, 0, 1),
    2: (18, 4, 1),
    3: (11, 7, 0),
    4: (13, 0, 0),
    5: (8, 1, 1),
    6: (8, 4, 1),
    7: (5, 0, 3),
    8: (6, 0, 2),
    9: (4, 0, 1),
    10: (3, 0, 0),
}
# machine: events, errors, maintenance minutes
EVENTS = {
    1: (5, 0, 0),
    2: (4, 1, 120),
    3: (2, 0, 0),
    4: (3, 0, 0),
    5: (2, 1, 240),
    6: (2, 0, 0),
    7: (4, 1, 90),
    8: (4, 1, 180),
    9: (2, 0, 0),
    10: (2, 0, 480),
}
# machine: inspections, passed, failed, defects
INSPECTIONS = {
    1: (5, 4, 0, 2),
    2: (5, 3, 1, 5),
    3: (4, 3, 0, 1),
    4: (4, 3, 0, 1),
    5: (4, 1, 1, 5),
    6: (3, 3, 0, 0),
    7: (4, 1, 2, 5),
    8: (5, 1, 3, 12),
    9: (3, 2, 0, 1),
    10: (3, 3, 0, 0),
}
# machine: logs, work orders, open work orders, shifts, hours, kWh, energy USD,
# downtimes, allocated USD
WORK = {
    1: (3, 3, 1, 5, "40.0", "1238.50", "148.62", 5, 6500),
    2: (3, 2, 0, 4, "31.0", "1564.40", "187.73", 4, 8850),
    3: (3, 3, 1, 4, "31.5", "954.60", "114.56", 4, 10290),
    4: (3, 3, 1, 3, "23.0", "792.40", "95.09", 3, 7560),
    5: (3, 3, 1, 4, "32.0", "2140.10", "256.81", 4, 13500),
    6: (3, 3, 1, 4, "31.5", "1408.30", "169.00", 3, 7530),
    7: (3, 2, 0, 4, "30.5", "674.00", "80.88", 3, 3260),
    8: (3, 2, 0, 4, "31.5", "1008.50", "121.02", 3, 7980),
    9: (3, 2, 1, 4, "32.0", "451.20", "54.14", 3, 2340),
    10: (3, 2, 1, 4, "30.0", "844.80", "101.38", 3, 7670),
}
ENERGY_RECORDS, ALLOCATIONS = 5, 3


def spread(total, parts):
    """The total split over that many rows, the remainder in the first."""
    total = Decimal(total)
    share = (total / parts).quantize(total)
    return [total - share * (parts - 1)] + [share] * (parts - 1)


def numbered(per_machine):
    return [(i + 1, *row) for i, row in enumerate(per_machine)]


def readings():
    rows = []
    for m, (n, warnings, criticals) in READINGS.items():
        states = ["warning"] * warnings + ["critical"] * criticals
        rows += [(m, s) for s in states + ["normal"] * (n - len(states))]
    return numbered(rows)


def events():
    rows = []
    for m, (n, errors, minutes) in EVENTS.items():
        own = [(m, "error", 15)] * errors + [(m, "maintenance", minutes)] * (minutes > 0)
        rows += own + [(m, "start", None)] * (n - len(own))
    return numbered(rows)


def inspections():
    rows = []
    for m, (n, passed, failed, defects) in INSPECTIONS.items():
        bad = ["fail"] * failed + ["warning"] * (n - passed - failed)
        found = [int(d) for d in spread(defects, len(bad))] if bad else []
        rows += [(m, "pass", 0)] * passed + [(m, r, d) for r, d in zip(bad, found)]
    return numbered(rows)


def work_tables():
    logs, orders, shifts, energy, downtimes, costs = [], [], [], [], [], []
    for m, (log, order, open_, shift, hours, kwh, usd, down, cost) in WORK.items():
        logs += [(m,)] * log
        orders += [(m, "open")] * open_ + [(m, "completed")] * (order - open_)
        shifts += [(m, h) for h in spread(hours, shift)]
        energy += [
            (m, k, u) for k, u in zip(spread(kwh, ENERGY_RECORDS), spread(usd, ENERGY_RECORDS))
        ]
        downtimes += [(m,)] * down
        costs += [(m, float(c)) for c in spread(cost, ALLOCATIONS)]
    return [numbered(t) for t in (logs, orders, shifts, energy, downtimes, costs)]


def factory_frames(spark):
    logs, orders, shifts, energy, downtimes, costs = work_tables()

    def frame(rows, schema):
        return rows_frame(spark, rows, schema)

    machine_columns = (
        "machine_id INT, machine_name STRING, production_line STRING, factory STRING, status STRING"
    )
    return {
        "postgres.machines": frame(MACHINES, machine_columns),
        "redshift.sensor_readings": frame(
            readings(), "reading_id INT, machine_id INT, status STRING"
        ),
        "redshift.production_events": frame(
            events(), "event_id INT, machine_id INT, event_type STRING, duration_minutes INT"
        ),
        "redshift.quality_inspections": frame(
            inspections(), "inspection_id INT, machine_id INT, result STRING, defect_count INT"
        ),
        "postgres.maintenance_logs": frame(logs, "log_id INT, machine_id INT"),
        "postgres.work_orders": frame(orders, "order_id INT, machine_id INT, status STRING"),
        "synapse.shift_schedules": frame(
            shifts, "shift_id INT, machine_id INT, hours_worked DECIMAL(4,1)"
        ),
        "synapse.energy_consumption": frame(
            energy,
            "record_id INT, machine_id INT, kwh_consumed DECIMAL(8,2), cost_usd DECIMAL(8,2)",
        ),
        "bigquery.downtime_records": frame(downtimes, "record_id BIGINT, machine_id BIGINT"),
        "bigquery.cost_allocation": frame(
            costs, "allocation_id BIGINT, machine_id BIGINT, amount_usd DOUBLE"
        ),
    }


def factory_sources(spark, off=()):
    frames = factory_frames(spark)
    return Sources({name: lambda f=f: f for name, f in frames.items()}, off)
