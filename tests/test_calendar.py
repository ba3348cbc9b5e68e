"""Calendar variables: published golden, edge dates and a multi-year sweep."""

import calendar
from datetime import date, timedelta

from pyspark.sql import functions as F

from fretelens.functions.calendar import CALENDAR_FIELDS, calendar_bounds

GOLDEN = {
    date(2025, 10, 23): ("2025-10-22", "2025-10-13", "2025-10-19", "2025-10-20", "2025-10-26", "2025-10-01",
                         "2025-10-31", "2025-07-01", "2025-12-31"),
    date(2025, 1, 1): ("2024-12-31", "2024-12-23", "2024-12-29", "2024-12-30", "2025-01-05", "2025-01-01",
                       "2025-01-31", "2025-01-01", "2025-06-30"),
    date(2024, 2, 29): ("2024-02-28", "2024-02-19", "2024-02-25", "2024-02-26", "2024-03-03", "2024-02-01",
                        "2024-02-29", "2024-01-01", "2024-06-30"),
    date(2025, 6, 30): ("2025-06-29", "2025-06-23", "2025-06-29", "2025-06-30", "2025-07-06", "2025-06-01",
                        "2025-06-30", "2025-01-01", "2025-06-30"),
}


def expected(d: date) -> dict:
    ws = d - timedelta(days=d.weekday())
    first_half = d.month <= 6
    return {
        "today": d, "yesterday": d - timedelta(days=1),
        "last_week_start": ws - timedelta(days=7), "last_week_end": ws - timedelta(days=1),
        "week_start": ws, "week_end": ws + timedelta(days=6),
        "month_start": d.replace(day=1), "month_end": d.replace(day=calendar.monthrange(d.year, d.month)[1]),
        "semester_start": date(d.year, 1 if first_half else 7, 1),
        "semester_end": date(d.year, 6, 30) if first_half else date(d.year, 12, 31),
    }


def _bounds(spark, days):
    df = spark.createDataFrame([(d,) for d in days], "d date")
    return [r.c.asDict() for r in df.select(calendar_bounds(F.col("d")).alias("c")).collect()]


def test_golden_dates(spark):
    got = _bounds(spark, list(GOLDEN))
    for d, row in zip(GOLDEN, got):
        assert tuple(row[f].isoformat() for f in CALENDAR_FIELDS[1:]) == GOLDEN[d]


def test_sweep_2023_2026(spark):
    days = [date(2023, 1, 1) + timedelta(days=i) for i in range(4 * 366)]
    got = _bounds(spark, days)
    for d, row in zip(days, got):
        assert row == expected(d), d
