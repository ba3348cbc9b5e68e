"""Calendar variables bound per row.

The service computes ten dates from the wall clock of each call.  Here the
anchor is a column (the request's own date), so a table of requests from
many days resolves each row against its own calendar in one projection.
Weeks run Monday..Sunday, "last week" is the previous calendar week and
semesters are Jan-Jun / Jul-Dec.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALENDAR_FIELDS = [
    "today", "yesterday", "last_week_start", "last_week_end", "week_start",
    "week_end", "month_start", "month_end", "semester_start", "semester_end",
]


def calendar_bounds(anchor: Column) -> Column:
    """STRUCT of the ten calendar dates for a DATE column."""
    d = anchor
    week_start = F.date_sub(d, F.weekday(d))
    first_half = F.month(d) <= 6
    y = F.year(d)
    return F.struct(
        d.alias("today"),
        F.date_sub(d, 1).alias("yesterday"),
        F.date_sub(week_start, 7).alias("last_week_start"),
        F.date_sub(week_start, 1).alias("last_week_end"),
        week_start.alias("week_start"),
        F.date_add(week_start, 6).alias("week_end"),
        F.trunc(d, "MM").alias("month_start"),
        F.last_day(d).alias("month_end"),
        F.when(first_half, F.make_date(y, F.lit(1), F.lit(1)))
         .otherwise(F.make_date(y, F.lit(7), F.lit(1))).alias("semester_start"),
        F.when(first_half, F.make_date(y, F.lit(6), F.lit(30)))
         .otherwise(F.make_date(y, F.lit(12), F.lit(31))).alias("semester_end"),
    )


def calendar_strings(cal: Column) -> Column:
    """The same struct with ISO ``yyyy-MM-dd`` strings (service output form)."""
    return F.struct(*[F.date_format(cal[f], "yyyy-MM-dd").alias(f) for f in CALENDAR_FIELDS])
