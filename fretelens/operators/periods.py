"""Period binding (C2-C4): phrases -> DE/ATE against the row's calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions.text import LB, RB, ci, fold, fold_py, loose
from . import lexicon as L

_MONTH_ALT = "(" + "|".join(loose(m) for m in D.MONTHS) + ")"
_DMY = r"(\d{1,2}/\d{1,2}/\d{4})"
_TO = r"(?:at[eé]|ao?|e)"

RANGE_DMY = ci(LB + r"(?:de|desde|entre|do\s+dia)\s+" + _DMY + r"\s+" + _TO + r"\s+(?:(?:o\s+)?dia\s+)?" + _DMY + RB)
FROM_DMY = ci(LB + r"(?:a\s+partir\s+d[eo]|desde|depois\s+d[eo])\s+(?:o\s+)?(?:dia\s+)?" + _DMY + RB)
UNTIL_DMY = ci(LB + r"(?:at[eé]|antes\s+d[eo])\s+(?:o\s+)?(?:dia\s+)?" + _DMY + RB)
ISO_DATE = r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)"
SINGLE_DMY = ci(LB + _DMY + RB)
DAYS_OF_MONTH = ci(LB + r"(?:entre|de|do)\s+(?:os\s+dias\s+|o\s+dia\s+|dia\s+)?(\d{1,2})\s+" + _TO
                   + r"\s+(\d{1,2})\s+de\s+" + _MONTH_ALT + r"(?:\s+de\s+(\d{4}))?" + RB)
DAY_OF_MONTH = ci(LB + r"(\d{1,2})\s+de\s+" + _MONTH_ALT + r"(?:\s+de\s+(\d{4}))?" + RB)
NAMED_MONTH = ci(LB + r"(?:em|de|no\s+m[eê]s\s+de|durante)\s+" + _MONTH_ALT + r"(?:\s+de\s+(\d{4}))?" + RB)
LAST_N_DAYS = ci(LB + r"[uú]ltim[oa]s\s+(\d+)\s+dias" + RB)

_NAMED = [
    (ci(LB + r"(?:[uú]ltima\s+semana|semana\s+passada)" + RB), "last_week"),
    (ci(LB + r"(?:n|d)?(?:esta|essa)\s+semana" + RB), "week"),
    (ci(LB + r"(?:n|d)?(?:este|esse)\s+m[eê]s" + RB), "month"),
    (ci(LB + r"(?:n|d)?(?:este|esse)\s+semestre" + RB), "semester"),
    (ci(LB + r"amanh[aã]" + RB), "tomorrow"),
    (ci(LB + r"ontem" + RB), "yesterday"),
    (ci(LB + r"hoje" + RB), "today"),
]


def _span(de: Column, ate: Column) -> Column:
    return F.struct(de.alias("DE"), ate.alias("ATE"))


def _dmy(s: Column) -> Column:
    return F.when(s != "", F.try_to_date(s, "d/M/yyyy"))  # no exception a row for a date that isn't there


def _ymd(y: Column, m: Column, d: Column) -> Column:
    s = F.concat_ws("-", y.cast("string"), m.cast("string"), d.cast("string"))
    return F.try_to_date(s, "yyyy-M-d")


def _month_no(name: Column) -> Column:
    months = F.create_map(*[x for i, m in enumerate(D.MONTHS) for x in (F.lit(fold_py(m)), F.lit(i + 1))])
    return F.element_at(months, fold(name))


def _year_for(month: Column, year_txt: Column, anchor: Column) -> Column:
    """Explicit year, else the latest such month not after the anchor."""
    implied = F.when(month <= F.month(anchor), F.year(anchor)).otherwise(F.year(anchor) - 1)
    return F.coalesce(F.when(year_txt != "", year_txt.try_cast("int")), implied)


def _written(text: Column, pattern: str, folded: Column | L.Held | None, *literals: str) -> Column:
    """Whether ``pattern`` occurs; given the folded text, only looked for beside one of the literals it needs."""
    return text.rlike(pattern) if folded is None else L.may_hold(folded, literals) & text.rlike(pattern)


MONTHS_FOLDED = tuple(fold_py(m) for m in D.MONTHS)


def explicit_range(text: Column, anchor: Column, folded: Column | L.Held | None = None) -> Column:
    """Explicit dates.  STRUCT(DE, ATE) or NULL; an open range leaves its other end NULL.  What is
    written as a range never collapses to one of its dates.  ``folded``: the folded text, or that of a
    longer one."""
    r1 = _span(_dmy(F.regexp_extract(text, RANGE_DMY, 1)), _dmy(F.regexp_extract(text, RANGE_DMY, 2)))
    m2 = _month_no(F.regexp_extract(text, DAYS_OF_MONTH, 3))
    y2 = _year_for(m2, F.regexp_extract(text, DAYS_OF_MONTH, 4), anchor)
    r2 = _span(_ymd(y2, m2, F.regexp_extract(text, DAYS_OF_MONTH, 1)),
               _ymd(y2, m2, F.regexp_extract(text, DAYS_OF_MONTH, 2)))
    from_d = _dmy(F.regexp_extract(text, FROM_DMY, 1))
    until_d = _dmy(F.regexp_extract(text, UNTIL_DMY, 1))
    single = F.array_distinct(F.regexp_extract_all(text, F.lit(SINGLE_DMY), 1))
    d3 = F.when(F.size(single) == 1, _dmy(single[0]))  # two dates that no range word joins name no period
    m4 = _month_no(F.regexp_extract(text, DAY_OF_MONTH, 2))
    d4 = _ymd(_year_for(m4, F.regexp_extract(text, DAY_OF_MONTH, 3), anchor), m4,
              F.regexp_extract(text, DAY_OF_MONTH, 1))
    open_end = F.lit(None).cast("date")
    return (
        F.when(_written(text, RANGE_DMY, folded, "/"), F.when(r1.DE <= r1.ATE, r1))
        .when(_written(text, DAYS_OF_MONTH, folded, *MONTHS_FOLDED), F.when(r2.DE <= r2.ATE, r2))
        .when(_written(text, FROM_DMY, folded, "/"), F.when(from_d.isNotNull(), _span(from_d, open_end)))
        .when(_written(text, UNTIL_DMY, folded, "/"), F.when(until_d.isNotNull(), _span(open_end, until_d)))
        .when(_written(text, SINGLE_DMY, folded, "/"), F.when(d3.isNotNull(), _span(d3, d3)))
        .when(_written(text, DAY_OF_MONTH, folded, *MONTHS_FOLDED), F.when(d4.isNotNull(), _span(d4, d4)))
    )


def invalid_range(text: Column, explicit: Column, folded: Column | L.Held | None = None) -> Column:
    """An explicit range or date is written, but gives no period (an impossible date, ends out of order, two loose dates)."""
    written = _written(text, SINGLE_DMY, folded, "/") | _written(text, RANGE_DMY, folded, "/") | _written(text, DAYS_OF_MONTH, folded, *MONTHS_FOLDED)
    return explicit.isNull() & written


def named_period(text: Column, cal: Column, anchor: Column, folded: Column | L.Held | None = None) -> Column:
    """C2 + C4: calendar words, last N days, a named month (``folded`` as in :func:`explicit_range`)."""
    spans = {
        "last_week": _span(cal.last_week_start, cal.last_week_end),
        "week": _span(cal.week_start, cal.week_end),
        "month": _span(cal.month_start, cal.month_end),
        "semester": _span(cal.semester_start, cal.semester_end),
        "tomorrow": _span(F.date_add(anchor, 1), F.date_add(anchor, 1)),
        "yesterday": _span(cal.yesterday, cal.yesterday),
        "today": _span(cal.today, cal.today),
    }
    n = F.regexp_extract(text, LAST_N_DAYS, 1)
    n = F.when(n != "", n.try_cast("int"))
    # no date lies before year 1
    n = F.when(n <= F.datediff(anchor, F.lit("0001-01-01").cast("date")), n)
    last_n = _span(F.date_sub(anchor, n - 1), anchor)
    mm = _month_no(F.regexp_extract(text, NAMED_MONTH, 1))
    yy = _year_for(mm, F.regexp_extract(text, NAMED_MONTH, 2), anchor)
    first = _ymd(yy, mm, F.lit(1))
    month_span = _span(first, F.last_day(first))
    needs = {"last_week": ["semana"], "week": ["semana"], "month": ["mes"], "semester": ["semestre"], "tomorrow": ["amanh"], "yesterday": ["ontem"], "today": ["hoje"]}
    out = F.when(_written(text, LAST_N_DAYS, folded, "ltim") & (n > 0), last_n)
    for pattern, key in _NAMED[:4]:
        out = out.when(_written(text, pattern, folded, *needs[key]), spans[key])
    out = out.when(_written(text, NAMED_MONTH, folded, *MONTHS_FOLDED) & first.isNotNull(), month_span)
    for pattern, key in _NAMED[4:]:
        out = out.when(_written(text, pattern, folded, *needs[key]), spans[key])
    return out


def mask_periods(text: Column) -> Column:
    """Blank every period phrase (one pass, longest alternatives first)."""
    parts = [RANGE_DMY, DAYS_OF_MONTH, FROM_DMY, UNTIL_DMY, SINGLE_DMY, DAY_OF_MONTH, LAST_N_DAYS, NAMED_MONTH] + [p for p, _ in _NAMED]
    return F.regexp_replace(text, L.combine(parts), " ")
