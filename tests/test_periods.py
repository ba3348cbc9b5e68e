"""Period binding edge cases."""

from datetime import date, datetime

from pyspark.sql import functions as F

from fretelens.operators.parse import parse_requests

SCHEMA = "request_id bigint, ts timestamp_ntz, user_id bigint, query string"


def _periods(spark, cases):
    rows = [(i, datetime.combine(a, datetime.min.time()), 0, q) for i, (q, a) in enumerate(cases)]
    out = parse_requests(spark.createDataFrame(rows, SCHEMA)).orderBy("request_id")
    return [(r.TipoData, r.DE, r.ATE) for r in out.select("TipoData", "DE", "ATE").collect()]


def test_period_edges(spark):
    got = _periods(spark, [
        ("notas emitidas em setembro", date(2025, 10, 22)),          # month already passed this year
        ("notas emitidas em dezembro", date(2025, 10, 22)),          # latest December: last year
        ("notas emitidas em fevereiro de 2024", date(2025, 10, 22)),  # explicit year, leap month
        ("notas entregues nos últimos 30 dias", date(2025, 3, 10)),
        ("notas baixadas entre 01/02/2025 e 05/02/2025", date(2025, 10, 22)),
        ("notas emitidas de 31/02/2025 até 10/03/2025", date(2025, 10, 22)),   # impossible date: no range
        ("notas emitidas em 05/03/2025 hoje", date(2025, 10, 22)),  # explicit date wins over "hoje" (E9)
        ("notas agendadas neste semestre", date(2025, 3, 1)),
        ("notas emitidas de 1 a 3 de março", date(2025, 10, 22)),
    ])
    assert got == [
        ("3", date(2025, 9, 1), date(2025, 9, 30)),
        ("3", date(2024, 12, 1), date(2024, 12, 31)),
        ("3", date(2024, 2, 1), date(2024, 2, 29)),
        ("2", date(2025, 2, 9), date(2025, 3, 10)),
        ("6", date(2025, 2, 1), date(2025, 2, 5)),
        (None, None, None),
        ("3", date(2025, 3, 5), date(2025, 3, 5)),
        ("1", date(2025, 1, 1), date(2025, 6, 30)),
        ("3", date(2025, 3, 1), date(2025, 3, 3)),
    ]


def test_anchor_is_per_row(spark):
    got = _periods(spark, [("notas emitidas ontem", date(2024, 3, 1)), ("notas emitidas ontem", date(2025, 1, 1))])
    assert got == [("3", date(2024, 2, 29), date(2024, 2, 29)), ("3", date(2024, 12, 31), date(2024, 12, 31))]
