"""Registered queries against their DuckDB oracles on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from conftest import SF_SMALL

import __spark_entry__ as E
from fretelens.sources.tables import TABLES

KEYS = ["parse_requests", "map_synonyms", "calendar_bounds", "link_customer", "link_city", "field_cooccurrence",
        "preservation_audit", "trace_requests", "match_requests", "ranked_results", "phrase_scan", "log_scan",
        "output_parse", "field_accuracy", "vague_rate", "vague_rate_by_endpoint", "stream_late_rows", "attempt_summary"]


def _norm(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        rows.append(tuple(None if (v is None or (not hasattr(v, "__len__") and pd.isna(v)))
                          else (str(int(v)) if isinstance(v, float) and float(v).is_integer()
                                else (round(float(v), 6) if isinstance(v, float) else str(v))) for v in r))
    return sorted(rows, key=lambda t: tuple("" if x is None else str(x) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    s = E.queries()[key](spark, SF_SMALL).toPandas()
    d = con.execute(E.oracle_sql()[key]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert len(s) == len(d)
    assert _norm(s) == _norm(d)


def test_every_query_has_oracle_or_is_declared():
    rows_only = {"generate_stub", "latency_quantiles"}
    missing = set(E.QUERIES) - set(E.oracle_sql()) - rows_only
    assert not missing


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "SituacaoNF" in df.columns
