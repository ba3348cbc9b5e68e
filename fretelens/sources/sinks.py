"""Filter sink (A6): one JSON object per request, every key present."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.outcome import to_filter_json


def write_filters(parsed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``(request_id, status, filter_json)`` as JSON lines, one folder
    per outcome (ok / vague / empty), so consumers read only what they need."""
    out = parsed.select("request_id", "outcome", "status", to_filter_json(parsed).alias("filter_json"))
    out.write.mode(mode).partitionBy("outcome").json(path)


def read_filters(spark, path: str, outcome: str | None = None) -> DataFrame:
    df = spark.read.schema("request_id bigint, status int, filter_json string, outcome string").json(path)
    return df.where(F.col("outcome") == outcome) if outcome else df
