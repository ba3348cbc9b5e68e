"""Evaluation and monitoring (H1-H5): joins and aggregates only.

All aggregates are partial (map-side) aggregates keyed by a field name,
an outcome, an hour or a request; none gathers a group's rows in memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import (FILTER_FIELDS, LOG_MSG_DEBUG_ERROR, LOG_MSG_DEBUG_RECEIVED, LOG_MSG_DEBUG_VAGUE, LOG_MSG_ERROR,
                                      LOG_MSG_RECEIVED, LOG_MSG_VAGUE)
from .quantiles import exact_quantiles
from .ranking import previous_in_group


def field_accuracy(predicted: DataFrame, expected: DataFrame, key: str = "request_id") -> DataFrame:
    """H1: per field counts of expected / predicted / correct values and
    null-safe agreement, plus a ``__record__`` row for whole records."""
    p = predicted.select(key, *[F.col(f).alias("p_" + f) for f in FILTER_FIELDS])
    e = expected.select(key, *[F.col(f).alias("e_" + f) for f in FILTER_FIELDS])
    j = p.join(e, key, "full_outer")
    aggs = []
    for f in FILTER_FIELDS:
        pc, ec = F.col("p_" + f), F.col("e_" + f)
        aggs += [F.count_if(ec.isNotNull()).alias(f"{f}|expected"), F.count_if(pc.isNotNull()).alias(f"{f}|predicted"),
                 F.count_if(pc == ec).alias(f"{f}|correct"), F.count_if(pc.eqNullSafe(ec)).alias(f"{f}|agree")]
    whole = reduce(lambda a, b: a & b, [F.col("p_" + f).eqNullSafe(F.col("e_" + f)) for f in FILTER_FIELDS])
    aggs += [F.count("*").alias("__record__|expected"), F.count("*").alias("__record__|predicted"),
             F.count_if(whole).alias("__record__|correct"), F.count_if(whole).alias("__record__|agree")]
    row = j.agg(*aggs)
    names = [*FILTER_FIELDS, "__record__"]
    stacked = ", ".join(f"'{n}', `{n}|expected`, `{n}|predicted`, `{n}|correct`, `{n}|agree`" for n in names)
    out = row.select(F.expr(f"stack({len(names)}, {stacked}) AS (field, n_expected, n_predicted, n_correct, n_agree)"))
    return out.withColumns({
        "precision": F.round(F.try_divide(F.col("n_correct"), F.col("n_predicted")), 6),
        "recall": F.round(F.try_divide(F.col("n_correct"), F.col("n_expected")), 6),
    })


def field_coverage(parsed: DataFrame) -> DataFrame:
    """H2: requests and filled fields per outcome, with a grand total row."""
    return parsed.rollup("outcome").agg(
        F.count("*").alias("n_requests"),
        *[F.count(F.col(f)).alias("n_" + f) for f in FILTER_FIELDS],
    )


def suite_coverage(parsed: DataFrame) -> DataFrame:
    """H2 by section of a corpus: requests, records and filled fields."""
    return parsed.groupBy("suite_no", "suite").agg(
        F.count("*").alias("n_requests"), F.count_if(F.col("outcome") == "ok").alias("n_ok"),
        *[F.count(F.col(f)).alias("n_" + f) for f in FILTER_FIELDS])


def suite_accuracy(predicted: DataFrame, expected: DataFrame, key: str = "request_id") -> DataFrame:
    """H1 by section of a corpus: per suite and field the counts of
    :func:`field_accuracy`; only requests the corpus holds are judged."""
    p = predicted.select(key, "suite_no", *[F.col(f).alias("p_" + f) for f in FILTER_FIELDS])
    j = p.join(expected.select(key, *[F.col(f).alias("e_" + f) for f in FILTER_FIELDS]), key, "left")
    aggs = []
    for f in FILTER_FIELDS:
        pc, ec = F.col("p_" + f), F.col("e_" + f)
        aggs += [F.count(ec).alias(f"{f}|expected"), F.count(pc).alias(f"{f}|predicted"),
                 F.count_if(pc == ec).alias(f"{f}|correct"), F.count_if(pc.eqNullSafe(ec)).alias(f"{f}|agree")]
    stacked = ", ".join(f"'{n}', `{n}|expected`, `{n}|predicted`, `{n}|correct`, `{n}|agree`" for n in FILTER_FIELDS)
    return j.groupBy("suite_no").agg(*aggs).select("suite_no", F.expr(
        f"stack({len(FILTER_FIELDS)}, {stacked}) AS (field, n_expected, n_predicted, n_correct, n_agree)"))


def vague_rate(records: DataFrame, every: str = "1 hour") -> DataFrame:
    """H3: requests, vague (400) and failed (500) answers per time window,
    read from service-log records."""
    is_request = (F.col("level") == "INFO") & F.col("message").startswith(LOG_MSG_RECEIVED)
    w = records.groupBy(F.window("ts", every).alias("w")).agg(
        F.count_if(is_request).alias("n_requests"),
        F.count_if(F.col("level") == "WARNING").alias("n_vague"),
        F.count_if(F.col("level") == "ERROR").alias("n_error"),
    )
    return w.select(F.col("w.start").alias("window_start"), "n_requests", "n_vague", "n_error",
                    F.round(F.try_divide(F.col("n_vague"), F.col("n_requests")), 6).alias("vague_rate"))


#: Endpoint, and the heads of its messages of a request, a vague answer and a failure.
ENDPOINTS = [("parse-query", LOG_MSG_RECEIVED, LOG_MSG_VAGUE, LOG_MSG_ERROR),
             ("debug-query", LOG_MSG_DEBUG_RECEIVED, LOG_MSG_DEBUG_VAGUE, LOG_MSG_DEBUG_ERROR)]


def vague_rate_by_endpoint(records: DataFrame, every: str = "1 hour") -> DataFrame:
    """H3 for each endpoint by itself, told by how its messages begin (a query may name the other endpoint).

    Records that say none of the three of any endpoint are not counted.
    """
    m = F.col("message")
    endpoint, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, *heads in ENDPOINTS:
        for what, level, head in zip(("request", "vague", "error"), ("INFO", "WARNING", "ERROR"), heads):
            is_it = (F.col("level") == level) & m.startswith(head)
            endpoint, kind = F.when(is_it, name).otherwise(endpoint), F.when(is_it, what).otherwise(kind)
    w = (records.select("ts", endpoint.alias("endpoint"), kind.alias("kind")).where(F.col("endpoint").isNotNull())
                .groupBy("endpoint", F.window("ts", every).alias("w")).agg(
                    *[F.count_if(F.col("kind") == k).alias(n) for k, n in (("request", "n_requests"), ("vague", "n_vague"), ("error", "n_error"))]))
    return w.select("endpoint", F.col("w.start").alias("window_start"), "n_requests", "n_vague", "n_error",
                    F.round(F.try_divide("n_vague", "n_requests"), 6).alias("vague_rate"))


def latency_summary(attempts: DataFrame) -> DataFrame:
    """H4: response time by HTTP status (exact, mergeable aggregates)."""
    return attempts.groupBy("status").agg(
        F.count("*").alias("n"),
        F.round(F.avg("seconds"), 6).alias("avg_s"),
        F.min("seconds").alias("min_s"),
        F.max("seconds").alias("max_s"),
        F.count_if(F.col("seconds") > 60).alias("n_over_60s"),
    )


def latency_quantiles(attempts: DataFrame) -> DataFrame:
    """H4: exact p50/p95/p99 by status."""
    q = exact_quantiles(attempts, "status", "seconds", [0.5, 0.95, 0.99])
    return q.groupBy("status").agg(*[F.max(F.when(F.col("q") == x, F.round("quantile", 6))).alias(name)
                                     for name, x in (("p50_s", 0.5), ("p95_s", 0.95), ("p99_s", 0.99))])


RETRY_WAIT = 60    # seconds the runner rests after an answer other than 200


def attempt_waits(attempts: DataFrame, wait: int = RETRY_WAIT, partitions: int | None = None) -> DataFrame:
    """H5: per request, waits between attempts (seconds), attempts that follow
    a failed one, and those among them sent before the rest was over."""
    a = attempts.select("request_id", "ts", "status", "seconds")
    x = previous_in_group(a, "request_id", [F.col("ts"), F.col("status"), F.col("seconds")], ["ts", "status"], partitions)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))  # noqa: E731  (UTC session)
    gap = (micros("ts") - micros("prev_ts")) / 1e6
    retry = F.col("prev_status") != 200
    return x.groupBy("request_id").agg(
        F.count("*").alias("n_attempts"), F.count_if(retry).alias("n_retries"), F.count_if(retry & (gap < wait)).alias("n_early"),
        F.round(F.min(gap), 6).alias("min_wait_s"), F.round(F.max(gap), 6).alias("max_wait_s"),
        F.round(F.max(F.when(retry, gap)), 6).alias("max_retry_wait_s"))


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """H5: per request, attempts until the first success and time spent.

    Two aggregates and one join on the request key; no per-request window,
    so a request retried millions of times is still split across tasks."""
    ok = F.col("status") == 200
    first = attempts.groupBy("request_id").agg(
        F.count("*").alias("n_attempts"),
        F.count_if(ok).alias("n_ok"),
        F.min("ts").alias("first_ts"),
        F.min(F.when(ok, F.col("ts"))).alias("first_ok_ts"),
    )
    before = (attempts.join(first.select("request_id", "first_ok_ts"), "request_id")
                      .where(F.col("ts") <= F.col("first_ok_ts"))
                      .groupBy("request_id").agg(F.count("*").alias("attempts_until_ok")))
    out = first.join(before, "request_id", "left")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))  # noqa: E731  (UTC session)
    secs = (micros("first_ok_ts") - micros("first_ts")) / 1e6
    return out.select("request_id", "n_attempts", "n_ok", "first_ts", "first_ok_ts", "attempts_until_ok",
                      F.round(secs, 6).alias("seconds_to_ok"))
