"""Service-log scan (A3) and the stand-in log rendered from ``events``.

Log format: ``asctime - logger - LEVEL - message``; a traceback's lines
follow the record they belong to.  Log files are read in splits by
:mod:`log_reader`; :func:`parse_log_records` groups a table of numbered lines
(a running count of header lines, a window over one rotated file at most).

The stand-in log: every event is one request ("Recebida ..." at INFO); a
``signup`` event is also answered 400 (WARNING, vague request) and an
``error`` event 500 (ERROR + three traceback lines).  Files hold
``EVENTS_PER_FILE`` events each, like size-based rotation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dictionaries as D

EVENTS_PER_FILE = 2000
LINES_PER_EVENT = 5
HEADER = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (\S+) - (DEBUG|INFO|WARNING|ERROR|CRITICAL) - (.*)$"


def log_level(event_type: Column) -> Column:
    """Outcome of a stand-in request event as a log level."""
    return F.when(event_type == "error", "ERROR").when(event_type == "signup", "WARNING").otherwise("INFO")


def render_log_lines(events: DataFrame, debug: Column | None = None) -> DataFrame:
    """(file, line_no, line) of the stand-in service log; events where ``debug`` holds came in at the debug endpoint."""
    def said(level: str, plain: str, debugging: str) -> Column:
        plain = F.lit(f"{level} - {plain}")
        return plain if debug is None else F.when(debug, F.lit(f"{level} - {debugging}")).otherwise(plain)

    e = events.select("event_id", "ts", "event_type")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    q = F.concat(F.lit("'evento "), F.col("event_id").cast("string"), F.lit("'"))
    head = F.concat(stamp, F.lit(" - app.main - "))
    lines = F.array(
        F.struct(F.lit(0).alias("k"), F.concat(head, said("INFO", D.LOG_MSG_RECEIVED, D.LOG_MSG_DEBUG_RECEIVED), q, F.lit("..."))
                 .alias("line")),
        F.when(F.col("event_type") == "signup", F.struct(
            F.lit(1).alias("k"), F.concat(head, said("WARNING", D.LOG_MSG_VAGUE, D.LOG_MSG_DEBUG_VAGUE), q,
                                          F.lit(D.LOG_MSG_VAGUE_TAIL)).alias("line"))),
        F.when(F.col("event_type") == "error", F.struct(
            F.lit(1).alias("k"), F.concat(head, said("ERROR", D.LOG_MSG_ERROR, D.LOG_MSG_DEBUG_ERROR), q).alias("line"))),
        F.when(F.col("event_type") == "error", F.struct(F.lit(2).alias("k"),
                                                         F.lit("Traceback (most recent call last):").alias("line"))),
        F.when(F.col("event_type") == "error", F.struct(
            F.lit(3).alias("k"), F.lit('  File "service/api.py", line 168, in parse_query').alias("line"))),
        F.when(F.col("event_type") == "error", F.struct(
            F.lit(4).alias("k"), F.lit("TimeoutError: model call timed out").alias("line"))),
    )
    x = e.select("event_id", F.explode(F.filter(lines, lambda s: s.isNotNull())).alias("l"))
    return x.select(
        F.concat(F.lit("service.log."), (F.col("event_id") / EVENTS_PER_FILE).cast("bigint").cast("string"))
         .alias("file"),
        (F.col("event_id") * LINES_PER_EVENT + F.col("l.k")).alias("line_no"),
        F.col("l.line").alias("line"),
    )


def parse_log_records(lines: DataFrame) -> DataFrame:
    """A3: (file, record_no, ts, logger, level, message) - traceback lines
    are appended to the message of the record above them."""
    is_head = F.col("line").rlike(HEADER)
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("record_no", F.sum(is_head.cast("int")).over(w)).where(F.col("record_no") > 0)
    rec = x.groupBy("file", "record_no").agg(
        F.min_by("line", "line_no").alias("head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]),
                     "\n").alias("body"),
        F.count("*").alias("n_lines"),
    )
    body_tail = F.expr("substring(body, length(head) + 2)")
    message = F.when(F.col("n_lines") > 1, F.concat(F.regexp_extract("head", HEADER, 4), F.lit("\n"), body_tail)) \
               .otherwise(F.regexp_extract("head", HEADER, 4))
    return rec.select(
        "file", "record_no",
        F.to_timestamp(F.regexp_extract("head", HEADER, 1), "yyyy-MM-dd HH:mm:ss,SSS").alias("ts"),
        F.regexp_extract("head", HEADER, 2).alias("logger"),
        F.regexp_extract("head", HEADER, 3).alias("level"),
        message.alias("message"),
    )


def land_log(events: DataFrame, path: str) -> str:
    """The stand-in service log as text files, one folder of one file for each rotation."""
    lines = render_log_lines(events)
    (lines.repartition("file").sortWithinPartitions("file", "line_no").select("file", F.col("line").alias("value"))
          .write.partitionBy("file").text(path))
    return path


def attempt_log(events: DataFrame) -> DataFrame:
    """Stand-in client attempt log: a user keeps resending one request; an
    ``error`` event is a 500, a ``click`` a 429 (rate limit), others 200;
    the event value is the response time in seconds."""
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "click", 429).otherwise(200)
    return events.select(F.col("user_id").alias("request_id"), "ts", status.alias("status"),
                         F.col("value").alias("seconds"))
