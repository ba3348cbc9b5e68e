"""Numbered lines of text files that are read in splits.

Spark cuts files into byte ranges and gives whole lines to the range they
start in.  A line's number is its place in its range plus the lines of the
ranges before, so one count per range, and never a file, meets in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

_RANGE = ["file", "_range"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value), lines counted from 1 (glob allowed).

    The lines are a written table: the places of the lines inside their range
    must be the same for the counts and for the lines.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_range"),
        F.monotonically_increasing_id().alias("_id"), "value")
    raw = written(raw)
    first = raw.groupBy(*_RANGE).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select(*_RANGE, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # a range is one run of lines in one task, so ids of its lines follow each other
    return raw.join(first, _RANGE).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "value")


def carried(lines: DataFrame, value: Column, name: str, every: int = 10_000) -> DataFrame:
    """Adds ``name``: the last non-NULL ``value`` at or above the line, in the file.

    Carried in two steps over runs of ``every`` lines: inside a run by a
    window of at most that many rows, between runs by a window over one row a
    run.
    """
    x = lines.withColumns({"_run": F.floor((F.col("line_no") - 1) / every), "_v": value})
    last = x.groupBy("file", "_run").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("line_no"))).alias("_last"))
    above = Window.partitionBy("file").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("file", "_run", F.last("_last", ignorenulls=True).over(above).alias("_above"))
    inside = Window.partitionBy("file", "_run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_here", F.last("_v", ignorenulls=True).over(inside)).join(last, ["file", "_run"])
    return x.withColumn(name, F.coalesce("_here", "_above")).drop("_run", "_v", "_here", "_above")
