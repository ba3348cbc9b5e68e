"""Exact quantiles per group by refining histograms (H4).

A wanted rank starts with the group's value range.  Each pass counts the
values of the range in bins, picks the bin that holds the rank, and goes on
with the smallest to the largest value in that bin.  Counts are aggregated
before they are shuffled, so a group of any size is spread over all tasks;
a bin's values are looked at themselves once they are few.  Every pass leaves
at least one value out (the smallest and the largest never share a bin), and
with BINS bins a pass two or three passes do for any table that fits a disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BINS = 4096       # counts of one rank that a pass looks at
FEW = 10_000      # values of one rank that are sorted at the end


def exact_quantiles(df: DataFrame, group: str, value: str, at: list[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """(group, q, quantile): interpolated between the two nearest ranks.

    NULL and NaN values are left out; a group without others has no row; a
    NULL group is a group."""
    base = written(df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)"))
    spans = base.groupBy("_g").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = F.col("q") * (F.col("_c") - 1)
    ranks = spans.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at]))).withColumn("_share", place - F.floor(place))
    ranks = ranks.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
    todo = written(ranks.select("_g", "q", "_share", "_rank", F.col("_rank").alias("_left"), "_c", "_lo", "_hi"))
    key = ["_g", "q", "_rank"]
    done = None
    while True:
        over = (F.col("_lo") == F.col("_hi")) | (F.col("_c") <= few)
        found = todo.where(over)
        done = found if done is None else done.unionByName(found)
        todo = todo.where(~over)
        if todo.isEmpty():
            break
        # halves, so that the widest range doesn't overflow
        part = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        hist = _values(base, todo).withColumn("_bin", F.least(F.floor(part * bins), F.lit(bins - 1)))
        hist = hist.groupBy(*key, "_share", "_left", "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        # at most BINS rows a rank
        below = F.coalesce(F.sum("_c").over(Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hist = hist.withColumn("_below", below).where((F.col("_below") <= F.col("_left")) & (F.col("_left") < F.col("_below") + F.col("_c")))
        todo = written(hist.select(*key, "_share", (F.col("_left") - F.col("_below")).alias("_left"), "_c", "_lo", "_hi"))
    same = done.where("_lo = _hi").select(*key, "_share", F.col("_lo").alias("_at"))
    rest = _values(base, done.where("_lo < _hi")).groupBy(*key, "_share", "_left").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    rest = rest.select(*key, "_share", F.element_at("_all", (F.col("_left") + 1).cast("int")).alias("_at"))
    both = same.unionByName(rest).groupBy("_g", "q").agg(F.min("_at").alias("_a"), F.max("_at").alias("_b"), F.max("_share").alias("_share"))
    return both.select(F.col("_g").alias(group), "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")).alias("quantile"))


def _values(base: DataFrame, ranks: DataFrame) -> DataFrame:
    """Values inside the range of each rank of their group."""
    r = ranks.withColumnRenamed("_g", "_rg")
    met = base.join(r, base["_g"].eqNullSafe(r["_rg"])).where("_v BETWEEN _lo AND _hi")
    return met.drop("_rg")
