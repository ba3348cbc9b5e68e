"""Filter interaction audit (operator 12): what each filter removes under every order of all of them.

A filter is the table of the row numbers that fail it.  A left-semi join of
the documents with it gives the filter's members; left-anti joins with the
tables of any set of other filters give what it still removes after those.
All sets are walked at once: before the anti-join with a filter's table, every
row is doubled into "that filter comes earlier" (the join looks at it) and
"it doesn't" (the join lets it pass), so n filters take n anti-joins on the
row number, which share one partitioning, and not one join a prefix.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fretelens.llm.common import WORD, materialize, numbered, table

FILTERS = "ABCDE"


def text_checks(docs: DataFrame) -> DataFrame:
    """Row number, doc_id, part, two hashes of the text and the checks A to D, as a written table."""
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("_t"))
    d = d.withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    d = d.withColumns({"_n": F.size("_w"), "_d": F.size(F.array_distinct("_w"))})
    return numbered(d.select(
        "doc_id", "part", F.xxhash64("_t").alias("h1"), F.xxhash64(F.lit(1), "_t").alias("h2"),
        (F.col("_n") < 50).alias("A"),
        (F.col("_d") * 100 < F.col("_n") * 65).alias("B"),
        (F.regexp_count("_t", F.lit("[A-Z]")) * 100 > F.length("_t") * 5).alias("C"),
        F.rlike("_t", F.lit("[#$%&*|]")).alias("D")), "row")


def later_copies(checks: DataFrame) -> DataFrame:
    """Row numbers whose text a smaller doc_id has too (equal by 128 bits of hash); a null id has no smaller one and is none."""
    # written, so that the join deals it anew and can split a text that many rows share
    first = materialize(checks.groupBy("h1", "h2").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1"))
    return checks.join(first, ["h1", "h2"]).where(F.col("doc_id") > F.col("_first")).select("row")


def labelled(checks: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, part, good, toxic): 1 where any label row of the doc_id says so; null ids have no label and don't meet in one key."""
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_k")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    has = F.col("doc_id").isNotNull()
    left = checks.select("row", "part", F.coalesce("doc_id", "row").alias("_k"), has.alias("_has"))
    out = left.join(flags.withColumn("_has", F.lit(True)), ["_k", "_has"], "left")
    return out.select("row", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def removals(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """(part, filter, before, n, good, toxic): members of ``filter`` that no filter of the set ``before`` (bits) has.

    ``failing`` holds a table of row numbers per filter; sets with nothing to remove have no row."""
    members = None
    for f, ids in failing.items():
        m = rows.join(ids, "row", "left_semi").withColumn("filter", F.lit(f))
        members = m if members is None else members.unionByName(m)
    x = members.withColumn("before", F.lit(0))
    for bit, (f, ids) in enumerate(failing.items()):
        both = F.array(F.lit(0), F.lit(1 << bit))
        x = x.withColumn("_at", F.explode(F.when(F.col("filter") == f, F.array(F.lit(0))).otherwise(both)))
        ids = ids.select(F.col("row").alias("_id"))
        x = x.join(ids, (F.col("row") == F.col("_id")) & (F.col("_at") > 0), "left_anti")
        x = x.withColumn("before", F.col("before") + F.col("_at")).drop("_at")
    return x.groupBy("part", "filter", "before").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def by_order(totals: DataFrame, removed: DataFrame, names: str) -> DataFrame:
    """Every part x order of the filters x step, with what the step does; ``totals`` is (part, total)."""
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    bit = lambda c: sum(F.when(c == f, 1 << i).otherwise(0) for i, f in enumerate(names))
    before = sum(F.when(F.col("step") > i, bit(F.substring("filter_order", i, 1))).otherwise(0) for i in range(1, len(names)))
    x = totals.withColumn("filter_order", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(names)))))
    x = x.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names))))).withColumns({"filter": letter, "before": before})
    alone = removed.groupBy("part", "filter").agg(
        F.max(F.when(F.col("before") == 0, F.col("n"))).alias("_fails"),
        F.max(F.when(F.col("before") + bit(F.col("filter")) == (1 << len(names)) - 1, F.col("n"))).alias("_only"))
    x = x.join(removed, ["part", "filter", "before"], "left").join(alone, ["part", "filter"], "left").na.fill(0, ["n", "good", "toxic", "_fails", "_only"])
    so_far = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    out = {
        "kept": F.col("total") - F.sum("n").over(so_far), "removed": F.col("n"), "redundant": F.col("_fails") - F.col("n"), "unique_fails": F.col("_only"),
        "good_lost": F.col("good"), "toxic_lost": F.col("toxic"), "shapley": F.sum("n").over(Window.partitionBy("part", "filter")),
    }
    return x.select("part", "filter_order", "step", *(c.cast("long").alias(k) for k, c in out.items()))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step.

    Null texts are empty (they fail A); a null source is the part ''; repeated
    rows are documents of their own, and rows that repeat a doc_id and its text
    are not copies of a smaller id; a null doc_id is no later copy and has no
    label; several label rows of an id count once; an empty table gives an
    empty result.  Only doc_id, source and text, and doc_id, quality and toxic
    of the labels are read.
    """
    checks = text_checks(docs)
    failing = {f: materialize(checks.where(f).select("row")) for f in FILTERS[:-1]} | {FILTERS[-1]: materialize(later_copies(checks))}
    rows = materialize(labelled(checks, labels))
    removed = materialize(removals(rows, failing))
    return by_order(rows.groupBy("part").agg(F.count("*").alias("total")), removed, FILTERS)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all `documents`, in every order, by source."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
m AS (SELECT part, doc_id, CAST(len(ws) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INTEGER)
    + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
    + 16 * CAST(coalesce(doc_id > first_id, false) AS INTEGER) AS fails FROM w),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic
    FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, fails),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM f a, f b, f c, f d, f e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(list_sum(bits[:step]) AS INTEGER) - bits[step] AS before
    FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, bit, sum(CASE WHEN (fails & (before | bit)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN (fails & bit) > 0 AND (fails & before) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN (fails & bit) > 0 AND (fails & before) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN (fails & bit) > 0 AND (fails & before) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN (fails & bit) > 0 AND (fails & before) = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x
"""
