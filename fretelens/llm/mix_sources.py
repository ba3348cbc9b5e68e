"""Mixing sources to target weights (operator 3), in DataFrame operations only.

The words of a source, documents in order, form one stream that is cut into
blocks of a fixed number of words.  Every output shard draws a multinomial
count for each source; the slots a source gets are numbered through all
shards, and slot number j takes block perm(j mod blocks) of pass j div blocks,
where perm is a pseudorandom permutation of the source's block numbers that
differs by source and pass.  Blocks are joined to documents by (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fretelens.llm.common import clearing, materialize, partitions_for, table, with_position, WORD

#: Words of a block; slots of an output shard; weights in turn; wanted share of all words; most passes over a source.
BLOCK, SHARD = 64, 1024
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
#: Rows that one running sum takes in a task, and bins of the draw.
RUN, BINS = 4096, 1024
# Primes above any block count: multiplying by one permutes the numbers mod any smaller count.
_PRIMES = (2915696333923769447, 3157959166272196927, 3717807861252345293, 3955185134989381889, 3978157896551575967, 4219262503184953739)


def sized(docs: DataFrame) -> DataFrame:
    """Documents with ``size`` (words), a hash ``h`` of the text and a place ``at`` in the order of source, doc_id and text."""
    d = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("h"))
    return with_position(d, F.asc_nulls_last("source"), F.asc_nulls_last("doc_id"), "h", "size", name="at")


def _running(df: DataFrame, value: str, order: str, by: list[str], name: str) -> DataFrame:
    """Sum of ``value`` over earlier rows of the same ``by``, in two levels of at most RUN rows a window."""
    run = F.expr(f"{order} div {RUN}")
    whole = df.withColumn("_run", run)
    sums = whole.groupBy(*by, "_run").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*by, F.expr(f"_run div {RUN}")).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    far = sums.withColumn("_big", F.expr(f"_run div {RUN}"))
    big = far.groupBy(*by, "_big").agg(F.sum("_sum").alias("_bigsum"))
    wb = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_big").rowsBetween(Window.unboundedPreceding, -1)
    big = big.withColumn("_bigsum", F.coalesce(F.sum("_bigsum").over(wb), F.lit(0)))
    far = far.withColumn("_sum", F.coalesce(F.sum("_sum").over(w), F.lit(0))).join(big, [*by, "_big"]).select(*by, "_run", (F.col("_sum") + F.col("_bigsum")).alias("_sum"))
    wi = Window.partitionBy(*by, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = whole.withColumn("_in", F.coalesce(F.sum(value).over(wi), F.lit(0)))
    return near.join(far, [*by, "_run"]).withColumn(name, F.col("_in") + F.col("_sum")).drop("_run", "_in", "_sum")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES, block: int = BLOCK) -> DataFrame:
    """One row per source: number, weight, source_size, target, blocks and slots.

    The target level is found in closed form: sources in order of
    (cap / weight); the first whose cap is not below the level that remains
    for it and all after it sets the level.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before").alias("start"))
    number = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    s = s.withColumn("source_no", number)
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.lit(float(passes)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    s = s.withColumn("_left", F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_level", F.col("_left") / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_sets", F.col("cap") / F.col("weight") >= F.col("_level"))
    level = F.coalesce(F.min_by(F.when(F.col("_sets"), F.col("_level")), F.when(F.col("_sets"), F.struct(F.col("cap") / F.col("weight"), "source_no"))).over(Window.partitionBy()), F.lit(float("inf")))
    s = s.withColumn("target", F.greatest(F.lit(0.0), F.least("cap", level * F.col("weight"))))
    s = s.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    slots = F.least(F.round(F.col("target") * F.col("blocks") / F.nullif("source_size", F.lit(0))).cast("long"), passes * F.col("blocks"))
    s = s.withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(F.lit(0).cast("long")))
    past = F.sum("slots").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("past", past).select("source", "source_no", "weight", "source_size", "start", "target", "blocks", "slots", "past")


def _permuted(k: Column, n: Column, *salt: Column) -> Column:
    """Place of k under a pseudorandom permutation of 0..n-1 chosen by ``salt``."""
    h = F.xxhash64(*salt)
    prime = F.element_at(F.array(*(F.lit(p).cast("long") for p in _PRIMES)), (F.pmod(h, F.lit(len(_PRIMES))) + 1).cast("int"))
    wide = lambda c: c.cast("decimal(19,0)")
    step = prime % n
    shift = F.pmod(F.xxhash64(*salt, F.lit(7)), n)
    return ((wide(step) * wide(k) + wide(shift)) % wide(n)).cast("long")


def mixed_slots(sources: DataFrame, shard: int = SHARD, seed: int = 3) -> DataFrame:
    """(shard, source_no, slot, pass, block): every slot of the mix; slot counts through all shards of a source.

    Draws beyond a source's slots fall away and sources that drew too few get
    the rest in a last shard, so each source has exactly its slots.
    """
    spark = sources.sparkSession
    total = sources.agg(F.max("past")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], "shard long, source_no int, slot long, pass long, block long")
    wide = -(-total // BINS)
    ranges = sources.where("slots > 0").select("source_no", (F.col("past") - F.col("slots")).alias("lo"), F.col("past").alias("hi"))
    ranges = ranges.withColumn("bin", F.explode(F.expr(f"sequence(lo div {wide}, (hi - 1) div {wide})")))
    drawn = spark.range(0, total, 1, partitions_for(sources)).select(F.expr(f"id div {shard}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias("u"))
    drawn = drawn.withColumn("bin", F.expr(f"u div {wide}")).join(ranges, "bin").where("u >= lo and u < hi")
    counts = materialize(drawn.groupBy("shard", "source_no").agg(F.count("*").alias("n")))
    placed = _running(counts, "n", "shard", ["source_no"], "first")
    facts = sources.select("source_no", "blocks", "slots")
    placed = placed.join(facts, "source_no").withColumn("n", F.least(F.col("n"), F.col("slots") - F.col("first"))).where("n > 0")
    rest = facts.join(counts.groupBy("source_no").agg(F.sum("n").alias("first")), "source_no", "left").na.fill(0, ["first"]).where("first < slots")
    rest = rest.select(F.lit(-(-total // shard)).cast("long").alias("shard"), "source_no", (F.col("slots") - F.col("first")).alias("n"), "first", "blocks", "slots")
    every = placed.select("shard", "source_no", "n", "first", "blocks", "slots").unionByName(rest)
    every = every.select("shard", "source_no", "blocks", F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot")).withColumn("pass", F.expr("slot div blocks"))
    block = _permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("source_no"), F.col("pass"))
    return every.select("shard", "source_no", "slot", "pass", block.alias("block"))


def segments(sizes: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(at, source_no, block, start, n): the words of each document in each block of its source."""
    d = sizes.join(sources.select("source", "source_no", "start"), sizes["source"].eqNullSafe(sources["source"])).select("at", "source_no", "size", (F.col("before") - F.col("start")).alias("off")).where("size > 0")
    d = d.withColumn("block", F.explode(F.expr(f"sequence(off div {block}, (off + size - 1) div {block})")))
    lo = F.greatest("off", F.col("block") * block)
    hi = F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block)
    return d.select("at", "source_no", "block", (lo - F.col("off")).alias("start"), (hi - lo).alias("n"))


def plan(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with size and place, sources with targets, slots of the mix)."""
    sizes = materialize(_running(sized(docs), "size", "at", [], "before"))
    sources = materialize(source_targets(sizes, block=block))
    return sizes, sources, mixed_slots(sources)


def mix_sources(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Null or empty texts have size 0 and are never taken; null is a source of
    its own, last in the order; repeated rows are documents of their own; an
    empty table gives an empty result.  Only doc_id, source and text are read.
    """
    sizes, sources, slots = plan(docs, block)
    uses = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    taken = segments(sizes, sources, block).join(uses, ["source_no", "block"]).groupBy("at").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    facts = sources.select(F.col("source").alias("_s"), "source_size", "target")
    out = sizes.join(facts, F.col("source").eqNullSafe(F.col("_s"))).join(taken, "at", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself, in the columns of ``docs``: one row per document and pass with the words taken, in order.

    A document taken whole keeps its text as it is; of others the taken words
    are joined by single spaces.  n_chars, if there, follows the text.  Texts
    stay where they are until what is taken of them is known; of rows that
    share doc_id and text, any one lends its other columns to each.
    """
    sizes, sources, slots = plan(docs, block)
    parts = segments(sizes, sources, block).join(slots.select("source_no", "block", "pass"), ["source_no", "block"])
    parts = parts.groupBy("at", "pass").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("parts"), F.sum("n").alias("got"))
    taken = sizes.select("at", F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "size").join(parts, "at")
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"))
    whole = whole.join(taken, F.col("doc.doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("doc.text") == F.col("_h")))
    if not sizes.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        whole = whole.dropDuplicates(["at", "pass"])
    found = F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice("_words", p["start"].cast("int") + 1, p["n"].cast("int")))), " ")
    part = F.col("got") < F.col("size")
    whole = whole.withColumn("_words", F.when(part, found)).withColumn("_text", F.when(part, cut).otherwise(F.col("doc.text")))
    as_they_are = {c: F.col("doc").getField(c) for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in as_they_are:
        as_they_are["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return whole.select(*(v.alias(c) for c, v in as_they_are.items()))


@clearing
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix of the documents."""
    return mixed_documents(docs)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` mixed to 150 % of their words at source weights 3, 1, 2."""
    return mix_sources(table(spark, sf_dir, "documents"))
