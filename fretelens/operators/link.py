"""Entity linking (D3, D4): names after "cliente"/"transportadora" joined to
the customer and carrier dimensions.

The words after the keyword are cut into leading n-grams (1..the word count
of the longest dimension name, an exact bound), folded, and equi-joined to
folded dimension names; the longest hit
per request and kind wins ("Acme do Brasil" over "Acme").  Only requests
that carry a keyword produce n-gram rows, and those rows are narrow.  The
dimension grows with the data, so the join is left to the planner: AQE turns
it into a broadcast join only when the runtime size allows, and its
skew-join handling splits a hot name (one customer asked by a third of all
requests).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, squash

KINDS = ("cliente", "transportadora")


def name_key(col: Column) -> Column:
    """Join key of a name: folded, single spaces, no trailing punctuation."""
    return F.regexp_replace(squash(fold(col)), r"[.'\"]+$", "")


def entity_dimension(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """(kind, name_key, name): one row per folded name and kind."""
    c = customer.select(F.lit("cliente").alias("kind"), F.col("c_name").alias("name"))
    s = supplier.select(F.lit("transportadora").alias("kind"), F.col("s_name").alias("name"))
    d = c.unionByName(s).where(F.col("name").isNotNull())
    return (d.withColumn("name_key", name_key(F.col("name")))
             .groupBy("kind", "name_key").agg(F.min("name").alias("name")))


def longest_name(dimension: DataFrame) -> int:
    """Words in the longest dimension name (one scalar): a longer n-gram can
    never match, so n-grams stop there - an exact bound, not a cap."""
    n = dimension.agg(F.max(F.size(F.split("name_key", " "))).alias("n")).first()["n"]
    return int(n or 1)


def linked_names(keys: DataFrame, dimension: DataFrame, most_words: int) -> DataFrame:
    """(kind, words, name, n_words) for the distinct (kind, words) whose leading n-grams hit the dimension."""
    tokens = F.split("words", " ")
    upto = F.least(F.size(tokens), F.lit(most_words))
    grams = keys.select("kind", "words", F.explode(F.transform(
        F.sequence(F.lit(1), upto),
        lambda n: F.struct(n.alias("n"), name_key(F.array_join(F.slice(tokens, 1, n), " ")).alias("gram_key")))).alias("g"))
    hits = grams.select("kind", "words", "g.n", F.col("g.gram_key").alias("name_key")).join(dimension, ["kind", "name_key"])
    return hits.groupBy("kind", "words").agg(F.max_by("name", "n").alias("name"), F.max("n").alias("n_words"))


def link_entities(df: DataFrame, dimension: DataFrame, spans: dict[str, Column], most_words: int | None = None) -> DataFrame:
    """Adds ``linked_<kind>`` (the dimension's name, NULL = unlinked) and ``name_<kind>`` (the name as written).

    ``spans`` gives, per kind, the words after the keyword.  What a name links
    to depends on those words alone, so they are the join key: no row needs an
    id of its own, requests that repeat an id stay apart, and equal words are
    linked once.  ``most_words`` (the longest dimension name) can be given to
    spare streams the scan of the dimension.
    """
    most = most_words or longest_name(dimension)
    for kind, tokens in spans.items():
        df = df.withColumn(f"_words_{kind}", F.when(F.size(tokens) > 0, F.array_join(F.slice(tokens, 1, most), " ")))
    keys = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_words_{k}").alias("words")) for k in spans])).alias("s"))
    links = linked_names(keys.select("s.kind", "s.words").where(F.col("words").isNotNull()).distinct(), dimension, most)
    for kind in spans:
        mine = links.where(F.col("kind") == kind).select(F.col("words").alias(f"_on_{kind}"), F.col("name").alias(f"linked_{kind}"), F.col("n_words").alias(f"_n_{kind}"))
        # rows without a name spread over all partitions instead of meeting on one null key
        on = F.coalesce(F.col(f"_words_{kind}"), F.concat(F.lit("\u0000"), F.xxhash64("request_id", "ts").cast("string")))
        df = df.withColumn(f"_key_{kind}", on).join(mine, F.col(f"_key_{kind}") == F.col(f"_on_{kind}"), "left")
        written = F.array_join(F.slice(F.split(f"_words_{kind}", " "), 1, F.col(f"_n_{kind}")), " ")
        df = df.withColumn(f"name_{kind}", F.when(F.col(f"_n_{kind}").isNotNull(), F.regexp_replace(written, r"[.'\"]+$", "")))
    return df.drop(*[f"_{what}_{k}" for k in spans for what in ("words", "on", "n", "key")])


def link_rowwise(df: DataFrame, dimension: DataFrame, spans: dict[str, Column], most_words: int) -> DataFrame:
    """:func:`link_entities` without an aggregate, for streams: one left join
    per kind and n-gram length with the static dimension, longest first.

    The number of joins is the word count of the longest name (an exact bound
    that the caller reads once), not of the data.
    """
    for kind, tokens in spans.items():
        names = dimension.where(F.col("kind") == kind)
        linked, n_words = F.lit(None).cast("string"), F.lit(None).cast("int")
        df = df.withColumn("_tok", F.when(F.size(tokens) > 0, F.slice(tokens, 1, most_words)))
        for n in range(1, most_words + 1):
            gram = F.when(F.size("_tok") >= n, name_key(F.array_join(F.slice("_tok", 1, n), " ")))
            # rows without a name spread over all partitions instead of meeting on one null key
            on = F.coalesce(gram, F.concat(F.lit("\u0000"), F.xxhash64("request_id", "ts").cast("string")))
            mine = names.select(F.col("name_key").alias(f"_key{n}"), F.col("name").alias(f"_name{n}"))
            df = df.withColumn(f"_on{n}", on).join(mine, F.col(f"_on{n}") == F.col(f"_key{n}"), "left")
            linked, n_words = F.coalesce(F.col(f"_name{n}"), linked), F.coalesce(F.when(F.col(f"_name{n}").isNotNull(), n), n_words)
        written = F.regexp_replace(F.array_join(F.slice("_tok", 1, n_words), " "), r"[.'\"]+$", "")
        df = df.withColumns({f"linked_{kind}": linked, f"name_{kind}": F.when(n_words.isNotNull(), written)})
        df = df.drop("_tok", *[f"_{what}{n}" for what in ("on", "key", "name") for n in range(1, most_words + 1)])
    return df
