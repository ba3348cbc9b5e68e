"""Phrase-corpus scan (A1): one request per line of a text corpus.

Blank lines and lines starting with ``#`` or ``=`` are dropped after
stripping; an inline ``# ...`` note stays part of the line (the parser
drops it later).  Use :func:`read_phrase_files` for corpus files and
:func:`phrase_lines` for a table with a text column (documents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import carried, numbered_lines

_EDGE_SPACE = r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$"
_NEWLINE = r"\r\n|\n|\r"
SUITE = r"^\s*#\s*Su[ií]te\s+(\d+)\s*:\s*(.*)$"


def phrase_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, text) for every kept line of ``text`` (1-based lines)."""
    x = df.select(key, F.posexplode(F.split(F.col(text), _NEWLINE)).alias("pos", "raw"))
    x = x.select(key, (F.col("pos") + 1).alias("line_no"), F.regexp_replace("raw", _EDGE_SPACE, "").alias("text"))
    return x.where((F.length("text") > 0) & ~F.col("text").startswith("#") & ~F.col("text").startswith("="))


def kept_lines(lines: DataFrame) -> DataFrame:
    """Numbered lines (``value``) without blank ones, notes and rulers, trimmed, as ``text``."""
    x = lines.withColumn("text", F.regexp_replace("value", _EDGE_SPACE, "")).drop("value")
    return x.where((F.length("text") > 0) & ~F.col("text").startswith("#") & ~F.col("text").startswith("="))


def read_phrase_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text) from UTF-8 corpus files (glob allowed), read in splits."""
    return kept_lines(numbered_lines(spark, path)).select("file", "line_no", "text")


def read_suites(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, suite_no, suite, text): the corpus with the section each line stands in.

    A section starts at a heading line ``# Suíte <number>: <title>``; lines
    above the first heading have no section.
    """
    return suite_lines(numbered_lines(spark, path))


def suite_lines(lines: DataFrame, every: int = 10_000) -> DataFrame:
    """:func:`read_suites` of numbered lines (file, line_no, value)."""
    heading = F.when(F.col("value").rlike(SUITE), F.struct(
        F.regexp_extract("value", SUITE, 1).cast("int").alias("no"), F.trim(F.regexp_extract("value", SUITE, 2)).alias("title")))
    x = kept_lines(carried(lines, heading, "_suite", every))
    return x.select("file", "line_no", F.col("_suite.no").alias("suite_no"), F.col("_suite.title").alias("suite"), "text")


def land_corpus(requests: DataFrame, suite_no, path: str, files: int = 4) -> str:
    """The requests as corpus files with sections (stand-in): heading and ruler
    lines, then a request a line with its id as an inline note."""
    one = requests.select(F.pmod(F.xxhash64("request_id"), F.lit(files)).alias("part"), suite_no.alias("no"), "request_id", "query")
    text = one.select("part", "no", "request_id", F.lit(2).alias("k"), F.concat(F.coalesce("query", F.lit("")), F.lit(" # caso "), F.col("request_id").cast("string")).alias("value"))
    head = one.select("part", "no").distinct().select(
        "part", "no", F.lit(None).cast("bigint").alias("request_id"), F.posexplode(F.array(
            F.lit("# " + "=" * 40), F.concat(F.lit("# Suíte "), F.col("no").cast("string"), F.lit(": modelos do grupo "), F.col("no").cast("string")))).alias("k", "value"))
    every = head.unionByName(text)
    (every.repartition("part").sortWithinPartitions("part", "no", "k", "request_id").select("part", "value").write.partitionBy("part").text(path))
    return path
