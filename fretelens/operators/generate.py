"""Generator slot (2.J) and the re-generation loop around it.

A generator turns rows with a ``prompt`` into rows with a ``raw_text``.
:func:`attach_generator` makes one of any ``texts -> texts`` function: pandas
Series of prompts, one Arrow batch at a time, inside the executors.

:func:`regenerate` asks again for outputs that hold no complete JSON object:
every pass generates for the rows still open, parses, settles what parsed and
sends only the rest back, each with its own answer and what was wrong with it.
Passes are bounded, each pass is a written table, and a row that never parses
stays quarantined (status 500) with its last error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import FILTER_FIELDS
from ..session import written
from .outcome import no_object, output_parse

TextGenerator = Callable[[pd.Series], pd.Series]
RowGenerator = Callable[[DataFrame], DataFrame]

PASSES = 3


def attach_generator(prompts: DataFrame, generate: TextGenerator) -> DataFrame:
    """(request_id, prompt) -> (request_id, raw_text)."""
    return row_generator(generate)(prompts).select("request_id", "raw_text")


def row_generator(generate: TextGenerator) -> RowGenerator:
    """A generator of rows from a function of texts; other columns stay as they are."""
    def rows(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(raw_text=generate(b["prompt"]))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInPandas(run, f"{kinds}, raw_text string")
    return rows


def empty_json_stub(prompts: pd.Series) -> pd.Series:
    """Local stand-in generator: answers every prompt with ``JSON FINAL: {}``."""
    return pd.Series(["JSON FINAL: {}"] * len(prompts), index=prompts.index)


def parse_error(raw: Column) -> Column:
    """What kept an output from parsing, in the words sent back with it."""
    return (F.when(raw.isNull(), F.lit("sem resposta"))
             .when(no_object(raw), F.lit("nenhum objeto JSON"))
             .otherwise(F.lit("objeto JSON incompleto")))


def retry_prompt(prompt: Column, raw: Column, error: Column) -> Column:
    """The first prompt, the answer that failed and its error."""
    return F.concat(prompt, F.lit("\nResposta recusada: "), F.coalesce(raw, F.lit("")), F.lit("\nErro: "), error,
                    F.lit("\nResponda somente com um objeto JSON completo."))


def regenerate(prompts: DataFrame, generate: RowGenerator, passes: int = PASSES) -> DataFrame:
    """F5 + 2.J: (request_id, prompt) -> one parsed row per prompt row.

    Adds ``attempts`` (generations made), ``error`` (of the last one, NULL
    when it parsed) and the columns of ``output_parse``.  ``generate`` gets
    request_id, attempt, prompt and a row number, and may not drop rows: a row
    without an answer counts as NULL text and goes round again.  Rows that
    share a request_id are asked and settled apart.  A retry always carries
    the first prompt plus the latest refusal, so it doesn't grow with passes.
    """
    first = written(prompts.select("request_id", "prompt", F.monotonically_increasing_id().alias("_row")))
    todo, done = first.select("_row", "request_id", F.lit(1).alias("attempt"), "prompt"), []
    for attempt in range(1, passes + 1):
        answers = generate(todo).select("_row", "raw_text")
        parsed = output_parse(todo.join(answers, "_row", "left"))
        result = written(parsed.select("_row", "request_id", "raw_text", F.col("attempt").alias("attempts"),
                                       F.when(~F.col("parse_ok"), parse_error(F.col("raw_text"))).alias("error"),
                                       "parse_ok", "all_null", "invalid_fields", "status", *FILTER_FIELDS))
        accepted = result.where("parse_ok")
        if attempt == passes:
            done.append(result)
            break
        done.append(accepted)
        # what is open: this pass's rows without the settled ones
        still = result.join(accepted.select("_row"), "_row", "left_anti").select("_row", "raw_text", "error")
        todo = written(first.join(still, "_row").select(
            "_row", "request_id", F.lit(attempt + 1).alias("attempt"),
            retry_prompt(F.col("prompt"), F.col("raw_text"), F.col("error")).alias("prompt")))
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, done).drop("_row")


def attempts_needed(outcomes: DataFrame) -> DataFrame:
    """Rows by attempts made and whether the last one parsed."""
    return outcomes.groupBy("attempts", "parse_ok").agg(F.count("*").alias("n_rows"))
