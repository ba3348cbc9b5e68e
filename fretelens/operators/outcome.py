"""Outcome, trace and output recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions.calendar import calendar_strings
from .resolve import FIELD_TYPES

ENUMS = {
    "Operacao": D.OPERATIONS,
    "SituacaoNF": D.SITUATIONS,
    "StatusAnaliseData": D.PERFORMANCE,
    "UFDestino": D.STATES,
    "SortColumn": D.SORT_COLUMNS,
    "SortDirection": D.SORT_DIRECTIONS,
    "TipoData": sorted(D.EVENT_CODES.values()),
}


def all_null(fields: list[str] = D.FILTER_FIELDS) -> Column:
    """F1 on a filter record: every field NULL."""
    return F.greatest(*[F.col(f).isNotNull().cast("int") for f in fields]) == 0


def classify_outcome(df: DataFrame) -> DataFrame:
    """status / outcome / detail per request."""
    empty = F.col("blank")
    vague = all_null()
    return df.withColumns({
        "status": F.when(empty | vague, F.lit(400)).otherwise(F.lit(200)),
        "outcome": F.when(empty, F.lit("empty")).when(vague, F.lit("vague")).otherwise(F.lit("ok")),
        "detail": F.when(empty, F.lit(D.DETAIL_EMPTY)).when(vague, F.lit(D.DETAIL_VAGUE)),
    })


def filters_struct() -> Column:
    return F.struct(*[F.col(f) for f in D.FILTER_FIELDS])


def trace(df: DataFrame) -> DataFrame:
    """query, dates, enhanced_query, parsed_json per request."""
    return df.select(
        "request_id",
        F.col("query"),
        calendar_strings(F.col("calendar")).alias("dates"),
        F.col("enhanced_query"),
        filters_struct().alias("parsed_json"),
    )


def to_filter_json(df: DataFrame) -> Column:
    """JSON text with all 14 keys, NULLs written out."""
    s = F.struct(*[F.date_format(F.col(f), "yyyy-MM-dd").alias(f) if FIELD_TYPES[f] == "date" else F.col(f)
                   for f in D.FILTER_FIELDS])
    return F.to_json(s, {"ignoreNullFields": "false"})


# ---------------------------------------------------------------- F4 / F5 --

def recover_block(raw: Column) -> Column:
    """text after the last ``JSON FINAL:`` marker (any case), then the
    greedy first-``{``-to-last-``}`` block; ``{}`` when there is none."""
    tail = F.element_at(F.split(raw, r"(?i)JSON FINAL\s*:?"), -1)
    block = F.regexp_extract(tail, r"(?s)\{.*\}", 0)
    return F.when(block != "", block).otherwise(F.lit("{}"))


def no_object(raw: Column) -> Column:
    """The output holds no JSON object of its own: null, no braces, cut off before the last one, or a list."""
    tail = F.element_at(F.split(raw, r"(?i)JSON FINAL\s*:?"), -1)
    cut_off = ~F.rlike(tail, F.lit(r"(?s)\{.*\}"))
    listed = F.rlike(tail, F.lit(r"(?s)^[^{]*\[\s*\{"))
    return raw.isNull() | cut_off | listed


def output_parse(df: DataFrame, raw: str = "raw_text") -> DataFrame:
    """F5 + E12: parse recovered JSON into typed fields.

    ``parse_ok`` is false for text without a complete JSON object (the service
    would ask the model again; here the row is quarantined with status 500).
    Values outside their domain, and values that are no number, date or CNPJ
    root of their field's type, become NULL and are listed in
    ``invalid_fields``; so are a range with its ends out of order and a sort
    direction without a column.  Numbers and sort pairs follow the same rules
    as parsed requests (E8, E10).  What is vague is judged on the typed record.
    """
    block = recover_block(F.col(raw))
    m = F.from_json(block, "map<string,string>")
    is_object = ~no_object(F.col(raw)) & F.ltrim(block).startswith("{") & m.isNotNull() & balanced(block)
    df = df.withColumns({"block": block, "_m": m, "parse_ok": F.coalesce(is_object, F.lit(False))})
    written = {f: F.when(F.trim(F.col("_m")[f]) != "", F.col("_m")[f]) for f in D.FILTER_FIELDS}
    typed = {}
    for f in D.FILTER_FIELDS:
        v = written[f]
        if FIELD_TYPES[f] == "bigint":
            v = v.try_cast("bigint")
        elif FIELD_TYPES[f] == "date":
            v = F.try_to_date(v, "yyyy-MM-dd")
        elif f in ENUMS:
            v = F.when(v.isin(ENUMS[f]), v)
        elif f == "CNPJRaizTransp":
            v = F.when(v.rlike(r"^\d{8}$"), v)
        typed[f] = v
    bad = {f: written[f].isNotNull() & typed[f].isNull() for f in D.FILTER_FIELDS}
    backwards = typed["DE"] > typed["ATE"]
    bad["DE"] = bad["DE"] | F.coalesce(backwards, F.lit(False))
    bad["ATE"] = bad["ATE"] | F.coalesce(backwards, F.lit(False))
    bad["SortDirection"] = bad["SortDirection"] | (typed["SortDirection"].isNotNull() & typed["SortColumn"].isNull())
    invalid = F.filter(F.array(*[F.when(bad[f], F.lit(f)) for f in D.FILTER_FIELDS]), lambda x: x.isNotNull())
    df = df.withColumn("invalid_fields", F.when(F.col("parse_ok"), invalid).otherwise(F.array().cast("array<string>")))
    has_nf = typed["NF"].isNotNull()
    out = {}
    for f in D.FILTER_FIELDS:
        v = F.when(F.col("parse_ok") & ~F.array_contains(F.col("invalid_fields"), f), typed[f])
        out[f] = v if f == "NF" else F.when(~has_nf, v)
    df = df.withColumns(out).withColumn("all_null", F.col("parse_ok") & all_null())
    status = F.when(~F.col("parse_ok"), F.lit(500)).when(F.col("all_null"), F.lit(400)).otherwise(F.lit(200))
    return df.withColumn("status", status).drop("_m")


def balanced(block: Column) -> Column:
    """One JSON object and nothing else: outside its strings, the braces close for the first time at the end."""
    bare = F.regexp_replace(block, r'"(?:[^"\\\\]|\\\\.)*"', "")
    # innermost pairs vanish step by step; flat objects, and nested ones up to four deep, become one mark
    for _ in range(4):
        bare = F.regexp_replace(bare, r"\{[^{}]+\}(?=.*\})", "x")
    return F.rlike(F.trim(bare), F.lit(r"(?s)^\{[^{}]*\}$"))


def domain_report(parsed_outputs: DataFrame) -> DataFrame:
    """Per field, how many values were outside the domain.

    The outer form of ``explode`` gives no filter on its list, which the
    optimizer would move below the parsing with all its expressions in it.
    """
    x = parsed_outputs.select(F.explode_outer("invalid_fields").alias("field")).where(F.col("field").isNotNull())
    return x.groupBy("field").agg(F.count("*").alias("n_invalid"))


def render_inputs(df: DataFrame) -> DataFrame:
    """the generation input per row (calendar + normalised query)."""
    cal = calendar_strings(F.col("calendar"))
    lines = [F.lit("Data de referência: "), cal.today, F.lit("\n")]
    for f in ["today", "yesterday", "last_week_start", "last_week_end", "week_start", "week_end",
              "month_start", "month_end", "semester_start", "semester_end"]:
        lines += [F.lit(f + "="), cal[f], F.lit("\n")]
    lines += [F.lit("Texto: "), F.col("enhanced_query")]
    return df.select("request_id", F.concat(*lines).alias("prompt"))
