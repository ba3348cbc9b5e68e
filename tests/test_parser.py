"""Golden requests: corpus, regression file, few-shot examples, edge inputs."""

from datetime import datetime

import goldens as G
import pytest
from pyspark.sql import functions as F

from fretelens.functions.dictionaries import FILTER_FIELDS
from fretelens.functions.text import fold
from fretelens.operators import lexicon as L
from fretelens.operators.extract import name_spans
from fretelens.operators.normalize import expand_abbreviations, normalize, preservation_audit
from fretelens.operators.parse import parse_requests

SCHEMA = "request_id bigint, ts timestamp_ntz, user_id bigint, query string"


def _parse(spark, phrases):
    rows = [(i, datetime(2025, 10, 22, 9, 30), 0, q) for i, q in enumerate(phrases)]
    df = spark.createDataFrame(rows, SCHEMA)
    return parse_requests(df).orderBy("request_id").collect()


@pytest.mark.parametrize("suite", ["CORPUS", "FEW_SHOT", "EDGE", "PROBES"])
def test_golden_records(spark, suite):
    cases = getattr(G, suite)
    out = _parse(spark, [q for q, _ in cases])
    bad = []
    for r, (q, exp) in zip(out, cases):
        got = {f: r[f] for f in FILTER_FIELDS if r[f] is not None}
        if got != (exp or {}):
            bad.append((q, got, exp))
    assert not bad, bad


def test_outcomes(spark):
    out = _parse(spark, ["", "   ", "me mostre as notas", "qual o clima para hoje?", "nf 98765"])
    assert [(r.status, r.outcome) for r in out] == [
        (400, "empty"), (400, "empty"), (400, "vague"), (400, "vague"), (200, "ok")]
    assert out[0].detail.startswith("A 'query'") and out[2].detail.startswith("A consulta")


def test_rewrites(spark):
    out = _parse(spark, [q for q, _ in G.REWRITES])
    for r, (q, fragments) in zip(out, G.REWRITES):
        text = r.enhanced_query.lower()
        for frag in fragments:
            assert frag.lower() in text, (q, r.enhanced_query, frag)
        assert r.enhanced_query[0].isupper()


def test_normalisation_is_idempotent(spark):
    phrases = [q for q, _ in G.CORPUS + G.FEW_SHOT]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(phrases)], "request_id bigint, query string")
    once = normalize(df).select("request_id", F.col("enhanced_query").alias("query"))
    twice = normalize(once).select("request_id", "enhanced_query")
    assert once.withColumnRenamed("query", "enhanced_query").exceptAll(twice).count() == 0


def test_regression_file_matches_corpus(spark):
    # every phrase of the regression file is also in the corpus, with the same answer
    corpus = dict(G.CORPUS)
    for phrase in ["notas com data de agenda para hoje", "notas previstas entre 1 e 15 de setembro de 2025",
                   "notas emitidas nesta semana", "qual o clima para hoje?", "me mostre as notas"]:
        assert phrase in corpus


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_blanked_once_for_the_audit(spark):
    """Text without status phrases and places is a column, not repeated in every pattern that reads it."""
    df = spark.range(3).select(F.col("id").alias("request_id"), F.lit("notas com atraso # x").alias("q0"), F.col("id").cast("string").alias("n"))
    df = df.select("request_id", F.concat("q0", "n").alias("query_clean"), F.concat(F.lit("Notas com status de análise ATRASO"), "n").alias("enhanced_query"))
    assert _plan(preservation_audit(df)).count("regexp_replace(") <= 24


def test_spans_fold_a_text_once(spark):
    df = spark.range(3).select(F.concat(F.lit("Notas do cliente Acme "), F.col("id").cast("string")).alias("t"))
    out = name_spans(df, "t")
    assert _plan(out).count("translate(") == 1
    assert [r["_cli_tokens"] for r in out.orderBy("t").collect()] == [["Acme", str(i)] for i in range(3)]


def test_literals_never_rule_out_a_match(spark):
    """Long s, dotless and dotted capital i stand for s and i in the patterns, though folding keeps them."""
    phrases = ["nf para ſp", "notas em trânſito", "notas emıtidas hoje", "notas com ſtatus entregue", "notas prevİstas para hoje"]
    got = spark.createDataFrame([(p,) for p in phrases], "t string").select(
        "t", expand_abbreviations(F.col("t")).alias("x"), L.distinct_values(F.col("t"), L.LEXICON["situation"], folded=fold("t")).alias("s"),
        L.first_value(F.col("t"), L.LEXICON["event"], folded=fold("t")).alias("e"),
        L.distinct_values(F.col("t"), L.LEXICON["situation"]).alias("s0"), L.first_value(F.col("t"), L.LEXICON["event"]).alias("e0")).collect()
    assert got[0].x == "nota fiscal para o estado de São Paulo"
    assert all(r.s == r.s0 and r.e == r.e0 for r in got) and got[1].s == ["TRÂNSITO"] and got[2].e == "3"


def test_patterns_look_once_at_a_place_and_lists_need_no_lambda(spark):
    """Common beginnings of alternatives are written once, a shared word boundary too, and lists of found values run in generated code."""
    from pyspark.sql import functions as F

    from fretelens.functions.text import LB, loose_pieces, one_of
    from fretelens.operators import lexicon as L
    assert one_of([list("rio"), list("rio branco"), list("sul")]) == "(?:rio(?: branco)?|sul)"
    names = ["Mato Grosso do Sul", "Mato Grosso", "Pará", "Paraná"]
    df = spark.createDataFrame([("mato grosso do sul",), ("MATO GROSSO",), ("parana",), ("para",), ("pará mato",)], "t string")
    body = "(?iu)^(" + one_of(loose_pieces(n) for n in sorted(names, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"
    assert [r[0] for r in df.select(F.regexp_extract("t", body, 1)).collect()] == ["mato grosso do sul", "MATO GROSSO", "parana", "para", "pará"]
    assert L.combine(p for p, _ in L.LEXICON["period"]).count(LB) == 1
    found = df.select(L.distinct_values(F.col("t"), L.LEXICON["situation"]))
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()


def test_texts_are_folded_squashed_and_tested_once(spark):
    """Texts in ASCII or not, with any white space, fold and squash as before; a list of literals has one column."""
    from fretelens.functions.text import fold_text, squash, squash_text
    texts = ["Notas SP", "EMISSÃO às 9", "a  b", " a", "a ", "a\tb", "a  ", "  ", "\n", "", None, "ſ İ", "a  b", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", fold("t").alias("f"), fold_text("t").alias("f2"), squash(F.col("t")).alias("s"), squash_text("t").alias("s2")).collect():
        assert r.f == r.f2 and r.s == r.s2, r
    held = L.Held(F.col("f"), {("a", "b"): F.lit(True)}, F.lit(False))
    row = spark.createDataFrame([("x",)], "f string").select(L.guard(held, ["a", "b"]).alias("known"), L.guard(held, ["c"]).alias("looked"), L.may_hold(held, ["c"]).alias("may")).first()
    assert (row.known, row.looked, row.may) == (True, False, False)


def test_generated_methods_stay_compilable(spark):
    """The JVM runs generated methods above 8,000 bytes interpreted, so none is made."""
    from fretelens.session import apply_job_conf
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    assert int(apply_job_conf(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_lower_case_states_after_place_words(spark):
    """One pass finds the codes after any place word; 'se' counts after 'uf' and 'estado' only."""
    got = _parse(spark, ["notas para mg", "notas uf se", "notas em rj e para rj", "notas para mg e para rj", "notas se para hoje"])
    assert [r["UFDestino"] for r in got] == ["MG", "SE", "RJ", None, None]
