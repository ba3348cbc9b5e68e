"""The re-generation loop: what goes back, with what, and how often."""

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from fretelens.operators.generate import attempts_needed, regenerate, row_generator


cloudpickle.register_pickle_by_value(sys.modules[__name__])    # workers can't import tests


def _by_refusals(prompts: pd.Series) -> pd.Series:
    """Answers right once the prompt holds what its last line before a refusal asks for."""
    out = []
    for p in prompts:
        want, refused = p.split("\n")[0], p.count("Resposta recusada: ")
        if want == "at once" or (want == "on error" and refused and "Erro: nenhum objeto JSON" in p):
            out.append('JSON FINAL: {"Cliente": "ACME"}')
        elif want == "cut":
            out.append('{"Cliente": "AC' if not refused else ('{"NF": 5}' if "Erro: nenhum objeto JSON" in p or "incompleto" in p else "?"))
        else:
            out.append(None if want == "nothing" else "sem filtros")
    return pd.Series(out, index=prompts.index)


def test_only_refused_rows_go_back(spark):
    rows = [(1, "at once"), (2, "on error"), (2, "at once"), (3, "nothing"), (4, "never"), (5, "cut"), (None, "on error")]
    asked = []

    def generate(todo):
        asked.append(sorted((r["request_id"] or 0, r["attempt"], r["prompt"].count("recusada")) for r in todo.collect()))
        return row_generator(_by_refusals)(todo)

    out = regenerate(spark.createDataFrame(rows, "request_id long, prompt string"), generate, passes=3)
    got = sorted((r["request_id"] or 0, r["attempts"], r["parse_ok"], r["status"], r["error"]) for r in out.collect())
    assert got == [(0, 2, True, 200, None), (1, 1, True, 200, None), (2, 1, True, 200, None), (2, 2, True, 200, None),
                   (3, 3, False, 500, "sem resposta"), (4, 3, False, 500, "nenhum objeto JSON"), (5, 2, True, 200, None)]
    # all rows first, then the refused ones, with one refusal each however often they came back
    assert [len(a) for a in asked] == [7, 5, 2] and {n for a in asked[1:] for _, _, n in a} == {1}
    assert {(r["attempts"], r["parse_ok"]): r["n_rows"] for r in attempts_needed(out).collect()} == {(1, True): 2, (2, True): 3, (3, False): 2}


def test_generators_that_drop_rows_and_empty_input(spark):
    prompts = spark.createDataFrame([(1, "at once"), (2, "at once")], "request_id long, prompt string")
    out = regenerate(prompts, lambda t: row_generator(_by_refusals)(t).where(F.col("request_id") == 1), passes=2)
    assert sorted((r["request_id"], r["attempts"], r["error"]) for r in out.collect()) == [(1, 1, None), (2, 2, "sem resposta")]
    assert regenerate(prompts.limit(0), row_generator(_by_refusals)).count() == 0
