"""Output recovery (F4), parsing (F5), domain checks (E12) and all-null (F1)."""

from pyspark.sql import functions as F

from fretelens.operators.outcome import domain_report, output_parse, recover_block


def _blocks(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    return [r.b for r in df.select(recover_block(F.col("raw")).alias("b")).collect()]


def test_recover_block(spark):
    got = _blocks(spark, [
        'pensando...\nJSON FINAL: {"NF": 1}',
        'json final: {"NF": 1}\nmais texto\nJSON FINAL:\n{"NF": 2}',
        'sem marcador {"NF": 3} e fim}',
        "nenhum json aqui",
        "JSON FINAL:",
    ])
    assert got == ['{"NF": 1}', '{"NF": 2}', '{"NF": 3} e fim}', "{}", "{}"]


def test_output_parse_and_all_null(spark):
    rows = [(1, '{"NF": null, "Cliente": null}'), (2, "{}"), (3, '{"NF": ""}'), (4, '{"NF": 5, "Cliente": }'),
            (5, '{"Operacao": "VENDA", "SituacaoNF": "EM TRÂNSITO", "UFDestino": "SP"}'), (6, '{"NF": "55432"}')]
    df = spark.createDataFrame(rows, "request_id bigint, raw_text string")
    out = {r.request_id: r for r in output_parse(df).collect()}
    assert out[1].all_null and out[1].status == 400
    assert out[2].all_null and out[2].status == 400
    assert out[3].all_null and out[3].status == 400            # judged on the typed record: "" sets no field
    assert not out[4].parse_ok and out[4].status == 500        # truncated JSON quarantined
    assert out[5].Operacao is None and out[5].SituacaoNF is None and out[5].UFDestino == "SP"
    assert sorted(out[5].invalid_fields) == ["Operacao", "SituacaoNF"]
    assert out[6].NF == 55432                                  # numbers as text still parse
    rep = {r.field: r.n_invalid for r in domain_report(output_parse(df)).collect()}
    assert rep == {"Operacao": 1, "SituacaoNF": 1}


def test_broken_outputs_are_quarantined(spark):
    texts = [None, "", "sem json", '{"NF": 5, "Cliente": "Acm', '[{"NF": 4}]', '{"NF": 3} e fim}', "JSON FINAL:", '{"NF": 1} {"NF": 2}']
    df = spark.createDataFrame(list(enumerate(texts)), "request_id bigint, raw_text string")
    assert {r.status for r in output_parse(df).collect()} == {500}


def test_failed_casts_are_reported_and_never_match_everything(spark):
    rows = [(1, '{"NF":"abc","DE":"31/02/2025"}'), (2, '{"Operacao":"VENDA"}'), (3, '{"CNPJRaizTransp": "12", "SortDirection": "ASC", "TipoData": "9", "Cliente": "A"}'),
            (4, '{"DE": "2025-02-10", "ATE": "2025-02-01", "UFDestino": "XX", "SortColumn": "peso", "Cliente": "A {b} \\" c"}'), (5, '{"NF": 7, "Cliente": "Acme", "UFDestino": "SP"}')]
    df = spark.createDataFrame(rows, "request_id bigint, raw_text string")
    out = {r.request_id: r for r in output_parse(df).collect()}
    assert out[1].status == out[2].status == 400 and sorted(out[1].invalid_fields) == ["DE", "NF"]
    assert out[3].status == 200 and sorted(out[3].invalid_fields) == ["CNPJRaizTransp", "SortDirection", "TipoData"]
    assert sorted(out[4].invalid_fields) == ["ATE", "DE", "SortColumn", "UFDestino"] and out[4].Cliente == 'A {b} " c'
    assert out[5].NF == 7 and out[5].Cliente is None and out[5].UFDestino is None


def test_domain_report_keeps_the_parsing_out_of_filters(spark):
    """A filter on ``invalid_fields`` below the parsing would hold its expressions many times over."""
    df = spark.range(12).select("id", F.when(F.col("id") % 3 == 0, F.lit('{"Operacao": "VENDA"}')).alias("raw_text"))
    report = domain_report(output_parse(df))
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 2 and not [line for line in plan.split("\n") if "Filter" in line and "raw_text" in line]
    assert [tuple(r) for r in report.collect()] == [("Operacao", 4)]
