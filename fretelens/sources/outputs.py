"""Model-output scan (A4) and its stand-in.

The service reads generated text and parses the JSON in it.  Generated
text is not in the driver tables, so each shipment yields one output in one
of six shapes (plain JSON; reasoning + ``JSON FINAL:``; two markers; no
JSON; truncated JSON; JSON with values outside their domain), which is
what output recovery and parsing (F4, F5, E12) must cope with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUTPUT_SHAPES = 6


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """A4: (request_id, raw_text) stored as parquet."""
    return spark.read.parquet(path).select("request_id", "raw_text")


def _s(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _json(ships: DataFrame, op: Column, sit: Column) -> Column:
    return F.concat(
        F.lit('{"NF": null, "DE": '), _s(F.date_format("data_emissao", "yyyy-MM-dd")),
        F.lit(', "ATE": '), _s(F.date_format("data_prevista", "yyyy-MM-dd")),
        F.lit(', "TipoData": "3", "Cliente": '), _s(F.col("cliente")),
        F.lit(', "UFDestino": '), _s(F.col("uf_destino")),
        F.lit(', "Operacao": '), op,
        F.lit(', "SituacaoNF": '), sit,
        F.lit(', "SortColumn": null, "SortDirection": null}'),
    )


def answering(ships: DataFrame):
    """Stand-in generator of :func:`generate.regenerate`: texts of
    :func:`render_outputs`, of which the malformed ones (shapes 3 and 4) come
    right at attempt 2, 3 or 4 by a rule of the id."""
    texts = render_outputs(ships)
    good = _json(ships, _s(F.col("operacao")), _s(F.col("situacao_nf")))
    right = ships.select(F.col("nf").alias("request_id"), good.alias("good"))
    both = texts.join(right, "request_id")

    def generate(todo: DataFrame) -> DataFrame:
        needs = 2 + F.floor(F.col("request_id") / OUTPUT_SHAPES) % 3
        bad = (F.col("request_id") % OUTPUT_SHAPES).isin(3, 4)
        text = F.when(bad & (F.col("attempt") >= needs), F.col("good")).otherwise(F.col("raw_text"))
        return todo.join(both, "request_id").withColumn("raw_text", text)
    return generate


def render_outputs(ships: DataFrame) -> DataFrame:
    """(request_id, raw_text): one generated text per shipment."""
    good = _json(ships, _s(F.col("operacao")), _s(F.col("situacao_nf")))
    bad_enum = _json(ships, F.lit('"VENDA"'), F.lit('"EM TRÂNSITO"'))
    shape = F.col("nf") % OUTPUT_SHAPES
    raw = (F.when(shape == 0, good)
            .when(shape == 1, F.concat(F.lit("Pensamento: notas do cliente "), F.col("cliente"),
                                       F.lit(".\nJSON FINAL: "), good))
            .when(shape == 2, F.concat(F.lit('json final: {"NF": 1}\nRevisão: corrigido.\nJSON FINAL:\n'), good))
            .when(shape == 3, F.lit("Não encontrei filtros para esta consulta."))
            .when(shape == 4, F.concat(F.substring(good, 1, 40), F.lit("}")))
            .otherwise(bad_enum))
    return ships.select(F.col("nf").alias("request_id"), raw.alias("raw_text"))
