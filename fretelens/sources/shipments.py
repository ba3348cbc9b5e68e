"""Shipments source (A5) and the long form of its event dates.

Grain: one shipment ("nota fiscal") per order.  The carrier of an order is
the supplier of its lowest supplier key among its line items; orders without
line items keep a NULL carrier.  Dates other than the issue date are derived
from the keys (the driver tables carry no such dates).

Plan shape: lineitem is reduced to one row per order by a partial
(map-side) aggregate before its shuffle; the join with orders reuses that
hash partitioning, so only orders are shuffled once more.  Customers and
suppliers are joined by key and AQE broadcasts them only when their
runtime size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from .tables import table

EVENT_DATE_COLUMNS = {
    "1": "data_agenda", "2": "data_entrega", "3": "data_emissao",
    "4": "data_prevista", "5": "data_previsao_real", "6": "data_baixa",
}


def _pick(values: list[str], one_based: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), one_based.cast("int"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                               "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    li = (table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
          .groupBy("l_orderkey").agg(F.min("l_suppkey").alias("carrier_key")))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    x = (o.join(c, o.o_custkey == c.c_custkey)
          .join(li, o.o_orderkey == li.l_orderkey, "left")
          .join(s, li.carrier_key == s.s_suppkey, "left"))
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    issued = F.to_date("o_orderdate")
    delivered = F.col("o_orderstatus") == "F"

    def plus(n: Column) -> Column:
        return F.date_add(issued, n.cast("int"))

    return x.select(
        k.alias("nf"),
        F.col("o_totalprice").alias("valor_nf"),
        issued.alias("data_emissao"),
        plus(1 + k % 6).alias("data_agenda"),
        plus(3 + ck % 8).alias("data_prevista"),
        plus(1 + ck % 8 + k % 5).alias("data_previsao_real"),
        F.when(delivered, plus(1 + k % 12)).alias("data_entrega"),
        F.when(delivered, plus(2 + k % 12 + k % 3)).alias("data_baixa"),
        F.col("c_name").alias("cliente"),
        ck.alias("cod_cliente"),
        F.col("s_name").alias("transportadora"),
        F.when(F.col("s_suppkey").isNotNull(), F.lpad(F.col("s_suppkey").cast("string"), 8, "0"))
         .alias("cnpj_raiz_transp"),
        _pick(D.STATES, F.col("c_nationkey") + 1).alias("uf_destino"),
        _pick(D.CAPITALS, F.col("c_nationkey") + 1).alias("cidade_destino"),
        _pick(D.OPERATIONS, ck % 10 + 1).alias("operacao"),
        F.when(F.col("o_orderstatus") == "F", "ENTREGUE").when(F.col("o_orderstatus") == "O", "TRÂNSITO")
         .when(F.col("o_orderstatus") == "P", "RETIDA").alias("situacao_nf"),
    )


def event_dates(ships: DataFrame) -> DataFrame:
    """The six event dates as rows (nf, tipo, dia); NULL dates dropped."""
    pairs = ", ".join(f"'{t}', {c}" for t, c in EVENT_DATE_COLUMNS.items())
    return (ships.select("nf", F.expr(f"stack({len(EVENT_DATE_COLUMNS)}, {pairs}) AS (tipo, dia)"))
                 .where(F.col("dia").isNotNull()))
