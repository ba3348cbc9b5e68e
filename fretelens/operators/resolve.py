"""Resolution rules (E1-E11): raw extractions -> one filter record.

Rules run in a fixed order inside one projection:
E9 explicit time first, E4 "entregue" without a period is the situation,
E2 an event needs a period, E1 a time-relative performance status drops a
period that no other event asks for, E10 sort pair, E11 out-of-domain -> all null, and E8
NF exclusive last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import FILTER_FIELDS

TIME_RELATIVE = ["DO DIA", "DIA SEGUINTE", "PREVISTO PARA 2 DIAS"]


def _null(dtype: str) -> Column:
    return F.lit(None).cast(dtype)


FIELD_TYPES = {
    "NF": "bigint", "DE": "date", "ATE": "date", "TipoData": "string", "Cliente": "string",
    "Transportadora": "string", "UFDestino": "string", "CidadeDestino": "string", "Operacao": "string",
    "SituacaoNF": "string", "StatusAnaliseData": "string", "CNPJRaizTransp": "string",
    "SortColumn": "string", "SortDirection": "string",
}


def filter_columns(df: DataFrame) -> dict[str, Column]:
    """Column expressions for the 14 fields (needs extract + link columns)."""
    period = F.coalesce(F.col("x_explicit"), F.col("x_named"))                    # E9
    event = F.col("x_event")
    bare_delivered = (event == "2") & ~F.col("x_has_period")                       # E4
    sit_vals = F.when(bare_delivered, F.array_union(F.col("x_sit_vals"), F.array(F.lit("ENTREGUE")))) \
                .otherwise(F.col("x_sit_vals"))
    perf = F.col("x_perf")
    # A time-relative status owns the period, unless an event outside the status phrase asks for it
    relative = F.coalesce(perf.isin(TIME_RELATIVE), F.lit(False)) & event.isNull()
    tipo = F.when(period.isNotNull(), event)                                       # E2
    de = F.when(~relative, period.DE)
    ate = F.when(~relative, period.ATE)
    sort_col = F.col("x_sort_col")
    cols = {
        "NF": F.col("x_nf"),
        "DE": de,
        "ATE": ate,
        "TipoData": tipo,
        # a link counts only where the rule text still names the entity
        "Cliente": F.when(F.col("x_cli_raw").isNotNull(), F.coalesce(F.col("linked_cliente"), F.col("x_cli_raw"))),
        "Transportadora": F.when(F.col("x_tr_raw").isNotNull(),
                                 F.coalesce(F.col("linked_transportadora"), F.col("x_tr_raw"))),
        "UFDestino": F.col("x_uf"),
        "CidadeDestino": F.col("x_city"),
        "Operacao": F.col("x_op"),
        "SituacaoNF": F.when(F.size(sit_vals) == 1, sit_vals[0]),
        "StatusAnaliseData": perf,
        "CNPJRaizTransp": F.col("x_cnpj"),
        "SortColumn": sort_col,
        "SortDirection": F.when(sort_col.isNotNull(), F.col("x_sort_dir")),      # E10
    }
    in_scope = F.col("x_domain") | F.col("x_op").isNotNull() | F.col("x_nf").isNotNull() \
        | F.col("x_cnpj").isNotNull()                                              # E11
    has_nf = F.col("x_nf").isNotNull()                                             # E8
    out = {}
    for name in FILTER_FIELDS:
        c = cols[name]
        if name != "NF":
            c = F.when(~has_nf, c)
        out[name] = F.when(in_scope & ~F.col("blank"), c).otherwise(_null(FIELD_TYPES[name])) \
                     .cast(FIELD_TYPES[name])
    return out


def resolve(df: DataFrame) -> DataFrame:
    return df.withColumns(filter_columns(df))
