"""Request sources (A2) and the stand-in request corpus rendered from shipments."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dictionaries as D
from . import request_templates as RT

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("query", T.StringType()),
])


def read_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A2: one request per row.  A JSON body whose ``query`` is missing or no
    string, or that is no JSON object, keeps its line in ``_corrupt_record``
    and a NULL ``query``, which the B1 gate rejects downstream; the job goes on."""
    if fmt != "json":
        return spark.read.schema(REQUEST_SCHEMA).format(fmt).load(path)
    # a schema of its own for every call: StructType.add changes its object in place
    schema = T.StructType([*REQUEST_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    body = spark.read.text(path).select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    kind = F.get_json_object("value", "$.query")
    # the parser turns numbers and objects into text; only a quoted value is a string
    text = F.rlike("value", F.lit(r'"query"\s*:\s*"')) & kind.isNotNull()
    fields = [F.col(f"r.{f.name}").alias(f.name) for f in REQUEST_SCHEMA.fields if f.name != "query"]
    return body.select(*fields, F.when(text, F.col("r.query")).alias("query"),
                       F.coalesce(F.col("r._corrupt_record"), F.when(~text, F.col("value"))).alias("_corrupt_record"))


def _pick(values, one_based: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), one_based.cast("int"))


def _slots(nf: Column) -> dict[str, Column]:
    issued = F.col("data_emissao")
    day = F.dayofmonth(issued)
    state_name = F.create_map(*[x for c, n in zip(D.STATES, D.STATE_NAMES) for x in (F.lit(c), F.lit(n))])
    return {
        "nf": nf.cast("string"),
        "cli": F.col("cliente"),
        "tr": F.col("transportadora"),
        "cnpj": F.col("cnpj_raiz_transp"),
        "uf": F.col("uf_destino"),
        "state": F.element_at(state_name, F.col("uf_destino")),
        "city": F.col("cidade_destino"),
        "op": F.col("operacao"),
        "ev": _pick([p for p, _ in RT.EVENTS], nf % RT.SLOT_MOD["ev"] + 1),
        "per": _pick([p[0] for p in RT.PERIODS], nf % RT.SLOT_MOD["per"] + 1),
        "ag": _pick([p[0] for p in RT.AGENDA], nf % RT.SLOT_MOD["ag"] + 1),
        "sit": _pick([p for p, _ in RT.SITUATIONS], nf % RT.SLOT_MOD["sit"] + 1),
        "sit_c": _pick(RT.SITUATIONS_CANON, nf % RT.SLOT_MOD["sit"] + 1),
        "srt_c": _pick(RT.SORTS_CANON, nf % RT.SLOT_MOD["srt"] + 1),
        "perf_c": _pick(RT.PERFORMANCE_CANON, nf % RT.SLOT_MOD["perf"] + 1),
        "perf": _pick([p for p, _ in RT.PERFORMANCE], nf % RT.SLOT_MOD["perf"] + 1),
        "srt": _pick([p[0] for p in RT.SORTS], nf % RT.SLOT_MOD["srt"] + 1),
        "d1": F.date_format(issued, "dd/MM/yyyy"),
        "d2": F.date_format(F.col("data_prevista"), "dd/MM/yyyy"),
        "dd1": day.cast("string"),
        "dd2": F.least(day + 4, F.dayofmonth(F.last_day(issued))).cast("string"),
        "month": _pick(D.MONTHS, F.month(issued)),
        "year": F.year(issued).cast("string"),
    }


def _render(text: str, slots: dict[str, Column]) -> Column:
    parts = [p for p in re.split(r"(\{\w+\})", text) if p]
    return F.concat(*[slots[p[1:-1]] if p.startswith("{") else F.lit(p) for p in parts])


def render_requests(ships: DataFrame) -> DataFrame:
    """One request per shipment: (request_id, ts, user_id, query)."""
    nf = F.col("nf")
    slots = _slots(nf)
    tpl = nf % RT.N_TEMPLATES
    text = None
    for i, t in enumerate(RT.TEMPLATES):
        branches = []
        if "needs" in t:
            branches.append(((tpl == i) & slots[t["needs"]].isNull(), _render(t["fallback"], slots)))
        branches.append((tpl == i, _render(t["text"], slots)))
        for cond, val in branches:
            text = F.when(cond, val) if text is None else text.when(cond, val)
    return ships.select(
        nf.alias("request_id"),
        F.col("data_emissao").cast("timestamp_ntz").alias("ts"),
        (F.col("cod_cliente") % 150).alias("user_id"),
        text.alias("query"),
    )


def render_labels(ships: DataFrame) -> DataFrame:
    """The structured record each rendered request was built from
    (request_id + 14 fields): the labelled side of the generated corpus,
    used to measure extraction quality (H1).  Built from the same slots as
    :func:`render_requests`, never from the text."""
    nf = F.col("nf")
    a = F.col("data_emissao")
    ws = F.date_sub(a, F.weekday(a))

    def pick_mod(values, mod):
        return _pick(values, nf % mod + 1)

    def case_mod(exprs, mod):
        out = None
        for i, e in enumerate(exprs):
            out = F.when(nf % mod == i, e) if out is None else out.when(nf % mod == i, e)
        return out

    env = {
        "a": a, "ws": ws, "lws": F.date_sub(ws, 7), "ms": F.trunc(a, "MM"), "me": F.last_day(a),
        "tpl": nf % RT.N_TEMPLATES, "cli": F.col("cliente"), "tr": F.col("transportadora"),
        "cnpj": F.col("cnpj_raiz_transp"), "uf": F.col("uf_destino"), "city": F.col("cidade_destino"),
        "op": F.col("operacao"),
        "ev_code": pick_mod([c for _, c in RT.EVENTS], RT.SLOT_MOD["ev"]),
        "sit_val": pick_mod([v for _, v in RT.SITUATIONS], RT.SLOT_MOD["sit"]),
        "perf_val": pick_mod([v for _, v in RT.PERFORMANCE], RT.SLOT_MOD["perf"]),
        "srt_col": pick_mod([x[1] for x in RT.SORTS], RT.SLOT_MOD["srt"]),
        "srt_dir": pick_mod([x[2] for x in RT.SORTS], RT.SLOT_MOD["srt"]),
        "city_is_state": F.col("cidade_destino").isin(D.STATE_NAMES),
        "range_end": F.make_date(F.year(a), F.month(a),
                                 F.least(F.dayofmonth(a) + 4, F.dayofmonth(F.last_day(a)))),
    }
    base = ships.withColumns(env)
    base = base.withColumns({
        "per_de": case_mod([F.expr(p[1]) for p in RT.PERIODS], RT.SLOT_MOD["per"]),
        "per_ate": case_mod([F.expr(p[2]) for p in RT.PERIODS], RT.SLOT_MOD["per"]),
        "ag_de": case_mod([F.expr(p[1]) for p in RT.AGENDA], RT.SLOT_MOD["ag"]),
        "ag_ate": case_mod([F.expr(p[2]) for p in RT.AGENDA], RT.SLOT_MOD["ag"]),
    })
    types = {"NF": "bigint", "DE": "date", "ATE": "date"}
    cols = {}
    for field in D.FILTER_FIELDS:
        out = None
        for i, t in enumerate(RT.TEMPLATES):
            branches = []
            if "needs" in t:
                fb = t["fallback_expect"].get(field)
                branches.append(((F.col("tpl") == i) & F.col(t["needs"]).isNull(), F.expr(fb) if fb else F.lit(None)))
            e = t["expect"].get(field)
            branches.append((F.col("tpl") == i, F.expr(e) if e else F.lit(None)))
            for cond, val in branches:
                out = F.when(cond, val) if out is None else out.when(cond, val)
        cols[field] = out.cast(types.get(field, "string"))
    return base.select(nf.alias("request_id"), *[cols[f].alias(f) for f in D.FILTER_FIELDS])
