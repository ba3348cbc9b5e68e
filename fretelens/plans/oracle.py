"""DuckDB oracle SQL for the registered queries.

The oracle never parses text.  It rebuilds the shipments view, takes the
template and slot values each request was rendered from, and writes the
structured truth directly; matching, ranking and aggregates are then
written with plain joins and GROUP BY.
"""

from __future__ import annotations

import re

from ..functions import dictionaries as D
from ..sources import request_templates as RT

FIELD_SQL_TYPES = {
    "NF": "BIGINT", "DE": "DATE", "ATE": "DATE", "TipoData": "VARCHAR", "Cliente": "VARCHAR",
    "Transportadora": "VARCHAR", "UFDestino": "VARCHAR", "CidadeDestino": "VARCHAR", "Operacao": "VARCHAR",
    "SituacaoNF": "VARCHAR", "StatusAnaliseData": "VARCHAR", "CNPJRaizTransp": "VARCHAR",
    "SortColumn": "VARCHAR", "SortDirection": "VARCHAR",
}


def q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


SHIPMENTS_CTE = f"""
carrier AS (SELECT l_orderkey, MIN(l_suppkey) AS carrier_key FROM lineitem GROUP BY l_orderkey),
shipments AS (
  SELECT o.o_orderkey AS nf, o.o_totalprice AS valor_nf, CAST(o.o_orderdate AS DATE) AS data_emissao,
    CAST(o.o_orderdate AS DATE) + CAST(1 + o.o_orderkey % 6 AS INTEGER) AS data_agenda,
    CAST(o.o_orderdate AS DATE) + CAST(3 + o.o_custkey % 8 AS INTEGER) AS data_prevista,
    CAST(o.o_orderdate AS DATE) + CAST(1 + o.o_custkey % 8 + o.o_orderkey % 5 AS INTEGER) AS data_previsao_real,
    CASE WHEN o.o_orderstatus = 'F' THEN CAST(o.o_orderdate AS DATE) + CAST(1 + o.o_orderkey % 12 AS INTEGER) END
      AS data_entrega,
    CASE WHEN o.o_orderstatus = 'F'
      THEN CAST(o.o_orderdate AS DATE) + CAST(2 + o.o_orderkey % 12 + o.o_orderkey % 3 AS INTEGER) END AS data_baixa,
    c.c_name AS cliente, o.o_custkey AS cod_cliente, s.s_name AS transportadora,
    CASE WHEN s.s_suppkey IS NOT NULL THEN lpad(CAST(s.s_suppkey AS VARCHAR), 8, '0') END AS cnpj_raiz_transp,
    ({lst(D.STATES)})[c.c_nationkey + 1] AS uf_destino,
    ({lst(D.CAPITALS)})[c.c_nationkey + 1] AS cidade_destino,
    ({lst(D.OPERATIONS)})[o.o_custkey % 10 + 1] AS operacao,
    CASE o.o_orderstatus WHEN 'F' THEN 'ENTREGUE' WHEN 'O' THEN 'TRÂNSITO' WHEN 'P' THEN 'RETIDA' END AS situacao_nf
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN carrier l ON l.l_orderkey = o.o_orderkey
  LEFT JOIN supplier s ON s.s_suppkey = l.carrier_key)"""


def _case_mod(mod: int, values) -> str:
    return "CASE nf % {} {} END".format(mod, " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)))


BASE_CTE = SHIPMENTS_CTE + f""",
base0 AS (
  SELECT *, data_emissao AS a,
    data_emissao - CAST(isodow(data_emissao) - 1 AS INTEGER) AS ws,
    CAST(date_trunc('month', data_emissao) AS DATE) AS ms,
    last_day(data_emissao) AS me
  FROM shipments),
base AS (
  SELECT *, nf % {RT.N_TEMPLATES} AS tpl, cliente AS cli, transportadora AS tr, cnpj_raiz_transp AS cnpj,
    uf_destino AS uf, cidade_destino AS city, operacao AS op, ws - 7 AS lws,
    ({lst([c for _, c in RT.EVENTS])})[nf % {RT.SLOT_MOD['ev']} + 1] AS ev_code,
    {_case_mod(RT.SLOT_MOD['per'], [p[1].replace('lws', '(ws - 7)') for p in RT.PERIODS])} AS per_de,
    {_case_mod(RT.SLOT_MOD['per'], [p[2].replace('lws', '(ws - 7)') for p in RT.PERIODS])} AS per_ate,
    {_case_mod(RT.SLOT_MOD['ag'], [p[1] for p in RT.AGENDA])} AS ag_de,
    {_case_mod(RT.SLOT_MOD['ag'], [p[2] for p in RT.AGENDA])} AS ag_ate,
    ({lst([v for _, v in RT.SITUATIONS])})[nf % {RT.SLOT_MOD['sit']} + 1] AS sit_val,
    ({lst([v for _, v in RT.PERFORMANCE])})[nf % {RT.SLOT_MOD['perf']} + 1] AS perf_val,
    ({lst([s[1] for s in RT.SORTS])})[nf % {RT.SLOT_MOD['srt']} + 1] AS srt_col,
    ({lst([s[2] for s in RT.SORTS])})[nf % {RT.SLOT_MOD['srt']} + 1] AS srt_dir,
    cidade_destino IN ({', '.join(q(n) for n in D.STATE_NAMES)}) AS city_is_state,
    make_date(year(data_emissao), month(data_emissao),
              least(day(data_emissao) + 4, day(last_day(data_emissao)))) AS range_end
  FROM base0)"""


def _field_case(field: str) -> str:
    whens = []
    for i, t in enumerate(RT.TEMPLATES):
        if "needs" in t:
            fb = t["fallback_expect"].get(field)
            whens.append(f"WHEN tpl = {i} AND {t['needs']} IS NULL THEN {fb if fb else 'NULL'}")
        e = t["expect"].get(field)
        whens.append(f"WHEN tpl = {i} THEN {e if e else 'NULL'}")
    return f"CAST(CASE {' '.join(whens)} END AS {FIELD_SQL_TYPES[field]})"


BLANK_TEMPLATES = [i for i, t in enumerate(RT.TEMPLATES) if t.get("blank")]

TRUTH_CTE = BASE_CTE + """,
truth0 AS (
  SELECT nf AS request_id, * EXCLUDE (nf, cliente, transportadora, operacao), cod_cliente % 150 AS user_id, tpl IN ({blank}) AS blank,
    {fields}
  FROM base),
truth AS (
  SELECT *,
    CASE WHEN blank THEN 'empty' WHEN {allnull} THEN 'vague' ELSE 'ok' END AS outcome,
    CASE WHEN blank OR {allnull} THEN 400 ELSE 200 END AS status
  FROM truth0)""".format(
    blank=", ".join(str(i) for i in BLANK_TEMPLATES) or "-1",
    fields=",\n    ".join(f"{_field_case(f)} AS {f}" for f in D.FILTER_FIELDS),
    allnull=" AND ".join(f"{f} IS NULL" for f in D.FILTER_FIELDS),
)


def with_truth(select_sql: str) -> str:
    """SQL with CTEs ``shipments``, ``base``, ``truth`` and ``texts`` in scope."""
    texts = (",\ntexts AS (SELECT nf AS request_id, tpl, {q} AS query, "
             "CASE WHEN tpl IN ({b}) THEN NULL ELSE upper(left({e}, 1)) || substr({e}, 2) END AS enhanced, "
             "CASE WHEN tpl IN ({b}) THEN '' ELSE {x} END AS expanded FROM base)").format(
        q=render_text_sql("text"), e=render_text_sql("enhanced"), x=render_text_sql("expanded"),
        b=", ".join(str(i) for i in BLANK_TEMPLATES) or "-1")
    return "WITH " + TRUTH_CTE + texts + "\n" + select_sql


def per_template(key: str, default: str = "NULL", fn=lambda v: v) -> str:
    """CASE over templates of a FACTS entry."""
    whens = [f"WHEN tpl = {i} THEN {fn(f[key])}" for i, f in RT.FACTS.items() if key in f]
    return f"CASE {' '.join(whens)} ELSE {default} END" if whens else default


def with_shipments(select_sql: str) -> str:
    return "WITH " + SHIPMENTS_CTE + "\n" + select_sql


def render_text_sql(variant: str = "text") -> str:
    """DuckDB rendering of the request text, or of its expected normalised
    (``enhanced``) or abbreviation-expanded (``expanded``) form."""
    slots = {
        "nf": "CAST(nf AS VARCHAR)", "cli": "cli", "tr": "tr", "cnpj": "cnpj", "uf": "uf",
        "state": f"({lst(D.STATE_NAMES)})[list_position({lst(D.STATES)}, uf)]", "city": "city", "op": "op",
        "ev": f"({lst([p for p, _ in RT.EVENTS])})[nf % {RT.SLOT_MOD['ev']} + 1]",
        "per": f"({lst([p[0] for p in RT.PERIODS])})[nf % {RT.SLOT_MOD['per']} + 1]",
        "ag": f"({lst([p[0] for p in RT.AGENDA])})[nf % {RT.SLOT_MOD['ag']} + 1]",
        "sit": f"({lst([p for p, _ in RT.SITUATIONS])})[nf % {RT.SLOT_MOD['sit']} + 1]",
        "perf": f"({lst([p for p, _ in RT.PERFORMANCE])})[nf % {RT.SLOT_MOD['perf']} + 1]",
        "srt": f"({lst([p[0] for p in RT.SORTS])})[nf % {RT.SLOT_MOD['srt']} + 1]",
        "d1": "strftime(data_emissao, '%d/%m/%Y')", "d2": "strftime(data_prevista, '%d/%m/%Y')",
        "dd1": "CAST(day(data_emissao) AS VARCHAR)",
        "dd2": "CAST(least(day(data_emissao) + 4, day(last_day(data_emissao))) AS VARCHAR)",
        "month": f"({lst(D.MONTHS)})[month(data_emissao)]", "year": "CAST(year(data_emissao) AS VARCHAR)",
        "sit_c": f"({lst(RT.SITUATIONS_CANON)})[nf % {RT.SLOT_MOD['sit']} + 1]",
        "srt_c": f"({lst(RT.SORTS_CANON)})[nf % {RT.SLOT_MOD['srt']} + 1]",
        "perf_c": f"({lst(RT.PERFORMANCE_CANON)})[nf % {RT.SLOT_MOD['perf']} + 1]",
    }

    def pick(t: dict, fallback: bool) -> str:
        pre = "fallback_" if fallback else ""
        base = t["fallback" if fallback else "text"]
        if variant == "text":
            return base
        return t.get(pre + variant, t.get(pre + "enhanced", base) if variant == "expanded" else base)

    def render(text: str) -> str:
        parts = [p for p in re.split(r"(\{\w+\})", text) if p]
        return "(" + " || ".join(slots[p[1:-1]] if p.startswith("{") else q(p) for p in parts) + ")"

    whens = []
    for i, t in enumerate(RT.TEMPLATES):
        if "needs" in t:
            whens.append(f"WHEN tpl = {i} AND {t['needs']} IS NULL THEN {render(pick(t, True))}")
        whens.append(f"WHEN tpl = {i} THEN {render(pick(t, False))}")
    return "CASE " + " ".join(whens) + " END"
