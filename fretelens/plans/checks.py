"""Oracle SQL per registered key (DuckDB dialect).

Each oracle reads the driver tables through the CTEs of :mod:`oracle`
(shipments view, template slots, structured truth) and never parses text.
"""

from __future__ import annotations

from itertools import combinations

from ..functions.calendar import CALENDAR_FIELDS
from ..functions.dictionaries import DETAIL_EMPTY, DETAIL_VAGUE, FILTER_FIELDS, STATES
from ..sources import request_templates as RT
from .oracle import BLANK_TEMPLATES, per_template, q, with_shipments, with_truth


def iso(col: str, alias: str | None = None) -> str:
    return f"strftime({col}, '%Y-%m-%d') AS {alias or col}"


def fields(*names: str) -> str:
    return ", ".join(iso(f) if f in ("DE", "ATE") else f for f in names)


def truth_select(*names: str) -> str:
    return with_truth(f"SELECT request_id, {fields(*names)} FROM truth")


RECORD = [*FILTER_FIELDS, "status", "outcome"]

CALENDAR_SQL = {
    "today": "a", "yesterday": "a - 1", "last_week_start": "ws - 7", "last_week_end": "ws - 1",
    "week_start": "ws", "week_end": "ws + 6", "month_start": "ms", "month_end": "me",
    "semester_start": "make_date(year(a), CASE WHEN month(a) <= 6 THEN 1 ELSE 7 END, 1)",
    "semester_end": "CASE WHEN month(a) <= 6 THEN make_date(year(a), 6, 30) ELSE make_date(year(a), 12, 31) END",
}
CALENDAR_COLS = ", ".join(iso(CALENDAR_SQL[c], c) for c in CALENDAR_FIELDS)


def json_sql(prefix: str = "") -> str:
    parts = []
    for i, f in enumerate(FILTER_FIELDS):
        col = prefix + f
        if f == "NF":
            v = f"COALESCE(CAST({col} AS VARCHAR), 'null')"
        elif f in ("DE", "ATE"):
            v = f"COALESCE('\"' || strftime({col}, '%Y-%m-%d') || '\"', 'null')"
        else:
            v = f"COALESCE('\"' || replace({col}, '\"', '\\\\\"') || '\"', 'null')"
        parts.append(("'{" if i == 0 else "',") + f"\"{f}\":' || {v}")
    return " || ".join(parts) + " || '}'"


def _linked(slot: str) -> str:
    whens = []
    for i, t in enumerate(RT.TEMPLATES):
        has_main = "{" + slot + "}" in t["text"]
        if "needs" in t:
            has_fb = "{" + slot + "}" in t["fallback"]
            if has_fb != has_main:
                whens.append(f"WHEN tpl = {i} AND {t['needs']} IS NULL THEN {slot if has_fb else 'NULL'}")
        if has_main:
            whens.append(f"WHEN tpl = {i} THEN {slot}")
    return "CASE " + " ".join(whens) + " END"


def _cooccurrence() -> str:
    pairs = list(combinations(FILTER_FIELDS, 2))
    counts = ", ".join(f"count_if({a} IS NOT NULL AND {b} IS NOT NULL) AS \"{a}|{b}\"" for a, b in pairs)
    return with_truth(
        f"SELECT split_part(pair, '|', 1) AS field_a, split_part(pair, '|', 2) AS field_b, CAST(n AS BIGINT) AS n "
        f"FROM (UNPIVOT (SELECT {counts} FROM truth) ON COLUMNS(*) INTO NAME pair VALUE n) WHERE n > 0")


def _audit() -> str:
    kinds = ["situation", "performance", "sort", "event", "period"]
    cols = ", ".join(
        per_template("tags", "0", fn=lambda v, k=k: str(v.get(k, 0))) + f" AS {k}" for k in kinds)
    return with_truth(
        f"SELECT kind, CAST(SUM(n) AS BIGINT) AS n_kept, CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_added "
        f"FROM (UNPIVOT (SELECT {cols} FROM truth) ON {', '.join(kinds)} INTO NAME kind VALUE n) "
        f"GROUP BY kind HAVING SUM(n) > 0")


_EVENT = per_template("event")
_EVENT_NO_SORT = "CASE " + " ".join(f"WHEN tpl = {i} THEN {f['event']}" for i, f in RT.FACTS.items()
                                    if "event" in f and not f.get("event_in_sort")) + " END"
_BLANK = ", ".join(str(i) for i in BLANK_TEMPLATES)
_NEGATED = ", ".join(str(i) for i, t in enumerate(RT.TEMPLATES) if t.get("negated"))
_AMBIG = ", ".join(str(i) for i, t in enumerate(RT.TEMPLATES) if t.get("ambiguous") == "situation")
_OUT = ", ".join(str(i) for i, f in RT.FACTS.items() if f.get("out_of_scope"))
_EXPLICIT = ", ".join(str(i) for i, f in RT.FACTS.items() if "explicit" in f)
_DETAIL = f"CASE outcome WHEN 'empty' THEN {q(DETAIL_EMPTY)} WHEN 'vague' THEN {q(DETAIL_VAGUE)} END"
_PROMPT = ("'Data de referência: ' || {t} || chr(10) || {lines} || 'Texto: ' || x.enhanced").format(
    t="strftime(a, '%Y-%m-%d')",
    lines=" || ".join(f"'{c}=' || strftime({CALENDAR_SQL[c]}, '%Y-%m-%d') || chr(10)" for c in CALENDAR_FIELDS))

EVENT_COL = ("CASE TipoData WHEN '1' THEN s.data_agenda WHEN '2' THEN s.data_entrega WHEN '3' THEN s.data_emissao "
             "WHEN '4' THEN s.data_prevista WHEN '5' THEN s.data_previsao_real WHEN '6' THEN s.data_baixa "
             "ELSE s.data_emissao END")


def status_at(at: str) -> str:
    return (f"CASE WHEN s.data_entrega IS NOT NULL THEN 'ENTREGUE' WHEN s.data_prevista < {at} THEN 'ATRASO' "
            f"WHEN s.data_prevista = {at} THEN 'DO DIA' WHEN s.data_prevista = {at} + 1 THEN 'DIA SEGUINTE' "
            f"WHEN s.data_prevista = {at} + 2 THEN 'PREVISTO PARA 2 DIAS' ELSE 'FUTURO' END")


MATCH_CTE = (
    "SELECT t.request_id, t.user_id, t.SortColumn, t.SortDirection, s.* FROM truth t JOIN shipments s ON "
    "(t.NF IS NULL OR s.nf = t.NF) AND (t.Cliente IS NULL OR s.cliente = t.Cliente) "
    "AND (t.Transportadora IS NULL OR s.transportadora = t.Transportadora) "
    "AND (t.UFDestino IS NULL OR s.uf_destino = t.UFDestino) "
    "AND (t.CidadeDestino IS NULL OR s.cidade_destino = t.CidadeDestino) "
    "AND (t.Operacao IS NULL OR s.operacao = t.Operacao) AND (t.SituacaoNF IS NULL OR s.situacao_nf = t.SituacaoNF) "
    "AND (t.CNPJRaizTransp IS NULL OR s.cnpj_raiz_transp = t.CNPJRaizTransp) "
    f"AND (t.DE IS NULL OR {EVENT_COL} BETWEEN t.DE AND t.ATE) "
    f"AND (t.StatusAnaliseData IS NULL OR {status_at('t.a')} = t.StatusAnaliseData) "
    "WHERE t.status = 200")
SORT_KEY = ("CASE WHEN SortDirection = 'DESC' THEN -1 ELSE 1 END * CASE SortColumn "
            "WHEN 'data_entrega' THEN CAST(data_entrega - DATE '1970-01-01' AS DOUBLE) "
            "WHEN 'valor_nf' THEN valor_nf WHEN 'data_emissao' THEN CAST(data_emissao - DATE '1970-01-01' AS DOUBLE) END")
RANKED = (f"SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {SORT_KEY} ASC NULLS LAST, nf ASC) "
          f"AS rank FROM m")


def with_matches(select_sql: str) -> str:
    return with_truth(f", m AS ({MATCH_CTE}), r AS ({RANKED})\n" + select_sql).replace(
        "\n, m AS", ", m AS", 1)


ORACLE = {
    "request_scan": with_truth(
        "SELECT t.request_id, strftime(CAST(a AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts, user_id, x.query "
        "FROM truth t JOIN texts x USING (request_id)"),
    "shipments": with_shipments(
        "SELECT nf, valor_nf, " + ", ".join(iso(c) for c in [
            "data_emissao", "data_agenda", "data_prevista", "data_previsao_real", "data_entrega", "data_baixa"])
        + ", cliente, cod_cliente, transportadora, cnpj_raiz_transp, uf_destino, cidade_destino, operacao, "
          "situacao_nf FROM shipments"),
    "filter_json": with_truth(f"SELECT request_id, {json_sql()} AS filter_json FROM truth"),
    "input_gate": truth_select("blank"),
    "expand_abbrev": with_truth("SELECT request_id, expanded FROM texts"),
    "map_synonyms": with_truth("SELECT request_id, enhanced AS enhanced_query FROM texts"),
    "ambiguity_guard": with_truth(
        f"SELECT request_id, tpl IN ({_AMBIG}) AS ambiguous_situation, false AS ambiguous_performance, "
        f"false AS ambiguous_sort FROM truth"),
    "protected_terms": with_truth(f"SELECT request_id, {_EVENT} AS event_before, {_EVENT} AS event_after FROM truth"),
    "sentence_shape": with_truth(
        f"SELECT request_id, CASE WHEN tpl IN ({_BLANK}) THEN NULL ELSE true END AS starts_upper, "
        f"CASE WHEN tpl IN ({_BLANK}) THEN NULL ELSE right(query, 1) = '?' END AS is_question FROM texts"),
    "preservation_audit": _audit(),
    "calendar_bounds": with_truth(f"SELECT request_id, {CALENDAR_COLS} FROM truth"),
    "bind_period": truth_select("DE", "ATE"),
    "explicit_range": with_truth(
        "SELECT request_id, "
        + iso(per_template("explicit", fn=lambda v: v[0]), "DE") + ", "
        + iso(per_template("explicit", fn=lambda v: v[1]), "ATE") + " FROM truth"),
    "extended_period": with_truth(
        "SELECT request_id, "
        + iso(per_template("named", fn=lambda v: v[0]), "DE") + ", "
        + iso(per_template("named", fn=lambda v: v[1]), "ATE") + " FROM truth"),
    "extract_nf": truth_select("NF"),
    "extract_event": with_truth(f"SELECT request_id, {_EVENT_NO_SORT} AS event FROM truth"),
    "link_customer": with_truth(f"SELECT request_id, Cliente, {_linked('cli')} AS linked_name FROM truth"),
    "link_carrier": with_truth(f"SELECT request_id, Transportadora, {_linked('tr')} AS linked_name FROM truth"),
    "extract_uf": truth_select("UFDestino"),
    "extract_city": truth_select("CidadeDestino"),
    "extract_operation": truth_select("Operacao"),
    "extract_situation": truth_select("SituacaoNF"),
    "extract_performance": truth_select("StatusAnaliseData"),
    "extract_cnpj_root": truth_select("CNPJRaizTransp"),
    "extract_sort": truth_select("SortColumn", "SortDirection"),
    "parse_requests": truth_select(*RECORD),
    "rule_performance_first": truth_select("StatusAnaliseData", "TipoData", "DE", "ATE"),
    "rule_event_period": truth_select("TipoData", "DE", "ATE"),
    "rule_situation": truth_select("SituacaoNF", "TipoData"),
    "rule_delivered": truth_select("TipoData", "SituacaoNF", "StatusAnaliseData"),
    "field_cooccurrence": _cooccurrence(),
    "rule_location": truth_select("UFDestino", "CidadeDestino"),
    "rule_negation": with_truth(
        f"SELECT request_id, tpl IN ({_NEGATED}) AS negated, UFDestino, SituacaoNF, Cliente FROM truth"),
    "rule_nf_exclusive": with_truth(
        "SELECT request_id, NF, " + " + ".join(f"CAST({f} IS NOT NULL AS INTEGER)" for f in FILTER_FIELDS[1:])
        + " AS n_other FROM truth"),
    "rule_time_priority": with_truth(
        f"SELECT request_id, {fields('DE', 'ATE')}, tpl IN ({_EXPLICIT}) AS explicit_used FROM truth"),
    "rule_sort_pair": truth_select("SortColumn", "SortDirection"),
    "rule_scope": with_truth(f"SELECT request_id, tpl NOT IN ({_OUT}) AS in_scope, outcome FROM truth"),
    "all_null": with_truth(
        "SELECT request_id, " + " AND ".join(f"{f} IS NULL" for f in FILTER_FIELDS) + " AS all_null FROM truth"),
    "classify_outcome": with_truth(f"SELECT request_id, status, outcome, {_DETAIL} AS detail FROM truth"),
    "trace_requests": with_truth(
        f"SELECT t.request_id, x.query, {CALENDAR_COLS}, x.enhanced AS enhanced_query, "
        f"{json_sql('t.')} AS parsed_json FROM truth t JOIN texts x USING (request_id)"),
    "apply_filters": with_shipments(
        "SELECT nf, valor_nf, " + iso("data_emissao") + ", cliente, uf_destino, situacao_nf FROM shipments "
        "WHERE situacao_nf = 'TRÂNSITO' AND uf_destino = 'MG' "
        "AND data_emissao BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"),
    "event_dates": with_shipments(
        "SELECT nf, tipo, strftime(dia, '%Y-%m-%d') AS dia FROM (UNPIVOT (SELECT nf, data_agenda AS \"1\", "
        "data_entrega AS \"2\", data_emissao AS \"3\", data_prevista AS \"4\", data_previsao_real AS \"5\", "
        "data_baixa AS \"6\" FROM shipments) ON \"1\", \"2\", \"3\", \"4\", \"5\", \"6\" "
        "INTO NAME tipo VALUE dia) WHERE dia IS NOT NULL"),
    "match_requests": with_matches("SELECT request_id, nf FROM m"),
    "ranked_results": with_matches("SELECT request_id, nf, rank FROM r"),
    "entitled_results": with_matches(
        "SELECT request_id, nf FROM m WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id FROM events) e "
        "JOIN customer c ON e.user_id % 25 = c.c_nationkey WHERE e.user_id = m.user_id AND c.c_name = m.cliente)"),
    "formatted_results": with_matches(
        "SELECT request_id, rank, nf, 'R$ ' || translate(format('{:,.2f}', valor_nf), ',.', '.,') AS valor, "
        "strftime(data_emissao, '%d/%m/%Y') AS emissao, COALESCE(strftime(data_entrega, '%d/%m/%Y'), '-') AS entrega, "
        "situacao_nf AS situacao FROM r"),
    "deadline_status": with_shipments(
        "SELECT s.nf, " + status_at("(SELECT MAX(data_emissao) FROM shipments)") + " AS status FROM shipments s"),
    "render_inputs": with_truth(
        f"SELECT t.request_id, {_PROMPT} AS prompt FROM truth t JOIN texts x USING (request_id)"),
}

from .checks_io import ORACLE_IO  # noqa: E402

ORACLE.update(ORACLE_IO)
ORACLE["stream_parse"] = ORACLE["parse_requests"]
ORACLE["stream_match"] = ORACLE["match_requests"]

_UFS = "[" + ", ".join(q(s) for s in STATES) + "]"
ORACLE["link_city"] = (
    "WITH t AS (SELECT n_nationkey AS k, list_aggregate(list_transform(string_split(lower(n_name), ' '), "
    "lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') AS city, "
    f"({_UFS})[n_nationkey + 1] AS uf, n_nationkey % 5 = 0 AS twice FROM nation), "
    "r AS (SELECT o_orderkey AS request_id, o_orderkey % 4 AS form, t.* FROM orders JOIN t ON t.k = (o_orderkey // 4) % 25) "
    "SELECT request_id, CASE WHEN form < 2 THEN city END AS CidadeDestino, CASE WHEN form = 1 THEN uf END AS UFDestino, "
    "form = 0 AND twice AS city_ambiguous FROM r")
