"""Oracle SQL for the corpus, log, model-output and evaluation keys."""

from __future__ import annotations

from ..functions.dictionaries import (FILTER_FIELDS, LOG_MSG_ERROR, LOG_MSG_RECEIVED, LOG_MSG_VAGUE,
                                      LOG_MSG_VAGUE_TAIL, OPERATIONS)
from .oracle import q, with_shipments, with_truth

# ---- A1 phrase scan --------------------------------------------------------
_SPACE = r"[ \t\r\f\x0B]"
PHRASE_SCAN = (
    r"WITH x AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS parts FROM documents), "
    "y AS (SELECT doc_id, unnest(parts) AS raw, unnest(generate_series(1, len(parts))) AS line_no FROM x), "
    f"z AS (SELECT doc_id, line_no, regexp_replace(raw, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS text FROM y) "
    "SELECT doc_id, line_no, text FROM z WHERE length(text) > 0 AND NOT starts_with(text, '#') "
    "AND NOT starts_with(text, '=')"
)

# ---- A3 log records ----------------------------------------------------------
# Structured truth: one INFO record per event, a WARNING record for signup
# events and an ERROR record with its three traceback lines for error events.
_QUOTED = "'''evento ' || CAST(event_id AS VARCHAR) || ''''"
_NL = " || chr(10) || "
LOG_SCAN = (
    "WITH h AS ("
    "SELECT event_id * 5 AS line_no, event_id, ts, 'INFO' AS level, "
    f"{q(LOG_MSG_RECEIVED)} || {_QUOTED} || '...' AS message FROM events "
    "UNION ALL SELECT event_id * 5 + 1, event_id, ts, 'WARNING', "
    f"{q(LOG_MSG_VAGUE)} || {_QUOTED} || {q(LOG_MSG_VAGUE_TAIL)} FROM events "
    "WHERE event_type = 'signup' "
    "UNION ALL SELECT event_id * 5 + 1, event_id, ts, 'ERROR', "
    f"{q(LOG_MSG_ERROR)} || {_QUOTED}{_NL}'Traceback (most recent call last):'"
    f"{_NL}'  File \"service/api.py\", line 168, in parse_query'{_NL}'TimeoutError: model call timed out' "
    "FROM events WHERE event_type = 'error'), "
    "r AS (SELECT 'service.log.' || CAST(event_id // 2000 AS VARCHAR) AS file, line_no, ts, level, message "
    "FROM h) "
    "SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no) AS record_no, "
    "strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts, 'app.main' AS logger, level, message FROM r"
)


# ---- A4 / F4 / F5 / E12 model outputs ----------------------------------------
def _out_json(op: str, sit: str) -> str:
    return (
        "'{\"NF\": null, \"DE\": \"' || strftime(data_emissao, '%Y-%m-%d') || '\", \"ATE\": \"' || "
        "strftime(data_prevista, '%Y-%m-%d') || '\", \"TipoData\": \"3\", \"Cliente\": \"' || cliente || "
        "'\", \"UFDestino\": \"' || uf_destino || '\", \"Operacao\": ' || " + op + " || "
        "', \"SituacaoNF\": ' || " + sit + " || ', \"SortColumn\": null, \"SortDirection\": null}'"
    )


_GOOD = _out_json("'\"' || operacao || '\"'", "'\"' || situacao_nf || '\"'")
_BAD = _out_json("'\"VENDA\"'", "'\"EM TRÂNSITO\"'")
RAW_OUTPUTS = (
    f"SELECT nf AS request_id, CASE nf % 6 WHEN 0 THEN {_GOOD} "
    f"WHEN 1 THEN 'Pensamento: notas do cliente ' || cliente || '.'{_NL}'JSON FINAL: ' || {_GOOD} "
    f"WHEN 2 THEN 'json final: {{\"NF\": 1}}'{_NL}'Revisão: corrigido.'{_NL}'JSON FINAL:'{_NL}{_GOOD} "
    "WHEN 3 THEN 'Não encontrei filtros para esta consulta.' "
    f"WHEN 4 THEN substr({_GOOD}, 1, 40) || '}}' "
    f"ELSE {_BAD} END AS raw_text FROM shipments"
)
BLOCKS = (
    f"o AS ({RAW_OUTPUTS}), "
    r"b0 AS (SELECT request_id, regexp_extract(regexp_split_to_array(raw_text, '(?i)JSON FINAL\s*:?')[-1], "
    r"'(?s)\{.*\}', 0) AS blk FROM o), "
    "b AS (SELECT request_id, blk <> '' AS found, CASE WHEN blk = '' THEN '{}' ELSE blk END AS block FROM b0)"
)


def _get(key: str, cast: str | None = None) -> str:
    v = f"json_extract_string(jb, '$.{key}')"
    return f"CASE WHEN parse_ok THEN {f'TRY_CAST({v} AS {cast})' if cast else v} END"


PARSED = (
    "p00 AS (SELECT request_id, block, CASE WHEN found AND json_valid(block) THEN json_type(block) = 'OBJECT' ELSE false END "
    "AS parse_ok FROM b), "
    "p0 AS (SELECT *, CASE WHEN parse_ok THEN block ELSE '{}' END AS jb FROM p00), "
    f"p1 AS (SELECT request_id, parse_ok, {_get('NF', 'BIGINT')} AS NF, {_get('DE', 'DATE')} AS DE, "
    f"{_get('ATE', 'DATE')} AS ATE, {_get('TipoData')} AS TipoData, {_get('Cliente')} AS Cliente, "
    f"{_get('UFDestino')} AS UFDestino, {_get('Operacao')} AS op0, {_get('SituacaoNF')} AS sit0 FROM p0), "
    f"p2 AS (SELECT *, op0 NOT IN ({', '.join(q(o) for o in OPERATIONS)}) AS bad_op, "
    "sit0 NOT IN ('ENTREGUE', 'RETIDA', 'TRÂNSITO') AS bad_sit FROM p1), "
    "p AS (SELECT request_id, parse_ok, NF, DE, ATE, TipoData, Cliente, UFDestino, "
    "CASE WHEN bad_op THEN NULL ELSE op0 END AS Operacao, CASE WHEN bad_sit THEN NULL ELSE sit0 END AS SituacaoNF, "
    "CAST(COALESCE(bad_op, false) AS INTEGER) + CAST(COALESCE(bad_sit, false) AS INTEGER) AS n_invalid, "
    "parse_ok AND NF IS NULL AND DE IS NULL AND ATE IS NULL AND TipoData IS NULL AND Cliente IS NULL "
    "AND UFDestino IS NULL AND op0 IS NULL AND sit0 IS NULL AS all_null FROM p2)"
)


def with_outputs(select_sql: str) -> str:
    return with_shipments(", " + BLOCKS + ", " + PARSED + " " + select_sql)


# ---- H evaluation -------------------------------------------------------------
def _accuracy() -> str:
    rows = [
        f"SELECT '{f}' AS field, count({f}) AS n_expected, count({f}) AS n_predicted, count({f}) AS n_correct, "
        f"count(*) AS n_agree, CASE WHEN count({f}) = 0 THEN NULL ELSE CAST(1 AS DOUBLE) END AS precision, "
        f"CASE WHEN count({f}) = 0 THEN NULL ELSE CAST(1 AS DOUBLE) END AS recall FROM truth"
        for f in FILTER_FIELDS
    ]
    rows.append("SELECT '__record__', count(*), count(*), count(*), count(*), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE) "
                "FROM truth")
    return with_truth(" UNION ALL ".join(rows))


ATTEMPTS = ("a AS (SELECT user_id AS request_id, ts, CASE event_type WHEN 'error' THEN 500 WHEN 'click' THEN 429 "
            "ELSE 200 END AS status, value AS seconds FROM events)")

# Append mode emits a window once the watermark (max event time - 1 hour)
# has passed its end; the last windows stay open.
STREAM_VAGUE_RATE = (
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n_requests, "
    "CAST(count_if(event_type = 'signup') AS BIGINT) AS n_vague, "
    "CAST(count_if(event_type = 'error') AS BIGINT) AS n_error, "
    "round(count_if(event_type = 'signup') / count(*), 6) AS vague_rate FROM events "
    "GROUP BY date_trunc('hour', ts) "
    "HAVING date_trunc('hour', ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)")

# The first feed's watermark judges the second feed; the last one closes windows.
STREAM_LATE_ROWS = (
    "WITH e AS (SELECT event_id % 10 = 0 AS second, date_trunc('hour', ts) AS h, epoch_ms(date_trunc('hour', ts)) + 3600000 AS fin, "
    "epoch_ms(ts) AS ms, event_type FROM events WHERE ts IS NOT NULL), "
    "w AS (SELECT max(ms) FILTER (WHERE NOT second) - 3600000 AS w1, max(ms) - 3600000 AS w2 FROM e), "
    "j AS (SELECT e.*, coalesce(second AND fin < w1, false) AS late FROM e, w WHERE fin < w2), "
    "r AS (SELECT h, count_if(NOT late) AS n, count_if(NOT late AND event_type = 'signup') AS v, "
    "count_if(NOT late AND event_type = 'error') AS x, count_if(late) AS l FROM j GROUP BY h) "
    "SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(n AS BIGINT) AS n_requests, CAST(v AS BIGINT) AS n_vague, "
    "CAST(x AS BIGINT) AS n_error, CAST(l AS BIGINT) AS n_late, CASE WHEN n > 0 THEN round(v / n, 6) END AS vague_rate FROM r")

_NEEDS = "CASE WHEN nf % 6 IN (3, 4) THEN 2 + (nf // 6) % 3 ELSE 1 END"
REGENERATED = with_shipments(
    f", n AS (SELECT *, least({_NEEDS}, 3) AS attempts, {_NEEDS} <= 3 AS ok FROM shipments) "
    "SELECT nf AS request_id, CAST(attempts AS INTEGER) AS attempts, ok AS parse_ok, CASE WHEN ok THEN 200 ELSE 500 END AS status, "
    "CASE WHEN ok THEN NULL WHEN nf % 6 = 3 THEN 'nenhum objeto JSON' ELSE 'objeto JSON incompleto' END AS error, "
    "CASE WHEN nf % 6 = 5 THEN 2 ELSE 0 END AS n_invalid, CAST(NULL AS BIGINT) AS NF, "
    "CASE WHEN ok THEN strftime(data_emissao, '%Y-%m-%d') END AS DE, CASE WHEN ok THEN strftime(data_prevista, '%Y-%m-%d') END AS ATE, "
    "CASE WHEN ok THEN '3' END AS TipoData, CASE WHEN ok THEN cliente END AS Cliente, CASE WHEN ok THEN uf_destino END AS UFDestino, "
    "CASE WHEN ok AND nf % 6 <> 5 THEN operacao END AS Operacao, CASE WHEN ok AND nf % 6 <> 5 THEN situacao_nf END AS SituacaoNF FROM n")

# H1/H2 over a corpus file in sections of four templates; blank requests are no lines
_SUITE = "t.tpl // 4 + 1"
SUITE_COVERAGE = with_truth(
    f"SELECT CAST({_SUITE} AS INTEGER) AS suite_no, 'modelos do grupo ' || CAST({_SUITE} AS VARCHAR) AS suite, count(*) AS n_requests, "
    "CAST(count_if(outcome = 'ok') AS BIGINT) AS n_ok, " + ", ".join(f"count({f}) AS n_{f}" for f in FILTER_FIELDS)
    + f" FROM truth t WHERE NOT blank GROUP BY {_SUITE}")
SUITE_ACCURACY = with_truth(" UNION ALL ".join(
    f"SELECT CAST({_SUITE} AS INTEGER) AS suite_no, '{f}' AS field, count({f}) AS n_expected, count({f}) AS n_predicted, "
    f"count({f}) AS n_correct, count(*) AS n_agree FROM truth t WHERE NOT blank GROUP BY {_SUITE}" for f in FILTER_FIELDS))

ORACLE_IO = {
    "suite_coverage": SUITE_COVERAGE,
    "suite_accuracy": SUITE_ACCURACY,
    "log_files_scan": LOG_SCAN,
    "regenerate_outputs": REGENERATED,
    "rule_scope_conversations": (
        "SELECT conv_id * 1000 + turn AS request_id, CASE WHEN trim(text) = '' THEN 'empty' ELSE 'vague' END "
        "AS outcome, 0 AS n_filled FROM conversations WHERE role = 'user'"),
    "stream_vague_rate": STREAM_VAGUE_RATE,
    "stream_late_rows": STREAM_LATE_ROWS,
    "phrase_scan": PHRASE_SCAN,
    "log_scan": LOG_SCAN,
    "recover_block": with_shipments(", " + BLOCKS + " SELECT request_id, block FROM b"),
    "output_parse": with_outputs(
        "SELECT request_id, parse_ok, all_null, CASE WHEN NOT parse_ok THEN 500 WHEN all_null THEN 400 ELSE 200 END "
        "AS status, n_invalid, NF, strftime(DE, '%Y-%m-%d') AS DE, strftime(ATE, '%Y-%m-%d') AS ATE, TipoData, "
        "Cliente, UFDestino, Operacao, SituacaoNF FROM p"),
    "domain_report": with_outputs(
        "SELECT field, n_invalid FROM (SELECT 'Operacao' AS field, CAST(count_if(bad_op) AS BIGINT) AS n_invalid "
        "FROM p2 UNION ALL SELECT 'SituacaoNF', CAST(count_if(bad_sit) AS BIGINT) FROM p2) WHERE n_invalid > 0"),
    "field_accuracy": _accuracy(),
    "field_coverage": with_truth(
        "SELECT outcome, count(*) AS n_requests, " + ", ".join(f"count({f}) AS n_{f}" for f in FILTER_FIELDS)
        + " FROM truth GROUP BY ROLLUP (outcome)"),
    "vague_rate": (
        "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n_requests, "
        "CAST(count_if(event_type = 'signup') AS BIGINT) AS n_vague, "
        "CAST(count_if(event_type = 'error') AS BIGINT) AS n_error, "
        "round(count_if(event_type = 'signup') / count(*), 6) AS vague_rate FROM events GROUP BY 1"),
    "vague_rate_by_endpoint": (
        "SELECT CASE WHEN event_id % 4 = 3 THEN 'debug-query' ELSE 'parse-query' END AS endpoint, "
        "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n_requests, "
        "CAST(count_if(event_type = 'signup') AS BIGINT) AS n_vague, CAST(count_if(event_type = 'error') AS BIGINT) AS n_error, "
        "round(count_if(event_type = 'signup') / count(*), 6) AS vague_rate FROM events GROUP BY 1, 2"),
    "latency_summary": (
        f"WITH {ATTEMPTS} SELECT status, count(*) AS n, round(avg(seconds), 6) AS avg_s, min(seconds) AS min_s, "
        "max(seconds) AS max_s, CAST(count_if(seconds > 60) AS BIGINT) AS n_over_60s FROM a GROUP BY status"),
    "latency_quantiles": (
        f"WITH {ATTEMPTS} SELECT status, " + ", ".join(f"round(quantile_cont(seconds, {x}), 6) AS {n}" for n, x in (
            ("p50_s", 0.5), ("p95_s", 0.95), ("p99_s", 0.99))) + " FROM a GROUP BY status"),
    "attempt_waits": (
        f"WITH {ATTEMPTS}, w AS (SELECT *, lag(status) OVER o AS prev_status, "
        "(epoch_us(ts) - epoch_us(lag(ts) OVER o)) / 1e6 AS gap FROM a WINDOW o AS (PARTITION BY request_id ORDER BY ts, status, seconds)) "
        "SELECT request_id, count(*) AS n_attempts, CAST(count_if(prev_status <> 200) AS BIGINT) AS n_retries, "
        "CAST(count_if(prev_status <> 200 AND gap < 60) AS BIGINT) AS n_early, round(min(gap), 6) AS min_wait_s, "
        "round(max(gap), 6) AS max_wait_s, round(max(CASE WHEN prev_status <> 200 THEN gap END), 6) AS max_retry_wait_s "
        "FROM w GROUP BY request_id"),
    "attempt_summary": (
        f"WITH {ATTEMPTS}, f AS (SELECT request_id, count(*) AS n_attempts, "
        "CAST(count_if(status = 200) AS BIGINT) AS n_ok, "
        "min(ts) AS first_ts, min(ts) FILTER (WHERE status = 200) AS first_ok_ts FROM a GROUP BY request_id) "
        "SELECT f.request_id, n_attempts, n_ok, strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS first_ts, "
        "strftime(first_ok_ts, '%Y-%m-%d %H:%M:%S') AS first_ok_ts, "
        "CASE WHEN first_ok_ts IS NULL THEN NULL ELSE (SELECT count(*) FROM a WHERE a.request_id = f.request_id "
        "AND a.ts <= f.first_ok_ts) END AS attempts_until_ok, "
        "round((epoch_us(first_ok_ts) - epoch_us(first_ts)) / 1e6, 6) AS seconds_to_ok FROM f"),
}
