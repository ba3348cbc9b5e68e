"""Stand-in request corpus: sentence templates filled from shipment rows.

The driver tables hold no requests, so each order yields one request whose
words come from that order's shipment (customer, carrier, place, dates).
The parser only ever sees the rendered text.  ``expect`` holds, per field,
the DuckDB SQL of the structured truth; only the oracle reads it, so the
check never repeats the parser's regexes.

Template choice and phrase choice are functions of the order key (``nf``);
every order is rendered, none is filtered out.
"""

from __future__ import annotations

N_TEMPLATES = 31

# Phrase lists and the structured value each phrase stands for.
EVENTS = [("com data de agenda", "1"), ("entregues", "2"), ("emitidas", "3"), ("previstas", "4"),
          ("com previsão real", "5"), ("baixadas", "6")]
PERIODS = [("hoje", "a", "a"), ("ontem", "a - 1", "a - 1"), ("na última semana", "lws", "lws + 6"),
           ("na semana passada", "lws", "lws + 6"), ("nesta semana", "ws", "ws + 6"),
           ("neste mês", "ms", "me"), ("nos últimos 7 dias", "a - 6", "a")]
AGENDA = [("hoje", "a", "a"), ("ontem", "a - 1", "a - 1"), ("para amanhã", "a + 1", "a + 1")]
# Normalised forms of the situation / performance phrases (synonym rewrite).
SITUATIONS_CANON = ["em trânsito", "em trânsito", "em trânsito", "em trânsito", "retidas", "retidas", "retidas",
                    "com situação logística ENTREGUE"]
PERFORMANCE_CANON = ["com status de análise ATRASO", "com status de análise DIA SEGUINTE",
                     "com status de análise DO DIA", "com status de análise PREVISTO PARA 2 DIAS",
                     "com status de análise FUTURO", "cuja análise de performance foi ENTREGUE",
                     "com status DO DIA", "em data futura"]
SITUATIONS = [("rodando", "TRÂNSITO"), ("viajando", "TRÂNSITO"), ("a caminho", "TRÂNSITO"),
              ("em trânsito", "TRÂNSITO"), ("retidas", "RETIDA"), ("bloqueadas", "RETIDA"),
              ("paradas na fiscalização", "RETIDA"), ("com status entregue", "ENTREGUE")]
PERFORMANCE = [("com atraso", "ATRASO"), ("previstas para amanhã", "DIA SEGUINTE"),
               ("previstas para hoje", "DO DIA"), ("previstas para daqui a 2 dias", "PREVISTO PARA 2 DIAS"),
               ("com status de análise FUTURO", "FUTURO"),
               ("cuja análise de performance foi ENTREGUE", "ENTREGUE"),
               ("com status DO DIA", "DO DIA"), ("em data futura", "FUTURO")]
SORTS = [("pela data de entrega mais recente", "data_entrega", "DESC"),
         ("pela data de entrega mais antiga", "data_entrega", "ASC"),
         ("pelo maior valor", "valor_nf", "DESC"), ("pelo menor valor", "valor_nf", "ASC"),
         ("pelo mais caro", "valor_nf", "DESC"), ("pelo mais barato", "valor_nf", "ASC"),
         ("pela data de emissão mais recente", "data_emissao", "DESC"),
         ("pela data de emissão mais antiga", "data_emissao", "ASC"),
         ("por valor decrescente", "valor_nf", "DESC"), ("por valor crescente", "valor_nf", "ASC"),
         ("pelas mais novas", "data_emissao", None)]
# Their normalised forms: a sort by price is rewritten to a sort by value.
SORTS_CANON = [{"pelo mais caro": "pelo maior valor", "pelo mais barato": "pelo menor valor"}.get(p, p) for p, _, _ in SORTS]

# Which modulus drives each phrase slot.
SLOT_MOD = {"ev": 6, "per": 7, "ag": 3, "sit": 8, "perf": 8, "srt": 11}

# Truth shorthands (DuckDB, over the oracle's base CTE).
CLI = {"Cliente": "cli"}
TR = {"Transportadora": "tr"}
EVP = {"TipoData": "ev_code", "DE": "per_de", "ATE": "per_ate"}
CITY_RULE = {"CidadeDestino": "CASE WHEN city_is_state THEN NULL ELSE city END",
             "UFDestino": "CASE WHEN city_is_state THEN uf END"}

TEMPLATES = [
    {"text": "me mostre a nota fiscal {nf}", "expect": {"NF": "nf"}},
    {"text": "qual a nf {nf} do cliente {cli}?", "expect": {"NF": "nf"},
     "enhanced": "qual a nota fiscal {nf} do cliente {cli}?"},
    {"text": "notas do cliente {cli}", "expect": CLI},
    {"text": "notas do cliente {cli} {ev} {per}", "expect": {**CLI, **EVP}},
    {"text": "notas da transportadora {tr} {ev} {per}", "expect": {**TR, **EVP},
     "needs": "tr", "fallback": "notas do cliente {cli} {ev} {per}", "fallback_expect": {**CLI, **EVP}},
    {"text": "notas com cnpj raiz da transportadora {cnpj}", "expect": {"CNPJRaizTransp": "cnpj"},
     "needs": "cnpj", "fallback": "notas do cliente {cli}", "fallback_expect": CLI},
    {"text": "notas do cliente {cli} {sit}", "expect": {**CLI, "SituacaoNF": "sit_val"},
     "enhanced": "notas do cliente {cli} {sit_c}", "expanded": "notas do cliente {cli} {sit}"},
    {"text": "notas do cliente {cli} {perf}", "expect": {**CLI, "StatusAnaliseData": "perf_val"},
     "enhanced": "notas do cliente {cli} {perf_c}", "expanded": "notas do cliente {cli} {perf}"},
    {"text": "notas de operação {op} do cliente {cli}", "expect": {**CLI, "Operacao": "op"}},
    {"text": "notas do cliente {cli} para o estado de {state}", "expect": {**CLI, "UFDestino": "uf"}},
    {"text": "notas do cliente {cli} para {uf}", "expect": {**CLI, "UFDestino": "uf"}},
    {"text": "notas do cliente {cli} para a cidade de {city}",
     "expect": {**CLI, "CidadeDestino": "city", "UFDestino": "CASE WHEN city_is_state THEN uf END"}},
    {"text": "notas da transportadora {tr} para {city}", "expect": {**TR, **CITY_RULE},
     "needs": "tr", "fallback": "notas do cliente {cli} para {city}", "fallback_expect": {**CLI, **CITY_RULE}},
    {"text": "notas do cliente {cli} para {city} em {state}",
     "expect": {**CLI, "UFDestino": "uf", "CidadeDestino": "CASE WHEN city_is_state THEN NULL ELSE city END"}},
    {"text": "notas do cliente {cli} ordenadas {srt}",
     "enhanced": "notas do cliente {cli} ordenadas {srt_c}", "expanded": "notas do cliente {cli} ordenadas {srt}",
     "expect": {**CLI, "SortColumn": "srt_col", "SortDirection": "srt_dir"}},
    {"text": "o que foi entregue de {d1} até {d2}",
     "expect": {"TipoData": "'2'", "DE": "data_emissao", "ATE": "data_prevista"}},
    {"text": "notas previstas entre {dd1} e {dd2} de {month} de {year}",
     "expect": {"TipoData": "'4'", "DE": "data_emissao", "ATE": "range_end"}},
    {"text": "notas emitidas em {month} de {year}", "expect": {"TipoData": "'3'", "DE": "ms", "ATE": "me"}},
    {"text": "notas com data de agenda {ag}", "expect": {"TipoData": "'1'", "DE": "ag_de", "ATE": "ag_ate"}},
    {"text": "notas do cliente {cli} em trânsito e com atraso",
     "expect": {**CLI, "SituacaoNF": "'TRÂNSITO'", "StatusAnaliseData": "'ATRASO'"},
     "enhanced": "notas do cliente {cli} em trânsito e com status de análise ATRASO",
     "expanded": "notas do cliente {cli} em trânsito e com atraso"},
    {"text": "notas {ev} {per} do cliente {cli} exceto para o estado de {state}", "expect": {**CLI, **EVP},
     "negated": True},
    {"text": "notas do cliente {cli} que não estão em trânsito", "expect": CLI, "negated": True},
    {"text": "me mostre as notas", "expect": {}},
    {"text": "qual o clima para hoje?", "expect": {}},
    {"text": "   ", "expect": {}, "blank": True},
    {"text": "nf do cli {cli} transp {tr} com atraso", "expect": {**CLI, **TR, "StatusAnaliseData": "'ATRASO'"},
     "enhanced": "nota fiscal do cliente {cli} da transportadora {tr} com status de análise ATRASO",
     "expanded": "nota fiscal do cliente {cli} da transportadora {tr} com atraso",
     "fallback_expanded": "nota fiscal do cliente {cli} com atraso",
     "needs": "tr", "fallback": "nf do cli {cli} com atraso",
     "fallback_enhanced": "nota fiscal do cliente {cli} com status de análise ATRASO",
     "fallback_expect": {**CLI, "StatusAnaliseData": "'ATRASO'"}},
    {"text": "quais notas da transportadora {tr} para {city} foram baixadas na semana passada e estão com "
             "análise ATRASO?",
     "expect": {**TR, **CITY_RULE, "TipoData": "'6'", "DE": "lws", "ATE": "lws + 6",
                "StatusAnaliseData": "'ATRASO'"},
     "needs": "tr",
     "fallback": "quais notas do cliente {cli} para {city} foram baixadas na semana passada e estão com "
                 "análise ATRASO?",
     "fallback_expect": {**CLI, **CITY_RULE, "TipoData": "'6'", "DE": "lws", "ATE": "lws + 6",
                         "StatusAnaliseData": "'ATRASO'"}},
    {"text": "notas de operação {op} para o cliente {cli} no estado de {state}, ordenadas pela data de entrega "
             "mais recente",
     "expect": {**CLI, "Operacao": "op", "UFDestino": "uf", "SortColumn": "'data_entrega'",
                "SortDirection": "'DESC'"}},
    {"text": "liste as notas do cliente {cli} emitidas hoje para {uf} que estão em trânsito, ordenadas pelo "
             "menor valor",
     "expect": {**CLI, "TipoData": "'3'", "DE": "a", "ATE": "a", "UFDestino": "uf", "SituacaoNF": "'TRÂNSITO'",
                "SortColumn": "'valor_nf'", "SortDirection": "'ASC'"}},
    {"text": "notas do cliente {cli} rodando e também as retidas", "expect": CLI, "ambiguous": "situation"},
    {"text": "notas em trânsito do cliente {cli} exceto as retidas", "expect": {**CLI, "SituacaoNF": "'TRÂNSITO'"},
     "negated": True, "ambiguous": "situation"},
]

# Structured facts per template for the oracles (template index -> value),
# written over the oracle's ``truth`` rows (order key = ``request_id``):
#   event     event code written outside status phrases (before the sort clause is removed)
#   explicit  explicit dates (DE, ATE); named: calendar-word / month period (DE, ATE)
#   tags      concept tags per kind, for the preservation audit
_SORT_EMISSION = f"CASE WHEN request_id % {SLOT_MOD['srt']} IN (6, 7) THEN '3' END"
FACTS = {
    3: {"event": "ev_code", "named": ("per_de", "per_ate"), "tags": {"event": 1, "period": 1}},
    4: {"event": "ev_code", "named": ("per_de", "per_ate"), "tags": {"event": 1, "period": 1}},
    6: {"tags": {"situation": 1}},
    7: {"tags": {"performance": 1}},
    14: {"event": _SORT_EMISSION, "event_in_sort": True,
         "tags": {"sort": f"CASE WHEN request_id % {SLOT_MOD['srt']} IN (2, 3, 4, 5) THEN 1 ELSE 0 END",
                  "event": f"CASE WHEN request_id % {SLOT_MOD['srt']} IN (6, 7) THEN 1 ELSE 0 END"}},
    15: {"event": "'2'", "explicit": ("data_emissao", "data_prevista"), "tags": {"event": 1, "period": 1}},
    16: {"event": "'4'", "explicit": ("data_emissao", "range_end"), "named": ("ms", "me"),
         "tags": {"event": 1, "period": 1}},
    17: {"event": "'3'", "named": ("ms", "me"), "tags": {"event": 1, "period": 1}},
    18: {"event": "'1'", "named": ("ag_de", "ag_ate"), "tags": {"event": 1, "period": 1}},
    19: {"tags": {"situation": 1, "performance": 1}},
    20: {"event": "ev_code", "named": ("per_de", "per_ate"), "tags": {"event": 1, "period": 1}},
    21: {"tags": {"situation": 1}},
    23: {"named": ("a", "a"), "tags": {"period": 1}, "out_of_scope": True},
    24: {"out_of_scope": True},
    25: {"tags": {"performance": 1}},
    26: {"event": "'6'", "named": ("lws", "lws + 6"), "tags": {"performance": 1, "event": 1, "period": 1}},
    28: {"event": "'3'", "named": ("a", "a"), "tags": {"situation": 1, "sort": 1, "event": 1, "period": 1}},
    29: {"tags": {"situation": 2}},
    30: {"tags": {"situation": 2}},
}

assert len(TEMPLATES) == N_TEMPLATES
