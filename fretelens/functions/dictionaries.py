"""Dictionaries that drive the rule set.

Everything under "FIXED VALUES" must equal the filter language that the
service defines (field domains, abbreviations, synonyms, event codes, sort
phrases, negation words).  They are written out plainly and in their natural
order.  The entries under "OURS" are not part of that language; they are the
small gazetteers and word lists our deterministic parser needs in place of a
language model (state names, capitals, month names, domain words).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (filter language)
# ---------------------------------------------------------------------------

# The 14 keys of a filter record, in output order.
FILTER_FIELDS = [
    "NF", "DE", "ATE", "TipoData", "Cliente", "Transportadora", "UFDestino",
    "CidadeDestino", "Operacao", "SituacaoNF", "StatusAnaliseData",
    "CNPJRaizTransp", "SortColumn", "SortDirection",
]

# Date-event codes for TipoData.
EVENT_CODES = {
    "agenda": "1",
    "entregue": "2",
    "emitido": "3",
    "previsto": "4",
    "previsão real": "5",
    "baixada": "6",
}

# Transport purposes (Operacao): closed domain.
OPERATIONS = [
    "InBound-IPO", "InBound-MAO", "InBound-UDI", "OutBound-BAR",
    "OutBound-BAR-MAT.PRIMA", "OutBound-IPO", "OutBound-MAO", "OutBound-RIO",
    "OutBound-SPO", "OutBound-UDI",
]

# Logistic situation (SituacaoNF): closed domain.
SITUATIONS = ["ENTREGUE", "RETIDA", "TRÂNSITO"]

# Deadline performance (StatusAnaliseData): closed domain.
PERFORMANCE = ["ATRASO", "DIA SEGUINTE", "DO DIA", "ENTREGUE", "FUTURO",
               "PREVISTO PARA 2 DIAS"]

# Destination states (UFDestino): closed domain, in this order.
STATES = ["AC", "AL", "AM", "AP", "BA", "CE", "DF", "ES", "GO", "MA", "MG",
          "MS", "MT", "PA", "PB", "PE", "PI", "PR", "RJ", "RN", "RO", "RR",
          "RS", "SC", "SE", "SP", "TO"]

SORT_COLUMNS = ["data_entrega", "valor_nf", "data_emissao"]
SORT_DIRECTIONS = ["ASC", "DESC"]

# Synonym rewrite: (phrase, canonical phrase, concept, value).
SYNONYMS = [
    ("com atraso", "com status de análise ATRASO", "performance", "ATRASO"),
    ("prevista para amanhã", "com status de análise DIA SEGUINTE", "performance", "DIA SEGUINTE"),
    ("prevista para hoje", "com status de análise DO DIA", "performance", "DO DIA"),
    ("entrega prevista para o dia seguinte", "com status de análise DIA SEGUINTE", "performance", "DIA SEGUINTE"),
    ("prevista para daqui a 2 dias", "com status de análise PREVISTO PARA 2 DIAS", "performance", "PREVISTO PARA 2 DIAS"),
    ("para daqui a dois dias", "com status de análise PREVISTO PARA 2 DIAS", "performance", "PREVISTO PARA 2 DIAS"),
    ("status entregue", "com situação logística ENTREGUE", "situation", "ENTREGUE"),
    ("análise entregue", "com status de análise de performance ENTREGUE", "performance", "ENTREGUE"),
    ("rodando", "em trânsito", "situation", "TRÂNSITO"),
    ("viajando", "em trânsito", "situation", "TRÂNSITO"),
    ("a caminho", "em trânsito", "situation", "TRÂNSITO"),
    ("paradas na fiscalização", "retidas", "situation", "RETIDA"),
    ("bloqueadas", "retidas", "situation", "RETIDA"),
    ("ordenar pelo mais caro", "ordenadas pelo maior valor", "sort", "valor_nf DESC"),
    ("ordenar pelo maior valor", "ordenadas pelo maior valor", "sort", "valor_nf DESC"),
    ("ordenar pelo mais barato", "ordenadas pelo menor valor", "sort", "valor_nf ASC"),
    ("ordenar pelo menor valor", "ordenadas pelo menor valor", "sort", "valor_nf ASC"),
]

# Named periods -> calendar variable pair.
PERIODS = [
    ("hoje", "today"),
    ("ontem", "yesterday"),
    ("última semana", "last_week"),
    ("semana passada", "last_week"),
    ("esta semana", "week"),
    ("dessa semana", "week"),
    ("este mês", "month"),
    ("deste mês", "month"),
    ("este semestre", "semester"),
    ("neste semestre", "semester"),
]

# Negation / exclusion words: the filter they govern is left unspecified.
NEGATION_WORDS = ["não", "exceto", "menos", "que não sejam"]

# Service messages (HTTP 400 details).
DETAIL_EMPTY = "A 'query' não pode ser vazia."
DETAIL_VAGUE = ("A consulta fornecida é muito vaga, irrelevante ou não pôde ser "
                "interpretada. Por favor, seja mais específico.")

# Service log: the messages the monitoring reads, by endpoint.
LOG_MSG_RECEIVED = "Recebida nova requisição em /parse-query para a query: "
LOG_MSG_VAGUE = "Consulta vaga/irrelevante detectada para query: "
LOG_MSG_VAGUE_TAIL = ". Retornando erro 400."
LOG_MSG_ERROR = "Erro no endpoint /parse-query para a query: "
LOG_MSG_DEBUG_RECEIVED = "Recebida nova requisição em /debug-query para a query: "
LOG_MSG_DEBUG_VAGUE = "Consulta vaga/irrelevante detectada (debug) para query: "
LOG_MSG_DEBUG_ERROR = "Erro na execução da cadeia de debug para a query: "

# ---------------------------------------------------------------------------
# OURS (not defined by the filter language)
# ---------------------------------------------------------------------------

# State names, same order as STATES.
STATE_NAMES = [
    "Acre", "Alagoas", "Amazonas", "Amapá", "Bahia", "Ceará",
    "Distrito Federal", "Espírito Santo", "Goiás", "Maranhão", "Minas Gerais",
    "Mato Grosso do Sul", "Mato Grosso", "Pará", "Paraíba", "Pernambuco",
    "Piauí", "Paraná", "Rio de Janeiro", "Rio Grande do Norte", "Rondônia",
    "Roraima", "Rio Grande do Sul", "Santa Catarina", "Sergipe", "São Paulo",
    "Tocantins",
]

# State capitals, same order as STATES.
CAPITALS = [
    "Rio Branco", "Maceió", "Manaus", "Macapá", "Salvador", "Fortaleza",
    "Brasília", "Vitória", "Goiânia", "São Luís", "Belo Horizonte",
    "Campo Grande", "Cuiabá", "Belém", "João Pessoa", "Recife", "Teresina",
    "Curitiba", "Rio de Janeiro", "Natal", "Porto Velho", "Boa Vista",
    "Porto Alegre", "Florianópolis", "Aracaju", "São Paulo", "Palmas",
]

# Further cities (city, state) named by the operation codes.
OTHER_CITIES = [
    ("Uberlândia", "MG"), ("Barueri", "SP"), ("Ipojuca", "PE"),
    ("Campinas", "SP"), ("Santos", "SP"), ("Guarulhos", "SP"),
]

MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho",
          "agosto", "setembro", "outubro", "novembro", "dezembro"]

# Words that put a request inside the shipments domain (scope gate).
DOMAIN_WORDS = [
    "nota", "notas", "nf", "fiscal", "fiscais", "entrega", "entregas",
    "entregue", "entregues", "cliente", "clientes", "tomador",
    "transportadora", "transportadoras", "parceiro", "carga", "cargas",
    "frete", "pedido", "pedidos", "operação", "operações", "remessa",
    "emitida", "emitido", "emitidas", "emitidos", "emissão", "baixada",
    "baixado", "baixadas", "baixados", "agenda", "agendada", "agendadas",
    "previsão", "prevista", "previsto", "previstas", "previstos", "trânsito",
    "retida", "retidas", "atraso", "cnpj", "situação", "status", "análise",
    "ordenar", "ordenadas", "ordenados",
]

# Function words that end an unlinked entity name.
NAME_STOPWORDS = [
    "a", "o", "as", "os", "para", "no", "na", "nos", "nas", "do", "da", "dos",
    "das", "de", "em", "com", "que", "e", "ou", "foram", "foi", "estão",
    "está", "entre", "até", "por", "pelo", "pela", "cujo", "cuja", "hoje",
    "ontem", "amanhã", "ordenadas", "ordenados", "exceto", "menos", "não",
    "sem",
]
