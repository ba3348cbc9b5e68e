"""Golden requests (anchor 2025-10-22) and their expected filter records.

Inputs are the phrases of the service's test corpus, regression file and
few-shot examples; expectations come from the comments next to each phrase
and from the written rules (decisions listed in README).  Only non-null
fields are given; every other field must be NULL.
"""

from datetime import date

ANCHOR = date(2025, 10, 22)
D = date

TODAY = (D(2025, 10, 22), D(2025, 10, 22))
YESTERDAY = (D(2025, 10, 21), D(2025, 10, 21))
TOMORROW = (D(2025, 10, 23), D(2025, 10, 23))
LAST_WEEK = (D(2025, 10, 13), D(2025, 10, 19))
WEEK = (D(2025, 10, 20), D(2025, 10, 26))
MONTH = (D(2025, 10, 1), D(2025, 10, 31))


def P(span):
    return {"DE": span[0], "ATE": span[1]}


CORPUS = [
    ("me mostre a nota fiscal 55432", {"NF": 55432}),
    ("qual a nf 12345", {"NF": 12345}),
    ("nf 98765", {"NF": 98765}),
    ("notas do cliente BEXX", {"Cliente": "BEXX"}),
    ("notas da transportadora RápidoLog", {"Transportadora": "RápidoLog"}),
    ("notas com operação InBound-IPO", {"Operacao": "InBound-IPO"}),
    ("me mostre as operações OutBound-SPO # Testando outro valor", {"Operacao": "OutBound-SPO"}),
    ("notas com cnpj raiz da transportadora 12345678", {"CNPJRaizTransp": "12345678"}),
    ("notas para o estado de São Paulo", {"UFDestino": "SP"}),
    ("me mostre as notas para Manaus", {"CidadeDestino": "Manaus"}),
    ("notas para São Paulo", {"UFDestino": "SP"}),
    ("mostre as notas para a cidade de São Paulo", {"UFDestino": "SP", "CidadeDestino": "São Paulo"}),
    ("mostre as notas para Uberlândia em Minas Gerais", {"UFDestino": "MG", "CidadeDestino": "Uberlândia"}),
    ("quais notas foram entregues hoje?", {"TipoData": "2", **P(TODAY)}),
    ("mostre o que foi emitido ontem", {"TipoData": "3", **P(YESTERDAY)}),
    ("notas com data de agenda para amanhã?", {"TipoData": "1", **P(TOMORROW)}),
    ("o que foi baixado na última semana?", {"TipoData": "6", **P(LAST_WEEK)}),
    ("notas emitidas nos últimos 7 dias # Similar a 'última semana' dependendo do dia",
     {"TipoData": "3", "DE": D(2025, 10, 16), "ATE": D(2025, 10, 22)}),
    ("notas emitidas nesta semana", {"TipoData": "3", **P(WEEK)}),
    ("o que tem previsão real para este mês?", {"TipoData": "5", **P(MONTH)}),
    ("notas previstas entre 1 e 15 de setembro de 2025",
     {"TipoData": "4", "DE": D(2025, 9, 1), "ATE": D(2025, 9, 15)}),
    ("o que foi entregue de 01/09/2025 até 10/09/2025",
     {"TipoData": "2", "DE": D(2025, 9, 1), "ATE": D(2025, 9, 10)}),
    ("notas com data de agenda para hoje", {"TipoData": "1", **P(TODAY)}),
    ("quais notas têm entrega prevista para amanhã? # Foco no TipoData '4' e datas",
     {"StatusAnaliseData": "DIA SEGUINTE"}),
    ("me mostre as notas com previsão real para hoje", {"TipoData": "5", **P(TODAY)}),
    ("quais notas estão em trânsito?", {"SituacaoNF": "TRÂNSITO"}),
    ("notas rodando # Testando sinônimo", {"SituacaoNF": "TRÂNSITO"}),
    ("me mostre as notas retidas", {"SituacaoNF": "RETIDA"}),
    ("quais notas foram retidas? # Variação", {"SituacaoNF": "RETIDA"}),
    ("notas com status entregue", {"SituacaoNF": "ENTREGUE"}),
    ("me mostre as notas com situação logística ENTREGUE # Testando frase canônica", {"SituacaoNF": "ENTREGUE"}),
    ("quais notas estão com atraso?", {"StatusAnaliseData": "ATRASO"}),
    ("entregas com atraso # Testando sinônimo", {"StatusAnaliseData": "ATRASO"}),
    ("quais notas estão com status de análise ATRASO? # Testando frase canônica", {"StatusAnaliseData": "ATRASO"}),
    ("notas previstas para amanhã", {"StatusAnaliseData": "DIA SEGUINTE"}),
    ("notas com entrega prevista para o dia seguinte # Testando sinônimo", {"StatusAnaliseData": "DIA SEGUINTE"}),
    ("notas previstas para hoje", {"StatusAnaliseData": "DO DIA"}),
    ("me mostre as notas com status DO DIA # Variação", {"StatusAnaliseData": "DO DIA"}),
    ("me mostre as notas com análise de performance FUTURO", {"StatusAnaliseData": "FUTURO"}),
    ("quais notas estão previstas para daqui a 2 dias?", {"StatusAnaliseData": "PREVISTO PARA 2 DIAS"}),
    ("liste as notas cuja análise de performance foi ENTREGUE", {"StatusAnaliseData": "ENTREGUE"}),
    ("ordenar pela data de entrega mais recente", {"SortColumn": "data_entrega", "SortDirection": "DESC"}),
    ("ordenar pelo valor mais caro", {"SortColumn": "valor_nf", "SortDirection": "DESC"}),
    ("notas rodando ordenadas pelo mais caro # Combinado com filtro",
     {"SituacaoNF": "TRÂNSITO", "SortColumn": "valor_nf", "SortDirection": "DESC"}),
    ("ordenar pela data de emissão mais antiga", {"SortColumn": "data_emissao", "SortDirection": "ASC"}),
    ("notas de operação OutBound-RIO para o cliente BEXX no estado do Rio de Janeiro, ordenadas pela data de "
     "entrega mais recente",
     {"Operacao": "OutBound-RIO", "Cliente": "BEXX", "UFDestino": "RJ", "SortColumn": "data_entrega",
      "SortDirection": "DESC"}),
    ("quais notas da transportadora RápidoLog para Manaus foram baixadas na semana passada e estão com análise "
     "ATRASO?",
     {"Transportadora": "RápidoLog", "CidadeDestino": "Manaus", "TipoData": "6", **P(LAST_WEEK),
      "StatusAnaliseData": "ATRASO"}),
    ("liste as notas emitidas hoje para SP que estão em trânsito, ordenadas pelo menor valor",
     {"TipoData": "3", **P(TODAY), "UFDestino": "SP", "SituacaoNF": "TRÂNSITO", "SortColumn": "valor_nf",
      "SortDirection": "ASC"}),
    ("notas em trânsito e com atraso", {"SituacaoNF": "TRÂNSITO", "StatusAnaliseData": "ATRASO"}),
    ("notas emitidas hoje que estão em trânsito", {"TipoData": "3", **P(TODAY), "SituacaoNF": "TRÂNSITO"}),
    ("notas baixadas na semana passada e que estão com atraso",
     {"TipoData": "6", **P(LAST_WEEK), "StatusAnaliseData": "ATRASO"}),
    ("qual o clima para hoje?", {}),
    ("me mostre as notas", {}),
    ("qual o status da entrega?", {}),
    ("quais são os clientes?", {}),
    ("liste as transportadoras", {}),
    ("notas fiscais", {}),
]

FEW_SHOT = [
    ("Quais notas de operação OutBound-SPO estão com análise de performance 'ATRASO'?",
     {"Operacao": "OutBound-SPO", "StatusAnaliseData": "ATRASO"}),
    ("notas previstas entre 1 e 15 de setembro de 2025",
     {"TipoData": "4", "DE": D(2025, 9, 1), "ATE": D(2025, 9, 15)}),
    ("notas entregues ontem ordenadas pela data de entrega mais recente",
     {"TipoData": "2", **P(YESTERDAY), "SortColumn": "data_entrega", "SortDirection": "DESC"}),
    ("Me mostre as notas fiscais em trânsito ordenadas pelo maior valor",
     {"SituacaoNF": "TRÂNSITO", "SortColumn": "valor_nf", "SortDirection": "DESC"}),
    ("Me mostre as notas com status de análise de performance ENTREGUE", {"StatusAnaliseData": "ENTREGUE"}),
    ("liste as notas emitidas hoje para SP que estão em trânsito",
     {"TipoData": "3", **P(TODAY), "UFDestino": "SP", "SituacaoNF": "TRÂNSITO"}),
    ("Quais notas foram emitidas este mês?", {"TipoData": "3", **P(MONTH)}),
    ("Quais notas fiscais têm status de entregue?", {"SituacaoNF": "ENTREGUE"}),
    ("Me mostre as notas fiscais em trânsito E com atraso", {"SituacaoNF": "TRÂNSITO", "StatusAnaliseData": "ATRASO"}),
    ("qual o status da entrega?", {}),
    ("Quais notas estão previstas para daqui a 2 dias?", {"StatusAnaliseData": "PREVISTO PARA 2 DIAS"}),
    ("Quais notas foram emitidas esta semana?", {"TipoData": "3", **P(WEEK)}),
]

# Rewrite goldens: input -> key fragments the normalised text must carry.
REWRITES = [
    ("quais notas foram entregues hoje?", ["entregues hoje"]),
    ("notas rodando ordenadas pelo mais caro", ["notas em trânsito ordenadas pelo maior valor"]),
    ("nf do cli acme transp veloz com atraso",
     ["nota fiscal do cliente acme da transportadora veloz", "com status de análise ATRASO"]),
    ("o que foi baixado na ult sem", ["baixado na última semana"]),
    ("notas para a cidade de São Paulo", ["cidade de São Paulo"]),
    ("notas com data de agenda para hoje", ["agenda para hoje"]),
]

EDGE = [
    ("", None),
    ("    ", None),
    ("notas em trânsito exceto para o estado de São Paulo", {"SituacaoNF": "TRÂNSITO"}),
    ("nota fiscal 777 do cliente BEXX em trânsito", {"NF": 777}),
    ("notas rodando e também as retidas", {}),
    ("notas com operação OutBound-BAR-MAT.PRIMA", {"Operacao": "OutBound-BAR-MAT.PRIMA"}),
    ("o que foi entregue de 31/02/2025 até 10/03/2025", {}),
    ("nf nf 123", {"NF": 123}),
    ("notas rodando ordenadas por cliente", {"SituacaoNF": "TRÂNSITO"}),
    ("notas com operação OutBound-SPO para SP", {"Operacao": "OutBound-SPO", "UFDestino": "SP"}),
    ("notas do tomador Acme", {"Cliente": "Acme"}),
    ("notas em trânsito que não sejam do estado de Minas Gerais", {"SituacaoNF": "TRÂNSITO"}),
]

# Phrases that once lost a filter without a signal.
PROBES = [
    ("nf #12345", {"NF": 12345}),
    ("nota #777", {"NF": 777}),
    ("nota fiscal 1234567890123456789", {"NF": 1234567890123456789}),
    ("o que foi entregue de 01/09/2025 ao dia 10/09/2025", {"TipoData": "2", "DE": D(2025, 9, 1), "ATE": D(2025, 9, 10)}),
    ("notas emitidas a partir de 01/09/2025", {"TipoData": "3", "DE": D(2025, 9, 1)}),
    ("notas emitidas até 10/09/2025", {"TipoData": "3", "ATE": D(2025, 9, 10)}),
    ("o que foi entregue de 10/03/2025 até 31/02/2025 do cliente Acme", {"Cliente": "Acme"}),
    ("notas emitidas de 10/09/2025 até 01/09/2025 do cliente Acme", {"Cliente": "Acme"}),
    ("notas emitidas de 2025-09-01 até 2025-09-10", {"TipoData": "3", "DE": D(2025, 9, 1), "ATE": D(2025, 9, 10)}),
    ("notas do cliente Acme emitidas nos últimos 2000000000 dias", {"Cliente": "Acme"}),
    ("notas do cliente Acme e do cliente Beta em trânsito", {"SituacaoNF": "TRÂNSITO"}),
    ("notas exceto para SP emitidas hoje", {"TipoData": "3", **P(TODAY)}),
    ("notas que não sejam de SP do cliente Acme", {"Cliente": "Acme"}),
    ("notas emitidas hoje exceto retidas para o cliente Acme", {"TipoData": "3", **P(TODAY), "Cliente": "Acme"}),
    ("notas baixadas na semana passada e com status DO DIA", {"TipoData": "6", **P(LAST_WEEK), "StatusAnaliseData": "DO DIA"}),
    ("me mostre as notas mais caras", {"SortColumn": "valor_nf", "SortDirection": "DESC"}),
    ("notas com maior valor", {"SortColumn": "valor_nf", "SortDirection": "DESC"}),
    ("notas do cliente Acme da entrega mais recente", {"Cliente": "Acme", "SortColumn": "data_entrega", "SortDirection": "DESC"}),
    ("notas para mg", {"UFDestino": "MG"}),
    ("notas para o rj", {"UFDestino": "RJ"}),
]
