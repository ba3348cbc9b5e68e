"""Entity linking: longest dimension match, folded keys, unlinked names."""

from datetime import datetime

from fretelens.operators.link import entity_dimension, longest_name
from fretelens.operators.parse import parse_requests


def test_longest_match_and_unlinked(spark):
    customers = spark.createDataFrame([(1, "Acme", 0), (2, "Acme do Brasil", 0), (3, "Lojas Ômega", 0)],
                                      "c_custkey bigint, c_name string, c_nationkey int")
    suppliers = spark.createDataFrame([(1, "Rápido Log Transportes")], "s_suppkey bigint, s_name string")
    dim = entity_dimension(customers, suppliers)
    assert longest_name(dim) == 3
    rows = [(1, "notas do cliente Acme do Brasil entregues hoje"),
            (2, "notas do cliente acme"),
            (3, "notas do cliente lojas omega em trânsito"),
            (4, "notas da transportadora rapido log transportes"),
            (5, "notas do cliente BEXX"),
            (6, "notas exceto do cliente Acme")]
    df = spark.createDataFrame([(i, datetime(2025, 10, 22), 0, q) for i, q in rows],
                               "request_id bigint, ts timestamp_ntz, user_id bigint, query string")
    out = {r.request_id: r for r in parse_requests(df, dim).collect()}
    assert out[1].Cliente == "Acme do Brasil" and out[1].TipoData == "2"
    assert out[2].Cliente == "Acme" and not out[2].cliente_unlinked
    assert out[3].Cliente == "Lojas Ômega" and out[3].SituacaoNF == "TRÂNSITO"
    assert out[4].Transportadora == "Rápido Log Transportes"
    assert out[5].Cliente == "BEXX" and out[5].cliente_unlinked
    assert out[6].Cliente is None


def test_repeated_ids_places_in_names_and_two_names(spark):
    customers = spark.createDataFrame([(1, "Acme", 0), (2, "Casa de Carnes São Paulo", 0), (3, "Lojas do Rio de Janeiro", 0)], "c_custkey bigint, c_name string, c_nationkey int")
    suppliers = spark.createDataFrame([(1, "Veloz")], "s_suppkey bigint, s_name string")
    rows = [(1, "notas do cliente Acme"), (1, "notas do cliente Casa de Carnes São Paulo"), (2, "notas do cliente Lojas do Rio de Janeiro emitidas hoje"),
            (3, "notas do cliente Acme da transportadora Veloz para SP"), (None, "notas do cliente Acme")]
    df = spark.createDataFrame([(i, datetime(2025, 10, 22), 0, q) for i, q in rows], "request_id bigint, ts timestamp_ntz, user_id bigint, query string")
    out = parse_requests(df, entity_dimension(customers, suppliers)).collect()
    assert len(out) == 5
    by = {r.query: r for r in out if r.request_id}
    assert by[rows[0][1]].Cliente == "Acme" and by[rows[1][1]].Cliente == "Casa de Carnes São Paulo" and by[rows[1][1]].UFDestino is None
    assert by[rows[2][1]].Cliente == "Lojas do Rio de Janeiro" and by[rows[2][1]].UFDestino is None and by[rows[2][1]].TipoData == "3"
    assert (by[rows[3][1]].Cliente, by[rows[3][1]].Transportadora, by[rows[3][1]].UFDestino) == ("Acme", "Veloz", "SP")
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_gazetteer_of_cities(spark):
    """Longest name, folded, explicit before plain, states apart, ambiguity, negation, names of customers, repeated ids, two cities."""
    from fretelens.operators.places import place_dimension
    customers = spark.createDataFrame([(1, "Acme", 0), (2, "Mercado em Bom Jesus", 0)], "c_custkey bigint, c_name string, c_nationkey int")
    suppliers = spark.createDataFrame([(1, "Veloz")], "s_suppkey bigint, s_name string")
    towns = spark.createDataFrame([("Xanxerê", "SC"), ("Bom Jesus", "PI"), ("Bom Jesus", "RS"), ("Bom Jesus da Lapa", "BA"), ("São Paulo", "SP"), ("Entregue", "AM"), (None, "SP"), ("", None), ("Manaus", "AM")], "city string, state string")
    places = place_dimension(towns)
    assert places.count() == 5
    cases = [("notas para xanxere", "Xanxerê", None, False), ("notas para Bom Jesus", "Bom Jesus", None, True), ("notas para Bom Jesus em RS", "Bom Jesus", "RS", False),
             ("notas para a cidade de Bom Jesus da Lapa emitidas hoje", "Bom Jesus da Lapa", None, False), ("notas para São Paulo", None, "SP", False),
             ("notas para a cidade de São Paulo", "São Paulo", "SP", False), ("notas para Xanxerê ou para Bom Jesus", None, None, False),
             ("notas em trânsito para a cidade de Xanxerê", "Xanxerê", None, False), ("notas exceto para Xanxerê", None, None, False), ("notas do cliente Mercado em Bom Jesus", None, None, False),
             ("notas para Entregue", "Entregue", None, False), ("notas para Manaus", "Manaus", None, False), ("notas para Xanxerê ou para Campinas", None, None, False),
             ("notas do cliente Acme para Xanxerê, em trânsito", "Xanxerê", None, False), ("notas para amanhã", None, None, False), ("", None, None, False), (None, None, None, False)]
    df = spark.createDataFrame([(i % 3, datetime(2025, 10, 22), 0, c[0]) for i, c in enumerate(cases)], "request_id bigint, ts timestamp_ntz, user_id bigint, query string")
    dim = entity_dimension(customers, suppliers)
    out = parse_requests(df, dim, places=places).collect()
    got = {r.query: (r.CidadeDestino, r.UFDestino, r.city_ambiguous) for r in out}
    assert len(out) == len(cases) and got == {c[0]: c[1:] for c in cases}
    assert next(r for r in out if r.query == "notas para Entregue").SituacaoNF is None
    none = parse_requests(df, dim, places=places.limit(0)).collect()
    assert {r.query: r.CidadeDestino for r in none}["notas para Manaus"] == "Manaus"
