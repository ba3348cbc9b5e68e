"""Quantiles, waits and access rules against plain versions."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fretelens.operators.evaluate import attempt_waits
from fretelens.operators.match import entitled_results
from fretelens.operators.quantiles import exact_quantiles
from fretelens.operators.ranking import previous_in_group, rank_within_groups


@pytest.mark.parametrize("bins,few", [(8, 3), (4096, 10_000)])
def test_exact_quantiles(spark, bins, few):
    """A hot group, ties, one value, extremes, nulls and NaN; few bins force many passes."""
    rng = np.random.default_rng(1)
    groups = {1: rng.normal(size=4000), 2: np.full(300, 2.5), 3: np.array([7.0]), 4: np.exp(rng.normal(size=500) * 20), 5: np.array([-1e308, 1e308, 0.0, 5e-324]),
              6: rng.integers(0, 4, 700).astype(float), None: np.arange(10.0)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(1, None), (8, None), (2, float("nan"))]
    got = {(r["g"], r["q"]): r["quantile"] for r in exact_quantiles(spark.createDataFrame(rows, "g int, v double").repartition(5), "g", "v", [0.0, 0.5, 0.95, 1.0], bins, few).collect()}
    assert set(got) == {(g, q) for g in groups for q in (0.0, 0.5, 0.95, 1.0)}
    for (g, q), x in got.items():
        s = np.sort(groups[g])
        at = q * (len(s) - 1)
        lo, hi = s[int(np.floor(at))], s[int(np.ceil(at))]
        assert x == lo + (hi - lo) * (at - np.floor(at)), (g, q)


def _attempts(spark, n):
    """One request holds a third of the rows; ties in time; a null request."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.col("id") % 211 + 1).alias("request_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7919 % 100_003 / 2).alias("ts"),
        F.when(F.col("id") % 5 < 2, 200).otherwise(500).cast("int").alias("status"), (F.col("id") * 31 % 997 / 8).alias("seconds"), "id")


@pytest.mark.parametrize("slices", [1, 13])
def test_waits_of_a_hot_request(spark, slices):
    a = _attempts(spark, 9000)
    got = previous_in_group(a, "request_id", [F.col("ts"), F.col("id")], ["ts", "status"], slices)
    w = Window.partitionBy("request_id").orderBy("ts", "id")
    want = a.withColumns({"n_in_group": F.row_number().over(w).cast("long"), "prev_ts": F.lag("ts").over(w), "prev_status": F.lag("status").over(w)})
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    waits = {r["request_id"]: r for r in attempt_waits(a, partitions=slices).collect()}
    assert sum(r["n_attempts"] for r in waits.values()) == 9000 and waits[0]["n_attempts"] == 3000 and 0 < waits[0]["n_early"] <= waits[0]["n_retries"] < 3000


def test_groups_over_many_slices(spark):
    """One group through all slices, empty slices, and as many groups as rows."""
    for df in (spark.range(50).select(F.lit(1).alias("g"), "id"), spark.range(50).select(F.col("id").alias("g"), "id"), spark.range(0).select(F.col("id").alias("g"), "id")):
        got = rank_within_groups(df, "g", [F.col("id")], partitions=20)
        want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("id")).cast("long"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_access_rules(spark):
    """Allow by any attribute, deny over all, rules for every value, repeated rules, nulls, users without rules."""
    states, names = ["SP", "RJ", None], ["A", "B"]
    rows = [(u, n, states[n % 3], names[n % 2]) for u in (1, 2, 3, 4, 5, None) for n in range(6)]
    rules = [(1, "uf_destino", "SP", True), (1, "uf_destino", "SP", True), (1, "cliente", "B", True), (2, "cliente", "*", True), (2, "uf_destino", "RJ", False),
             (3, "cliente", "A", False), (4, "uf_destino", "*", True), (4, "nf", "4", False), (4, "cliente", "B", None), (5, "cliente", "A", True), (5, "cliente", "*", False), (None, "nf", "1", True)]

    def sees(u, n, uf, c):
        row = {"uf_destino": uf, "cliente": c, "nf": str(n)}
        hit = lambda allow: any(r[0] == u and r[3] is allow and (r[2] == "*" or row[r[1]] == r[2]) for r in rules if r[0] is not None)
        return hit(True) and not hit(False)

    m = spark.createDataFrame(rows, "user_id int, nf long, uf_destino string, cliente string")
    got = entitled_results(m, spark.createDataFrame(rules, "user_id int, attribute string, value string, allow boolean"))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((r for r in rows if sees(*r)), key=key)
    with pytest.raises(ValueError):
        entitled_results(m, spark.createDataFrame([(1, "cor", "x", True)], "user_id int, attribute string, value string, allow boolean"))


def test_rules_narrow_the_records_before_the_match(spark):
    """Pairs that no rule opens aren't made, and what the rules leave is the same as without narrowing."""
    from fretelens.operators import match as M
    none = dict.fromkeys(M.SPEC_FIELDS)
    asked = [{}, {"UFDestino": "SP"}, {"UFDestino": "MG"}, {"Operacao": "x"}, {"SortColumn": "valor_nf", "SortDirection": "ASC"}, {"SituacaoNF": "RETIDA", "UFDestino": "RJ"}, {"NF": 5}]
    types = {"NF": "bigint", "DE": "date", "ATE": "date"}
    schema = ", ".join(["request_id int, anchor date, user_id int", *[f"{f} {types.get(f, 'string')}" for f in M.SPEC_FIELDS], "status int"])
    specs = spark.createDataFrame([(10 * u + i, None, u or None, *(none | a).values(), 200) for u in range(7) for i, a in enumerate(asked)], schema)
    ships = spark.createDataFrame([(i % 40, float(i), None, None, None, None, None, None, "c", i, "t", "1", ["SP", "MG", "RJ", None][i % 4], "z", "xy"[i % 2], ["RETIDA", "ENTREGUE"][i % 2]) for i in range(48)],
                                  "nf bigint, valor_nf double, data_emissao date, data_agenda date, data_prevista date, data_previsao_real date, data_entrega date, data_baixa date, cliente string, cod_cliente int, "
                                  "transportadora string, cnpj_raiz_transp string, uf_destino string, cidade_destino string, operacao string, situacao_nf string")
    rules = [(1, "uf_destino", "SP", True), (1, "uf_destino", "SP", True), (2, "uf_destino", "SP", True), (2, "uf_destino", "MG", True), (3, "uf_destino", "*", True), (3, "uf_destino", "RJ", True),
             (4, "uf_destino", None, True), (5, "uf_destino", "*", True), (5, "operacao", "x", False), (None, "uf_destino", "SP", True)]
    shape = "user_id int, attribute string, value string, allow boolean"
    pairs = lambda df: sorted(tuple(r) for r in df.select("request_id", "nf", "valor_nf").collect())
    whole = M.match_requests(specs, ships).cache()
    for given in (rules, [*rules, (6, "operacao", "x", True)]):
        r = spark.createDataFrame(given, shape)
        narrow = M.match_requests(M.within_rules(specs, r), ships).cache()
        assert pairs(M.entitled_results(narrow, r)) == pairs(M.entitled_results(whole, r)) != []
        assert narrow.count() < whole.count() if given is rules else narrow.count() == whole.count()
