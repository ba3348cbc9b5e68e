"""Matching, ranking and plan shape."""

from conftest import SF_SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from fretelens.operators.match import apply_filters, match_requests, spec_predicate
from fretelens.operators.ranking import rank_within_groups
from fretelens.plans import catalog as C


def _brute_force(spark, specs, ships):
    """Every pair tested with the plain predicate (small fixture only)."""
    from fretelens.operators.match import materialize, prepare_shipments, prepare_specs
    sp = materialize(prepare_specs(specs))
    return sp.crossJoin(materialize(prepare_shipments(ships))).where(spec_predicate()).select("request_id", "nf")


def test_match_equals_brute_force(spark):
    specs = C.parsed(spark, SF_SMALL).select("request_id", "anchor", "user_id", *C.FILTER_FIELDS, "status")
    ships = C.ships(spark, SF_SMALL)
    fast = match_requests(specs, ships).select("request_id", "nf")
    slow = _brute_force(spark, specs, ships)
    assert fast.count() > 0
    assert fast.exceptAll(slow).count() == 0 and slow.exceptAll(fast).count() == 0


def test_filter_on_the_parse_output_plans_fast(spark):
    """A predicate on a resolved field stays above the rule projections."""
    import time
    p = C.parsed(spark, SF_SMALL)
    for cond in (F.col("SituacaoNF") == "RETIDA", (F.col("status") == 200) & F.col("DE").isNotNull()):
        t0 = time.time()
        p.where(cond)._jdf.queryExecution().executedPlan()
        assert time.time() - t0 < 10
    assert 0 < p.where(F.col("SituacaoNF") == "RETIDA").count() < p.count()


def test_match_plan_has_no_nested_loop(spark):
    specs = C.parsed(spark, SF_SMALL).select("request_id", "anchor", "user_id", *C.FILTER_FIELDS, "status")
    plan = match_requests(specs, C.ships(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_parse_plan_has_no_python(spark):
    plan = C.parsed(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas"):
        assert node not in plan


def test_apply_filters_pushes_down(spark):
    spec = {"SituacaoNF": "TRÂNSITO", "UFDestino": "MG"}
    out = apply_filters(C.ships(spark, SF_SMALL), spec)
    rows = out.select("situacao_nf", "uf_destino").distinct().collect()
    assert all(r.situacao_nf == "TRÂNSITO" and r.uf_destino == "MG" for r in rows)


def test_rank_within_hot_group(spark):
    # one group holds a third of all rows
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1).alias("g"),
        (F.col("id") * 7919 % 10007).cast("double").alias("v"),
        F.col("id").alias("nf"))
    got = rank_within_groups(df, "g", [F.col("v").asc(), F.col("nf").asc()], partitions=8)
    ref = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("v", "nf")))
    assert got.select("g", "nf", "rank").exceptAll(ref.select("g", "nf", "rank")).count() == 0
    # the hot group was cut into several slices
    slices = (df.repartitionByRange(8, "g", "v", "nf").where(F.col("g") == 0)
                .select(F.spark_partition_id().alias("p")).distinct().count())
    assert slices > 1


def test_every_mask_equals_brute_force(spark):
    """Hand-made records of many masks (due dates, long and open ranges,
    sort-only), with the chosen key sets, with none but the empty one, and
    with salted cells."""
    from datetime import date

    from fretelens.operators import mask_join
    from fretelens.operators.match import SPEC_FIELDS, match_pairs, match_prepared, materialize, plan_match, prepare_shipments, prepare_specs
    ships = materialize(C.ships(spark, SF_SMALL))
    one = ships.orderBy("nf").first()
    base = {f: None for f in SPEC_FIELDS}
    rows = [
        {"NF": one.nf},
        {"CNPJRaizTransp": one.cnpj_raiz_transp},
        {"Transportadora": one.transportadora, "SituacaoNF": "ENTREGUE"},
        {"Cliente": one.cliente},
        {"DE": date(1996, 3, 1), "ATE": date(1996, 3, 10), "TipoData": "2"},
        {"CidadeDestino": one.cidade_destino},
        {"UFDestino": one.uf_destino, "SortColumn": "valor_nf", "SortDirection": "DESC"},
        {"Operacao": "OutBound-RIO"},
        {"StatusAnaliseData": "DO DIA"},
        {"StatusAnaliseData": "DIA SEGUINTE", "UFDestino": "MG"},
        {"SituacaoNF": "TRÂNSITO"},
        {"StatusAnaliseData": "ATRASO"},
        {"StatusAnaliseData": "ENTREGUE"},
        {"DE": date(1995, 1, 1), "ATE": date(1997, 12, 31), "TipoData": "3"},
        {"SortColumn": "data_emissao", "SortDirection": "ASC"},
    ]
    data = [(i, date(1997, 6, 15), 7, *[{**base, **r}[f] for f in SPEC_FIELDS], 200) for i, r in enumerate(rows)]
    schema = ("request_id bigint, anchor date, user_id bigint, NF bigint, DE date, ATE date, TipoData string, "
              "Cliente string, Transportadora string, UFDestino string, CidadeDestino string, Operacao string, "
              "SituacaoNF string, StatusAnaliseData string, CNPJRaizTransp string, SortColumn string, "
              "SortDirection string, status int")
    specs = spark.createDataFrame(data, schema)
    specs = materialize(specs)
    slow = {tuple(r) for r in _brute_force(spark, specs, ships).collect()}
    assert slow
    sp, sh = materialize(prepare_specs(specs)), materialize(prepare_shipments(ships))
    plan = plan_match(sp, sh)
    assert len({r.k_mask for r in sp.select("k_mask").collect()}) >= 14
    plans = [plan, mask_join.KeyPlan((mask_join.KeySet((), 5, 0.0),), plan.first, plan.last),
             mask_join.KeyPlan(tuple(mask_join.KeySet(s.fields, 3, s.per_record) for s in plan.sets), plan.first, plan.last)]
    pairs = []
    for p in plans:
        got = [tuple(r) for r in match_prepared(sp, sh, p).select("request_id", "nf").collect()]
        assert len(got) == len(set(got)) and set(got) == slow
        pairs.append(match_pairs(sp, sh, p))
    assert pairs[0] == pairs[2] < pairs[1] == len(rows) * ships.count()


def test_key_sets_follow_the_counts():
    """A set is kept while the pairs it saves outnumber the rows it adds."""
    from fretelens.operators.mask_join import choose_key_sets
    masks = {("cliente", "day2"): (1000, 5.0), ("cliente",): (1000, 1.0), ("uf",): (1, 1.0), ("nf",): (5000, 1.0)}
    stats = {"n": 100_000, "distinct": {("cliente", "day2"): 90_000, ("cliente",): 1000, ("uf",): 25, ("nf",): 100_000},
             "most": {"cliente": 40_000, "day2": 100, "uf": 5000, "nf": 1}}
    sets = choose_key_sets(masks, stats, 100)
    assert [s.fields for s in sets] == [("nf",), ("cliente",), ()]        # day2 saves 94,444 pairs, fewer than the rows; uf serves one record
    assert [s.salt for s in sets] == [1, 40, 100]
    masks["cliente", "day2"] = (5000, 5.0)
    assert ("cliente", "day2") in [s.fields for s in choose_key_sets(masks, stats, 100)]


def test_scans_are_column_pruned(spark):
    import re
    plan = C.requests(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    orders = [s for s in schemas if "o_orderkey" in s]
    lineitem = [s for s in schemas if "l_orderkey" in s]
    assert orders and all(set(x.split(":")[0] for x in s.split(",")) <= {"o_orderkey", "o_custkey", "o_orderdate"}
                          for s in orders)
    assert lineitem and all(set(x.split(":")[0] for x in s.split(",")) <= {"l_orderkey", "l_suppkey"}
                            for s in lineitem)


def test_match_join_is_spread_over_the_cores(spark):
    """Few bytes meet in many pairs: the join runs in four tasks a core, not in the one or two that its bytes are worth."""
    from datetime import date
    specs = spark.createDataFrame([(i, date(2024, 1, 1), 0, "RETIDA") for i in range(50)], "request_id bigint, anchor date, user_id bigint, situacao string")
    specs = specs.select("request_id", "anchor", "user_id", F.lit(200).alias("status"),
                         *[F.col("situacao").alias(f) if f == "SituacaoNF" else F.lit(None).cast("date" if f in ("DE", "ATE") else "bigint" if f == "NF" else "string").alias(f)
                           for f in C.FILTER_FIELDS])
    ships = C.ships(spark, SF_SMALL)
    pairs = match_requests(specs, ships).select("request_id", "nf")
    assert pairs.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert pairs.count() == 50 * ships.where("situacao_nf = 'RETIDA'").count() > 0


def test_formatted_results_need_only_shown_columns(spark):
    from fretelens.operators import match as M
    ranked = spark.sql("SELECT 1L AS request_id, 7L AS nf, 1234567.8D AS valor_nf, DATE'2024-02-03' AS data_emissao, CAST(NULL AS DATE) AS data_entrega, 'RETIDA' AS situacao_nf, 1L AS rank")
    r = M.formatted_results(ranked.select(*M.SHOWN_COLUMNS, "rank")).first()
    assert (r.emissao, r.entrega, r.valor, r.situacao, r["rank"]) == ("03/02/2024", "-", "R$ 1.234.567,80", "RETIDA", 1)


def test_amounts_are_put_together_as_the_formatter_does(spark):
    """Whole cents don't go through the formatter; what it writes is the same for every double."""
    from fretelens.operators import match as M
    values = [0.0, -0.0, 0.01, 0.5, 999.99, 1000.0, 99999.99, 999999.99, 1000000.0, 999999999.99, 1e9, 1e20, -0.001, -1234567.891, 0.005, 0.125, 1.005, 99999999.995, 123456.7,
              float("nan"), float("inf"), None, *[round(i * 7919.37, 2) for i in range(2000)], *[i / 7 for i in range(500)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shown = df.select("v", M._brazilian_number(F.col("v"), True).alias("a"), F.translate(F.format_number("v", 2), ",.", ".,").alias("b")).collect()
    assert len(shown) == len(values) and not [r for r in shown if r["a"] != r["b"]]
