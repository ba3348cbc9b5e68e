"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from fretelens.llm import ann_hilbert, topk_norms
from fretelens.llm.vectors import clean_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score int, rank int"


def make(spark, x, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, 3) for i, v in enumerate(x)], SCHEMA)


def brute(x, queries, k, keep=None):
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -np.inf
    if keep is not None:
        s[:, ~keep] = -np.inf
    return [[int(j) for j in np.lexsort((np.arange(len(x)), -r))[:k] if r[j] > -np.inf] for r in s]


def test_recall_on_the_table(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows])
    got = {}
    for r in ann_hilbert.op1_hilbert_ann(spark, SF_SMALL).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = np.arange(0, len(x), 20)
    want = brute(x, q, 20)
    assert np.mean([len({v for _, v, _ in got[int(i)]} & set(w)) / 20 for i, w in zip(q, want)]) >= 0.9
    for i in q:
        ranks, ids, scores = zip(*sorted(got[int(i)]))
        assert ranks == tuple(range(1, 21)) and list(scores) == sorted(scores, reverse=True) and i not in ids
        assert scores == pytest.approx([x[i] @ x[j] for j in ids], abs=1e-12)


def test_recall_with_small_blocks(spark):
    """Clustered vectors of different lengths: windows that hold a small part of the rows find the nearest."""
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((40, 12))[rng.integers(0, 40, 3000)] + 0.15 * rng.standard_normal((3000, 12))) * rng.uniform(0.5, 2, (3000, 1))
    v = clean_vectors(make(spark, x.astype(np.float32)), allow_zero=False)
    got = {}
    for r in ann_hilbert.hilbert_search(v, F.col("id") % 20 == 0, k=10, block=64).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    q = np.arange(0, 3000, 20)
    assert np.mean([len(got[int(i)] & set(w)) / 10 for i, w in zip(q, brute(x.astype(np.float32).astype(float), q, 10))]) >= 0.9


def test_equal_vectors_rank_by_id(spark):
    x = np.ones((500, 4), dtype=np.float32)
    v = clean_vectors(make(spark, x), allow_zero=False)
    got = ann_hilbert.hilbert_search(v, F.col("id") == 20, k=5, block=600).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4]


def test_hilbert_neighbours_touch():
    side = np.arange(8)
    cells = np.array(np.meshgrid(side, side, side)).reshape(3, -1).T
    key = ann_hilbert.hilbert_keys(cells, 3)
    assert sorted(key) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


@pytest.mark.parametrize("bucket,queries", [(4096, 1024), (37, 5)])
def test_topk_is_exact(spark, bucket, queries):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((700, 8)) * np.exp(rng.standard_normal((700, 1))) * 20)
    x[100:140] = x[99]
    x[5] = 0
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = topk_norms.norm_topk(v, F.col("id") % 50 == 0, bucket=bucket, queries=queries).orderBy("query_id", "rank").collect()
    q = np.arange(0, 700, 50)
    assert [[r["vec_id"] for r in got if r["query_id"] == i] for i in q] == brute(x, q, 5)
    assert all(r["score"] == int(x[r["query_id"]] @ x[r["vec_id"]]) for r in got)


def test_pruning_keeps_whatever_reaches_the_bound():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = rng.standard_normal((60, 6)) * rng.uniform(0.2, 3, (60, 1))
        x = x[np.argsort(-np.linalg.norm(x, axis=1))]
        q, bound = rng.standard_normal(6), rng.uniform(-1, 6)
        at = topk_norms.pruned(q, np.linalg.norm(q), bound, x, np.linalg.norm(x, axis=1))
        assert set(np.flatnonzero(x @ q >= bound)) <= set(at)


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    x = [[1, 2], None, [None, 1], [nan, 1], [inf, 0], [0, 0], [], [1, 2, 3], [3, -1], [1, 1]]
    d = make(spark, x)
    d = d.unionAll(d).unionAll(spark.createDataFrame([(None, [1.0, 1.0], 0, 0, 0)], SCHEMA))
    assert sorted(r["id"] for r in clean_vectors(d).collect()) == [0, 5, 8, 9]
    assert sorted(r["id"] for r in clean_vectors(d, allow_zero=False).collect()) == [0, 8, 9]
    v = clean_vectors(d)
    got = topk_norms.norm_topk(v, F.col("id") == 0).orderBy("rank").collect()  # 3 for 9, 1 for 8, 0 for 5
    assert [r["vec_id"] for r in got] == [9, 8, 5]


def test_no_vectors_and_no_queries(spark):
    none = make(spark, [])
    some = make(spark, [[1, 0], [0, 1]])
    for rows, cond in ((none, F.lit(True)), (some, F.lit(False))):
        assert ann_hilbert.hilbert_search(clean_vectors(rows, allow_zero=False), cond).count() == 0
        assert topk_norms.norm_topk(clean_vectors(rows), cond).count() == 0
