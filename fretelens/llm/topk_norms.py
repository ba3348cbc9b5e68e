"""Exact top-k inner products by norm buckets (operator 10).

Candidates are ordered by length and cut into buckets.  The bucket of the
longest ones gives every query a first lower bound on its k-th best score.  A
query visits a bucket only if |q| times the bucket's largest length reaches
that bound; inside, the local cosine threshold (bound over the product of
lengths) picks coordinate or length pruning, and what is left is verified by
its exact integer product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from fretelens.llm.common import materialize, table, with_position
from fretelens.llm.vectors import clean_vectors, matrix

#: Rows of a bucket and of a block of queries: what one task holds at a time.
BUCKET, QUERIES = 4096, 1024
#: Bucket bounds a lookup table holds at most (beyond that, bounds of runs of buckets).
BOUNDS = 4096
#: Local cosine thresholds from here on use coordinate pruning, on so many coordinates.
COORDINATE_FROM, FOCUS = 0.3, 4


def verified(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; float64 where every partial sum stays below 2**53."""
    if not len(x):
        return np.zeros(0, dtype=np.int64)
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * len(q) < 2.0**53:
        return (x @ q).astype(np.int64)
    return x.astype(np.int64) @ q.astype(np.int64)


def pruned(q: np.ndarray, q_len: float, bound: float, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places in a bucket (lengths falling) that can reach ``bound``."""
    top = lengths[0] if len(lengths) else 0.0
    if bound <= 0 or not q_len or not top:
        return np.arange(len(x))
    reach = int(np.searchsorted(-lengths, -bound / q_len * (1 - 1e-12), side="right"))  # length pruning
    cosine = bound / (q_len * top)
    if cosine < COORDINATE_FROM or not reach:
        return np.arange(reach)
    keep = np.ones(reach, dtype=bool)
    room = 1 - min(1.0, cosine) ** 2
    for f in np.argsort(-np.abs(q))[:FOCUS]:  # coordinate pruning: p.q >= t bounds each coordinate of p
        qf = q[f] / q_len
        width = np.sqrt(room * max(0.0, 1 - qf * qf)) + 1e-9
        p = x[:reach, f] / np.maximum(lengths[:reach], 1e-300)
        centre = qf * min(1.0, cosine)
        # below the centre a larger cosine only narrows; above, a vector along q is always allowed
        keep &= (p >= centre - width) if qf >= 0 else (p <= centre + width)
    return np.flatnonzero(keep)


def norm_topk(vectors: DataFrame, is_query, k: int = 5, bucket: int = BUCKET, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer products of every query, exactly.

    ``vectors`` is (id, v) with whole-number components; a query's own id is
    no candidate; ties go to the smaller id; fewer candidates than k: all.
    No vectors or no queries: an empty result.
    """
    spark = vectors.sparkSession
    n2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    pos = with_position(vectors.select("id", "v", is_query.alias("q"), n2.alias("n2")), F.desc("n2"), F.asc("id"))
    pos = materialize(pos.select("id", "v", "q", "n2", F.expr(f"position div {bucket}").alias("bucket")))
    n_queries, last = pos.agg(F.count_if("q"), F.max("bucket")).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    # at most BOUNDS rows: the largest length of every run of `run` buckets, falling
    run = -(-(last + 1) // BOUNDS)
    tops = pos.groupBy(F.expr(f"bucket div {run}").alias("r")).agg(F.sqrt(F.max("n2")).alias("top")).orderBy("r").collect()
    tops = np.array([r["top"] for r in tops])
    # one bucket: at most `bucket` vectors
    longest = pos.where("bucket = 0").select("id", "v", "n2").toPandas()

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> list[tuple]:
        right = right.sort_values(["n2", "id"], ascending=[False, True])
        ids, x, lengths = right["id"].to_numpy(), matrix(right["v"]), np.sqrt(right["n2"].to_numpy())
        rows = []
        for qid, q, q_len, bound in zip(left["id"], matrix(left["v"]), np.sqrt(left["n2"]), left["bound"]):
            at = pruned(q, q_len, bound, x, lengths)
            s = verified(q, x[at])
            ok = (ids[at] != qid) & (s >= bound)
            s, mine = s[ok], ids[at][ok]
            best = np.lexsort((mine, -s))[:k]
            rows.append((qid, mine[best], s[best]))
        return rows

    def seed(batches):
        for b in batches:
            if len(b):
                found = scan(b.assign(bound=-np.inf), longest)
                b["bound"] = [float(s[k - 1]) if len(s) >= k else -np.inf for _, _, s in found]
                reach = [run * int(np.searchsorted(-tops, -t / n * (1 - 1e-12), side="right")) if t > 0 and n > 0 else last + 1
                         for t, n in zip(b["bound"], np.sqrt(b["n2"]))]
                yield b.assign(past=np.minimum(reach, last + 1))[["id", "v", "n2", "bound", "past"]]

    asked = pos.where("q").select("id", "v", "n2").mapInPandas(seed, "id long, v array<double>, n2 double, bound double, past long")
    blocks = -(-n_queries // queries)
    asked = materialize(asked.withColumn("qblock", F.pmod(F.xxhash64("id"), F.lit(blocks))))
    # buckets fall in length, so what a query visits is a prefix of them
    visits = asked.where("past > 0").withColumn("bucket", F.explode(F.expr("sequence(0L, past - 1)")))
    spans = asked.groupBy("qblock").agg(F.max("past").alias("past")).where("past > 0")
    pairs = spans.select("qblock", F.explode(F.expr("sequence(0L, past - 1)")).alias("bucket"))
    held = pos.select("id", "v", "n2", "bucket").join(pairs, "bucket").toDF("at_bucket", "id", "v", "n2", "at_qblock")

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(scan(left, right) if len(left) and len(right) else [], columns=["query_id", "ids", "scores"])

    found = visits.groupBy("bucket", "qblock").cogroup(held.groupBy("at_bucket", "at_qblock")).applyInPandas(visit, "query_id long, ids array<long>, scores array<long>")
    flat = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("query_id", F.col("e.ids").alias("vec_id"), F.col("e.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of `embeddings` as floor(256 * x): the 5 highest products for every row whose vec_id is divisible by 50."""
    vectors = clean_vectors(table(spark, sf_dir, "embeddings"))
    whole = vectors.select("id", F.transform("v", lambda x: F.floor(256 * x).cast("double")).alias("v"))
    return norm_topk(whole, F.col("id") % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, min(embedding) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
w AS (SELECT vec_id, list_transform(e, x -> floor(256 * x::DOUBLE)) AS e FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM w q JOIN w c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
