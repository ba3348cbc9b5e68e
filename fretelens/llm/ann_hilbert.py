"""Approximate nearest neighbours by shifted space-filling curves (operator 1).

Every curve projects the vectors onto a few random directions, shifts the
grid, and orders the cells along a Hilbert curve.  Spark range-partitions each
ordering; a query meets the rows of its own block of the ordering and of both
neighbouring blocks, and what the curves find is merged and reranked by the
exact inner product.  How long a block has to be depends on the data and grows
with it, so it is measured: the exact nearest of a few queries are found by
one scan, and the block is the shortest in which they reach the recall aimed
at.

Largest inner products become nearest neighbours by the usual lift: a
candidate x becomes (x, sqrt(M^2 - |x|^2)) / M with M the largest length, a
query q becomes (q, 0) / |q|.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fretelens.llm.common import materialize, table, with_position
from fretelens.llm.vectors import clean_vectors, matrix

#: Curves, least rows of a block, projected dimensions, bits a dimension.
CURVES, BLOCK, DIMS, BITS = 18, 1024, 8, 6
#: Recall the block is chosen for, queries it is measured on, growth of the block from try to try.
RECALL, PROBES, GROWTH = 0.95, 200, 1.25
#: Rows that a task holds of a block (a longer block is several), queries it multiplies at once.
HELD, AT_ONCE = 16384, 256


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (rows of ``cells``, below 2**bits) on the Hilbert curve."""
    x = [c.astype(np.int64) for c in cells.T]
    m = len(x)
    for level in range(bits - 1, -1, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(m):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, m):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[m - 1] >> level) & 1 == 1, flip ^ ((1 << level) - 1), flip)
    key = np.zeros(len(cells), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << 1) | (((x[i] ^ flip) >> level) & 1)
    return key


def _lift(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    n2 = (x * x).sum(axis=1)
    if query:
        return np.hstack([x / np.sqrt(n2)[:, None], np.zeros((len(x), 1))])
    return np.hstack([x / longest, np.sqrt(np.maximum(0, 1 - n2 / longest**2))[:, None]])


def _moments(vectors: DataFrame, longest: float, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the lifted vectors; every task sends (d + 1)^2 sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(d + 1), np.zeros((d + 1, d + 1))
        for b in batches:
            z = _lift(matrix(b.column("v").to_pandas(), d), longest, False) if b.num_rows else np.zeros((0, d + 1))
            n, s, ss = n + len(z), s + z.sum(axis=0), ss + z.T @ z
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [np.concatenate([s, ss.ravel()]).tolist()]})

    parts = vectors.select("v").mapInArrow(run, "n long, s array<double>")
    at = parts.select("n", F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()
    n, sums = at[0]["n"], np.array([r["x"] for r in at])
    mean = sums[: d + 1] / n
    return mean, sums[d + 1 :].reshape(d + 1, d + 1) / n - np.outer(mean, mean)


def _long_enough(vectors: DataFrame, ordered: DataFrame, d: int, k: int, block: int) -> int:
    """The shortest block, from ``block`` on, whose window finds ``RECALL`` of the k nearest of some queries.

    The driver gets ``PROBES`` queries, their k nearest and the places of both
    on every curve.
    """
    n = vectors.count()
    zero = F.forall("v", lambda c: c == 0)
    probes = vectors.where(F.col("q") & ~zero).orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(PROBES).select("id", "v").toPandas()
    if n <= block or not len(probes):
        return block
    mine, q = probes["id"].to_numpy(), matrix(probes["v"], d)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("id").to_numpy()
            s = matrix(b.column("v").to_pandas(), d) @ q.T
            s[ids[:, None] == mine[None, :]] = -np.inf
            top = np.argsort(-s, axis=0, kind="stable")[:k]
            row, col = top.ravel(), np.tile(np.arange(len(mine)), len(top))
            real = s[row, col] > -np.inf
            yield pa.RecordBatch.from_pydict({"query_id": mine[col][real], "id": ids[row][real], "s": s[row, col][real]})

    found = vectors.select("id", "v").mapInArrow(nearest, "query_id long, id long, s double")
    best = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("s")).alias("s"), "id"))), 1, k)
    pairs = materialize(found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.explode("best.id").alias("id")))
    pairs = pairs.toPandas().drop_duplicates()
    spark = vectors.sparkSession
    wanted = [(int(i), True) for i in set(pairs["query_id"])] + [(int(i), False) for i in set(pairs["id"])]
    if not wanted:
        return block
    at = ordered.join(F.broadcast(spark.createDataFrame(wanted, "id long, query boolean")), ["id", "query"]).select("curve", "id", "query", "position").toPandas()
    at = at.drop_duplicates(["curve", "id", "query"])
    left = pairs.merge(at[at["query"]].rename(columns={"id": "query_id", "position": "from"})[["query_id", "curve", "from"]], on="query_id")
    both = left.merge(at[~at["query"]][["id", "curve", "position"]], on=["id", "curve"])
    while block < 2 * n * (int(at["curve"].max()) + 1):  # by then the block holds every row
        near = (both["from"] // block - both["position"] // block).abs() <= 1
        if near.groupby([both["query_id"], both["id"]]).any().mean() >= RECALL:
            break
        block = int(block * GROWTH) + 1
    return block


def hilbert_search(vectors: DataFrame, is_query, k: int = 20, curves: int = CURVES, block: int = BLOCK,
                   dims: int = DIMS, bits: int = BITS, seed: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query.

    ``vectors`` is (id, v) as ``clean_vectors`` gives it; ``is_query`` a
    condition on it.  A query's own id is no candidate.  Ties go to the
    smaller id.  Fewer than k candidates: all that exist are found when they
    fit the window.  No vectors or no queries: an empty result.  ``block`` is
    the least block; it grows until ``RECALL`` is reached on ``PROBES`` of the
    queries, if need be to the whole table.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    vectors = materialize(vectors.select("id", "v", is_query.alias("q")))
    head = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m"), F.max(F.size("v")).alias("d")).first()
    if head["d"] is None:
        return spark.createDataFrame([], out)
    d, longest = head["d"], float(np.sqrt(head["m"])) or 1.0
    mean, cov = _moments(vectors, longest, d)
    dims = min(dims, d + 1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        maps = []
        for _ in range(curves):
            r, _ = np.linalg.qr(rng.standard_normal((d + 1, dims)))
            spread = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", r, cov, r), 1e-30))
            maps.append((r, mean @ r, spread, rng.random(dims)))
        for b in batches:
            if not b.num_rows:
                continue
            ids, x, q = b.column("id").to_numpy(), matrix(b.column("v").to_pandas(), d), b.column("q").to_numpy(zero_copy_only=False)
            raw = np.array([r.tobytes() for r in np.ascontiguousarray(x, dtype="<f8")], dtype=object)
            mine = np.flatnonzero(q & ((x * x).sum(axis=1) > 0))
            for query, ids_, z, raw_ in ((False, ids, _lift(x, longest, False), raw), (True, ids[mine], _lift(x[mine], longest, True), raw[mine])):
                if not len(ids_):
                    continue
                for c, (r, mu, spread, shift) in enumerate(maps):
                    u = 1 / (1 + np.exp(np.clip(-1.702 * (z @ r - mu) / spread, -50, 50)))
                    cells = np.clip((u * ((1 << bits) - 1) + shift).astype(np.int64), 0, (1 << bits) - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ids_), c, np.int32)), pa.array(hilbert_keys(cells, bits)), pa.array(ids_), pa.array(np.full(len(ids_), query)), pa.array(raw_, pa.binary())],
                        names=["curve", "key", "id", "query", "v"])

    ordered = with_position(vectors.mapInArrow(keys, "curve int, key long, id long, query boolean, v binary"), "curve", "key", "id", "query")
    # a block holds the rows of one curve only, as the group key has the curve
    block = _long_enough(vectors, ordered, d, k, block)
    parts = -(-block // HELD)  # a block is so many pieces, each met on its own
    ordered = ordered.withColumn("block", F.expr(f"position div {-(-block // parts)}"))
    met = ordered.where("not query").unionByName(ordered.where("query").withColumn("block", F.explode(F.expr(f"sequence(block - {parts}, block + {parts})"))))

    def score(g: pd.DataFrame) -> pd.DataFrame:
        qs, xs = g[g["query"]], g[~g["query"]]
        rows = []
        if len(qs) and len(xs):
            ids, x = xs["id"].to_numpy(), matrix(xs["v"])
            slack = 1e-9 * longest * longest
            for a in range(0, len(qs), AT_ONCE):
                some = matrix(qs["v"].iloc[a : a + AT_ONCE])
                for qid, q, s in zip(qs["id"].to_numpy()[a : a + AT_ONCE], some, some @ x.T):
                    s[ids == qid] = -np.inf
                    cut = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
                    at = np.flatnonzero((s >= cut - slack) & (s > -np.inf))
                    exact = (x[at] * q).sum(axis=1)  # the same sum for equal vectors, wherever they lie
                    best = np.lexsort((ids[at], -exact))[:k]
                    rows.append((qid, ids[at][best], exact[best]))
        return pd.DataFrame(rows, columns=["query_id", "ids", "scores"])

    found = met.select("curve", "block", "id", "query", "v").groupBy("curve", "block").applyInPandas(score, "query_id long, ids array<long>, scores array<double>")

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        ids, first = np.unique(np.concatenate(g["ids"].to_numpy()), return_index=True)
        s = np.concatenate(g["scores"].to_numpy())[first]
        best = np.lexsort((ids, -s))[:k]
        return pd.DataFrame({"query_id": g["query_id"].iloc[0], "rank": np.arange(1, len(best) + 1, dtype=np.int32), "vec_id": ids[best], "score": s[best]})

    return found.groupBy("query_id").applyInPandas(merge, out)


def op1_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of `embeddings`: the 20 nearest found for every row whose vec_id is divisible by 20."""
    vectors = clean_vectors(table(spark, sf_dir, "embeddings"), allow_zero=False)
    return hilbert_search(vectors, F.col("id") % 20 == 0)
