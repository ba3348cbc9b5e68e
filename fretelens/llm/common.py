"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fretelens.session import checkpoint_dir

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step works on (a longer text makes its own step).
STEP_BYTES = 512 << 10

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BYTE = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor rereads files instead of recomputing.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    # nothing else uses what this job shuffles, so its files go when it ends
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    for made in _open_stages:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def forget(*tables: DataFrame) -> None:
    """Remove materialized tables that nothing reads any more."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            _remove(t.sparkSession, path)


def alone(make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` as a materialized table; the tables that it wrote on the way are removed."""
    made: list[str] = []
    _open_stages.append(made)
    try:
        out = materialize(make())
    finally:
        _open_stages.pop()
    for path in made[:-1]:
        _remove(out.sparkSession, path)
    return out


#: Tables written since each stage that is running began, and those of stages that have ended.
_open_stages: list[list[str]] = []
_ended: list[str] = []


def clearing(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A pipeline stage, whose result its caller writes and reads again for the next one.

    When a later stage starts on documents that don't read them, the tables
    that ended stages needed on the way are removed.
    """
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _ended else []
        for path in [p for p in _ended if not any(p.rsplit("/", 1)[1] in f for f in read)]:
            _remove(spark, path)
            _ended.remove(path)
        made: list[str] = []
        _open_stages.append(made)
        try:
            return stage(spark, docs, sf_dir)
        finally:
            _open_stages.pop()
            _ended.extend(made)
    return run


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """Written table of ``df`` with a number of its own for every row, rising in the order of its partitions."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


def perhaps_in(df: DataFrame, key: str, need: DataFrame, bits: int = 20) -> DataFrame:
    """Rows of ``df`` whose key may be in ``need`` (none that is gets lost), before an exact join.

    What is broadcast is a set of at most 2**bits hash slots, whatever the
    data; once ``need`` fills them all, the join after it does all the work.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits)).alias("_slot")
    return df.select("*", slot).join(F.broadcast(need.select(slot).distinct()), "_slot", "left_semi").drop("_slot")


def partitions_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_position(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """Rows numbered 0..n-1 in the total order ``order``, by a range shuffle.

    Slices of the range shuffle are numbered locally; slice offsets come from
    one count per partition (as many rows as partitions, not data).
    """
    n = partitions_for(df)
    part = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    )
    part = materialize(part)
    counts = sorted((r[0], r[1]) for r in part.groupBy("_part").count().collect())
    offset, rows = 0, []
    for p, c in counts:
        rows.append((p, offset))
        offset += c
    at = df.sparkSession.createDataFrame(rows, "_part int, _offset long")
    return part.join(F.broadcast(at), "_part").withColumn(name, F.col("_row") + F.col("_offset")).drop("_part", "_row", "_offset")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2**64, for positions up to n."""
    if "up" not in _POW or len(_POW["up"]) <= n:
        size = max(n + 1, STEP_BYTES + 65536)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.ones(size, dtype=np.uint64)
            done, step = 1, base
            while done < size:  # doubling
                take = min(done, size - done)
                p[done : done + take] = p[:take] * np.uint64(step)
                step = step * step % (1 << 64)
                done += take
            _POW[key] = p
    return _POW["up"], _POW["down"]


class Rolling:
    """Hashes of any byte ranges of one buffer, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers(len(data))
        self._sum = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self._sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start] + (end - start).astype(np.uint64) * _MULT)


def text_steps(column: pa.Array, step: int = STEP_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past row, bytes, byte offsets) of pieces of a string column, of at most ``rows`` rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + step, side="right")) - 1
        b = min(n, a + rows, max(b, a + 1))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased (A-Z) texts: word hashes, starts, ends, and first word of each text (one more at the end).

    A text's end also ends a word; words are runs of ``WORD``.
    """
    low = _LOWER[data]
    inside = ~_SPACE[low]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] = inside[cuts]
    starts = np.flatnonzero(begin)
    stop = np.ones(len(data), dtype=bool)
    stop[:-1] = ~inside[1:]
    if len(cuts):
        stop[cuts - 1] = True
    ends = np.flatnonzero(stop & inside) + 1
    first = np.searchsorted(starts, offsets)
    return Rolling(low)(starts, ends), starts, ends, first


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """Per text: the sorted distinct hashes of its word shingles (the whole sequence if it has fewer words)."""
    w, _, _, first = words(data, offsets)
    n = max(0, len(w) - width + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        rolled = rolled * _MULT + w[j : j + n]
    rolled = mix(rolled)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            h = np.zeros(1, dtype=np.uint64)
            for j in range(a, b):
                h = h * _MULT + w[j]
            yield mix(h + np.uint64(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as (node, component), component the smallest node.

    Alternating large and small stars: every round is a minimum per node
    (partly aggregated before the shuffle) and one join, so a hub is split by
    the skew join; nothing is gathered per node or on the driver.  Each round
    is a written table, which goes when the next one is there.
    """
    return alone(lambda: _components(edges, most_rounds))


def _components(edges: DataFrame, most_rounds: int) -> DataFrame:
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        nxt = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        old, cur = cur, materialize(nxt.select("e.a", "e.b").where("a <> b").distinct())
        forget(old)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = cur.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
