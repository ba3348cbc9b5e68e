"""Jaccard metric-space join on word 5-grams (operator 2).

Jaccard distance is a metric.  Documents that share rare shingles meet a
common pivot; each pivot's documents are its region.  A region that is too
large for a task gets pivots of its own: every document joins the Voronoi
region of its nearest pivot and, by the triangle inequality, all regions whose
pivot is no more than twice the join distance farther; this is repeated, and
regions that no pivot can divide (all documents near each other) are joined
block against block.  Within a region the distances are exact.

Almost all distances in a corpus are 1, where pivots tell nothing apart, so an
exact bound goes first: a linked document shares at least 80 % of its shingles,
so one with more shingles of its own than the bound allows is linked to
nothing, and two linked documents share a shingle among the rarest ones that
the bound leaves.  Those rarest shingles lead a document to its pivots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fretelens.llm.common import clearing, components, materialize, mix, numbered, shingles, table, text_steps
from fretelens.llm.suffix_dedup import planes, unplanes

#: Link if 100 * intersection >= PERCENT * union; words of a shingle.
PERCENT, WIDTH = 80, 5
#: Bytes of text of a unit and of a count bucket; documents that one task joins; pivots and rounds of a division.
UNIT, BUCKET, BLOCK, PIVOTS, ROUNDS = 8 << 20, 16 << 20, 256, 16, 4
_KEY_BITS = 40


def _least_shared(n: np.ndarray | int, percent: int):
    """Shingles that a set of n shares at least with any it links to."""
    return -(-n * percent // 100)


class Unit:
    """Shingle sets of the texts of a unit; equal sets once."""

    def __init__(self, t: pa.Table):
        sets: list[np.ndarray] = []
        for _, _, data, offsets in text_steps(t.column("text")):
            sets += [s.copy() for s in shingles(data, offsets, WIDTH)]
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        total = lambda s, a, b: int(mix((s * np.uint64(a)) ^ (s >> np.uint64(b))).sum(dtype=np.uint64))
        self.prints = np.array([total(s, 0x9E3779B97F4A7C15, 29) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
        _, first, self.copies = np.unique(self.prints, return_index=True, return_counts=True)
        keep = self.sizes[first] > 0
        self.first, self.copies = first[keep], self.copies[keep]
        self.sets = [sets[i] for i in self.first]
        every = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        self.keys, self.back, self.counts = np.unique(every >> np.uint64(64 - _KEY_BITS), return_inverse=True, return_counts=True)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(((keys >> np.uint64(_KEY_BITS - 32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))


def _ask(u: Unit, unit: int, buckets: int) -> pa.Table:
    cut = _bucket(u.keys, buckets)
    spans = [(i, a, z) for i, (a, z) in enumerate(zip(cut[:-1], cut[1:])) if z > a]
    return pa.table({"unit": pa.array([unit] * len(spans), pa.int64()), "bucket": pa.array([s[0] for s in spans], pa.int64()),
                     "keys": pa.array([planes(u.keys[a:z]) for _, a, z in spans], pa.binary()),
                     "counts": pa.array([np.minimum(u.counts[a:z], 255).astype(np.uint8).tobytes() for _, a, z in spans], pa.binary())})


def _count(t: pa.Table) -> pa.Table:
    """How many sets of the corpus hold each key asked for (255 and more: 255)."""
    got = [unplanes(k, np.uint64) for k in t.column("keys").to_pylist()]
    key = np.concatenate(got)
    counts = np.concatenate([np.frombuffer(c, dtype=np.uint8) for c in t.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    total = np.empty(len(key), dtype=np.int64)
    total[order] = np.add.reduceat(counts[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    total = np.minimum(total, 255).astype(np.uint8)
    cut = np.cumsum([0, *map(len, got)])
    return pa.table({"unit": t.column("unit"), "bucket": t.column("bucket"), "counts": pa.array([total[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary())})


_SET = "doc_id {}, n long, print long, copies long, rare binary, shared binary"


def _describe(u: Unit, ids: pa.ChunkedArray, answers: pa.Table, percent: int) -> pa.Table:
    """Every document with its set's size and print; with the first of each set that can have links: copies here, rare shingles, shared shingles."""
    df = np.frombuffer(b"".join(answers.sort_by("bucket").column("counts").to_pylist()), dtype=np.uint8)
    if len(df) != len(u.keys):
        raise RuntimeError("a unit's answers don't fit its texts")
    n = len(u.sizes)
    copies, rare, shared = [None] * n, [None] * n, [None] * n
    of = df[u.back]
    at = np.cumsum([0, *map(len, u.sets)])
    for j, (i, s) in enumerate(zip(u.first, u.sets)):
        d = of[at[j] : at[j + 1]]
        least = _least_shared(len(s), percent)
        copies[i] = int(u.copies[j])
        if int((d > 1).sum()) >= least:
            lead = np.lexsort((s, d))[: len(s) - least + 1]
            rare[i], shared[i] = s[lead[d[lead] > 1]].tobytes(), s[d > 1].tobytes()
    prints = pa.array(u.prints, pa.int64(), mask=u.sizes == 0)
    return pa.table({"doc_id": ids, "n": u.sizes, "print": prints, "copies": pa.array(copies, pa.int64()), "rare": pa.array(rare, pa.binary()), "shared": pa.array(shared, pa.binary())})


def document_sets(docs: DataFrame, percent: int = PERCENT, unit: int = UNIT, bucket: int = BUCKET) -> DataFrame:
    """Written table of every document's set: doc_id, n, print (null if empty) and, for one row a unit of each set that can have links, its shingles."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    units, buckets = max(1, -(-size // unit)), max(1, -(-size // bucket))
    d = d.withColumn("unit", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(units)))
    kind = _SET.format(docs.schema["doc_id"].dataType.simpleString())

    def ask(t: pa.Table) -> pa.Table:
        return _ask(Unit(t), t.column("unit")[0].as_py(), buckets)

    def describe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("print", pa.int64()), ("copies", pa.int64()), ("rare", pa.binary()), ("shared", pa.binary())]).empty_table()
        return _describe(Unit(left), left.column("doc_id"), right, percent)

    asked = d.groupBy("unit").applyInArrow(ask, "unit long, bucket long, keys binary, counts binary")
    answers = materialize(asked.groupBy("bucket").applyInArrow(_count, "unit long, bucket long, counts binary"))
    return materialize(d.groupBy("unit").cogroup(answers.toDF("at_unit", "bucket", "counts").groupBy("at_unit")).applyInArrow(describe, kind))


def _sets_of(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.uint64) for b in t.column("shared").to_pylist()]


def overlaps(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``, by products of presence matrices."""
    every, back = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    left = row < len(a)
    both = (np.bincount(back[left], minlength=len(every)) > 0) & (np.bincount(back[~left], minlength=len(every)) > 0)
    number = np.cumsum(both) - 1
    keep = both[back]
    row, col = row[keep], number[back[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    total = int(both.sum())
    for c in range(0, total, columns):
        lo, hi = np.searchsorted(col, [c, c + columns])
        x = np.zeros((len(a) + len(b), min(columns, total - c)), dtype=np.float32)
        x[row[lo:hi], col[lo:hi] - c] = 1
        out += x[: len(a)] @ x[len(a) :].T
    return out.astype(np.int64)


def _linked(t: pa.Table, percent: int) -> pa.Table:
    """Of one joined block (or two, by side): a spanning forest of its links, and each set's links that no earlier task counts."""
    side = t.column("side").to_numpy()
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if (side == 1).any() else a
    if not len(a):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    sets, n = _sets_of(t), t.column("n").to_numpy()
    x = overlaps([sets[i] for i in a], [sets[i] for i in b])
    union = n[a][:, None] + n[b][None, :] - x
    hit = 100 * x >= percent * union
    if b is a:
        hit = np.triu(hit, 1)
    ids, copies = t.column("print").to_numpy(), t.column("copies").to_numpy()
    task = t.column("task")[0].as_py()
    tasks = [set(v) for v in t.column("tasks").to_pylist()]
    root = np.arange(len(ids))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links, forest = np.zeros(len(ids), dtype=np.int64), []
    for i, j in zip(*np.nonzero(hit)):
        i, j = a[i], b[j]
        p, q = top(i), top(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            forest.append((ids[i], ids[j]))
        if min(tasks[i] & tasks[j]) == task:
            links[i] += copies[j]
            links[j] += copies[i]
    some = np.flatnonzero(links)
    return pa.table({"a": pa.array([f[0] for f in forest] + ids[some].tolist(), pa.int64()), "b": pa.array([f[1] for f in forest] + [None] * len(some), pa.int64()),
                     "links": pa.array([None] * len(forest) + links[some].tolist(), pa.int64())})


def _divide(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """Members of a region to the Voronoi regions of its pivots: the nearest, and all within twice the join distance of it."""
    if not left.num_rows or not right.num_rows:
        return pa.table({"region": pa.array([], pa.int64()), "print": pa.array([], pa.int64())})
    x = overlaps(_sets_of(left), _sets_of(right))
    union = left.column("n").to_numpy()[:, None] + right.column("n").to_numpy()[None, :] - x
    d = 1 - x / union
    member, pivot = np.nonzero(d <= d.min(axis=1, keepdims=True) + 2 * (1 - percent / 100) + 1e-9)
    region, which = left.column("region").to_numpy(), right.column("print").to_numpy()
    key = mix(region[member].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + which[pivot].astype(np.uint64)).view(np.int64)
    return pa.table({"region": key, "print": left.column("print").to_numpy()[member]})


def joined_tasks(regions: DataFrame, sets: DataFrame, percent: int = PERCENT, block: int = BLOCK, pivots: int = PIVOTS, rounds: int = ROUNDS) -> DataFrame:
    """(task, side, print): regions within ``block``, larger ones divided, and those that pivots can't divide as pairs of blocks."""
    spark = regions.sparkSession
    done = None
    for k in range(rounds + 1):
        sized = regions.join(regions.groupBy("region").agg(F.count("*").alias("members")), "region")
        small = sized.where(F.col("members") <= block).select(F.xxhash64("region").alias("task"), F.lit(0).alias("side"), "print")
        done = small if done is None else done.unionByName(small)
        large = sized.where(F.col("members") > block)
        if large.isEmpty():
            return done
        if k < rounds:
            near = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("print", F.lit(k))))
            chosen = large.withColumn("r", near).where(F.col("r") <= pivots).select("region", "members", "print").join(sets, "print")
            parts = F.expr(f"cast(ceil(members / {block}) as int)")
            dealt = large.withColumn("salt", F.pmod(F.xxhash64("print"), parts)).join(sets.select("print", "n", "shared"), "print")
            chosen = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).select("region", F.col("salt").cast("long"), "print", "n", "shared").toDF("at_region", "at_salt", "print", "n", "shared")
            divided = materialize(dealt.select("region", F.col("salt").cast("long").alias("salt"), "print", "n", "shared").groupBy("region", "salt").cogroup(
                chosen.groupBy("at_region", "at_salt")).applyInArrow(lambda a, b: _divide(a, b, percent), "region long, print long"))
            if divided.count() <= 2 * large.count():
                regions = divided
                continue
        # no use in dividing: blocks against blocks
        blocks = F.expr(f"cast(ceil(members / {block}) as int)")
        b = large.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
        other = b.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        task = F.xxhash64("region", F.least("mine", "other"), F.greatest("mine", "other"))
        return done.unionByName(other.select(task.alias("task"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "print"))
    return done


def jaccard_links(described: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Written table of what the regions found: links (a, b) that span every component, and counts of links (a, null, links)."""
    sets = described.where("copies is not null").groupBy("print").agg(F.sum("copies").alias("copies"), F.any_value("n").alias("n"), F.any_value("rare").alias("rare"), F.any_value("shared").alias("shared"))
    sets = materialize(sets.where("rare is not null"))

    def lead(batches):
        for b in batches:
            for p, rare in zip(b.column("print").to_pylist(), b.column("rare").to_pylist()):
                t = np.frombuffer(rare, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.full(len(t), p))], names=["token", "print"])

    rows = materialize(sets.select("print", "rare").mapInArrow(lead, "token long, print long"))
    pivot = rows.groupBy("token").agg(F.min("print").alias("region"), F.count("*").alias("c")).where("c > 1")
    regions = materialize(rows.join(pivot, "token").select("region", "print").distinct())
    tasks = materialize(joined_tasks(regions, sets, percent, block))
    # the same set may come to a task twice only as both sides of one block
    of = tasks.groupBy("print").agg(F.collect_set("task").alias("tasks"))
    work = tasks.distinct().join(of, "print").join(sets.select("print", "n", "copies", "shared"), "print")
    return materialize(work.groupBy("task").applyInArrow(lambda t: _linked(t, percent), "a long, b long, links long"))


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, unit: int = UNIT, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every document.

    Documents with equal sets are linked; an empty set (null, empty or blank
    text) is linked with nothing, its component is itself.  component_id is
    the smallest doc_id reachable by links, n_links the number of documents
    linked directly.  Rows that share a doc_id are documents of their own; an
    empty table gives an empty result; columns other than doc_id and text are
    ignored.
    """
    described = document_sets(docs, percent, unit, bucket)
    found = jaccard_links(described, percent, block)
    joined = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("print")).agg(F.sum("links").alias("far"))
    m = described.select("doc_id", F.col("n").alias("n_shingles"), "print")
    m = m.join(joined.withColumnRenamed("node", "print"), "print", "left").withColumn("class", F.coalesce("component", "print"))
    least = m.where("print is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    same = m.where("print is not null").groupBy("print").agg((F.count("*") - 1).alias("near")).join(links, "print", "left")
    out = m.join(least, "class", "left").join(same, "print", "left")
    own = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (F.coalesce("near", F.lit(0)) + F.coalesce("far", F.lit(0))).alias("n_links"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` joined on word 5-grams at a similarity of 0.8."""
    return jaccard_classes(table(spark, sf_dir, "documents"))


@clearing
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component stays, the earliest of those with the smallest doc_id (no doc_id comes last)."""
    rows = numbered(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    classes = jaccard_classes(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    each = materialize(rows.select("_row", place.alias("place")).join(classes, "_row"))
    best = each.groupBy("component_id").agg(F.min("place").alias("best"), F.count("*").alias("n")).where("n > 1")
    gone = each.join(best, "component_id").where("_row <> best._row").select("_row")
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)
