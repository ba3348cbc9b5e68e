"""Document fingerprints by threshold-scaled sketches (operator 11).

A sketch keeps every shingle hash of its text below a fixed fraction of the
hash range, so long texts keep many hashes and short ones few, and sketches of
texts of any size can be merged and compared.  Where fewer than LEAST hashes
lie below it, the sketch raises its own threshold until it holds that many (or
all the text has).  Two sketches are compared below the smaller of their
thresholds, where both are complete, so shares of hashes there estimate shares
of shingles.

A sketch is written as its threshold and its hashes in ascending order, 32 bits
each: as bytes between stages, in hexadecimal in the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fretelens.llm.common import materialize, partitions_for, shingles, table, text_steps

#: Share of the hash range that is kept, hashes kept at least, and words of a shingle.
FRACTION, LEAST, WIDTH = 1 / 8, 16, 5
#: Hashes count as numbers of this many bits.
BITS = 32
_TOP = (1 << BITS) - 1
#: Bytes of text that one sorted slice holds, on average, at most.
SLICE = 64 << 20

Sketch = tuple[int, np.ndarray]


def sketch_of(hashes: np.ndarray, fraction: float = FRACTION, least: int = LEAST) -> Sketch:
    """(threshold, kept hashes) of a sorted set of 64-bit hashes."""
    h = np.unique(hashes >> np.uint64(64 - BITS))
    limit = int(fraction * (_TOP + 1)) - 1
    n = int(np.searchsorted(h, np.uint64(limit), side="right"))
    if n >= least:
        return limit, h[:n]
    return (int(h[least - 1]), h[:least]) if len(h) > least else (_TOP, h)


def sketches(texts: pa.Array) -> Iterator[Sketch]:
    """Sketches of the texts of a column."""
    for _, _, data, offsets in text_steps(texts):
        for h in shingles(data, offsets, WIDTH):
            yield sketch_of(h)


def written_form(s: Sketch) -> bytes:
    return np.concatenate([[np.uint64(s[0])], s[1]]).astype(">u4").tobytes()


def read_form(hexadecimal: str) -> Sketch:
    n = np.frombuffer(bytes.fromhex(hexadecimal), dtype=">u4").astype(np.uint64)
    return int(n[0]), n[1:]


def merged(a: Sketch, b: Sketch) -> Sketch:
    """Sketch of both texts' shingles together."""
    limit = min(a[0], b[0])
    h = np.union1d(a[1], b[1])
    return limit, h[h <= np.uint64(limit)]


def _below(a: Sketch, b: Sketch) -> tuple[np.ndarray, np.ndarray, int]:
    limit = np.uint64(min(a[0], b[0]))
    x, y = a[1][: np.searchsorted(a[1], limit, side="right")], b[1][: np.searchsorted(b[1], limit, side="right")]
    return x, y, len(np.intersect1d(x, y, assume_unique=True))


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated share of the shingles of either text that both have; texts without any word are alike, and unlike all others."""
    x, y, both = _below(a, b)
    union = len(x) + len(y) - both
    return both / union if union else float(not len(a[1]) and not len(b[1]))


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of the shingles of the first text that the second has too (1 for a text without words)."""
    x, _, both = _below(a, b)
    return both / len(x) if len(x) else float(not len(a[1]))


def edited(text: str, donor: str) -> str:
    """``text`` with the last quarter of its code points (rounded down) replaced by the donor's first as many."""
    k = len(text) // 4
    return text[: len(text) - k] + donor[:k]


_OUT = pa.schema([("at", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()),
                  ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])


def _answers(pairs: list[tuple], edits: list[str]) -> list[dict]:
    """Result fields of (row, sketch, next sketch), with the edited texts."""
    out = []
    for (_, s, after), e, es in zip(pairs, edits, sketches(pa.array(edits, pa.string()))):
        out.append({"edited_sha256": hashlib.sha256(e.encode()).digest(), "fingerprint": written_form(s), "edited_fingerprint": written_form(es),
                    "near_edited": likeness(s, es), "near_next": likeness(s, after)})
    return out


def along(at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted slice with their answers from the next row.

    The last row waits for the first of the next slice: both carry their text.
    """
    def emit(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"at": at, "first": False, "last": False} | r for r in rows], schema=_OUT)

    waiting = None  # row, text and sketch of the last row so far
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        for a, z, data, offsets in text_steps(texts):
            now = texts.slice(a, z - a).to_pylist()
            kept = [sketch_of(h) for h in shingles(data, offsets, WIDTH)]
            rows = [{"doc_id": d, "n_chars": len(t)} for d, t in zip(ids.slice(a, z - a).to_pylist(), now)]
            if waiting is None:
                # a copy of the slice's first row, for the slice before it
                yield emit([rows[0] | {"first": True, "text": now[0]}])
            else:
                rows, now, kept = [waiting[0], *rows], [waiting[1], *now], [waiting[2], *kept]
            pairs = list(zip(rows, kept, kept[1:]))
            answers = _answers(pairs, [edited(t, n) for t, n in zip(now, now[1:])])
            if pairs:
                yield emit([r | x for (r, _, _), x in zip(pairs, answers)])
            waiting = rows[-1], now[-1], kept[-1]
    if waiting is not None:
        yield emit([waiting[0] | {"last": True, "text": waiting[1]}])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    Null texts are empty; a text without words has an empty sketch, alike only
    to other empty ones; the documents follow each other by doc_id, null ids
    last, rows that share an id by a hash of their text; after the last comes
    the first, and a lone document is its own next; an empty table gives an
    empty result; columns other than doc_id and text are ignored.  Documents
    are dealt into sorted slices; the driver sees the numbers of the slices.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    order = [F.asc_nulls_last("doc_id"), F.asc("_h")]
    # equal ids with equal texts are one key to the range shuffle, but any of them may be dealt anywhere
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(partitions_for(docs), -(-size // SLICE))
    dealt = d.repartitionByRange(slices, *order, F.monotonically_increasing_id()).sortWithinPartitions(*order).select("doc_id", "text")
    names = [f.name for f in _OUT]
    types = "at int, first boolean, last boolean, doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text string"
    rows = materialize(dealt.mapInArrow(lambda batches: along(TaskContext.get().partitionId(), batches), types))
    ends = rows.where("last").select("at", "doc_id", "n_chars", "text")
    # one number a slice
    used = sorted(r["at"] for r in ends.select("at").collect())
    following = spark.createDataFrame(list(zip(used, used[1:] + used[:1])), "at int, then int")
    heads = rows.where("first").select(F.col("at").alias("then"), F.col("text").alias("donor"))
    met = ends.join(F.broadcast(following), "at").join(heads, "then").select("at", "doc_id", "n_chars", "text", "donor")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                s, after = sketches(pa.array([r["text"], r["donor"]], pa.string()))
                row = {"at": r["at"], "first": False, "last": False, "doc_id": r["doc_id"], "n_chars": r["n_chars"]}
                yield pa.RecordBatch.from_pylist([row | _answers([(row, s, after)], [edited(r["text"], r["donor"])])[0]], schema=_OUT)

    done = rows.where("not first and not last").unionByName(met.mapInArrow(finish, types))
    hexed = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return done.select(F.col("doc_id").cast(kind).alias("doc_id"), *(hexed.get(c, F.col(c)).alias(c) for c in names[4:-1]))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts of `documents`, of their edited texts, and how alike they and the next ones' are."""
    return fingerprints(table(spark, sf_dir, "documents"))
