"""Importance resampling towards a target distribution (operator 13).

Texts of a batch are joined with separator sentinels; one regex pass finds the
words of all of them, a search of the document offsets tells where a run of
words leaves its document, and what is left is hashed and counted by bucket.
The counts of documents and target give every bucket a gain; a document's
weight is the mean gain of its features, and the highest weights plus Gumbel
noise are drawn.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fretelens.llm.common import materialize, table, text_steps, with_position

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7
#: Words of lower-cased UTF-8; what separates texts is no word byte.
_WORDS, _SENTINEL = re.compile(rb"[0-9a-z\x80-\xff]+"), 0x0A
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words longer than this are hashed one by one.
_LONG = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def _crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Raw crc32 states after the bytes starts..ends; all words step byte by byte together."""
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, _LONG + 1).astype(np.int8), kind="stable")
    s, at, n = state[order], starts[order], sizes[order]
    longer = int((n > _LONG).sum())
    for i in range(longer):
        word = data[at[i] : at[i] + n[i]].tobytes()
        s[i] = zlib.crc32(word, int(s[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    live = np.searchsorted(-n[longer:], -np.arange(_LONG), side="left") + longer  # words of more than j bytes
    for j in range(_LONG):
        z = int(live[j])
        if z == longer:
            break
        part = s[longer:z]
        s[longer:z] = _CRC[(part ^ data[at[longer:z] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty_like(s)
    out[order] = s
    return out


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in one buffer: buckets of all one- and two-word features, the text each is of, and the words of every text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    joined = np.full(len(data) + n, _SENTINEL, dtype=np.uint8)
    joined[np.arange(len(data)) + np.repeat(np.arange(n), sizes) if n > 1 else slice(0, len(data))] = _LOWER[data]
    spans = np.fromiter(chain.from_iterable(m.span() for m in _WORDS.finditer(joined.tobytes())), dtype=np.int64)
    starts, ends = spans[::2], spans[1::2]
    text = np.searchsorted(offsets[1:] + np.arange(1, n + 1), starts, side="right")
    one = _crc_on(np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32), joined, starts, ends)
    inside = np.flatnonzero(text[1:] == text[:-1])  # pairs that don't leave their text
    space = _CRC[(one[inside] ^ np.uint32(0x20)) & np.uint32(255)] ^ (one[inside] >> np.uint32(8))
    two = _crc_on(space, joined, starts[inside + 1], ends[inside + 1])
    crc = np.concatenate([one, two]) ^ np.uint32(0xFFFFFFFF)
    return (crc % np.uint32(buckets)).astype(np.int64), np.concatenate([text, text[inside]]), np.bincount(text, minlength=n)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; every task sends one row a bucket, the driver gets one a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, _, data, offsets in text_steps(b.column(0)):
                n += np.bincount(features(data, offsets, buckets)[0], minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of the smoothed shares of every bucket, rounded down."""
    k, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(b + 1) * float(s + k)) / (float(a + 1) * float(t + k)))) for a, b in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (the mean gain, rounded down; 0 without features) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, offsets in text_steps(b.column(1)):
                bucket, text, words = features(data, offsets, len(gain))
                n = np.bincount(text, minlength=z - a)
                # sums stay whole numbers: far below 2**53
                total = np.bincount(text, weights=gain[bucket], minlength=z - a).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                                                 names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every document.

    Null and empty texts have no feature, weight 0, and are never drawn; a null
    doc_id counts as the text "null" in the noise and comes last among ties;
    repeated rows are documents of their own, in any order; an empty target
    leaves the smoothed shares; an empty table gives an empty result; columns
    other than doc_id and text are ignored.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = materialize(weights(docs, gain).withColumns({"score": F.col("weight") + noise, "enough": F.col("n_words") >= least_words}))
    n = scored.where("enough").count()
    placed = with_position(scored, F.desc("enough"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight")
    drawn = F.col("enough") & (F.col("position") < percent * n // 100)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("position") + 1).alias("rank"))


def op13_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the longer `documents`, drawn towards `benchmark`."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
