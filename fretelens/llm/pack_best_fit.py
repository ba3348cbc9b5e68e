"""Best-fit packing under several capacities (operator 8).

Documents become token ids and pieces of at most one sequence.  Only (piece,
length) rows move: they are dealt by hash into groups of bounded size, and
each group is packed by vector best-fit decreasing.  A sequence has room for
tokens, documents and attention cost (sum of squared lengths); of the
sequences that can take a piece under every one of them, the one with the
smallest weighted norm of what remains is taken (or the largest weighted dot
product of what remains and what the piece needs).
"""

from __future__ import annotations

import base64
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fretelens.llm.common import clearing, materialize, Rolling, table, text_steps

SEQUENCE = 2048
#: Pieces of a packing group; distinct words whose ids a worker keeps.
GROUP, KEPT_WORDS = 10_000, 1_500_000
#: Weights of the residual tokens, documents and attention cost (each as a share of its capacity).
RESIDUALS = (1.0, 0.001, 0.001)

# Byte classes of texts that need only ASCII and the letters U+00C0..U+00FF.
_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[0x20, *range(9, 14)]] = _SPACE
# Bytes that send a text to the tokenizer as a whole: control characters, the
# apostrophe (contractions), the bar (special tokens) and other scripts.
_HARD = np.zeros(256, dtype=bool)
_HARD[[*range(0, 9), *range(14, 32), 0x27, 0x7C, 0x7F, *range(0xC0, 0xC3), *range(0xC4, 256)]] = True


class Words:
    """Ids of the words a worker has met, found by hash; asked in bulk."""

    def __init__(self, path: str, ranks: str):
        import tiktoken
        from tokenizers import Tokenizer

        special = {t.content: i for i, t in Tokenizer.from_file(path).get_added_tokens_decoder().items() if t.special}
        pairs = (line.split() for line in open(ranks, "rb"))
        coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens=special)
        self.word, self.whole = coder.encode_ordinary, lambda text: coder.encode(text, allowed_special="all")
        self.hash, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def places(self, hashes: np.ndarray, text_of) -> np.ndarray:
        """Index of every hash; unknown ones are encoded from ``text_of(i)``."""
        i = np.minimum(np.searchsorted(self.hash, hashes), max(0, len(self.hash) - 1))
        new = np.flatnonzero(self.hash[i] != hashes) if len(self.hash) else np.arange(len(hashes))
        if len(new):
            if len(self.hash) > KEPT_WORDS:
                self.hash, self.at, self.n, self.ids = self.hash[:0], self.at[:0], self.n[:0], self.ids[:0]
                return self.places(hashes, text_of)
            got = [self.word(text_of(j)) for j in new]
            n = np.array([len(g) for g in got], dtype=np.int64)
            at = len(self.ids) + np.cumsum(n) - n
            self.ids = np.concatenate([self.ids, np.array([x for g in got for x in g], dtype=np.uint32)])
            h = np.concatenate([self.hash, hashes[new]])
            o = np.argsort(h, kind="stable")
            self.hash, self.at, self.n = h[o], np.concatenate([self.at, at])[o], np.concatenate([self.n, n])[o]
            i = np.searchsorted(self.hash, hashes)
        return i


def worker_words(path: str, ranks: str) -> Words:
    """One ``Words`` for all tasks of a Python worker."""
    home = sys.modules.setdefault("fretelens_worker_words", types.ModuleType("fretelens_worker_words"))
    if not hasattr(home, "of"):
        home.of = {}
    if path not in home.of:
        home.of[path] = Words(path, ranks)
    return home.of[path]


def token_ids(data: np.ndarray, offsets: np.ndarray, known: Words) -> list[np.ndarray]:
    """The ids of every text of a buffer, as the tokenizer gives them.

    Texts are cut where the tokenizer's own pre-tokeniser cuts (one leading
    space goes with the run of letters, digits or other signs that follows it,
    the last white space of a longer run stands alone), so a word's ids can be
    looked up; texts outside that simple alphabet go to the tokenizer whole.
    """
    n = len(offsets) - 1
    out: list = [None] * n
    bad = _HARD[data]
    if len(data) > 1:
        bad[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    hard = np.zeros(n, dtype=bool)
    hard[np.searchsorted(offsets, np.flatnonzero(bad), side="right") - 1] = True
    if len(data):
        kind = _CLASS[data]
        head = np.zeros(len(data) + 1, dtype=bool)
        head[offsets] = True
        before = np.empty_like(kind)
        before[0], before[1:] = 9, kind[:-1]
        before[head[:-1]] = 9
        glued = np.zeros(len(data), dtype=bool)
        glued[1:] = data[:-1] == 0x20
        after = np.empty_like(kind)
        after[-1], after[:-1] = _SPACE, kind[1:]
        after[head[1:]] = _SPACE
        space = kind == _SPACE
        start = np.where(space, (before != _SPACE) | (after != _SPACE), (before != kind) & ~glued) | head[:-1]
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))
        h, first, back = np.unique(Rolling(data)(starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        owner = np.searchsorted(offsets, starts[first], side="right") - 1
        easy = ~hard[owner]  # words of hard texts only are not asked for
        slot = np.zeros(len(h), dtype=np.int64)
        slot[easy] = known.places(h[easy], lambda j, f=first[easy]: raw[starts[f[j]] : ends[f[j]]].decode("utf-8"))
        # a word first met in a hard text may stand in an easy one as well
        seen_easy = np.zeros(len(h), dtype=bool)
        token_owner = np.searchsorted(offsets, starts, side="right") - 1
        soft = ~hard[token_owner]
        seen_easy[back[soft]] = True
        late = np.flatnonzero(seen_easy & ~easy)
        if len(late) or len(known.hash) == 0:
            spot = np.zeros(len(h), dtype=np.int64)
            spot[back[soft]] = np.flatnonzero(soft)
            known.places(h[late], lambda j: raw[starts[spot[late[j]]] : ends[spot[late[j]]]].decode("utf-8"))
            slot = np.minimum(np.searchsorted(known.hash, h), max(0, len(known.hash) - 1))
        where = slot[back]
        count = np.where(soft, known.n[where] if len(known.n) else 0, 0)
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = known.ids[np.repeat((known.at[where] if len(known.at) else 0) - upto[:-1], count) + np.arange(upto[-1])] if upto[-1] else np.zeros(0, np.uint32)
        cut = upto[np.searchsorted(starts, offsets)]
    for i in range(n):
        if hard[i]:
            out[i] = np.array(known.whole(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")), dtype=np.uint32)
        else:
            out[i] = ids[cut[i] : cut[i + 1]] if len(data) else np.zeros(0, np.uint32)
    return out


def pieces(docs: DataFrame, path: str, ranks: str, size: int = SEQUENCE, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): texts as ids plus an end id, cut into pieces of ``size`` (the first may be shorter)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_words(path, ranks)
        end = np.array([end_id], dtype=np.uint32)
        for b in batches:
            doc_id = b.column("doc_id")
            for a, _, data, offsets in text_steps(b.column("text")):
                row, piece, start, length, crc, raw = [], [], [], [], [], []
                for i, ids in enumerate(token_ids(data, offsets, known)):
                    ids = np.concatenate([ids, end])
                    total, at, p = len(ids), 0, 0
                    upto = (total - 1) % size + 1
                    while at < total:
                        part = ids[at:upto].astype("<u4").tobytes()
                        row.append(a + i), piece.append(p), start.append(at), length.append(upto - at), crc.append(zlib.crc32(part))
                        if with_ids:
                            raw.append(part)
                        at, upto, p = upto, upto + size, p + 1
                cols = [doc_id.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(raw, pa.binary())] if with_ids else []), names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def vector_best_fit(lengths: np.ndarray, size: int = SEQUENCE, max_docs: int | None = None, max_cost: int | None = None,
                    weights: tuple = RESIDUALS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece, longest first; by default only the tokens can run out."""
    room = np.array([size, max_docs or size, max_cost or size * size], dtype=np.float64)
    w = np.asarray(weights) / room**2
    left = np.empty((3, 256))
    name = np.empty(256, dtype=np.int64)
    live = bins = 0
    least = float(lengths.min()) if len(lengths) else 0.0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        a = float(lengths[i])
        need = (a, 1.0, a * a)
        tokens, docs, cost = left[:, :live]
        fits = np.flatnonzero((tokens >= a) & (docs >= 1) & (cost >= need[2]))
        if len(fits):
            score = 0.0
            for have, n, x in zip((tokens, docs, cost), need, w):
                score = score + (x * (have[fits] - n) ** 2 if rule == "norm" else -x * n * have[fits])
            at = int(fits[np.argmin(score)])
        else:
            if live == len(name):
                left, name = np.hstack([left, np.empty_like(left)]), np.concatenate([name, np.empty_like(name)])
            at, left[:, live], name[live] = live, room, bins
            live, bins = live + 1, bins + 1
        where[i], offset[i] = name[at], size - left[0, at]
        left[:, at] -= need
        if left[0, at] < least or left[1, at] < 1 or left[2, at] < least * least:  # nothing fits any more
            live -= 1
            left[:, at], name[at] = left[:, live], name[live]
    return where, offset


def pack(docs: DataFrame, path: str | None = None, ranks: str | None = None, size: int = SEQUENCE, max_docs: int | None = None, max_cost: int | None = None,
         weights: tuple = RESIDUALS, rule: str = "norm", group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """Pieces of ``pieces`` with sequence_id and offset.

    ``path`` is the tokenizer's file, ``ranks`` the same vocabulary as ranks:
    texts are encoded by those, with the same ids, many times faster.

    Null and empty texts are one end id; repeated rows are packed each; an
    empty table gives an empty result; columns other than doc_id and text are
    ignored.  A piece costs at most size**2, so ``max_cost`` below that is
    refused.
    """
    if max_cost is not None and max_cost < size * size:
        raise ValueError("max_cost must hold one full piece")
    path, ranks = path or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    cut = materialize(pieces(docs, path, ranks, size, with_ids=with_ids))
    groups = max(1, -(-cut.count() // group))
    cut = cut.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(groups)))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        where, offset = vector_best_fit(g["length"].to_numpy(), size, max_docs, max_cost, weights, rule)
        return g.assign(sequence_id=(int(g["grp"].iloc[0]) << 32) + where, offset=offset).drop(columns="grp")

    names = cut.columns[:-1]
    kinds = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in names)
    return cut.groupBy("grp").applyInPandas(run, kinds + ", sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` packed into sequences of at most 2,048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


@clearing
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents as packed pieces, with their ids."""
    return pack(docs, with_ids=True)
