"""Removal of repeated 100-byte strings by prefix-free parsing (operator 9).

A rolling hash picks triggers: of every 100-byte string, the 32-byte gram with
the smallest hash (the leftmost of equals).  What picks it lies inside the
string, so equal strings have equal triggers at equal offsets.  The starts
that share a trigger, with the bytes their strings span, are one phrase of the
parse.

A suffix matters only up to its first 100 bytes, and in suffix order equal
strings stand together with the earliest first.  Those groups are found in
two steps.  Dictionary: equal phrases (trigger and all bytes) hold the same
suffixes, so of each phrase only its earliest occurrence goes on; all others
are covered.  Inside phrases: a first occurrence whose trigger also begins
other phrases has its suffixes compared one by one; all other suffixes are
the only ones of their kind.

Texts are dealt into units of bounded size that send the first occurrences
they hold to hash-range buckets and get back which of them came earlier
elsewhere; nothing is gathered per phrase, on the driver or in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fretelens.llm.common import _MULT, Rolling, materialize, mix, table, text_steps

LENGTH, GRAM = 100, 32
#: Bytes of text of a unit and of a bucket.
UNIT, BUCKET = 2 << 20, 4 << 20
_PHRASE, _SUFFIX = 1, 2
_LAST_ID = np.iinfo(np.int64).max


def parse(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(trigger, first start, last start, trigger hash, phrase hash, rolling hash) of the phrases of a buffer of texts."""
    n, width = len(data), length - gram + 1
    if n < length:
        return (*[np.zeros(0, np.int64)] * 3, *[np.zeros(0, np.uint64)] * 2, None)
    roll = Rolling(data)
    at = np.arange(n - gram + 1)
    h = roll(at, at + gram)
    bits = np.uint64(int(n).bit_length())
    low = ((h >> bits) << bits) | at.astype(np.uint64)
    have = 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    trigger = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(trigger)]
    whole = np.arange(len(trigger)) + length <= end  # strings never cross texts
    change = trigger[1:] != trigger[:-1]
    new, last = whole.copy(), whole.copy()
    new[1:] &= ~whole[:-1] | change
    last[:-1] &= ~whole[1:] | change
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    trigger = trigger[lo]
    phrase = mix((roll(lo, hi + length) ^ ((trigger - lo).astype(np.uint64) * _MULT)) + h[trigger])
    return trigger, lo, hi, h[trigger], phrase, roll


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers by byte planes: the high bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(raw: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


class Unit:
    """The texts of a unit in the order of doc_id, parsed."""

    def __init__(self, t: pa.Table):
        ids = t.column("doc_id").fill_null(_LAST_ID)
        order = pa.compute.sort_indices(pa.table({"i": ids, "h": t.column("h")}), [("i", "ascending"), ("h", "ascending")])
        self.table = t.take(order)
        ids = ids.take(order).to_numpy()
        steps = list(text_steps(self.table.column("text")))
        sizes = np.concatenate([np.diff(o) for _, _, _, o in steps]) if steps else np.zeros(0, np.int64)
        self.sizes = sizes
        self.start = np.cumsum(sizes) - sizes  # of each text in the unit
        # texts that share an id follow each other by a hash; rows of one id and hash are equal and in this unit, one after the other
        h = self.table.column("h").to_numpy()
        again = np.concatenate([[False], (ids[1:] == ids[:-1]) & (h[1:] == h[:-1])])
        along = np.cumsum(sizes + 1) - (sizes + 1)
        base = (h << 40) + along - np.maximum.accumulate(np.where(again, 0, along))
        self.data, found, self.rolls, total = [], [], [], 0
        for a, z, data, offsets in steps:
            trigger, lo, hi, h, phrase, roll = parse(data, offsets)
            row = a + np.searchsorted(offsets, lo, side="right") - 1
            found.append((trigger + total, lo + total, hi + total, h, phrase, row, np.full(len(lo), len(self.rolls))))
            self.data.append(data), self.rolls.append((roll, total))
            total += len(data)
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 7
        self.trigger, self.lo, self.hi, self.h, self.phrase, row, self.step = cols
        self.h, self.phrase = self.h.astype(np.uint64), self.phrase.astype(np.uint64)
        self.total, self.doc = total, ids[row] if len(row) else row
        self.place = base[row] - self.start[row] if len(row) else row  # add to a place in the unit: a place in the document
        _, first = np.unique(self.phrase, return_index=True)
        self.first = first[np.argsort(self.h[first], kind="stable")]  # first occurrences, in order of their buckets

    def phrases(self) -> dict[str, np.ndarray]:
        f = self.first
        return {"h": self.h[f], "key": self.phrase[f], "doc": self.doc[f], "at": self.trigger[f] + self.place[f]}

    def suffixes(self, flags: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Strings to compare one by one (each the earliest here), and starts whose string came earlier here."""
        f = np.sort(self.first[flags == 2])
        if not len(f):
            none = np.zeros(0, np.int64)
            return {"h": none.astype(np.uint64), "key": none.astype(np.uint64), "doc": none, "at": none, "start": none}, none
        n = self.hi[f] - self.lo[f] + 1
        of = np.repeat(f, n)
        start = self.lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        key = np.empty(len(of), dtype=np.uint64)
        for s, (roll, base) in enumerate(self.rolls):
            mine = self.step[of] == s
            if mine.any():
                key[mine] = roll(start[mine] - base, start[mine] - base + LENGTH)
        _, first = np.unique(key, return_index=True)  # np.unique gives the first, and starts rise
        later = np.ones(len(of), dtype=bool)
        later[first] = False
        return {"h": key[first], "key": key[first], "doc": self.doc[of[first]], "at": start[first] + self.place[of[first]], "start": start[first]}, start[later]


def _buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))


_REQUEST = "unit long, bucket long, h binary, key binary, doc binary, at binary"
_ANSWER = "unit long, round int, bucket long, flags binary"


def requests(unit: int, rows: dict[str, np.ndarray], buckets: int) -> pa.Table:
    """One row for each bucket, rows in order of ``h``; the key is left out where it is ``h``."""
    cut = _buckets(rows["h"], buckets)
    spans = [(i, a, z) for i, (a, z) in enumerate(zip(cut[:-1], cut[1:])) if z > a]
    same = rows["h"] is rows["key"] or np.array_equal(rows["h"], rows["key"])
    out = {"unit": pa.array([unit] * len(spans), pa.int64()), "bucket": pa.array([s[0] for s in spans], pa.int64())}
    for c in ("h", "key", "doc", "at"):
        out[c] = pa.array([b"" if same and c == "key" else planes(rows[c][a:z]) for _, a, z in spans], pa.binary())
    return pa.table(out)


def judge(round_: int) -> Callable[[pa.Table], pa.Table]:
    """For every row asked: 1 if its key came earlier, 2 if it is the first of its key but the trigger has other keys, else 0."""
    def run(t: pa.Table) -> pa.Table:
        raw = {c: t.column(c).to_pylist() for c in ("h", "key", "doc", "at")}
        h = [unplanes(x, np.uint64) for x in raw["h"]]
        sizes = [len(x) for x in h]
        key = np.concatenate([unplanes(k, np.uint64) if k else x for k, x in zip(raw["key"], h)])
        h, doc, at = np.concatenate(h), np.concatenate([unplanes(x) for x in raw["doc"]]), np.concatenate([unplanes(x) for x in raw["at"]])
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        flags = np.zeros(len(key), dtype=np.uint8)
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        many = np.flatnonzero(size[group] > 1)  # only keys that repeat need the order of places
        if len(many):
            o = order[many]
            o = o[np.lexsort((at[o], doc[o], group[many]))]
            g = key[o]
            flags[o[np.concatenate([[False], g[1:] == g[:-1]])]] = 1
        if round_ == _PHRASE:
            left = np.flatnonzero(flags == 0)
            left = left[np.argsort(h[left], kind="stable")]
            s = h[left]
            near = np.zeros(len(s), dtype=bool)
            near[1:] = s[1:] == s[:-1]
            near[:-1] |= s[1:] == s[:-1]
            flags[left[near]] = 2
        cut = np.cumsum([0, *sizes])
        n = len(sizes)
        return pa.table({"unit": t.column("unit"), "round": pa.array([round_] * n, pa.int32()), "bucket": t.column("bucket"),
                         "flags": pa.array([flags[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary())})
    return run


def _flags(answers: pa.Table, round_: int) -> np.ndarray:
    mine = answers.filter(pa.compute.equal(answers.column("round"), round_)).sort_by("bucket")
    return np.frombuffer(b"".join(mine.column("flags").to_pylist()), dtype=np.uint8)


def _finish(unit: Unit, answers: pa.Table) -> pa.Table:
    flags = _flags(answers, _PHRASE)
    rows, here = unit.suffixes(flags)
    there = _flags(answers, _SUFFIX)
    if len(flags) != len(unit.first) or len(there) != len(rows["h"]):
        raise RuntimeError("a unit's answers don't fit its texts")
    covered = np.ones(len(unit.lo), dtype=bool)  # phrases that came earlier, here or elsewhere
    covered[unit.first[flags != 1]] = False
    starts = np.concatenate([here, rows["start"][there == 1]])
    begin = np.concatenate([unit.lo[covered], starts])
    end = np.concatenate([unit.hi[covered], starts]) + LENGTH
    n = unit.total
    depth = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    gone = np.cumsum(depth[:n]) > 0
    data = np.concatenate(unit.data) if unit.data else np.zeros(0, np.uint8)
    kept = data[~gone]
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    heads = unit.start[unit.sizes > 0]
    edge[heads] = gone[heads]  # a run ends with its text
    bound = np.concatenate([unit.start, [n]])
    upto = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[bound])
    removed, spans = upto(gone), upto(edge)
    keep_at = np.concatenate([[0], np.cumsum(unit.sizes - removed)])
    raw = kept.tobytes()
    sha = [hashlib.sha256(raw[a:z]).hexdigest() for a, z in zip(keep_at[:-1], keep_at[1:])]
    at = np.flatnonzero(edge)
    owner = np.searchsorted(bound, at, side="right") - 1
    stop = np.flatnonzero(gone & np.concatenate([~gone[1:] | np.isin(np.arange(1, n), heads), [True]])) + 1 if n else at
    lists = [[] for _ in range(len(unit.sizes))]
    for r, a, z in zip(owner, at, stop):
        lists[r].append({"start": int(a - unit.start[r]), "end": int(z - unit.start[r])})
    return pa.table({"doc_id": unit.table.column("doc_id"), "n_bytes": pa.array(unit.sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
                     "kept_sha256": pa.array(sha, pa.string()), "spans": pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})


def repeated_spans(docs: DataFrame, unit: int = UNIT, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte offsets) of every text.

    Null and empty texts have no bytes.  Rows that share a doc_id are taken
    in the order of a hash of their texts, rows without one come last; an empty table
    gives an empty result; columns other than doc_id and text are ignored.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    units, buckets = max(1, -(-size // unit)), max(1, -(-size // bucket))
    # ids that many rows share, null ones too, are dealt over all units; 23 bits of the hash order their texts
    d = d.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 41)).withColumn("unit", F.pmod(F.xxhash64("doc_id", "h"), F.lit(units)))

    def ask_phrases(t: pa.Table) -> pa.Table:
        return requests(t.column("unit")[0].as_py(), Unit(t).phrases(), buckets)

    def ask_suffixes(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.schema([(c, pa.int64() if c in ("unit", "bucket") else pa.binary()) for c in ("unit", "bucket", "h", "key", "doc", "at")]).empty_table()
        u = Unit(left)
        return requests(left.column("unit")[0].as_py(), u.suffixes(_flags(right, _PHRASE))[0], buckets)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        return _finish(Unit(left), right) if left.num_rows else _NOTHING.empty_table()

    by_unit = lambda x: x.toDF("at_unit", "round", "bucket", "flags").groupBy("at_unit")
    phrases = materialize(d.groupBy("unit").applyInArrow(ask_phrases, _REQUEST).groupBy("bucket").applyInArrow(judge(_PHRASE), _ANSWER))
    asked = d.groupBy("unit").cogroup(by_unit(phrases)).applyInArrow(ask_suffixes, _REQUEST)
    suffixes = materialize(asked.groupBy("bucket").applyInArrow(judge(_SUFFIX), _ANSWER))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return d.groupBy("unit").cogroup(by_unit(phrases.unionByName(suffixes))).applyInArrow(
        finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


_NOTHING = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                      ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings removed from all `documents`."""
    return repeated_spans(table(spark, sf_dir, "documents"))
