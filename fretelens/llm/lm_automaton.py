"""Language-model scores by a weighted backoff automaton (operator 7).

The model is a smoothed n-gram model, of order 3 by default.  The automaton's
states are the root and the contexts seen in training (one word, two words).
A state has an arc for every word seen after it, which leads to the longest
context that ends with that word, and a failure arc to its context without
the first word (at last the root), which costs mu / (c + mu), c the state's
count, and is followed as long as no arc fits.  A text is scored in one pass
from left to right that carries the state and adds log-probabilities.

The automaton grows with the corpus and is never sent whole.  Texts are dealt
into units of bounded size.  A unit sends the distinct n-grams it holds, with
their training counts, to the buckets of a range-partitioned count; the
buckets send the corpus counts back, and from them every unit builds the part
of the automaton that its own texts can walk.  Keys travel as compressed
differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fretelens.llm.common import _MULT, materialize, mix, table, text_steps, words
from fretelens.llm.lang_kernel import held_out

#: Weight of the shorter context under a context of one word, of two words, and so on: the order is one more.
MUS = (500.0, 50.0)
#: Bytes of text of a unit and of a count bucket; tokens of a text that are walked at once.
UNIT, BUCKET, SEGMENT = 8 << 20, 8 << 20, 1024
_END = np.uint64(0x5BD1E995A4B3C2D1)
_WORD = 1


def token_stream(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each followed by the end token, and the number of tokens of each text."""
    parts, sizes = [], []
    for a, z, data, offsets in text_steps(column):
        w, _, _, first = words(data, offsets)
        t = np.full(len(w) + z - a, _END, dtype=np.uint64)
        n = np.diff(first)
        t[np.arange(len(w)) + np.repeat(np.arange(z - a), n)] = w
        parts.append(t), sizes.append(n + 1)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(sizes)


def _places(sizes: np.ndarray) -> np.ndarray:
    """Place of every token in its text."""
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(first, sizes)


def key_bits(size: int) -> int:
    """Bits of the keys of n-grams in a corpus of ``size`` bytes: fewer than one key in 2**20 meets another n-gram's."""
    return min(63, max(32, size.bit_length() + 20))


def grams(tokens: np.ndarray, place: np.ndarray, order: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, where, key) for n = 1..order: the n-grams that end at the tokens ``where``.

    A text begins in the context of one end token, so an n-gram reaches back to
    that at most.  Keys have 63 bits for words and ``bits`` for longer n-grams.
    """
    yield _WORD, np.arange(len(tokens)), tokens >> np.uint64(1)
    rolled, before = tokens, _END
    for n in range(2, order + 1):
        rolled = mix(np.concatenate([[before], rolled[:-1]]).astype(np.uint64) * _MULT + tokens) if len(tokens) else tokens
        before = np.uint64(0)  # no n-gram of three tokens ends at the first one
        where = np.flatnonzero(place >= n - 2)
        yield n, where, rolled[where] >> np.uint64(64 - bits)


def bucket_of(key: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """A bucket takes a range of keys, so that buckets in order give keys in order."""
    top = key >> np.uint64(bits - 32)
    return (top * np.uint64(buckets)) >> np.uint64(32)


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of their bytes, behind their number."""
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(x).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueeze(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    planes = pa.decompress(raw[4:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(8, n).T).view("<u8").reshape(-1)


def pack(key: np.ndarray) -> bytes:
    """Rising keys as their differences."""
    return squeeze(np.diff(key, prepend=np.uint64(0)))


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(raw), dtype=np.uint64)


def count_requests(batches: Iterator[pa.RecordBatch], buckets: int, order: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Of (unit, train, text): the distinct keys of every unit with training counts, by bucket."""
    held: dict[tuple[int, int], list] = {}
    for b in batches:
        tokens, sizes = token_stream(b.column("text"))
        if not len(sizes):
            continue
        train = b.column("train").to_numpy(zero_copy_only=False)
        flag = np.repeat(train, sizes).astype(np.uint64)
        of = np.repeat(b.column("unit").to_numpy(), sizes)
        for n, where, key in grams(tokens, _places(sizes), order, bits):
            marked = (key << np.uint64(1)) | flag[where]
            unit = of[where]
            for u in np.unique(unit):
                held.setdefault((int(u), n), []).append(marked[unit == u])
    for u, n in sorted(held):
        marked = np.concatenate(held.pop((u, n)))
        marked.sort()
        key = marked >> np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.add.reduceat((marked & np.uint64(1)).astype(np.int64), first)
        key = key[first]
        cut = np.searchsorted(bucket_of(key, 63 if n == _WORD else bits, buckets), np.arange(buckets + 1))
        rows = [(u, n, i, pack(key[a:z]), squeeze(counts[a:z])) for i, (a, z) in enumerate(zip(cut[:-1], cut[1:])) if z > a]
        yield pa.RecordBatch.from_pylist([dict(zip(("unit", "kind", "bucket", "keys", "counts"), r)) for r in rows], schema=_REQUEST)


_REQUEST = pa.schema([("unit", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("unit", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("counts", pa.binary()), ("distinct", pa.int64()), ("total", pa.int64())])


def count_bucket(t: pa.Table) -> pa.Table:
    """Corpus counts of one bucket, for every unit that asked, in the order it asked."""
    kind, bucket = t.column("kind")[0].as_py(), t.column("bucket")[0].as_py()
    got = [unpack(k.as_py()) for k in t.column("keys")]
    cut = np.cumsum([0, *map(len, got)])
    key = np.concatenate(got)
    got.clear()
    counts = np.concatenate([unsqueeze(c.as_py()) for c in t.column("counts")]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    total = np.add.reduceat(counts[order], np.flatnonzero(new))
    back = np.empty(len(key), dtype=np.int64)
    back[order] = total[np.cumsum(new) - 1]
    n = len(cut) - 1
    return pa.Table.from_pydict({
        "unit": t.column("unit"), "kind": [kind] * n, "bucket": [bucket] * n,
        "counts": [squeeze(back[a:z]) for a, z in zip(cut[:-1], cut[1:])],
        "distinct": [int((total > 0).sum())] + [0] * (n - 1), "total": [int(total.sum())] + [0] * (n - 1)}, schema=_ANSWER)


def _ranks(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Place of every key among the sorted distinct ones, and how many those are."""
    order = np.argsort(key)
    s = key[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, int(new.sum())


class Automaton:
    """The states and arcs that the texts of one unit can reach.

    ``seen`` gives for n = 1, 2, ... the corpus count of every distinct n-gram,
    its number at every token (-1 where none ends) and a token where it ends.
    States are the n-grams up to order - 1, those of one word first, then the
    root; an n-gram not seen in training has no arc leading to it.
    """

    def __init__(self, seen: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], start: int, n: int, v: int, mus: tuple):
        order = max(seen)
        counts, self.words = {k: g[0].astype(np.float64) for k, g in seen.items()}, len(seen[_WORD][0])
        base, self.root = {}, 0
        for k in range(1, order):
            base[k], self.root = self.root, self.root + len(counts[k])
        word = seen[_WORD][1]
        self.known = counts[_WORD] > 0
        self.by_root = np.log10((counts[_WORD] + 1) / (n + 1 * (v + 1)))  # arcs of the root, by word
        self.from_root = np.where(self.known, np.arange(self.words), self.root) if order > 1 else np.full(self.words, self.root)
        self.fail_to = np.full(self.root + 1, self.root)
        self.fail = np.zeros(self.root + 1)
        key, weight, to, shorter = [], [], [], 10.0**self.by_root
        for k in range(2, order + 1):
            at, mu = seen[k][2], mus[k - 2]
            before = seen[k - 1][1][at - 1].astype(np.int64)  # before the first token stands the last one, an end as well
            c = counts[k - 1]
            self.fail[base[k - 1] : base[k - 1] + len(c)] = np.log10(mu / (c + mu))
            if k > 2:
                self.fail_to[base[k - 1] : base[k - 1] + len(c)] = base[k - 2] + seen[k - 2][1][seen[k - 1][2]]
            p = (counts[k] + mu * shorter[seen[k - 1][1][at]]) / (c[before] + mu)
            real = counts[k] > 0
            last = min(k, order - 1)
            key.append(((base[k - 1] + before) * self.words + word[at])[real])
            weight.append(np.log10(p[real]))
            to.append((base[last] + seen[last][1][at])[real])
            shorter = p
        self.key, self.weight, self.to = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((key, np.int64), (weight, np.float64), (to, np.int32)))
        key.clear(), weight.clear(), to.clear()
        sort = np.argsort(self.key)
        self.key = self.key[sort]
        self.weight = self.weight[sort]
        self.to = self.to[sort]
        self.start = int(self.from_root[start])

    def step(self, states: np.ndarray, words_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the log10-probability of each word: its arc, after the failure arcs that lead to one."""
        to, score = np.empty(len(states), np.int64), np.zeros(len(states))
        left, at = np.arange(len(states)), states.astype(np.int64)
        while len(left):
            w = words_[left]
            rooted = at == self.root
            if rooted.any():
                done = left[rooted]
                to[done] = self.from_root[w[rooted]]
                score[done] += self.by_root[w[rooted]]
                left, at, w = left[~rooted], at[~rooted], w[~rooted]
            if not len(left):
                break
            wanted = at * self.words + w
            arc = np.searchsorted(self.key, wanted)
            fits = arc < len(self.key)
            fits[fits] = self.key[arc[fits]] == wanted[fits]
            done = left[fits]
            to[done] = self.to[arc[fits]]
            score[done] += self.weight[arc[fits]]
            left, at = left[~fits], at[~fits]
            score[left] += self.fail[at]
            at = self.fail_to[at]
        return to, score

    def walk(self, words_: np.ndarray, sizes: np.ndarray, order: int, segment: int = SEGMENT) -> np.ndarray:
        """Log10-probability of every text; all texts are walked side by side, token by token.

        A long text is cut into segments, which first read the order - 1 tokens
        before them from the root: those alone decide the state.
        """
        pieces = -(-sizes // segment)
        of = np.repeat(np.arange(len(sizes)), pieces)
        number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lead = np.where(number > 0, order - 1, 0)
        begin = (np.cumsum(sizes) - sizes)[of] + number * segment - lead
        length = np.minimum(segment, sizes[of] - number * segment) + lead
        by_length = np.argsort(-length, kind="stable")
        begin, length, lead = begin[by_length], length[by_length], lead[by_length]
        state = np.where(lead > 0, self.root, self.start)
        score = np.zeros(len(of))
        for t in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -t, side="left"))  # those longer than t
            state[:live], found = self.step(state[:live], words_[begin[:live] + t])
            score[:live] += np.where(lead[:live] <= t, found, 0.0)
        return np.bincount(of[by_length], weights=score, minlength=len(sizes))


def automaton_of(column, answers: pa.Table, n: int, v: int, mus: tuple, bits: int) -> tuple[Automaton, np.ndarray, np.ndarray]:
    """The automaton of a unit's texts, their words' numbers and the texts' sizes."""
    order = len(mus) + 1
    tokens, sizes = token_stream(column)
    kinds, buckets = answers.column("kind").to_numpy(), answers.column("bucket").to_numpy()
    held = {}
    for k, where, key in grams(tokens, _places(sizes), order, bits):
        rank, distinct = _ranks(key)
        mine = np.flatnonzero(kinds == k)
        mine = mine[np.argsort(buckets[mine])]
        got = [unsqueeze(answers.column("counts")[int(i)].as_py()) for i in mine]
        counts = np.concatenate(got).astype(np.int64) if got else np.zeros(0, np.int64)
        if len(counts) != distinct:
            raise RuntimeError("a unit's answers don't fit its texts")
        number, at = np.full(len(tokens), -1, dtype=np.int32), np.empty(distinct, dtype=np.int32)
        number[where], at[rank] = rank, where
        held[k] = counts, number, at
        del rank, where, key, got
    words_ = held[_WORD][1]
    return Automaton(held, int(words_[sizes[0] - 1]), n, v, mus), words_, sizes


def score_unit(docs: pa.Table, answers: pa.Table, n: int, v: int, mus: tuple, bits: int) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of every text of a unit."""
    auto, w, sizes = automaton_of(docs.column("text"), answers, n, v, mus, bits)
    first = np.cumsum(sizes) - sizes
    return {"n_tokens": sizes, "n_known": np.add.reduceat(auto.known[w].astype(np.int64), first),
            "base_score": np.add.reduceat(auto.by_root[w], first), "score": auto.walk(w, sizes, len(mus) + 1)}


def score_texts(docs: DataFrame, train: Column, mus: tuple = MUS, unit: int = UNIT, bucket: int = BUCKET) -> DataFrame:
    """doc_id, held_out (not trained on), n_tokens, n_known, train_tokens, base_score and score of every text.

    ``mus`` has a weight for every length of context; its length + 1 is the order.
    A null or empty text is one end token.  Repeated rows are counted and
    scored each; without training rows every word is unknown; an empty table
    gives an empty result; columns other than doc_id and text are ignored.
    """
    d = docs.select("doc_id", train.alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    size = (d.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0)
    units, buckets = max(1, -(-size // unit)), max(1, -(-size // bucket))
    bits = key_bits(int(size))
    d = d.withColumn("unit", F.pmod(F.xxhash64("doc_id", "text"), F.lit(units)))
    requests = d.select("unit", "train", "text").repartition(units, "unit").mapInArrow(
        lambda batches: count_requests(batches, buckets, len(mus) + 1, bits), "unit long, kind int, bucket long, keys binary, counts binary")
    # no unit spans two tasks, as the rows of a unit meet in one partition
    answers = materialize(requests.groupBy("kind", "bucket").applyInArrow(count_bucket, "unit long, kind int, bucket long, counts binary, distinct long, total long"))
    n, v = answers.where(F.col("kind") == _WORD).agg(F.sum("total"), F.sum("distinct")).first()
    n, v = n or 0, v or 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out.empty_table()
        s = score_unit(left, right, n, v, mus, bits)
        return pa.table({"doc_id": left.column("doc_id"), "held_out": pa.compute.invert(left.column("train")), "n_tokens": s["n_tokens"], "n_known": s["n_known"],
                         "train_tokens": pa.array(np.full(left.num_rows, n)), "base_score": s["base_score"], "score": s["score"]})

    return d.groupBy("unit").cogroup(answers.select(F.col("unit").alias("at_unit"), "kind", "bucket", "counts").groupBy("at_unit")).applyInArrow(
        score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of `documents`, scored by a model of six of seven folds."""
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, ~held_out(7))
