"""Language identification by string kernels (operator 6).

The kernel of two texts counts the character n-grams (n = 1..4, all lengths
blended) that both hold, over the root of the product of how many each holds.
Landmark texts span the Nystroem space; kernel ridge regression in it, one
language against the rest, gives a weight for every landmark.  Batches of
texts become n-gram presence matrices and are scored by matrix products: the
product of the landmarks' presence matrix with their weights is taken once, so
a batch needs one product with a narrow matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fretelens.llm.common import clearing, mix, table, text_steps

#: Longest n-gram, columns of the presence matrix, landmarks, ridge.
LONGEST, COLUMNS, LANDMARKS, RIDGE = 4, 1 << 15, 256, 1e-2
#: Texts of a language that training samples at most (chosen by a hash of the id).
PER_LANGUAGE = 300
#: Texts of one step, however short: a presence matrix has as many rows (32 MB).
ROWS = 256
UNKNOWN = "und"
#: The pipeline drops a text whose familiarity lies under this share of the RARE quantile of labelled texts of its
#: size and whose margin lies under that quantile of their margins.
SHARE, RARE = 0.9, 0.01
#: Characters of the beginnings of labelled texts that stand for shorter ones; classes of sizes (two a doubling);
#: texts of a class from which it has a quantile of its own.
BEGINNINGS, CLASSES, OWN = (8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096), 40, 20


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0/1 matrix of texts by hashed character n-grams; A-Z and U+00C0..U+00DE in lower case."""
    n = len(offsets) - 1
    x = np.zeros((n, COLUMNS), dtype=np.float32)
    if not len(data):
        return x
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # offsets in characters
    chars[((chars >= 65) & (chars <= 90)) | ((chars >= 0xC0) & (chars <= 0xDE) & (chars != 0xD7))] += np.uint64(32)
    row = np.repeat(np.arange(n) * COLUMNS, np.diff(at))
    end = np.repeat(at[1:], np.diff(at))
    flat, code = x.reshape(-1), np.zeros(len(chars), dtype=np.uint64)
    for k in range(1, LONGEST + 1):
        code = code[: len(chars) - k + 1] * np.uint64(0x100000001B3) + chars[k - 1 :]
        inside = np.arange(len(code)) + k <= end[: len(code)]
        flat[(row[: len(code)] + (mix(code + np.uint64(k)) >> np.uint64(49)).astype(np.int64))[inside]] = 1
    return x


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # columns x languages

    def score(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights) / np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None]


@dataclass
class Known:
    """What texts of the learned languages look like, by the labelled texts themselves."""

    common: np.ndarray  # columns x languages: the share of a language's texts that hold an n-gram
    floors: np.ndarray  # least familiarity of a text, by the class of its size
    margin: float  # from this margin between best and second language on, a text is known whatever it holds

    def holds(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        n, seen = familiarity(x, self.common)
        return (seen >= self.floors[n]) | (margins(s) >= self.margin)


def familiarity(x: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size class of texts, and how common their n-grams are, on average, in the language that holds them most."""
    n = np.maximum(1, x.sum(axis=1))
    return np.minimum(2 * np.log2(n), CLASSES - 1).astype(int), (x @ common).max(axis=1) / n


def margins(s: np.ndarray) -> np.ndarray:
    if s.shape[1] < 2:
        return np.full(len(s), -np.inf)
    best = np.sort(s, axis=1)
    return best[:, -1] - best[:, -2]


def _presences(texts: list[str]) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_steps(pa.array(texts, pa.string()), rows=ROWS):
        yield presence(data, offsets)


def _common(texts: list[str], languages: list[str], names: list[str]) -> np.ndarray:
    """The share of each language's texts that hold an n-gram."""
    out = np.zeros((COLUMNS, len(names)), dtype=np.float32)
    for i, name in enumerate(names):
        mine = [t for t, x in zip(texts, languages) if x == name]
        for x in _presences(mine):
            out[:, i] += x.sum(axis=0) / len(mine)
    return out


def known(texts: list[str], languages: list[str]) -> Known:
    """Bounds from labelled texts and their beginnings, each half of them scored by what the other half teaches."""
    names, sizes, seen, margin = sorted(set(languages)), [], [], []
    for half in (0, 1):
        other, said, mine = texts[1 - half :: 2], languages[1 - half :: 2], texts[half::2]
        if not other or not mine:
            continue
        common, model = _common(other, said, names), fit(other, said)
        for x in _presences(mine):
            margin.append(margins(model.score(x)))
        for size in (*BEGINNINGS, None):
            for x in _presences([t[:size] for t in mine]):
                n, f = familiarity(x, common)
                sizes.append(n)
                seen.append(f)
    floors = np.zeros(CLASSES)
    if sizes:
        n, f = np.concatenate(sizes), np.concatenate(seen)
        full = np.flatnonzero(np.bincount(n, minlength=CLASSES) >= min(OWN, np.bincount(n).max()))
        floors = SHARE * np.interp(np.arange(CLASSES), full, [np.quantile(f[n == c], RARE) for c in full])
    return Known(_common(texts, languages, names), floors, float(np.quantile(np.concatenate(margin), RARE)) if margin else -np.inf)


def fit(texts: list[str], languages: list[str], seed: int = 6) -> Model:
    """One-versus-rest kernel ridge regression in the Nystroem space of the landmarks."""
    names = sorted(set(languages))
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    pick = np.sort(np.random.default_rng(seed).permutation(len(texts))[:LANDMARKS])

    def rows(which) -> Iterator[np.ndarray]:
        for x in _presences([texts[i] for i in which]):
            yield x / np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None]

    marks = np.vstack(list(rows(pick)))
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-8 * values.max()
    half = vectors[:, good] / np.sqrt(values[good])
    phi = np.vstack([x @ marks.T for x in rows(range(len(texts)))]).astype(np.float64) @ half
    w = np.linalg.solve(phi.T @ phi + RIDGE * len(texts) / LANDMARKS * np.eye(phi.shape[1]), phi.T @ y)
    return Model(names, (marks.T @ (half @ w)).astype(np.float32))


def training_sample(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE, id_col: str = "doc_id") -> pd.DataFrame:
    """At most ``per_language`` usable texts of every language, by the smallest hashes of their ids."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)))
    rows = rows.withColumns({"_h": F.xxhash64(F.lit(6), id_col), "_t": F.xxhash64("text")})
    narrow = rows.select("lang", "_h", "_t")
    counts = narrow.groupBy("lang").agg(F.count("*").alias("n"))
    # a hash threshold first, so that the ranking sees about twice the sample and no whole language
    near = narrow.join(counts, "lang").where(F.col("_h") <= F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(2.0 * per_language + 20) / F.col("n")))
    best = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "_t"))
    picked = near.withColumn("r", best).where(F.col("r") <= per_language).groupBy("lang", "_h", "_t").agg(F.min("r").alias("r"))
    return rows.join(picked, ["lang", "_h", "_t"]).groupBy("lang", "r").agg(F.min("text").alias("text")).orderBy("lang", "r").select("lang", "text").toPandas()


def predict(docs: DataFrame, model: Model | None, keep: list[str], of: Known | None = None) -> DataFrame:
    """Columns ``keep`` of the documents, lang_pred and score; ``und`` and 0 where a text is null or has no letter, or isn't known by ``of``."""
    letter = F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, offsets in text_steps(b.column("_text"), rows=ROWS):
                part = b.slice(a, z - a)
                has = part.column("_letter").to_numpy(zero_copy_only=False)
                if model is None:
                    names, best = np.full(z - a, UNKNOWN, dtype=object), np.zeros(z - a)
                else:
                    x = presence(data, offsets)
                    s = model.score(x)
                    if of is not None:
                        has = has & of.holds(x, s)
                    names = np.where(has, np.array(model.languages, dtype=object)[s.argmax(axis=1)], UNKNOWN)
                    best = np.where(has, np.clip((s.max(axis=1) + 1) / 2, 0, 1), 0.0)
                kept = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(best, pa.float64())], names=[*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*(F.col(c) for c in keep), F.col("text").alias("_text"), letter.alias("_letter"))
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame, usable: Column, keep: list[str]) -> DataFrame:
    """Learns from the usable rows that name a language and predicts every row.

    Only text and lang of usable rows are learned from, only text is used to
    predict.  Without any usable row every prediction is ``und`` with score 0.
    Empty tables give empty results; repeated rows are predicted each.
    """
    sample = training_sample(docs, usable)
    model = fit(sample["text"].tolist(), sample["lang"].tolist()) if len(sample) else None
    return predict(docs, model, keep)


def held_out(parts: int) -> Column:
    """crc32 of the id as text leaves remainder 2; a null id is held out by no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 2, F.lit(False))


def op6_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of `documents`, learned from three of four folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(4))
    return identify(docs, ~F.col("held_out"), ["doc_id", "held_out"])


@clearing
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is recognised, in their own columns."""
    sample = training_sample(docs, F.lit(True))
    texts, languages = sample["text"].tolist(), sample["lang"].tolist()
    scored = predict(docs, fit(texts, languages), docs.columns, known(texts, languages)) if texts else predict(docs, None, docs.columns)
    return scored.where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)
