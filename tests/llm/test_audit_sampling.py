"""Fingerprints, filter audit and target sampling against brute force, on awkward rows and edge tables."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from brute import words
from test_documents import SCHEMA
from test_documents import rows as prose_rows

from fretelens.llm import filter_audit, fingerprints, target_sampling


def rows():
    """The awkward texts, with a hot null id, repeated ids and rows, capitals, signs and long words."""
    out = prose_rows()
    out += [(None, t) for _, t in out[:40]] + [(None, None), (None, ""), (5, out[5][1]), (5, out[5][1]), (5, out[9][1]), (-3, out[4][1])]
    return out + [(500, "Big WORDS Here " * 30), (501, "a # b"), (502, "né" * 300 + " " + "z" * 70 + " " + "z" * 70), (503, "日本語 テキスト 7 x9"), (504, "a\0b-c_d" * 9)]


@pytest.fixture(scope="module")
def docs(spark):
    full = [(d, t, None, [None, "", "s1", "s2"][(d or 1) % 4], 0, 1, 2, 3) for d, t in rows()]
    return spark.createDataFrame(full, SCHEMA).repartition(6).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- operator 11
def true_likeness(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (words(a), words(b)))
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("slices", [1, 7, 300])
def test_fingerprints(docs, spark, slices, monkeypatch):
    """Any number of slices (also empty ones, and one row each) gives every document the same next one."""
    spark.conf.set("spark.sql.shuffle.partitions", str(slices))
    try:
        got = fingerprints.fingerprints(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows())
    unique = Counter(d for d, _ in rows())
    order = sorted({d for d, _ in rows() if d is not None})
    text = {d: t or "" for d, t in rows() if unique[d] == 1}
    checked, errors = 0, []
    for d, after in zip(order, order[1:]):
        if d not in text or after not in text:
            continue
        (r,) = by_id[d]
        t, e = text[d], fingerprints.edited(text[d], text[after])
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert len(e) == len(t) - len(t) // 4 + min(len(t) // 4, len(text[after]))
        sk, ek = fingerprints.read_form(r["fingerprint"]), fingerprints.read_form(r["edited_fingerprint"])
        assert r["near_edited"] == fingerprints.likeness(sk, ek) and 0 <= r["near_next"] <= 1
        assert r["near_next"] == fingerprints.likeness(sk, fingerprints.read_form(by_id[after][0]["fingerprint"]))
        errors += [abs(r["near_edited"] - true_likeness(t, e)), abs(r["near_next"] - true_likeness(t, text[after]))]
        checked += 1
    assert checked > 120 and np.mean(errors) < 0.04 and max(errors) < 0.35
    same = {}
    for d, t in rows():
        if unique[d] == 1:
            same.setdefault(t or "", set()).add(by_id[d][0]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())
    # null ids come last and lead back to the first document
    lasts = {hashlib.sha256(fingerprints.edited(t or "", text[order[0]]).encode()).hexdigest() for d, t in rows() if d is None}
    assert lasts & {r["edited_sha256"] for r in by_id[None]}


def test_sketches_merge_and_contain():
    """Sketches of parts merge into the whole's; a small text's share in a very large one is estimated."""
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 1 << 63, 40_000, dtype=np.uint64) << np.uint64(1))
    small, large = np.sort(rng.choice(h, 900, replace=False)), h
    a, b = fingerprints.sketch_of(small), fingerprints.sketch_of(large)
    assert fingerprints.containment(a, b) == 1 and abs(fingerprints.containment(b, a) - 900 / 40_000) < 0.005
    half = np.unique(np.concatenate([small[:450], np.unique(rng.integers(0, 1 << 63, 450, dtype=np.uint64))]))
    assert abs(fingerprints.containment(fingerprints.sketch_of(half), b) - 0.5) < 0.12
    m = fingerprints.merged(fingerprints.sketch_of(h[::2]), fingerprints.sketch_of(h[1::2]))
    assert m[0] == b[0] and (m[1] == b[1]).all()
    tiny = fingerprints.sketch_of(h[:5])
    assert len(tiny[1]) == 5 and fingerprints.read_form(fingerprints.written_form(tiny).hex())[1].tolist() == tiny[1].tolist()
    none = fingerprints.sketch_of(h[:0])
    assert fingerprints.likeness(none, none) == 1 and fingerprints.likeness(none, tiny) == 0


def test_fingerprints_of_few(spark, empty):
    assert fingerprints.fingerprints(empty).count() == 0
    (r,) = fingerprints.fingerprints(spark.createDataFrame([(1, "ab cd ef gh ij")], "doc_id int, text string")).collect()
    assert r["near_next"] == 1 and r["edited_sha256"] == hashlib.sha256(b"ab cd ef ghab ").hexdigest()


# ---- operator 12
def fails(doc_id, t, first):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return ((len(w) < 50) + 2 * (100 * len(set(w)) < 65 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + 8 * bool(re.search(r"[#$%&*|]", t))
            + 16 * (doc_id is not None and t in first and first[t] < doc_id))


def audited(table, good, toxic):
    first = {}
    for d, t, _ in table:
        if d is not None:
            first[t] = min(d, first.get(t, d))
    count = Counter()
    for d, t, part in table:
        count[part, fails(d, t, first), d in good, d in toxic] += 1
    out, shapley = {}, Counter()
    for part in {p for p, *_ in count}:
        for p in permutations("ABCDE"):
            gone = 0
            for step, f in enumerate(p, 1):
                bit = 1 << "ABCDE".index(f)
                here = [(k, n) for k, n in count.items() if k[0] == part and k[1] & bit]
                now = [(k, n) for k, n in here if not k[1] & gone]
                kept = sum(n for k, n in count.items() if k[0] == part and not k[1] & (gone | bit))
                removed = sum(n for _, n in now)
                shapley[part, f] += removed
                out[part, "".join(p), step] = [kept, removed, sum(n for _, n in here) - removed, sum(n for k, n in here if k[1] == bit),
                                               sum(n for k, n in now if k[2]), sum(n for k, n in now if k[3])]
                gone |= bit
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(docs, spark):
    labels = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 500, 2)] + [(4, 1, 0), (4, 0, None), (None, 1, 1), (9, None, 1)]
    found = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found.collect()}
    good, toxic = {d for d, q, _ in labels if q and d is not None}, {d for d, _, x in labels if x and d is not None}
    table = [(r["doc_id"], r["text"] or "", r["source"] or "") for r in docs.collect()]
    assert got == audited(table, good, toxic) and len(got) == 600 * len({p for *_, p in table})


def test_filter_audit_of_none(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).count() == 0
    clean = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "s")], "doc_id long, text string, source string")
    r = filter_audit.audit(clean, labels).collect()
    assert len(r) == 600 and {tuple(x)[3:] for x in r} == {(1, 0, 0, 0, 0, 0, 0)}


# ---- operator 13
def feature_buckets(t):
    w = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    return len(w), [zlib.crc32(x) % 10_000 for x in w + [a + b" " + b for a, b in zip(w, w[1:])]]


def sampled(table, target):
    found = [(d, *feature_buckets(t)) for d, t in table]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for x in target for b in feature_buckets(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000))))
    out = []
    for d, n, f in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], math.inf if x[0] is None else x[0], x[2], x[3]))
    ranks = [(*x[:1], *x[2:], i + 1) for i, x in enumerate(enough[: 25 * len(enough) // 100])]
    rest = [(*x[:1], *x[2:], None) for x in enough[25 * len(enough) // 100 :]] + [(*x[:1], *x[2:], None) for x in out if x[1] < 20]
    return Counter(ranks + rest)


def test_target_sampling(docs, spark):
    target = [t for _, t in rows()[3:9]] + [None, "", "né néné 日本語"]
    found = target_sampling.resample(docs, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"))
    got = Counter(map(tuple, found.select("doc_id", "n_features", "weight", "score", "rank").collect()))
    assert got == sampled(rows(), target) and max(r[4] or 0 for r in got) > 20


def test_target_sampling_of_none(docs, spark, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert target_sampling.resample(empty, none).count() == 0
    assert target_sampling.resample(docs, none).count() == len(rows())


def test_features_stop_at_text_borders():
    texts = ["Ab c", "", "d", "x" * 100 + " " + "y" * 65, "é-É é"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    bucket, text, n = target_sampling.features(data, offsets)
    assert n.tolist() == [feature_buckets(t)[0] for t in texts]
    for i, t in enumerate(texts):
        assert sorted(bucket[text == i].tolist()) == sorted(feature_buckets(t)[1])
