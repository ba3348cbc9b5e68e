"""The document operators against brute force, on a small table with awkward rows and on edge tables."""

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from brute import crc_fold, jaccard, line_links, ngram_scores, repeats, targets, words

from conftest import SF_SMALL
from fretelens.llm import jaccard_join, lang_kernel, line_dedup, lm_automaton, mix_sources, pack_best_fit, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, band int, unit int"


def rows():
    """Generated prose plus nulls, empty, blank, one-word, tied, repeated and very long texts."""
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdefghilmnoprstuv"), rng.integers(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab, n))
    out = [(i, "\n".join(prose(rng.integers(3, 60)) for _ in range(rng.integers(1, 5)))) for i in range(60)]
    passage = prose(80)
    out += [(100 + i, prose(20) + " " + passage + " " + prose(20)) for i in range(12)]
    base = prose(150).split()
    for i in range(40):  # a large group of near copies
        w = list(base)
        for j in rng.integers(0, 150, 3):
            w[j] = "edit%d" % rng.integers(1000)
        out.append((200 + i, " ".join(w)))
    out += [(300 + i, prose(30)) if i % 5 else (300 + i, out[7][1]) for i in range(25)]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "One"), (404, "one"), (405, "a b c"), (406, "x" * 400), (407, prose(9000)), (408, "aé ü" * 90), (409, "\n\n" + passage)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    langs = ["aa", None, "bb"]
    return spark.createDataFrame([(d, t, langs[d % 3], ["s1", "s10", "s2", None][d % 4] if d % 2 else "s1", 0, 1, 2, 3) for d, t in rows()], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select(*cols).collect()}


@pytest.mark.parametrize("block", [256, 8])
def test_jaccard_join_is_exact(docs, block):
    """block 8 divides regions by pivots and joins the near copies block by block."""
    found = table(jaccard_join.jaccard_classes(docs, block=block, unit=20_000, bucket=30_000), "doc_id", "n_shingles", "component_id", "n_links")
    assert found == jaccard(rows())


def test_division_keeps_every_link(spark):
    """Groups far from each other inside one region are divided by pivots; no pair within the distance is parted."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    sets = []
    for g in range(6):
        core = rng.integers(0, 1 << 62, 100).astype(np.uint64)
        for _ in range(10):
            sets.append(np.unique(np.concatenate([core[rng.permutation(100)[:92]], rng.integers(0, 1 << 62, 4).astype(np.uint64)])))
    t = pa.table({"region": [7] * 60, "print": list(range(60)), "n": [len(s) for s in sets], "shared": pa.array([s.tobytes() for s in sets], pa.binary())})
    got = jaccard_join._divide(t, t.take(list(range(0, 60, 7))), 80).to_pydict()
    where = {}
    for r, p in zip(got["region"], got["print"]):
        where.setdefault(p, set()).add(r)
    assert len(where) == 60 and len({r for v in where.values() for r in v}) > 1
    for a in range(60):
        for b in range(a):
            x = len(np.intersect1d(sets[a], sets[b]))
            if 100 * x >= 80 * (len(sets[a]) + len(sets[b]) - x):
                assert where[a] & where[b]


def test_repeated_strings_are_removed_exactly(docs):
    found = table(suffix_dedup.repeated_spans(docs, unit=9_000, bucket=20_000), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == repeats(rows())


def test_removed_spans_give_the_kept_bytes(docs):
    import hashlib

    text = dict(rows())
    for r in suffix_dedup.repeated_spans(docs).collect():
        b, at, kept = (text[r["doc_id"]] or "").encode(), 0, b""
        for s in r["spans"]:
            kept, at = kept + b[at : s["start"]], s["end"]
        assert hashlib.sha256(kept + b[at:]).hexdigest() == r["kept_sha256"] and len(r["spans"]) == r["n_spans"]


@pytest.mark.parametrize("mus", [(500.0,), (500.0, 50.0), (300.0, 40.0, 5.0)])
def test_backoff_scores(docs, mus):
    held = lambda d: crc_fold(d, 7)
    found = table(lm_automaton.score_texts(docs, ~lang_kernel.held_out(7), mus=mus, unit=20_000, bucket=30_000), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for d, want in ngram_scores(rows(), held, mus).items():
        got = found[d]
        assert got[0] == held(d) and got[1:4] == want[:3]
        assert got[4:] == pytest.approx(want[3:], rel=1e-9)


def automaton(texts, train, mus):
    """The automaton of one unit that holds all texts, without Spark."""
    asked = pa.Table.from_batches(lm_automaton.count_requests([pa.record_batch({"unit": [0] * len(texts), "train": train, "text": texts})], 1, len(mus) + 1, 48))
    told = pa.concat_tables([lm_automaton.count_bucket(asked.filter(pa.compute.equal(asked["kind"], k))) for k in range(1, len(mus) + 2)])
    words_of = told.filter(pa.compute.equal(told["kind"], 1))
    n, v = (sum(words_of[c].to_pylist()) for c in ("total", "distinct"))
    return lm_automaton.automaton_of(pa.array(texts), told, n, v, mus, 48)


def test_backoff_model_is_a_distribution():
    # one word of the last text stands for all that training has not seen
    auto, w, sizes = automaton(["a b a b c", "a b", "c a b d d d", "", "a b a unseen"], [True] * 4 + [False], (3.0, 2.0))
    assert (~auto.known).sum() == 1
    end = w[sizes[0] - 1]
    reached = set(auto.to[auto.key % auto.words != end]) | set(auto.from_root) | {auto.start, auto.root}
    assert len(reached) > 10  # all but those where a text has ended
    for state in reached:
        _, found = auto.step(np.full(auto.words, state), np.arange(auto.words))
        assert (10.0**found).sum() == pytest.approx(1)


def test_failure_arcs_follow_each_other():
    auto, w, _ = automaton(["a b c", "b e", "f", "a b f"], [True] * 3 + [False], (3.0, 2.0))
    one = lambda s, i: [x[0] for x in auto.step(np.array([s]), w[i : i + 1])]
    a, b, f = 0, 1, 7  # where these words stand among the tokens
    s, _ = one(auto.start, a)
    pair, _ = one(s, b)
    # the start and "a" is a context seen in training; so is "a b"
    assert auto.fail_to[s] == w[a] and auto.fail_to[w[a]] == auto.root and auto.fail_to[pair] == w[b]
    to, found = one(pair, f)
    assert to == w[f] and found == pytest.approx(auto.fail[pair] + auto.fail[w[b]] + auto.by_root[w[f]])


@pytest.mark.parametrize("segment", [1, 2, 7, 10_000])
def test_segments_of_long_texts_carry_the_state(segment):
    texts = [t for _, t in rows() if t]
    auto, w, sizes = automaton(texts, [i % 3 > 0 for i in range(len(texts))], (500.0, 50.0))
    assert auto.walk(w, sizes, 3, segment) == pytest.approx(auto.walk(w, sizes, 3, 1 << 30), rel=1e-9)


def test_fuzzy_lines(docs):
    found = table(line_dedup.line_dedup(docs), "doc_id", "n_lines", "n_removed", "removed_lines")
    want = line_links(rows())
    total = sum(map(len, want.values()))
    missed = sum(len(want[d] - set(found[d][2])) for d, _ in rows())
    assert total > 40 and missed <= 0.03 * total
    for d, t in rows():
        assert set(found[d][2]) <= want[d] and found[d][1] == len(found[d][2])
        assert found[d][0] == sum(1 for x in (t or "").split("\n") if x.strip(" "))


def test_lines_found_for_real_texts(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    found = table(line_dedup.line_dedup(d), "doc_id", "removed_lines")
    want = line_links([(r["doc_id"], r["text"]) for r in d.collect()])
    total = sum(map(len, want.values()))
    assert sum(len(want[k] - set(v[0])) for k, v in found.items()) <= 0.03 * total
    assert not any(set(v[0]) - want[k] for k, v in found.items())


def test_mix_meets_its_targets(docs):
    out = mix_sources.mix_sources(docs, block=4).collect()
    sizes = {d: len(words(t)) for d, t in rows()}
    assert {r["doc_id"]: r["size"] for r in out} == sizes
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    whole = [sum(sizes[d] for d in sizes if source[d] == s) for s in names]
    want = dict(zip(names, targets(whole)))
    for s, total in zip(names, whole):
        mine = [r for r in out if source[r["doc_id"]] == s]
        assert all(r["source_size"] == total and r["target"] == pytest.approx(want[s]) for r in mine)
        assert sum(r["taken"] for r in mine) == pytest.approx(want[s], abs=8)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    again = mix_sources.mix_sources(docs.repartition(3), block=4)
    assert {r["doc_id"]: r["taken"] for r in again.collect()} == {r["doc_id"]: r["taken"] for r in out}


def test_mixed_documents_hold_the_words_taken(docs):
    taken = {r["doc_id"]: r["taken"] for r in mix_sources.mix_sources(docs).collect()}
    got = {}
    mixed = mix_sources.mixed_documents(docs)
    assert mixed.columns == docs.columns
    text = dict(rows())
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words(r["text"]))
        assert set(words(r["text"])) <= set(words(text[r["doc_id"]])) and r["n_chars"] == len(r["text"])
    assert {d: n for d, n in taken.items() if n} == got


def test_block_numbers_are_permuted(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 97, 1000):
        d = spark.range(n).select(mix_sources._permuted(F.col("id"), F.lit(n), F.lit(n), F.lit(1)).alias("p"))
        assert sorted(r["p"] for r in d.collect()) == list(range(n))


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packed(out, want, size):
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():  # gapless and within the size
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert set(got) == set(want)
    for d, ids in want.items():
        import zlib

        k = -(-len(ids) // size)
        edges = [0, *(len(ids) - size * (k - i) for i in range(1, k + 1))]
        assert sorted(got[d]) == [(i, a, z - a, zlib.crc32(np.array(ids[a:z], dtype="<u4").tobytes())) for i, (a, z) in enumerate(zip(edges[:-1], edges[1:]))]
    return len(by)


def test_packing(docs, tokenizer):
    hard = [(900, "it's  a\n\n b\t c"), (901, "a b  "), (902, " <|endoftext|> x"), (903, "日本 × é1 2 3abc"), (904, "a b\t\tc  d\n"), (905, "x\n y")]
    d = docs.select("doc_id", "text").unionAll(docs.sparkSession.createDataFrame(hard, "doc_id long, text string"))
    want = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for k, t in rows() + hard}
    n = check_packed(pack_best_fit.pack(d).collect(), want, 2048)
    assert n <= -(-sum(map(len, want.values())) // 2048) + 1
    check_packed(pack_best_fit.pack(d, size=64, group=100).collect(), want, 64)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    lengths = np.random.default_rng(0).integers(1, 400, 500)
    where, offset = pack_best_fit.vector_best_fit(lengths, 1000, max_docs=6, max_cost=1000 * 1000, rule=rule)
    for b in np.unique(where):
        n = lengths[where == b]
        assert n.sum() <= 1000 and len(n) <= 6 and (n**2).sum() <= 1000 * 1000
        assert sorted(offset[where == b]) == (np.cumsum([0, *n[np.argsort(offset[where == b])]])[:-1]).tolist()


def test_language_accuracy_on_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lang_kernel.identify(d.withColumn("held", lang_kernel.held_out(4)), ~lang_kernel.held_out(4), ["doc_id", "lang"]).collect()
    held = [r for r in out if crc_fold(r["doc_id"], 4)]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in out)


def test_language_edges(docs):
    from pyspark.sql import functions as F

    out = table(lang_kernel.identify(docs, F.lit(True), ["doc_id"]), "doc_id", "lang_pred", "score")
    assert len(out) == len(rows()) and {out[400], out[401], out[402]} == {("und", 0.0)} and out[0][0] in ("aa", "bb")
    untaught = table(lang_kernel.identify(docs, F.lit(False), ["doc_id"]), "doc_id", "lang_pred", "score")
    assert set(untaught.values()) == {("und", 0.0)}


def test_empty_tables(empty):
    from pyspark.sql import functions as F

    for out in (jaccard_join.jaccard_classes(empty), suffix_dedup.repeated_spans(empty), lm_automaton.score_texts(empty, F.lit(True)), line_dedup.line_dedup(empty),
                mix_sources.mix_sources(empty), mix_sources.mixed_documents(empty), pack_best_fit.pack(empty), lang_kernel.identify(empty, F.lit(True), ["doc_id"])):
        assert out.count() == 0


def test_null_ids_and_repeated_rows(spark):
    from pyspark.sql import functions as F

    text = "one two three four five six seven eight nine ten " * 4
    d = spark.createDataFrame([(None, text, None, None), (None, None, "aa", "s"), (5, text, "aa", None), (5, text, "aa", None), (7, None, None, None)], "doc_id long, text string, lang string, source string")
    for out in (jaccard_join.jaccard_classes(d), lm_automaton.score_texts(d, F.lit(True)), line_dedup.line_dedup(d), mix_sources.mix_sources(d), pack_best_fit.pack(d), lang_kernel.identify(d, F.lit(True), ["doc_id"])):
        assert out.count() == 5
    removed = sorted((r["doc_id"] or 99, r["n_removed"]) for r in suffix_dedup.repeated_spans(d).collect())
    n = len(text)
    period = n // 4  # the text repeats itself: every string from the second period on starts earlier
    assert removed[0][1] + removed[1][1] == 2 * n - period and len(removed) == 5
    assert mix_sources.mixed_documents(d).where("doc_id = 5").count() >= 2
