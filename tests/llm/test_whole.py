"""Inputs on which an operator once did less than its whole job."""

import numpy as np
from brute import line_links, repeats
from pyspark.sql import functions as F

from fretelens.llm import ann_hilbert, html_region, jaccard_join, lang_kernel, line_dedup, mix_sources, suffix_dedup


def test_foreign_scripts_and_gibberish_are_no_known_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("text rlike '[a-z]{2}' and lang is not null and doc_id >= 0")
    rng = np.random.default_rng(4)
    noise = [" ".join("".join(map(chr, rng.integers(lo, hi, k))) for k in rng.integers(2, 9, n)) for lo, hi in ((0x4E00, 0x9FA5), (0x430, 0x44F), (0x3B1, 0x3C9), (97, 123)) for n in (50, 400)]
    both = d.unionAll(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(noise)], d.schema))
    kept = {r["doc_id"] for r in lang_kernel.known_language(spark, both, "").collect()}
    assert not [i for i in kept if i < 0]
    assert len(kept) >= 0.998 * d.select("doc_id").distinct().count()


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghilmnoprstuv"), rng.integers(4, 9))) for _ in range(n))


def test_lines_of_rows_that_share_an_id(spark):
    """A copied line of one row takes no line of another row with its id; copies at equal places go."""
    rng = np.random.default_rng(1)
    a, b, c, d, e = (prose(rng, 12) for _ in range(5))
    texts = [(1, a), (None, f"{b}\n{a}"), (None, f"{c}\n{d}"), (None, f"{e}\n{d}"), (7, f"{a}\n{a}"), (7, prose(rng, 12)), (8, None), (8, " \n")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = sorted((str(r["doc_id"]), r["n_lines"], r["removed_lines"]) for r in line_dedup.line_dedup(docs).collect())
    assert got == sorted([("1", 1, []), ("None", 2, [1]), ("None", 2, []), ("None", 2, [1]), ("7", 2, [0, 1]), ("7", 1, []), ("8", 0, []), ("8", 0, [])])
    left = sorted(r["text"] for r in line_dedup.without_repeated_lines(spark, docs, "").collect())
    assert left == sorted([a, b, f"{c}\n{d}", e, texts[5][1]])


def test_documents_that_share_an_id(spark):
    """One row of each component stays, whatever the ids of the rows are."""
    rng = np.random.default_rng(2)
    a, b, c, d = (prose(rng, 30) for _ in range(4))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (None, c), (None, c), (3, d), (3, d), (None, a)], "doc_id long, text string")
    left = sorted((str(r["doc_id"]), r["text"]) for r in jaccard_join.one_of_each(spark, docs, "").collect())
    assert left == sorted([("1", a), ("2", b), ("None", c), ("3", d)])


def test_templated_lines(spark):
    """Many lines of one template share bands without all being near: every pair that meets is decided."""
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefghilmnoprstuv"), n))
    base, lines = [word(6) for _ in range(20)], []
    for _ in range(300):
        w = list(base)
        w[4], w[15] = word(rng.integers(1, 13)), word(rng.integers(1, 13))
        lines.append(" ".join(w))
    docs = [(i, x) for i, x in enumerate(lines)]
    want = {d for d, gone in line_links(docs).items() if gone}
    got = {r["doc_id"] for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r["n_removed"]}
    assert 100 < len(want) < 200 and got <= want and len(want - got) <= 0.03 * len(want)


def test_short_lines(spark):
    """Near copies of headings and the like meet although one edit changes all their long shingles."""
    rng = np.random.default_rng(6)
    lines = []
    for _ in range(150):
        x = prose(rng, rng.integers(3, 6))
        lines += [x, x[:-1] + "z", x + "!"]
    docs = list(enumerate(lines))
    want = {d for d, gone in line_links(docs).items() if gone}
    got = {r["doc_id"] for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r["n_removed"]}
    assert len(want) > 250 and got <= want and len(want - got) <= 0.01 * len(want)


def test_marks_spare_far_lines_the_comparison(spark, monkeypatch):
    """Lines of one template that aren't near are told apart by their marks; no near pair is."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(12)
    template = " ".join(prose(rng, 1) for _ in range(6))
    lines = [f"{template} {prose(rng, 12)}" for _ in range(40)] + ["é", "abcde", "a" * 300]
    lines += [x[:-1] + "ç" for x in lines[:20]] + [x + " fim" for x in lines[20:43]]
    grams = lambda x: {x[i : i + 5] for i in range(len(x) - 4)} or {x}
    near = {(i, j) for i, x in enumerate(lines) for j, y in enumerate(lines) if i < j and len(grams(x) & grams(y)) / len(grams(x) | grams(y)) >= 0.8}
    marks = line_dedup.marked(spark.createDataFrame(list(enumerate(lines)), "id long, line string"))
    assert {r["id"]: r["n_grams"] for r in marks.collect()} == {i: len(grams(x)) for i, x in enumerate(lines)}
    a, b = marks.alias("a"), marks.alias("b")
    fits = line_dedup.may_be_near(F.col("a.n_grams"), F.col("a.marks"), F.col("b.n_grams"), F.col("b.marks"), 0.8)
    kept = {tuple(r) for r in a.join(b, F.col("a.id") < F.col("b.id")).where(fits).select("a.id", "b.id").collect()}
    assert len(near) > 30 and near <= kept and len(kept - near) <= 10
    compared, judged = [], line_dedup._judged

    def counted(pairs, text, similar):
        compared.append(pairs.count())
        return judged(pairs, text, similar)
    monkeypatch.setattr(line_dedup, "_judged", counted)
    found = line_dedup.line_dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found if r["n_removed"]} == {j for _, j in near} and sum(compared) <= 2 * len(near)


def test_lines_outside_the_basic_plane_and_bands_dealt_once(spark, monkeypatch):
    """Grams are of whole characters; members of bands aren't sifted by slots, which fill up as the table grows."""
    lines = ["a😀b😀c😀d😀e", "😀" * 9, "é😀", "abcdefgh", "texto comum ção " * 4]
    grams = lambda x: {x[i : i + 5] for i in range(len(x) - 4)} or {x}
    got = {r["id"]: r["n_grams"] for r in line_dedup.marked(spark.createDataFrame(list(enumerate(lines)), "id long, line string")).collect()}
    assert got == {i: len(grams(x)) for i, x in enumerate(lines)}
    pairs = spark.createDataFrame([(x, y) for x in lines for y in lines], "a string, b string")
    for r in line_dedup.similarity(pairs, "a", "b", "a", "b").collect():
        x, y = grams(r["a"]), grams(r["b"])
        assert r["similarity"] == len(x & y) / len(x | y)
    sifted, plain = [], line_dedup.perhaps_in
    monkeypatch.setattr(line_dedup, "perhaps_in", lambda df, key, need, **k: sifted.append(key) or plain(df, key, need, **k))
    rows = spark.createDataFrame([(1, lines[4]), (2, lines[4] + "a"), (3, lines[4] + "e"), (4, lines[3])], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in line_dedup.line_dedup(rows).collect() if r["n_removed"]) == [2, 3] and "band" not in sifted


def test_recall_of_structureless_vectors(spark):
    """A table of many blocks without clusters: the block follows the rows."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in ann_hilbert.hilbert_search(v, F.col("id") % 20 == 0, block=32).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    s = x[::20] @ x.T
    s[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    assert np.mean([len(got[20 * i] & set(np.argsort(-r)[:20])) / 20 for i, r in enumerate(s)]) >= 0.9


def test_pages_are_scored_by_the_learned_weights():
    """A body without a mark beside marked cards is the text; a list of links at the end of main isn't."""
    train = ["<html><body><nav><a href=x>Home</a></nav><ul><li><a href=y>News</a></li><li><a href=z>Sport</a></li></ul><article><h1>Title</h1><p>" + "some words that make an article " * 5
             + "<p>more of them</article><ul><li><a href=y>About</a></li></ul><div><a href=z>Legal</a></div></body></html>"] * 20
    w = html_region.learn(train)
    body = "one two three four five six seven eight nine ten " * 6
    cards = "<ul><li><article><a href=1>A card</a></article></li><li><article><a href=2>Next card</a></article></li></ul>"
    page = f"<body><div><h1>Head</h1><p>{body}<p>{body}</div>{cards}</body>"
    assert html_region.main_text(page, w).startswith(f"Head\n{body.strip()}\n{body.strip()}")
    links = "<ul>" + "".join(f"<li><a href={i}>Link</a></li>" for i in range(6)) + "</ul>"
    assert html_region.main_text(f"<body><main><h1>Head</h1><p>{body}</p>{links}</main></body>", w) == f"Head\n{body.strip()}"


def test_suffix_dedup_with_a_hot_null_id(spark):
    """A third of the rows has no id, another third one id; they are dealt over all units and equal brute force."""
    rng = np.random.default_rng(11)
    shared = [prose(rng, 40) for _ in range(6)]
    texts = [(i if i % 3 == 0 else None if i % 3 == 1 else 5, " ".join([prose(rng, rng.integers(1, 30)), shared[rng.integers(6)], prose(rng, 5)])) for i in range(150)]
    texts += [(None, shared[0]), (None, shared[0]), (5, shared[1]), (5, shared[1]), (None, None), (5, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    order = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 41)).collect()
    order = sorted(order, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["h"]))
    want = repeats([(i, r["text"]) for i, r in enumerate(order)])
    found = suffix_dedup.repeated_spans(docs, unit=1500, bucket=4000).collect()
    key = lambda d, v: (str(d), *v)
    assert sorted(key(r["doc_id"], tuple(r)[1:5]) for r in found) == sorted(key(r["doc_id"], want[i]) for i, r in enumerate(order))
    assert sum(r["n_removed"] for r in found) > 10_000


def test_a_stage_clears_the_tables_of_earlier_ones(spark):
    """Tables of an ended stage go when a stage starts that doesn't read them, and not before."""
    import os

    from fretelens.llm import common
    docs = common.materialize(spark.createDataFrame([(i, prose(np.random.default_rng(i % 7), 30), "aa", "s", 0) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long"))
    tables = f"{common.checkpoint_dir(spark).removeprefix('file:')}/tables"
    common._ended.clear()
    lazy = line_dedup.without_repeated_lines(spark, docs, "")
    first = list(common._ended)
    again = mix_sources.mixed(spark, lazy, "")    # reads what the first stage left unwritten
    kept = [p for p in first if p in common._ended]
    assert 0 < len(kept) < len(first) and again.count() > 0
    written = common.materialize(lazy)
    mix_sources.mixed(spark, written, "")
    assert not [p for p in first if os.path.isdir(f"{tables}/{p.rsplit('/', 1)[1]}")] and written.count() == 7 and not common._open_stages


def test_short_texts_come_in_bounded_steps():
    """Ten thousand short texts make no step of more than the rows a presence matrix may have."""
    import pyarrow as pa

    from fretelens.llm.common import text_steps
    steps = list(text_steps(pa.array([f"t{i}" if i % 3 else None for i in range(10_000)]), rows=lang_kernel.ROWS))
    assert max(z - a for a, z, _, _ in steps) == lang_kernel.ROWS and [a for a, *_ in steps[1:]] == [z for _, z, *_ in steps[:-1]] and steps[-1][1] == 10_000
    assert b"".join(d.tobytes() for _, _, d, _ in steps) == "".join(f"t{i}" if i % 3 else "" for i in range(10_000)).encode()


def test_line_dedup_leaves_few_tables(spark, tmp_path):
    """Texts, signatures and the rounds of line dedup go as soon as nothing reads them; the result still stands."""
    import glob
    from fretelens.llm.common import materialize
    from fretelens.session import checkpoint_dir
    rng = np.random.default_rng(11)
    lines = [prose(rng, 12) for _ in range(60)]
    docs = spark.createDataFrame([(i, f"{x}\n{x[:-2]}zz") for i, x in enumerate(lines)], "doc_id long, text string")
    folder = f"{checkpoint_dir(spark)}/tables".removeprefix("file:")
    before = set(glob.glob(f"{folder}/*"))
    found = line_dedup.line_dedup(docs)
    left = [spark.read.parquet(p).columns for p in set(glob.glob(f"{folder}/*")) - before]
    assert len(left) <= 3 and not any({"line", "signatures"} & set(c) for c in left)
    got = {r["doc_id"]: r["removed_lines"] for r in materialize(found).collect()}
    want = line_links([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(len(want[d] - set(got[d])) for d in want) <= 1 and all(set(got[d]) <= want[d] for d in want)
