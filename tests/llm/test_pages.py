"""Main text of pages."""

import random
import re

import pytest

from fretelens.llm import html_region as H

from conftest import SF_SMALL

TRAIN = ["<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title</h1><p>some words that make <b>an</b> article<p>more of them</article>"
         "<div>about us</div><footer>foot</footer></body></html>"] * 3
W = H.learn(TRAIN)


def test_signs():
    assert W[""] > 0 and all(v < 0 for k, v in W.items() if k and k[0] not in "<.")


def test_article():
    page = "<body><header>Site</header><div class='cookie notice'>We use</div><article><h1>A &amp; B</h1><p>x&nbsp; y\n z<br>w<p>q<aside>side</aside><form>mail <input></form><script>var a='</p>';</script><div id=comments><p>great</div>" \
           "<p class=ad>buy<p>last</article><p>elsewhere there are a few words</p><footer>c</footer>"
    assert H.main_text(page, W) == "A & B\nx y z w\nq\nlast"


def test_unmarked_page():
    page = "<body><div id=menu><a>Home</a><a>News</a></div><div><h2>Head</h2><p>One two three four five six<p>Seven eight nine</div><div class=sidebar>s t u</div>"
    assert H.main_text(page, W) == "Head\nOne two three four five six\nSeven eight nine"


def test_empty_and_broken():
    for page in (None, "", "   ", "<p>", "<!-- x", "<script>a", "<nav>only a menu</nav>", "<style>p{}</style>"):
        assert H.main_text(page, W) == ""
    assert H.main_text("<article><p title='a>b'>kept<p>long " + "word " * 50_000 + "</article>", W).count("word") == 50_000


def test_scan_takes_the_best_run():
    p = [H.Piece("text", "a", False, 3), *[H.Piece("tag", "zz", False, 0)] * 400, H.Piece("text", "b", False, 5), H.Piece("tag", "zz", False, 0), H.Piece("text", "c", False, 5)]
    assert H.best_region(p, {"": 1.0}) == (401, 404)
    assert H.best_region([], {}) == (0, 0)


def test_scan_equals_all_runs():
    """The region scores what the best of all runs of random pieces scores; trimming by marks has its own tests."""
    rng = random.Random(4)
    w = {"": 0.5, "p": -0.7, "li": -2.0, "td": -0.1}
    for _ in range(300):
        found = [H.Piece("text", "x", False, rng.randint(0, 4)) if rng.random() < 0.5 else H.Piece("skip", "x", False, 3) if rng.random() < 0.1 else H.Piece("tag", rng.choice(["p", "li", "td", "q"]), False, 0)
                 for _ in range(rng.randint(0, 25))]
        value = [x.words * w[""] if x.kind == "text" else 0.0 if x.kind == "skip" else w.get(x.value, -H.UNSEEN) for x in found]
        best = max([sum(value[a:z]) for a in range(len(found)) for z in range(a + 1, len(found) + 1)], default=0.0)
        a, z = H.best_region(found, w)
        assert abs(sum(value[a:z]) - max(best, 0.0)) < 1e-9


@pytest.mark.parametrize("word", ["legal", "form", "search", "share", "alert", "related", "promo", "widget"])
def test_prose_keeps_its_place(word):
    """A paragraph of an article stays whatever it is about; an element that only holds such things goes."""
    page = f"<body><article><h1>T</h1><p>one two three<p class='{word}-note'>four five six<p>seven</article><div class={word}>eight</div>"
    assert H.main_text(page, W) == "T\none two three\nfour five six\nseven"
    assert "eight" not in H.main_text(page.replace("article", "div"), W)
    assert H.main_text(f"<article><p>one two three<div class={word}>four</div><p>seven{' and on' * 20}</article>", W) == "one two three\nseven" + " and on" * 20
    # labelled pages that use the word for prose teach so, also of other elements
    prose = f"<nav><a>Home</a></nav><article><p>some words<div class={word}>a long paragraph that has rather more than eight words in it</div></article>"
    taught = H.learn([prose] * 20)
    assert H.main_text(f"<article><p>one two three<div class={word}>four</div><p>seven{' and on' * 20}</article>", taught) == "one two three\nfour\nseven" + " and on" * 20


def test_class_words_are_learned():
    page = "<body><div class='teaser box'><p>Read this too, it is short but has several words</p></div><div class='wrap'><article class=story><h2 class=box>Head</h2><p>Body words of the story<div class=ad>buy this now, it is an advert of many more words</div></article></div>"
    w = H.learn([page] * 30)
    assert w[".teaser"] < H.FURNITURE and w[".wrap"] > 0 and w[".ad"] == H.SAYS and w[".story"] > 0
    bare = page.replace("article", "section")
    assert H.main_text(bare, w) == "Head\nBody words of the story" and "Read this" in H.main_text(bare, W)


def test_held_out_pages_without_marks():
    """Weights of half the pages find the articles of the other half, marks stripped: word F1 against the marked text."""
    import pyarrow.parquet as pq
    html = [h for h in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist() if h and h.count("<article") == 1]
    weights = H.learn(html[::2][:H.LABELLED])
    f1 = []
    for h in html[1::2]:
        want, got = H.main_text(h, weights).split(), H.main_text(re.sub(r"</?article[^>]*>", "", h), weights).split()
        same = len(set(enumerate(want)) & set(enumerate(got)))
        f1.append(2 * same / max(1, len(want) + len(got)))
    assert sum(f1) / len(f1) > 0.99


def test_evidence_of_broken_pages():
    H.class_evidence("<p class=x>" * 5000 + "<a>" * 5000 + "</article>")
    assert H.class_evidence("") == (set(), set()) and H.learn([])[""] > 0
    assert H.class_evidence("<ul><li class=a>one<li class=b>two</ul><main><p class=c>" + "word " * 9) == ({"c"}, {"a", "b"})


def test_query(spark):
    out = {r["page_id"]: r for r in H.op4_html_region(spark, SF_SMALL).collect()}
    rows = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    assert len(out) == len(rows)
    for r in rows:
        got = out[r["page_id"]]
        assert got["n_chars"] == len(got["text"]) and got["url"] == r["url"] and "<p>" not in got["text"] and "track(" not in got["text"]
        assert all(x == " ".join(x.split()) and x for x in got["text"].split("\n")) or not got["text"]


def test_null_pages(spark):
    d = spark.createDataFrame([(1, None, None, 5), (1, "u", "", 5), (None, "v", "<article>x</article>", 5)], "page_id long, url string, html string, text int")
    assert sorted((r["text"], r["n_chars"]) for r in H.extract(d).collect()) == [("", 0), ("", 0), ("x", 1)]
    assert H.extract(d.limit(0)).count() == 0
