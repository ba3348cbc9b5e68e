"""Main text of web pages by maximum-scoring subsequence (operator 4).

A page is a sequence of words and tags.  Words score positive and tags
negative, with weights learned from labelled pages: those that mark their own
content with one ``article`` or ``main`` element.  One linear scan finds the
contiguous region of the largest score; its words, without those of page
furniture inside it, are the text.

Which elements are furniture is weighed too.  The words of class, id and role
are features: a few start from what they mean, all learn from where they stand
in labelled pages, and an element is furniture if their sum, and that of its
tag, says so.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fretelens.llm.common import table

#: Labelled pages that training samples at most (the smallest hashes of the id).
LABELLED = 400
#: What a tag costs at least, and one that training never met.
LEAST, UNSEEN = 1e-6, 0.25
#: Open elements that evidence of class words is kept for.
_DEEPEST = 200

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|iframe|noscript|template|xmp)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-z][^\s/>]*)([^<>]*)>"
    r"|<[!?][^>]*>",
    re.I | re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS_ITSELF = ("p", "li", "dt", "dd", "td", "th", "tr", "option")
# elements that are never part of an article, and words of class, id or role that say so of any element
_FURNITURE = frozenset("head nav aside footer form button select input menu dialog svg canvas object embed audio video map noscript".split())
# words of class, id or role that say so of any element, and those that may as well stand on prose
_SAYS = re.compile(
    r"ads?|adv|advert\w*|sponsor\w*|banner\w*|sidebar\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|footer|header|masthead|"
    r"comments?|commentlist|disqus\w*|respond|replies|cookies?|consent|gdpr|notices?|warningbar|newsletter\w*|subscri\w*|signup|login|social\w*|"
    r"popup|modal|overlay|pagination|pager|toolbar|copyright|disclaimer|skiplink|contentinfo|complementary")
_MAY_SAY = re.compile(r"promo\w*|alert|share\w*|sharing|related\w*|recommend\w*|widget\w*|legal|search|form")
_JOINED = re.compile(r"\b(side|warning|sign|skip)-(bar|up|link)", re.I)
#: Weight of a word that says furniture and of one that may, most that a tag adds, and below what a sum an element is furniture.
SAYS, MAY_SAY, MOST_TAG, FURNITURE = -4.0, -1.5, 2.0, -1.0
#: Words that an element in marked content holds at least to count as prose.
PROSE = 8
_CONTENT = ("article", "main")


class Piece(NamedTuple):
    kind: str  # "text", "tag" or "skip"
    value: str  # the raw text, or the tag's name
    main: bool  # inside an article or main element
    words: int


def said_words(attributes: str) -> list[str]:
    """Distinct lower-case words of class, id and role."""
    said = " ".join(filter(None, (x for g in _NAMES.findall(attributes) for x in g)))
    return list(dict.fromkeys(re.findall(r"[a-z]+", _JOINED.sub(r"\1\2", said.lower()))))


def prior(word: str) -> float:
    """What a word of class, id or role weighs before training."""
    return SAYS if _SAYS.fullmatch(word) else MAY_SAY if _MAY_SAY.fullmatch(word) else 0.0


def is_furniture(name: str, said: list[str], main: bool, weights: dict[str, float]) -> bool:
    """Whether the words on an element outweigh its tag.

    Inside marked content only words that mean furniture count, and ``header``
    and ``masthead`` are its own.
    """
    if main:
        said = [w for w in said if prior(w) and w not in ("header", "masthead")]
    return bool(said) and sum(weights.get("." + w, prior(w)) for w in said) + weights.get("<" + name, 0.0) < FURNITURE


def pieces(html: str, weights: dict[str, float]) -> list[Piece]:
    """The page as texts and tags, in order; texts of page furniture have kind ``skip``."""
    out: list[Piece] = []
    main, skip, depth, at = 0, "", 0, 0

    def text(raw: str) -> None:
        if raw:
            out.append(Piece("skip" if skip else "text", raw, main > 0, len(raw.split())))

    for m in _TOKEN.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:  # comments, declarations, scripts and the like
            continue
        close, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        block = name not in _INLINE
        if skip in _ENDS_ITSELF and block and (not close or name != skip):
            if name == skip or (skip == "p" and not close) or (close and name != skip):
                skip = ""  # ended by what follows it
        if skip:
            if name == skip:
                depth += -1 if close else 1
                if not depth:
                    skip = ""
            elif skip == "head" and name == "body":
                skip = ""
        elif not close and name not in _VOID:
            said = " ".join(filter(None, (x for g in _NAMES.findall(attributes) for x in g))) if attributes else ""
            content = name in _CONTENT or (name == "div" and "role" in attributes.lower() and re.search(r"(?:^|\s)main(?:\s|$)", said))
            if name in ("html", "body"):
                pass
            elif content and not re.search(r"comment|repl(?:y|ies)", said, re.I):
                main += 1
            elif (name in _FURNITURE or (name == "header" and not main) or (attributes and _HIDDEN.search(attributes))
                  or (said and is_furniture(name, said_words(attributes), main > 0, weights))):
                skip, depth = name, 1
        elif close and name in _CONTENT and main:
            main -= 1
        out.append(Piece("tag", name, main > 0, 0))
    text(html[at:])
    return out


def class_evidence(html: str) -> tuple[set[str], set[str]]:
    """Words of class, id and role in (or around) the marked content of a page, and outside it; those that say furniture need prose inside."""
    inside, outside, open_, main, at = set(), set(), [], 0, 0

    def text(raw: str) -> None:
        n = len(raw.split())
        linked = any(e["name"] == "a" for e in open_) if n else False
        for e in open_ if n else ():
            e["words"] += n
            e["linked"] += n * linked

    def ended(e: dict) -> None:
        prose = e["around"] or (e["words"] >= PROSE and 2 * e["linked"] < e["words"])
        if e["around"] or e["main"]:
            inside.update(w for w in e["said"] if prose or not prior(w))
        else:
            outside.update(e["said"])

    for m in _TOKEN.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name or name in _VOID:
            continue
        if m[2] or m[5]:
            i = next((i for i in range(len(open_) - 1, -1, -1) if open_[i]["name"] == name), None)
            if i is not None:
                for e in open_[i:]:
                    main -= e["content"]
                    ended(e)
                del open_[i:]
            continue
        if open_ and open_[-1]["name"] == name and name in _ENDS_ITSELF:
            ended(open_.pop())
        if len(open_) >= _DEEPEST:
            continue
        content = name in _CONTENT
        if content:
            for e in open_:
                e["around"] = True
        main += content
        attributes = m[4] or m[7] or ""
        open_.append({"name": name, "said": said_words(attributes) if attributes else [], "words": 0, "linked": 0,
                      "main": main > 0, "content": content, "around": content})
    text(html[at:])
    for e in open_:
        ended(e)
    return inside, outside


def learn(pages: list[str]) -> dict[str, float]:
    """Log-odds of standing inside the marked content of labelled pages, as the scan needs them.

    Keys: "" a word of text, a tag's name, ``<name`` the tag under the words
    it carries, ``.word`` a word of class, id or role.  A word that says
    furniture can't lose that weight: an advert stands in articles too.
    """
    said_in, said_out = Counter(), Counter()
    for html in pages:
        a, b = class_evidence(html)
        said_in.update(a), said_out.update(b)
    weights = {}
    for w in {*said_in, *said_out}:
        odds = math.log(said_in[w] + 1) - math.log(said_out[w] + 1) + prior(w)
        weights["." + w] = min(odds, SAYS) if prior(w) == SAYS else odds
    inside, outside = Counter(), Counter()
    for html in pages:
        for p in pieces(html, weights):
            if p.kind != "skip":
                (inside if p.main else outside)["" if p.kind == "text" else p.value] += p.words if p.kind == "text" else 1
    total_in, total_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    odds = {k: math.log((inside[k] + 0.5) / total_in) - math.log((outside[k] + 0.5) / total_out) for k in {*inside, *outside, ""}}
    weights |= {k: max(v, 0.1) if k == "" else min(v, -LEAST) for k, v in odds.items()}
    return weights | {"<" + k: min(max(v, 0.0), MOST_TAG) for k, v in odds.items() if k}


def best_region(found: list[Piece], weights: dict[str, float]) -> tuple[int, int]:
    """Start and past of the contiguous pieces with the largest score; the first such region, (0, 0) if none is above 0.

    The learned weights alone choose it.  A mark only trims it: where most of
    its words stand in ``article`` or ``main`` elements, it ends with them.
    """
    word = weights.get("", 1.0)
    best, region, run, start = 0.0, (0, 0), 0.0, 0
    for i, p in enumerate(found):
        if p.kind == "tag":
            run += weights.get(p.value, -UNSEEN)
        elif p.kind == "text":
            run += p.words * word
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, region = run, (start, i + 1)
    a, z = region
    marked = [i for i in range(a, z) if found[i].kind == "text" and found[i].main and found[i].words]
    if 2 * sum(found[i].words for i in marked) > sum(p.words for p in found[a:z] if p.kind == "text"):
        region = marked[0], marked[-1] + 1
    return region


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best region, one a line; empty if there is none."""
    if not html:
        return ""
    found = pieces(html, weights)
    a, z = best_region(found, weights)
    blocks, block = [], []
    for p in found[a:z]:
        if p.kind == "text":
            block.append(p.value)
        elif p.kind == "tag":
            if p.value == "br":
                block.append(" ")
            elif p.value not in _INLINE:
                blocks.append(block)
                block = []
    blocks.append(block)
    lines = (" ".join(unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def labelled_sample(pages: DataFrame, most: int = LABELLED) -> list[str]:
    """At most ``most`` pages that mark their content with exactly one element, by the smallest hashes of page_id."""
    marked = F.regexp_count("html", F.lit(r"(?i)<(?:article|main)[\s>]")) == 1
    rows = pages.where(marked).select(F.xxhash64(F.lit(4), "page_id").alias("h"), "html")
    n = rows.count()
    near = F.col("h") <= F.lit(-(2.0**63)) + F.lit(2.0**64) * min(1.0, (2.0 * most + 20) / max(1, n))
    return [r["html"] for r in rows.where(near).orderBy("h", "html").limit(most).collect()]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, by weights from its own labelled pages.

    Null, empty or text-free pages give an empty text.  Unclosed elements run
    to what ends them; repeated rows are extracted each; other columns are
    ignored; an empty table gives an empty result.
    """
    weights = learn(labelled_sample(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), weights) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string, n_chars long")


def op4_html_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of `pages`."""
    return extract(table(spark, sf_dir, "pages"))
