"""Request gate and normalisation.

All steps are column expressions over the request table: one projection,
no Python per row.  The output column ``enhanced_query`` plays the role of
the service's normalised sentence; extraction reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions.text import LB, RB, ci, fold, fold_text, loose, squash, squash_text, word
from . import lexicon as L

_COMMENT = r"\s#(?!\s*\p{N}).*$"


def _clean(df: DataFrame, query_col: str) -> DataFrame:
    """Adds ``query_clean``, as :func:`strip_comment` gives it."""
    q = F.col(query_col)
    df = df.withColumn("_noted", F.when(F.contains(q, F.lit("#")), F.regexp_replace(q, _COMMENT, "")).otherwise(q))
    return df.withColumn("query_clean", squash_text("_noted")).drop("_noted")


def strip_comment(col: Column) -> Column:
    """Drop an inline ``# ...`` note (never a number sign before a digit) and squash whitespace."""
    return squash(F.regexp_replace(col, _COMMENT, ""))


def is_blank(col: Column) -> Column:
    """B1: null, empty or whitespace-only (any Unicode space)."""
    return col.isNull() | ~col.rlike(r"(?U)\S")


# B7 + B2: abbreviations.  A leading preposition is absorbed so that
# "notas para SP" does not become "para para o estado de São Paulo".
_ABBREV_RULES = [
    (ci(LB + r"(cidade\s+d[eo]\s+)sp" + RB), "$1São Paulo"),
    (ci(LB + "nf" + RB), "nota fiscal"),
    (ci(LB + r"(?:(?:para|em|no|de|do)\s+(?:o\s+)?)?sp" + RB), "para o estado de São Paulo"),
    (ci(LB + r"(?:d[oa]\s+)?cli" + RB), "do cliente"),
    (ci(LB + r"(?:d[oa]\s+)?transp" + RB), "da transportadora"),
    (ci(word("ult sem")), "última semana"),
]


#: The abbreviations as whole words of a folded text; letters of ``L.ODD_LETTERS`` may stand for one.
_ABBREVIATED = r"(?<![a-z0-9])(?:s(?:p|em)|nf|cli|transp|ult)(?![\p{L}\p{N}])|[" + "".join(L.ODD_LETTERS) + "]"


def expand_abbreviations(col: Column, folded: Column | None = None) -> Column:
    out = col
    for pattern, repl in _ABBREV_RULES:
        out = F.regexp_replace(out, pattern, repl)
    f = fold(col) if folded is None else folded
    return F.when(L.guard(f, ["nf", "sp", "cli", "transp", "ult"]) & f.rlike(_ABBREVIATED), out).otherwise(col)


def _concept_values(col: Column, concept: str, folded: Column | None = None) -> Column:
    return L.distinct_values(col, L.LEXICON[concept], L.guard(folded, L.GUARDS[concept]), folded)


_CONCEPT_ORDER = ("performance", "situation", "sort")


def _rewrite(col: Column, concept: str) -> Column:
    out = col
    for phrase, canonical, c, _ in sorted(D.SYNONYMS, key=lambda s: -len(s[0])):
        if c == concept:
            # "com" already in front of a phrase whose canonical form starts with "com" is absorbed
            if concept == "sort":  # any form of the verb stands for the listed one
                verb, rest = phrase.split(" ", 1)
                body = loose(verb[:-1]).rstrip() + r"(?:r|d[ao]s?|ndo)?\s+" + loose(rest).replace(loose("pelo"), r"pel[ao]s?")
                out = F.regexp_replace(out, ci(LB + body + r"s?" + RB), canonical)
                continue
            lead = r"(?:com\s+)?" if canonical.startswith("com ") and not phrase.startswith("com ") else ""
            out = F.regexp_replace(out, ci(LB + lead + "(?:" + loose(phrase, inflect=True) + ")" + RB), canonical)
    return out


def map_synonyms(df: DataFrame, src: str, dst: str) -> DataFrame:
    """B3 with the B4 guard: rewrite synonyms longest first, except for a
    concept asked with two different values (then all of that concept is
    left as written).  B5 holds because only the listed phrases are
    rewritten; a bare event word is never touched.  One column per concept
    keeps the expression tree linear."""
    df = df.withColumn("_fsyn", fold_text(src))
    df = df.withColumns({f"_may_{c}": L.guard(F.col("_fsyn"), L.GUARDS[c]) for c in _CONCEPT_ORDER})
    folded = L.Held(F.col("_fsyn"), {tuple(L.GUARDS[c]): F.col(f"_may_{c}") for c in _CONCEPT_ORDER}, L.guard(F.col("_fsyn"), L.ODD_LETTERS))
    df = df.withColumns({f"_amb_{c}": F.size(_concept_values(F.col(src), c, folded)) > 1 for c in _CONCEPT_ORDER})
    prev = src
    for c in _CONCEPT_ORDER:
        skip = F.col(f"_amb_{c}") | ~F.col(f"_may_{c}")
        df = df.withColumn(f"_syn_{c}", F.when(skip, F.col(prev)).otherwise(_rewrite(F.col(prev), c)))
        prev = f"_syn_{c}"
    df = df.withColumn(dst, F.col(prev))
    return df.drop("_fsyn", *[f"{what}_{c}" for what in ("_may", "_amb", "_syn") for c in _CONCEPT_ORDER])


def sentence_shape(col: Column) -> Column:
    """Capital first letter, tone (question / command) kept."""
    return F.concat(F.upper(F.substring(col, 1, 1)), F.substring(col, 2, 1 << 30))


def normalize(df: DataFrame, query_col: str = "query") -> DataFrame:
    """Adds ``query_clean``, ``blank`` and ``enhanced_query``."""
    q = F.col(query_col)
    df = _clean(df.withColumn("blank", is_blank(q)), query_col).withColumn("_fclean", fold_text("query_clean"))
    df = df.withColumn("_expanded", expand_abbreviations(F.col("query_clean"), F.col("_fclean")))
    df = map_synonyms(df, "_expanded", "_mapped")
    df = df.withColumn("_shaped", sentence_shape(F.col("_mapped")))
    return df.withColumn("enhanced_query", F.when(F.col("blank"), F.lit(None)).otherwise(squash_text("_shaped"))) \
             .drop("_fclean", "_expanded", "_mapped", "_shaped")


def concepts(col: Column, masked: Column, folded: Column) -> Column:
    """Concept tags (``kind:value``) present in a text, for B8.  Event and
    period words inside a status phrase belong to that phrase (the longest
    phrase wins), and "janeiro" in "Rio de Janeiro" is no month, so they are
    read in ``masked``, where status phrases and place names are blanked
    (:func:`_status_and_places_masked`; a column, as many patterns read it)."""
    def tag(kind: str):
        return lambda v: F.concat(F.lit(kind + ":"), v)

    parts = [
        F.transform(L.distinct_values(masked if kind in ("event", "period") else col, L.LEXICON[kind], L.may_hold(folded, L.GUARDS[kind]), folded), tag(kind))
        for kind in ("situation", "performance", "sort", "event", "period")
    ]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))


def _status_and_places_masked(col: Column, folded: Column | None = None) -> Column:
    """Status phrases and place names blanked; given the folded text, only where it holds a word they need."""
    from .extract import CITY_EXPLICIT, COLLIDING, PLACE_HINT, STATE_NAME, TOWN
    needs = {k: None if folded is None else L.may_hold(folded, L.GUARDS[k]) for k in ("performance", "situation")}
    status = L.mask(L.mask(col, L.LEXICON["performance"], needs["performance"]), L.LEXICON["situation"], needs["situation"])
    out = status
    for p in (CITY_EXPLICIT, STATE_NAME, TOWN):
        out = F.regexp_replace(out, p, " ")
    if folded is None:
        return out
    place = folded.rlike(PLACE_HINT + "|[" + "".join(L.ODD_LETTERS) + "]")
    for name in COLLIDING:
        place = place | F.lower(col).contains(name)
    return F.when(place, out).otherwise(status)


def protected_events(col: Column) -> Column:
    """The date-event code named in a text outside status phrases."""
    return L.first_value(_status_and_places_masked(col), L.LEXICON["event"])


def preservation_audit(df: DataFrame) -> DataFrame:
    """Concepts before vs after normalisation, lost and added per kind."""
    x = df.select("request_id", "query_clean", "enhanced_query", fold("query_clean").alias("_clean_folded"), fold("enhanced_query").alias("_enhanced_folded"))
    x = x.select("*", _status_and_places_masked(F.col("query_clean"), F.col("_clean_folded")).alias("_clean_masked"),
                 _status_and_places_masked(F.col("enhanced_query"), F.col("_enhanced_folded")).alias("_enhanced_masked"))
    x = x.select(
        "request_id",
        concepts(F.col("query_clean"), F.col("_clean_masked"), F.col("_clean_folded")).alias("before"),
        concepts(F.col("enhanced_query"), F.col("_enhanced_masked"), F.col("_enhanced_folded")).alias("after"),
    )
    x = x.select(
        "request_id",
        F.explode(F.array(
            F.struct(F.lit("kept").alias("what"), F.array_intersect("before", "after").alias("tags")),
            F.struct(F.lit("lost").alias("what"), F.array_except("before", "after").alias("tags")),
            F.struct(F.lit("added").alias("what"), F.array_except("after", "before").alias("tags")),
        )).alias("s"),
    ).select("request_id", "s.what", F.explode("s.tags").alias("tag"))
    x = x.withColumn("kind", F.substring_index("tag", ":", 1))
    return x.groupBy("kind").agg(
        F.count_if(F.col("what") == "kept").alias("n_kept"),
        F.count_if(F.col("what") == "lost").alias("n_lost"),
        F.count_if(F.col("what") == "added").alias("n_added"),
    )
