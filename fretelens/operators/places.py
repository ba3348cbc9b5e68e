"""City linking (D6): words after "cidade de", "para" and "em" joined to a gazetteer table.

The gazetteer is a table of (city, state) of any size; the towns that
:mod:`extract` knows by itself need none.  Every place keyword of a request
gives a span of words; the leading n-grams of the spans are equi-joined to the
folded city names as in :mod:`link`, the longest hit of a span wins.  A span
after "cidade de" outweighs the others; two different cities give none.
Names of states stay with the state rules ("para São Paulo" is a state).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions.text import LB, RB, ci, fold_py, squash
from .extract import LINKED, mask_negation
from .link import linked_names, name_key

KIND = "cidade"
_EXPLICIT = ci(LB + r"cidade\s+d[eo]\s+")
_PLAIN = ci(LB + r"(?:para|em)\s+(?!(?:a\s+)?cidade" + RB + ")")


def place_dimension(gazetteer: DataFrame, city: str = "city", state: str = "state") -> DataFrame:
    """(kind, name_key, name, states): one row per folded city name, with the states that have such a city."""
    g = gazetteer.select(F.lit(KIND).alias("kind"), F.col(city).alias("name"), F.upper(F.trim(state)).alias("state"))
    g = g.withColumn("name_key", name_key("name")).where(F.length("name_key") > 0)
    return (g.where(~F.col("name_key").isin([fold_py(s) for s in D.STATE_NAMES]))
             .groupBy("kind", "name_key").agg(F.min("name").alias("name"), F.sort_array(F.collect_set("state")).alias("states")))


def place_spans(text: Column, most_words: int) -> Column:
    """Array of (explicit, words): the words after each place keyword up to a clause mark, negated ones left out."""
    said = mask_negation(F.coalesce(text, F.lit("")))

    def after(pattern: str, explicit: bool) -> Column:
        parts = F.split(said, pattern)
        cut = lambda p: F.array_join(F.slice(F.split(squash(F.regexp_extract(p, r"^[^,;!?]*", 0)), " "), 1, most_words), " ")
        return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.lit(explicit).alias("explicit"), cut(p).alias("words")))

    return F.filter(F.concat(after(_EXPLICIT, True), after(_PLAIN, False)), lambda s: s["words"] != "")


def linked_places(spans: DataFrame, places: DataFrame, most_words: int) -> DataFrame:
    """Of distinct span arrays (``_places``): linked_cidade, name_cidade (as written), city_states and city_conflict."""
    one = spans.select("_places", F.explode(F.array_distinct("_places")).alias("s")).select("_places", "s.explicit", "s.words")
    names = linked_names(one.select(F.lit(KIND).alias("kind"), "words").distinct(), places.select("kind", "name_key", "name"), most_words)
    hits = one.join(names.drop("kind"), "words").join(places.select("name", "states"), "name")
    written = F.regexp_replace(F.array_join(F.slice(F.split("words", " "), 1, F.col("n_words")), " "), r"[.'\"]+$", "")
    hit = F.struct("name", written.alias("written"), "states")
    sets = hits.groupBy("_places").agg(F.collect_set(F.when(F.col("explicit"), hit)).alias("e"), F.collect_set(F.when(~F.col("explicit"), hit)).alias("p"))
    chosen = F.sort_array(F.when(F.size("e") > 0, F.col("e")).otherwise(F.col("p")))
    several = F.size(F.array_distinct(F.transform(chosen, lambda h: h["name"]))) > 1
    return sets.select("_places", F.when(~several, chosen[0]).alias("h"), several.alias("city_conflict")).select(
        F.col("_places").alias("_on_places"), F.col("h.name").alias("linked_cidade"), F.col("h.written").alias("name_cidade"),
        F.col("h.states").alias("city_states"), "city_conflict")


def link_places(df: DataFrame, base: DataFrame, places: DataFrame, most_words: int) -> DataFrame:
    """Adds the columns of :func:`linked_places` to ``df``; ``base`` is a written table with the same ``_places``.

    The spans themselves are the join key, as names are in :mod:`link`.  A
    city whose words stand in a linked customer's or carrier's name only is
    not one.
    """
    found = linked_places(base.select("_places").where(F.size("_places") > 0).distinct(), places, most_words)
    # rows without a span spread over all partitions instead of meeting on one key
    alone = F.array(F.struct(F.lit(False).alias("explicit"), F.concat(F.lit("\u0000"), F.xxhash64("request_id", "ts").cast("string")).alias("words")))
    df = df.withColumn("_key_places", F.when(F.size("_places") > 0, F.col("_places")).otherwise(alone))
    df = df.join(found, F.col("_key_places") == F.col("_on_places"), "left")
    rest = squash(F.col("enhanced_query"))
    for kind in ("cliente", "transportadora"):
        name = F.col(f"name_{kind}")
        rest = F.when(name.isNotNull(), F.replace(rest, name, F.lit(LINKED))).otherwise(rest)
    stands = F.coalesce(F.contains(rest, F.col("name_cidade")), F.lit(False))
    df = df.withColumns({c: F.when(stands, F.col(c)) for c in ("linked_cidade", "name_cidade", "city_states")})
    return df.withColumn("city_conflict", F.coalesce("city_conflict", F.lit(False))).drop("_places", "_key_places", "_on_places")


def settle_city(df: DataFrame) -> DataFrame:
    """The linked city and the one the rules read become one ``x_city``; two different ones give none."""
    linked, read = F.col("linked_cidade"), F.col("x_city")
    city = F.when(F.col("city_conflict"), None).when(linked.isNull(), read).when(read.isNull() | (read == linked), linked)
    return df.withColumn("x_city", city)


def city_ambiguous() -> Column:
    """Whether the record's city lies in several states and the request names none of them."""
    held = F.coalesce(F.array_contains("city_states", F.col("UFDestino")), F.lit(False))
    return F.coalesce((F.col("CidadeDestino") == F.col("linked_cidade")) & (F.size("city_states") > 1) & ~held, F.lit(False))
