"""Request table -> filter records (the whole rule path, D12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import FILTER_FIELDS
from ..session import written
from .extract import extract, name_spans
from .link import link_entities, link_rowwise, longest_name
from .normalize import normalize
from .outcome import classify_outcome
from .places import city_ambiguous, link_places, place_spans, settle_city
from .resolve import resolve


RESULT = ["anchor", "calendar", "enhanced_query", *FILTER_FIELDS, "status", "outcome", "detail",
          "cliente_unlinked", "transportadora_unlinked"]


def settled(df: DataFrame, own: list[str], columns: list[str]) -> DataFrame:
    """``own`` as they are and ``columns`` behind a boundary that no predicate crosses.

    The optimizer moves a filter below a projection by putting the projection's
    expressions into it, layer by layer; through the rule layers that grows
    exponentially.  Generator output stays where it is, so a filter on a
    resolved field costs no planning time; filters on ``own`` still go down.
    """
    return df.select(*own, F.inline(F.array(F.struct(*columns))))


def parse_requests(requests: DataFrame, dimension: DataFrame | None = None, keep: bool = False,
                   partitions: int | None = None, most_words: int | None = None,
                   columns: list[str] | None = None, places: DataFrame | None = None) -> DataFrame:
    """Normalise, bind calendar, extract, link, resolve and classify.

    ``requests`` needs ``request_id``, ``ts`` and ``query``.  With
    ``dimension`` (see :func:`link.entity_dimension`) names are linked to the
    customer/carrier tables; without it the written name is kept.  With
    ``places`` too (see :func:`places.place_dimension`) cities are linked to
    that gazetteer and ``city_ambiguous`` is added.  With
    ``keep`` the intermediate columns stay (trace use); ``columns`` names the
    result or intermediate columns wanted beside the request's own, so that
    nothing else is computed.

    The rule projection costs CPU, not bytes: after a join AQE would fold a
    small request table into one or two partitions.  ``partitions`` spreads
    the rows round-robin first (AQE keeps an explicit count).
    """
    if partitions:
        requests = requests.repartition(partitions)
    df = requests.withColumn("anchor", F.to_date("ts"))
    df = normalize(df)
    if places is not None and dimension is None:
        raise ValueError("cities are linked beside names: give a dimension too")
    if dimension is not None:
        # names first: a linked name's own words (places, dates, statuses) must not fill other fields
        df = name_spans(df, "enhanced_query")
        if places is not None:
            most_place = longest_name(places)
            df = df.withColumn("_places", place_spans(F.col("enhanced_query"), most_place))
        # a written table: the link reads the normalised rows more than once, and
        # the optimizer would else inline one rule projection into the other
        base = df = written(df)
        spans = {"x_cli_tokens": F.col("_cli_tokens"), "x_tr_tokens": F.col("_tr_tokens")}
        df = link_entities(df, dimension, {"cliente": spans["x_cli_tokens"], "transportadora": spans["x_tr_tokens"]}, most_words)
        df = extract(df) if places is None else settle_city(extract(link_places(df, base, places, most_place)))
    else:
        df = extract(df)
        df = df.withColumns({"linked_cliente": F.lit(None).cast("string"),
                             "linked_transportadora": F.lit(None).cast("string")})
    return _result(df, requests, keep, columns)


def parse_stream(requests: DataFrame, dimension: DataFrame, most_words: int, columns: list[str] | None = None) -> DataFrame:
    """:func:`parse_requests` as one stateless plan: no aggregate, no written
    table, so it runs on a stream (or a batch) as it is.  ``most_words`` is the
    word count of the longest name of the (static) dimension."""
    df = normalize(requests.withColumn("anchor", F.to_date("ts")))
    df = name_spans(df, "enhanced_query")
    # join keys come from behind a boundary: their null checks would else be pushed through the rules
    df = settled(df, requests.columns, [c for c in df.columns if c not in requests.columns])
    df = link_rowwise(df, dimension, {"cliente": F.col("_cli_tokens"), "transportadora": F.col("_tr_tokens")}, most_words)
    return _result(extract(df), requests, False, columns)


def _result(df: DataFrame, requests: DataFrame, keep: bool, columns: list[str] | None) -> DataFrame:
    """Extracted rows resolved, classified and settled."""
    df = classify_outcome(resolve(df)).withColumns({
        "cliente_unlinked": F.col("linked_cliente").isNull() & F.col("Cliente").isNotNull(),
        "transportadora_unlinked": F.col("linked_transportadora").isNull() & F.col("Transportadora").isNotNull()})
    found = RESULT
    if "linked_cidade" in df.columns:
        df, found = df.withColumn("city_ambiguous", city_ambiguous()), [*RESULT, "city_ambiguous"]
    if not columns:
        columns = [c for c in df.columns if c not in requests.columns] if keep else found
    return settled(df, requests.columns, columns)
