"""Registered queries: (spark, sf_dir) -> DataFrame, one per operator key.

Every query reads the driver tables (or data Spark derives from them) in
full.  Dates leave as ISO text so results compare across engines.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import CALENDAR_FIELDS
from ..functions.dictionaries import FILTER_FIELDS
from ..operators import normalize as N
from ..operators import match as M
from ..operators.link import entity_dimension
from ..operators.outcome import all_null, render_inputs, to_filter_json
from ..operators.parse import parse_requests
from ..session import apply_job_conf, checkpoint_dir, written
from ..sources.request_templates import N_TEMPLATES
from ..sources.requests import render_requests
from ..sources.shipments import shipments
from ..sources.tables import table


def ships(spark: SparkSession, sf: str) -> DataFrame:
    apply_job_conf(spark)
    return shipments(spark, sf)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return render_requests(ships(spark, sf))


def dimension(spark: SparkSession, sf: str) -> DataFrame:
    return entity_dimension(table(spark, sf, "customer"), table(spark, sf, "supplier"))


def parse_parallelism(spark: SparkSession) -> int:
    """Tasks for the CPU-bound rule projection: two per core."""
    return max(2 * spark.sparkContext.defaultParallelism, 8)


def parsed(spark: SparkSession, sf: str, keep: bool = False, columns: list[str] | None = None) -> DataFrame:
    return parse_requests(requests(spark, sf), dimension(spark, sf), keep=keep, partitions=parse_parallelism(spark), columns=columns)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage into the cluster's shared folder (reused inputs)."""
    return written(df)


def matches(spark: SparkSession, sf: str, rules: DataFrame | None = None) -> DataFrame:
    """Parsed requests x shipments (inputs materialised once inside); with ``rules`` only pairs they may open."""
    specs = parsed(spark, sf).select("request_id", "anchor", "user_id", *FILTER_FIELDS, "status")
    return M.match_requests(specs if rules is None else M.within_rules(specs, rules), ships(spark, sf))


def iso(df: DataFrame) -> DataFrame:
    """Dates and timestamps leave as ISO text (the service's JSON form)."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if t == "date":
            out.append(F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name))
        elif t.startswith("timestamp"):
            out.append(F.date_format(F.col(f.name), "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def project(*cols):
    """Key that keeps some columns of the parsed table (``(src, alias)`` renames)."""
    def q(spark, sf):
        sel = [F.col(c) if isinstance(c, str) else F.col(c[0]).alias(c[1]) for c in cols]
        names = [c if isinstance(c, str) else c[0] for c in cols]
        return iso(parsed(spark, sf, columns=names).select("request_id", *sel))
    return q


RECORD = [*FILTER_FIELDS, "status", "outcome"]


# ---------------------------------------------------------------- sources --
def q_request_scan(spark, sf):
    """A2: the request table (id, time, user, text)."""
    return iso(requests(spark, sf))


def q_shipments(spark, sf):
    """A5: the shipments view."""
    return iso(ships(spark, sf))


def q_filter_json(spark, sf):
    """One JSON object per request, all 14 keys, NULLs written out."""
    p = parsed(spark, sf)
    return p.select("request_id", to_filter_json(p).alias("filter_json"))


# ------------------------------------------------------------ normalising --
def q_expand_abbrev(spark, sf):
    """B2 (+B7): abbreviations expanded, text otherwise untouched."""
    r = requests(spark, sf)
    return r.select("request_id", N.expand_abbreviations(N.strip_comment(F.col("query"))).alias("expanded"))


def q_ambiguity_guard(spark, sf):
    """Concepts asked with two different values (left untranslated)."""
    r = requests(spark, sf).select("request_id", N.expand_abbreviations(N.strip_comment(F.col("query"))).alias("t"))
    return r.select("request_id", *[(F.size(N._concept_values(F.col("t"), c)) > 1).alias(f"ambiguous_{c}")
                                    for c in ("situation", "performance", "sort")])


def q_protected_terms(spark, sf):
    """Event word before and after normalisation (must be equal)."""
    p = parsed(spark, sf, columns=["query_clean", "enhanced_query"])
    return p.select("request_id", N.protected_events(F.col("query_clean")).alias("event_before"),
                    N.protected_events(F.col("enhanced_query")).alias("event_after"))


def q_sentence_shape(spark, sf):
    """Normalised text starts upper-case and keeps the question mark."""
    p = parsed(spark, sf, columns=["enhanced_query"])
    e = F.col("enhanced_query")
    return p.select("request_id",
                    (F.substring(e, 1, 1) == F.upper(F.substring(e, 1, 1))).alias("starts_upper"),
                    e.endswith("?").alias("is_question"))


def q_preservation_audit(spark, sf):
    """Concept tags kept / lost / added by normalisation, per kind."""
    return N.preservation_audit(parsed(spark, sf, columns=["query_clean", "enhanced_query"]))


# --------------------------------------------------------------- calendar --
def q_calendar_bounds(spark, sf):
    """The ten calendar dates of every request's own date."""
    p = parsed(spark, sf, columns=["calendar"])
    return iso(p.select("request_id", *[F.col("calendar")[c].alias(c) for c in CALENDAR_FIELDS]))


def q_explicit_range(spark, sf):
    """Explicit dates and day ranges."""
    p = parsed(spark, sf, columns=["x_explicit"])
    return iso(p.select("request_id", F.col("x_explicit.DE").alias("DE"), F.col("x_explicit.ATE").alias("ATE")))


def q_extended_period(spark, sf):
    """C2 + C4 before resolution: calendar words, amanhã, últimos N dias, months."""
    p = parsed(spark, sf, columns=["x_named"])
    return iso(p.select("request_id", F.col("x_named.DE").alias("DE"), F.col("x_named.ATE").alias("ATE")))


def q_extract_event(spark, sf):
    """Event code found in the text (before the event+period rule)."""
    return parsed(spark, sf, columns=["x_event"]).select("request_id", F.col("x_event").alias("event"))


def q_link(kind: str):
    def q(spark, sf):
        p = parsed(spark, sf, columns=[kind.capitalize(), f"linked_{kind}"])
        return p.select("request_id", F.col(kind.capitalize()), F.col(f"linked_{kind}").alias("linked_name"))
    q.__doc__ = f"D3/D4: {kind} name linked to its dimension (longest match)."
    return q


# ------------------------------------------------------------------ rules --
def q_field_cooccurrence(spark, sf):
    """E5: how often two filter fields are filled together (one pass)."""
    p = parsed(spark, sf, columns=FILTER_FIELDS)
    pairs = list(combinations(FILTER_FIELDS, 2))
    agg = p.agg(*[F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"{a}|{b}") for a, b in pairs])
    stacked = ", ".join(f"'{a}', '{b}', `{a}|{b}`" for a, b in pairs)
    return (agg.select(F.expr(f"stack({len(pairs)}, {stacked}) AS (field_a, field_b, n)"))
               .where(F.col("n") > 0))


def q_rule_nf_exclusive(spark, sf):
    """With an NF no other field is filled."""
    p = parsed(spark, sf, columns=FILTER_FIELDS)
    others = sum(F.col(f).isNotNull().cast("int") for f in FILTER_FIELDS if f != "NF")
    return p.select("request_id", "NF", others.alias("n_other"))


def q_rule_time_priority(spark, sf):
    """Explicit dates decide DE/ATE first."""
    p = parsed(spark, sf, columns=["DE", "ATE", "x_explicit"])
    return iso(p.select("request_id", "DE", "ATE", F.col("x_explicit").isNotNull().alias("explicit_used")))


def q_rule_scope(spark, sf):
    """Out-of-domain text yields no filter."""
    p = parsed(spark, sf, columns=["x_domain", "x_op", "x_nf", "x_cnpj", "outcome"])
    scope = F.col("x_domain") | F.col("x_op").isNotNull() | F.col("x_nf").isNotNull() | F.col("x_cnpj").isNotNull()
    return p.select("request_id", scope.alias("in_scope"), "outcome")


def q_rule_scope_conversations(spark, sf):
    """E11 on real out-of-domain text: every user turn of ``conversations``
    is parsed; none may yield a filter."""
    conv = table(spark, sf, "conversations").where(F.col("role") == "user")
    req = conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
                      F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
                      F.lit(0).cast("bigint").alias("user_id"), F.col("text").alias("query"))
    p = parse_requests(req, dimension(spark, sf), partitions=parse_parallelism(spark))
    filled = sum(F.col(f).isNotNull().cast("int") for f in FILTER_FIELDS)
    return p.select("request_id", "outcome", filled.alias("n_filled"))


def q_all_null(spark, sf):
    """every filter field NULL."""
    return parsed(spark, sf).select("request_id", all_null().alias("all_null"))


def q_trace_requests(spark, sf):
    """query, calendar, normalised query and filters per request."""
    p = parsed(spark, sf, columns=["calendar", "enhanced_query", *FILTER_FIELDS])
    return iso(p.select("request_id", "query", *[F.col("calendar")[c].alias(c) for c in CALENDAR_FIELDS],
                        "enhanced_query", to_filter_json(p).alias("parsed_json")))


def q_render_inputs(spark, sf):
    """generation input rendered per request."""
    return render_inputs(parsed(spark, sf))


# --------------------------------------------------------------- matching --
APPLY_TEXT = "notas em trânsito para MG emitidas de 01/01/1997 até 31/12/1997"


def q_apply_filters(spark, sf):
    """G1: one request's filters as a pushed-down predicate on all shipments."""
    req = spark.createDataFrame([(0, None, 0, APPLY_TEXT)], "request_id bigint, ts timestamp_ntz, "
                                                            "user_id bigint, query string")
    spec = parse_requests(req).first().asDict()        # one row: the record
    out = M.apply_filters(ships(spark, sf), spec)
    return iso(out.select("nf", "valor_nf", "data_emissao", "cliente", "uf_destino", "situacao_nf"))


def q_event_dates(spark, sf):
    """Six event dates per shipment as rows."""
    from ..sources.shipments import event_dates
    return iso(event_dates(ships(spark, sf)))


def q_match_requests(spark, sf):
    """Every request against every shipment."""
    return matches(spark, sf).select("request_id", "nf")


def q_deadline_status(spark, sf):
    """Status of every shipment at the latest issue date."""
    s = ships(spark, sf)
    at = s.agg(F.max("data_emissao")).first()[0]       # one scalar
    st = M.deadline_status(F.col("data_prevista"), F.col("data_entrega").isNotNull(), F.lit(at))
    return s.select("nf", st.alias("status"))


def q_ranked_results(spark, sf):
    """Matches ranked per request in the request's sort order."""
    return M.ranked_results(matches(spark, sf), ["request_id", "nf"]).select("request_id", "nf", "rank")


def q_entitled_results(spark, sf):
    """Matches the requesting user may see."""
    rules = M.nation_rules(table(spark, sf, "events"))
    return M.entitled_results(matches(spark, sf, rules), rules).select("request_id", "nf")


def q_formatted_results(spark, sf):
    """Ranked rows in presentation form."""
    return M.formatted_results(M.ranked_results(matches(spark, sf), M.SHOWN_COLUMNS))


# ----------------------------------------------------- logs, outputs, eval --
def q_phrase_scan(spark, sf):
    """A1: request lines of a text corpus (documents, whole texts)."""
    from ..sources.phrases import phrase_lines
    return phrase_lines(table(spark, sf, "documents"), "doc_id", "text")


def log_records(spark, sf):
    from ..sources.logs import parse_log_records, render_log_lines
    return parse_log_records(render_log_lines(table(spark, sf, "events")))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of this run under the cluster's shared one."""
    import uuid
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def corpus(spark, sf):
    """Requests of a corpus file with sections: (request_id, ts, user_id, query, suite_no, suite)."""
    from ..sources.phrases import land_corpus, read_suites
    r = requests(spark, sf)
    path = land_corpus(r, (F.floor(F.col("request_id") % N_TEMPLATES / 4) + 1).cast("int"), scratch(spark, "corpus"))
    lines = read_suites(spark, f"{path}/part=*/")
    lines = lines.withColumn("request_id", F.regexp_extract("text", r"# caso (\d+)$", 1).cast("bigint"))
    return lines.join(r.select("request_id", "ts", "user_id"), "request_id").select(
        "request_id", "ts", "user_id", F.col("text").alias("query"), "suite_no", "suite")


def q_suite_coverage(spark, sf):
    """H2: filled fields by section of the corpus."""
    from ..operators.evaluate import suite_coverage
    p = parse_requests(corpus(spark, sf), dimension(spark, sf), partitions=parse_parallelism(spark), columns=[*FILTER_FIELDS, "outcome"])
    return suite_coverage(p)


def q_suite_accuracy(spark, sf):
    """H1: parsed corpus lines against their labels, by section and field."""
    from ..operators.evaluate import suite_accuracy
    from ..sources.requests import render_labels
    p = parse_requests(corpus(spark, sf), dimension(spark, sf), partitions=parse_parallelism(spark), columns=FILTER_FIELDS)
    return suite_accuracy(p, render_labels(ships(spark, sf)))


def q_log_files_scan(spark, sf):
    """A3: the service log from files, read in splits of 64 KB."""
    from ..sources.log_reader import scan_logs
    from ..sources.logs import land_log
    path = land_log(table(spark, sf, "events"), scratch(spark, "log"))
    r = scan_logs(spark, f"{path}/file=*/part-*", split_bytes=64 << 10)
    return r.withColumns({"file": F.regexp_extract("file", "file=([^/]*)", 1), "ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")})


def q_log_scan(spark, sf):
    """A3: service-log records, tracebacks folded into their record."""
    r = log_records(spark, sf)
    return r.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"))


def outputs(spark, sf):
    from ..sources.outputs import render_outputs
    # reading an output costs CPU, not bytes: after the joins AQE would fold a small table into one or two tasks
    return render_outputs(ships(spark, sf).repartition(parse_parallelism(spark)))


def q_recover_block(spark, sf):
    """JSON block after the last marker of each generated text."""
    from ..operators.outcome import recover_block
    return outputs(spark, sf).select("request_id", recover_block(F.col("raw_text")).alias("block"))


OUTPUT_FIELDS = ["NF", "DE", "ATE", "TipoData", "Cliente", "UFDestino", "Operacao", "SituacaoNF"]


def q_output_parse(spark, sf):
    """F5 (+E12): typed fields, quarantine flag and status per output."""
    from ..operators.outcome import output_parse
    o = output_parse(outputs(spark, sf))
    return iso(o.select("request_id", "parse_ok", "all_null", "status",
                        F.size("invalid_fields").alias("n_invalid"), *OUTPUT_FIELDS))


def q_domain_report(spark, sf):
    """Values outside their field's domain, per field."""
    from ..operators.outcome import domain_report, output_parse
    return domain_report(output_parse(outputs(spark, sf)))


def q_generate_stub(spark, sf):
    """2.J: a texts -> texts generator slot (mapInPandas) between render
    and recovery; the local stub answers every prompt with an empty JSON."""
    from ..operators.generate import attach_generator, empty_json_stub
    from ..operators.outcome import output_parse, render_inputs
    gen = attach_generator(render_inputs(parsed(spark, sf)), empty_json_stub)
    return output_parse(gen).select("request_id", "status")


def q_regenerate_outputs(spark, sf):
    """F5 + 2.J: outputs that don't parse go back to the generator, three passes at most."""
    from ..operators.generate import regenerate
    from ..sources.outputs import answering
    sh = materialize(ships(spark, sf))
    prompts = render_inputs(materialize(parsed(spark, sf, columns=["calendar", "enhanced_query"])))
    out = regenerate(prompts.withColumn("prompt", F.coalesce("prompt", F.lit(""))), answering(sh))
    return iso(out.select("request_id", "attempts", "parse_ok", "status", "error",
                          F.size("invalid_fields").alias("n_invalid"), *OUTPUT_FIELDS))


def q_field_accuracy(spark, sf):
    """H1: parsed records vs the corpus labels, per field."""
    from ..operators.evaluate import field_accuracy
    from ..sources.requests import render_labels
    return field_accuracy(parsed(spark, sf, columns=FILTER_FIELDS), render_labels(ships(spark, sf)))


def q_field_coverage(spark, sf):
    """H2: filled fields per outcome, rolled up."""
    from ..operators.evaluate import field_coverage
    return field_coverage(parsed(spark, sf, columns=["outcome", *FILTER_FIELDS]))


def q_vague_rate(spark, sf):
    """H3: hourly vague-request rate from the service log."""
    from ..operators.evaluate import vague_rate
    return iso(vague_rate(log_records(spark, sf)))


def q_vague_rate_by_endpoint(spark, sf):
    """H3: hourly vague rate of each endpoint; every fourth event came in at the debug endpoint."""
    from ..operators.evaluate import vague_rate_by_endpoint
    from ..sources.logs import parse_log_records, render_log_lines
    lines = render_log_lines(table(spark, sf, "events"), F.col("event_id") % 4 == 3)
    return iso(vague_rate_by_endpoint(parse_log_records(lines)))


def attempts(spark, sf):
    from ..sources.logs import attempt_log
    return attempt_log(table(spark, sf, "events"))


def q_latency_summary(spark, sf):
    """H4: response time by status."""
    from ..operators.evaluate import latency_summary
    return latency_summary(attempts(spark, sf))


def q_latency_quantiles(spark, sf):
    """H4: exact p50/p95/p99 by status."""
    from ..operators.evaluate import latency_quantiles
    return latency_quantiles(attempts(spark, sf))


def q_attempt_summary(spark, sf):
    """H5: attempts until success per request."""
    from ..operators.evaluate import attempt_summary
    return iso(attempt_summary(attempts(spark, sf)))


def q_attempt_waits(spark, sf):
    """H5: waits and early retries per request."""
    from ..operators.evaluate import attempt_waits
    return attempt_waits(attempts(spark, sf))


def q_link_city(spark, sf):
    """Cities of a gazetteer table (the nations' names as towns, every fifth of them in two states)."""
    from ..functions.dictionaries import STATES
    from ..operators.places import place_dimension
    nation = table(spark, sf, "nation")
    town, state = F.initcap("n_name"), F.element_at(F.lit(STATES), (F.col("n_nationkey") + 1).cast("int"))
    second = F.when(F.col("n_nationkey") % 5 == 0, F.element_at(F.lit(STATES), (F.col("n_nationkey") + 2).cast("int")))
    towns = nation.select("n_nationkey", town.alias("city"), state.alias("uf"))
    gazetteer = nation.select(town.alias("city"), F.explode(F.array(state, second)).alias("state")).where("state IS NOT NULL")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.expr("(o_orderkey DIV 4) % 25").alias("a"), F.expr("(o_orderkey DIV 4 + 1) % 25").alias("b"))
    o = (o.join(towns.select(F.col("n_nationkey").alias("a"), F.col("city").alias("t"), "uf"), "a")
          .join(towns.select(F.col("n_nationkey").alias("b"), F.col("city").alias("t2")), "b"))
    k = F.col("o_orderkey") % 4
    query = (F.when(k == 0, F.concat(F.lit("notas emitidas ontem para a cidade de "), "t"))
              .when(k == 1, F.concat(F.lit("notas retidas para "), F.upper("t"), F.lit(" em "), "uf"))
              .when(k == 2, F.concat(F.lit("notas em trânsito para "), "t", F.lit(" ou para "), "t2"))
              .otherwise(F.concat(F.lit("notas em trânsito exceto para "), "t")))
    req = o.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.lit(0).cast("long").alias("user_id"), query.alias("query"))
    got = parse_requests(req, dimension(spark, sf), partitions=parse_parallelism(spark), columns=["CidadeDestino", "UFDestino", "city_ambiguous"],
                         places=materialize(place_dimension(gazetteer)))
    return got.select("request_id", "CidadeDestino", "UFDestino", "city_ambiguous")


# -------------------------------------------------------------- streaming --
def q_stream_parse(spark, sf):
    """Requests arriving as a file stream, parsed per micro-batch."""
    from ..streaming import jobs as J
    feed = J.land(requests(spark, sf), J.run_folder(spark, "requests"))
    out = J.stream_parse(spark, feed, dimension(spark, sf), J.run_folder(spark, "parsed"),
                         J.run_folder(spark, "ckpt"), files_per_batch=2, partitions=parse_parallelism(spark))
    return iso(out.select("request_id", *RECORD))


def q_stream_vague_rate(spark, sf):
    """Hourly vague rate over the event stream, watermark 1 hour."""
    from ..streaming import jobs as J
    events = table(spark, sf, "events")
    feed = J.land(events, J.run_folder(spark, "events"))
    out = J.stream_vague_rate(spark, feed, events.schema, J.run_folder(spark, "rate"), J.run_folder(spark, "ckpt"))
    return iso(out)


def q_stream_late_rows(spark, sf):
    """Rates of closed windows and their late rows; every tenth event arrives after all others."""
    from ..streaming import jobs as J
    events = table(spark, sf, "events")
    feed = J.run_folder(spark, "events")
    J.land(events.where("event_id % 10 <> 0"), feed)
    J.land(events.where("event_id % 10 = 0"), feed)
    out = J.stream_settled(spark, feed, events.schema, J.run_folder(spark, "settled"), J.run_folder(spark, "ckpt"))
    return iso(J.settled_rates(out))


def q_stream_match(spark, sf):
    """Request stream against the static shipments."""
    from ..streaming import jobs as J
    feed = J.land(requests(spark, sf), J.run_folder(spark, "requests"))
    return J.stream_match(spark, feed, dimension(spark, sf), ships(spark, sf),
                          J.run_folder(spark, "matched"), J.run_folder(spark, "ckpt"), files_per_batch=2,
                          partitions=parse_parallelism(spark))


QUERIES = {
    "request_scan": q_request_scan,
    "shipments": q_shipments,
    "filter_json": q_filter_json,
    "input_gate": project("blank"),
    "expand_abbrev": q_expand_abbrev,
    "map_synonyms": project("enhanced_query"),
    "ambiguity_guard": q_ambiguity_guard,
    "protected_terms": q_protected_terms,
    "sentence_shape": q_sentence_shape,
    "preservation_audit": q_preservation_audit,
    "calendar_bounds": q_calendar_bounds,
    "bind_period": project("DE", "ATE"),
    "explicit_range": q_explicit_range,
    "extended_period": q_extended_period,
    "extract_nf": project("NF"),
    "extract_event": q_extract_event,
    "link_customer": q_link("cliente"),
    "link_carrier": q_link("transportadora"),
    "extract_uf": project("UFDestino"),
    "extract_city": project("CidadeDestino"),
    "link_city": q_link_city,
    "extract_operation": project("Operacao"),
    "extract_situation": project("SituacaoNF"),
    "extract_performance": project("StatusAnaliseData"),
    "extract_cnpj_root": project("CNPJRaizTransp"),
    "extract_sort": project("SortColumn", "SortDirection"),
    "parse_requests": project(*RECORD),
    "rule_performance_first": project("StatusAnaliseData", "TipoData", "DE", "ATE"),
    "rule_event_period": project("TipoData", "DE", "ATE"),
    "rule_situation": project("SituacaoNF", "TipoData"),
    "rule_delivered": project("TipoData", "SituacaoNF", "StatusAnaliseData"),
    "field_cooccurrence": q_field_cooccurrence,
    "rule_location": project("UFDestino", "CidadeDestino"),
    "rule_negation": project(("x_negated", "negated"), "UFDestino", "SituacaoNF", "Cliente"),
    "rule_nf_exclusive": q_rule_nf_exclusive,
    "rule_time_priority": q_rule_time_priority,
    "rule_sort_pair": project("SortColumn", "SortDirection"),
    "rule_scope": q_rule_scope,
    "rule_scope_conversations": q_rule_scope_conversations,
    "all_null": q_all_null,
    "classify_outcome": project("status", "outcome", "detail"),
    "trace_requests": q_trace_requests,
    "render_inputs": q_render_inputs,
    "apply_filters": q_apply_filters,
    "event_dates": q_event_dates,
    "match_requests": q_match_requests,
    "deadline_status": q_deadline_status,
    "ranked_results": q_ranked_results,
    "entitled_results": q_entitled_results,
    "formatted_results": q_formatted_results,
    "phrase_scan": q_phrase_scan,
    "log_scan": q_log_scan,
    "log_files_scan": q_log_files_scan,
    "suite_coverage": q_suite_coverage,
    "suite_accuracy": q_suite_accuracy,
    "recover_block": q_recover_block,
    "output_parse": q_output_parse,
    "domain_report": q_domain_report,
    "generate_stub": q_generate_stub,
    "regenerate_outputs": q_regenerate_outputs,
    "field_accuracy": q_field_accuracy,
    "field_coverage": q_field_coverage,
    "vague_rate": q_vague_rate,
    "vague_rate_by_endpoint": q_vague_rate_by_endpoint,
    "latency_summary": q_latency_summary,
    "latency_quantiles": q_latency_quantiles,
    "attempt_summary": q_attempt_summary,
    "attempt_waits": q_attempt_waits,
    "stream_parse": q_stream_parse,
    "stream_vague_rate": q_stream_vague_rate,
    "stream_late_rows": q_stream_late_rows,
    "stream_match": q_stream_match,
}
