"""Field extraction (D1-D11, E7 masking) as column expressions.

Each step reads a working text, extracts its field and blanks the phrase it
used, so later steps cannot reuse the same words: negation scope first,
then Operacao (so "OutBound-SPO" never yields SP), CNPJ root before NF (both
are digits), sort clause, performance, situation, names, geography (so "Rio
de Janeiro" is gone before "de janeiro" could read as a month), periods and
finally the date event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions.calendar import calendar_bounds
from ..functions.text import LB, RB, any_word, ci, fold, fold_py, fold_text, loose, loose_pieces, one_of, squash
from . import lexicon as L
from .periods import ISO_DATE, MONTHS_FOLDED, explicit_range, invalid_range, mask_periods, named_period

# --- E7: a negation word governs the next phrase only: its linking words, one
# word, and what follows up to a clause boundary or the start of another filter
_NEG = "|".join(loose(w) for w in sorted(D.NEGATION_WORDS, key=len, reverse=True))
_LINKING = ("(?:" + "|".join(loose(w) for w in (
    "para", "as", "os", "a", "o", "estado", "cidade", "de", "do", "da", "dos", "das", "em", "no", "na", "com", "que", "sejam", "seja",
    "estejam", "esteja", "estão", "está", "são", "foram", "foi", "for", "cliente", "tomador", "transportadora", "parceiro", "status",
    "situação", "logística", "análise", "operação")) + ")" + RB)
_NEXT_FILTER = (r"(?:e|mas|ordenad\w*|emitid[ao]s?|entregues?|baixad[ao]s?|previst[ao]s?|agendad[ao]s?|retid[ao]s?|bloquead[ao]s?|com|para|que|cuj[ao]|"
                r"(?:d|n|pel)[ao]s?\s+(?:cliente|tomador|transportadora|parceiro|estado|cidade|opera[cç][aã]o|nota)|em\s+tr[aâ]nsito)" + RB)
NEGATION_SCOPE = ci(LB + "(?:" + _NEG + r")" + RB + r"(?:\s+" + _LINKING + r")*(?:\s+[^\s,;!?]+(?:\s+(?!" + _NEXT_FILTER + r")[^\s,;!?]+)*)?")

# --- D7: operation codes, longest first, never split ----------------------
_OPS = sorted(D.OPERATIONS, key=len, reverse=True)
OPERATION = ci(r"(?<![\p{L}\p{N}\-.])(" + "|".join(o.replace(".", r"\.").replace("-", r"\-") for o in _OPS)
               + r")(?![\p{L}\p{N}\-.])")

# --- D10 / D1 -------------------------------------------------------------
CNPJ_ROOT = ci(LB + r"(?:cnpj(?:\s+raiz)?|raiz\s+do\s+cnpj)(?:\s+d[ao]\s+(?:transportadora|parceiro))?"
               r"\s*(?:[:=]|[eé])?\s*(\d{8})" + RB)
NF_NUMBER = ci(LB + r"(?:notas?\s+fisca(?:l|is)|nota)\s*(?:n[º°o]\.?\s*|n[uú]mero\s+|#\s*)?(\d+)" + RB)

# --- D11: sort clause = from the sort verb to the end, or a phrase that needs no verb
SORT_TAIL = ci(LB + r"(?:orden\w*|ordem|classific\w*)" + RB + ".*$")
SORT_PHRASE = ci(LB + r"(?:(?:com\s+)?(?:o\s+)?(?:maior|menor)(?:es)?\s+valor(?:es)?|mais\s+(?:car|barat)[ao]s?|"
                 r"(?:d[ao]\s+)?(?:data\s+de\s+)?(?:entrega|emiss[aã]o)\s+mais\s+(?:recentes?|antig[ao]s?)|mais\s+nov[ao]s)" + RB)
_SORT_COLUMN = [
    (ci(LB + r"(?:data\s+de\s+entrega|entrega\s+mais\s+(?:recentes?|antig[ao]s?))" + RB), "data_entrega"),
    (ci(LB + r"(?:data\s+de\s+emiss[aã]o|emiss[aã]o\s+mais\s+(?:recentes?|antig[ao]s?)|mais\s+nov[ao]s?)" + RB),
     "data_emissao"),
    (ci(LB + r"(?:valor(?:es)?|pre[cç]os?|mais\s+car[ao]s?|mais\s+barat[ao]s?)" + RB), "valor_nf"),
]
_SORT_DIRECTION = [
    (ci(LB + r"(?:mais\s+recentes?|maior(?:es)?|mais\s+car[ao]s?|decrescente)" + RB), "DESC"),
    (ci(LB + r"(?:mais\s+antig[ao]s?|menor(?:es)?|mais\s+barat[ao]s?|crescente)" + RB), "ASC"),
]
_SORT_WORDS = ci(LB + r"(?:orden\w*|ordem|classific\w*|em|por|pel[oa]s?|d[ao]|de|a|o|as|os|data|entrega|"
                 r"emiss[aã]o|valor(?:es)?|nota|pre[cç]os?|mais|recentes?|antig[ao]s?|nov[ao]s?|car[ao]s?|"
                 r"barat[ao]s?|maior(?:es)?|menor(?:es)?|decrescente|crescente)" + RB)

# --- D3 / D4: keyword + name -------------------------------------------------
_STOP = one_of(loose_pieces(w) for w in sorted(D.NAME_STOPWORDS, key=len, reverse=True))
_NOT_STOP = r"(?!(?iu:" + _STOP + r")(?![\p{L}\p{N}]))"
_NAME = (_NOT_STOP + r"[^\s,;!?]+(?:\s+" + _NOT_STOP + r"[\p{Lu}\p{N}][^\s,;!?]*)*")
CLIENT_KW = r"(?iu:cliente|tomador)"
CARRIER_KW = r"(?iu:transportadora|parceiro)"
NAME_AFTER = r"(?u)^(" + _NAME + ")"
ENTITY_SPAN = r"(?u)(?<![\p{L}\p{N}])(?:" + CLIENT_KW + "|" + CARRIER_KW + r")\s+" + _NAME


#: Stands for a linked name in the text that the other fields are read from.
LINKED = "§"


def _after(text: Column, kw: str) -> Column:
    return F.regexp_extract(text, r"(?u)(?<![\p{L}\p{N}])" + kw + r"\s+([^,;!?]*)", 1)


def _raw_name(text: Column, kw: str, after: Column) -> Column:
    """The name after the keyword; NULL if the keyword names two different ones."""
    words = F.regexp_extract_all(text, F.lit(r"(?u)(?<![\p{L}\p{N}])" + kw + r"\s+(" + _NAME + ")"), 1)
    several = F.size(F.array_distinct(F.transform(words, fold))) > 1
    return F.when(~several, _first_name(after))


def _first_name(after: Column) -> Column:
    name = F.regexp_replace(F.regexp_extract(after, NAME_AFTER, 1), r"[.'\"]+$", "")
    return F.when(name != "", name)


def _tokens(after: Column) -> Column:
    return F.array_remove(F.split(squash(after), " "), "")


# --- D5 / D6: geography ---------------------------------------------------
def _exact(phrase: str) -> list[str]:
    return [r"\s+" if c == " " else c.replace(".", r"\.") for c in " ".join(phrase.split())]


_STATE_OF = dict(zip(D.STATE_NAMES, D.STATES))
_CITY_STATE = dict(zip(D.CAPITALS, D.STATES)) | dict(D.OTHER_CITIES)
_COLLIDE = set(fold_py(w) for w in D.NAME_STOPWORDS) | {"para"}


def _name_pattern(name: str) -> list[str]:
    # Names whose unaccented form is a common word ("Pará" ~ "para") keep accents.
    return _exact(name) if fold_py(name) in _COLLIDE else loose_pieces(name)


def _alt(names) -> str:
    return "(" + one_of(_name_pattern(n) for n in sorted(names, key=len, reverse=True)) + ")"


STATE_NAME = ci(LB + _alt(D.STATE_NAMES) + RB)
_TOWNS = [c for c in _CITY_STATE if c not in _STATE_OF]
TOWN = ci(LB + _alt(_TOWNS) + RB)
CITY_EXPLICIT = ci(LB + r"cidade\s+d[eo]\s+" + _alt(list(_CITY_STATE)) + RB)
_WITH_CODE = r"(?:(?:para|em|uf|estado(?:\s+d[eoa])?)\s+(?:o\s+|a\s+)?(?:estado\s+(?:d[eoa]\s+)?)?)"
# in lower case only after a word that asks for a place ("se", a common word, only after "uf" or "estado")
UF_LOWER = ci(LB + "(?:" + _WITH_CODE + "(" + "|".join(s.lower() for s in D.STATES if s != "SE") + r")|(?:uf|estado(?:\s+d[eo])?)\s+(se))(?![\p{L}\p{N}\-])")
UF_CODE = r"(?<![\p{L}\p{N}\-.#])(" + "|".join(D.STATES) + r")(?![\p{L}\p{N}\-])"

# Cheap pre-checks on the folded text (plain ASCII, no case folding): a row
# without any place name or domain word skips the accent-aware regexes.
# (names whose folded form is a common word, "Pará" ~ "para", are checked
# with their accent instead)
_PLACES_FOLDED = sorted({fold_py(n) for n in [*D.STATE_NAMES, *_CITY_STATE, "cidade"]} - _COLLIDE, key=len,
                        reverse=True)
COLLIDING = sorted({n.lower() for n in [*D.STATE_NAMES, *_CITY_STATE] if fold_py(n) in _COLLIDE})
PLACE_HINT = "(?:" + one_of([r"\s+" if c == " " else c for c in p] for p in _PLACES_FOLDED) + ")"
DOMAIN_FOLDED = (r"(?<![a-z0-9])(?:" + "|".join(sorted({fold_py(w) for w in D.DOMAIN_WORDS}, key=len, reverse=True))
                 + r")(?![a-z0-9])")


def _lookup(pairs: dict, key: Column) -> Column:
    m = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(fold_py(k)), F.lit(v))])
    return F.element_at(m, squash(fold(key)))


def _one(arr: Column) -> Column:
    d = L.distinct_present(arr)
    return F.when(F.size(d) == 1, d[0])


def mask_negation(text: Column) -> Column:
    return F.regexp_replace(text, NEGATION_SCOPE, " ")


def name_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_cli_tokens`` and ``_tr_tokens``: the words after the customer /
    carrier keyword, read from a text where only negated clauses and the
    CNPJ-root phrase are blanked (cheap: the linker needs the leading words,
    not the other fields).  The folded and the blanked text are columns, so
    that they are made once a row."""
    df = df.withColumn("_fspan", fold_text(text))
    f, t = F.col("_fspan"), F.col(text)
    t = F.when(L.guard(f, ["nao", "exceto", "menos"]), mask_negation(t)).otherwise(t)
    t = F.when(f.contains("cnpj"), F.regexp_replace(t, CNPJ_ROOT, " ")).otherwise(t)
    df = df.withColumn("_tspan", t)
    t = F.col("_tspan")
    df = df.withColumn("_tspan", F.when(f.contains("bound"), F.regexp_replace(t, OPERATION, " ")).otherwise(t))
    none = F.array().cast("array<string>")
    return df.withColumns({
        "_cli_tokens": F.when(L.guard(f, ["cliente", "tomador"]), _tokens(_after(t, CLIENT_KW))).otherwise(none),
        "_tr_tokens": F.when(L.guard(f, ["transportadora", "parceiro"]), _tokens(_after(t, CARRIER_KW)))
                       .otherwise(none),
    }).drop("_fspan", "_tspan")


#: Lists of literals that several steps ask the folded text for; each is tested once a row.
_ODD = tuple(L.ODD_LETTERS)
_TESTS = [("nao", "exceto", "menos"), ("bound",), ("cnpj",), ("nota",), ("cliente", "tomador"), ("transportadora", "parceiro"),
          *[tuple(L.GUARDS[k]) for k in ("performance", "situation", "period")], ("/",), MONTHS_FOLDED, ("semana",), _ODD]


def extract(df: DataFrame, text: str = "enhanced_query", anchor: str = "anchor") -> DataFrame:
    """Adds raw field columns ``x_*`` and the row's ``calendar`` struct.

    Every regex group runs only on rows whose folded text holds one of the
    literals it needs (``L.guard``: plain substring tests); later texts only
    lose words, so guards on the first text stay valid all the way down."""
    t0 = F.coalesce(F.col(text), F.lit(""))
    t0 = F.when(F.contains(t0, F.lit("-")), F.regexp_replace(t0, ISO_DATE, "$3/$2/$1")).otherwise(t0)
    for kind in ("cliente", "transportadora", "cidade"):
        if f"name_{kind}" in df.columns:  # a linked name's own words say nothing else
            name = F.col(f"name_{kind}")
            t0 = F.when(name.isNotNull(), F.replace(t0, name, F.lit(LINKED))).otherwise(t0)
    a = F.col(anchor)
    df = df.withColumns({"calendar": calendar_bounds(a), "_t0": t0})
    t0 = F.col("_t0")
    df = df.withColumn("_f0", fold_text("_t0"))
    f0 = F.col("_f0")
    df = df.withColumns({f"_g{i}": L.guard(f0, words) for i, words in enumerate(_TESTS)})
    held = L.Held(f0, {words: F.col(f"_g{i}") for i, words in enumerate(_TESTS)}, F.col(f"_g{_TESTS.index(_ODD)}"))

    def g(*words):
        return L.guard(held, words)

    g_neg = g("nao", "exceto", "menos")
    df = df.withColumns({
        "x_negated": g_neg & t0.rlike(NEGATION_SCOPE),
        "_t1": F.when(g_neg, mask_negation(t0)).otherwise(t0),
    })
    t1 = F.col("_t1")
    g_op = g("bound")
    ops = F.transform(F.regexp_extract_all(t1, F.lit(OPERATION), 1),
                      lambda x: _lookup({o: o for o in D.OPERATIONS}, x))
    df = df.withColumns({"x_op": F.when(g_op, _one(ops)),
                         "_t2": F.when(g_op, F.regexp_replace(t1, OPERATION, " ")).otherwise(t1)})
    t2 = F.col("_t2")
    g_cnpj = g("cnpj")
    cnpj = F.regexp_extract(t2, CNPJ_ROOT, 1)
    df = df.withColumns({"x_cnpj": F.when(g_cnpj & (cnpj != ""), cnpj),
                         "_t3": F.when(g_cnpj, F.regexp_replace(t2, CNPJ_ROOT, " ")).otherwise(t2)})
    t3 = F.col("_t3")
    g_nf = g("nota")
    df = df.withColumn("_t4", F.when(g_nf, F.regexp_replace(t3, NF_NUMBER, " ")).otherwise(t3))
    t4 = F.col("_t4")
    g_sort = g("orden", "ordem", "classific")
    g_phrase = g("mais ", "maior", "menor")
    nf = F.regexp_extract(t3, NF_NUMBER, 1)
    df = df.withColumns({
        "x_nf": F.when(g_nf & (nf != ""), nf.try_cast("bigint")),  # a cast that fails costs an exception
        "_tail": F.when(g_sort, F.regexp_extract(t4, SORT_TAIL, 0)).otherwise(F.lit("")),
    })
    df = df.withColumn("_bare", (F.col("_tail") == "") & g_phrase & t4.rlike(SORT_PHRASE))
    bare = F.col("_bare")
    df = df.withColumn("_tail", F.when(bare, F.regexp_extract(t4, SORT_PHRASE, 0)).otherwise(F.col("_tail")))
    tail = F.col("_tail")
    has_tail = tail != ""
    head = F.when(bare, F.regexp_replace(t4, SORT_PHRASE, " ")) \
            .when(has_tail, F.substring(t4, F.lit(1), F.length(t4) - F.length(tail))).otherwise(t4)
    df = df.withColumns({
        "x_sort_col": F.when(has_tail, L.first_value(tail, _SORT_COLUMN)),
        "x_sort_dir": F.when(has_tail, L.single_value(tail, _SORT_DIRECTION)),
        "_t5": F.when(has_tail, F.concat(head, F.lit(" "), F.regexp_replace(tail, _SORT_WORDS, " "))).otherwise(t4),
    })
    t5 = F.col("_t5")
    g_perf = g(*L.GUARDS["performance"])
    df = df.withColumn("_perf", L.distinct_values(t5, L.LEXICON["performance"], g_perf, held))
    perf = F.col("_perf")
    df = df.withColumns({
        "x_perf": F.when(F.size(perf) == 1, perf[0]),
        "_t6": L.mask(t5, L.LEXICON["performance"], F.size(perf) > 0),
    })
    t6 = F.col("_t6")
    g_sit = g(*L.GUARDS["situation"])
    df = df.withColumn("x_sit_vals", L.distinct_values(t6, L.LEXICON["situation"], g_sit, held))
    df = df.withColumn("_t7", L.mask(t6, L.LEXICON["situation"], F.size("x_sit_vals") > 0))
    t7 = F.col("_t7")
    g_cli, g_tr = g("cliente", "tomador"), g("transportadora", "parceiro")
    cli_after, tr_after = _after(t7, CLIENT_KW), _after(t7, CARRIER_KW)
    none = F.array().cast("array<string>")
    df = df.withColumns({
        "x_cli_raw": F.when(g_cli, _raw_name(t7, CLIENT_KW, cli_after)),
        "x_cli_tokens": F.when(g_cli, _tokens(cli_after)).otherwise(none),
        "x_tr_raw": F.when(g_tr, _raw_name(t7, CARRIER_KW, tr_after)),
        "x_tr_tokens": F.when(g_tr, _tokens(tr_after)).otherwise(none),
        "_t8": F.when(g_cli | g_tr, F.regexp_replace(t7, ENTITY_SPAN, " ")).otherwise(t7),
    })
    t8 = F.col("_t8")
    g_city = g("cidade")
    df = df.withColumn("_city_w", F.when(g_city, F.regexp_extract(t8, CITY_EXPLICIT, 1)).otherwise(F.lit("")))
    city_x = F.col("_city_w")
    city_x_name = _lookup({c: c for c in _CITY_STATE}, city_x)
    df = df.withColumns({
        "_city_x": F.when(city_x != "", city_x_name),
        "_t9": F.when(city_x != "", F.regexp_replace(t8, CITY_EXPLICIT, " ")).otherwise(t8),
    })
    t9 = F.col("_t9")
    low = F.lower(t0)
    g_place = f0.rlike(PLACE_HINT)
    for name in COLLIDING:
        g_place = g_place | low.contains(name)
    none_s = F.array().cast("array<string>")
    df = df.withColumn("_g_place", g_place)
    g_place = F.col("_g_place")
    df = df.withColumn("_states", F.when(g_place, F.regexp_extract_all(t9, F.lit(STATE_NAME), 1)).otherwise(none_s))
    has_states = F.size("_states") > 0
    state_ufs = F.when(has_states, F.transform("_states", lambda x: _lookup(_STATE_OF, x))).otherwise(none_s)
    codes = F.when(t9.rlike("[A-Z]{2}"), F.regexp_extract_all(t9, F.lit(UF_CODE), 1)).otherwise(none_s)
    # every match ends with its code
    lower = F.when(t9.rlike(UF_LOWER), F.transform(F.regexp_extract_all(t9, F.lit(UF_LOWER), 0), lambda x: F.upper(F.right(x, F.lit(2))))).otherwise(none_s)
    code_ufs = F.concat(codes, F.when(g("para", "em ", "uf", "estado"), lower).otherwise(none_s))
    no_states = F.when(has_states, F.regexp_replace(t9, STATE_NAME, " ")).otherwise(t9)
    city_x_uf = F.when(F.col("_city_x").isin(list(_STATE_OF)), _lookup(_STATE_OF, F.col("_city_x")))
    df = df.withColumn("_t9b", no_states)
    df = df.withColumn("_towns", F.when(g_place, F.regexp_extract_all(F.col("_t9b"), F.lit(TOWN), 1)).otherwise(none_s))
    has_towns = F.size("_towns") > 0
    towns = F.when(has_towns, F.transform("_towns", lambda x: _lookup({c: c for c in _TOWNS}, x))).otherwise(none_s)
    df = df.withColumns({
        "x_uf": _one(F.concat(state_ufs, code_ufs, F.array(city_x_uf))),
        "x_city": F.coalesce(F.col("_city_x"), _one(towns)),
        "_t10": F.when(has_towns, F.regexp_replace(F.col("_t9b"), TOWN, " ")).otherwise(F.col("_t9b")),
    })
    t10 = F.col("_t10")
    g_per = g(*L.GUARDS["period"])
    df = df.withColumns({
        "x_has_period": g_per & t10.rlike(L.combine(p for p, _ in L.LEXICON["period"])),
        "x_explicit": F.when(g_per, explicit_range(t10, a, held)),
        "x_named": F.when(g_per, named_period(t10, F.col("calendar"), a, held)),
        "_t11": F.when(g_per, mask_periods(t10)).otherwise(t10),
    })
    df = df.withColumn("x_range_invalid", F.when(g_per, invalid_range(t10, F.col("x_explicit"), held)).otherwise(F.lit(False)))
    df = df.withColumns({
        "x_event": L.first_value(F.col("_t11"), L.LEXICON["event"], g(*L.GUARDS["event"]), held),
        "x_domain": f0.rlike(DOMAIN_FOLDED),
    })
    return df.drop("_perf", "_city_w", "_states", "_towns", "_t0", "_f0", "_bare", "_t1", "_t2", "_t3", "_t4", "_tail", "_t5", "_t6", "_t7", "_t8", "_t9", "_t9b", "_t10",
                   "_t11", "_city_x", "_g_place", *[f"_g{i}" for i in range(len(_TESTS))])
