"""Concept lexicon: phrase patterns -> (concept, canonical value).

One table serves the ambiguity guard (B4), the preservation audit (B8) and
extraction (D8, D9, D11): a concept's value is the single distinct value
whose pattern occurs in the text; two different values mean ambiguity.
Patterns are Java regexes compiled once per task (literal arguments).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions.text import LB, RB, ci, loose, word

_PERF_VALUE = {v: loose(v) for v in D.PERFORMANCE}
_QUOTE = r"['\"]?"

_situation = [
    (ci(word("trânsito")), "TRÂNSITO"),
    (ci(word("rodando")), "TRÂNSITO"),
    (ci(word("viajando")), "TRÂNSITO"),
    (ci(word("a caminho")), "TRÂNSITO"),
    (ci(word("retidas", inflect=True)), "RETIDA"),
    (ci(word("bloqueadas", inflect=True)), "RETIDA"),
    (ci(word("paradas na fiscalização", inflect=True)), "RETIDA"),
    (ci(LB + r"(?:status|situa[cç][aã]o(?:\s+log[ií]stica)?)\s+(?:(?:[eé]|de|do|da|=|:)\s+)?"
        + _QUOTE + r"entregues?" + RB), "ENTREGUE"),
]

_performance = []
for _v, _body in _PERF_VALUE.items():
    # "status de análise X", "análise de performance foi X", "análise X"
    _performance.append((ci(LB + r"an[aá]lise(?:\s+de\s+performance)?\s+(?:(?:foi|[eé]|=|:)\s+)?"
                            + _QUOTE + _body + RB), _v))
    if _v != "ENTREGUE":  # "status X"; "status entregue" is the situation
        _performance.append((ci(LB + r"status\s+(?:(?:[eé]|=|:)\s+)?" + _QUOTE + _body + RB), _v))
for _phrase, _canon, _concept, _v in D.SYNONYMS:
    if _concept == "performance":
        _performance.append((ci(word(_phrase, inflect=True)), _v))
_performance.append((ci(word("em data futura")), "FUTURO"))

_sort = [
    (ci(LB + loose(p.split(" ", 1)[0][:-1]) + r"(?:r|d[ao]s?|ndo)?\s+pel[ao]s?\s+" + loose(p.split(" ", 2)[2]) + "s?" + RB), v)
    for p, _, c, v in D.SYNONYMS if c == "sort"
] + [
    (ci(word("ordenadas pelo maior valor", inflect=True)), "valor_nf DESC"),
    (ci(word("ordenadas pelo menor valor", inflect=True)), "valor_nf ASC"),
]

_event = [
    (ci(word("previsão real")), "5"),
    (ci(LB + r"agend(?:a|ad[ao]s?|amento)" + RB), "1"),
    (ci(LB + r"(?:baixad[ao]s?|data\s+de\s+baixa)" + RB), "6"),
    (ci(LB + r"(?:emitid[ao]s?|emiss[aã]o)" + RB), "3"),
    (ci(LB + r"entregues?" + RB), "2"),
    (ci(LB + r"(?:previst[ao]s?|previs[aã]o(?!\s+real))" + RB), "4"),
]

_MONTHS = "|".join(loose(m) for m in D.MONTHS)

_period = [
    (ci(LB + r"[uú]ltim[oa]s\s+\d+\s+dias" + RB), "last_n_days"),
    (ci(LB + r"(?:[uú]ltima\s+semana|semana\s+passada)" + RB), "last_week"),
    (ci(LB + r"(?:n|d)?(?:esta|essa)\s+semana" + RB), "week"),
    (ci(LB + r"(?:n|d)?(?:este|esse)\s+m[eê]s" + RB), "month"),
    (ci(LB + r"(?:n|d)?(?:este|esse)\s+semestre" + RB), "semester"),
    (ci(LB + "(?:" + _MONTHS + ")" + RB), "named_month"),
    (ci(LB + r"\d{1,2}/\d{1,2}/\d{4}" + RB), "explicit"),
    (ci(word("amanhã")), "tomorrow"),
    (ci(word("ontem")), "yesterday"),
    (ci(word("hoje")), "today"),
]

# Literals (folded: lower case, no accents) that every pattern of a concept
# needs; a row without any of them cannot match, so the regexes are skipped.
GUARDS = {
    "situation": ["transito", "rodando", "viajando", "caminho", "retid", "bloquead", "parad", "status", "situac"],
    "performance": ["analise", "status", "atraso", "previst", "daqui", "futur"],
    "sort": ["ordena"],
    "event": ["previs", "agend", "baix", "emiti", "emiss", "entreg"],
    "period": ["ultim", "semana", "mes", "hoje", "ontem", "amanha", "/"]
              + ["janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro",
                 "outubro", "novembro", "dezembro"],
}

# Literals of which every pattern of a value needs one (values not listed have none).
NEEDS = {
    "TRÂNSITO": ["transito", "rodando", "viajando", "caminho"], "RETIDA": ["retid", "bloquead", "parad"], "ENTREGUE": ["entreg"],
    "ATRASO": ["atras"], "DO DIA": ["dia", "hoje"], "DIA SEGUINTE": ["seguinte", "amanha"],
    "PREVISTO PARA 2 DIAS": ["dias"], "FUTURO": ["futur"],
    "5": ["previs"], "1": ["agend"], "6": ["baix"], "3": ["emiti", "emiss"], "2": ["entreg"], "4": ["previs"],
}

LEXICON = {
    "situation": _situation,
    "performance": _performance,
    "sort": _sort,
    "event": _event,
    "period": _period,
}


def _body(pattern: str) -> str:
    return pattern[len("(?iu)"):] if pattern.startswith("(?iu)") else pattern


def combine(patterns) -> str:
    """One alternation for several case-insensitive patterns (one regex pass).  A word
    boundary that all of them begin with is looked at once a place."""
    bodies = [_body(p) for p in patterns]
    if all(b.startswith(LB) for b in bodies):
        return "(?iu)" + LB + "(?:" + "|".join("(?:" + b[len(LB):] + ")" for b in bodies) + ")"
    return "(?iu)" + "|".join("(?:" + b + ")" for b in bodies)


def by_value(entries):
    """Entries grouped by value, one combined pattern per value (table order)."""
    groups: dict[str, list[str]] = {}
    for p, v in entries:
        groups.setdefault(v, []).append(p)
    return [(combine(ps), v) for v, ps in groups.items()]


@dataclass(frozen=True)
class Held:
    """A folded text whose tests for some lists of literals, and for ``ODD_LETTERS``, are columns (made once a row)."""

    text: Column
    tests: dict[tuple[str, ...], Column]
    odd: Column


def guard(folded: Column | Held | None, words) -> Column | None:
    """True when the folded text holds one of ``words`` (plain substring tests)."""
    if folded is None:
        return None
    if isinstance(folded, Held):
        known = folded.tests.get(tuple(words))
        return guard(folded.text, words) if known is None else known
    out = None
    for w in words:
        c = folded.contains(w)
        out = c if out is None else (out | c)
    return out


#: Letters that case-insensitive patterns take for s or i, but folding keeps: with one of them no literal rules a pattern out.
ODD_LETTERS = ["ſ", "ı", "\u0307"]


def may_hold(folded: Column | Held, words) -> Column:
    """False only if no pattern that needs one of the literals ``words`` can match the text."""
    if isinstance(folded, Held):
        return guard(folded, words) | folded.odd
    return guard(folded, [*words, *ODD_LETTERS])


def _when_needed(value: str, pattern: str, col: Column, folded: Column | None) -> Column:
    needs = NEEDS.get(value)
    found = col.rlike(pattern)
    return found if folded is None or needs is None else may_hold(folded, needs) & found


def distinct_present(arr: Column) -> Column:
    """The distinct non-null texts of an array, in order (no lambda: Spark would evaluate what it is applied to without generated code)."""
    return F.array_except(arr, F.array(F.lit(None).cast("string")))


def distinct_values(col: Column, entries, when: Column | None = None, folded: Column | None = None) -> Column:
    """ARRAY of distinct values whose pattern occurs in ``col`` (regexes only
    run on rows where ``when`` holds and, given the ``folded`` text, where it
    holds a literal the value needs)."""
    found = distinct_present(F.array(*[F.when(_when_needed(v, p, col, folded), F.lit(v)) for p, v in by_value(entries)]))
    return found if when is None else F.when(when, found).otherwise(F.array().cast("array<string>"))


def single_value(col: Column, entries, when: Column | None = None) -> Column:
    """The value when exactly one distinct value occurs, else NULL."""
    vals = distinct_values(col, entries, when)
    return F.when(F.size(vals) == 1, vals[0])


def first_value(col: Column, entries, when: Column | None = None, folded: Column | None = None) -> Column:
    """Value of the first entry (table order = priority) that occurs."""
    out = F.coalesce(*[F.when(_when_needed(v, p, col, folded), F.lit(v)) for p, v in by_value(entries)])
    return out if when is None else F.when(when, out)


def mask(col: Column, entries, when: Column | None = None) -> Column:
    """Blank out every phrase of the given entries (longest first, one pass)."""
    out = F.regexp_replace(col, combine(p for p, _ in entries), " ")
    return out if when is None else F.when(when, out).otherwise(col)
