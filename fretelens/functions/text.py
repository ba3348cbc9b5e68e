"""Text helpers: accent folding and accent/case-insensitive word patterns.

All helpers return either a Spark ``Column`` or a Java regex string that is
used as a literal pattern, so Catalyst compiles it once per task and the
expressions stay inside whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüç"
_PLAIN = "aaaaaeeeeiiiiooooouuuuc"

_CLASSES = {
    "a": "aáàâãä", "e": "eéèêë", "i": "iíìîï", "o": "oóòôõö", "u": "uúùûü",
    "c": "cç",
}
_BASE = {acc: plain for acc, plain in zip(_ACCENTED, _PLAIN)}

# Letters or digits: a match may not touch one on either side.
LB = r"(?<![\p{L}\p{N}])"
RB = r"(?![\p{L}\p{N}])"


def fold(col: Column | str) -> Column:
    """Lower-case and strip the Portuguese accents (length preserving)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.translate(F.lower(c), _ACCENTED, _PLAIN)


def fold_text(name: str) -> Column:
    """:func:`fold` of a text column; plain ASCII is only lower-cased."""
    c = F.col(name)
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(fold(c))


def fold_py(text: str) -> str:
    return text.lower().translate(str.maketrans(_ACCENTED, _PLAIN))


def _char_class(ch: str) -> str:
    low = ch.lower()
    base = _BASE.get(low, low)
    if base in _CLASSES:
        return "[" + _CLASSES[base] + "]"
    if ch.isspace():
        return r"\s+"
    return re.escape(ch)


def loose(phrase: str, inflect: bool = False) -> str:
    """Regex body matching ``phrase`` ignoring accents, case and spacing.

    With ``inflect`` a participle ending (-ada/-ido/-ista ...) also accepts
    the other gender and the plural (prevista -> previst[ao]s?).
    """
    return "".join(loose_pieces(phrase, inflect))


def loose_pieces(phrase: str, inflect: bool = False) -> list[str]:
    """:func:`loose` character by character."""
    out = []
    for word in phrase.split():
        if out:
            out.append(r"\s+")
        stem, suffix = word, ""
        if inflect:
            m = re.fullmatch(r"(.*(?:ad|id|ist|est|uad))([ao])(s?)", fold_py(word))
            if m:
                stem, suffix = word[: len(m.group(1))], "[ao]s?"
        out += [_char_class(ch) for ch in stem] + ([suffix] if suffix else [])
    return out


def one_of(alternatives) -> str:
    """Regex group of alternatives (lists of pieces) whose common beginnings are
    written once, so that a place in the text is compared with a few first
    letters and not with every alternative.  Where one alternative begins
    another one, the longer is tried first."""
    tree: dict = {}
    for pieces in alternatives:
        node = tree
        for p in pieces:
            node = node.setdefault(p, {})
        node[""] = {}
    return _branches(tree)


def _branches(node: dict) -> str:
    arms = [p + _branches(after) for p, after in node.items() if p]
    if "" in node and arms:
        return "(?:" + "|".join(arms) + ")?"
    return arms[0] if len(arms) == 1 else "(?:" + "|".join(arms) + ")" if arms else ""


def word(phrase: str, inflect: bool = False) -> str:
    """Whole-word version of :func:`loose`."""
    return LB + "(?:" + loose(phrase, inflect) + ")" + RB


def any_word(phrases, inflect: bool = False) -> str:
    """Whole-word alternation, longest phrase first."""
    alts = sorted(set(phrases), key=lambda p: (-len(p), p))
    return LB + "(?:" + "|".join(loose(p, inflect) for p in alts) + ")" + RB


def ci(body: str) -> str:
    """Case-insensitive, Unicode-aware pattern."""
    return "(?iu)" + body


def has(col: Column, pattern: str) -> Column:
    return col.rlike(pattern)


def squash(col: Column) -> Column:
    """Collapse runs of whitespace and trim both ends."""
    return F.regexp_replace(F.regexp_replace(col, r"\s+", " "), r"^ | $", "")


def squash_text(name: str) -> Column:
    """:func:`squash` of a text column, rewritten only where that changes something."""
    c = F.col(name)
    return F.when(c.rlike(r"^\s|[^\S ]|\s\s|\s$"), squash(c)).otherwise(c)
