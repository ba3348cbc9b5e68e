"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(s: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def words(s: str | None) -> list[str]:
    return WORD.findall(low(s))


def shingle_set(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(ids, links) -> dict:
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b), near[b].add(a)
    out: dict = {}
    for d in sorted(ids):
        todo = [] if d in out else [d]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = d
                todo += near[x]
    return out


def jaccard(rows, percent=80):
    """{doc_id: (n, component, links)} by all pairs."""
    sets = {d: shingle_set(t) for d, t in rows}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links.append((a, b))
    comp, n = components(ids, links), Counter(i for link in links for i in link)
    return {d: (len(sets[d]), comp[d], n[d]) for d in ids}


def repeats(rows, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256 of what stays)}."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def ngram_scores(rows, held, mus):
    """{doc_id: (n_tokens, n_known, train_tokens, base, score)}."""
    tokens = {d: words(t) + [None] for d, t in rows}
    order = len(mus) + 1
    count, context = Counter(), Counter()
    for d, t in tokens.items():
        line = [None] + t
        for i in range(1, len(line)) if not held(d) else ():
            for k in range(order):
                if i - k >= 0:
                    count[tuple(line[i - k : i + 1])] += 1
                    context[tuple(line[i - k : i])] += 1
    one = {g[0]: c for g, c in count.items() if len(g) == 1}
    n, v = sum(one.values()), len(one)

    def prob(before, w):
        if not before:
            return (one.get(w, 0) + 1) / (n + v + 1)
        mu = mus[len(before) - 1]
        return (count[before + (w,)] + mu * prob(before[1:], w)) / (context[before] + mu)

    out = {}
    for d, t in tokens.items():
        line = [None] + t
        base = sum(math.log10(prob((), w)) for w in t)
        score = sum(math.log10(prob(tuple(line[max(0, i - order + 1) : i]), line[i])) for i in range(1, len(line)))
        out[d] = (len(t), sum(w in one for w in t), n, base, score)
    return out


def crc_fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts == 2


def line_links(rows, similar=0.8, gram=5):
    """{doc_id: removed line numbers}: all pairs of lines, earliest of a component stays."""
    lines, at = {}, []
    for d, t in sorted(rows):
        for i, x in enumerate((t or "").split("\n")):
            x = x.strip(" ").lower()
            if x:
                at.append((d, i, lines.setdefault(x, len(lines))))
    grams = [frozenset(x[i : i + gram] for i in range(max(1, len(x) - gram + 1))) for x in lines]
    by = defaultdict(list)
    links = []
    for k, g in enumerate(grams):
        common = Counter(e for x in g for e in by[x])
        links += [(k, e) for e, c in common.items() if c >= similar * (len(g) + len(grams[e]) - c) - 1e-12]
        for x in g:
            by[x].append(k)
    comp, seen, out = components(range(len(grams)), links), set(), defaultdict(set)
    for d, i, k in at:
        if comp[k] in seen:
            out[d].add(i)
        seen.add(comp[k])
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets of sources (in order) by repeated resharing of the excess."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    caps, full = [most * s for s in sizes], set()
    total = share * sum(sizes)
    while True:
        left = total - sum(caps[i] for i in full)
        free = [i for i in range(len(sizes)) if i not in full]
        level = left / sum(w[i] for i in free) if free else 0
        over = [i for i in free if level * w[i] > caps[i] + 1e-9]
        if not over:
            return [caps[i] if i in full else level * w[i] for i in range(len(sizes))]
        full |= set(over)
