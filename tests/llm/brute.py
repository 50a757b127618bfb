"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substrings(docs: list[tuple], window: int) -> list[tuple]:
    """(id, words, removed, kept hash) of each row."""
    words = [WORD.findall(t or "") for _, t in docs]
    places = defaultdict(list)
    for d, ws in enumerate(words):
        for i in range(len(ws) - window + 1):
            places[tuple(ws[i: i + window])].append((d, i))
    gone = [set() for _ in docs]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d].update(range(i, i + window))
    return [(doc, len(ws), len(g), sha(" ".join(w for i, w in enumerate(ws) if i not in g)))
            for (doc, _), ws, g in zip(docs, words, gone)]


def lines(docs: list[tuple], min_chars: int = 10) -> list[tuple]:
    """(id, lines, dropped, kept hash) of each row; a null id is the last document."""
    def key(line: str) -> str:
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    rank = [float("inf") if d is None else d for d, _ in docs]
    first: dict[str, float] = {}
    for r, (_, t) in zip(rank, docs):
        for line in (t or "").split("\n"):
            first[key(line)] = min(r, first.get(key(line), float("inf")))
    out = []
    for r, (d, t) in zip(rank, docs):
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(key(x)) < min_chars or first[key(x)] == r]
        out.append((d, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def shingles(text: str | None, n: int) -> frozenset:
    ws = WORD.findall((text or "").translate(LOWER))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i: i + n]) for i in range(max(1, len(ws) - n + 1)))


def components(docs: list[tuple], n: int, percent: int = 80) -> list[tuple]:
    """(id, set size, component) of each row; rows of one id are one node."""
    sets = [shingles(t, n) for _, t in docs]
    up = {d: d for d, _ in docs if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and docs[i][0] is not None and docs[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(docs[i][0]), root(docs[j][0])
                up[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else root(d)) for (d, _), s in zip(docs, sets)]


def statistics(text: str | None) -> tuple:
    """words, their characters, symbols, repeated lines, words in repeated three-word windows."""
    text = text or ""
    ws = WORD.findall(text)
    seen = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {i + k for i in range(len(ws) - 2) if seen[tuple(ws[i: i + 3])] > 1 for k in range(3)}
    ls = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(ls) - len(set(ls)), len(covered)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranking(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    """(item, rank, id, score): all scores of every document, sorted; a null id is the last of equal scores."""
    held = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    size, total = len(held), sum(c.total() for _, c in held)
    found = []
    for item, text in dict.fromkeys(items):
        scored = []
        for d, counts in held:
            m, score = 100 - 90 + (90 * counts.total() * size) // total, 0
            for term in dict.fromkeys(TERM.findall((text or "").translate(LOWER))):
                df = sum(term in c for _, c in held)
                if counts[term]:
                    w = math.floor(1000 * math.log((2 * size + 2) / (2 * df + 1)))
                    score += w * ((1000000000 * counts[term]) // (1000 * counts[term] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        found += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return found


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def secrets(text: str | None) -> list[tuple]:
    """(start, kind, end) of the base kinds, in the order asked for."""
    text = text or ""
    # Python folds two letters beyond A-Z onto s and k; they are none here.
    plain = text.replace("ſ", "\u0000").replace("K", "\u0000")
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(plain) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def whitening(vectors: list[tuple], k: int) -> tuple[int, dict, "np.ndarray", float]:
    """Rows of the fit list, deviation by id, eigenvalues, trace: products of centred fractions."""
    from fractions import Fraction

    kept = [(i, tuple(math.floor(64 * float(c)) + 1000000 for c in v)) for i, v in vectors
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    listed = sorted({x for _, x in kept})
    n, d = len(listed), len(listed[0])
    sums = [sum(x[j] for x in listed) for j in range(d)]
    centred = [[Fraction(n * x[j] - sums[j], n) for j in range(d)] for x in listed]
    matrix = np.array([[float(sum(r[a] * r[b] for r in centred) / n) for b in range(d)] for a in range(d)])
    deviation = {i: sum((n * x[j] - sums[j]) ** 2 for j in range(d)) for i, x in kept}
    return n, deviation, np.linalg.eigvalsh(matrix)[::-1][:k], float(np.trace(matrix))


def url_purities(rows, max_children, own_share, similar_z, prior):
    """{(host, segments): (template, purity)} from rows (host, segments, label or None), by recursion over nodes."""
    rows = [[h, list(s), list(s), y] for h, s, y in rows]

    def rate(some):
        return sum(1 for r in some if r[3] == 1), sum(1 for r in some if r[3] == 0)

    def split(some, depth):
        groups = {}
        for r in some:
            if len(r[2]) > depth:
                groups.setdefault(r[2][depth], []).append(r)
        return groups

    def generalise(some, depth):
        groups = split(some, depth)
        total = sum(map(len, groups.values()))
        if len(groups) > max_children:
            for members in groups.values():
                if len(members) < own_share * total:
                    for r in members:
                        r[2][depth] = "*"
        for members in split(some, depth).values():
            generalise(members, depth + 1)

    out = {}

    def judge(some, depth, up, counts):
        for r in some:
            out[r[0], tuple(r[1])] = ("/" + "/".join(r[2]), up)
        groups = split(some, depth)
        pg, pb = counts
        alike = []
        for members in groups.values():
            g, b = rate(members)
            n, rest, mean = g + b, pg + pb - g - b, (pg + 0.5) / (pg + pb + 1)
            differs = n and rest and abs(g / n - (pg - g) / rest) >= similar_z * (mean * (1 - mean) * (1 / n + 1 / rest)) ** 0.5
            if differs:
                judge(members, depth + 1, (g + prior * up) / (n + prior), (g, b))
            else:
                alike.append(members)
        if alike:
            pooled = [r for members in alike for r in members]
            if len(alike) > 1:
                for r in pooled:
                    r[2][depth] = "~"
            g, b = rate(pooled)
            judge(pooled, depth + 1, up if (g, b) == (pg, pb) else (g + prior * up) / (g + b + prior), (g, b))

    g, b = rate(rows)
    root = (g + 1) / (g + b + 2)
    for host in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == host]
        generalise(own, 0)
        g, b = rate(own)
        judge(own, 0, (g + prior * root) / (g + b + prior), (g, b))
    return out
