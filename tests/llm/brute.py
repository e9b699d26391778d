"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict

UPPER = {c: c + 32 for c in range(65, 91)}
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall((text or "").translate(UPPER))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def near_components(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def leaks(text, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    w, hit, met = cut(text), set(), set()
    for item, t in items:
        v = cut(t)
        k = min(window, len(v))
        parts = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in parts:
                hit.update(range(i, i + k))
                met.add(item)
    return len(w), len(hit), sorted(map(str, met))


def repeats(rows, least=50):
    """doc -> word positions inside a passage of ``least`` words that another document has."""
    where = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - least + 1):
            where[tuple(w[j : j + least])].add((i, j))
    out = defaultdict(set)
    for places in where.values():
        if len({i for i, _ in places}) > 1:
            for i, j in places:
                out[i].update(range(j, j + least))
    return out


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii(text):
    out = []
    for n, (kind, p) in enumerate(PATTERNS.items(), 1):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), n, m.end(), kind))
    return sorted(out)
