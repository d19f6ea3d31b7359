"""Plain Python answers on small tables."""

import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    w = [x.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) for x in WORD.findall((text or "").encode())]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_components(rows, size=5, percent=75):
    """id -> (set size, smallest reachable id)."""
    sets = {i: shingles(t, size) for i, t in rows}
    at = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            at[x].add(i)
    pairs = {(a, b) for v in at.values() for a in v for b in v if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = union_find(sets, links)
    return {i: (len(sets[i]), comp[i]) for i in sets}
