"""Brute-force versions that the operators are held against. Plain Python, whole inputs."""

from __future__ import annotations

import re
from collections import defaultdict


def union_find(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingle_set(text, width=5):
    w = plain_words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def jaccard_components(rows):
    """rows: (id, text) -> per row (size, component) by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            at[g].append(i)
    common = defaultdict(int)
    for group in at.values():
        for x, a in enumerate(group):
            for b in group[x + 1:]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    root = union_find(len(rows), links)
    smallest: dict[int, int] = {}
    for i, (k, _) in enumerate(rows):
        if k is not None and sets[i]:
            smallest[root[i]] = min(k, smallest.get(root[i], k))
    return [(len(s), smallest.get(root[i]) if s else rows[i][0]) for i, s in enumerate(sets)]


def windows_found(text, items, width=10):
    """(words, hit words, sorted item ids) of one text."""
    w = alnum_words(text)
    hit, found = set(), set()
    for item, body in items:
        v = alnum_words(body)
        n = min(width, len(v))
        if item is None or not n:
            continue
        grams = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def kept_lines(rows, width=8, threshold=0.8):
    """rows: distinct (id, text hash, text) -> set of (id, hash, line) that stay."""
    first, blank = {}, set()
    for i, h, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        for k, line in enumerate(text.split("\n") if text is not None else []):
            p = " ".join(line.encode().lower().decode().split())
            if p:
                first.setdefault(p, (i, h, k))
            else:
                blank.add((i, h, k))
    lines = list(first)
    sets = [frozenset(p[k:k + width] for k in range(len(p) - width + 1)) if len(p) >= width else frozenset([p]) for p in lines]
    links = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines))
             if (n := len(sets[a] & sets[b])) and n / (len(sets[a]) + len(sets[b]) - n) >= threshold]
    root = union_find(len(lines), links)
    return {first[lines[i]] for i in set(root)} | blank
