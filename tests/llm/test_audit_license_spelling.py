"""License blocks, filter interactions and spelling variants against brute force, on fixtures with nulls,
empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import filter_audit, license_scan, queries, spelling
from tests.llm import helpers as H

DOC = "doc_id long, text string, source string, digest string, blocks string, w string, word string, n long, part string, k int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", "z", "v", 1, "p", 2) for i, t, s in rows], DOC).repartition(3)


# -- license blocks ------------------------------------------------------------------------------------

def license_rows():
    r = random.Random(4)
    filler = lambda n: " ".join(r.choice("the of license general public mit under cc alpha beta gamma Ödé K".split()) for _ in range(n))
    texts = ["", None, "MIT license", "Released under the MIT License.", "x " * 62 + "GNU General Public License " + "y " * 70, "cc by", "cc-by CC BY; cc\nby by",
             "mit licenſe", "apache  License, Version 2.0 (Licensed under the", filler(3000), filler(400) + " this work is Licensed under GNU general, PUBLIC v 3",
             "z " * 127 + "apache license " + "z " * 63 + "apache license", "Copyright 2020. All Rights Reserved. no part of it", "general gnu license public"]
    texts += [filler(r.randint(1, 300)) for _ in range(30)]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], rows[9], (None, "mit license", "s"), (None, "cc by cc by", None), (3, "no notice here", None)]


def licenses_of(text):
    w = H.alnum_words(text)
    base, met = [], {}
    for phrase, label in queries.LICENSE_PHRASES.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    for s in range(0, len(w), license_scan.STRIDE):
        block = set(w[s:s + 2 * license_scan.STRIDE])
        for t in license_scan.NOTICES:
            n = len(block & set(t.tokens))
            if n >= t.need:
                met[t.label] = max(met.get(t.label, 0), n / len(t.tokens))
    places, names = sorted(i for i, _ in base), {x for _, x in base}
    return (len(w), len(base), places[0] if base else None, places[-1] if base else None, ",".join(sorted(names)), ",".join(sorted(names | set(met))),
            max([1.0] * bool(base) + list(met.values()) + [0.0]))


def test_licenses(spark):
    rows = license_rows()
    got = license_scan.licenses(frame(spark, rows), queries.LICENSE_PHRASES)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((i, *licenses_of(t))) for i, t, _ in rows)
    assert sum(r["n_base"] > 0 for r in got.collect()) > 10
    assert license_scan.licenses(frame(spark, rows).limit(0), queries.LICENSE_PHRASES).count() == 0


def test_license_blocks(spark):
    found = license_scan.find_blocks(frame(spark, license_rows()), queries.LICENSE_PHRASES).where("doc_id = 4").collect()
    hit = next(r for r in found if r["template"] == 0)
    assert (hit["from_word"], hit["to_word"], hit["places"], hit["containment"]) == (0, 128, [62], 1.0) and "gnu general public license" in hit["text"]
    with pytest.raises(ValueError):
        license_scan.find_blocks(frame(spark, license_rows()), {" - ": "none"})


# -- filter interactions -------------------------------------------------------------------------------

def test_popcounts():
    r = np.random.default_rng(3)
    for n, groups in ((0, 1), (1, 1), (2, 3), (5000, 7), (300, 300)):
        group = np.sort(r.integers(0, groups, n))
        words = r.integers(0, 1 << 32, n, dtype=np.uint32)
        want = np.zeros((groups, 32), np.int64)
        np.add.at(want, group, (words[:, None] >> np.arange(32, dtype=np.uint32) & 1).astype(np.int64))
        assert (filter_audit.popcounts(words, group, groups) == want).all()


def audited(rows, labels):
    """Every document through every order, one filter after the other."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    docs = defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs[s or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = []
    for part, members in docs.items():
        worth, steps = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = members
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                redundant = sum(f in d[0] for d in members) - len(gone)
                left = [d for d in left if f not in d[0]]
                worth[f] += len(gone)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), redundant, sum(d[0] == {f} for d in members), sum(d[1] for d in gone),
                              sum(d[2] for d in gone), f))
        out += [(*s[:-1], worth[s[-1]]) for s in steps]
    return out


def test_audit(spark):
    r = random.Random(8)
    rows = []
    for i in range(120):
        w = [r.choice("aa bb CC dd ee ff Gg hh ii jj kk ll".split()) + str(r.randint(0, 9) if i % 3 else 0) for _ in range(r.choice([0, 3, 49, 50, 80]))]
        rows.append((i, (" ".join(w) + r.choice(["", "", " #", "\n"])) if i % 17 else None, r.choice(["a", "b", "", None])))
    rows += [(500 + i, rows[i][1], "a") for i in range(0, 60, 3)] + [rows[7], rows[7], (None, rows[8][1], "b"), (1000, "x " * 20000, "long")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (99999, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(frame(spark, rows), lab)
    want = audited(rows, labels)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want) and len(want) == 4 * 600
    assert filter_audit.audit(frame(spark, rows).limit(0), lab).count() == 0
    assert {x["shapley"] for x in filter_audit.audit(frame(spark, [(1, "a", "s")]), lab.limit(0)).collect()} == {120, 0}


# -- spelling variants -----------------------------------------------------------------------------------

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def variants(rows):
    count = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    close = {w: [v for v in count if near(w, v)] for w in count}
    best = {w: min(c, key=lambda v: (-count[v], v)) for w, c in close.items() if c}
    form = {w: b for w, b in best.items() if count[b] >= 10 * count[w]}
    out = []
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(close[w]), count[form[w]] if w in form else None))
    return out


def variant_rows():
    r = random.Random(6)
    words = ["".join(r.choice("etaoinsé") for _ in range(r.randint(6, 12))) for _ in range(25)]
    rows = []
    for i in range(150):
        t = []
        for _ in range(40):
            w = r.choice(words[:6] * 12 + words)
            if r.random() < 0.15:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1:], w[:k] + r.choice("xetÿ÷") + w[k:], w[:k] + "q" + w[k + 1:]])
            t.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", "-", "9"]).join(t), None))
    chain = " ".join(["aaaaaaaa"] * 400 + ["aaaaaaab"] * 40 + ["aaaaaabb"] * 4)
    tied = " ".join(["zzzzzzza", "zzzzzzzb"] * 30 + ["zzzzzzzc"] * 2)
    long = " ".join(["e" * 3000, "e" * 3000, "e" * 3001] * 3)
    return rows + [(900, chain, None), (901, tied, None), (902, long, None), (None, "nullable nullable", None), (903, None, None), (904, "", None), rows[0], rows[0]]


@pytest.mark.parametrize("cell", [1 << 14, 8])
def test_variants(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL", cell)  # the small one: many cells, and parts that the sample can't split
    rows = variant_rows()
    got = sorted((tuple(x) for x in spelling.group_variants(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(variants(rows), key=repr)
    assert sum(x[1] is not None for x in got) > 20 and any(x[1] and x[1] != x[2] for x in got)
    assert spelling.group_variants(frame(spark, rows).limit(0)).count() == 0


def test_search_reaches_every_near_word():
    """Trees of several levels, anagrams included, against all pairs."""
    r = random.Random(12)
    words = sorted({"".join(r.choice("abcdé") for _ in range(n)) for n in (7, 8) for _ in range(900)})
    by = {m: [w for w in words if len(w) == m] for m in (7, 8)}
    cell = spelling.Cell(by[8], np.ones(len(by[8]), np.int64))
    for m in (7, 8):
        got = {(by[m][a], cell.words[b]) for x, y in cell.pairs(spelling.matrix(by[m])) for a, b in zip(x, y, strict=True)}
        assert got == {(a, b) for a in by[m] for b in by[8] if near(a, b)} and got


def test_tops_reach_every_near_word():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghé") for _ in range(9)) for _ in range(1500)]
    x = spelling.masks(spelling.matrix(words), 9)
    top = np.array(spelling.fit_top(x, 1500.0, 40), np.int64)
    i, cell, parts = spelling.reach(top, x, 0, 0)
    assert len(i) == len(words) and len(set(cell.tolist())) > 20
    own = dict(zip(i.tolist(), cell.tolist(), strict=True))
    i, cell, _ = spelling.reach(top, x, 1, 1)
    reached = set(zip(i.tolist(), cell.tolist(), strict=True))
    assert all((a, own[b]) in reached for a in range(200) for b in range(len(words)) if near(words[a], words[b]))
