"""The ten operators on small fixtures with nulls, empty and long texts, ties, repeated rows, empty
tables and clashing column names, each against a brute-force version."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quarry.llm import (ann_join, byte_cnn, chat_format, decontam, html_text, jaccard_join, line_dedup, queries, source_mix, token_codes,
                        url_filter)
from tests.llm import helpers as H

DOC = "doc_id long, text string, lang string, source string, n_chars long, h long, id string, cls string"


def doc_rows(seed=5):
    """Documents with near copies, shared passages, short, empty, null and long texts, repeated rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "é", "ß", "re", "he"]) for _ in range(r.randint(1, 4)))
    texts = []
    passage = " ".join(word() for _ in range(60))
    for _ in range(25):
        w = [word() for _ in range(r.randint(30, 120))]
        texts.append(" ".join(w))
        for _ in range(r.randint(0, 4)):  # near copies
            v = list(w)
            v[r.randrange(len(v))] = word()
            texts.append(" ".join(v).upper() if r.random() < 0.2 else "\n".join([" ".join(v[:20]), " ".join(v[20:])]))
        if r.random() < 0.4:
            texts.append(" ".join(w[:40]) + " " + passage)
    texts += ["", None, " \n\t ", "one", "one", "One two", "a b c d", "a b c d e", " ".join(word() for _ in range(4000)), "x" * 5000, "\n\n", "a\x00b c"]
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", None, i, "clash", None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[0], None, "s1", 1, 2, None, None), (7, texts[12], "de", "s2", 1, 2, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOC).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_jaccard_components(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(zip([k for k, _ in rows], H.jaccard_components(rows), strict=True), key=repr)
    got = sorted([(r["doc_id"], (r["n_shingles"], r["component_id"])) for r in jaccard_join.join_components(docs).collect()], key=repr)
    assert got == want
    assert len({c for _, (_, c) in got}) < len(got) - 20
    assert jaccard_join.join_components(empty).count() == 0


def test_jaccard_unlinked_hub(spark, monkeypatch):
    """Copies that are linked through their original only, and pivots off: the pairwise path decides."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 30):
        v = list(base)
        for _ in range(r.randint(2, 6)):
            v[r.randrange(200)] = f"x{r.random()}"
        rows.append((i, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = H.jaccard_components(rows)
    for rounds in (3, 1):
        monkeypatch.setattr(jaccard_join, "PIVOT_ROUNDS", rounds)
        monkeypatch.setattr(jaccard_join, "FREQUENT", 4 if rounds == 3 else 10**6)
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.join_components(df).collect()}
        assert got == {k: w for (k, _), w in zip(rows, want, strict=True)}


def test_one_of_each(docs, empty):
    docs = docs.where("lang is null or lang <> 'de'")  # without the id that two different texts have
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    comps = H.jaccard_components(rows)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and one_count(comps) == kept.count()
    assert jaccard_join.one_of_each(empty).count() == 0


def one_count(comps):
    return len({c for n, c in comps if n}) + sum(1 for n, _ in comps if not n)


def test_fuzzy_lines(spark, docs, empty):
    r = random.Random(3)
    line = " ".join(f"word{r.randint(0, 99)}" for _ in range(40))
    extra = [(1000 + i, f"{line} {i % 3}\nshared line of all\n  \nSHARED  line of all\nonly {r.random()}", None, None, None, 0, "", "") for i in range(40)]
    long_ = " ".join(f"tok{r.randint(0, 999)}" for _ in range(500))
    extra += [(2000, long_, None, None, None, 0, "", ""), (2001, long_[:-7] + " changed", None, None, None, 0, "", "")]
    df = docs.unionByName(spark.createDataFrame(extra, DOC))
    got = line_dedup.dedup_lines(df).collect()
    keyed = {(x["doc_id"], x["h"], x["text"]) for x in df.selectExpr("doc_id", "xxhash64(cast(text as binary)) h", "text").collect()}
    assert {(x["doc_id"], x["h"], k) for x in got for k in x["kept"]} == H.kept_lines(list(keyed))
    assert len(got) == df.count()
    text = {x["doc_id"]: x["text"] for x in line_dedup.rewrite(df, line_dedup.dedup_lines(df)).collect()}
    assert text[1000].count("shared line of all") <= 1 and text[1007].startswith("  \n")
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_hashing_of_whole_batches():
    r = random.Random(5)
    odd = [b"\t a  b\x0b \xc3\xa9 \xc3\x9cn\xc3\xafx ", b"", b"\n\n X \n", b"A\rb\x0cc", b"a\x00b  c", b" one space \nB C", b"x"]
    for t in odd:
        assert line_dedup.plain_lines(t) == [line_dedup.plain(x) for x in t.split(b"\n")]
    words = ["straße", "word", "ñandú", "a", "tokens"]
    xs = [" ".join(r.choice(words) + str(r.randrange(50)) for _ in range(n)).encode() for n in (1, 1, 2, 9, 30, 100, 900) * 6] + [b"abc", "äöü".encode()]
    ys = [x[:len(x) // 2].decode("utf-8", "ignore").encode() + b"q" + x[len(x) // 2 + r.randrange(3):].decode("utf-8", "ignore").encode() for x in xs[:-2]] + [b"abc", b"abd"]
    sets = lambda x: (lambda u: {u[k:k + 8] for k in range(max(1, len(u) - 7))})(x.decode())
    assert any(len(x) > 10 * line_dedup.SHORT + 8 for x in xs)
    for x, y, got in zip(xs, ys, line_dedup.similarities(xs, ys), strict=True):
        assert got == len(sets(x) & sets(y)) / len(sets(x) | sets(y))
    h, first = line_dedup.shingles(xs)
    n = np.diff(np.append(first, len(h)))
    assert n.tolist() == [max(1, len(x.decode()) - 7) for x in xs]
    smallest, parts = line_dedup._by_functions(h, first), line_dedup._by_parts(h, n)
    for i in range(len(xs)):
        own = h[first[i]:first[i] + n[i]]
        assert smallest[i].tolist() == [int(((own >> np.uint64(32)).astype(np.uint32) * f).min()) for f in line_dedup._FACTORS]
        low: dict[int, int] = {}
        for v in map(int, own):
            low[(v >> 32) * 80 >> 32] = min(v, low.get((v >> 32) * 80 >> 32, v))
        for q in range(80):
            k = next(k for k in range(q, q + 80) if k % 80 in low) % 80
            assert int(parts[i, q]) == (low[k] + (k - q) * 0xD6E8FEB86659FD93) % 2**64


def test_similar_lines_in_long_mixed_lists(spark, monkeypatch):
    """Pairs of similar lines on one template, whose lists hold hundreds of lines that are not similar
    enough: each pair is found, whatever stands between in the list, also across blocks."""
    r = random.Random(8)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    template, lines = letters(240), []
    for _ in range(600):
        x = template + letters(40)
        y = list(x)
        for at in (60, 120, 180):
            y[at] = chr(35 + r.randrange(25))
        lines += [x, "".join(y)]
    sets = [frozenset(x[k:k + 8] for k in range(len(x) - 7)) for x in lines]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(alike(i, i + 1) > 0.82 and alike(i, (i + 2) % 1200) < 0.79 and alike(i + 1, (i + 3) % 1200) < 0.79 for i in range(0, 1200, 2))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").repartition(4)
    for block in (line_dedup.BLOCK, 150):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        got = {x["doc_id"]: x["kept"] for x in line_dedup.dedup_lines(df).collect()}
        assert got == {i: [0] if i % 2 == 0 else [] for i in range(1200)}


def test_sketches_never_rule_out_links():
    r = np.random.default_rng(6)
    for n in (1, 5, 60, 900, 20000):
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        for changed in {0, n // 50, n // 10, n // 9}:
            b = np.unique(np.concatenate([a[changed:], r.integers(0, 2**64, changed, dtype=np.uint64)]))
            x, y = line_dedup.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
            linked = line_dedup.links_across([a, b], np.array([0, 1]), np.zeros(2, int), 0.8)
            assert bool(linked) == (line_dedup.similarity(a, b) >= 0.8)


def test_benchmark_windows(spark, docs, empty):
    rows = docs.collect()
    texts = [r["text"] for r in rows if r["text"]]
    items = [(1, " ".join(H.plain_words(texts[0])[3:25])), (2, "one"), (3, None), (4, ""), (5, "... !"), (10, " ".join(H.plain_words(texts[4])[:12])),
             (10, " ".join(H.plain_words(texts[4])[:12])), (None, "one"), (6, "a b c d"), (9, "not there at all, this text")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted([(r["doc_id"], r["n_words"], sum(x["to"] - x["from"] for x in r["spans"]), list(r["items"])) for r in decontam.scan(docs, bench).collect()], key=repr)
    assert got == sorted([(r["doc_id"], *H.windows_found(r["text"], items)) for r in rows], key=repr)
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(1 for g in got if not g[2])
    spans = decontam.decontaminate(docs, bench, mode="spans")
    left = decontam.scan(spans, bench.where("item_id = 2")).where("size(items) > 0").count()
    assert spans.count() == len(rows) and left == 0
    assert decontam.scan(docs, bench.limit(0)).where("size(items) > 0").count() == 0 and decontam.scan(empty, bench).count() == 0


def test_benchmark_in_blocks(docs, spark, monkeypatch):
    """A benchmark beyond one broadcast block gives the same result."""
    texts = [r["text"] for r in docs.where("length(text) > 200").limit(6).collect()]
    bench = spark.createDataFrame([(i, " ".join(H.plain_words(t)[:30])) for i, t in enumerate(texts)], "item_id long, text string")
    one = sorted(map(repr, decontam.scan(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 4000)
    assert sorted(map(repr, decontam.scan(docs, bench).collect())) == one


def test_readers_of_token_codes_hold_no_words(monkeypatch):
    """A Python worker that wrote codes gives its remembered words back before it reads."""
    class Segments:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    monkeypatch.setattr(token_codes, "_segments", lambda *_: Segments())
    token_codes.encoder(queries.tokenizer_path(), True).encode([b"some words"])
    assert token_codes.encoder.cache_info().currsize
    assert list(token_codes.read_documents(None, "")(iter([]))) == []
    assert token_codes.encoder.cache_info().currsize == 0


def test_token_codes(spark, docs, empty):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.tokenizer_path())
    df = docs.unionByName(spark.createDataFrame([(5000, "Don't <|endoftext|> stop-it?! it's 42% ΣΑΣ naïve… é, (ok)'s", "", "", 0, 0, "", ""),
                                                 (5001, "<|startoftext|>ab<| x", "", "", 0, 0, "", "")], DOC))
    path = token_codes.write_codes(df, queries.tokenizer_path())
    got = sorted(token_codes.read_documents(spark, path).collect(), key=lambda r: r["start"])
    rows = df.selectExpr("doc_id", "text", "xxhash64(cast(text as binary)) h", "xxhash64(text) h2").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h2"]))
    start, flat = 0, []
    for r, g in zip(rows, got, strict=True):
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        flat += ids
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    places = [0, 1, 7, start // 2, start - 1, start, -1, None]
    found = {r["place"]: r["id"] for r in token_codes.lookup(spark, path, spark.createDataFrame([(p,) for p in places], "place long")).collect()}
    assert found == {p: flat[p] for p in places if p is not None and 0 <= p < start}
    assert token_codes.read_documents(spark, token_codes.write_codes(empty, queries.tokenizer_path())).count() == 0


def test_word_encoder_asks_for_letters_in_plain_calls():
    """Words of letters go to the library without special tokens between them, and a comma or full stop
    behind a word makes no further word; ids are those of whole texts in every context."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.tokenizer_path())

    class Calls:
        def __init__(self, tok):
            self.tok, self.texts = tok, []

        def __getattr__(self, name):
            return getattr(self.tok, name)

        def encode_batch_fast(self, texts, **kw):
            self.texts += texts
            return self.tok.encode_batch_fast(texts, **kw)

    enc = token_codes.WordEncoder(queries.tokenizer_path(), True)
    enc.letters, enc.tok = Calls(enc.letters), Calls(enc.tok)
    text = "Alpha beta, gamma. Alpha, straße,\ngamma, beta. é. alpha"
    assert enc.encode([text.encode()])[0] == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert not any(w.endswith((b",", b".")) for w in enc.known if len(w) > 1)
    assert [sorted(t.split()) for t in enc.letters.texts] == [sorted(["alpha", "beta", "gamma", "straße", "é"])]
    assert not any("alpha" in t for t in enc.tok.texts)
    r = random.Random(7)
    bits = [*"aZé9ßÄ×÷.,;!?'$-_<|> \n\t\x0b\x85\u0301\u00a0\u2028”İΣ五\x00", "'s", "'LL", " the ", ", ", ". ", "<|endoftext|>", "<|startoftext|>", "e\u0301, "]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 60))) for _ in range(1500)]
    for t, ids in zip(texts, enc.encode([t.encode() for t in texts]), strict=True):
        assert ids == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_segment_round_trip():
    r = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([0], np.uint32), r.integers(0, 2**32, 3000, dtype=np.uint32), r.integers(0, 300, 5000, dtype=np.uint32)):
        seg = token_codes.Segment(token_codes.pack([None, 5], np.array([len(ids) // 2, len(ids)]), ids))
        assert (seg.all() == ids).all() and seg.doc_ids == [None, 5] and seg.ends.tolist() == [len(ids) // 2, len(ids)]
        for i in r.integers(0, max(1, len(ids)), 40):
            if len(ids):
                assert seg.get(int(i)) == ids[i]
        with pytest.raises(IndexError):
            seg.get(len(ids))


def test_reply_trees(spark):
    #        0 -> 1 -> 3 -> 6      best path of tree t: 0 2 4 (score 9); u has one node; c is a cycle
    rows = [("t", 0, None, "user", "q", 0.0), ("t", 1, 0, "assistant", "a1", 1.0), ("t", 2, 0, "assistant", "a2 </turn>", 4.0), ("t", 3, 1, "user", "x", 1.0),
            ("t", 4, 2, "user", None, 5.0), ("t", 6, 3, "assistant", "y", 1.0), ("u", 0, 99, None, "alone", None), ("c", 0, 1, "user", "p", 0.0), ("c", 1, 0, "user", "q", 0.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    df = df.selectExpr("tree", "node", "parent", "coalesce(role, '') role", "coalesce(text, '') text", "score")
    out = {(r["tree"], r["rank"]): r for r in chat_format.format_paths(df, top=2).collect()}
    assert set(out) == {("t", 1), ("t", 2), ("u", 1)}
    assert chat_format.parse(out["t", 1]["formatted"]) == [("user", "q"), ("assistant", "a2 </turn>"), ("user", "")]
    assert chat_format.parse(out["t", 2]["formatted"]) == [("user", "q"), ("assistant", "a1"), ("user", "x"), ("assistant", "y")]
    assert [r["leaf"] for r in chat_format.format_paths(df, top=1).where("tree = 't'").collect()] == [4]


def test_conversations(spark):
    tricky = "\\### Assistant: </turn> ok\n### User:\n\\"
    rows = [(1, 0, "user", tricky, 1), (1, 1, "assistant", tricky, 1), (1, 1, "assistant", "again", 1), (2, None, "a:\nb", None, 2), (None, 0, "assistant", "x", 3),
            (3, 0, "assistant", "", 4)] + [(9, i, "user" if i % 2 else "assistant", f"t{i}", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node long")
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_paths(chat_format.conversations_as_trees(df))).collect()}
    for k in {r[0] for r in rows}:
        mine = sorted([(-1 if r[1] is None else r[1], r[2], r[3] or "") for r in rows if r[0] == k])
        loss = "".join(t for _, role, t in mine if role == "assistant")
        assert got[k]["n_turns"] == len(mine) and got[k]["loss_chars"] == len(loss)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in mine).encode()).hexdigest()
        assert got[k]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert len(got) == 5
    assert chat_format.format_paths(chat_format.conversations_as_trees(df.limit(0))).count() == 0


def test_url_rules_and_reputation(spark):
    urls = [None, "", "no scheme", "http://A.example.com/en/1?x#y", "https://www.example.com/en/2", "https://b.www.example.com/en/", "http://x.com", "http://x.com/",
            "http://notcom/", "ftp://a.net/es/z", "http://a.net/FR/", "http://a.net/fr/#", "x://h?q/p", "://", "a://b://c/d"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(100 + i, f"http://bad.org/{i}", "") for i in range(60)] + [(200 + i, f"http://good.org/{i}", "") for i in range(60)]
    rows += [rows[3], (None, "http://bad.org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    outcomes = spark.createDataFrame([("bad.org", 0)] * 50 + [("good.org", 1)] * 50 + [("x.com", 1), ("x.com", None)], "host string, good int")
    got = {(r["page_id"], r["host"]): r for r in url_filter.judge(pages, outcomes, queries.URL_RULES).collect()}
    by = {k[0]: r for k, r in got.items()}
    assert [(by[i]["host"], by[i]["path"], by[i]["rule"]) for i in range(len(urls))] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/2", "www.example.com/en/"),
        ("b.www.example.com", "/en/", "www.example.com/en/"), ("x.com", "", None), ("x.com", "/", "com/"), ("notcom", "/", None), ("a.net", "/es/z", "net/es/"),
        ("a.net", "/FR/", None), ("a.net", "/fr/", "net/fr/"), ("h", "", None), ("", "", None), ("b:", "//c/d", None)]
    assert by[3]["verdict"] == "block" and by[4]["verdict"] == "allow" and by[9]["verdict"] == "block" and by[6]["verdict"] == "allow"
    assert {by[100 + i]["verdict"] for i in range(60)} == {"block"} and {by[200 + i]["verdict"] for i in range(60)} == {"allow"}
    none = url_filter.judge(pages, outcomes.limit(0), []).collect()
    assert {r["verdict"] for r in none} == {"allow"} and len(none) == len(rows)
    assert url_filter.judge(pages.limit(0), outcomes, queries.URL_RULES).count() == 0


def test_reputation_shrinks(spark):
    rows = [("a.big.org", 1)] * 90 + [("a.big.org", 0)] * 10 + [("b.big.org", 0)] + [("c.bad.net", 0)] * 40 + [("d.bad.net", 1)]
    rep = {r["host"]: r for r in url_filter.reputation(spark.createDataFrame(rows, "host string, good int")).collect()}
    assert 0 < rep["b.big.org"]["mean"] < rep["a.big.org"]["mean"] < 1  # one bad page, pulled up by its domain
    assert rep["c.bad.net"]["mean"] < rep["d.bad.net"]["mean"] < 1 and all(r["lower"] <= r["mean"] <= r["upper"] for r in rep.values())


def test_hosts_without_outcomes(spark):
    """Such a host has the mean of its domain, else of its suffix, else of the table."""
    rows = [("a.bad.net", 0)] * 60 + [("b.bad.net", 0)] * 50 + [("b.bad.net", 1)] + [("www.fine.net", 1)] * 400 + [("good.org", 1)] * 80 + [("x.good.org", 1)] * 40 + [("x.good.org", 0)]
    outcomes = spark.createDataFrame(rows, "host string, good int")
    urls = ["http://new.bad.net/1", "http://new.bad.net/2", "http://bad.net/", "http://new.fine.net/", "http://other.net/", "http://y.good.org/", "http://far.xyz/", None, "http://a.bad.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, outcomes, []).collect()}
    assert [got[i]["verdict"] for i in range(len(urls))] == ["block", "block", "block", "allow", "allow", "allow", "allow", "allow", "block"]
    assert all(r["mean"] is not None and r["upper"] >= r["mean"] for r in got.values())
    rep = {r["host"]: r for r in url_filter.reputation(outcomes, hosts=pages.select(url_filter.host_of(pages.url).alias("host"))).collect()}
    assert rep["new.bad.net"]["n"] == 0 and rep["new.bad.net"]["mean"] == rep["bad.net"]["mean"] < rep["other.net"]["mean"] < rep["new.fine.net"]["mean"]
    n, good = len(rows), sum(g for _, g in rows)
    assert rep["far.xyz"]["mean"] == rep[""]["mean"] == pytest.approx((good + 0.5) / (n + 1))
    before = {r["host"]: r for r in url_filter.reputation(outcomes).collect()}  # further hosts change nothing for those with outcomes
    assert all(rep[h]["mean"] == pytest.approx(r["mean"]) and rep[h]["upper"] == pytest.approx(r["upper"]) for h, r in before.items())


def test_registered_domains(spark):
    hosts = {"a.b.example.com": ("com", "example.com"), "example.com:8080": ("com", "example.com"), "u:p@www.example.com:1": ("com", "example.com"),
             "www.shop.co.uk": ("co.uk", "shop.co.uk"), "other.co.uk:80": ("co.uk", "other.co.uk"), "co.uk": ("co.uk", "co.uk"), "localhost": ("localhost", "localhost"),
             "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "[::1]:80": ("[::1]", "[::1]"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r["host"]: (r["s"], r["d"]) for r in df.select("host", url_filter.registered(df.host)[0].alias("s"), url_filter.registered(df.host)[1].alias("d")).collect()}
    assert got == hosts
    # one bad shop under co.uk does not pull down the others' domain; a port does not make a new one
    rows = [("bad.co.uk", 0)] * 60 + [("www.good.co.uk:8080", 1)] * 60 + [("fine.org", 1)] * 60
    rep = {r["host"]: r for r in url_filter.reputation(spark.createDataFrame(rows, "host string, good int"),
                                                       hosts=spark.createDataFrame([("good.co.uk",), ("bad.co.uk:443",)], "host string")).collect()}
    assert rep["good.co.uk"]["domain"] == "good.co.uk" and rep["good.co.uk"]["mean"] > 0.9 > 0.1 > rep["bad.co.uk:443"]["mean"]


def test_nearest(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.standard_normal(8)], 1) for i in range(400)]
    rows += [(500 + i, rows[0][1], 2) for i in range(15)]  # ties
    rows += [(700, None, 0), (701, [0.0] * 8, 0), (702, [1.0] * 7 + [None], 0), (703, [float("nan")] * 8, 0), (704, [float("inf")] + [1.0] * 7, 0),
             (None, rows[1][1], 0), (800, [1.0, 2.0], 0), (801, [3.0, 4.0], 0), rows[5], rows[5], (900, [1e-320] * 8, 0), (1000, [1e200] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in ann_join.nearest(df, lambda i: i % 100 == 0, 10).collect()}
    good = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    for q, v in sorted(good):
        if q % 100 == 0:
            with np.errstate(over="ignore"):
                near = sorted((float(np.sqrt(((np.array(c) - np.array(v)) ** 2).sum())), i) for i, c in good if i != q and len(c) == len(v))[:10]
            assert [got[q, k + 1] for k in range(len(near))] == [(i, s) for s, i in near]
            assert (q, len(near) + 1) not in got
    assert ann_join.nearest(df.limit(0), lambda i: i % 100 == 0, 10).count() == 0


def test_quality_model(spark, empty):
    r = random.Random(1)
    good = [" ".join(r.choice(["the", "and", "other", "then"]) for _ in range(r.randint(5, 400))) for _ in range(150)]
    bad = [" ".join(r.choice(["the###", "and$$", "other%%", "then"]) for _ in range(r.randint(5, 400))) for _ in range(60)]
    rows = [(i, t, "s") for i, t in enumerate(good + bad)] + [(900, None, "x"), (901, "", "x"), (902, "the " * 40000, "x"), (3, good[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(210)] + [(5000, 1), (7, None), (None, 0)], "doc_id long, quality int")
    model = byte_cnn.fit(df, labels, held_out=queries.held_out)
    out = byte_cnn.add_score(df, model, "p").collect()
    assert len(out) == len(rows) and all(0 <= x["p"] <= 1 for x in out)
    held = {x["doc_id"] for x in df.where(queries.held_out(df.doc_id)).collect()}
    unseen = [x for x in out if x["doc_id"] in held and x["doc_id"] < 210]
    assert len(unseen) > 20 and sum((x["p"] >= 0.5) == (x["doc_id"] < 150) for x in unseen) >= 0.95 * len(unseen)
    again = byte_cnn.add_score(df, byte_cnn.fit(df.repartition(5), labels, held_out=queries.held_out), "p")
    assert {x["doc_id"]: x["p"] for x in again.collect()} == {x["doc_id"]: x["p"] for x in out}
    none = byte_cnn.fit(df, labels.limit(0))
    assert {x["p"] for x in byte_cnn.add_score(df, none, "p").collect()} == {0.5} and byte_cnn.add_score(empty, none, "p").count() == 0


def test_cnn_covers_whole_text():
    model = byte_cnn.Model()
    for n in (0, 1, 3, 4, 511, 512, 513, 1016, 5000, 64 * 504 + 9):
        text = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)
        f = model.features(text)
        whole = model.respond(byte_cnn.padded(text)).max(axis=0)
        assert np.allclose(f[:byte_cnn.FILTERS], whole)  # the largest response over chunks is that of the text


def test_cnn_learns_from_whole_texts():
    """Marks that stand anywhere but at the start, in the middle or at the end of long texts; clean texts
    are not rejected, however long."""
    r = random.Random(4)
    word = lambda: r.choice(["the", "and", "other", "then"])

    def text(n, marked):
        w = [word() for _ in range(n)]
        for _ in range(n // 40 + 1 if marked else 0):
            w[int(n * r.choice([r.uniform(0.2, 0.35), r.uniform(0.65, 0.8)]))] = "#$%&"
        return " ".join(w).encode()

    sizes = [600, 1200, 2400]
    y = [int(i % 2) for i in range(120)]
    model = byte_cnn.train([text(sizes[i % 3], not y[i]) for i in range(120)], y)
    for n in (60, *sizes, 9600):
        score = lambda marked: [model.head(model.features(np.frombuffer(text(n, marked), np.uint8))[None])[0] for _ in range(15)]  # noqa: B023, E731
        good, bad = score(False), score(True)
        assert min(good) > max(bad) and min(good) >= queries.QUALITY_SCORE


def test_cnn_trains_on_the_scored_features():
    model = byte_cnn.Model()
    for n in (0, 3, 100, 513, 5000, 64 * 504 + 9):
        text = byte_cnn.padded(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        f, place, top, mean = byte_cnn._forward(model, text)
        assert np.allclose(f, model.features(text), atol=1e-5) and np.allclose(top.max(axis=0), f[:byte_cnn.FILTERS])
        assert place.max() + byte_cnn.WIDTH <= len(text) and np.allclose(mean.mean(axis=0), f[3 * byte_cnn.FILTERS:], atol=1e-5)


def test_cnn_gradients(spark):
    """The gradient of every kind of parameter against differences of the loss, in double precision."""
    r = np.random.default_rng(5)
    model = byte_cnn.Model()
    docs = [byte_cnn.padded(r.integers(97, 103, n, dtype=np.uint8)) for n in (0, 3, 40, 700, 3000, 64 * 504 + 200)]
    y = np.array([0, 1, 0, 1, 1, 0], np.float32)
    for name in ("table", "bias", "w1", "b1", "w2", "b2", "centre", "scale"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    _, grads = byte_cnn.loss_and_gradients(model, docs, y)
    assert np.count_nonzero(grads[0][:, 97:103]) > 300
    for p, g in zip(model.params(), grads, strict=True):
        used = np.flatnonzero(np.abs(g.ravel()) > 1e-4)
        for k in r.choice(used, min(12, len(used)), replace=False):
            at, eps = np.unravel_index(k, p.shape), 1e-6
            was = p[at]
            p[at] = was + eps
            up = byte_cnn.loss_and_gradients(model, docs, y)[0]
            p[at] = was - eps
            down = byte_cnn.loss_and_gradients(model, docs, y)[0]
            p[at] = was
            assert (up - down) / (2 * eps) == pytest.approx(g[at], rel=2e-2, abs=2e-5)


def test_cnn_score_once_more(spark):
    """Scores from plain loops over chunks, places and filter bytes."""
    r = np.random.default_rng(9)
    model = byte_cnn.train([bytes(r.integers(97, 105 + 3 * (i % 2), 30 + 40 * i, dtype=np.uint8)) for i in range(24)], [i % 2 for i in range(24)])

    def plain(text):
        text = text + bytes(max(0, byte_cnn.WIDTH - len(text)))
        tops, means = [], []
        for s in range(0, max(1, len(text) - byte_cnn.OVERLAP), byte_cnn.CHUNK - byte_cnn.OVERLAP):
            chunk = text[s:s + byte_cnn.CHUNK]
            rows = []
            for a in range(len(chunk) - byte_cnn.WIDTH + 1):
                v = model.bias.astype(float)
                for k in range(byte_cnn.WIDTH):
                    v = v + model.table[k, chunk[a + k]]
                rows.append(np.maximum(v, 0))
            tops.append(np.max(rows, axis=0))
            means.append(np.mean(rows, axis=0))
        f = np.concatenate([np.max(tops, axis=0), np.mean(tops, axis=0), np.max(means, axis=0), np.mean(means, axis=0)])
        h = np.maximum((f - model.centre) / model.scale @ model.w1 + model.b1, 0)
        return 1 / (1 + np.exp(-(h @ model.w2 + model.b2[0])))

    texts = ["", "ab", "some text é", "the end " * 90, "x" * 1016, "#$% " * 600]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["p"] for x in byte_cnn.add_score(df, model, "p").collect()}
    assert all(got[i] == pytest.approx(plain(t.encode()), abs=1e-4) for i, t in enumerate(texts))


def test_training_sample_is_bounded(spark, monkeypatch):
    """Repeated ids, labels without documents and long texts do not grow what comes to the driver."""
    taken = []
    monkeypatch.setattr(byte_cnn, "train", lambda texts, labels: taken.append((texts, labels)))
    monkeypatch.setattr(byte_cnn, "TRAIN_DOCS", 50)
    monkeypatch.setattr(byte_cnn, "TRAIN_BYTES", 5000)
    df = spark.createDataFrame([(1, f"copy {i}") for i in range(300)] + [(i, "t" * (10 + i)) for i in range(2, 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 3000)], "doc_id long, quality int")
    byte_cnn.fit(df, labels)
    byte_cnn.fit(df.repartition(7), labels)
    (texts, y), again = taken
    assert (texts, y) == again and 20 < len(texts) <= 50 and sum(map(len, texts)) <= 5000 and len(set(texts)) == len(texts)


def test_clashing_names(spark):
    """Columns named like the operators' own go through unchanged."""
    names = ["rid", "rh", "__id", "__h", "__rid", "__rh", "__kept", "h", "group", "cls", "component", "id", "score", "word", "part"]
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, t, *range(len(names))) for i, t in [(1, text), (2, text + " more"), (3, "other"), (3, "other"), (4, None), (5, "a line\na line")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns and sorted((r["doc_id"], r["rid"], r["__rh"]) for r in kept.collect()) == [(i, 0, 5) for i in (1, 3, 4, 5)]
    new = line_dedup.rewrite(df, line_dedup.dedup_lines(df))
    assert new.columns == df.columns and {r["doc_id"]: (r["text"], r["__kept"]) for r in new.collect()}[5] == ("a line", 6)
    model = byte_cnn.Model()
    assert byte_cnn.add_score(df, model, "p").select(df.columns).count() == len(rows)


def test_page_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
      <header><h2>Site</h2></header><nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav><div class="cookie-notice">We use cookies here</div>
      <!-- ad <p>no --><div class="ad">Buy now</div><article class="post"><h1>Head &amp; line</h1><p><b>First   para&nbsp;graph<br>goes on
      <p>One.</p><div>5 &lt; 6 &#8217;q&#8217; a < b</div><form>Name <input></form><aside>Related <a href=z>link</a></aside>
      <ul><li>item <a href=w>w</a></li></ul><div id="comments"><p>Nice post, I think so too and more words here to be long</p></div></article>
      <div class="sidebar"><p>Side text that is long enough to look like a paragraph of the main text, or so it seems.</p></div><footer>&copy; 2020</footer></body></html>"""
    plain = "<p>" + "A page without marks, only a long paragraph of text. " * 3 + "</p><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul><p>Short end</p>"
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<article><p>cut &amp; off</p><p>here <a hr", "x"), (5, "u", plain, "x"),
            (6, "u", "<article><p>" + "word " * 50000 + "</p><script>never ends", "x"), (1, "u", page, "x"), (7, "u", "</p></div>stray<p>tags</b></article>", "x"),
            (8, "u", "<article>" + "<div>" * 3000 + "deep", "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert text[1] == "Head & line\nFirst para graph goes on\nOne.\n5 < 6 ’q’ a < b\nitem w"
    assert text[2] == "" and text[3] == "" and text[4] == "cut & off\nhere" and text[6] == ("word " * 50000).strip() and text[8] == "deep"
    assert text[5] == ("A page without marks, only a long paragraph of text. " * 3).strip() + "\nShort end" and text[7] == "stray\ntags"


def test_tree_fits_its_table():
    tree = html_text.grow(html_text.LABELLED)
    assert all(html_text.decide(tree, r[:-1]) == r[-1] for r in html_text.LABELLED)


def test_targets():
    assert source_mix.targets([100, 100, 100], [5, 2, 1], 1.5, 2) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert source_mix.targets([], [], 1.5, 2) == [] and source_mix.targets([0, 10], [5, 1], 1.5, 2) == [0.0, 15.0]


def test_flow_overlapping_sources():
    """Two sources share a pattern: it goes to the one that cannot be met otherwise, copies only then."""
    flow = source_mix.min_cost_flow([((0,), 100), ((0, 1), 60), ((1,), 20)], [150, 70], 2)
    assert [sum(x) for x in zip(*flow, strict=True)] == [150, 70]
    assert all(sum(f) <= 2 * s for f, s in zip(flow, [100, 60, 20], strict=True))
    repeats = sum(max(0, sum(f) - s) for f, s in zip(flow, [100, 60, 20], strict=True))
    assert repeats == 40  # 220 words of 180


def test_mix(docs, empty):
    out = source_mix.mix(docs, lambda i: queries.SOURCE_WEIGHTS[i % 3]).collect()
    rows = docs.collect()
    sizes = sorted(len(H.plain_words(r["text"])) for r in rows)
    assert sorted(r["size"] for r in out) == sizes and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    by: dict = {}
    for r in out:
        x = by.setdefault((r["source_size"], r["target"]), [0, 0])
        x[0] += r["taken"]
        x[1] += r["size"]
    assert len(by) == len({r["source"] for r in rows})
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(sizes))
    for (size, target), (taken, own) in by.items():
        assert own == size and target <= 2 * size and abs(taken - target) <= 0.05 * target + 5  # one document holds most of a source
    again = source_mix.mix(docs.repartition(7), lambda i: queries.SOURCE_WEIGHTS[i % 3]).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    copies = source_mix.mixed(docs, lambda i: queries.SOURCE_WEIGHTS[i % 3])
    assert copies.columns == docs.columns and copies.count() == sum(r["copies"] for r in out)
    assert source_mix.mix(empty, lambda i: 1).count() == 0


def test_mix_leaves_texts_where_they_are(docs):
    """The mix's plan and bin ends are a row for each pattern: no join sorts or shuffles the texts for them."""
    plan = source_mix.mixed(docs, lambda i: queries.SOURCE_WEIGHTS[i % 3])._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_words_that_a_worker_remembers(monkeypatch):
    """Both memories together hold two limits and one slice's words at most, and the ids stay the same."""
    assert token_codes.CACHE_WORDS <= 250_000
    texts = [" ".join(f"w{i}q{j}" for j in range(40)).encode() for i in range(30)]
    whole = token_codes.WordEncoder(queries.tokenizer_path(), True).encode(texts)
    monkeypatch.setattr(token_codes, "CACHE_WORDS", 100)
    small = token_codes.WordEncoder(queries.tokenizer_path(), True)
    assert [small.encode([t])[0] for t in texts] == whole
    assert len(small.known) + len(small.old) <= 2 * (100 + 40)


def test_long_words_that_a_worker_remembers(monkeypatch):
    r = random.Random(8)
    texts = [" ".join("".join(r.choices("abcdefgh", k=400)) for _ in range(5)).encode() for _ in range(40)]
    whole = token_codes.WordEncoder(queries.tokenizer_path(), True).encode(texts)
    monkeypatch.setattr(token_codes, "CACHE_BYTES", 10_000, raising=False)
    small = token_codes.WordEncoder(queries.tokenizer_path(), True)
    assert [small.encode([t])[0] for t in texts] == whole
    held = [sum(len(w) + len(ids) for w, ids in m.items()) for m in (small.known, small.old)]
    assert max(held) <= 10_000 + 2 * max(len(t) + len(w) for t, w in zip(texts, whole, strict=True)), held


def test_token_codes_arrow_batches(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(4 << 20))
    try:
        docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
        path = token_codes.write_codes(docs, queries.tokenizer_path(), path=str(tmp_path / "codes"))
        assert int(spark.conf.get(key)) <= 1 << 20
        assert [r["n_tokens"] for r in token_codes.read_documents(spark, path).orderBy("doc_id").collect()] == [3, 1]
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
