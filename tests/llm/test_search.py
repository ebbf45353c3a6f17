"""Ranked search, decontamination and the manifest against plain versions on small tables."""

import math
import random
import re
from collections import Counter, defaultdict

from kith.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def terms(text):
    return TERM.findall(lower(text))


def plain_search(docs, items, top):
    rows = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    rows = [r for r in rows if r[2]]
    n, total = len(rows), sum(r[2] for r in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, c, size in rows:
            m = 25 + 75 * size * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in wanted.items() if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def corpus(r, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "naïve", "X9", "ﬁ"]
    text = lambda k: " ".join(vocabulary[min(len(vocabulary) - 1, int(r.expovariate(0.08)))] for _ in range(k))
    docs = [(i, text(r.choice([1, 3, 20, 60]))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(40)] + [(5, "w1 w1 W2"), (5, "w1 w1 W2"), (None, docs[3][1]), (None, "w1"), (n + 99, None), (n + 98, ""), (n + 97, " .,-")]
    return docs, [(i, text(r.choice([1, 2, 8, 30]))) for i in range(25)] + [(3, "w1 w2 w2"), (None, "w1 zzz"), (40, ""), (41, None), (42, "nowhere"), (43, docs[3][1])]


def test_ranked_search(spark):
    r = random.Random(7)
    docs, items = corpus(r, 400)
    df = spark.createDataFrame([(t, i, 1) for i, t in docs], "text string, doc_id long, term int").repartition(3)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, block int")
    want = plain_search(docs, items, 10)
    options = [lexical.SearchOptions(block_bytes=4_000, window=16), lexical.SearchOptions(short=0), lexical.SearchOptions(block_bytes=9_000, window=8, short=1, pairs=60)]
    for opts in options:
        got = lexical.search(lexical.build(df, opts), asked, opts).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_walk_skips_windows_that_cannot_reach_the_floor(monkeypatch):
    import numpy as np

    opened = []
    docs = np.arange(4096)
    gain = np.where(docs < 64, 1000, 1) + docs % 3
    kept = lexical.Kept(5)
    offer = kept.offer
    monkeypatch.setattr(kept, "offer", lambda *a: (opened.append(len(a[0])), offer(*a)))
    opts = lexical.SearchOptions(top=5, window=64, short=0)
    lists = [(lexical.Postings(docs, gain, 64, 64), 1), (lexical.Postings(docs[::2], gain[::2], 64, 64), 2)]
    lexical.walk(lists, docs, np.zeros(4096, bool), kept, opts)
    assert len(opened) == 1 and kept.score.tolist() == sorted((gain + 2 * np.where(docs % 2 == 0, gain, 0)).tolist(), reverse=True)[:5]


def test_ranked_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(lexical.build(none), items).collect() == []
    some = lexical.build(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"))
    assert lexical.search(some, items.limit(0)).collect() == []
    assert [tuple(x) for x in lexical.search(some, items).collect()] == plain_search([(1, "a"), (2, None)], [(1, "a b")], 10)


def h(*parts):
    import hashlib

    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(hashes):
    """The root and each leaf's path of (left, right)."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        runs = [level[i:i + 8] for i in range(0, len(level), 8)]
        for i, p in enumerate(at):
            paths[i].append(("".join(runs[p // 8][:p % 8]), "".join(runs[p // 8][p % 8 + 1:])))
            at[i] = p // 8
        level = [h(*run) for run in runs]
    return level[0], paths


def plain_manifest(rows):
    import zlib

    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by_lang = defaultdict(list)
    for doc, source, lang, n, text in rows:
        make = lambda t: h(*map(framed, (doc, source, lang, n, t)))
        tampered = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 and text is not None
        by_lang[lang].append((doc, make(text), make(lower(text) if tampered else text)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = plain_tree([x[1] for x in by_lang[lang]])
    root, tops = plain_tree([trees[x][0] for x in langs])
    out = []
    for lang, top in zip(langs, tops):
        for (doc, leaf, found), path in zip(by_lang[lang], trees[lang][1]):
            x = found
            for left, right in path + top:
                x = h(left, x, right)
            out.append((doc, leaf, trees[lang][0], root, h(*[a + b for a, b in path + top]), x, x == root))
    return sorted(out, key=str)


def test_manifest(spark, monkeypatch):
    from pyspark.sql import functions as F

    from kith.llm import manifest
    from kith.llm.queries import LOWER, UPPER

    def check(rows):
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, path string, g int")
        chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
        m = manifest.manifest(df.repartition(3), F.when(chosen, F.translate("text", UPPER, LOWER)))
        assert sorted(map(tuple, manifest.verify(m).collect()), key=str) == (plain_manifest(rows) if rows else [])
        assert (m.root is None) == (not rows)

    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", None]), r.choice(["en"] * 9 + ["dé", "z", None]), r.choice([None, i]), r.choice([f"Text {i} Ä", None, ""])) for i in range(700)]
    rows += [(5, "a", "en", 1, "A")] * 30 + [(None, "a", "en", 1, "A")] * 9 + [(i, "a", f"l{i}", 1, "Q") for i in range(20)] + [(9, None, "tall", None, "Z" * 300_000)]
    monkeypatch.setattr(manifest, "BLOCK", 64)
    check(rows)
    check([])
    check([(4, "a", "en", 1, "One Text")])
    check([(i, None, None, None, "Tt") for i in range(9)])


def test_manifest_finds_what_was_changed(spark):
    from kith.llm import manifest

    docs = spark.range(100).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "1L AS n_chars", "concat('text ', id) AS text")
    other = docs.selectExpr("doc_id", "source", "lang", "n_chars", "text", "CASE WHEN doc_id = 57 THEN 'other' WHEN doc_id = 3 THEN text END AS copy")
    from pyspark.sql import functions as F

    got = {x.doc_id: x.verified for x in manifest.verify(manifest.manifest(other, F.col("copy"))).collect()}
    assert [k for k, ok in got.items() if not ok] == [57] and len(got) == 100


def plain_hits(docs, items, k):
    phrases = defaultdict(set)
    for item, text in items:
        ws = terms(text)
        for i in range(max(1, len(ws) - k + 1)) if ws else ():
            phrases[tuple(ws[i:i + k])].add(item)
    lengths, out = {len(p) for p in phrases}, []
    for doc, text in docs:
        ws, hit, found = terms(text), set(), set()
        for n in lengths:
            for i in range(len(ws) - n + 1):
                if (p := tuple(ws[i:i + n])) in phrases:
                    hit |= set(range(i, i + n))
                    found |= phrases[p] - {None}
        out.append((doc, len(ws), sorted(hit), sorted(found)))
    return sorted(out, key=str)


def benchmark_corpus(r):
    word = lambda: "w" + str(r.randrange(30))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40) for _ in range(6)] + [text(9), text(4), "Ünder x9", "w3 w3 w3 w3 w3 w3 w3 w3 w3 w3 w3 w3 w3"]
    docs = [(i, " ".join([text(r.choice([0, 3, 30, 300])), r.choice(passages), text(r.choice([0, 50]))])) for i in range(60)]
    docs += [(i, text(80)) for i in range(60, 90)] + [(100 + i, docs[2][1]) for i in range(20)] + [(7, docs[3][1].upper()), (None, docs[4][1]), (None, None), (201, ""), (202, ".,")]
    docs += [(300, text(1500) + " " + passages[0] + " " + text(700)), (301, " ".join(["w3"] * 900)), (302, passages[1] + "\n" + passages[1])]
    items = [(i, p) for i, p in enumerate(passages)] + [(3, passages[0]), (None, passages[5]), (50, ""), (51, None), (52, "nowhere to be found"), (53, passages[2][20:])]
    return docs, items


def test_decontamination(spark):
    from kith.llm import fm_index

    docs, items = benchmark_corpus(random.Random(11))
    df = spark.createDataFrame([(t, i, 1) for i, t in docs], "text string, doc_id long, doc int").repartition(3)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, part int")
    for k, opts in [(10, fm_index.IndexOptions()), (10, fm_index.IndexOptions(segment=16, rate=4, symbols=700, rows=50)), (4, fm_index.IndexOptions(phrase=4, segment=5, rate=1, pairs=40))]:
        got = fm_index.search(fm_index.build(df, opts), asked, opts).collect()
        for x in got:
            assert all(a.end < b.start for a, b in zip(x.spans, x.spans[1:])) and x.n_hit == sum(s.end - s.start for s in x.spans)
        rows = [(x.doc_id, x.n_words, [i for s in x.spans for i in range(s.start, s.end)], sorted(x["items"])) for x in got]
        assert sorted(rows, key=str) == plain_hits(docs, items, k)


def test_decontamination_of_empty_tables_and_removal(spark):
    from kith.llm import fm_index

    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "One two, three"), (2, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Zero one TWO three. Four", 3), (1, "one two", 4), (None, "é one; two three one two three!", 5), (2, None, 6)], "doc_id long, text string, row int")
    assert fm_index.search(fm_index.build(none), items).collect() == []
    assert [tuple(x)[1:3] for x in fm_index.search(fm_index.build(docs.filter("doc_id = 2")), items.limit(0)).collect()] == [(0, 0)]
    got = sorted(map(tuple, fm_index.remove(docs, items).collect()), key=lambda x: x[2])
    assert got == [(1, "Zero . Four", 3), (1, "one two", 4), (None, "é !", 5), (2, None, 6)]


def test_suffixes_and_wavelet():
    import numpy as np

    from kith.llm import fm_index

    r = np.random.default_rng(5)
    text = np.concatenate([r.integers(1, 4, n).tolist() + [0] for n in (0, 5, 40, 40, 1)]).astype(np.int64)
    text[47:87] = text[6:46]
    ends = np.flatnonzero(text == 0)
    named = [(-len(ends) + int(np.searchsorted(ends, i)) if c == 0 else int(c)) for i, c in enumerate(text)]
    assert fm_index.suffixes(text, ends).tolist() == sorted(range(len(text)), key=lambda i: named[i:])
    symbols = r.integers(0, 37, 300)
    w = fm_index.Wavelet.of(symbols, 6)
    at = np.arange(300)
    symbol, before = w.access(at)
    assert (symbol == symbols).all() and before.tolist() == [(symbols[:i] == symbols[i]).sum() for i in at]
    for c in (0, 5, 36):
        assert w.rank(np.full(301, c), np.arange(301)).tolist() == np.concatenate([[0], np.cumsum(symbols == c)]).tolist()
