"""SentencePiece, chat, quality, pages, personal data and records against plain versions and exact round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kith.llm import chat, dom, html_extract, pii, quality, records, sentencepiece, trees

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "  two  spaces ", "▁ mark", "tab\tand\nline", "😀 中文 ½", "x" * 3000, " " * 700 + "end", "the same", "the same", "<s> </s> \x00"]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_pieces_equal_the_library():
    import sentencepiece as library

    sp, m, r = library.SentencePieceProcessor(model_file=PIECES), sentencepiece.Pieces(PIECES, memo=500), random.Random(3)
    texts = [t or "" for t in TEXTS] + [" " * n + "b" for n in range(70)]
    texts += ["".join(r.choice("abcdeß ▁\n.,!0123é½中😀thingeron") for _ in range(r.randint(0, 300))) for _ in range(300)]
    texts += ["".join(r.choice("thingeronat") for _ in range(20_000))]
    for t in texts:
        ids = np.frombuffer(m.encode(t), "<i4").tolist()
        assert ids == sp.encode(t), t[:50]
        assert m.decode(ids) == sp.decode(ids)


def test_window_stays_bounded():
    m, r = sentencepiece.Pieces(PIECES), random.Random(1)
    text, longest = "".join(r.choice("thingeronatx") for _ in range(5000)), 0
    paths, keep = sentencepiece.Pieces._path, []
    sentencepiece.Pieces._path = staticmethod(lambda ends, place: keep.append(len(ends)) or paths(ends, place))
    try:
        m.word(text)
    finally:
        sentencepiece.Pieces._path = staticmethod(paths)
    assert max(keep) <= 12 * m.longest + longest


def test_sentencepiece_tables(spark):
    df = table(spark, [(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "a", None)], "id long, text string, ids int")
    back = sentencepiece.decode(sentencepiece.encode(df, PIECES, keep_text=True), PIECES, text="decoded", keep_ids=True).collect()
    assert len(back) == len(TEXTS) + 1
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in back)
    assert sentencepiece.encode(df.filter("false"), PIECES).count() == 0


def test_chat_reads_back(spark):
    r = random.Random(5)
    rows = [(c, i, r.choice(["user", "assistant", "system", "a:b"]), r.choice([None, "", "### user: x</turn>\n", "\\l\\b<#:", "w " * r.randint(1, 90)]), "x")
            for c in range(12) for i in range(r.randint(1, 40))] + [(None, None, None, None, "x"), (3, 0, "user", "same", "x"), (3, 0, "user", "same", "x")]
    df = table(spark, rows, "conv_id long, turn long, role string, text string, window string")
    opts = chat.ChatOptions(budget=60, history=20, block=4)
    wins = chat.windows(df, opts)
    found = {x.conv_id: x for x in chat.digest(chat.read_back(wins)).collect()}
    first = lambda t: (t is not None, t)
    for c in {x[0] for x in rows}:
        turns = sorted(((x[1], x[2] or "", x[3] or "") for x in rows if x[0] == c), key=lambda t: (first(t[0])[0], t[0] or 0, t[1], t[2]))
        loss = "".join(t[2] for t in turns if t[1] == "assistant")
        assert found[c].n_turns == len(turns) and found[c].loss_chars == len(loss)
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert found[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for w in wins.collect():
        pieces = w.formatted.split(chat.END)[:-1]
        tokens = [len(chat_words(p.split(": ", 1)[1])) + opts.overhead for p in pieces]
        new = tokens[w.first_new:]
        assert len(new) >= 1 and (sum(new) <= opts.budget or len(new) == 1)
    assert chat.digest(chat.read_back(chat.windows(df.filter("false")))).count() == 0


def chat_words(escaped):
    return re.findall(r"[^\x20\x09-\x0D]+", escaped)


def test_quality_statistics(spark):
    r = random.Random(2)
    texts = TEXTS + [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) + r.choice(["", "\n", "\nq\nq\n \n\n"]) for _ in range(60)]
    df = table(spark, [(i, t, 1) for i, t in enumerate(texts)], "id long, text string, n_words int")
    for row in quality.measure(df).collect():
        t = row.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (row.n_words, row.word_chars, row.n_repeat_words, row.n_dup_lines) == (
            len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines))), t[:40]
        assert row.n_symbols == sum(c in "#*$%&|<>" for c in t)
    empty = quality.quality_rules(df.filter("false"))
    assert empty.count() == 0 and {"kept", "posterior"} <= set(empty.columns)


def test_quality_keeps_prose_and_rejects_junk(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    prose = lambda: " ".join(word() + r.choice(["", "", "", "", ".", ","]) for _ in range(r.randint(60, 200)))
    rows = [(i, prose()) for i in range(200)] + [(1000 + i, " ".join(w + "%%%" for w in prose().split())) for i in range(20)]
    rows += [(2000 + i, prose().upper().replace(" ", "!! ")) for i in range(20)] + [(3000 + i, "La " * 80) for i in range(10)]
    kept = {x.id for x in quality.quality_rules(table(spark, rows, "id long, text string")).filter("kept").collect()}
    assert kept == set(range(200))


def test_quality_keeps_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "some words here, and more of them still to come. So they go on.", "k", 7, [8], 9), (2, None, None, 1, None, None)],
                               "doc_id long, text string, key string, __words long, __lines array<int>, Key_ long")
    got = {x.doc_id: x for x in quality.quality_rules(df).collect()}
    assert (got[1]["key"], got[1]["__words"], got[1]["__lines"], got[1]["Key_"], got[1]["n_words"]) == ("k", 7, [8], 9, 14)
    assert (got[2]["key"], got[2]["__words"], got[2]["kept"]) == (None, 1, False)


def test_pages(spark):
    layouts = html_extract.Layouts([f"w{i}" for i in range(300)], 1)
    found = [html_extract.labelled(layouts.page()) for _ in range(200)]
    model = trees.train(np.concatenate([f for f, _ in found]), np.concatenate([y for _, y in found]))
    held, right, total = html_extract.Layouts([f"w{i}" for i in range(300)], 77), 0, 0
    for _ in range(60):
        source = held.page()
        page = dom.Page(source)
        want = {t.replace("\x01", "") for t in page.text if t and "\x01" in t}
        got = set(html_extract.main_texts([source.replace("\x01", "")], model)[0].split("\n"))
        right, total = right + len(want & got), total + len(want | got)
    assert right / total > 0.9
    odd = [None, "", "plain", "<p>", "<<>>&amp", "<div " * 900 + "deep", "<script>x", "<a href='x' b>" * 50, "&lt;p&gt; <!-- open"]
    df = table(spark, [(i, h, 1) for i, h in enumerate(odd)], "page_id long, html string, text int")
    out = {x.page_id: x.text for x in html_extract.extract(df, model).collect()}
    assert len(out) == len(odd) and out[0] == out[1] == ""
    assert html_extract.extract(df.filter("false"), model).count() == 0


def test_page_blocks():
    page = dom.Page("<div>a &amp; b<br>c<p>d\n e<b> f</b><p>g</div><ul><li>h<li>i</ul><style>x</style>")
    assert [t for t in page.text if t] == ["a & b c", "d e f", "g", "h", "i"]


def test_embedded_text_stays_in_its_block():
    page = dom.Page("<p>Let <math><mi>x</mi><mo>+</mo><mn>1</mn></math> be <svg><g><text>drawn</text></g></svg> or <object data=a>told"
                    "<param name=b></object>, <video><source src=c>seen</video>.</p><noscript>Read <b>this</b></noscript><p>Press <button>OK</button></p>")
    assert [t for t in page.text if t] == ["Let x+1 be drawn or told, seen.", "Read this", "Press", "OK"]
    assert page.tag[page.parent[page.text.index("OK")]] == "button"


def test_hand_written_pages(spark):
    """Pages that the generator of the training layouts can't make."""
    layouts = html_extract.Layouts([f"w{i}" for i in range(300)], 1)
    found = [html_extract.labelled(layouts.page()) for _ in range(300)]
    model = trees.train(np.concatenate([f for f, _ in found]), np.concatenate([y for _, y in found]))
    long = "The river rose in the night, and by the morning it had reached the lower fields, where the sheep stood. Nobody had seen it so high before."
    pages = [
        (f"<html><head><title>t</title></head><body><header class=masthead><a href=/>Home</a></header><nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></nav>"
         f"<article class='post entry'><h1>High water</h1><p>{long}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be its depth. {long}</p></article>"
         f"<footer>&copy; 2020 All rights reserved</footer></body></html>", ["High water", long, f"Let x=2 be its depth. {long}"]),
        (f"<body><div id=cookie-notice><p>We use cookies on this site, please accept.</p><button>Accept</button></div><main><h1>On sheep</h1><p>{long}</p>"
         f"<form class=newsletter><label>Mail</label><select><option>Daily<option>Weekly</select><button>Subscribe</button></form><p>{long} Again.</p></main>"
         f"<aside class='sidebar related'><h3>More</h3><ul><li><a href=3>Floods</a></li></ul></aside></body>", ["On sheep", long, f"{long} Again."]),
    ]
    for source, want in pages:
        assert html_extract.main_texts([source], model)[0].split("\n") == want


def plain_spans(text):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(kinds):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x * (1 + i % 2) - 9 * (x * (1 + i % 2) > 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
            if k == 0 or k == 1 and all(int(x) < 256 for x in m[0].split(".")) or k == 2 and 14 <= len(d) <= 19 and luhn or k == 3 and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    r = random.Random(4)
    for _ in range(4000):
        t = "".join(r.choice("0123456789" * 3 + "  --..@@++()ab%é") for _ in range(r.randint(0, 70)))
        assert pii.base_spans(t) == plain_spans(t), t
    for t in ("4111 1111 1111 1111", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "+1 (555) 010-9999", "0" * 5000, "a@" * 4000):
        assert pii.base_spans(t) == plain_spans(t), t[:30]


def test_spans_and_redaction(spark):
    rows = [(i, t, "x") for i, t in enumerate([None, "", "mail a.b@c.org now", "call (555) 123-4567 phone", "plain words only", "host 10.1.2.3", "+1 (555) 010-9999"] * 40)]
    df = table(spark, rows, "doc_id long, text string, spans string")
    got = {x.doc_id: x for x in pii.digests(pii.spans(df, ["doc_id"])).collect()}
    assert got[2].n_email == 1 and got[4].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {x.doc_id: x.text for x in pii.redact(df).collect()}
    assert clean[2] == "mail <email> now" and clean[4] == rows[4][1] and clean[0] is None and clean[5] == "host <ip>"
    assert pii.redact(df.filter("false")).count() == 0


def test_records_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = TEXTS + ["don't stop. 3 times!\nNext line, ok", "a<|endoftext|>b", "é,é.\né x\x00y 12ab"] * 2
    rows = [(9 - i, t) for i, t in enumerate(texts)] + [(None, "none")]
    opts = records.RecordOptions(tokenizer=WORDS, file_bytes=64)
    folder, index = f"{tmp_path}/f", f"{tmp_path}/i"
    records.write(table(spark, rows, "doc_id long, text string"), folder, opts)
    records.write_index(spark, folder, index)
    got = sorted(records.read_index(spark, index).collect(), key=lambda x: x.start)
    tk, start = Tokenizer.from_file(WORDS), 0
    assert [x.doc_id for x in got] == [None, *sorted(d for d, _ in rows if d is not None)]
    given = dict(rows)
    for x in got:
        ids = np.array(tk.encode(given[x.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    mixed = records.read_shuffled(spark, folder, index, 3).orderBy("place").collect()
    assert {(x.doc_id, len(x.ids)) for x in mixed} == {(x.doc_id, x.n_tokens) for x in got}
    with pytest.raises(ValueError):
        records.parse(b"\x01" + records.frame(1, b"\x01\x00", False)[1:], 0)


def test_end_tags_of_elements_beyond_the_bound_close_no_ancestor():
    from kith.llm import dom

    page = dom.Page("<article>" + "<div>" * 450 + "deep" + "</div>" * 450 + "<p>later</p></article>after")
    at = page.text.index("later")
    assert page.tag[page.parent[page.parent[at]]] == "article" and page.tag[page.parent[page.text.index("after")]] != "article"
    page = dom.Page("<div>" * 420 + "</div>" * 40 + "inside" + "</div>" * 380)
    depth, at = 0, page.text.index("inside")
    while (at := page.parent[at]) > 0:
        depth += 1
    assert depth == 380
