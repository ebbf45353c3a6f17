"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded from the root down.

The trees are trained on ``pages`` generated layouts with known labels (a documented bound, not a share of the data), which are filled
with words of a bounded sample of the given pages. A node's label says whether its subtree holds main text; decoding
takes the most likely labelling in which nothing below a dropped node is kept.

Defined cases: null and empty pages give an empty text; a page without main text too; repeated rows are treated one by one; other columns are
carried along, a column with the name of a result is replaced.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kith.llm import dom, trees
from kith.llm.common import slices


@dataclass(frozen=True)
class ExtractOptions:
    pages: int = 500      # generated layouts
    sample: int = 200     # given pages whose words fill them
    seed: int = 11


class Layouts:
    """Random pages whose main text is marked by \\x01 at the start of its blocks."""

    def __init__(self, words: list[str], seed: int):
        self.r, self.words = random.Random(seed), words or ["word"]

    def say(self, low: int, high: int) -> str:
        out, r = [], self.r
        for _ in range(r.randint(low, high)):
            w = r.choice(self.words)
            out.append(w + r.choice(["", "", "", "", "", ".", ","]))
        return " ".join(out)

    def mark(self, *names: str) -> str:
        r = self.r
        if r.random() < 0.15:
            return ""
        name = r.choice(names) + r.choice(["", "", "", "-1", "-box", " x12", "_wrap"])
        return r.choice([f' class="{name}"', f' id="{name}"', f' class="c {name}"'])

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.say(1, 3)}</a></li>' for k in range(n))

    def choices(self) -> str:
        r, say = self.r, self.say
        listed = "".join(f"<option>{say(1, 2)}" for _ in range(r.randint(1, 4)))
        return r.choice(["", f"<select>{listed}</select>"]) + r.choice(["", f"<button>{say(1, 2)}</button>"])

    def boilerplate(self) -> str:
        r, say, mark = self.r, self.say, self.mark
        kind = r.randrange(11)
        if kind == 0:
            return f"<nav{mark('nav', 'menu')}><ul>{self.links(r.randint(2, 12))}</ul></nav>"
        if kind == 1:
            return f"<div{mark('nav', 'menu', 'breadcrumbs', 'navbar')} role=navigation><ul>{self.links(r.randint(2, 12))}</ul></div>"
        if kind == 2:
            return f"<aside{mark('sidebar', 'related', 'widget')}><h3>{say(1, 4)}</h3>" + (f"<ul>{self.links(r.randint(2, 8))}</ul>" if r.random() < 0.6 else f"<p>{say(4, 60)}</p>") + "</aside>"
        if kind == 3:
            return f'<div class="{r.choice(["sidebar", "side", "widget", "related"])}"><h4>{say(1, 4)}</h4><p>{say(3, 50)}</p></div>'
        if kind == 4:
            return f'<div class="{r.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo"])}">{say(2, 25)}</div>'
        if kind == 5:
            inner = f"<p>{say(5, 40)}</p>" if r.random() < 0.5 else say(5, 40)
            return f'<div {r.choice(["class", "id"])}="{r.choice(["cookie-notice", "notice", "consent", "alert", "popup", "cookie-banner"])}">{inner}<button>ok</button></div>'
        if kind == 6:
            return f"<form{mark('newsletter', 'subscribe', 'search', 'login')}><label>{say(1, 4)}</label><input name=q>{self.choices()}<p>{say(2, 20)}</p></form>"
        if kind in (7, 8):
            items = "".join(f'<{t} class="comment"><b>{say(1, 2)}</b><p>{say(3, 80)}</p></{t}>' for t in [r.choice(["div", "li", "article"])] * r.randint(1, 6))
            return f'<{r.choice(["section", "div"])} {r.choice(["id", "class"])}="{r.choice(["comments", "comment-list", "reader-comments", "discussion"])}"><h3>{say(1, 3)}</h3>{items}</div></section>'
        if kind == 9:
            return f'<div class="{r.choice(["share", "social", "tags", "pagination"])}"><a href="#">{say(1, 2)}</a> <a href="#">{say(1, 2)}</a></div>'
        return f"<section{mark('related', 'popular', 'trending')}><h3>{say(1, 3)}</h3><ul>{self.links(r.randint(2, 9))}</ul></section>"

    def main(self) -> str:
        r, say = self.r, self.say
        loose = r.random() < 0.5  # unclosed tags
        out = [f"<h1>\x01{say(2, 14)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 1, 1, 2, 2, 3, 4, 6, 10, 25])):
            text = say(1, 25) if r.random() < 0.35 else say(10, 150)
            k = r.random()
            if k < 0.2:
                out.append(f"<p><b>\x01{text}<br>" if loose else f"<p><b>\x01{text}</b></p>")
            elif k < 0.28:
                out.append(f"<h2>\x01{say(1, 10)}</h2>")
            elif k < 0.34:
                out.append("<ul>" + "".join(f"<li>\x01{say(2, 20)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif k < 0.38:
                out.append(f"<blockquote>\x01{text}</blockquote>")
            elif k < 0.46:
                out.append(f'<p>\x01{text} <a href="#">{say(1, 4)}</a> {say(1, 10)}</p>')
            elif k < 0.5:
                out.append(f"<div>\x01{text}</div>")
            else:
                out.append(f"<p>\x01{text}" + ("" if loose else "</p>"))
            if r.random() < 0.04:
                out.append(f'<div class="{r.choice(["ad", "advert", "promo"])}">{say(2, 20)}</div>')
            elif r.random() < 0.04:
                out.append(self.boilerplate())
        return "".join(out)

    def page(self) -> str:
        r, say = self.r, self.say
        if r.random() < 0.2:
            tag, mark = "article", ""
        else:
            tag, mark = r.choice([("article", ""), ("main", ""), ("article", self.mark("post", "entry")), ("div", self.mark("content", "post-body", "entry-content", "article", "story")),
                                  ("div", ""), ("section", self.mark("content", "main"))])
        main = f"<{tag}{mark}>{self.main()}</{tag}>"
        if r.random() < 0.2:
            main = f"<div{self.mark('wrap', 'page', 'main')}>{main}</div>"
        top = [self.boilerplate() for _ in range(r.randint(0, 2))]
        if r.random() < 0.5:
            top.insert(0, f"<nav><ul>{self.links(r.randint(2, 9))}</ul></nav>")
        if r.random() < 0.4:
            top.insert(0, f"<header{self.mark('header', 'masthead')}><p>{say(1, 8)}</p></header>")
        if r.random() < 0.4:
            top.append(f'<!-- ad --><div class="ad">{say(2, 25)}</div>')
        tail = [self.boilerplate() for _ in range(r.randint(0, 3))]
        if r.random() < 0.8:
            tail.append(r.choice([f"<footer>&copy; {say(1, 3)} &middot; {say(2, 30)}</footer>", f"<footer{self.mark('footer')}><p>{say(2, 30)}</p></footer>",
                                  f'<div class="footer">{say(2, 25)}</div>']))
        head = f"<head><title>{say(2, 8)}</title><style>p{{}}</style><script>var a='</p>'</script></head>" if r.random() < 0.9 else ""
        return f"<html>{head}<body>{''.join(top)}{main}{''.join(tail)}" + ("</body></html>" if r.random() < 0.85 else "")


def labelled(source: str):
    """Features and labels of the nodes of a generated page."""
    page = dom.Page(source)
    label = [0] * len(page.tag)
    for i in range(len(page.tag) - 1, 0, -1):
        text = page.text[i]
        if text is not None and "\x01" in text:
            label[i], page.text[i] = 1, text.replace("\x01", "")
        label[page.parent[i]] |= label[i]
    return dom.features(page), np.array(label[1:], float)


def fit(pages: DataFrame, opts: ExtractOptions = ExtractOptions(), html: str = "html") -> dict:
    """Train the trees; at most ``sample`` given pages, those of the smallest hashes, lend their words. Only hashes and words come to the driver."""
    hashed = pages.select(F.xxhash64(html).alias("h"), F.col(html).alias("html")).filter(F.length("html") > 0)
    chosen = [h for (h,) in hashed.select("h").distinct().orderBy("h").limit(opts.sample).collect()]

    def spoken(batches):
        seen, found = set(), set()
        for batch in batches:
            for h, source in zip(*(c.to_pylist() for c in batch.columns)):
                if h not in seen:
                    seen.add(h)
                    found.update(w for t in dom.Page(source).text if t for w in t.split())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])

    said = hashed.filter(F.col("h").isin(chosen)).mapInArrow(spoken, "word string")
    words = [w for (w,) in said.distinct().orderBy("word").collect()]
    layouts = Layouts(words, opts.seed)
    found = [labelled(layouts.page()) for _ in range(opts.pages)]
    return trees.train(np.concatenate([f for f, _ in found]), np.concatenate([y for _, y in found]))


def main_texts(sources: list[str | None], model: dict) -> list[str]:
    parsed = [dom.Page(s) if s else None for s in sources]
    rows = [dom.features(p) for p in parsed if p is not None and len(p.tag) > 1]
    odds = trees.log_odds(model, np.concatenate(rows)) if rows else None
    out, at = [], 0
    for p in parsed:
        if p is None or len(p.tag) == 1:
            out.append("")
            continue
        n = len(p.tag) - 1
        out.append("\n".join(dom.decode(p, odds[at:at + n])))
        at += n
    return out


def extract(df: DataFrame, model: dict, html: str = "html", text: str = "text") -> DataFrame:
    """Add ``text``; the markup goes."""
    df = df.drop(text) if html != text else df
    kept = [f for f in df.schema.fields if f.name != html]
    schema = T.StructType([*kept, T.StructField(text, T.StringType(), False)])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, html):
                texts = main_texts(batch.column(batch.schema.get_field_index(html)).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), pa.array(texts, pa.string())], [*(f.name for f in kept), text])

    return df.mapInArrow(run, schema)
