"""A tolerant reader of HTML: block elements and text blocks as a tree, with the features of each node."""

from __future__ import annotations

import html
import math
import re

import numpy as np

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>?", re.S)
_ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
HIDDEN = frozenset("head template".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var "
                    "br img wbr input ruby rt rp output").split())
#: Embedded content that stands in a line: formulas, drawings, and what stands in for media that can't be shown.
EMBEDDED = frozenset(("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts "
                      "semantics annotation svg g text tspan path object canvas audio video source track param").split())
_CLOSES_ITSELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
                  "option": ("select",), "tbody": ("table",), "thead": ("table",)}

GROUPS = [
    ("article", "main"), ("section",), ("div",), ("p", "blockquote", "pre", "figure", "figcaption"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("nav", "menu"),
    ("footer",), ("header",), ("aside",), ("form", "fieldset", "dialog", "button", "select", "option", "optgroup", "datalist"), ("ul", "ol", "li", "dl", "dd", "dt"), ("table", "tr", "td", "th"), ("#text",), ("body", "html", "#root")]
#: Words in class, id and role that page authors use; fixed values.
TOKENS = [
    "content article post entry story main body text blog".split(),
    "nav navigation menu navbar breadcrumb breadcrumbs pagination pager tabs toc skip".split(),
    "footer foot bottom copyright legal colophon".split(), "header head masthead banner top logo branding toolbar".split(),
    "sidebar side aside widget rail related recommended popular trending more tags".split(),
    "ad ads advert advertisement adsense sponsor sponsored promo promotion".split(),
    "cookie cookies notice consent gdpr alert popup modal overlay message info warning disclaimer".split(),
    "comment comments respond reply replies discussion disqus thread reader readers".split(),
    "form login signup subscribe newsletter search contact share social follow button".split()]
_WHICH = {w: k for k, words in enumerate(TOKENS) for w in words}
_GROUP = {t: k for k, tags in enumerate(GROUPS) for t in tags}


class Page:
    """Nodes in document order: ``tag``, ``parent``, ``text`` of text blocks (else None), ``tokens`` of attributes, and counts."""

    def __init__(self, source: str):
        self.tag, self.parent, self.text, self.tokens, self.linked, self.marked = ["#root"], [-1], [None], [()], [0], [0]
        self._deep: list[str] = []  # open elements beyond the stack's bound
        self._stack, self._words, self._link, self._hide, self._chars, self._bold = [0], [], 0, 0, 0, 0
        at, lower = 0, None
        while at < len(source):
            m = _TAG.search(source, at)
            if m is None:
                self._say(source[at:])
                break
            if m.start() > at:
                self._say(source[at:m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                self._close(name)
            else:
                self._open(name, m[3])
                if name in RAW:
                    lower = lower if lower is not None else source.lower()
                    at = lower.find(f"</{name}", at)
                    at = len(source) if at < 0 else at
        self._end_block()

    def _say(self, text: str):
        if self._hide or self.tag[self._stack[-1]] in RAW or not text:
            return
        if "&" in text:
            text = html.unescape(text)
        self._words.append(text)
        n = len(text)
        self._chars += n
        if self._link:
            self.linked[0] += n
            self._linked_here = getattr(self, "_linked_here", 0) + n

    def _end_block(self):
        text = " ".join("".join(self._words).split()) if self._words else ""
        linked = min(getattr(self, "_linked_here", 0), len(text))
        self._words, self._linked_here = [], 0
        if text:
            self._add("#text", self._stack[-1], text, ())
            self.linked[-1], self.marked[-1] = linked, self._bold
        self._bold = 0

    def _add(self, tag, parent, text, tokens):
        self.tag.append(tag)
        self.parent.append(parent)
        self.text.append(text)
        self.tokens.append(tokens)
        self.linked.append(0)
        self.marked.append(0)

    def _open(self, name, attributes):
        if name in EMBEDDED:
            return
        if name in INLINE:
            if name == "a":
                self._link = 1
            elif name in ("br", "img", "wbr", "input"):
                self._words.append(" ")
            else:
                self._bold += 1
            return
        self._end_block()
        stack = self._stack
        if name in VOID:
            return
        if name in _CLOSES_ITSELF:
            stop = _CLOSES_ITSELF[name]
            deep = next((k for k in range(len(self._deep) - 1, -1, -1) if self._deep[k] == name or self._deep[k] in stop), None)
            if deep is not None and self._deep[deep] not in stop:
                self._shut(deep)
            for k in range(len(stack) - 1, 0, -1) if deep is None else ():
                if self.tag[stack[k]] in stop:
                    break
                if self.tag[stack[k]] == name:
                    self._pop(k)
                    break
        while self._deep and self._deep[-1] == "p":
            self._shut(len(self._deep) - 1)
        while not self._deep and self.tag[stack[-1]] == "p":  # a block ends an open paragraph
            self._pop(len(stack) - 1)
        tokens = ()
        if attributes and ("class" in attributes or "id" in attributes or "role" in attributes or "=" in attributes):
            tokens = tuple(t.lower() for m in _ATTRIBUTE.finditer(attributes) for t in _TOKEN.findall(m[1] or m[2] or m[3] or ""))
        self._add(name, stack[-1], None, tokens)
        if len(stack) < 400:  # deeper elements stay siblings
            stack.append(len(self.tag) - 1)
        else:
            self._deep.append(name)
        self._hide += name in HIDDEN
        self._link = 0

    def _shut(self, k):
        for name in self._deep[k:]:
            self._hide -= name in HIDDEN
        del self._deep[k:]

    def _pop(self, k):
        self._shut(0)
        for i in self._stack[k:]:
            self._hide -= self.tag[i] in HIDDEN
        del self._stack[k:]

    def _close(self, name):
        if name in EMBEDDED:
            return
        if name in INLINE:
            if name == "a":
                self._link = 0
            elif name == "br":
                self._words.append(" ")
            return
        for k in range(len(self._deep) - 1, -1, -1):
            if self._deep[k] == name:
                self._end_block()
                self._shut(k)
                self._link = 0
                return
        for k in range(len(self._stack) - 1, 0, -1):
            if self.tag[self._stack[k]] == name:
                self._end_block()
                self._pop(k)
                self._link = 0
                return


def features(page: Page) -> np.ndarray:
    """A row for each node but the root: tag, attribute tokens of its own and above, subtree density, depth, siblings, place."""
    n = len(page.tag)
    parent = page.parent
    depth, chars, links, nodes, leaves, marks = [0] * n, [0] * n, [0] * n, [1] * n, [0] * n, [0] * n
    before, kids, order = [0] * n, [0] * n, [0] * n
    own = [0] * n
    above, above_tags = [0] * n, [0] * n
    children: list[list[int]] = [[] for _ in range(n)]
    total = 0
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        order[i] = kids[p]
        kids[p] += 1
        children[p].append(i)
        before[i] = total
        mask = 0
        for t in page.tokens[i]:
            if (k := _WHICH.get(t)) is not None:
                mask |= 1 << k
        own[i] = mask
        above[i] = above[p] | own[p]
        above_tags[i] = above_tags[p] | (1 << _GROUP.get(page.tag[p], 2))
        if page.text[i] is not None:
            t = page.text[i]
            chars[i], links[i], leaves[i] = len(t), page.linked[i], 1
            marks[i] = t.count(".") + t.count(",") + t.count("!") + t.count("?")
            total += len(t)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        nodes[p] += nodes[i]
        leaves[p] += leaves[i]
        marks[p] += marks[i]
    total = max(total, 1)
    rows = []
    for i in range(1, n):
        p, c = parent[i], chars[i]
        around = children[p]
        last = around[order[i] - 1] if order[i] else 0
        following = around[order[i] + 1] if order[i] + 1 < len(around) else 0
        group = _GROUP.get(page.tag[i], 2)
        rows.append((
            depth[i], math.log1p(c), c / total, links[i] / max(c, 1), math.log1p(nodes[i]), c / nodes[i], math.log1p(leaves[i]), c / max(leaves[i], 1),
            marks[i] / max(c, 1), before[i] / total, order[i] / max(len(around), 1), math.log1p(len(around)),
            math.log1p(chars[last] if last else 0), math.log1p(chars[following] if following else 0),
            links[last] / max(chars[last], 1) if last else 0, links[following] / max(chars[following], 1) if following else 0,
            math.log1p(chars[p]), links[p] / max(chars[p], 1), chars[p] / total,
            *(float(group == k) for k in range(len(GROUPS))), *(float(above_tags[i] >> k & 1) for k in range(len(GROUPS) - 1)),
            *(float(own[i] >> k & 1) for k in range(len(TOKENS))), *(float(above[i] >> k & 1) for k in range(len(TOKENS)))))
    return np.array(rows, float).reshape(n - 1, -1)


def decode(page: Page, odds: np.ndarray) -> list[str]:
    """The texts of the most likely labelling in which a node within a dropped one is dropped too."""
    n = len(page.tag)
    yes = [0.0, *(-np.logaddexp(0, -odds)).tolist()]
    no = [0.0, *(-np.logaddexp(0, odds)).tolist()]
    dropped, kept = no[:], yes[:]
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = page.parent[i]
        dropped[p] += dropped[i]
        kept[p] += max(dropped[i], kept[i])
    alive = [True] * n
    out = []
    for i in range(1, n):
        alive[i] = alive[page.parent[i]] and kept[i] > dropped[i]
        if alive[i] and page.text[i] is not None:
            out.append(page.text[i])
    return out
