"""Main-text extraction with a tree-structured graphical model of the DOM.

A page is parsed into its element tree. Each element (and each inline element
that has a class, id or role) is a node with a hidden label: content or not. Node
potentials come from its tag, the words of its class, id and role, its text and
its links; parent-child potentials depend on the child's kind. Sum-product
messages pass upward and downward through all trees of a batch at once, one depth
after the other in numpy, and give each node's marginal. Text whose node is
content with probability over one half is kept.

The weights are trained by maximum likelihood (the same messages give the
expectations) on labelled pages. No table has labels, so the labelled pages are
composed here, from a seed: articles in many wrappers, with menus, headers,
footers, sidebars, notices, adverts, forms, related links and comments around and
inside them, every part labelled as it is made. Some articles stand right in the
body, in one element without parts, or have paragraphs with misleading names.

Defined cases: null or empty html gives empty text; script, style, head and other
unseen elements are never text; unclosed and stray tags are handled as browsers
do for the common cases; no attribute of a page is read but class, id and role;
nesting may be of any depth; pages of any length are read whole; a node with
probability one half isn't content; repeated pages each get their row, and a null
page_id or url stays null; an empty table gives no row; other columns of the
table are not read, whatever their names.
"""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import map_text, texts

TRAIN_PAGES = 600
TRAIN_SEED = 11
_LABEL = "data-label"

# Element classes of HTML, natural order.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("annotation annotation-xml script style head title noscript template iframe object svg canvas audio video".split())
MATH = "math merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
RAW = frozenset("script style title textarea noscript iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split() + MATH)
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "thead": ("tr", "td", "th")}
SCOPES = frozenset("ul ol menu dl table select".split())
TAGS = "html body div section article main header footer nav aside menu ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table tr td th form fieldset label button select option textarea a span".split()
#: Words of class, id and role, by what they say.
HINTS = {
    "menu": "nav navbar navigation menu topbar breadcrumb breadcrumbs pager pagination tabs toolbar skip".split(),
    "head": "header masthead banner logo branding hero top".split(),
    "foot": "footer foot copyright colophon legal bottom".split(),
    "side": "sidebar side aside widget rail column complementary".split(),
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion affiliate".split(),
    "note": "cookie cookies consent gdpr notice notices alert message popup modal overlay paywall warning dialog".split(),
    "form": "form login signin signup search subscribe newsletter register contact input".split(),
    "comment": "comment comments commentlist reply replies discussion disqus respond thread review reviews".split(),
    "share": "share sharing social follow related recommended recommendations more popular trending tags tag meta author byline read".split(),
    "body": "article content post entry story main body text articlebody page prose markdown maintext".split(),
}
#: Headings over readers' comments, with or without their number.
COMMENT_HEADINGS = "comment comments reply replies response responses discussion kommentar kommentare antworten commentaire commentaires réponses comentario comentarios respuestas commenti".split()
_COMMENTS = re.compile(rf"\W*(?:\d+\W+)?(?:(?:{'|'.join(COMMENT_HEADINGS)})|(?:leave|post|write|add) a (?:comment|reply))\W*\d*\W*", re.IGNORECASE)
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_WORD_HINT = {w: h for h, ws in HINTS.items() for w in ws}
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_HINT_AT = {h: len(TAGS) + 1 + i for i, h in enumerate(HINTS)}
_NUMERIC = len(TAGS) + 1 + len(HINTS)
N_FEATURES = _NUMERIC + 18
#: Kinds of parent-child potentials, by the child.
KINDS = ("container", "sectioning", "list", "item", "text", "heading", "form", "inline", "other")
_KIND = {"div": 0, "table": 0, "tr": 0, "td": 3, "th": 3, "section": 1, "article": 1, "main": 1, "header": 1, "footer": 1, "nav": 1, "aside": 1, "ul": 2, "ol": 2, "dl": 2, "menu": 2, "li": 3, "dt": 3, "dd": 3, "p": 4, "blockquote": 4, "pre": 4, "figure": 4, "figcaption": 4, "form": 6, "fieldset": 6, "label": 6, "button": 6, "select": 6, "option": 6, "textarea": 6, **{f"h{i}": 5 for i in range(1, 7)}}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute, as HTML reads it: a name, and a value in quotes of either kind or without.
_ATTR = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*|(?=>)))?""")
_ATTRS_END = re.compile(r"[\s/]*")
_OPEN = re.compile(r"""\s*=\s*["']""")
_KEPT = frozenset(("class", "id", "role", _LABEL))
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """A page's nodes (parallel lists) and its pieces of text in order: (node, text, in a link, starts a block).

    ``labelled``: the page was composed here, and its marks give the nodes' labels.
    """

    def __init__(self, source: str, labelled: bool = False):
        self._labelled = labelled
        self._at: defaultdict[str, list[int]] = defaultdict(list)  # places of open elements on the stack, by name
        self._blocks = [0]  # places of those that aren't inline
        self.tag, self.parent, self.depth, self.hints, self.label = ["html"], [-1], [0], [()], [None]
        self.pieces: list[tuple[int, str, bool, bool]] = []
        self._stack: list[tuple[str, int]] = [("html", 0)]  # open elements with their nodes
        self._links = self._unseen = 0
        self._fresh = True
        self._parse(source)
        self._comment_headings()

    def _comment_headings(self) -> None:
        """What a heading such as "3 Comments" stands over is hinted at as comments: its part, or what follows it in the main part."""
        said: dict[int, list[str]] = {}
        for node, text, _, _ in self.pieces:
            if self.tag[node] in _HEADINGS:
                said.setdefault(node, []).append(text)
        for node in [n for n, t in said.items() if len(t) < 9 and _COMMENTS.fullmatch("".join(t).strip())]:
            over = self.parent[node]
            if self.tag[over] in ("html", "article", "main") or "body" in self.hints[over]:
                meant = [node] + [n for n in range(node + 1, len(self.tag)) if self.parent[n] == over and self.tag[n] not in ("p", *_HEADINGS)][:1]
            else:
                meant = [over]
            for n in meant:
                self.hints[n] = tuple(dict.fromkeys([*self.hints[n], "comment"]))

    def _parse(self, s: str) -> None:
        at, size = 0, len(s)
        while at < size:
            lt = s.find("<", at)
            if lt < 0:
                self._text(s[at:])
                return
            if lt > at:
                self._text(s[at:lt])
            after = s[lt + 1 : lt + 2]
            if after == "!" or after == "?":
                if s.startswith("<!--", lt):
                    end = s.find("-->", lt + 4)
                    at = size if end < 0 else end + 3
                else:
                    end = s.find(">", lt)
                    at = size if end < 0 else end + 1
            elif after == "/" and (m := _NAME.match(s, lt + 2)):
                end, _ = self._tag_end(s, m.end())
                self._end(m[0].lower())
                at = min(size, end + 1)
            elif m := _NAME.match(s, lt + 1):
                end, kept = self._tag_end(s, m.end())
                name = m[0].lower()
                attrs = s[m.end() : end]
                self._start(name, attrs, kept)
                at = min(size, end + 1)
                if name in RAW and not attrs.endswith("/"):
                    close = re.compile(f"</{re.escape(name)}", re.I).search(s, at)
                    to = close.start() if close else size
                    if name == "textarea":
                        self._text(s[at:to])
                    at = to
            else:
                self._text("<")
                at = lt + 1

    @staticmethod
    def _tag_end(s: str, at: int) -> tuple[int, dict[str, str]]:
        """The tag's closing bracket outside quoted values, and the kept attributes; the next bracket if a quote never closes."""
        kept = {}
        while m := _ATTR.match(s, at):
            name, value = m.groups()
            if value is None and _OPEN.match(s, m.end()):  # a quote that never closes
                end = s.find(">", m.end())
                return (len(s) if end < 0 else end), kept
            if value and (name := name.lower()) in _KEPT:
                kept.setdefault(name, value[1:-1] if value[0] in "\"'" else value)
            at = m.end()
        return _ATTRS_END.match(s, at).end(), kept

    def _start(self, name: str, attrs: str, kept: dict[str, str]) -> None:
        if name in CLOSES_P:
            self._close_if("p", SCOPES | {"td", "th", "button", "li"} - {"p"})
        for other in SIBLINGS.get(name, ()):
            self._close_if(other, SCOPES)
        if name == "br":
            self._piece(" ")
            return
        inline = name in INLINE
        if not inline:
            self._fresh = True
        if name in VOID:
            return
        hints, label = (), None
        if kept:
            label = kept.pop(_LABEL, None)
            label = int(label) if self._labelled and label is not None else None
            hints = tuple(dict.fromkeys(h for v in kept.values() for w in _SPLIT.findall(v) if (h := _WORD_HINT.get(w.lower()))))
        node = self._stack[-1][1]
        if name in ("html", "body"):
            self.label[0] = self.label[0] if label is None else label
        elif (not inline or hints or label is not None) and name not in UNSEEN:
            self.tag.append(name)
            self.hints.append(hints)
            self.label.append(self.label[node] if label is None else label)
            self.parent.append(node)
            self.depth.append(self.depth[node] + 1)
            node = len(self.tag) - 1
        if attrs.endswith("/") and inline:
            return
        self._at[name].append(len(self._stack))
        if not inline:
            self._blocks.append(len(self._stack))
        self._stack.append((name, node))
        self._links += name == "a"
        self._unseen += name in UNSEEN

    def _pop(self) -> None:
        name, _ = self._stack.pop()
        self._at[name].pop()
        if self._blocks[-1] == len(self._stack):
            self._blocks.pop()
        self._links -= name == "a"
        self._unseen -= name in UNSEEN
        if name not in INLINE:
            self._fresh = True

    def _close_if(self, name: str, scope) -> None:
        """Close an open ``name`` and what is in it, unless a scope lies between."""
        if at := self._at[name]:
            if not any(self._at[x] and self._at[x][-1] > at[-1] for x in scope if x != name):
                self._pop_to(at[-1])

    def _pop_to(self, at: int) -> None:
        while len(self._stack) > at:
            self._pop()

    def _end(self, name: str) -> None:
        if name == "br":
            self._piece(" ")
            return
        if name not in INLINE:
            self._fresh = True
        if name in ("html", "body") or not self._at[name]:
            return
        if name not in INLINE or self._blocks[-1] < self._at[name][-1]:  # an inline element ends in its own block alone
            self._pop_to(self._at[name][-1])

    def _text(self, text: str) -> None:
        if not self._unseen:
            self._piece(html.unescape(text) if "&" in text else text)

    def _piece(self, text: str) -> None:
        if text and not self._unseen:
            self.pieces.append((self._stack[-1][1], text, self._links > 0, self._fresh))
            if not text.isspace():
                self._fresh = False

    def features(self) -> np.ndarray:
        n = len(self.tag)
        chars, linked, words, stops = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        first = np.full(n, -1.0)
        seen = 0
        for node, text, link, _ in self.pieces:
            w = len(text.split())
            if w:
                if first[node] < 0:
                    first[node] = seen
                size = len(text)
                seen += size
                chars[node] += size
                linked[node] += size * link
                words[node] += w
                stops[node] += text.count(". ") + text.count("! ") + text.count("? ") + (text.rstrip()[-1:] in ".!?。…")
        all_chars, all_linked = chars.copy(), linked.copy()
        for i in range(n - 1, 0, -1):  # children come after their parents
            all_chars[self.parent[i]] += all_chars[i]
            all_linked[self.parent[i]] += all_linked[i]
        x = np.zeros((n, N_FEATURES))
        for i, (t, hints) in enumerate(zip(self.tag, self.hints, strict=True)):
            x[i, _TAG_AT.get(t, len(TAGS))] = 1
            for h in hints:
                x[i, _HINT_AT[h]] = 1
        with np.errstate(divide="ignore", invalid="ignore"):
            own_link = np.where(chars > 0, linked / chars, 0)
            tree_link = np.where(all_chars > 0, all_linked / all_chars, 0)
        at = _NUMERIC
        x[:, at] = 1
        x[:, at + 1] = np.log1p(words) / 4
        x[:, at + 2] = own_link
        x[:, at + 3] = tree_link
        x[:, at + 4] = np.log1p(all_chars) / 8
        x[:, at + 5] = all_chars / max(1.0, all_chars[0])
        x[:, at + 6] = np.log1p(stops)
        x[:, at + 7] = words > 12
        x[:, at + 8] = (words > 0) & (words <= 4)
        x[:, at + 9] = words == 0
        x[:, at + 10] = (own_link > 0.5) & (words > 0)
        x[:, at + 11] = np.minimum(np.array(self.depth) / 10, 2)
        parent = np.array(self.parent)
        main = np.array([t in ("article", "main") or "body" in hints for t, hints in zip(self.tag, self.hints, strict=True)])
        within, over = main.copy(), main.copy()  # in such an element, and around one
        for i in range(1, n):
            within[i] |= within[parent[i]]
        for i in range(n - 1, 0, -1):
            over[parent[i]] |= over[i]
        share = chars / max(1.0, all_chars[0])
        x[:, at + 12] = share
        x[:, at + 13] = share * (not main.any())
        x[:, at + 14] = within
        x[:, at + 15] = ~within & ~over & main.any()
        x[:, at + 16] = (np.array([len(h) for h in self.hints]) > 0) & within
        x[:, at + 17] = ~within & over & (words > 0)
        return x

    def kinds(self) -> np.ndarray:
        return np.array([7 if t in INLINE else _KIND.get(t, 8) for t in self.tag], np.int64)

    def text(self, content: np.ndarray) -> str:
        """The content's blocks in order, white space inside as one space, joined by one space."""
        blocks, now = [], []
        for node, text, _, fresh in self.pieces:
            if fresh and now:
                blocks.append("".join(now))
                now = []
            if content[node]:
                now.append(text)
        blocks.append("".join(now))
        return " ".join(" ".join(blocks).split())


class Trees:
    """The joined trees of many pages, with messages by depth."""

    def __init__(self, pages: list[Page]):
        size = np.array([len(p.tag) for p in pages], np.int64)
        self.at = np.append(0, np.cumsum(size))
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + a) for p, a in zip(pages, self.at[:-1], strict=True)])
        self.x = np.concatenate([p.features() for p in pages])
        self.kind = np.concatenate([p.kinds() for p in pages])
        depth = np.concatenate([np.array(p.depth) for p in pages])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 1)))[1:]

    def marginals(self, w: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of content of each node, and pair marginals (node, parent's label, own label)."""
        n = len(self.parent)
        up = np.zeros((n, 2))
        up[:, 1] = self.x @ w
        sent = np.zeros((n, 2))
        for level in reversed(self.levels):
            both = up[level][:, None, :] + edge[self.kind[level]]
            sent[level] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            np.add.at(up, self.parent[level], sent[level])
        down = np.zeros((n, 2))
        pair = np.zeros((n, 2, 2))
        for level in self.levels:
            p = self.parent[level]
            above = up[p] + down[p] - sent[level]
            both = above[:, :, None] + edge[self.kind[level]]
            down[level] = np.logaddexp(both[:, 0], both[:, 1])
            joint = both + up[level][:, None, :]
            joint = np.exp(joint - joint.max((1, 2), keepdims=True))
            pair[level] = joint / joint.sum((1, 2), keepdims=True)
        z = np.clip((up + down)[:, 0] - (up + down)[:, 1], -50, 50)
        return 1 / (1 + np.exp(z)), pair


def fit(pages: list[Page], rounds: int = 250, l2: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the labelled trees with Adam steps."""
    trees = Trees(pages)
    y = np.array([v or 0 for p in pages for v in p.label])
    child = trees.parent >= 0
    truth = np.zeros((len(y), 2, 2))
    truth[np.flatnonzero(child), y[trees.parent[child]], y[child]] = 1
    theta = np.zeros(N_FEATURES + len(KINDS) * 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, edge = theta[:N_FEATURES], theta[N_FEATURES:].reshape(-1, 2, 2)
        p, pair = trees.marginals(w, edge)
        g_edge = np.zeros_like(edge)
        np.add.at(g_edge, trees.kind[child], (pair - truth)[child])
        g = np.append(trees.x.T @ (p - y), g_edge) / len(pages) + l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:N_FEATURES], theta[N_FEATURES:].reshape(-1, 2, 2)


class _Composer:
    """Composes labelled pages from a seed."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        parts = "an be co di er fa gi ho in jo ka le mo nu or pe qui ra so ti ul ve wa xi yo zu é ö ñ".split()
        self.words = ["".join(self.r.choice(parts) for _ in range(self.r.randint(1, 4))) for _ in range(800)]

    def some(self, low: int, high: int, stops: bool = False) -> str:
        w = [self.r.choice(self.words) for _ in range(self.r.randint(low, high))]
        if stops:
            for i in range(self.r.randint(4, 10), len(w), 9):
                w[i] += self.r.choice([".", ".", ",", "?", "!", " |", "&amp;"])
            w[0] = w[0].capitalize()
            w[-1] += "."
        return " ".join(w)

    def named(self, *hints: str) -> str:
        """Attributes that name a part, or none."""
        word = self.r.choice([w for h in hints for w in HINTS[h]])
        return self.r.choice([f' class="{word}"', f' id="{word}"', f' class="{word} x{self.r.randint(1, 9)}"', f' class="c-{word}-box"', f' role="{word}"'])

    def maybe(self, *hints: str, chance: float = 0.6) -> str:
        return self.named(*hints) if self.r.random() < chance else ""

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.some(1, 3)}</a>' for i in range(self.r.randint(low, high))]
        kind = self.r.randint(0, 2)
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if kind == 0 else " ".join(items) if kind == 1 else "".join(f"<div>{x}</div>" for x in items)

    def blurb(self, low: int = 3, high: int = 40) -> str:
        t = self.some(low, high, self.r.random() < 0.7)
        return self.r.choice([t, f"<p>{t}</p>", f"<h3>{self.some(1, 4)}</h3><p>{t}</p>", f'{t} <a href="#">{self.some(1, 2)}</a>'])

    def boilerplate(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            tag = r.choice(["nav", "nav", "div", "ul", "header", "menu"])
            body = self.links(3, 9)
            named = self.maybe("menu") if tag in ("nav", "menu") else self.named("menu", "head")
        elif kind == "head":
            tag, body = r.choice(["header", "header", "div"]), f"<h2>{self.some(1, 3)}</h2>{r.choice(['', self.links(2, 6), self.blurb(3, 12)])}"
            named = self.maybe("head") if tag == "header" else self.named("head")
        elif kind == "foot":
            tag, body = r.choice(["footer", "footer", "div"]), f"&copy; {self.some(1, 3)} &middot; {self.blurb(3, 40)}{r.choice(['', self.links(2, 6)])}"
            named = self.maybe("foot", chance=0.4) if tag == "footer" else self.named("foot")
        elif kind == "side":
            tag, body = r.choice(["aside", "div", "section"]), "".join(r.choice([self.links(2, 7), self.blurb(5, 50)]) for _ in range(r.randint(1, 3)))
            named = self.maybe("side", "share") if tag == "aside" else self.named("side", "share")
        elif kind == "form":
            tag, named = r.choice(["form", "form", "div"]), self.maybe("form")
            body = f"<label>{self.some(1, 4)}</label><input name=q><select><option>{self.some(1, 2)}<option>{self.some(1, 2)}</select><button>{self.some(1, 2)}</button>{r.choice(['', self.blurb(3, 20)])}"
            if tag == "div":
                body = f"<form>{body}</form>"
        elif kind == "comment":
            tag = r.choice(["div", "section", "ol", "ul"])
            each = "li" if tag in ("ol", "ul") else r.choice(["div", "article", "p"])
            body = "".join(f"<{each}{self.maybe('comment', chance=0.7)}>{r.choice(['', f'<b>{self.some(1, 2)}</b> '])}{self.some(4, 60, True)}</{each}>" for _ in range(r.randint(1, 6)))
            body, named = r.choice(["", f"<h3>{self.some(1, 3)}</h3>"]) * (tag not in ("ol", "ul")) + body, self.named("comment")
            if r.random() < 0.25:  # nothing but a heading tells
                items = "".join(f"<li>{self.some(4, 60, True)}</li>" for _ in range(r.randint(1, 6)))
                tag, named, body = r.choice(["section", "div"]), "", f"<h3>{r.choice(['', f'{r.randint(1, 40)} '])}{r.choice(COMMENT_HEADINGS).capitalize()}</h3><ul>{items}</ul>"
        else:
            tag, body, named = r.choice(["div", "div", "aside", "p", "section"]), self.blurb(3, 45), self.named(kind)
        return f'<{tag}{named} {_LABEL}="0">{body}</{tag}>'

    def paragraph(self) -> str:
        """One or more blocks of an article; some have names that say nothing true of them."""
        made = self._paragraph()
        if self.r.random() < 0.12 and (m := re.match(r"<(p|div|h2|ul|blockquote|pre|figure|table)>", made)):
            made = f"<{m[1]}{self.named(*HINTS)}>{made[m.end() :]}"
        return made

    def _paragraph(self) -> str:
        r = self.r
        t = self.some(*r.choice([(1, 3), (1, 3), (4, 12), (4, 12), (15, 60), (15, 60), (40, 120), (40, 120), (100, 600)]), r.random() < 0.75)
        kind = r.random()
        if kind < 0.06:
            return "<ul>" + "".join(f"<li>{self.some(2, 20, True)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.10:
            return f"<blockquote><p>{t}</p></blockquote>"
        if kind < 0.13:
            return f"<table><tr><th>{self.some(1, 2)}<td>{self.some(1, 6)}</table>"
        if kind < 0.16:
            return f"<figure><img src=x><figcaption>{self.some(3, 12)}</figcaption></figure>"
        if kind < 0.19:
            return f"<pre>{t}</pre>"
        if kind < 0.25:
            return f"<h2>{self.some(1, 6)}</h2>"
        if kind < 0.4:
            return f"<p><b>{t}<br>"
        if kind < 0.5:
            return f'<p>{self.some(3, 20)} <a href="/x">{self.some(1, 4)}</a> {t}</p>'
        if kind < 0.58:
            return f"<div>{t}</div>"
        return f"<p>{t}</p>" if kind < 0.9 else f"<p>{t}"

    def bare(self) -> str:
        """An article's text without blocks of its own: plain, or with line breaks, links and emphasis."""
        r = self.r
        cut = [self.some(*r.choice([(1, 4), (4, 20), (15, 60), (40, 150)]), r.random() < 0.8) for _ in range(r.choice([1, 1, 1, 2, 4]))]
        if r.random() < 0.3:
            cut[0] += r.choice([f' <a href="/x">{self.some(1, 3)}</a>', f" <b>{self.some(1, 4)}</b>", f" <em>{self.some(1, 2)}</em>"])
        return r.choice(["<br>", "<br><br>", "\n", " "]).join(cut)

    def page(self) -> str:
        r = self.r
        shape = r.random()
        if shape < 0.12:  # right in the body, or in a page without tags
            text = self.bare() if r.random() < 0.6 else "".join(self.paragraph() for _ in range(r.choice([1, 2, 4])))
            around = [self.boilerplate(k) for k in ("menu", "head", "ad") if r.random() < 0.25]
            behind = [self.boilerplate(k) for k in ("side", "note", "foot") if r.random() < 0.25]
            return f"<html><body {_LABEL}='1'>{''.join(around)}{text}{''.join(behind)}</body></html>"
        if shape < 0.3:  # in one element without parts
            tag = r.choice(["article", "article", "main", "div", "div", "p", "section", "td", "pre", "center"])
            inside = f'<{tag}{self.maybe("body", chance=0.3)} {_LABEL}="1">{self.bare()}</{tag}>'
            around = [self.boilerplate(k) for k in ("menu", "head", "ad", "form") if r.random() < 0.3]
            behind = [self.boilerplate(k) for k in ("side", "note", "share", "foot") if r.random() < 0.3]
            return f"<html><body {_LABEL}='0'>{''.join(around)}{inside}{''.join(behind)}</body></html>"
        tag = r.choice(["article", "article", "article", "main", "div", "section", "td"])
        named = self.maybe("body") if tag in ("article", "main") else self.named("body")
        inner = r.choice([f"<h1>{self.some(2, 10)}</h1>", f"<h1>{self.some(2, 10)}</h1>", f"<header><h1>{self.some(2, 10)}</h1></header>", ""])
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9])):
            inner += self.paragraph()
            if r.random() < 0.1:
                inner += self.boilerplate(r.choice(["ad", "form", "share", "note", "side"]))
        if r.random() < 0.15:
            inner += self.boilerplate(r.choice(["comment", "share"]))
        if r.random() < 0.08:  # comments right behind the paragraphs, under a heading
            remarks = "".join(f"<li>{self.some(4, 60, True)}</li>" for _ in range(r.randint(1, 5)))
            inner += f"<h3 {_LABEL}='0'>{r.choice([*COMMENT_HEADINGS, 'leave a reply', 'post a comment']).capitalize()}</h3><{(at := r.choice(['ul', 'div', 'ol']))} {_LABEL}='0'>{remarks}</{at}>"
        body = f'<{tag}{named} {_LABEL}="1">{inner}</{tag}>'
        if tag == "td":
            body = f"<table><tr>{body}</tr></table>"
        for _ in range(r.randint(0, 2)):
            wrap = r.choice(["div", "div", "main", "section"])
            body = f"<{wrap}{self.maybe('body', chance=0.4)} {_LABEL}=\"0\">{r.choice(['', self.boilerplate(r.choice(['ad', 'side', 'share'])), ''])}{body}{r.choice(['', self.boilerplate(r.choice(['comment', 'side', 'ad', 'form'])), ''])}</{wrap}>"
        before = "".join(self.boilerplate(k) for k in ("head", "menu", "ad", "note", "form") if r.random() < 0.45)
        behind = "".join(self.boilerplate(k) for k in ("comment", "side", "share", "form", "note", "ad") if r.random() < 0.3) + (self.boilerplate("foot") if r.random() < 0.85 else "")
        return f"<!DOCTYPE html><html><head><title>{self.some(2, 8)}</title><style>p{{margin:0}}</style></head><body {_LABEL}='0'><!-- x --><script>var a = '</p>';</script>{before}{body}{behind}</body></html>"


def labelled_pages(n: int = TRAIN_PAGES, seed: int = TRAIN_SEED) -> list[str]:
    composer = _Composer(seed)
    return [composer.page() for _ in range(n)]


@lru_cache(maxsize=1)
def trained() -> tuple[np.ndarray, np.ndarray]:
    return fit([Page(x, labelled=True) for x in labelled_pages()])


def main_texts(sources: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    pages = [Page(s) for s in sources]
    trees = Trees(pages)
    p, _ = trees.marginals(*model)
    return [page.text(p[a:b] > 0.5) for page, a, b in zip(pages, trees.at[:-1], trees.at[1:], strict=True)]


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page, mapped where it is read."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def make():
        def step(part):
            found = main_texts([t.decode("utf-8", "replace") for t in texts(part.column(2))], shared.value)
            return {"page_id": part.column(0), "url": part.column(1), "text": pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64())}

        return step

    return map_text(pages, ["page_id", "url", "html"], make, "page_id long, url string, text string, n_chars long")
