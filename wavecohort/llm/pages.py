"""HTML extraction: a linear-chain conditional random field over the DOM's leaf blocks.

A page is read into leaf blocks, the runs of text between block-level tags. A block's features are the tags and the
class and id words of its ancestors, the nearest apart from the others and those that hold most of the page's text apart
from those that hold a part, and how its text looks (length, links, marks). A chain model with two states, main
text and other, is trained on labelled pages and decoded by Viterbi; what it calls main text is joined in page order.

The labelled pages are made by :func:`labelled_pages`, from page layouts in common use, with made-up text, so that no
word but structure is learnt. The model is fitted once in each driver.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecohort.llm.common import inside, table

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul textarea iframe video audio canvas".split()
)
SILENT = frozenset("script style noscript template head title svg annotation annotation-xml object iframe textarea select option video audio canvas".split())
#: What may stand in a head; any other start tag ends one that was left open.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Tags whose content is no part of a head's own.
NESTED = frozenset("noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that an opening tag closes, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
STRUCTURE = frozenset("article aside body blockquote footer form h1 h2 h3 header li main nav p pre section table figure figcaption ul button label dialog div td details".split())
_WORD = re.compile(r"[a-z]+")


#: First and last words of class names that tell a state and no part of a page (has-sidebar, comments-open).
BEFORE, AFTER = frozenset("has is no not with without".split()), frozenset("active closed disabled enabled open".split())
#: An ancestor with this share of a page's text, of this many blocks or more, is around the page and no part of it.
WIDE, LEAST_BLOCKS = 0.7, 3


class _Frame:
    __slots__ = ("tag", "place", "block")

    def __init__(self, tag: str, place: int, block: str = ""):
        self.tag, self.place, self.block = tag, place, tag if tag in BLOCK_TAGS else block


class _Blocks(HTMLParser):
    """Leaf blocks ``(text, number of the innermost ancestor with names, innermost block tag, letters in links)`` of a page,
    and each such ancestor's parent among them with its own names."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Frame("", -1)]
        self.out: list[tuple[str, int, str, int]] = []
        self.named: list[tuple[int, frozenset[str]]] = []
        self.text: list[str] = []
        self.linked = self.silent = self.links = 0
        self.open: dict[str, int] = {}  # open tags by name: what is not open is not searched for, so that broken pages take linear time

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.out.append((text, self.stack[-1].place, self.stack[-1].block, self.linked))
        self.text, self.linked = [], 0

    def pop(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.open[tag] -= 1
            self.silent -= tag in SILENT
            self.links -= tag == "a"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD and (self.open.get("head") or (tag == "body" and self.open.get("title"))):  # a head left open ends here
            at = next((i for i, f in enumerate(self.stack) if f.tag == "head" or (f.tag == "title" and tag == "body")), None)
            if at is not None and (tag == "body" or not any(f.tag in NESTED - {"title"} for f in self.stack[at:])):
                self.pop(at)
        if tag in BLOCK_TAGS:
            self.flush()
            if tag in CLOSES:
                closed, stop = CLOSES[tag]
                for i in range(len(self.stack) - 1, 0, -1) if any(self.open.get(x) for x in closed) else ():
                    if self.stack[i].tag in stop:
                        break
                    if self.stack[i].tag in closed:
                        self.pop(i)
                        break
            elif self.open.get("p") and tag not in ("button", "label", "option"):  # a paragraph ends where another block begins
                for i in range(len(self.stack) - 1, 0, -1):
                    if self.stack[i].tag == "p":
                        self.pop(i)
                        break
                    if self.stack[i].tag in BLOCK_TAGS:
                        break
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        own = {f"in:{tag}"} if tag in STRUCTURE else set()
        for k, v in attrs if tag not in ("html", "body") else ():  # names of the whole page tell nothing of a part
            for token in v.lower().split() if v and k in ("class", "id", "role") else ():
                found = _WORD.findall(token)
                if found and not (len(found) > 1 and (found[0] in BEFORE or found[-1] in AFTER)):
                    own |= {f"name:{w}" for w in found if w in NAMES}
        place = self.stack[-1].place
        if own:
            self.named.append((place, frozenset(own)))
            place = len(self.named) - 1
        self.stack.append(_Frame(tag, place, self.stack[-1].block))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        for i in range(len(self.stack) - 1, 0, -1) if self.open.get(tag) else ():
            if self.stack[i].tag == tag:
                self.pop(i)
                return

    def handle_data(self, data: str) -> None:
        if self.stack[-1].tag == "head" and data.strip():  # text of a head's own ends one that was left open
            self.pop(len(self.stack) - 1)
        if not self.silent:
            self.text.append(data)
            self.linked += len(data) if self.links else 0


# Words of class and id names that page authors use for parts of a page.
NAMES = frozenset(
    "ad ads advert advertisement article author banner body breadcrumb breadcrumbs byline comment comments consent content cookie copyright date disclaimer entry footer form gdpr head header hero login main masthead menu meta modal nav navbar navigation newsletter notice pagination popup post promo promoted related reply respond search share sharing sidebar sidebars signup skip social sponsored sponsor story subscribe tags text toolbar topbar widget alert message rail recommended teaser".split()
)


def leaf_blocks(html: str | None) -> list[tuple[str, frozenset[str], str, int]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    held, total = [0] * len(parser.named), 0
    for text, place, _, _ in parser.out:
        total += len(text)
        if place >= 0:
            held[place] += len(text)
    for i in range(len(held) - 1, -1, -1):  # a parent comes before its children
        if parser.named[i][0] >= 0:
            held[parser.named[i][0]] += held[i]
    around: list[frozenset[str]] = []
    names: list[frozenset[str]] = []
    for (parent, own), h in zip(parser.named, held, strict=True):
        wide = len(parser.out) >= LEAST_BLOCKS and h >= WIDE * total
        own = frozenset(f"wide:{x}" for x in own) if wide else own
        around.append(own | around[parent] if parent >= 0 else own)
        names.append(around[-1] | {f"near:{x}" for x in own})
    return [(text, names[place] if place >= 0 else frozenset(), tag, linked) for text, place, tag, linked in parser.out]


def block_features(block: tuple[str, frozenset[str], str, int]) -> list[str]:
    text, names, tag, linked = block
    n = len(text)
    marks = sum(text.count(c) for c in ".!?")
    out = [*names, f"tag:{tag}", f"long:{min(n.bit_length(), 10)}", f"linked:{min(4, 4 * linked // max(n, 1))}", f"marks:{min(marks, 3)}", f"end:{text[-1] in '.!?:'}", "all"]
    if "\xa9" in text:
        out.append("copyright")
    return out


class ChainField:
    """A linear-chain conditional random field with two states and binary features."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weight = np.zeros((0, 2))
        self.move = np.zeros((2, 2))
        self.start = np.zeros(2)

    def emissions(self, page: list[list[str]]) -> np.ndarray:
        out, index, weight = np.zeros((len(page), 2)), self.index, self.weight
        for i, features in enumerate(page):
            own = [index[f] for f in features if f in index]
            if own:
                out[i] = weight[own].sum(axis=0)
        return out

    def fit(self, pages: list[list[list[str]]], labels: list[list[int]], epochs: int = 25, rate: float = 0.3, decay: float = 1e-3) -> ChainField:
        for page in pages:
            for features in page:
                for f in features:
                    self.index.setdefault(f, len(self.index))
        self.weight = np.zeros((len(self.index), 2))
        known = [[np.array([self.index[f] for f in features]) for features in page] for page in pages]
        squares = [np.full_like(self.weight, 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6)]
        order = random.Random(3)
        turns = list(range(len(pages)))
        for _ in range(epochs):
            order.shuffle(turns)
            for p in turns:
                page, y = known[p], labels[p]
                e = np.array([self.weight[f].sum(axis=0) for f in page])
                one, two = self.marginals(e)
                one[np.arange(len(y)), y] -= 1
                g_weight = np.zeros_like(self.weight)
                for f, g in zip(page, one, strict=True):
                    g_weight[f] += g
                g_move = two.sum(axis=0)
                for a, b in zip(y, y[1:], strict=False):
                    g_move[a, b] -= 1
                for w, g, s in ((self.weight, g_weight + decay * self.weight, squares[0]), (self.move, g_move, squares[1]), (self.start, one[0], squares[2])):
                    s += g * g
                    w -= rate * g / np.sqrt(s)
        return self

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the states, and of pairs of neighbouring states, by the forward-backward recursion."""
        n = len(e)
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        a[0] = self.start + e[0]
        for i in range(1, n):
            a[i] = e[i] + np.logaddexp.reduce(a[i - 1][:, None] + self.move, axis=0)
        for i in range(n - 2, -1, -1):
            b[i] = np.logaddexp.reduce(self.move + (e[i + 1] + b[i + 1])[None, :], axis=1)
        z = np.logaddexp.reduce(a[-1])
        pairs = np.exp(a[:-1, :, None] + self.move[None] + (e[1:] + b[1:])[:, None, :] - z)
        return np.exp(a + b - z), pairs

    def decode(self, e: np.ndarray) -> list[int]:
        """The best sequence of states (Viterbi)."""
        (m00, m01), (m10, m11) = self.move.tolist()
        s0, s1 = self.start.tolist()
        back = []
        for i, (e0, e1) in enumerate(e.tolist()):
            if not i:
                s0, s1 = s0 + e0, s1 + e1
                continue
            a0, b0, a1, b1 = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((int(b0 > a0), int(b1 > a1)))
            s0, s1 = max(a0, b0) + e0, max(a1, b1) + e1
        if not len(e):
            return []
        path = [int(s1 > s0)]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Pages of common layouts with their main text's blocks."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bcdfglmnprstv" for b in ("a", "e", "i", "o", "u", "an", "er", "is")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high)))

    def sentence() -> str:
        return words(1, 18).capitalize() + rng.choice(["."] * 8 + ["?", "!", ",", ""])

    def prose() -> str:
        return " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))

    def pick(p: float) -> bool:
        return rng.random() < p

    def links() -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randint(3, 9)))

    def box(tag: str, names: list[str], inside: str) -> str:
        return f'<{tag} class="{rng.choice(names)}">{inside}</{tag}>'

    def other() -> str:
        return rng.choice(
            [
                lambda: box("div", ["ad", "ads banner", "advert", "sponsored", "promo"], rng.choice([prose(), f"<p>{prose()}</p>"])),
                lambda: box("aside", ["sidebar", "widget", "related", "rail"], f"<h3>{words(1, 4)}</h3><ul>{links()}</ul>" + f"<p>{prose()}</p>" * pick(0.5)),
                lambda: f"<aside><p>{prose()}</p></aside>",
                lambda: box("div", ["cookie notice", "consent", "notice", "alert", "gdpr popup"], f"<p>{prose()}</p>" + "<button>OK</button>" * pick(0.5)),
                lambda: f'<form action="/"><label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button><p>{prose()}</p></form>',
                lambda: box("div", ["newsletter", "subscribe", "signup"], f"<h3>{words(2, 5)}</h3><p>{prose()}</p>"),
                lambda: box("div", ["share", "social", "tags", "breadcrumb", "pagination"], f"<ul>{links()}</ul>"),
                lambda: box("div", ["related", "recommended", "promoted"], f"<h3>{words(1, 4)}</h3>" + "".join(f'<p><a href="/{word()}">{sentence()}</a></p>' for _ in range(3))),
            ]
        )()

    def comments() -> str:
        inside = "".join(f'<div class="comment"><p>{words(1, 2)}</p><p>{prose()}</p></div>' for _ in range(rng.randint(1, 5)))
        return rng.choice([f'<section class="comments" id="comments"><h2>{words(1, 2)}</h2>{inside}</section>', f'<div id="comments">{inside}</div>', f'<section id="comments"><ol class="comments">{"".join(f"<li><p>{prose()}</p></li>" for _ in range(3))}</ol></section>'])

    made = []
    for _ in range(n):
        main, inner = [], []
        kind_of_text, bare = rng.choice(["p"] * 8 + ["div", "bare"]), False

        def put(tag: str, text: str, main=main, inner=inner, **how) -> None:
            main.append(" ".join(text.split()))
            inner.append(f"<{tag}>{text}" + f"</{tag}>" * pick(how.get("closed", 0.95)))

        if pick(0.8):
            put("h1", words(2, 10).capitalize() + rng.choice(["", ".", "?"]), closed=1)
        for _ in range(rng.randint(1, 10)):
            kind, was_bare, bare = rng.random(), bare, False
            if kind < 0.72 and kind_of_text == "bare":
                text, bare = prose(), True
                inner.append(f"{text}<br><br>")
                main += [text] if not was_bare else []
                main[-1] = main[-1] if not was_bare else f"{main[-1]} {text}"
            elif kind < 0.72:
                put(kind_of_text, prose(), closed=0.95 if kind_of_text == "p" else 1)
            elif kind < 0.8:
                put(rng.choice(["h2", "h3"]), words(1, 7).capitalize(), closed=1)
            elif kind < 0.86:
                items = [sentence() for _ in range(rng.randint(1, 5))]
                main += [" ".join(x.split()) for x in items]
                inner.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            elif kind < 0.9:
                put("blockquote", prose(), closed=1)
            elif kind < 0.93:
                put("pre", words(3, 20), closed=1)
            elif kind < 0.96:
                text = prose()
                main.append(text)
                inner.append(f"<figure><img src='x'><figcaption>{text}</figcaption></figure>")
            else:
                inner.append(other())
        if pick(0.25):
            inner.append(comments())
        body = "\n".join(inner)
        shell = rng.choice(["<article>{}</article>"] * 5 + ["<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main"><div class="post">{}</div></div>', '<div class="entry text">{}</div>', '<div class="article body">{}</div>', '<section class="story">{}</section>', '<div id="content">{}</div>', '<div class="entry-content">{}</div>', '<div class="post-content">{}</div>'])
        if pick(0.15):  # the article among what a wrapper with a telling name holds besides
            shell = f'<div class="{rng.choice(["has-sidebar", "with-menu", "content-sidebar", "comments-open"])}">{shell}{other() if pick(0.5) else ""}</div>'
        parts = []
        if pick(0.4):
            parts.append(rng.choice([f'<header><p>{words(1, 4)}</p></header>', f'<header class="masthead"><a href="/">{words(1, 3)}</a><p>{sentence()}</p></header>', f'<div class="header">{words(1, 5)}</div>']))
        if pick(0.85):
            parts.append(rng.choice([f"<nav><ul>{links()}</ul></nav>", f'<div class="menu navigation"><ul>{links()}</ul></div>', f'<ul class="nav">{links()}</ul>']))
        parts += [other() for _ in range(rng.randint(0, 2))]
        parts.append(shell.format(body))
        parts += [other() for _ in range(rng.randint(0, 2))]
        if pick(0.2):
            parts.append(comments())
        if pick(0.85):
            end = rng.choice([f"&copy; {word()}.example &middot; {prose()}", f"<p>&copy; {words(1, 3)}</p><ul>{links()}</ul>", prose()])
            parts.append(rng.choice(["<footer>{}</footer>", '<div class="footer">{}</div>']).format(end))
        if pick(0.3):  # all of the page within one more
            parts = [rng.choice(['<form id="form1" action="/">{}</form>'] * 2 + ['<div class="{}">'.format(x) + "{}</div>" for x in ("page site", "content", "main", "sidebar-right", "body text", "menu-page")] + ["<section>{}</section>", "<main>{}</main>"]).replace("{}", "\n".join(parts))]
        shown = rng.choice(["", "", ' class="home post comments-open"', ' class="has-sidebar nav-open"', ' id="footer-page"'])
        head = f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head><body{shown}>"
        made.append((head + "\n".join(parts) + rng.choice(["</body></html>", ""]), main))
    return made


@functools.cache
def model(n: int = 400, seed: int = 11) -> ChainField:
    pages, labels = [], []
    for html, main in labelled_pages(n, seed):
        blocks, left, y = leaf_blocks(html), list(main), []
        for b in blocks:  # the main text's blocks come in order
            hit = bool(left) and b[0] == left[0]
            y.append(int(hit))
            if hit:
                left.pop(0)
        if blocks and not left:
            pages.append([block_features(b) for b in blocks])
            labels.append(y)
    return ChainField().fit(pages, labels)


def main_text(html: str | None, field: ChainField) -> str:
    blocks = leaf_blocks(html)
    states = field.decode(field.emissions([block_features(b) for b in blocks]))
    return "\n\n".join(b[0] for b, s in zip(blocks, states, strict=True) if s)


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, field: ChainField | None = None) -> DataFrame:
    """The columns ``keep`` of ``pages`` (all by default) with ``text``, the main text, and ``n_chars``, its length.

    A null or empty page, or one without main text, gives an empty text. Pages are read whole, however long or broken;
    repeated rows give equal rows. Columns of ``pages`` with the two names are replaced.
    """
    field = field or model()
    kept = [c for c in (keep or pages.columns) if c not in ("text", "n_chars")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            text = [main_text(x if isinstance(x, str) else None, field) for x in f.iloc[:, 0]]
            out = f[kept].copy()
            out["text"], out["n_chars"] = pd.Series(text, index=f.index, dtype=object), pd.Series([len(t) for t in text], index=f.index, dtype="int64")
            yield out

    types = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "text string", "n_chars long"])
    return pages.select(F.col(html_col).alias(inside(pages, "html_")[0]), *[F.col(c) for c in kept]).mapInPandas(run, schema)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
