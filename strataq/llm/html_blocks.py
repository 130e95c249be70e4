"""Main text of web pages: flat text blocks and a decision tree.

A page is cut into flat blocks at block-level tags. Each block has its word
count and link density and those of the two blocks on either side, the words of
link-free text around it, and, as extras, what tags tell: paragraph, heading or
list item; and where the block stands: in page furniture, or an element whose
class or id names furniture by all its words ("top-menu", not "side-effects");
outside the articles of a page that has some; on a page without; or in an
article. A decision tree grown here tells text from
boilerplate. It learns from a small table that ``labelled_blocks`` writes by
rule, with pages without semantic tags and pages whose tags or class names
mislead, so word counts and link densities carry it where tags say nothing.

Text means: character references decoded, white space inside a block as one
space, trimmed; kept blocks joined by a line feed in page order. A line break
tag counts as white space. Script, style and form content, titles and comments
are no text.

Cases: null or empty html, and pages without text, give "". Unclosed tags,
quotes and comments never raise: an open comment or script runs to the end.
Equal pages give equal texts. Time and memory
are linear in the page, however deep its tags nest.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._batches import map_texts

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
#: Element names of HTML by their role here.
RAW = set("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = {"article", "main"}
FURNITURE = set("nav header footer aside form button select option fieldset menu dialog head svg math object audio video canvas datalist figcaption".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id and role that mark furniture, and words that say nothing beside them.
CUES = set("ad ads advert adverts advertisement sponsor sponsored banner promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer copyright legal comment comments reply replies respond disqus sharing related recommended newsletter subscribe signup login search toolbar widget pagination pager complementary contentinfo".split())
NEUTRAL = set("top bottom left right main site page box block area slot wrap wrapper container section list item inner outer bar panel group row col text content the user reader social share".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SPLIT = re.compile(r"[^a-z]+")

FEATURES = ("words", "links", "words_before", "links_before", "words_before_2", "links_before_2", "words_after", "links_after", "words_after_2", "links_after_2", "text_around", "links_around", "stand", "paragraph", "heading", "list")
#: The first of these, as the dealt method names them; the others are what tags tell.
DENSITIES = 12


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    article: bool = False
    furniture: bool = False
    cue: bool = False
    tag: str = ""
    text: str = ""
    words: int = 0


def cues(attributes: str) -> bool:
    """Whether a class, id or role is made of furniture words (and neutral ones), or a mark hides the element."""
    low = attributes.lower()
    if "=" not in low:
        return " hidden" in f" {low} "
    for key, v, w, x in ATTRIBUTE.findall(low):
        if key in ("class", "id", "role"):
            for name in (v or w or x).split():
                words = [y for y in SPLIT.split(name) if y]
                if not set(words).isdisjoint(CUES) and set(words) <= CUES | NEUTRAL:
                    return True
    return "display:none" in low.replace(" ", "") or 'aria-hidden="true"' in low or bool(re.search(r"\shidden(?:\s|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", low)))


def blocks(html: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, bool]] = []  # name, cue
    opened: dict[str, int] = {}  # how often each name is in the stack
    now = Block()
    depth = {"article": 0, "furniture": 0, "cue": 0, "a": 0}

    def end() -> None:
        nonlocal now
        raw = "".join(now.parts)
        now.text = " ".join(unescape(raw).split())
        if now.text:
            now.words = now.text.count(" ") + 1
            out.append(now)
        now = Block(article=depth["article"] > 0, furniture=depth["furniture"] > 0, cue=depth["cue"] > 0, tag=stack[-1][0] if stack else "")

    def count(x: tuple[str, bool], step: int) -> None:
        opened[x[0]] = opened.get(x[0], 0) + step
        depth["article"] += step * (x[0] in ARTICLE)
        depth["furniture"] += step * (x[0] in FURNITURE)
        depth["cue"] += step * x[1]

    def text(piece: str) -> None:
        if piece:
            now.parts.append(piece)
            if depth["a"]:
                now.linked += len(piece.split())

    at, n, last = 0, len(html), html.rfind(">")
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        text(html[at:lt])
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            at = n if stop < 0 else stop + 3
            continue
        if html[lt + 1 : lt + 2] in ("!", "?"):
            stop = html.find(">", lt)
            at = n if stop < 0 else stop + 1
            continue
        if lt >= last:  # no tag can end behind here
            text(html[lt:])
            break
        m = TAG.match(html, lt) or LOOSE.match(html, lt)
        if not m:
            text("<")
            at = lt + 1
            continue
        at = m.end()
        closing, name = bool(m[1]), m[2].lower()
        if name in RAW and not closing:
            stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
            if not stop:
                break
            close = html.find(">", stop.start())
            at = n if close < 0 else close + 1
            continue
        if name == "a":
            depth["a"] = 0 if closing else 1
            continue
        if name == "br":
            text(" ")
            continue
        mark = bool(m[3]) and not closing and cues(m[3])
        if name in INLINE and not mark:
            if closing and any(x[0] == name for x in stack[-4:]):
                while stack and stack[-1][0] != name:
                    count(stack.pop(), -1)
                if stack:
                    count(stack.pop(), -1)
                end()
            continue
        if not closing and name not in VOID:
            while stack and stack[-1][0] in SELF_CLOSING.get(name, {"p"} if name not in INLINE else ()):
                count(stack.pop(), -1)
            stack.append((name, mark))
            count(stack[-1], 1)
        elif closing and opened.get(name, 0):
            while True:
                x = stack.pop()
                count(x, -1)
                if x[0] == name:
                    break
            depth["a"] = 0
        end()
    end()
    return out


def table(found: list[Block]) -> np.ndarray:
    """One row of FEATURES per block."""
    n = len(found)
    words = np.array([b.words for b in found], float)
    linked = np.array([b.linked for b in found], float)
    links = linked / words
    at = lambda a, k: np.r_[a[k:], np.zeros(min(k, n))] if k > 0 else np.r_[np.zeros(min(-k, n)), a[:k]]
    near = [k for k in (-3, -2, -1, 1, 2, 3)]
    plain = np.where(links < 0.3, words, 0.0)
    around = sum(at(plain, k)[:n] for k in near)
    all_words, all_linked = sum(at(words, k)[:n] for k in near), sum(at(linked, k)[:n] for k in near)
    page = any(b.article for b in found)
    stand = [-2.0 if b.furniture or b.cue else 0.0 if not page else 1.0 if b.article else -1.0 for b in found]
    flags = np.array([[k, b.tag == "p", b.tag in HEADING, b.tag in ("li", "dd", "dt")] for k, b in zip(stand, found, strict=True)], float)
    sides = [at(a, k)[:n] for k in (-1, -2, 1, 2) for a in (words, links)]
    return np.c_[words, links, np.stack(sides, 1), around, all_linked / np.maximum(all_words, 1), flags]


LAYOUTS = ("semantic", "main", "tagless", "misleading", "cards", "classes")


def labelled_blocks(pages: int = 4800, seed: int = 11, layouts: tuple[str, ...] = LAYOUTS) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of pages in several layouts, written by rule."""
    found = [(table(b), [x.text.startswith("x") for x in b]) for b in (blocks(p) for p in labelled_pages(pages, seed, layouts)) if b]
    return np.concatenate([x for x, _ in found]), np.array([t for _, y in found for t in y], float)


def labelled_pages(pages: int, seed: int, layouts: tuple[str, ...] = LAYOUTS) -> list[str]:
    """Pages whose words start with ``x`` in text and ``o`` in boilerplate."""
    r = random.Random(seed)

    def words(low: int, high: int, good: bool) -> str:
        return " ".join(("x" if good else "o") + "abcdefgh"[r.randrange(8)] * r.randint(1, 8) for _ in range(r.randint(low, high)))

    def wrap(tag: str, body: str, attributes: str = "") -> str:
        return f"<{tag}{' ' + attributes if attributes else ''}>{body}</{tag}>"

    bad = lambda low, high: words(low, high, False)
    link = lambda low, high: wrap("a", bad(low, high), 'href="/"')

    def menu() -> str:
        items = [link(1, 3) for _ in range(r.randint(2, 9))]
        return r.choice([lambda: wrap("ul", "".join(wrap("li", x) for x in items)), lambda: wrap("div", " | ".join(items)), lambda: "".join(wrap("div", x) for x in items)])()

    def comment_list(tag: str, attributes: str = "") -> str:
        return "".join(wrap(tag, wrap("div", bad(1, 4)) + wrap("p", bad(2, 45)) + wrap("div", link(1, 2)), attributes) for _ in range(r.randint(1, 5)))

    def teasers(tag: str) -> str:
        return "".join(wrap(tag, wrap("h3", link(3, 9)) + (wrap("p", bad(4, 18)) if r.random() < 0.6 else "")) for _ in range(r.randint(2, 5)))

    #: What stands around an article, by kind: what it holds, the tag that names it, and class names that do.
    kinds = {
        "nav": (menu, "nav", ["menu", "top-menu", "navbar", "nav main"]),
        "header": (lambda: wrap("div", bad(1, 5)) + (wrap("p", bad(2, 9)) if r.random() < 0.5 else "") + (menu() if r.random() < 0.5 else ""), "header", ["header", "site-header", "masthead"]),
        "footer": (lambda: r.choice([wrap("p", bad(3, 16)), "&copy; " + bad(2, 8), menu() + wrap("p", bad(2, 12))]), "footer", ["footer", "site-footer", "copyright"]),
        "side": (lambda: wrap("h3", bad(1, 4)) + r.choice([menu, lambda: wrap("p", bad(3, 14) + " " + link(1, 3)), lambda: teasers("div")])(), "aside", ["sidebar", "widget", "right sidebar"]),
        "ad": (lambda: r.choice([bad(2, 12), wrap("p", bad(3, 14)) + wrap("div", link(1, 3)), link(2, 8)]), "div", ["ad", "advert", "ad-slot", "sponsored banner"]),
        "cookie": (lambda: wrap("p", bad(6, 26)) + r.choice([wrap("button", bad(1, 2)), wrap("div", link(1, 2))]), "div", ["cookie-notice", "consent", "notice"]),
        "form": (lambda: wrap("form", wrap("label", bad(1, 4)) + wrap("p", bad(2, 12)) + wrap("button", bad(1, 2))), "div", ["newsletter", "signup", "search"]),
        "related": (lambda: wrap("h3", bad(1, 4)) + r.choice([menu, lambda: teasers("div")])(), "div", ["related", "recommended"]),
        "comments": (lambda: wrap("h2", bad(1, 3)) + comment_list("div"), "section", ["comments", "comment-list", "user-comments"]),
    }

    def furniture(kind: str, layout: str) -> str:
        body, tag, names = kinds[kind][0](), kinds[kind][1], kinds[kind][2]
        named = r.choice(['class="{}"', 'id="{}"']).format(r.choice(names))
        if layout in ("semantic", "main", "cards"):
            return wrap(tag, body, named if tag in ("div", "section") else "")
        if layout == "classes":
            return wrap("div", body, named)
        return wrap("div", body, r.choice(["", "", 'class="box-2"', 'class="post"', 'id="story"'])) if layout == "misleading" else wrap("div", body)

    def article(layout: str) -> str:
        heading = wrap(r.choice(["h1", "h1", "h2"]), words(1, 10, True))
        short = r.random() < 0.5
        if layout not in ("tagless", "misleading") and r.random() < 0.25:  # where tags tell, an article may be tiny
            return heading + "".join(wrap("p", words(*r.choice([(1, 6), (6, 25)]), True)) for _ in range(r.randint(1, 3)))
        parts = []
        for k in range(r.randint(2, 9)):
            sort = r.random()
            size = (1, 6) if short and k and sort < 0.35 else (8, 30) if sort < 0.55 else (25, 140)
            inner = words(*size, True)
            if sort > 0.8:
                inner += " " + wrap("a", words(1, 3, True)) + " " + words(4, 12, True)
            if k and sort > 0.93:
                parts.append(wrap("h2", words(1, 6, True)))
            if sort > 0.97:
                parts.append(wrap("ul", "".join(wrap("li", words(3, 20, True)) for _ in range(r.randint(2, 4)))))
            parts.append(wrap("div" if layout in ("tagless", "misleading") and r.random() < 0.15 else "p", inner))
        if layout in ("tagless", "misleading") and not any(len(x) > 200 for x in parts):
            parts.append(wrap("p", words(40, 120, True)))
        if layout not in ("tagless", "misleading"):  # where tags tell, it may begin and end with a word or two
            for at in (0, len(parts)):
                if r.random() < 0.4:
                    parts.insert(at, wrap("p", words(1, 8, True)))
        return heading + "".join(parts)

    out = []
    for k in range(pages):
        layout = layouts[k % len(layouts)]
        body = article(layout)
        extra = [furniture(x, layout) for x in r.sample(["ad", "comments", "form", "related", "side"], r.choice([0, 0, 1, 2]))]
        inside = "".join(extra) if layout != "tagless" else ""
        if layout == "misleading":
            body = wrap(r.choice(["div", "article", "section"]), body, r.choice(['class="post side-effects"', 'id="share-prices"', 'class="menu-planning"', 'class="ad-hoc story"', 'class="notice-period"'])) + inside
        elif layout == "cards":
            wrapper = r.choice(["article", "div"])
            body = wrap(wrapper, body + (inside if wrapper == "article" else "")) + r.choice([lambda: teasers("article"), lambda: wrap("h2", bad(1, 3)) + comment_list("article", 'class="comment"')])()
        else:
            body = {"semantic": lambda: wrap("article", body + inside), "main": lambda: wrap("main", wrap("div", body, 'class="content"') + inside), "tagless": lambda: wrap("div", body) + inside, "classes": lambda: wrap("div", body, r.choice(['class="post"', 'class="entry-content"', 'id="story"'])) + inside}[layout]()
        head = "".join(furniture(f, layout) for f in r.sample(["nav", "nav", "header", "ad", "cookie"], r.randint(1, 4)))
        tail = "".join(furniture(f, layout) for f in r.sample(["footer", "footer", "side", "ad", "related", "comments", "form", "nav"], r.randint(1, 4)))
        out.append(head + body + tail)
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 16, least: int = 3) -> tuple:
    """A leaf (share of text) or (feature, threshold, low branch, high branch), by Gini impurity."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return (share,)
    best = (1e9, 0, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        ones, n = np.cumsum(t)[:-1], np.arange(1, len(t))
        ok = (v[1:] > v[:-1]) & (n >= least) & (len(t) - n >= least)
        if ok.any():
            rest = t.sum() - ones
            cost = np.where(ok, ones * (1 - ones / n) + rest * (1 - rest / (len(t) - n)), 1e9)
            k = int(cost.argmin())
            if cost[k] < best[0]:
                best = (float(cost[k]), f, float((v[k] + v[k + 1]) / 2))
    if best[0] >= len(y) * share * (1 - share) - 1e-9:
        return (share,)
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


@lru_cache(maxsize=1)
def trained() -> tuple:
    return grow(*labelled_blocks())


def is_text(tree: tuple, row: np.ndarray) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


def main_text(html: str, tree: tuple) -> str:
    found = blocks(html)
    if not found:
        return ""
    return "\n".join(b.text for b, row in zip(found, table(found).tolist(), strict=True) if is_text(tree, row))


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, text, n_chars (code points)."""
    tree = trained()

    def run(pages: list[str]) -> list:
        texts = [main_text(p, tree) for p in pages]
        return [texts, [len(t) for t in texts]]

    return map_texts(df, id_col, html_col, T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]), lambda: run)
