"""Main text of web pages from flat blocks, classified by a decision tree.

A page is cut at block-level tags into flat text blocks.  A block is described by its
number of words and its link density, by those of the blocks before and after it, and by
the kind of containers it lies in; a decision tree trained on the small labelled table
below says whether it belongs to the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "main", "page_has_main", "heading"]

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# elements that end a block and may hold others; those of MARGIN are never article text
CONTAINERS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup html "
    "li main menu nav ol search section summary table tbody td tfoot th thead tr ul".split()
)
BREAKS = CONTAINERS | HEADINGS | {"p", "pre", "hr", "caption", "legend", "option", "optgroup", "head", "frameset"}
MARGIN = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "search", "fieldset"}
# elements whose content is not text of the page: up to their end tag, or else to the end of the page ...
RAW = "script style title textarea".split()
# ... or, left open, up to the next tag
UNREAD = set("noscript template select button iframe object svg math canvas audio video map datalist".split())
# words in class, id and role that tell what a container is for
MARGIN_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions banner banners cookie "
    "cookies consent gdpr privacy notice notices alert alerts popup modal overlay sidebar sidebars side aside rail menu menus nav navbar navi "
    "navigation breadcrumb breadcrumbs pagination pager paging toolbar topbar masthead header footer foot comment comments commentlist reply "
    "replies respond discussion disqus share sharing social related recommended recommendations newsletter subscribe subscription signup "
    "login search searchbox widget widgets copyright legal skip toc taboola outbrain dialog complementary contentinfo".split()
)
# those whose container is for texts by others or of other pages, articles within it included
OTHER_WORDS = set("comment comments commentlist reply replies respond discussion disqus related recommended recommendations sponsored".split())
MAIN_WORDS = set("article content post entry story main articlebody".split())
# the first word of a class that says what its element has, lacks or deals with, not what it is for
MODIFIERS = set("with has have no not without is category categories cat tag tagged topic type format status about".split())
TELLING = {"class", "id", "role", "hidden", "style", "aria-hidden"}
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PARTS = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/](?:[^>]*)(?:>|\Z)",
    re.S | re.I,
)


@dataclass
class Block:
    text: str
    words: int
    links: float
    aside: bool
    main: bool
    heading: bool


def _purpose(name: str, rest: str) -> str:
    """What a container is for: 'aside' (said to be none of the article's), 'margin', 'header', 'main' (the article) or ''."""
    words: set[str] = set()
    whole: set[str] = set()  # margin words that are all of a class name
    for key, *values in ATTRIBUTE.findall(rest) if rest else ():
        if key.lower() not in TELLING:
            continue
        value = next((v for v in values if v), "")
        if key.lower() == "hidden" or (key.lower() == "aria-hidden" and value == "true"):
            return "aside"
        if key.lower() == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return "aside"
            continue
        for token in value.split():
            found = [w.lower() for w in WORD.findall(token)]
            if found and found[0] not in MODIFIERS:
                words.update(found)
                whole.update(found if MARGIN_WORDS.issuperset(found) else ())
    # an article is not judged by a word in the name of its subject
    words = words - (MARGIN_WORDS - whole) if name in ("article", "main") else words
    if name == "header" or words & MARGIN_WORDS == {"header"}:
        return "header"
    if words & OTHER_WORDS:
        return "aside"
    if name in MARGIN or words & MARGIN_WORDS:
        return "margin"
    return "main" if name in ("article", "main") or words & MAIN_WORDS else ""


def blocks_of(page: str) -> list[Block]:
    """Flat text blocks in page order; references are decoded and white space is folded."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # open containers and their purpose
    pieces: list[str] = []
    linked: list[str] = []
    in_link = heading = False

    def finish() -> None:
        nonlocal pieces, linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            words = text.count(" ") + 1
            link_words = len(html.unescape(" ".join(linked)).split())
            purposes = [p for _, p in stack if p]
            main = "main" in purposes
            # an element left open before the article does not swallow it; what is inside it, or meant for something else, counts
            inner = purposes[purposes.index("main") :] if main else purposes
            aside = "aside" in purposes or "margin" in inner or ("header" in inner and not (main and heading))
            out.append(Block(text, words, link_words / words, aside, main, heading))
        pieces, linked = [], []

    at = 0
    never_closed: set[str] = set()  # elements without an end tag in the rest of the page
    while (part := PARTS.search(page, at)) is not None:
        if part.start() > at:
            text = page[at : part.start()]
            pieces.append(text)
            if in_link:
                linked.append(text)
        at = part.end()
        name = part["name"]
        if name is None:
            continue
        name = name.lower()
        if name in UNREAD:
            if not part["close"] and not part["rest"].endswith("/"):
                end = None if name in never_closed else re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if end is None:
                    never_closed.add(name)
                    end = re.compile("[^<]*").match(page, at)
                at = end.end()
        elif name == "br":
            pieces.append(" ")
        elif name == "a":
            in_link = not part["close"]
        elif name in BREAKS:
            finish()
            in_link = False
            heading = name in HEADINGS and not part["close"]
            if name in CONTAINERS and name not in ("html", "body"):
                if not part["close"]:
                    if not part["rest"].endswith("/"):
                        stack.append((name, _purpose(name, part["rest"])))
                else:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == name:
                            del stack[i:]
                            break
    if at < len(page):
        pieces.append(page[at:])
    finish()
    return out


def features_of(blocks: Sequence[Block]) -> np.ndarray:
    has_main = any(b.main for b in blocks)
    own = np.array([[b.words, b.links] for b in blocks], dtype=float).reshape(-1, 2)
    around = np.vstack([np.zeros((1, 2)), own, np.zeros((1, 2))])
    flags = np.array([[b.aside, b.main, has_main, b.heading] for b in blocks], dtype=float).reshape(-1, 4)
    return np.hstack([own, around[:-2], around[2:], flags])


@dataclass
class Tree:
    """A node of a classification tree: a leaf's share of article blocks, or a split."""

    share: float
    feature: int = -1
    bound: float = 0.0
    below: Tree | None = None
    above: Tree | None = field(default=None)

    def says(self, row: Sequence[float]) -> bool:
        node = self
        while node.below is not None:
            node = node.below if row[node.feature] <= node.bound else node.above
        return node.share > 0.5


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, leaf: int = 2) -> Tree:
    """Greedy splits that lower the Gini impurity most; ties go to the first feature and bound."""
    share = float(y.mean()) if len(y) else 0.0
    node = Tree(share)
    if depth == 0 or share in (0.0, 1.0):
        return node
    best = (share * (1 - share) * len(y) - 1e-9, -1, 0.0)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for bound in (values[1:] + values[:-1]) / 2:
            low = x[:, j] <= bound
            n, p = int(low.sum()), float(y[low].sum())
            if min(n, len(y) - n) < leaf:
                continue
            q = float(y.sum()) - p
            impurity = p * (1 - p / n) + q * (1 - q / (len(y) - n))
            if impurity < best[0] - 1e-12:
                best = (impurity, j, float(bound))
    if best[1] >= 0:
        low = x[:, best[1]] <= best[2]
        node.feature, node.bound = best[1], best[2]
        node.below, node.above = grow(x[low], y[low], depth - 1, leaf), grow(x[~low], y[~low], depth - 1, leaf)
    return node


_LONG = "a longer paragraph of running text with some clauses, which goes on until it has said what it has to say. " * 2
_SHORT = "a short sentence of text."

#: The labelled table: pages whose blocks begin with + (article) or - (not article).
LABELLED_PAGES = [
    f"<nav><a>- home</a> <a>- news</a></nav><div class=ad>- {_SHORT}</div><article><h1>+ title</h1><p>+ {_LONG}<p>+ {_SHORT}<p>+ word."
    f"<p>+ {_LONG}</article><footer>- {_SHORT}</footer>",
    f"<header>- site</header><main><h1>+ title of it</h1><p>+ {_SHORT}</p><p>+ {_LONG}</p><aside>- {_LONG}</aside><p>+ {_LONG}</p>"
    f"<ul><li>+ item</li><li>+ item <a>two</a></li></ul></main><div class=cookie-notice>- {_LONG}</div><footer><p>- a <a>b</a></p></footer>",
    f"<ul><li><a>- home</a></li><li><a>- about us</a></li><li><a>- contact</a></li></ul><div><h1>+ title</h1><p>+ {_LONG}</p><p>+ {_LONG}</p>"
    f"<p>+ {_SHORT}</p><p>+ {_LONG}</p></div><div><a>- more of this</a></div><div><a>- terms</a></div>",
    f"<div class=sidebar><p>- {_LONG}</p></div><div class=post-content><h2>+ title</h2><p>+ {_LONG}</p><p>+ {_SHORT}</p><p><a>+ see there</a></p>"
    f"<p>+ {_LONG}</p></div><div id=comments><p>- {_LONG}</p><p>- {_SHORT}</p></div><form>- mail <p>- {_SHORT}</p></form>",
    f"<div><a>- start</a> <a>- blog</a></div><p>+ {_LONG}</p><p>+ {_LONG}</p><p>+ {_LONG}</p><p>- copyright</p>",
    f"<div role=navigation>- <a>a</a> <a>b</a></div><article><header><h1>+ title</h1><p>- by me</p></header><p>+ {_SHORT}</p><p>+ {_SHORT}</p>"
    f"<div class=share>- share</div><p>+ {_LONG}</p><section class=comments><article>- {_LONG}</article><article>- {_SHORT}</article></section></article>",
    f"<div>- <a>one</a></div><div>- <a>two</a></div><div>- <a>three four five</a></div><h1>+ title</h1><p>+ {_LONG}</p><p>+ {_LONG}</p><div>- <a>six</a></div>",
    f"<nav>- a b c</nav><p>- {_SHORT}</p><article><p>+ {_SHORT}</p></article><p>- {_LONG}</p><div>- {_LONG}</div><footer>- end</footer>",
    f"<article><h1>+ title</h1><h2>+ below it</h2><p>+ {_LONG}</p><nav>- <a>next</a></nav><form><p>- {_LONG}</p></form><p>+ ok</p></article>",
    f"<main><h1>+ title</h1><ul><li><a>+ one</a><li><a>+ two of it</a><li><a>+ three</a></ul><p><a>+ all links</a> <a>here</a></p><p>+ {_LONG}</p></main>",
    f"<article><p><a>+ title</a></p><p><a>+ {_SHORT}</a></p><p>+ {_LONG}</p><div class=related><a>- this too</a></div><p><a>+ source</a></p></article>",
    f"<div><a>- home</a></div><main><p><a>+ a link</a></p><p>+ word</p><p><a>+ b link</a></p></main><div><a>- end</a></div><p>- {_LONG}</p>",
    f"<ul><li><a>- a</a><li><a>- b</a></ul><h2>+ title</h2><p>+ {_LONG}</p><p>+ {_SHORT}</p><p>+ {_LONG}</p><p>- (c) all rights</p><p><a>- terms</a></p>",
    f"<div><a>- a</a></div><p>- login</p><h1>+ title words here</h1><p>+ {_LONG}</p><p>+ {_LONG}</p><p>- imprint</p><div><a>- up</a></div>",
    f"<div><a>- home</a></div><h1>+ title</h1><p>+ {_SHORT}</p><p>+ {_SHORT}</p><p>+ {_LONG}</p><p>- imprint</p><div><a>- up</a></div>",
    f"<p><a>- home</a> <a>- all</a></p><h2>+ title</h2><p>+ {_SHORT}</p><h3>+ part</h3><p>+ {_SHORT}</p><p>+ word</p><p>+ {_LONG}</p><div><a>- up</a></div>",
    f"<header><h1>- site name</h1></header><article><h2>+ title</h2><p>+ {_LONG}</p></article><aside><h3>- related</h3><p>- {_LONG}</p></aside>",
]


def labelled_blocks(page: str) -> tuple[list[Block], list[bool]]:
    """The blocks of a labelled page without their marks, and which of them are the article's."""
    blocks = blocks_of(page)
    plain = [
        replace(b, text=b.text[2:], words=max(1, b.words - 1), links=b.links if b.links in (0.0, 1.0) else min(1.0, b.links * b.words / max(1, b.words - 1)))
        for b in blocks
    ]
    return plain, [b.text.startswith("+") for b in blocks]


def trained_tree(pages: Sequence[str] = LABELLED_PAGES) -> Tree:
    rows = [labelled_blocks(p) for p in pages]
    x = np.vstack([features_of(blocks) for blocks, _ in rows])
    return grow(x, np.array([float(of_article) for _, told in rows for of_article in told]))


def main_text(page: str | None, tree: Tree) -> str:
    blocks = blocks_of(page or "")
    rows = features_of(blocks).tolist()
    return "\n".join(b.text for b, row in zip(blocks, rows, strict=True) if tree.says(row))


def _extract(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py(), tree) for page in batch.column("_html")]
        at = batch.schema.get_field_index("_html")
        rest = batch.remove_column(at)
        names = [*rest.schema.names, "text", "n_chars"]
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names)


def extract(pages: DataFrame, html_column: str = "html", keep: Sequence[str] = ("page_id", "url"), labelled: Sequence[str] = LABELLED_PAGES) -> DataFrame:
    """(keep..., text, n_chars) per row of ``pages``: the article's blocks in page order, one per line.

    One pass without a shuffle; a page is read whole, by one task.  A null or empty page has
    the empty text; null keys, repeated rows and an empty table come through as they are;
    columns that are not in ``keep`` are ignored.
    """
    source = pages.select(*(F.col(c) for c in keep), F.col(html_column).cast("string").alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_html")
    return source.mapInArrow(partial(_extract, tree=trained_tree(labelled)), f"{fields}, text string, n_chars bigint")
