"""Main text of HTML pages: flat text blocks, classified by a decision tree over a block and its neighbours.

A page is scanned once into blocks (text between block-level tags). Features are word counts and link densities of a
block and both neighbours, whether it is a heading, and what its containers are called. The tree is grown on a small
labelled table below.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rowwise import struct_column

#: Elements that begin or end a block, elements without content of their own, elements whose content is
#: no text, containers that are not the article, and words in class, id or role that say so (or the opposite).
BLOCK = frozenset("address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object noframes".split())
BAD_ELEMENTS = frozenset("nav footer aside form button select dialog menu head".split())
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner banners cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay newsletter subscribe subscription signup comment comments commentary reply replies respond disqus discussion sidebar side widget widgets related recommended recommendations share sharing social menu menus nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar toolbar login search pagination pager tags tagcloud copyright legal disclaimer skip complementary contentinfo hidden teaser outbrain taboola".split())
GOOD_WORDS = frozenset("article articlebody story storybody post postbody entry content maincontent main".split())
#: Words that make a class speak of something absent or elsewhere: has-sidebar, comment-free.
TURNING = frozenset("has have had no non not without with free hide hidden-on is-not show shows enabled disabled".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start ends an open element of the same kind, if no list or table lies between.
SIBLINGS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}

FEATURES = ("bad", "good", "page", "words", "before", "after", "links", "links_before", "links_after", "heading")
#: Labelled blocks: the features above in that order, then 1 for main text. `page` says whether any block of the page
#: is in a good container. Written by hand.
LABELLED = """
1 0 1  3  0  6 1.0 0.0 1.0 0 0 | 1 0 1 12 6 10 0.0 1.0 0.0 0 0 | 1 0 1 40 3 60 0.0 0.0 0.0 0 0 | 1 1 1 25 80 10 0.0 0.0 0.0 0 0
1 1 1  5 60  0 0.6 0.0 0.0 0 0 | 1 0 0  4  0  5 1.0 0.0 1.0 0 0 | 1 0 0 55 20 70 0.0 0.0 0.0 0 0 | 1 0 0  9 90  0 0.0 0.0 0.0 0 0
1 1 1  1  0  1 0.0 0.0 0.0 0 0 | 1 0 1  8  9  0 0.1 0.0 0.0 0 0 | 1 1 1 90 90 9 0.0 0.0 0.0 1 0 | 1 0 0 18 5 4 0.2 1.0 1.0 0 0
0 1 1 10 12 70 0.0 0.0 0.0 1 1 | 0 1 1 80 10 90 0.0 0.0 0.0 0 1 | 0 1 1 95 80 2 0.02 0.0 0.0 0 1 | 0 1 1 2 90 70 0.0 0.0 0.0 0 1
0 1 1  1  2  1 0.0 0.0 0.0 0 1 | 0 1 1  1  1  0 0.0 0.0 0.0 0 1 | 0 1 1 14 60 8 0.1 0.0 0.0 0 1 | 0 1 1 30 0 0 0.0 0.0 0.0 0 1
0 1 1  5 20 12 0.0 0.0 0.0 1 1 | 0 1 1 45 5 40 0.3 0.0 0.0 0 1 | 0 1 1 20 30 20 0.45 0.1 0.1 0 1 | 0 1 1 3 0 3 0.0 0.0 0.0 0 1
0 1 1  4 60  4 1.0 0.0 1.0 0 0 | 0 1 1  3  4  3 1.0 1.0 1.0 0 0 | 0 1 1  6  5  0 0.9 1.0 0.0 0 0 | 0 1 1 8 40 7 0.85 0.0 0.9 0 0
0 1 1 60 30 50 0.0 1.0 0.0 0 1 | 0 1 1 12 4 80 0.0 1.0 0.0 1 1 | 0 1 1 7 70 10 0.2 0.0 0.0 0 1 | 0 1 1 2 8 0 0.0 0.9 0.0 0 1
0 0 1 12  6 10 0.0 1.0 0.0 0 0 | 0 0 1 50  9 12 0.0 0.0 0.0 0 0 | 0 0 1  4  0  5 1.0 0.0 1.0 0 0 | 0 0 1 16 80 0 0.0 0.0 0.0 0 0
0 0 1  8 60  0 0.0 0.0 0.0 1 0 | 0 0 1 90 30  5 0.1 0.0 0.0 0 0 | 0 0 1  2  1  0 0.0 0.0 0.0 0 0 | 0 0 1 25 2 9 0.5 1.0 0.0 0 0
0 0 0  4  0  5 1.0 0.0 1.0 0 0 | 0 0 0  5  4  6 0.8 1.0 1.0 0 0 | 0 0 0  3  0 12 0.0 0.0 1.0 0 0 | 0 0 0 6 5 4 0.0 1.0 1.0 0 0
0 0 0 60  5 70 0.0 1.0 0.0 0 1 | 0 0 0 70 60 8 0.05 0.0 0.0 0 1 | 0 0 0 30  8 40 0.0 0.0 0.0 0 1 | 0 0 0 22 30 0 0.1 0.0 0.0 0 1
0 0 0 18 50 40 0.2 0.0 0.0 0 1 | 0 0 0  5 60 70 0.0 0.0 0.0 0 1 | 0 0 0  2 40 50 0.0 0.0 0.0 0 1 | 0 0 0 8 4 60 0.0 1.0 0.0 1 1
0 0 0  6 70 50 0.0 0.0 0.0 1 1 | 0 0 0  9 60  3 0.0 0.0 1.0 0 0 | 0 0 0  7  5 60 0.0 1.0 0.0 0 0 | 0 0 0 5 90 0 0.0 0.0 0.0 0 0
0 0 0 25 40  9 0.6 0.0 0.5 0 0 | 0 0 0 40  6  8 0.7 0.9 0.9 0 0 | 0 0 0 11 30 28 0.0 0.0 0.0 0 1 | 0 0 0 12 3 4 0.9 1.0 1.0 0 0
0 1 1 60  0  2 0.0 0.0 1.0 0 1 | 0 1 1 35 40  6 0.1 0.0 1.0 0 1 | 0 1 1  1 30  1 0.0 0.0 1.0 0 1 | 0 1 1 3 1 2 0.0 0.0 1.0 0 1
0 1 1 14  0  1 0.0 0.0 0.9 0 1 | 0 1 1  8 50  3 0.0 0.0 1.0 1 1 | 0 1 1 90 90 12 0.0 0.0 0.6 0 1 | 0 1 1 22 3 30 0.3 1.0 1.0 0 1
0 1 1  6 40  5 1.0 0.0 0.0 0 0 | 0 1 1 12 10 14 0.9 0.8 0.9 0 0 | 0 1 1 25 30  2 0.8 0.0 0.0 0 0 | 0 1 1 2 2 0 1.0 1.0 0.0 0 0
0 0 0 60  0  2 0.0 0.0 1.0 0 1 | 0 0 0 40 30  3 0.1 0.0 1.0 0 1 | 0 0 0 28  6  4 0.0 1.0 1.0 0 1 | 0 0 0 80 70 5 0.0 0.0 0.9 0 1
0 0 0 20  0  3 0.0 0.0 1.0 0 1 | 0 0 0 15 60 40 0.2 0.0 0.0 0 1 | 0 0 0 24  2  1 0.0 1.0 1.0 0 1 | 0 0 0 35 50 7 0.3 0.0 0.6 0 1
0 0 0 30  5  8 0.9 1.0 1.0 0 0 | 0 0 0  4 80  6 0.0 0.0 1.0 0 0 | 0 0 0  8  4  6 0.2 1.0 1.0 0 0 | 0 0 0 22 20 30 0.8 0.1 0.7 0 0
0 0 0 100 0 0 0.0 0.0 0.0 0 1 | 0 0 0 16  0  0 0.0 0.0 0.0 0 1 | 0 0 0  6  0  0 0.0 0.0 0.0 0 0 | 0 0 0 3 4 5 0.0 1.0 0.9 1 0
"""


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    bad: bool = False
    good: bool = False
    heading: bool = False


_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _hints(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether a container says that it isn't, or is, main text. A header within the article is neutral."""
    bad, good = name in BAD_ELEMENTS or (name == "header" and not inside), name in ("article", "main")
    if "=" in attributes or "hidden" in attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values)
            key = key.lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                bad = True
            elif key in ("class", "id", "role", "itemprop"):
                names = {w for part in value.split() if not TURNING & (own := {w.lower() for w in (*_WORD.findall(part), part)}) for w in own}
                bad = bad or bool(names & BAD_WORDS) and name not in ("body", "html", "main") and not (inside and names & BAD_WORDS <= {"header"})
                good = good or bool(names & GOOD_WORDS)
    return bad, good and not bad


def blocks_of(page: str) -> list[Block]:
    """Blocks with text in page order. Markup that isn't closed, and text that is cut off, is taken as far as it goes."""
    out, current = [], Block()
    stack: list[tuple[str, bool, bool]] = []  # open elements with what they and all around them say
    open_now: Counter[str] = Counter()  # so that the stack is searched only for what is on it
    link, at, n = 0, 0, len(page)
    lower = page.lower() if page.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), page)

    def flush() -> None:
        nonlocal current
        if any(not p.isspace() for p in current.parts):
            out.append(current)
        _, bad, good = stack[-1] if stack else ("", False, False)
        current = Block([], [], bad, good, bool(stack) and stack[-1][0] in HEADINGS)

    def pop() -> str:
        tag = stack.pop()[0]
        open_now[tag] -= 1
        return tag

    def text(piece: str) -> None:
        current.parts.append(piece)
        if link:
            current.linked.append(piece)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        if start > at:
            text(page[at:start])
        if lower.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        closing = page.startswith("/", start + 1)
        name = _NAME.match(page, start + 1 + closing)
        if not name:
            if page.startswith(("!", "?", "/"), start + 1):
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            else:  # a lone sign
                text("<")
                at = start + 1
            continue
        tag = name[0].lower()
        end, quote = name.end(), ""
        while end < n and (quote or page[end] != ">"):  # a sign within quotes doesn't end the tag
            c = page[end]
            quote = "" if quote == c else quote if quote else c if c in "\"'" and page[end - 1 : end] == "=" else ""
            end += 1
        attributes, at = page[name.end() : end], min(n, end + 1)
        if tag == "br":
            text(" ")
            continue
        if tag == "a":
            link = 0 if closing else 1
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                close = lower.find(f"</{tag}", at)
                end = page.find(">", close) if close >= 0 else -1
                at = n if end < 0 else end + 1
            if tag in BLOCK:
                flush()
            continue
        if tag not in BLOCK or tag in VOID:
            if tag == "hr":
                flush()
            continue
        if closing:
            if open_now[tag]:
                while pop() != tag:
                    pass
                link = 0
        else:
            if stack and stack[-1][0] in ("p", *HEADINGS):
                pop()  # a block ends an open paragraph
            if tag in SIBLINGS and open_now[tag]:
                around = SIBLINGS[tag].split()
                depth = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag or stack[k][0] in around)
                if stack[depth][0] == tag:
                    while len(stack) > depth:
                        pop()
            _, bad, good = stack[-1] if stack else ("", False, False)
            own_bad, own_good = _hints(tag, attributes, good)
            stack.append((tag, bad or own_bad, good or own_good))
            open_now[tag] += 1
            link = 0
        flush()
    flush()
    return out


def clean(block: Block) -> str:
    return " ".join(html.unescape("".join(block.parts)).split())


def features(blocks: list[Block], texts: list[str]) -> np.ndarray:
    words = np.array([len(t.split()) for t in texts], float)
    linked = np.array([len(html.unescape(" ".join(b.linked)).split()) for b in blocks], float)
    links = np.minimum(linked / np.maximum(words, 1), 1)
    good = np.array([b.good and not b.bad for b in blocks], float)
    shift = lambda x, k: np.concatenate([x[1:], [0]]) if k > 0 else np.concatenate([[0], x[:-1]])
    page = np.full(len(blocks), float(good.any()))
    return np.stack([np.array([b.bad for b in blocks], float), good, page, words, shift(words, -1), shift(words, 1), links, shift(links, -1), shift(links, 1), np.array([b.heading for b in blocks], float)], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A tree by Gini impurity: (feature, threshold, tree up to it, tree above it) or a label. Ties: the first split."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return (int(share >= 0.5),)
    best = (2 * share * (1 - share) - 1e-9, None, None)
    for f in range(x.shape[1]):
        for t in (lambda v: (v[1:] + v[:-1]) / 2)(np.unique(x[:, f])):
            low = x[:, f] <= t
            impurity = sum(m.mean() * 2 * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
            if impurity < best[0] - 1e-12:
                best = (impurity, f, t)
    if best[1] is None:
        return (int(share >= 0.5),)
    low = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def decide(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    low = x[:, tree[0]] <= tree[1]
    out = np.zeros(len(x), int)
    out[low], out[~low] = decide(tree[2], x[low]), decide(tree[3], x[~low])
    return out


@cache
def default_tree() -> tuple:
    rows = np.array([[float(v) for v in row.split()] for line in LABELLED.strip().splitlines() for row in line.split("|")])
    return grow(rows[:, :-1], rows[:, -1])


def main_text(page: str | None, tree: tuple | None = None) -> tuple[str, int, int]:
    """The text, and how many blocks were kept and found."""
    blocks = blocks_of(page or "")
    pairs = [(b, t) for b, t in zip(blocks, map(clean, blocks)) if t]
    if not pairs:
        return "", 0, 0
    keep = decide(tree or default_tree(), features([b for b, _ in pairs], [t for _, t in pairs]))
    kept = [t for (_, t), k in zip(pairs, keep) if k]
    return "\n\n".join(kept), len(kept), len(pairs)


def extracted(page: Column) -> Column:
    def work(pages: list[bytes | None]) -> list:
        rows = [main_text((p or b"").decode()) for p in pages]
        return [[r[0] for r in rows], [len(r[0]) for r in rows], [r[1] for r in rows], [r[2] for r in rows]]

    return struct_column(work, "text string, n_chars bigint, n_blocks bigint, n_found bigint", page)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks (kept) and n_found of every row. A null page counts as empty and has no text;
    repeated rows come back as often as they came, an empty table gives none, other columns are ignored."""
    return pages.select("page_id", "url", extracted(F.col("html")).alias("_r")).select("page_id", "url", "_r.*")
