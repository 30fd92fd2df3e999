"""HTML extraction: two-pass block rules.

A page is cut into text blocks at block-level tags. The first pass decides a
block by where it stands and by its density. Blocks inside navigation, forms,
footers, asides and containers named as adverts, notices, sidebars or comments
are boilerplate. All other blocks inside the article are content, links and
lists too, whatever their density. Outside it, also on pages that have one,
blocks made of links are boilerplate, long blocks with a fair share of stop words
are content, and long ones without are boilerplate, unless they are written in
sentences: these stay open, as short blocks do. On pages of a language that the
list of stop words doesn't serve (hardly any in all long blocks), length and link
density alone decide. In the second pass an open block inherits the label of its
nearest decided neighbours: content if both sides are content, else the label of
the nearer one, the one before it where both are as near. A heading goes with
what follows it. On a page where nothing is decided all blocks are content.

Cases: null html equals an empty page; pages without content give an empty
text. Repeated rows are extracted each. Ties between neighbours go to the one
before. Unclosed tags, comments and scripts end with the page. An empty table
gives no rows. Very long pages are read whole, in linear time. Columns other than
page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_or_empty

# fixed values: tag names of HTML
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
HIDDEN_TAGS = frozenset("script style noscript template svg annotation annotation-xml iframe object canvas head title textarea select button".split())
RAW_TAGS = frozenset("script style textarea title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog".split())
GOOD_TAGS = frozenset("article main".split())
# words in class, id and role that name what isn't the article: the first list
# wherever they stand in a name, the second where the rest of the name, too, is
# of these lists (related-articles, but not related-work)
BAD_NAMES = frozenset("advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies gdpr sidebar navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar disqus newsletter pagination pager adslot adbox adsense complementary contentinfo".split())
WEAK_NAMES = frozenset("ad ads consent notice notices alert popup modal overlay side aside widget widgets nav menu header comment comments reply replies respond related recommended share sharing social subscribe subscription signup login search skip".split())
LAYOUT_NAMES = frozenset("area articles bar block body box button buttons container content form global group holder icons inner item items js left link links list main message module outer page panel posts primary right secondary section site slot stories text title top unit wrap wrapper".split())
# words that make a name one of the page's layout
PAGE_NAMES = frozenset("with has no without layout".split())
# common function words of the languages served
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he in is it its of on or that the this to was were which will with not but they you his her "
    "der die das und ist in zu den von mit nicht ein eine einen einer auf für im dem des sich auch als an es bei aus nach "
    "le la les de des du et est un une en que qui dans pour pas par sur au aux avec ce il elle ne se son sa ou "
    "el los las del y es una por para con no se lo su al como más o pero sus ya".split()
)
SHORT, LONG = 70, 200
LINKS_MOST = 0.5
STOP_LEAST = 0.2
#: Under this share of stop words in all its long blocks a page's language isn't served.
SERVED_LEAST = 0.04

_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW_TAGS}
# letters of scripts without spaces, which say as much as several Latin ones
_WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_SENTENCE = re.compile(r"[.!?\u0964\u06d4](?:[\"')\]\u2019\u201d]*\s|$)|[\u3002\uff01\uff1f]")

GOOD, BAD, OPEN = 1, -1, 0


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    place: int  # GOOD inside an article, BAD in boilerplate containers
    heading: bool


def _tag_end(page: str, at: int) -> int:
    """The position of the ``>`` that ends the tag at ``at``; quoted ones don't."""
    while True:
        end = page.find(">", at)
        if end < 0:
            return len(page)
        quote = min((q for q in (page.find('"', at, end), page.find("'", at, end)) if q >= 0), default=-1)
        if quote < 0 or page[quote - 1] not in "= \t\n\r":
            return end
        close = page.find(page[quote], quote + 1)
        if close < 0:
            return end
        at = close + 1


def _bad_name(attributes: str, in_article: bool) -> bool:
    """Whether class, id or role name boilerplate, or the element is hidden. A
    name that tells of a page's layout (with-sidebar) names the whole page; inside
    an article a header is the article's, and a name counts as a whole only."""
    for name, value in _ATTR.findall(attributes):
        low = name.lower()
        if low in ("class", "id", "role"):
            for token in value.strip("\"'").split():
                parts = {p.lower() for p in _PARTS.findall(token)}
                if parts & PAGE_NAMES or (in_article and parts & {"header", "masthead"}):
                    continue
                named = parts & BAD_NAMES, parts & WEAK_NAMES
                whole = not parts - BAD_NAMES - WEAK_NAMES - LAYOUT_NAMES
                if (any(named) and whole) or (named[0] and not in_article):
                    return True
        elif low == "hidden" or (low == "style" and "display:none" in value.replace(" ", "").lower()):
            return True
    return False


def _events(page: str):
    """("text", s), ("open", name, attributes), ("close", name)."""
    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:], ""
            return
        if start > at:
            yield "text", page[at:start], ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), start):
            at = _tag_end(page, start) + 1
        else:
            closing = page.startswith("</", start)
            m = _NAME.match(page, start + 1 + closing)
            if not m:  # a bare "<"
                yield "text", "<", ""
                at = start + 1
                continue
            end = _tag_end(page, m.end())
            name, at = m.group().lower(), end + 1
            if closing:
                yield "close", name, ""
                continue
            yield "open", name, page[m.end() : end]
            if name in RAW_TAGS and page[end - 1 : end] != "/":
                close = _RAW_END[name].search(page, at)
                end = close.start() if close else n
                yield "text", page[at:end], ""
                at = end


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # name, place, hidden
    standing: Counter[str] = Counter()  # names in the stack
    text: list[str] = []
    linked = links = 0
    where: tuple[int, bool] = (OPEN, False)

    def flush():
        nonlocal linked
        joined = _SPACE.sub(" ", html_lib.unescape("".join(text))).strip()
        if joined:
            out.append(Block(joined, linked, where[0], where[1]))
        text.clear()
        linked = 0

    for kind, what, attributes in _events(page):
        place, hidden = stack[-1][1:] if stack else (OPEN, False)
        if kind == "text":
            if hidden:
                continue
            if not text:
                where = (place, any(x[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for x in stack[-3:]))
            text.append(what)
            if links:
                linked += len(what.strip())
        elif kind == "open":
            if what in BLOCK_TAGS:
                flush()
            if what in VOID_TAGS or attributes.endswith("/"):
                continue
            if what in ("p", "li", "td", "th", "tr", "dd", "dt", "option") and stack and stack[-1][0] == what:
                standing[stack.pop()[0]] -= 1  # these end where the next one begins
                place, hidden = stack[-1][1:] if stack else (OPEN, False)
            if what in BAD_TAGS or (what not in ("html", "body", *GOOD_TAGS) and _bad_name(attributes, place == GOOD)) or (what == "header" and place != GOOD):
                place = BAD
            elif what in GOOD_TAGS and place != BAD:
                place = GOOD
            stack.append((what, place, hidden or what in HIDDEN_TAGS))
            standing[what] += 1
            links += what == "a"
        else:
            if what in BLOCK_TAGS:
                flush()
            if standing[what]:
                while True:
                    name = stack.pop()[0]
                    standing[name] -= 1
                    links -= name == "a"
                    if name == what:
                        break
    flush()
    return out


def _stops(text: str) -> tuple[int, int]:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words), max(1, len(words))


def stop_density(text: str) -> float:
    n, words = _stops(text)
    return n / words


def weight(text: str) -> int:
    """Length in Latin letters."""
    return len(text) + 2 * len(_WIDE.findall(text))


def served(found: list[Block]) -> bool:
    """Whether the stop words are those of the page's language."""
    counts = [_stops(b.text) for b in found if b.place != BAD and weight(b.text) >= SHORT and b.linked <= LINKS_MOST * len(b.text)]
    return sum(n for n, _ in counts) >= SERVED_LEAST * sum(w for _, w in counts)


def first_pass(b: Block, by_stops: bool = True) -> int:
    if b.place != OPEN:
        return b.place
    if b.linked > LINKS_MOST * len(b.text) or b.text.startswith(("©", "Copyright")):
        return BAD
    size = weight(b.text)
    if size < SHORT or b.heading:
        return OPEN
    if not by_stops:
        return GOOD
    density = stop_density(b.text)
    if density >= STOP_LEAST or (size >= LONG and density >= STOP_LEAST / 2):
        return GOOD
    return OPEN if len(_SENTENCE.findall(b.text)) >= 2 else BAD


def classify(found: list[Block]) -> list[int]:
    by_stops = served(found)
    first = [first_pass(b, by_stops) for b in found]
    n = len(first)
    nowhere = (OPEN, n + 1)  # no decided block on that side
    before, after, last = [nowhere] * n, [nowhere] * n, None
    for i in range(n):
        last = (first[i], i) if first[i] != OPEN else last
        before[i] = (last[0], i - last[1]) if last else nowhere
    last = None
    for i in reversed(range(n)):
        last = (first[i], i) if first[i] != OPEN else last
        after[i] = (last[0], last[1] - i) if last else nowhere
    out = []
    for label, left, right, b in zip(first, before, after, found):
        if label == OPEN:
            nearer = left if left[1] <= right[1] else right
            label = GOOD if b.heading and right[0] == GOOD else nearer[0]
        out.append(label if label != OPEN else GOOD)  # a page of short blocks only
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, classify(found)) if label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", text_or_empty("html").alias("html")).mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
