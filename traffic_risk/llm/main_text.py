"""Main text of web pages by the maximum-scoring subsequence.

Pasternack and Roth: Extracting article text from the web with maximum subsequence segmentation (2009). A page becomes a
sequence of tags and blocks of words. Words score positive, tags negative; the weights are learned from labelled pages,
those that mark their content by one article or main element: a tag costs the more, the more often it occurs
outside of content, among the tags there, than inside. Words inside menus, page headers, footers, sidebars, notices, adverts, forms
and comments, which an element's name or its class, id or role tells, score negative. One linear scan finds the
contiguous stretch of largest sum; its blocks, without those parts, are the text.

A block ends where a block-level element starts or ends; inline tags leave no trace, a line break is a blank. Character
references are decoded, then white space becomes one blank. A main element, and an article that stands in a menu, header or form, ends the side part
around it, so pages with unclosed menus or one form around everything keep their article. Scripts, styles, titles and comments of the markup are
skipped unread. Scanning is linear in the page's length also for broken markup.

Defined cases: null and empty pages, and pages without words, have the empty text; of stretches with equal sums the
first, longest one is taken; with no labelled page, all tags cost the same; repeated rows each get a row; an
empty table gives an empty result; only the id, url and html columns are read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traffic_risk.llm.common import map_texts
from traffic_risk.session import ship_package

# Element names by what they do, and words in class, id or role that tell what an element is.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style title textarea template iframe noframes xmp svg math object audio video canvas".split())
APART = frozenset("nav aside footer form menu dialog button select label noscript".split())
WHOLE = frozenset("html body main article".split())
"""Never taken for a side part by a class name."""
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense banner banners breadcrumb breadcrumbs comment "
    "comments commentlist consent cookie cookies disqus footer gdpr header masthead menu menus modal nav navbar navigation "
    "newsletter notice notices notification notifications pagination popup promo promos promotion related share sharing "
    "sidebar sidebars social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets "
    "complementary contentinfo search alert disclaimer".split()
)
STRONG = frozenset("advert adverts advertisement advertisements adsense comment comments commentlist cookie cookies disqus gdpr newsletter sponsored".split())
"""Hints that tell what an element is whatever follows them in a class name."""
AROUND = frozenset(
    "area bar block bottom box button buttons column container content count field fields form frame group holder icon icons inner item items left link "
    "links list outer panel primary right row secondary section slot text title top unit wrap wrapper".split()
)
"""Words that may follow any hint in a class name."""
NEGATED = frozenset("content has hidden hide layout main no not show toggle with without".split())
"""Before a hint they speak of the layout around it."""
TITLED = frozenset("article blog entry news post story".split())
"""A header of these holds the title."""
LEFT_OPEN = frozenset("aside form header menu nav".split())
"""Side parts that count as plain elements if no tag closes them; a footer that is left open ends with the page."""
LEADING = frozenset("nav navbar navigation menu menus header masthead topbar toolbar form".split())
"""Side parts that an article inside is no part of; they were left open, or hold the whole page."""
CONTENT = ("article", "main")

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^"'<>]++|"[^"<]*+"|'[^'<]*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<rest2>[^<>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in UNREAD}
PAGE, LINK, SIDE = 0, 1, 2
"""Where words are: plain, in a link, in a side part."""


@dataclass(frozen=True)
class Weights:
    """Words' worth of every tag, and the score of a word by where it is."""

    tags: dict[str, float]
    other: float = 1.0
    side: float = 0.1
    """Of a tag that belongs to a side part; its words count against the stretch already."""
    words: tuple[float, float, float] = (1.0, 0.5, -1.0)


@dataclass(frozen=True)
class MainTextParams:
    fit_pages: int = 5000
    """Expected number of labelled pages the weights are learned from, taken by a hash of the page."""
    base: float = 0.1
    """Least cost of a tag, in words."""
    scale: float = 4.0
    most: float = 6.0
    """Largest log ratio that counts."""


def hint_of(names: str, inside_content: bool = False) -> str:
    """The hint in a class, id or role that makes its element a side part, or nothing.

    A name of several words has to end with the hint, but for words that only say where or what container it is, and may not
    start with a word like has or no.
    """
    for name in names.split():
        parts = [w.lower() for w in _WORDS.findall(name)]
        for i, part in enumerate(parts):
            if part not in HINTS or not NEGATED.isdisjoint(parts[:i]):
                continue
            if part == "header" and (inside_content or not TITLED.isdisjoint(parts[:i])):
                continue
            if part in STRONG or all(w in AROUND or w in HINTS or w.isdigit() for w in parts[i + 1 :]):
                return part
    return ""


def hint_of_rest(rest: str) -> str:
    """The hint in the attributes of a tag, if any."""
    return next(filter(None, (hint_of(m[1] or m[2] or m[3] or "") for m in _NAMED.finditer(rest))), "")


def _side_of(name: str, rest: str, inside_content: bool) -> str:
    """Why an element is a side part: its name or a hint; nothing if it is none."""
    if name in APART or name == "header" and not inside_content:
        return name
    if name in WHOLE or name == "header" or not rest:
        return ""
    return next(filter(None, (hint_of(m[1] or m[2] or m[3] or "", inside_content) for m in _NAMED.finditer(rest))), "")


def parse(page: str) -> list[tuple[str, str, int, int, bool]]:
    """Events in page order: (tag name, "", 0, where, in content) or ("", block text, words, where, in content).

    A part of a block that is in a link or a side part is a block of words of its own kind, with the same text run on: parts
    carry a leading blank if there is white space before them. Forms are no side parts of a page that has most of its words in them.
    """
    events, in_forms = _parse(page, True)
    if 2 * in_forms > sum(e[2] for e in events):
        events, _ = _parse(page, False)
    return events


def _parse(page: str, forms: bool) -> tuple[list[tuple[str, str, int, int, bool]], int]:
    """The events, and the words in forms if these are side parts."""
    out: list[tuple[str, str, int, int, bool]] = []
    at, link, content, in_forms = 0, 0, 0, 0
    side, nested, why = "", 0, ""
    closed: dict[str, int] = {}

    def text(piece: str) -> None:
        nonlocal in_forms
        piece = html.unescape(piece) if "&" in piece else piece
        words = piece.split()
        if words or piece:
            glued = ("" if piece[:1].strip() else " ") + " ".join(words) + ("" if not words or piece[-1:].strip() else " ")
            out.append(("", glued, len(words), SIDE if side else LINK if link else PAGE, content > 0))
            in_forms += len(words) if why == "form" else 0

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        end, rest = m["end"] or m["end2"], m["rest"] or m["rest2"] or ""
        if not end and name in UNREAD and not rest.endswith("/"):
            close = _CLOSE[name].search(page, at)
            at = close.end() if close else size
            continue
        if side in ("p", "li") and not nested and (name in BLOCKS) and (not end or name != side):
            side = why = ""  # these end by themselves where the next block starts
        was = side
        if end:
            if name == side:
                nested -= 1
                if nested < 0:
                    side, nested, why = "", 0, ""
            elif name == "a":
                link = max(0, link - 1)
            if name in CONTENT:
                content = max(0, content - 1)
        else:
            if side and (name == "main" or name == "article" and why in LEADING and not hint_of_rest(rest)):
                side, nested, why = "", 0, ""
            if side:
                nested += name == side and name not in VOID
            elif name not in VOID and (found := _side_of(name, rest, content > 0)):
                if found == name in LEFT_OPEN:
                    if name not in closed:
                        closed[name] = max((c.start() for c in re.finditer(f"</{name}", page, re.I)), default=-1)
                    if closed[name] < at:
                        found = ""  # never closed: no telling where it ends
                if found and (forms or name != "form"):
                    side, nested, why = name, 0, found
            if name == "a":
                link = 1  # links do not nest
            if name in CONTENT:
                content += 1
        if name in BLOCKS and link:
            link = 0
        out.append((name, "", 0, SIDE if side or was and end else PAGE, content > 0))
    return out, in_forms


def best_stretch(scores: Sequence[float]) -> tuple[int, int]:
    """First and one past the last place of the largest sum; empty if none is above zero."""
    best, first, stop = 0.0, 0, 0
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, first, stop = total, start, i + 1
    return first, stop


def extract(page: str, weights: Weights) -> str:
    """The main text of one page."""
    events = parse(page)
    get, other, words = weights.tags.get, weights.other, weights.words
    scores = [
        n * words[where] if not name else -get(name, other) if where != SIDE else -weights.side
        for name, _, n, where, _ in events
    ]
    first, stop = best_stretch(scores)
    blocks, now = [], []
    for name, piece, _, where, _ in events[first:stop]:
        if not name:
            if where != SIDE:
                now.append(piece)
        elif name in BLOCKS:
            blocks.append("".join(now))
            now = []
        elif name == "br":
            now.append(" ")
    blocks.append("".join(now))
    joined = (" ".join(b.split()) for b in blocks)
    return "\n".join(b for b in joined if b)


def fit(pages: DataFrame, html_col: str, params: MainTextParams = MainTextParams()) -> Weights:
    """Weights from pages with one article or main element. Known tag names only, so the model has a fixed size."""
    ship_package(pages.sparkSession)
    known = BLOCKS | VOID | frozenset("a abbr b big cite code em font i ins mark q s small span strong sub sup tt u".split())
    marked = pages.select(F.col(html_col).alias("html")).where(F.lower("html").rlike("<(article|main)[\\s>]"))
    share = min(1.0, params.fit_pages / max(marked.count(), 1))
    drawn = marked.where(F.pmod(F.xxhash64("html"), F.lit(1 << 60)) < int(share * (1 << 60)))

    def count(batches):
        found: dict[tuple[str, bool], int] = {}
        for batch in batches:
            for page in batch.column(0).to_pylist():
                events = parse(page)
                if not any(e[4] for e in events):
                    continue
                for name, _, _, _, inside in events:
                    if name:
                        key = (name if name in known else "", inside)
                        found[key] = found.get(key, 0) + 1
        names = [k[0] for k in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([k[1] for k in found], pa.bool_()), pa.array(list(found.values()), pa.int64())],
            ["name", "inside", "n"],
        )

    rows = drawn.mapInArrow(count, "name string, inside boolean, n bigint").groupBy("name", "inside").agg(F.sum("n").alias("n"))
    counts = {(r.name, r.inside): r.n for r in rows.collect()}
    all_in, all_out = (1 + sum(n for (_, inside), n in counts.items() if inside == side) for side in (True, False))
    tags = {}
    for name in {name for name, _ in counts if name}:
        outside = (counts.get((name, False), 0) + 0.5) / all_out
        inside = (counts.get((name, True), 0) + 0.5) / all_in
        tags[name] = params.base + params.scale * min(max(math.log(outside / inside), 0.0), params.most)
    for name in CONTENT:  # the labels themselves are no evidence
        tags[name] = params.base
    return Weights(tags)


def main_texts(
    pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: ``id_col``, ``url_col``, ``text``, ``n_chars``."""

    def run(keys: pa.RecordBatch, texts: list) -> list:
        found = [extract(t, weights) for t in texts]
        return [keys.column(0), keys.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())]

    kinds = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]
    return map_texts(pages, [id_col, url_col], html_col, run, f"{', '.join(kinds)}, text string, n_chars bigint")
