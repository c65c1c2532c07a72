"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Words score +1; a tag scores the log-odds, learned
from labelled pages, that its kind (name and class) stands inside the main text, always
below zero. Words under an element whose kind the labelled pages have outside only score
below zero as well. One linear scan finds the contiguous run of the greatest sum. Parts that
their element or its names mark as standing beside the main text (menus, adverts, forms,
comments ...) are no words of it: their words score nothing, and the run may pass over them.
On a page that labels its own main text, words elsewhere score below zero too.

Labelled pages are those of the given table that mark their own main text by one ``article``
or ``main`` element; counts of tag kinds are taken over all of them, outside the parts beside.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftaudit.llm.common import slices

# Elements of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ASIDE = frozenset("nav aside footer header form menu dialog button select label script style textarea title noscript template iframe svg math head".split())
# Words of class, id and role names that mark parts beside the main text.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside footer masthead topbar toolbar header cookie cookies consent gdpr notice alert popup modal newsletter subscribe "
    "subscription signup share sharing social related recommended comment comments reply replies disqus discussion form search pagination pager "
    "widget contentinfo complementary skip copyright legal login".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<|[^<]+", re.S)
#: Of these, words that inside an article name its own head.
HEAD_NAMES = frozenset(("header", "masthead", "banner"))
_NAMES = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CLOSES = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_SPACES = re.compile(r"[ \t\n\r\f\v\xa0]+")
FRAME = frozenset(("html", "body", "article", "main"))
#: Tag scores lie between these; the page's frame and the borders of its articles have BORDER, tags that the page itself
#: labels as inside LABELLED.
LEAST, MOST, BORDER, LABELLED = -0.05, -4.0, -1000.0, -1e-4
#: Scores of kinds that no labelled page has: links (menus are made of them), blocks, other tags.
UNKNOWN_LINK, UNKNOWN_BLOCK, UNKNOWN = -0.8, -0.3, -0.1
SMOOTH = 0.5


def _marks(rest: str, inside: bool) -> tuple[str, bool]:
    """The first class name of a tag, and whether its names or states mark it as beside the main text.

    ``inside``: the tag stands in an article, where a head is the article's own.
    """
    first, beside = "", False
    for name, *values in _NAMES.findall(rest):
        name, value = name.lower(), "".join(values).lower()
        if name == "class" and value.split():
            first = value.split()[0]
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            beside = True
        elif name == "style":
            beside |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif name in ("class", "id", "role"):
            words = ASIDE_NAMES.intersection(re.split(r"[^a-z0-9]+", value))
            beside |= bool(words - HEAD_NAMES if inside else words)
    return first, beside


class Token:
    """A tag (kind; step +1 opens, -1 closes, 0 neither) or a text, with the number of open elements beside the main text."""

    __slots__ = ("aside", "beside", "kind", "name", "opener", "step", "text")

    def __init__(self, kind: str, name: str, text: str, step: int, aside: bool = False, opener: Token | None = None) -> None:
        self.kind, self.name, self.text, self.step, self.aside, self.opener, self.beside = kind, name, text, step, aside, opener, 0


def tokens(page: str | None) -> list[Token]:
    """The page's tags and texts in order, in one pass; closing tags take the kind of their opener.

    A ``p``, list item or table cell ends where the standard ends it; a closing tag without
    opener stands alone; raw elements (scripts, styles, titles) are one text under their tag.
    An element that only its names put beside the main text, but that holds an ``article`` or
    ``main``, is a frame around it and not beside.
    """
    found: list[Token] = []
    page = page or ""
    stack: list[Token] = []
    named: list[Token] = []  # open elements that only names put beside
    open_names: Counter[str] = Counter()
    at = 0

    def close() -> None:
        opener = stack.pop()
        open_names[opener.name] -= 1
        if named and named[-1] is opener:
            named.pop()
        found.append(Token(opener.kind, opener.name, "", -1, opener=opener))

    while at < len(page):
        match = _TOKEN.match(page, at)
        at = match.end()
        closing, name = match[1], (match[2] or "").lower()
        if not name:
            if match[0][0] != "<" or match[0] == "<":
                found.append(Token("", "", match[0], 0))
            continue
        if closing:
            if name == "p" and not open_names["p"]:
                found.append(Token("p", "p", "", 0))
            elif open_names[name]:
                while stack[-1].name != name:
                    close()
                close()
            continue
        while stack and name in _CLOSES.get(stack[-1].name, ()):
            close()
        inside = open_names["article"] > 0
        first, by_name = _marks(match[3], inside) if match[3] and not match[3].isspace() else ("", False)
        kind = f"{name}.{first}" if first else name
        if name in VOID or match[3].endswith("/"):
            found.append(Token(kind, name, "", 0))
            continue
        by_tag = name in ASIDE and not (name == "header" and inside)
        opener = Token(kind, name, "", 1, by_tag or (by_name and name not in FRAME))
        if name in ("article", "main"):
            for outer in named:
                outer.aside = False
            named.clear()
        elif opener.aside and not by_tag:
            named.append(opener)
        stack.append(opener)
        open_names[name] += 1
        found.append(opener)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
    while stack:
        close()
    beside = 0
    for token in found:
        beside += token.step > 0 and token.aside
        token.beside = beside
        beside -= token.step < 0 and token.opener.aside
    return found


def labelled(found: list[Token]) -> tuple[int, int] | None:
    """The span of the page's only ``article`` (or else ``main``) element not beside; None if the page does not label itself."""
    for name in ("article", "main"):
        at = [i for i, t in enumerate(found) if t.name == name and t.step and not t.beside]
        if len(at) == 2:
            return at[0], at[1]
    return None


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for batch in slices(batches):
        for page in batch["html"].to_pylist():
            found = tokens(page)
            span = labelled(found)
            if span is None:
                continue
            for i, token in enumerate(found):
                if token.kind and not token.beside and token.name not in FRAME:
                    (inside if span[0] < i < span[1] else outside)[token.kind] += 1
    kinds = sorted({*inside, *outside})
    yield pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.string()), pa.array([inside[k] for k in kinds], pa.int64()), pa.array([outside[k] for k in kinds], pa.int64())],
        names=["kind", "inside", "outside"],
    )


def tag_score(inside: int, outside: int) -> float:
    return max(MOST, min(LEAST, math.log((inside + SMOOTH) / (outside + SMOOTH))))


def learn_weights(pages: DataFrame, kinds: int = 4096) -> dict[str, float]:
    """Scores of tag kinds: log((inside + s) / (outside + s)) over all labelled pages, from ``MOST`` to ``LEAST``.

    Counts are summed in the tasks first. Only the ``kinds`` most frequent kinds reach the
    driver: a documented bound of the model; rarer ones score as unknown tags.
    """
    counts = pages.select("html").mapInArrow(_counted, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    rows = counts.orderBy(F.desc(F.col("inside") + F.col("outside")), "kind").limit(kinds).collect()
    return {r["kind"]: tag_score(r["inside"], r["outside"]) for r in rows}


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of the greatest sum, the first of equal ones; empty if none is above zero."""
    best, total, start, span = 0.0, 0.0, 0, (0, 0)
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best run, joined by newlines; parts beside the main text are left out wherever they stand.

    The run is widened to whole texts of its outermost blocks by construction, as a text is
    one token that scores its number of words.
    """
    found = tokens(page)
    span = labelled(found)
    scores, foreign = [], 0  # open elements of kinds that labelled pages have outside
    for i, token in enumerate(found):
        if token.beside:
            scores.append(LEAST if token.kind else 0.0)
        elif token.name in FRAME:
            scores.append(BORDER)
        elif token.kind:
            unknown = UNKNOWN_LINK if token.name == "a" else UNKNOWN_BLOCK if token.name in BLOCK else UNKNOWN
            score = weights.get(token.kind, weights.get(token.name, unknown))
            foreign += token.step * (score <= MOST / 2)
            scores.append(LABELLED if span and span[0] < i < span[1] else score)
        else:
            words = float(len(token.text.split()))
            outside = not span[0] < i < span[1] if span else foreign > 0
            scores.append(-words if outside else words)
    start, end = best_run(scores)
    blocks, block = [], []
    for token in found[start:end]:
        if token.kind:
            if token.name in BLOCK:
                blocks.append("".join(block))
                block = []
            elif token.name in ("br", "img"):
                block.append(" ")
        elif not token.beside:
            block.append(token.text)
    blocks.append("".join(block))
    cleaned = (_SPACES.sub(" ", entities.unescape(b)).strip() for b in blocks)
    return "\n".join(b for b in cleaned if b)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``; weights are learned from the pages themselves unless given.

    The whole html is read, null counts as empty, and text is '' if no run scores above zero.
    Without labelled pages all tags score alike. Repeated rows give repeated results; extra
    columns are not read.
    """
    weights = learn_weights(pages) if weights is None else weights

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(h, weights) for h in batch["html"].to_pylist()]
            arrays = [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    source = pages.selectExpr("cast(page_id as long) page_id", "url", "html")
    return source.mapInArrow(rows, "page_id long, url string, text string, n_chars long")
