"""Main text of web pages by line-block distribution.

Markup is stripped into one line per block.  Lines of menus, headers, footers,
sidebars, notices, adverts, forms and comments are taken out; of the others,
lines that are mostly links weigh nothing and the rest weighs its text length.
Lengths are summed over a sliding window of lines: the text begins where the
sums surge and ends where they dive to nothing, and the lines between these
points are kept.

An ``<article>`` element is a weight, not a switch: its lines weigh even where
they are links, and its lines and those outside of any article are weighed
apart.  The heavier side is searched for the text, by the same windows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80
#: A line that never surges is still text if it has so many words or ends like a sentence.
SENTENCE_WORDS = 6

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"""
    r"""<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|(?P<text>[^<]+|<(?![A-Za-z/!?]))""",
    re.DOTALL,
)
_LOOSE = re.compile(r"<(?P<close>/?)(?P<tag>[A-Za-z]?[^\s/>]*)(?P<attrs>[^>]*)>")  # a tag with a quote that never ends
_ATTR = re.compile(r"""([A-Za-z:_-][\w:.-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z0-9]+")

# Fixed values of the HTML language.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead "
    "tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object audio video canvas noframes xmp".split())
DROPPED = frozenset("nav aside footer form button select dialog menu fieldset head".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form".split())
#: Words in class names and ids that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup comment comments disqus respond reply "
    "replies share sharing social related recommended footer masthead pagination pager toolbar widget login search copyright disclaimer "
    "sitenav topbar header".split()
)
#: Words that may stand beside a mark in one name without changing what it says.
BESIDE = frozenset(
    "site page main top bottom left right box bar block blocks container wrapper wrap section list inner outer area item items unit slot post posts user "
    "users reader readers links link buttons button icons icon form panel col column row content global primary secondary small large mobile desktop "
    "the on of by js widget widgets".split()
)
#: Names of elements that hold the text, whatever else they are called.
HOLDERS = frozenset("content article entry story text body articlebody entry-content post-content article-body article-content main-content story-body".split())
_SAYS_NOTICE = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.IGNORECASE)


@dataclass
class Line:
    text: str
    linked: int  # characters within links
    article: int  # number of the outermost article element, 0 outside of any
    dropped: bool = False
    title: bool = False

    @property
    def weight(self) -> int:
        """The text's length; nothing for lines outside of articles that are mostly links."""
        return 0 if not self.article and self.linked * 2 > len(self.text) else len(self.text)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def _is_marked(name: str, in_article: bool) -> bool:
    """A class name or id says that this isn't text: it holds a mark, and no word that says something else."""
    words = {w for w in _NAME.findall(name) if not w.isdigit()}
    marks = words & MARKS
    return bool(marks) and words <= MARKS | BESIDE and (marks != {"header"} or not in_article)


def _is_dropped(tag: str, raw: str, in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not raw.strip() or tag in ("html", "body", "main", "article"):
        return False
    attrs = _attributes(raw)
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", attrs.get("style", "").lower()):
        return True
    names = [*attrs.get("class", "").lower().split(), attrs.get("id", "").lower()]
    return not HOLDERS & set(names) and any(_is_marked(n, in_article) for n in names)


def lines(page: str) -> list[Line]:
    """One line per block with text, in page order."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, whether it or one around it is dropped, within article or main, article
    opened: Counter = Counter()
    articles = 0
    pieces: list[str] = []
    linked, in_link, breaks = 0, 0, 0

    def flush() -> None:
        nonlocal linked, breaks
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            top = stack[-1] if stack else ("", False, False, 0)
            out.append(Line(text, linked, top[3], top[1], top[0] == "h1"))
        linked = breaks = 0

    def close(to: int) -> None:
        for tag, *_ in stack[to:]:
            opened[tag] -= 1
        del stack[to:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at) or _LOOSE.match(page, at)
        if m is None:  # a tag that never ends
            break
        at = m.end()
        tag = m["tag"]
        if tag is None:
            text = m["text"] or m["cdata"]
            if text:
                text = entities.unescape(text) if m["text"] else text
                pieces.append(text)
                if text.strip():
                    breaks = 0
                if in_link:
                    linked += len(" ".join(text.split()))
            continue
        tag = tag.lower()
        if m["close"]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in BLOCKS:
                flush()
                if opened[tag]:
                    to = len(stack) - 1
                    while stack[to][0] != tag:
                        to -= 1
                    close(to)
            continue
        if tag in RAW:
            if m["attrs"].rstrip().endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                pieces.append(" ")
            continue
        if tag == "a":
            in_link = 1
        if tag in BLOCKS:
            flush()
            if stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                close(len(stack) - 1)
            if tag not in VOID:
                _, dropped, within, article = stack[-1] if stack else ("", False, False, 0)
                own = tag == "article" or 'itemprop="articlebody"' in m["attrs"].lower()
                if own and not article:
                    articles += 1
                    article = articles
                within = within or own or tag == "main"
                stack.append((tag, dropped or _is_dropped(tag, m["attrs"], within), within, article))
                opened[tag] += 1
    flush()
    return out


def regions(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(surge, dive) points: from where a window's sum passes the threshold to where it is nothing."""
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    threshold = min(surge, max(sums, default=0) / 2)
    out, start = [], None
    for i in range(n):
        if start is None:
            if sums[i] >= threshold and sums[i] > 0:
                start = i
                while start > 0 and weights[start - 1] > 0 and (not out or start > out[-1][1]):
                    start -= 1  # the text began in lines too short to surge
        elif sums[i] == 0:
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, n))
    return out


def _heaviest(found: list[Line]) -> list[Line]:
    """The lines outside of articles, or those of the articles, whichever hold the largest body of text.

    Where that is an article, the others count too.
    """
    total: Counter = Counter()
    for x in found:
        total[x.article] += x.weight
    if not total:
        return []
    best = max(total, key=lambda k: (total[k], k))
    return [x for x in found if bool(x.article) == bool(best)]


def _reads_as_text(line: Line) -> bool:
    return (line.title or len(line.text.split()) >= SENTENCE_WORDS or line.text[-1] in ".!?…:\"”»") and not _SAYS_NOTICE.match(line.text)


def main_text(page: str | None) -> str:
    """The article's blocks joined by line feeds; empty if there is none."""
    if not page:
        return ""
    own = _heaviest([x for x in lines(page) if not x.dropped])  # removed lines make no gap in the text
    weights = [x.weight for x in own]
    inside = [False] * len(own)
    for a, b in regions(weights):
        inside[a:b] = [True] * (b - a)
    kept = []
    for i, x in enumerate(own):
        if inside[i]:  # a single line of links belongs to the text around it, a list of them doesn't
            alone = 0 < i < len(own) - 1 and weights[i - 1] and weights[i + 1] and inside[i - 1] and inside[i + 1]
            keep = bool(weights[i]) or alone
        else:  # a paragraph behind an inserted list, or a title before one
            keep = bool(weights[i]) and any(inside) and _reads_as_text(x)
        if keep:
            kept.append(x.text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page.

    Null and empty html give an empty text, as does a page without any weighing
    line.  A page without tags is one block.  Unclosed elements end with the
    page; repeated rows come back repeated; a null id or url stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
