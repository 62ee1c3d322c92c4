"""Main text of HTML pages.

The standard library's parser streams events; each block of text becomes a line with
the number of tags before it and the letters of it that are in links.  A line's ratio is
its letters outside links by its tags.  Ratios are smoothed by a Gaussian within their
region (article, or else main part, or else container); lines at or above a threshold
are in a cluster.  Clusters decide twice: a region is content if it holds one, and
inside it a run of lines made of links is content if its smoothed ratios reach the
threshold on the mean, as a linked paragraph between paragraphs does and a menu does
not.  Everything else of a chosen region is returned, short lines included.  Tags, roles
and classes are evidence beforehand: what they name as menu, header, footer, sidebar,
notice, advert, form, script, style, hidden part or reader comments is no line.  A class
counts only as a whole: ``ad`` and ``ad-slot`` do, ``ad-free`` and ``article-header`` do
not.

Defined cases: a null html is the empty page, whose text is empty; markup cut off
anywhere, and end tags of nothing, are read as far as they go; a line break is white
space of its block; equal ratios are alike, as only the threshold compares them; a very
long page is one page, in time linear in its tags; rows that repeat a page, or lack an
id, are extracted one by one; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that hold no content of the page's article.
OUTSIDE = frozenset(
    "head title script style noscript template nav header footer aside form button select textarea option "
    "iframe object svg canvas audio video menu dialog".split()
)
#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag counts only inside the block that they began in.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that begin and end a block; all others, unknown ones too, stand inside the block that they are in.
BLOCKS = frozenset(
    "address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre "
    "search section summary table tbody td tfoot th thead title tr ul xmp".split()
)
#: Roles that mark an element as no content.
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu".split())
#: Classes and ids that mark an element as no content, alone or with the words of ``AROUND``.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsbox sponsor sponsored promo promoted banner sidebar nav navbar "
    "navigation menu breadcrumb breadcrumbs header footer comment comments disqus respond cookie cookies consent notice "
    "notices gdpr newsletter subscribe signup share sharing social related popup modal overlay pagination pager".split()
)
#: Words that tell no more than where or how a marked part stands.
AROUND = frozenset(
    "site top bottom left right global primary secondary list box bar container wrapper wrap area block buttons button "
    "links link unit slot widget form posts post body inner outer row panel text".split()
)
#: Parts that stay marked whatever stands in them.
_REPLIES = frozenset("comment comments disqus respond".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_GROUPS = frozenset("div section td main article ul ol dl table".split())


@dataclass(slots=True)
class Line:
    """A block of text: the tags since the block before, the letters in links, its article, main part and container."""

    text: str
    tags: int
    linked: int
    article: int
    main: int
    container: int


def _names_furniture(value: str) -> str | None:
    """The marked word of a class or id that consists of such words alone."""
    for word in value.split():
        parts = [x for x in re.split(r"[-_]+", _CAMEL.sub("-", word).lower()) if x]
        marked = [x for x in parts if x in MARKED]
        if marked and all(x in MARKED or x in AROUND or x.isdigit() for x in parts):
            return marked[0]
    return None


def _mark(tag: str, attrs: list[tuple[str, str | None]]) -> str | None:
    """Why an element's attributes say that it is no content, if they do."""
    for name, value in attrs:
        if name == "hidden":
            return name
        if not value:
            continue
        if name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return name
        if name == "style" and _HIDDEN.search(value):
            return name
        if name in ("class", "id") and tag not in ("body", "html", "main"):
            if (found := _names_furniture(value)) and (tag != "article" or found in _REPLIES):
                return found
    return None


class PageLines(HTMLParser):
    """Parser events turned into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self._open: list[str] = []  # elements that are open
        self._places: dict[str, list[int]] = {}  # where in it each tag stands
        self._blocks: list[int] = []  # where in it blocks stand
        self._outside: int | None = None  # how deep the outermost open element without content is
        self._lifted = False  # whether an article in it is content all the same
        self._article = self._main = 0
        self._groups = [0]
        self._count = 0
        self._parts: list[str] = []
        self._tags = self._linked = 0

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.lines.append(Line(text, self._tags, self._linked, self._article, self._main, self._groups[-1]))
                self._tags = 0
            self._parts.clear()
        self._linked = 0

    def _close(self, depth: int) -> None:
        """Close the open elements from ``depth`` on."""
        for at in range(len(self._open) - 1, depth - 1, -1):
            tag = self._open.pop()
            self._places[tag].pop()
            if self._outside == at:
                self._outside = None
            if tag in BLOCKS:
                self._blocks.pop()
                self._flush()
            if tag == "article" and not self._places[tag]:
                self._article = 0
            elif tag == "main" and not self._places[tag]:
                self._main = 0
            if tag in _GROUPS:
                self._groups.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag == "br":
            self._parts.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        if tag in BLOCKS:
            self._flush()
            if self._blocks:
                there = self._open[self._blocks[-1]]
                if there == "p" or there == tag and tag in ("li", "dt", "dd", "tr", "td", "th"):
                    self._close(self._blocks[-1])
        first_article = tag == "article" and not self._article
        if self._outside is None:
            mark = _mark(tag, attrs) if attrs else None
            if mark or tag in OUTSIDE or tag == "article" and not first_article:
                self._outside = len(self._open)
                self._lifted = mark in MARKED and mark not in _REPLIES and tag not in OUTSIDE
        elif self._lifted and (first_article or tag == "main" and not self._main) and not (attrs and _mark(tag, attrs)):
            self._outside = None  # a class does not empty the page around its article
        self._places.setdefault(tag, []).append(len(self._open))
        if tag in BLOCKS:
            self._blocks.append(len(self._open))
        self._open.append(tag)
        self._count += 1
        if first_article:
            self._article = self._count
        elif tag == "main" and not self._main:
            self._main = self._count
        if tag in _GROUPS:
            self._groups.append(self._count)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag == "br":
            self._parts.append(" ")
            return
        places = self._places.get(tag)
        if places and (tag not in INLINE or not self._blocks or self._blocks[-1] < places[-1]):
            self._close(places[-1])

    def handle_data(self, data: str) -> None:
        if self._outside is None:
            self._parts.append(data)
            if self._places.get("a"):
                self._linked += len("".join(data.split()))

    def finish(self) -> list[Line]:
        """The lines, once all of the page is fed."""
        self.close()
        self._flush()
        return self.lines


def letters(line: Line) -> int:
    """Characters of a line that are not white space."""
    return len(line.text) - line.text.count(" ")


def smoothed_ratios(ratios: list[float], regions: list[int], sigma: float = 1.0) -> list[float]:
    """Each ratio smoothed by a Gaussian of ``sigma`` lines over its neighbours in the same region."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    out = []
    for i, region in enumerate(regions):
        near = [j for j in range(max(0, i - reach), min(len(ratios), i + reach + 1)) if regions[j] == region]
        weights = [kernel[j - i + reach] for j in near]
        out.append(sum(w * ratios[j] for w, j in zip(weights, near, strict=True)) / sum(weights))
    return out


def content_lines(lines: list[Line], sigma: float = 1.0, threshold: float = 0.5) -> list[Line]:
    """The lines of the regions that the clusters of high ratio select.

    A line is in a cluster if its smoothed ratio is at least ``threshold`` times the mean
    of all ratios that compete: those of lines in articles, or else in main parts, or else
    of all lines.  A run of lines of which half the letters or more are links, in one
    container, goes with its mean.
    """
    for place in ("article", "main"):
        if inside := [x for x in lines if getattr(x, place)]:
            break
    else:
        place, inside = "container", lines
    if not inside:
        return []
    regions = [getattr(x, place) for x in inside]
    ratios = [max(0, letters(x) - x.linked) / max(1, x.tags) for x in inside]
    smooth = smoothed_ratios(ratios, regions, sigma)
    least = threshold * sum(ratios) / len(ratios)
    chosen = {r for r, value in zip(regions, smooth, strict=True) if value >= least}
    out, at = [], 0
    while at < len(inside):
        kind = regions[at], inside[at].container, 2 * inside[at].linked >= letters(inside[at])
        end = at + 1
        while end < len(inside) and (regions[end], inside[end].container, 2 * inside[end].linked >= letters(inside[end])) == kind:
            end += 1
        if kind[0] in chosen and (not kind[2] or sum(smooth[at:end]) >= least * (end - at)):
            out += inside[at:end]
        at = end
    return out


def main_text(html: str | None, sigma: float = 1.0, threshold: float = 0.5) -> str:
    """The main text of a page: its blocks, one a line."""
    parser = PageLines()
    parser.feed(html or "")
    return "\n".join(x.text for x in content_lines(parser.finish(), sigma, threshold))


def extract_pages(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0, threshold: float = 0.5
) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(cell.as_py(), sigma, threshold) for cell in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    schema = T.StructType(
        [
            T.StructField("page_id", pages.schema[id_col].dataType),
            T.StructField("url", pages.schema[url_col].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, schema)
