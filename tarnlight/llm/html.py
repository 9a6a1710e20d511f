"""Main text of web pages (operator 7).

Method: events of the standard library's streaming HTML parser make lines of
text (one for each block); each line has a text-to-tag ratio, its characters
for each tag that opens in it; the ratios are smoothed by a Gaussian over the
neighbouring lines, inside and outside of marked articles apart, and parted by
a threshold between two clusters.  Lines of
elements that are never main text (menus, headers, footers, sidebars, forms,
scripts, styles, and block elements of any kind, from a paragraph to a table
cell, whose class, id or role calls them an advert, a notice, comments, ...) are
left out before.  A class or id does not count on a
block that holds over half of the page's text and of its lines, unless an
article or main outside it holds a quarter as much.

Content is where the smoothed ratio reaches the threshold.  The mark of an
article or main is one input of it: smoothed ratios inside count ``MARK`` times.
What is kept are whole regions, never single lines by their own ratio.  A
container is kept whole if a line of its own reaches the threshold; otherwise
its own lines and, one by one, its parts: those that reach the threshold, those
between them, and those of the same tag and class.  Lines and parts below the
threshold that are mostly links stay only between content.  A part below the
threshold right behind content stays if all its lines are sentences without
links: the end of an article that goes on in a container of another class.

Character references are decoded; white space inside a block becomes one space;
blocks are joined in page order by an empty line.  Null and empty pages, and
pages without content, give an empty text; an empty table gives an empty one.
Broken markup is read as browsers read it: ``<![`` and ``</`` without a name
begin comments that end at the next ``>``, and a comment or tag that is never
closed takes the rest of the page.  A block element that is not closed ends with
its container.  Pages that repeat have rows of their own; ties are kept, since a
ratio equal to the threshold reaches it; a very long page is read in one pass.
Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.common import slices

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are followed on the stack; an unclosed one ends with what holds it.
HOLDERS = (BLOCKS - {"hr", "html"}) | frozenset("button head iframe noscript object script select style svg template textarea title".split())
#: A start of the first ends an open one of the second, unless one of the third is nearer: the elements whose end may be left out.
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ENDS = (
    {t: (("li",), ("ul", "ol", "menu", "dir")) for t in ("li",)}
    | {t: (("dt", "dd"), ("dl",)) for t in ("dt", "dd")}
    | {t: (("td", "th"), ("tr", "table")) for t in ("td", "th")}
    | {t: (("tr",), ("table",)) for t in ("tr", "thead", "tbody", "tfoot")}
    | {t: (_HEADINGS, ("div", "section", "article")) for t in _HEADINGS}
)
#: So many open elements are looked through for one that ends.
REACH = 8
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("aside button dialog fieldset footer form head iframe menu nav noscript object script search select style svg template textarea title".split())
MARKED = frozenset(("article", "main"))
#: Elements whose text is a region of its own; lists and tables belong to what holds them.
CONTAINERS = MARKED | {"div", "section"}
#: How often the ratio of a line inside an article or main counts.
MARK = 2.0
#: Containers and named holders nested deeper belong to the one at this depth.
DEEPEST = 100
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|signup|sidebars?|side-bar|rail|widget\w*|menus?|nav|navbar|navigation|breadcrumbs?|comments?|commentlist|respond|replies|reviews?|disqus|discussion|share|sharing|social|related|recommend\w*|popup|modal|overlay|login|search|toolbar|pagination|pager|footer|masthead|site-header|page-header|skip-link|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())


#: A line of several words that ends like a sentence and has no sign of rights or trade in it.
_SENTENCE = re.compile(r"^(?!.*[©®™|·»])(?:\S+\s+){3,}\S*[.!?…][\"'”’)\]]*$", re.S)
_COMMENT_END = re.compile("--!?>")


class _Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters inside links
    region: int  # outermost marked container (0: none)
    path: tuple[int, ...]  # containers, from the outermost
    named: tuple[int, ...]  # holders whose class or id calls them no main text


class _Holder(NamedTuple):
    tag: str
    out: bool
    region: int
    path: tuple[int, ...]
    named: tuple[int, ...]


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.stack: list[_Holder] = []
        self.text: list[str] = []
        self.kinds: list[tuple[str, str]] = [("", "")]  # tag and class of each container and named holder
        self.tags = self.linked = 0
        self.link = False

    # The whole page is there, so what has no end here ends with it.
    def parse_starttag(self, i: int) -> int:
        end = self.check_for_whole_start_tag(i)
        if end >= 0 and self.rawdata[end - 1] != ">":  # junk in a tag goes with it
            end = self.rawdata.find(">", end) + 1 or -1
            return end if end >= 0 else len(self.rawdata)
        return super().parse_starttag(i) if end >= 0 else len(self.rawdata)

    def parse_endtag(self, i: int) -> int:
        end = super().parse_endtag(i)
        return end if end >= 0 else len(self.rawdata)

    def parse_comment(self, i: int, report: bool = True) -> int:
        if self.rawdata.startswith((">", "->"), i + 4):
            return self.rawdata.find(">", i) + 1
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_bogus_comment(self, i: int, report: bool = True) -> int:
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        return self.parse_bogus_comment(i)

    def parse_pi(self, i: int) -> int:
        return self.parse_bogus_comment(i)

    def top(self) -> _Holder:
        return self.stack[-1] if self.stack else _Holder("", False, 0, (), ())

    def flush(self) -> None:
        at = self.top()
        text = " ".join("".join(self.text).split())
        if text and not at.out:
            self.lines.append(_Line(text, self.tags, self.linked, at.region, at.path, at.named))
        if text or at.out:
            self.tags = 0
        self.text, self.linked = [], 0

    def end_before(self, tag: str) -> None:
        """End what a start of ``tag`` ends."""
        if self.stack and self.stack[-1].tag == "p" and tag in BLOCKS:
            self.stack.pop()
        closed, kept = ENDS.get(tag, ((), ()))
        for i in range(len(self.stack) - 1, max(-1, len(self.stack) - 1 - REACH), -1):
            if not closed or self.stack[i].tag in kept:
                break
            if self.stack[i].tag in closed:
                del self.stack[i:]
                break

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS or tag in HOLDERS:
            self.flush()
            self.end_before(tag)
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag == "a":
            self.link = True
        if tag in HOLDERS:
            _, out, region, path, named = self.top()
            if not out:
                a = {k: v or "" for k, v in attrs}
                out = tag in NEVER or (tag == "header" and not region) or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES
                calls = tag not in ("body", "main") and bool(NAMED.search(a.get("class", "")) or NAMED.search(a.get("id", "")))
                if not out and (tag in CONTAINERS or calls):
                    new = len(self.kinds)
                    self.kinds.append((tag, a.get("class", "")))
                    path = (*path, new) if tag in CONTAINERS and len(path) < DEEPEST else path
                    named = (*named, new) if calls and len(named) < DEEPEST else named
                    region = region or (new if tag in MARKED else 0)
            self.stack.append(_Holder(tag, out, region, path, named))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag in ("svg", "script", "iframe"):  # closed at once
            self.tags += 1
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in HOLDERS:
            self.flush()
        if tag == "a":
            self.link = False
        if tag in HOLDERS:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].tag == tag:
                    del self.stack[i:]
                    break

    def handle_data(self, data: str) -> None:
        if not self.top().out:
            self.text.append(data)
            self.linked += len(data) if self.link else 0


def _smooth(values: list[float], sigma: float = 1.0, reach: int = 2) -> list[float]:
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[k + reach], values[i + k]) for k in range(-reach, reach + 1) if 0 <= i + k < len(values)]
        out.append(sum(a * b for a, b in near) / sum(a for a, _ in near))
    return out


def _threshold(values: list[float]) -> float:
    """Half way between the means of two clusters; below the smallest value where all are alike."""
    low, high = min(values), max(values)
    if high < 4 * low + 1:
        return low
    for _ in range(20):
        cut = (low + high) / 2
        a, b = [v for v in values if v < cut], [v for v in values if v >= cut]
        new = (sum(a) / len(a) if a else low, sum(b) / len(b) if b else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _unnamed(lines: list[_Line]) -> list[_Line]:
    """The lines outside of named holders, but for holders of over half of the page's text and lines."""
    if not any(x.named for x in lines):
        return lines
    region, size, many = Counter(), Counter(), Counter()
    for x in lines:
        region[x.region] += len(x.text)
        for h in x.named:
            size[h] += len(x.text)
            many[h] += 1
    whole = sum(region.values())
    left_out = {h for h in size if 2 * size[h] <= whole or 2 * many[h] <= len(lines)}
    for h in size.keys() - left_out:
        within = {x.region for x in lines if h in x.named}
        if any(r and r not in within and 4 * n >= size[h] for r, n in region.items()):
            left_out.add(h)
    return [x for x in lines if left_out.isdisjoint(x.named)]


def _region(lines: list[_Line], scores: list[float], kinds: list[tuple[str, str]], some: list[int], depth: int, cut: float) -> set[int]:
    """Of the lines ``some`` of one container, ``depth`` containers deep, those that are kept."""
    while all(len(lines[i].path) > depth for i in some) and len({lines[i].path[depth] for i in some}) == 1:
        depth += 1
    parts: dict[int, list[int]] = {}  # lines of each container inside; 0: own lines
    for i in some:
        parts.setdefault(lines[i].path[depth] if len(lines[i].path) > depth else 0, []).append(i)
    high = {p for p, at in parts.items() if max(scores[i] for i in at) >= cut}
    content = [i for p in high for i in parts[p] if p or scores[i] >= cut]
    first, last = min(content), max(content)
    alike = {kinds[p] for p in high if p}

    def links(at: list[int]) -> bool:
        return 2 * sum(lines[i].linked for i in at) > sum(len(lines[i].text) for i in at)

    def closes(at: list[int]) -> bool:
        """Prose without links right behind content: how an article ends that goes on in a container of its own."""
        return at[0] == last + 1 and not any(lines[i].linked for i in at) and all(_SENTENCE.search(lines[i].text) for i in at)

    kept: set[int] = set()
    for p, at in parts.items():
        if not p:
            kept.update(i for i in at if first <= i <= last or scores[i] >= cut or not links([i]))
        elif p in high:
            kept |= set(at) if 0 in high else _region(lines, scores, kinds, at, depth + 1, cut)
        elif first < at[0] < last or ((0 in high or kinds[p] in alike) and not links(at)) or closes(at):
            kept.update(at)
    return kept


def main_text(page: str | None) -> str:
    """Main text of one page, blocks joined by an empty line."""
    if not page:
        return ""
    parser = _Lines()
    parser.feed(page)
    parser.close()
    parser.flush()
    lines = _unnamed(parser.lines)
    if not lines:
        return ""
    scores = [0.0] * len(lines)
    for r in {x.region for x in lines}:
        at = [i for i, x in enumerate(lines) if x.region == r]
        for i, v in zip(at, _smooth([len(lines[i].text) / max(1, lines[i].tags) for i in at])):
            scores[i] = v * MARK if r else v
    cut = _threshold(scores)
    kept = _region(lines, scores, parser.kinds, list(range(len(lines))), 0, cut)
    return "\n\n".join(x.text for i, x in enumerate(lines) if i in kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = picked.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return picked.mapInArrow(work, schema)
