"""HTML extraction by line-block distribution.

Markup is read once, front to back, and stripped to lines, one for each block of the page. A line's length is the
number of its code points, less those within links; structure only weighs it: what the markup says is no article
text (navigation, page header and footer, sidebar, form, advert, notice, reader comments, hidden) weighs nothing, and
text outside the container of the article less than text in it. That container is the article or main element if the page has one, else
the innermost division that holds `HOLDS` of the length of all lines.

The weighted lengths of the `WINDOW` lines around each line are summed. The page's own distribution of these sums
gives the threshold: `SHARE` of the sum of the windows that the median code point lies in. A surge point is where the
sums reach the threshold, a dive point where they fall below it or to nothing; the lines between are the text, without
short lines at either end that only reach it by their neighbours. Lines of the article's container stand `threshold`
higher, so that short paragraphs and headings stay.

Character references are decoded, white space within a block becomes one space, blocks are trimmed and joined by one
space in page order. Tags that never end reach to the end of the page, as in browsers; elements that are
closed by a slash end there unless an end tag of their own follows. Null html is an empty page; a page without text has
an empty result. Pages of any length are read whole, in time linear in it. Repeated rows are independent; only the id,
url and html columns are read.
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
#: Of the typical sum, what a surge reaches; of all length, what the article's container holds.
SHARE, HOLDS = 0.3, 0.7
#: Weights of lines outside the container: of an article or main element, and of one that was found by length.
OUTSIDE_ELEMENT, OUTSIDE_FOUND = 0.25, 0.5
#: Weight of link text in headings.
HEADING_LINKS = 0.5

_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_END = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')|=\s*["']|>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""")
_COMMENT_END = re.compile(r"--!?>")

#: Elements whose content is no markup; it goes.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that end by themselves; the other ones are followed until they are closed.
LOOSE = frozenset("p li dd dt hr h1 h2 h3 h4 h5 h6 td th tr body html thead tbody tfoot caption legend figcaption summary".split())
_BEFORE_BLOCK = frozenset("p div ul ol section article table".split())
#: Containers that part a page; lists, quotes and tables belong to what is around them.
SECTIONS = frozenset("div section article main aside nav header footer form center dialog details".split())
#: Elements that hold no article text.
ASIDE = frozenset("nav header footer aside form button dialog menu label input noscript template select object svg math video audio canvas datalist".split())
#: Of these, those that an article within shows to be left open or to be around the page.
_AROUND = frozenset("nav header form label button dialog menu noscript select object".split())
#: Class, id and role names, whole or up to or from a hyphen or underscore, of what holds no article text wherever it is.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav navbar navigation breadcrumb "
    "breadcrumbs cookie cookies consent newsletter subscribe subscription comments disqus pagination contentinfo complementary".split()
)
#: Words that may follow such a name after a hyphen: 'ad-slot' is one of these names, 'ad-hoc' and 'promo-free' are not.
_PARTS = frozenset(
    "area banner bar block body bottom box button center column container content count footer form frame group header icon inner item items label left "
    "line link links list main menu message modal notice outer panel popup primary rail right row section sidebar signup slot space strip text thread title top "
    "trail unit widget wrap wrapper zone".split()
)
#: The same as MARKS, whole or at the begin, outside an article or main element only; within one their links do not count.
OUTER_MARKS = frozenset(
    "header footer masthead copyright banner menu notice notices alert share sharing social comment related recommended popup modal widget "
    "toolbar login signup search".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass(slots=True)
class Line:
    text: str
    linked: int  # code points within links
    section: int
    article: bool  # within an article or main element
    excluded: bool
    heading: bool
    doubtful: bool  # under a name that may mean no article text
    form: bool  # excluded by a form alone

    def length(self) -> float:
        if self.excluded:
            return 0.0
        if self.article and not self.doubtful:
            return float(len(self.text))
        return max(0.0, len(self.text) - self.linked * (HEADING_LINKS if self.heading else 1.0))


def _names(attributes: str) -> tuple[list[str], bool]:
    """Names of class, id and role, and whether the element is hidden."""
    names, hidden = [], False
    for found in _ATTRIBUTE.finditer(attributes):
        name, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if name in ("class", "id", "role"):
            names += value.lower().split()
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.lower().replace(" ", "")):
            hidden = True
    return names, hidden


def _marked(names: list[str]) -> tuple[bool, bool]:
    """Whether a name marks what is no article text, and whether one does so outside an article."""
    sure = doubtful = False
    for name in names:
        parts = re.split(r"[-_]+", name)
        sure |= parts[0] in MARKS and all(p in _PARTS or p in MARKS or not p.isalpha() for p in parts[1:])
        sure |= parts[-1] in MARKS and parts[0] not in ("has", "no", "with", "without")
        doubtful |= name in OUTER_MARKS or (len(parts) > 1 and parts[0] in OUTER_MARKS) or (len(parts) > 1 and parts[-1] in OUTER_MARKS)
    return sure, doubtful


class _Ends:
    """Where the next end tag and the next tag of an element are; asked from front to back, so every page is searched once."""

    def __init__(self, page: str):
        self.page, self.known = page.lower(), {}
        if len(self.page) != len(page):  # a few letters have longer lower-case forms
            self.page = "".join(c.lower() if c.isascii() else c for c in page)

    def after(self, mark: str, at: int) -> int:
        found = self.known.get(mark, -2)
        if found != -1 and found < at:
            found = self.known[mark] = self.page.find(mark, at)
        return found


def lines_of(page: str) -> tuple[list[Line], list[int]]:
    """The lines in page order, and the parent of each section (the page is section 0; parents come first)."""
    lines: list[Line] = []
    parents = [0]
    # open elements: name, and what the counts below were before it
    stack: list[tuple[str, tuple[int, ...]]] = []
    open_: Counter[str] = Counter()
    pieces: list[str] = []
    links: list[str] = []
    out = inside = doubts = forms = around = section = at = 0
    in_link = heading = False
    ends = _Ends(page)

    def close_line():
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                linked = sum(len(" ".join(entities.unescape(x).split())) for x in links)
                lines.append(Line(text, min(linked, len(text)), section, inside > 0, out > 0 and not (heading and inside and out == open_["header"]), heading, doubts > 0, out == forms > 0))
            pieces.clear()
        links.clear()

    def add(piece: str):
        pieces.append(piece)
        if in_link:
            links.append(piece)

    def pop():
        nonlocal out, around, inside, doubts, forms, section
        name, (out, around, inside, doubts, forms, section) = stack.pop()
        open_[name] -= 1

    while True:
        found = _OPEN.search(page, at)
        start = found.start() if found else len(page)
        if start > at:
            add(page[at:start])
        if not found:
            break
        if page.startswith("<!--", start):
            end = _COMMENT_END.search(page, start + 2)
            at = end.end() if end else len(page)
            continue
        closing = page.startswith("/", start + 1)
        name_at = _NAME.match(page, start + 1 + closing)
        if not name_at:  # a declaration, or a bogus comment
            end = page.find(">", start)
            at = end + 1 if end >= 0 else len(page)
            continue
        name, end = name_at[0].lower(), name_at.end()
        while (mark := _TAG_END.search(page, end)) and mark[0] != ">" and mark[0][-1] in "\"'" and len(mark[0]) > 2 and mark[0].count(mark[0][-1]) == 2:
            end = mark.end()
        if not mark or mark[0] != ">":
            break  # the tag does not end
        attributes, at = page[name_at.end() : mark.start()], mark.end()
        slashed = attributes.endswith("/")
        if name == "br":
            add("\n")
            continue
        if name in RAW:
            if closing:
                continue
            end = ends.after(f"</{name}", at)
            if slashed and (end < 0 or 0 <= ends.after(f"<{name}", at) < end):
                continue
            if end < 0:
                break
            at = end
            close_at = page.find(">", at)
            at = close_at + 1 if close_at >= 0 else len(page)
            continue
        if name == "a":
            in_link = not closing and "href" in attributes.lower()
            continue
        block = name in BLOCKS
        if block:
            close_line()
            in_link = False
            heading = name in _HEADINGS and not closing
            while stack and stack[-1][0] in LOOSE and not closing and (name == stack[-1][0] or name in _BEFORE_BLOCK):
                pop()  # an excluded paragraph ends where the next block begins
        if closing:
            if open_[name] > 0:
                close_line()
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in _VOID or slashed and name not in BLOCKS:
            continue
        names, hidden = _names(attributes) if attributes else ([], False)
        sure, doubtful = _marked(names) if names and name not in ("html", "body", "main") else (False, False)
        article, form = name in ("article", "main"), name == "form"
        if article and names:
            sure, doubtful = any(x in MARKS or x == "comment" for x in names), False
        excludes = name in ASIDE or sure or (hidden and name not in ("html", "body")) or (doubtful and not inside)
        reopened = article and not excludes and out and (name == "main" or out == around)  # left open, or around the whole page
        doubtful &= not excludes
        if excludes or doubtful or (block and name not in LOOSE):
            if excludes and not block:
                close_line()
            stack.append((name, (out, around, inside, doubts, forms, section)))
            open_[name] += 1
            if reopened:
                out = around = forms = 0
            out += excludes
            around += excludes and name in _AROUND
            inside += article and not excludes
            doubts += doubtful
            forms += excludes and form and not (sure or hidden)
            if name in SECTIONS:
                parents.append(section)
                section = len(parents) - 1
    close_line()
    return lines, parents


def window_sums(lengths: list[float], window: int) -> list[float]:
    """Sums of the `window` entries around each one (fewer at the ends)."""
    total = [0.0]
    for x in lengths:
        total.append(total[-1] + x)
    before, after = window // 2, window - window // 2
    n = len(lengths)
    return [total[min(n, i + after)] - total[max(0, i - before)] for i in range(n)]


def threshold_of(lengths: list[float], sums: list[float], share: float = SHARE) -> float:
    """`share` of the sum of the window around the median code point, from long windows to short ones."""
    half, seen = sum(lengths) / 2, 0.0
    for total, length in sorted(zip(sums, lengths), reverse=True):
        seen += length
        if seen >= half:
            return share * total
    return 0.0


def main_text(page: str) -> str:
    lines, parents = lines_of(page)
    if not any(line.length() for line in lines):
        # a form around the whole page
        for line in lines:
            line.excluded &= not line.form
    lengths = [line.length() for line in lines]
    elements = any(line.article and not line.excluded for line in lines)
    if elements:
        own = [line.article for line in lines]
    else:
        held = [0.0] * len(parents)
        for line, x in zip(lines, lengths):
            held[line.section] += x
        for i in range(len(parents) - 1, 0, -1):
            held[parents[i]] += held[i]
        container = max((i for i, x in enumerate(held) if x >= HOLDS * held[0]), default=0)
        own = [line.section == container for line in lines]
        below = [i == container for i in range(len(parents))]
        for i in range(1, len(parents)):
            below[i] |= below[parents[i]]
    outside = OUTSIDE_ELEMENT if elements else OUTSIDE_FOUND
    weighted = [x * (1.0 if line.article or (not elements and below[line.section]) else outside) for line, x in zip(lines, lengths)]
    sums = window_sums(weighted, WINDOW)
    threshold = threshold_of(weighted, sums)
    kept: list[int] = []
    run: list[int] = []
    for i in range(len(lines) + 1):
        if i < len(lines) and sums[i] > 0 and sums[i] + (threshold if own[i] else 0.0) >= threshold:
            run.append(i)  # after a surge point
            continue
        # a dive point
        firm = [k for k, j in enumerate(run) if own[j] or weighted[j] * WINDOW >= threshold]
        kept += [j for j in run[firm[0] : firm[-1] + 1] if weighted[j] > 0] if firm else []
        run = []
    return " ".join(lines[i].text for i in kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars (code points)."""
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) if h else "" for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {id_type}, url {url_type}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
