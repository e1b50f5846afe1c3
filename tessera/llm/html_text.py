"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one per block of the page.  Elements that never hold main text (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, comments) leave lines without weight, and so
do lines whose text is mostly links, outside main elements.  An element is told by its name, its role, or a word of
its class or id: one of ROLES_ALWAYS, alone or together with words that only say where it stands or what it
holds (ad-slot, sidebar-left, commentlist).  Words of ROLES_MAYBE also name ordinary sections: they count only where
the text never surges to SURGE characters in WINDOW lines.  An element that encloses a main element is never left
out, whatever its name, nor is a form or an element with a named role that holds most of a page without one.

The text lengths of WINDOW lines after each line are summed; where the sum surges from nothing the text
begins, and where it dives to nothing it ends.  The stretches between surges and dives are the text: all of
those in main elements, but for main elements made of links, which are teasers; at either end of a main element,
WINDOW or more lines of links are a menu.  If a stretch outside outweighs all main elements OUTWEIGHED times, it is
text too.  There, and on a page without main elements, the text goes from the first stretch to the last of
the innermost container with more than half of it.

A null page counts as empty and gives an empty text.  Broken markup is read once from front to back: a tag
without an end is text, a quote without an end does not hide what follows.  Pages count whole, whatever
their length; equal pages give equal rows, rows that repeat stay.  Columns other than page_id, url and html
are not read, so their names cannot clash.  An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.text import slices

WINDOW = 3
#: Outside main elements, a line whose text is mostly links counts as blank in the distribution.
LINK_SHARE = 0.5
#: So many times the text of all main elements, in one stretch outside, shows that it is text as well.
OUTWEIGHED = 2
#: So many characters outside links and blanks in WINDOW lines are prose, not a box of buttons.
SURGE = 60

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
ENDS = re.compile(r"[\"'>]")
#: Elements whose content is not text of the page.
RAW = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in "script style template noscript textarea svg iframe title canvas".split()}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button select dialog menu head".split())
MAIN = frozenset(("article", "main"))
CELLS = frozenset(("td", "th"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What names an element that holds no main text.
ROLES_ALWAYS = "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs consent cookie cookies disclaimer footer masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion sidebar sponsor sponsored subscribe".split()
#: What may name an ordinary section as well.
ROLES_MAYBE = "recommended related respond share sharing side social toolbar widget".split()
ROLES_COMMENTS = "comment comments disqus replies reply".split()
#: Words beside these that do not change what they say.
PLACES = "area bar block body bottom bottoms box col column container form global group holder inner item items left list main mobile outer page panel primary right row secondary section site slot space strip sub thread top unit wrap wrapper zone".split()
#: Elements that may hold the main text of a page without a main element, if they have several lines.
CONTAINERS = frozenset("html body div section td center".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _named(words: list[str]) -> frozenset[str]:
    """Words, also run together with a place before or behind."""
    return frozenset(w for word in words for w in (word, *(word + p for p in PLACES), *(p + word for p in PLACES)))


_ALWAYS, _MAYBE, _COMMENTS, _HEADER = (_named(w) for w in (ROLES_ALWAYS, ROLES_MAYBE, ROLES_COMMENTS, ["header"]))


def _names(token: str, roles: frozenset[str]) -> bool:
    """Whether a class or id is one of the roles, perhaps with places beside it and hyphens between."""
    parts = [p for p in re.split("[-_]+", token) if p]
    return any(p in roles for p in parts) and all(p in roles or p in PLACES or p.isdigit() for p in parts)


def dropped(name: str, rest: str, within_main: bool) -> str:
    """What tells that an element holds no main text: "element" (name, role), "comments", "words" or "maybe" (class, id)."""
    if name in DROPPED or (name == "header" and not within_main):
        return "element"
    if not rest or name in ("body", "html"):
        return ""
    found = ""
    for key, a, b, c in ATTRIBUTE.findall(rest):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or (key == "role" and value in ROLES) or (key == "aria-hidden" and value == "true"):
            return "element"
        if key in ("class", "id"):
            for token in value.split():
                if _names(token, _COMMENTS):
                    found = "comments"
                elif name not in MAIN and found in ("", "maybe"):
                    if _names(token, _ALWAYS) or (not within_main and _names(token, _HEADER)):
                        found = "words"
                    elif _names(token, _MAYBE):
                        found = "maybe"
    return found


class Tag(NamedTuple):
    """A piece of markup; one without a name is a comment, a declaration or an element with its raw content."""

    start: int
    end: int
    name: str = ""
    close: bool = False
    rest: str = ""


def scan(page: str) -> list[Tag]:
    """The markup of a page, in one pass."""
    found: list[Tag] = []
    at, unclosed, quotes = 0, set(), True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4) + 3
            found.append(Tag(start, end if end > 2 else len(page)))
        elif page.startswith(("<!", "<?"), start):
            end = page.find("]]>", start) + 3 if page.startswith("<![CDATA[", start) and "cdata" not in unclosed else 2
            if end == 2:
                unclosed |= {"cdata"} if page.startswith("<![CDATA[", start) else set()
                end = page.find(">", start) + 1
            if not end:
                break
            found.append(Tag(start, end))
        elif begun := TAG.match(page, start):
            end = _tag_end(page, begun.end()) if quotes else 0
            if not end:  # no end outside quotes: from here on, quotes mean nothing
                quotes = False
                end = page.find(">", begun.end()) + 1
            if not end:
                break
            name, close, rest = begun[2].lower(), bool(begun[1]), page[begun.end() : end - 1]
            shut = RAW[name].search(page, end) if name in RAW and not close and name not in unclosed else None
            if shut:
                found.append(Tag(start, shut.end()))
            elif name in RAW and not close:
                unclosed.add(name)
                found.append(Tag(start, len(page)) if name in ("script", "style") else Tag(start, end, name, close, rest))
            else:
                found.append(Tag(start, end, name, close, rest))
        else:
            at = start + 1
            continue
        at = found[-1].end
    return found


def _tag_end(page: str, at: int) -> int:
    """Behind the first > outside quotes, or 0."""
    while sign := ENDS.search(page, at):
        if sign[0] == ">":
            return sign.end()
        at = page.find(sign[0], sign.end()) + 1
        if not at:
            return 0
    return 0


class Line(NamedTuple):
    """A line, the characters of it in links, the main element or what lies between two, and whether it was left out."""

    text: str
    linked: int
    holder: int
    out: bool = False
    heading: bool = False


class Lines:
    """Lines of a page, and the container that each is in."""

    def __init__(self) -> None:
        self.rows: list[Line] = []
        self.text: list[str] = []
        self.linked = 0
        #: The container of each row, and the one around each container; 0 is the page.
        self.within: list[int] = []
        self.parents = [0]
        self.container = 0

    def end(self, holder: int, out: bool = False, heading: bool = False) -> None:
        line = " ".join(html.unescape("".join(self.text)).split())
        if line:
            self.rows.append(Line(line, self.linked, holder, out, heading))
            self.within.append(self.container)
        self.text, self.linked = [], 0

    def gap(self, holder: int) -> None:
        self.end(holder)
        self.rows += [Line("", 0, holder)] * WINDOW
        self.within += [self.container] * WINDOW


def strip(page: str) -> Lines:
    """Lines of the page; blank ones stand where main elements or table cells begin or end, or elements of the body were left out.

    Within a container an element left out only breaks the line, as text may go on behind it.
    """
    out = Lines()
    found = scan(page)
    closes = _closing(found)
    content = Content(page, found)
    at, skip_to, links, mains, holder = 0, -1, 0, 0, 0
    opened: list[tuple[int, int, bool]] = []  # where the containers end, the ones around, and whether within a block
    for i, tag in enumerate(found):
        out.text.append(page[at : tag.start])
        out.linked += tag.start - at if links else 0
        at = tag.end
        name = tag.name
        if i <= skip_to:
            if name == "br":
                out.text.append(" ")
            elif i == skip_to or (name and name not in INLINE):
                out.end(holder, out=True)
            if i == skip_to and name not in INLINE and not mains and not (opened and opened[-1][2]):
                out.gap(holder)
            continue
        if not name:
            continue
        if tag.close:
            if name == "a":
                links = max(0, links - 1)
            elif name in MAIN and mains:
                out.gap(holder)
                mains -= 1
                holder += not mains
            elif name in CELLS:
                out.gap(holder)
            elif name not in INLINE:
                out.end(holder, heading=name in HEADINGS)
            while opened and opened[-1][0] <= i:
                out.container = opened.pop()[1]
            continue
        why = dropped(name, tag.rest, mains > 0) if i in closes else ""
        if why and (name not in MAIN or why != "comments"):
            own = content.within(i, closes[i])
            wraps = own.mains and not mains
            if wraps or (own.most and (why == "words" or name == "form")) or (why == "maybe" and own.prose):
                why = ""
        if why:
            skip_to = closes[i]
            out.end(holder)
            if name not in INLINE and not mains and not (opened and opened[-1][2]):
                out.gap(holder)
        elif name == "a":
            links += i in closes
        elif name == "br":
            out.text.append(" ")
        elif name in MAIN:
            out.gap(holder)
            holder += not mains
            mains += 1
        elif name not in INLINE:
            out.gap(holder) if name in CELLS else out.end(holder)
            if name in CONTAINERS and i in closes:
                opened.append((closes[i], out.container, name not in ("html", "body")))
                out.parents.append(out.container)
                out.container = len(out.parents) - 1
    out.text.append(page[at:])
    out.end(holder)
    return out


class Inside(NamedTuple):
    """What an element holds: a main element; on a page without one, most of the text outside links; prose."""

    mains: bool
    most: bool
    prose: bool


class Content:
    """How much text outside links, and whether a main element, lies between two tags; counted when asked."""

    def __init__(self, page: str, found: list[Tag]) -> None:
        self.page, self.found = page, found
        self.counts: tuple[list[int], list[int]] | None = None
        self.lines: list[tuple[int, int]] = []
        self.surge: list[int] = []

    def within(self, start: int, end: int) -> Inside:
        if self.counts is None:
            self._count()
        text, mains = self.counts
        return Inside(mains[end] > mains[start], not mains[-1] and 2 * (text[end] - text[start]) > text[-1], self._surges(start, end))

    def _count(self) -> None:
        text, mains, at, links, line = [], [], 0, 0, 0
        for i, tag in enumerate(self.found):
            between = 0 if links else len("".join(self.page[at : tag.start].split()))
            text.append((text[-1] if text else 0) + between)
            mains.append((mains[-1] if mains else 0) + _begins_main(tag))
            line += between
            if tag.name and tag.name not in INLINE:
                if line:
                    self.lines.append((i, line))
                line = 0
            if tag.name == "a":
                links = max(0, links - 1) if tag.close else links + 1
            at = tag.end
        text.append(text[-1] + len("".join(self.page[at:].split())) if text else 0)
        self.counts = text, mains
        # From each line on, the tag at which the first such run of lines ends.
        self.surge = [len(self.found) + 1] * (len(self.lines) + 1)
        for j in range(len(self.lines) - 1, -1, -1):
            total = itertools.accumulate(n for _, n in self.lines[j : j + WINDOW])
            self.surge[j] = min(self.surge[j + 1], next((self.lines[j + k][0] for k, n in enumerate(total) if n >= SURGE), len(self.found) + 1))

    def _surges(self, start: int, end: int) -> bool:
        """Whether WINDOW lines between the tags, or fewer, hold SURGE characters outside links."""
        first = bisect.bisect_right(self.lines, (start, 1 << 60))
        return first < len(self.lines) and self.surge[first] <= end


def _begins_main(tag: Tag) -> bool:
    """Whether a tag begins a main element that is not itself left out, such as a comment in an article element."""
    return tag.name in MAIN and not tag.close and not dropped(tag.name, tag.rest, False)


def _closing(found: list[Tag]) -> dict[int, int]:
    """For each start tag that is closed, the index of its end tag."""
    open_: dict[str, list[int]] = {}
    out: dict[int, int] = {}
    for i, tag in enumerate(found):
        name = tag.name
        if not name or name in VOID:
            continue
        if not tag.close:
            if not tag.rest.endswith("/"):
                open_.setdefault(name, []).append(i)
        elif open_.get(name):
            out[open_[name].pop()] = i
    return out


def stretches(weight: list[int]) -> list[tuple[int, int, int]]:
    """(first line, line behind the last, text) between surges and dives of the sums over WINDOW lines."""
    sums = [sum(weight[i : i + WINDOW]) for i in range(len(weight))]
    found: list[tuple[int, int, int]] = []
    i = 0
    while i < len(weight):
        if not weight[i]:  # a surge needs text on its own line
            i += 1
            continue
        end = i
        while end < len(weight) and sums[end]:
            end += 1
        found.append((i, end, sum(weight[i:end])))
        i = end
    return found


def main_text(page: str | None) -> str:
    """The page's main text: blocks in page order, joined by a blank line."""
    if not page:
        return ""
    lines = strip(page)
    rows = lines.rows
    prose = [0 if r.out or (r.linked > LINK_SHARE * len(r.text) and not (r.heading and _is_main(r.holder))) else len(r.text) for r in rows]
    teasers = _teasers(rows, prose)
    weight = [w if not _is_main(r.holder) else 0 if r.out or r.holder in teasers else len(r.text) for r, w in zip(rows, prose, strict=True)]
    for a, b in _menus(rows, prose, teasers):
        weight[a:b] = [0] * (b - a)
    found = stretches(weight)
    inside_main = [s for s in found if _is_main(rows[s[0]].holder)]
    in_mains = sum(n for *_, n in inside_main)
    chosen = {j for a, b, _ in inside_main for j in range(a, b)}
    if max((n for a, _, n in found if not _is_main(rows[a].holder)), default=0) > OUTWEIGHED * in_mains:
        outside = [0 if _is_main(r.holder) else w for r, w in zip(rows, weight, strict=True)]
        inside = _fullest(lines, outside)
        own = [s for s in found if any(inside[lines.within[j]] and outside[j] for j in range(s[0], s[1]))]
        chosen |= {j for j in range(own[0][0], own[-1][1]) if not _is_main(rows[j].holder)}
    return "\n\n".join(rows[j].text for j in sorted(chosen) if rows[j].text and not rows[j].out)


def _teasers(rows: list[Line], prose: list[int]) -> set[int]:
    """Main elements without text but links and headings, where another one has some."""
    told: dict[int, int] = {}
    for r, w in zip(rows, prose, strict=True):
        if _is_main(r.holder) and r.text and not r.out:
            told[r.holder] = told.get(r.holder, 0) + (0 if r.heading else w)
    return {h for h, n in told.items() if not n} if any(told.values()) else set()


def _menus(rows: list[Line], prose: list[int], teasers: set[int]) -> list[tuple[int, int]]:
    """Runs of at least WINDOW lines of links at either end of a main element."""
    found, at = [], 0
    for holder, group in itertools.groupby(rows, lambda r: r.holder):
        own = list(group)
        if _is_main(holder) and holder not in teasers:
            text = [j for j in range(at, at + len(own)) if rows[j].text and not rows[j].out]
            solid = [k for k, j in enumerate(text) if prose[j]]
            if solid:
                before, behind = text[: solid[0]], text[solid[-1] + 1 :]
                found += [(run[0], run[-1] + 1) for run in (before, behind) if len(run) >= WINDOW]
        at += len(own)
    return found


def _fullest(lines: Lines, weight: list[int]) -> list[bool]:
    """Which containers are, or lie in, the innermost one of several lines with more than half of the text."""
    n = len(lines.parents)
    text, count = [0] * n, [0] * n
    for k, w in zip(lines.within, weight, strict=True):
        text[k] += w
        count[k] += w > 0
    for k in range(n - 1, 0, -1):
        text[lines.parents[k]] += text[k]
        count[lines.parents[k]] += count[k]
    best = max((k for k in range(n) if 2 * text[k] > text[0] and count[k] > 1), default=0)
    inside = [k == best for k in range(n)]
    for k in range(best + 1, n):
        inside[k] = inside[lines.parents[k]]
    return inside


def _is_main(holder: int) -> bool:
    """Holders are numbered in page order: odd ones are main elements, even ones lie outside."""
    return holder % 2 == 1


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def strip_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(page) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.selectExpr("cast(page_id AS long) AS page_id", "url", "html").mapInArrow(strip_pages, "page_id long, url string, text string, n_chars long")
