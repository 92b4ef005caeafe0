"""Detail pages read in one pass over their tags: a stack of open elements and what they wait for.

No tree is built and nothing recurses, so the memory is the page and its open elements, however
deep it nests. An end tag without a matching start is passed over by a count of open tags; one
that matches closes all that stand inside. Every start tag is pushed and popped once, and an
element that many rows wait for is given to all of them at once, so the time is linear.
"""

from __future__ import annotations

import collections
import re
from html import unescape

# Page labels, element ids and classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = ("script", "style", "template")
LABELS = {
    "Genre:": "genre",
    "Release Date:": "release_date",
    "ESRB Rating:": "esrb",
    "Publisher:": "publisher",
    "Developer:": "developer",
    "Model Number:": "model_number",
    "Player Count:": "player_count",
    "UPC:": "upc",
    "ASIN (Amazon):": "asin",
    "ePID (eBay):": "epid",
}
ID_LABEL = "ID:"
TABLE_ID = "attribute"
PRICE_IDS = {"used_price": "loose", "complete_price": "cib", "new_price": "new"}
SALE_BOXES = {"completed-auctions-used": "loose", "completed-auctions-cib": "cib", "completed-auctions-new": "new"}


def _attribute(name: str, value: str) -> str:
    return rf"""\s+{name}=(?:"{value}"|'{value}'|{value}(?=>))"""


def _value(name: str, group: str) -> str:
    """An attribute's value without references; unquoted, one that doesn't end in a slash."""
    return rf"""\s+{name}=(?:"(?P<{group}2>[^"&<>]*)"|'(?P<{group}1>[^'&<>]*)'|(?P<{group}0>[^\s<>&"'=]*[^\s<>&"'=/])(?=>))"""


#: A row of a sale in plain form.
ROW = (
    rf"""<tr(?:{_value("id", "id")})?>\s*<td{_attribute("class", "date")}>(?P<date>[^<]*)</td>\s*<td{_attribute("class", "title")}>"""
    rf"""(?:(?P<a><a(?:{_value("href", "href")})>)(?P<link>[^<]*)</a>)?(?P<rest>[^<]*)</td>\s*"""
    rf"""<td{_attribute("class", "numeric")}><span{_attribute("class", "js-price")}>(?P<price>[^<]*)</span></td>\s*</tr>"""
)
_ROW, _ROWS = re.compile(ROW), re.compile(rf"(?:{re.sub(r"\?P<[a-z0-9]+>", "?:", ROW)})++")


class Span:
    """A stretch of the page's text: of an element, from its start to its end tag."""

    __slots__ = ("begin", "end", "href")

    def __init__(self, begin: int, href: str | None = None):
        self.begin, self.end, self.href = begin, None, href


class Row:
    """A table row: the first element of each kind inside it, once they have opened."""

    __slots__ = ("detail", "boxes", "own_id", "title", "details", "date", "price", "link")

    def __init__(self, detail: bool, boxes: list[str], own_id: str | None):
        self.detail, self.boxes, self.own_id = detail, boxes, own_id
        self.title = self.details = self.date = self.price = self.link = None


_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SKIP, _SPACES = re.compile(r"[\s/]*"), re.compile(r"\s*")
_ATTRIBUTE, _UNQUOTED = re.compile(r"[^\s/>][^\s/>=]*"), re.compile(r"[^\s>]*")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in ("script", "style")}


def start_tag(page: str, at: int) -> tuple[str, dict[str, str], bool, int] | None:
    """(name, attributes, closed in itself, where it ends) of the start tag at ``at``; None if the page ends in it.
    Of equal attributes the last counts."""
    m = _NAME.match(page, at + 1)
    tag, at, held = m[0].lower(), m.end(), {}
    while True:
        at = _SKIP.match(page, at).end()
        if at >= len(page):
            return None
        if page[at] == ">":
            return tag, held, page[at - 1] == "/", at + 1
        m = _ATTRIBUTE.match(page, at)
        name, at, value = m[0].lower(), m.end(), ""
        equals = _SPACES.match(page, at).end()
        if page[equals : equals + 1] == "=":
            at = _SPACES.match(page, equals + 1).end()
            quote = page[at : at + 1]
            if quote in ('"', "'"):
                end = page.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = page[at + 1 : end], end + 1
            else:
                m = _UNQUOTED.match(page, at)
                value, at = m[0], m.end()
        held[name] = unescape(value)


class DetailPage:
    """Feeds on a page; ``result`` gives the raw texts of its fields, prices and sales."""

    def __init__(self, sales: bool = True):
        self.sales = sales
        self.spans = 0  # open ones
        self.parts: list[str] = []
        self.size = 0
        self.stack: list[tuple[str, list]] = []  # tag, what to do when it closes
        self.open = collections.Counter()
        self.hidden = 0
        self.cells = 0  # open td.numeric
        self.table = None  # None: not met; True: open; False: over
        self.boxes: dict[str, list] = {}  # class -> [open, depth of tbody inside]
        self.prices: dict[str, Span] = {}
        self.within: collections.Counter = collections.Counter()  # open elements with a price id
        self.rows: list[Row] = []
        self.waiting: dict[str, list[Row]] = {k: [] for k in ("title", "details", "date", "price")}
        self.linkless: list[Row] = []

    # ------------------------------------------------------------------ events

    def feed(self, page: str) -> None:
        """Never looks at a character of markup twice: what has no end reaches to the end of the page."""
        at = 0
        while at < len(page):
            to = page.find("<", at)
            to = len(page) if to < 0 else to
            if to > at:
                self._data(page[at:to])
            if to == len(page):
                return
            if self._plain() and (past := self._plain_rows(page, to)) > to:
                at = past
                continue
            follows = page[to + 1 : to + 2]
            if _NAME.match(follows):
                found = start_tag(page, to)
                if found is None:
                    return
                tag, attrs, closed, at = found
                self._start(tag, attrs)
                if closed and tag not in VOID:
                    self._end(tag)
                elif tag in _ENDS:
                    end = _ENDS[tag].search(page, at)
                    at = end.start() if end else len(page)
            elif follows in ("!", "?") or follows == "/" and page[to + 2 : to + 3]:
                comment = page.startswith("<!--", to)
                end = page.find("-->" if comment else ">", to + 2)
                if follows == "/" and (name := _NAME.match(page, to + 2)):
                    self._end(name[0].lower())
                at = len(page) if end < 0 else end + (3 if comment else 1)
            else:
                self._data("<")
                at = to + 1

    def _plain(self) -> bool:
        """Whether a row that begins here has nothing around it that its parts could be given to."""
        return bool(self.stack) and self.stack[-1][0] == "tbody" and not (self.spans or self.hidden or self.cells or self.table or self.linkless or any(self.waiting.values()) or any(self.within.values()))

    def _plain_rows(self, page: str, at: int) -> int:
        """Reads the plain rows from ``at`` on; returns where they end."""
        boxes = [name for name, (is_open, bodies) in self.boxes.items() if is_open and bodies]
        if not (self.sales and boxes):
            m = _ROWS.match(page, at)
            return m.end() if m and not any(f"{name}" in page[at : m.end()] for name in PRICE_IDS) else at
        while m := _ROW.match(page, at):
            id2, id1, id0, date, a, href2, href1, href0, link, rest, price = m.groups()
            own_id = id2 or id1 or id0
            if own_id in PRICE_IDS:
                break
            rest = unescape(rest) if "&" in rest else rest
            link = unescape(link) if a and "&" in link else link
            sale = (own_id, (unescape(date) if "&" in date else date).strip(), link if a else rest, link + rest if a else rest, unescape(price) if "&" in price else price, (href2 or href1 or href0 or "") if a else None)
            self.rows.append((boxes, sale))
            at = m.end()
        return at

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in VOID:
            for close in self._met(tag, attrs, void=True):
                close()
            return
        closers: list = []
        self.stack.append((tag, closers))
        self.open[tag] += 1
        if tag in UNSEEN:
            self.hidden += 1
        closers += self._met(tag, attrs, void=False)

    def _end(self, tag: str) -> None:
        if self.open[tag]:
            while self._pop() != tag:
                pass

    def _data(self, text: str) -> None:
        if not self.hidden:
            self.parts.append(unescape(text))
            self.size += len(self.parts[-1])

    def _pop(self) -> str:
        tag, closers = self.stack.pop()
        self.open[tag] -= 1
        if tag in UNSEEN:
            self.hidden -= 1
        for close in closers:
            close()
        return tag

    # ------------------------------------------------------------------ elements

    def _span(self, closers: list, href: str | None = None) -> Span:
        span = Span(self.size, href)
        self.spans += 1

        def close():
            span.end = self.size
            self.spans -= 1

        closers.append(close)
        return span

    def _give(self, kind: str, closers: list) -> None:
        """The element that just opened is the first of its kind for every row that waits for one."""
        rows, self.waiting[kind] = self.waiting[kind], []
        if not rows:
            return
        span = self._span(closers)
        for row in rows:
            setattr(row, kind, span)
        if kind == "title":
            mark = len(self.linkless)
            self.linkless += rows
            closers.append(lambda: self.linkless.__delitem__(slice(mark, None)))

    def _met(self, tag: str, attrs: dict[str, str], void: bool) -> list:
        """What opens with this element; returns what to do when it closes."""
        closers: list = []
        own_id, classes = attrs.get("id", ""), attrs.get("class", "").split()
        if "price" in classes:
            for name in PRICE_IDS:
                if self.within[name] and name not in self.prices:
                    self.prices[name] = self._span(closers)
        if own_id in PRICE_IDS and not void:
            self.within[own_id] += 1
            closers.append(lambda: self.within.subtract([own_id]))
        if tag == "table" and own_id == TABLE_ID and self.table is None:
            self.table = True
            closers.append(lambda: setattr(self, "table", False))
        elif tag == "div" and "tab" not in classes:
            for name in SALE_BOXES:
                if name in classes and name not in self.boxes:
                    box = self.boxes[name] = [True, 0]
                    closers.append(lambda box=box: box.__setitem__(0, False))
        elif tag == "tbody":
            for box in self.boxes.values():
                if box[0]:
                    box[1] += 1
                    closers.append(lambda box=box: box.__setitem__(1, box[1] - 1))
        elif tag == "tr":
            self._row(own_id, closers)
        elif tag == "td":
            for kind in ("title", "details", "date"):
                if kind in classes:
                    self._give(kind, closers)
            if "numeric" in classes:
                self.cells += 1
                closers.append(lambda: setattr(self, "cells", self.cells - 1))
        elif tag == "span" and "js-price" in classes and self.cells:
            self._give("price", closers)
        elif tag == "a" and self.linkless:
            span = self._span(closers, attrs.get("href"))
            for row in self.linkless:
                row.link = span
            self.linkless = []
        return closers

    def _row(self, own_id: str, closers: list) -> None:
        boxes = [name for name, (is_open, bodies) in self.boxes.items() if is_open and bodies]
        detail = self.table is True
        if not (detail or boxes):
            return
        row = Row(detail, boxes, own_id or None)
        self.rows.append(row)
        for rows in self.waiting.values():
            rows.append(row)

        def close():  # the last row to open is the first to close
            for rows in self.waiting.values():
                if rows and rows[-1] is row:
                    rows.pop()

        closers.append(close)

    # ------------------------------------------------------------------ result

    def result(self) -> dict:
        while self.stack:
            self._pop()
        text = "".join(self.parts)
        shown = lambda span: text[span.begin : span.end] if span else None
        fields: dict[str, str] = {}
        own = None
        sales = []
        for row in self.rows:
            if isinstance(row, tuple):
                boxes, sale = row
                sales += [(SALE_BOXES[name], *sale) for name in boxes]
                continue
            if row.detail and row.title and row.details:
                label = shown(row.title).strip()
                if label in LABELS:
                    fields[LABELS[label]] = shown(row.details)
                elif label.endswith(ID_LABEL):
                    own = shown(row.details)
            if self.sales and row.date and row.price:
                sale = row.own_id, shown(row.date).strip(), shown(row.link or row.title), shown(row.title), shown(row.price), row.link.href if row.link else None
                sales += [(SALE_BOXES[name], *sale) for name in row.boxes]
        prices = {condition: shown(self.prices.get(name)) for name, condition in PRICE_IDS.items()}
        return {"fields": fields, "prices": prices, "own_id": own, "sales": sales}


#: What a sale shows, in order.
SALE = ("condition", "row_id", "sale_date", "title", "cell", "price", "url")


def read_page(html: str | None, sales: bool = True) -> dict:
    """The raw texts of a detail page, each sale a tuple of SALE; values are cleaned in SQL."""
    page = DetailPage(sales)
    page.feed(html or "")
    return page.result()


def read_detail(html: str | None) -> dict:
    """The same, each sale by its names."""
    found = read_page(html)
    return found | {"sales": [dict(zip(SALE, s, strict=True)) for s in found["sales"]]}
