"""Anchors of one HTML document with the text block around each.

The only step that needs nesting.  It runs inside ``mapInPandas``: Spark spreads the
documents, this reads one of them.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from rentlake import fixed_values as V
from rentlake.functions.regex import SPACE

_SPACES = re.compile(f"[{SPACE}]+")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {
    "a": ("a",), "li": ("li",), "p": ("p",), "option": ("option",),
    "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"),
}
_SCOPE = frozenset(("table", "ul", "ol", "html"))
_CASA_FACT = re.compile(V.CASA_BLOCK_FACT, re.I | re.A)
_IDEALISTA_FACT = re.compile(V.IDEALISTA_BLOCK_FACT, re.I)


def collapse(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


class Page(HTMLParser):
    """Elements as (tag, parent, start, end) spans over the document text."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [["html", None, 0, None]]
        self.anchors: list[tuple[int, str]] = []
        self._open, self._text, self._size = [0], [], 0
        self._seen: dict[int, str] = {}
        self.feed(html)
        self.close()
        self.text = "".join(self._text)

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES:
            self._end_implied(_CLOSES[tag])
        if tag in _VOID:
            return
        self.nodes.append([tag, self._open[-1], self._size, None])
        self._open.append(len(self.nodes) - 1)
        if tag == "a":
            href = dict(attrs).get("href")
            if href:
                self.anchors.append((len(self.nodes) - 1, href))

    def handle_endtag(self, tag):
        for depth in range(len(self._open) - 1, 0, -1):
            if self.nodes[self._open[depth]][0] == tag:
                self._end_from(depth)
                return

    def handle_data(self, data):
        self._text.append(data)
        self._size += len(data)

    def _end_implied(self, tags):
        for depth in range(len(self._open) - 1, 0, -1):
            name = self.nodes[self._open[depth]][0]
            if name in _SCOPE:
                return
            if name in tags:
                self._end_from(depth)
                if name == tags[0]:
                    return

    def _end_from(self, depth):
        for node in self._open[depth:]:
            self.nodes[node][3] = self._size
        del self._open[depth:]

    def content(self, node: int) -> str:
        """Collapsed text of an element."""
        if node not in self._seen:
            _, _, start, end = self.nodes[node]
            self._seen[node] = collapse(self.text[start:end])
        return self._seen[node]

    def parent_text(self, node: int) -> str:
        return self.content(self.nodes[node][1])

    def table_text(self, node: int) -> str:
        while node is not None:
            if self.nodes[node][0] == "table":
                return self.content(node)
            node = self.nodes[node][1]
        return ""

    def block(self, node: int, fact: re.Pattern, depth: int, size: int = 600) -> str:
        """Nearest ancestor with a price and a fact, else the nearest table."""
        up = self.nodes[node][1]
        while up is not None and depth > 0:
            text = self.content(up)
            if "€" in text and fact.search(text):
                return text[:size]
            up, depth = self.nodes[up][1], depth - 1
        return self.table_text(node)[:size]


_DOMAINS = tuple(V.LISTING_PATHS)


def scan(route: str, html: str):
    """Yield (position, href, text, block) of the anchors the route looks at; ``every`` sees all of them."""
    page = Page(html or "")
    for pos, (node, href) in enumerate(page.anchors):
        if route == "every":
            yield pos, href, page.content(node), page.parent_text(node)
        elif route == "immobiliare":
            if V.CLICK_HOST in href:
                yield pos, href, page.content(node), page.table_text(node)[:500]
        elif route == "idealista":
            if "/immobile/" in href:
                block = page.block(node, _IDEALISTA_FACT, V.IDEALISTA_BLOCK_DEPTH)
                yield pos, href, page.content(node), block
        elif any(d in href.lower() for d in _DOMAINS):
            if route == "casa":
                yield pos, href, page.content(node), page.block(node, _CASA_FACT, V.CASA_BLOCK_DEPTH)
            else:
                yield pos, href, page.content(node), page.parent_text(node)
