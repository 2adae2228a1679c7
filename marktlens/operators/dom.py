"""A small HTML tree for grid detection.

Nodes lie in one list in document order; a node's subtree is the slice from
its place to its end, so ancestry is a comparison of places and every count
over a subtree is a difference of running totals. Built on the standard
library's tokenizer: void elements, implied ends of p, li, options, table
parts and definition items, and raw text elements are handled; foster
parenting and the adoption agency are not.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag, the open elements it ends, and the elements that shield them.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}),
    "option": ({"option"}, {"select", "datalist"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
WHITE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    at: int
    parent: int
    tag: str = ""  # empty for text
    text: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    end: int = 0
    div: int = -1  # the nearest div above
    children: list[int] = field(default_factory=list)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def has_class(self, part: str) -> bool:
        return any(part in c for c in self.classes)


class Tree(HTMLParser):
    """All nodes of a page; node 0 is the document."""

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node(0, -1, "#document")]
        self.open = [0]
        self.feed(source)
        self.close()
        while self.open:
            self._end()

    def _end(self) -> None:
        self.nodes[self.open.pop()].end = len(self.nodes)

    def _add(self, tag: str, text: str = "", attrs: dict[str, str] | None = None) -> int:
        parent = self.nodes[self.open[-1]]
        node = Node(len(self.nodes), parent.at, tag, text, attrs or {}, div=parent.at if parent.tag == "div" else parent.div)
        node.end = node.at + 1
        parent.children.append(node.at)
        self.nodes.append(node)
        return node.at

    def _end_implied(self, tags: set[str] | frozenset[str], shields: set[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.nodes[self.open[depth]].tag
            if name in shields:
                return
            if name in tags:
                while len(self.open) > depth:
                    self._end()
                if tags == {"p"}:
                    return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P:
            self._end_implied(frozenset({"p"}), {"button", "td", "th", "table"})
        if tag in IMPLIED:
            self._end_implied(*IMPLIED[tag])
        first: dict[str, str] = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        at = self._add(tag, attrs=first)
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash ends nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[depth]].tag == tag:
                while len(self.open) > depth:
                    self._end()
                return

    def handle_data(self, data: str) -> None:
        self._add("", data)

    def below(self, at: int) -> list[Node]:
        """The node and all below it, in document order."""
        return self.nodes[at : self.nodes[at].end]

    def all_text(self, at: int) -> str:
        return "".join(n.text for n in self.below(at))

    def flat_text(self, at: int) -> str:
        return WHITE.sub(" ", self.all_text(at)).strip()
