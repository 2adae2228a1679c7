"""Price-grid detection: a page's product cards with names, prices, links, images and currency.

The page is parsed inside an Arrow task (a tree cannot be columnar); what
comes out is one row a page, or one a product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prices import CURRENCIES
from ..schemas import CONTAINER, PRODUCT
from .dom import WHITE, Node, Tree

NUMBER = re.compile(r"[0-9](?:[0-9]|[.,'](?=[0-9])|[ \xa0](?=[0-9]{3}(?![0-9])))*")
SEPARATORS = frozenset(" \xa0.,'")
SIZE = re.compile(r"[0-9]+\s?(?:ml|gr|g|lt|l)(?![A-Za-z])", re.IGNORECASE | re.ASCII)
WORD = re.compile(r"[^\W_]+")
# Markup by which shops mark lists, prices, names, brands, sizes, and links that lead nowhere.
LISTS = ("ul", "ol", "tbody", "table")
PRICE_SPAN, CURRENT_PRICE, CURRENT_TYPE, NAME_ANCHOR = "product-price", "price", "finalPrice", "product-item-name"
BRAND_CLASSES, BRAND_WORDS = ("productBrandName", "productBrandContainer", "product-item-brand", "__brand"), {"brand", "product"}
SIZE_SELECTOR, SELECTED, NO_LINK = "skuSelectorItem", "selected", ("javascript:", "mailto:", "tel:", "data:")

Price = tuple[float, str]


def number_of(token: str) -> float | None:
    """The value of a number token; see functions.prices.parse_price."""
    head, sign, tail = token, "", ""
    cut = max(token.rfind("."), token.rfind(","))
    if cut >= 0 and (("." in token and "," in token) or sum(c.isdigit() for c in token[cut + 1 :]) <= 2):
        head, sign, tail = token[:cut], ".", token[cut + 1 :]
    whole, part = ("".join(c for c in x if c in "0123456789") for x in (head, tail))
    return float(whole + sign + part) if whole else None


def prices_in(text: str) -> list[Price]:
    """The prices of a text; see functions.prices.classify_text."""
    found = NUMBER.findall(text)
    sure = [(v, t) for t in found if SEPARATORS & set(t) and (v := number_of(t)) is not None]
    if sure:
        return sure
    bare = [t for t in found if not SEPARATORS & set(t) and 2 <= len(t) <= 7]
    if len(bare) == 1 and not any(c.isalnum() or c in "-%" for c in text.replace(bare[0], "", 1)):
        return [(float(bare[0]), bare[0])]
    return []


def shows_price(text: str) -> bool:
    return any(SEPARATORS & set(t) for t in NUMBER.findall(text))


def size_in(text: str) -> str | None:
    found = SIZE.search(text)
    return WHITE.sub(" ", found[0]) if found else None


class Page:
    """One page's tree and what is derived from it."""

    def __init__(self, source: str) -> None:
        self.tree = Tree(source)
        self.nodes = self.tree.nodes
        self.own: dict[int, str] = {}
        for n in self.nodes:
            if not n.tag and n.div >= 0:
                self.own[n.div] = self.own.get(n.div, "") + n.text
        self.priced = self.without_outer(self.merged(self.leaves()))
        inside = set(self.priced)
        total = lambda hit: [0, *accumulate(int(hit(n)) for n in self.nodes)]
        self.n_divs, self.n_priced = total(lambda n: n.tag == "div"), total(lambda n: n.at in inside)
        self.ranking = self.rank()

    # Price divs

    def priced_texts(self, texts: dict[int, str]) -> dict[int, list[Price]]:
        found = {at: prices_in(texts[at]) for at in sorted(texts)}
        return {at: prices for at, prices in found.items() if prices}

    def leaves(self) -> dict[int, list[Price]]:
        """Divs with prices: from marked price spans if these give two or more, else from each div's own text."""
        spans: dict[int, str] = {}
        for n in self.nodes:
            if n.tag == "span" and n.has_class(PRICE_SPAN) and n.div >= 0:
                direct = "".join(self.nodes[c].text for c in n.children)
                if direct:
                    spans[n.div] = spans.get(n.div, "") + direct
        marked = self.priced_texts(spans)
        return marked if len(marked) >= 2 else self.priced_texts(self.own)

    def is_named(self, at: int) -> bool:
        return self.structured_name(at) is not None or len(self.longest_text(at)) >= 6

    def merged(self, leaves: dict[int, list[Price]]) -> dict[int, list[Price]]:
        """Nameless price divs side by side in a div without text are one price group, its last prices counting."""
        siblings: dict[int, list[int]] = {}
        for at in leaves:
            siblings.setdefault(self.nodes[at].parent, []).append(at)
        group = {}
        for parent, some in siblings.items():
            if len(some) > 1 and self.nodes[parent].tag == "div" and not self.own.get(parent, "").strip() and not any(map(self.is_named, some)):
                group.update(dict.fromkeys(some, parent))
        out: dict[int, list[Price]] = {}
        for at, prices in leaves.items():
            out[group.get(at, at)] = prices
        return out

    def without_outer(self, divs: dict[int, list[Price]]) -> dict[int, list[Price]]:
        places = sorted(divs)
        following = dict(zip(places, places[1:]))  # noqa: B905
        return {at: prices for at, prices in divs.items() if not (at in following and following[at] < self.nodes[at].end)}

    # Containers

    def rank(self) -> list[tuple[int, int, int]]:
        """(place, price divs, divs) of candidate containers, the densest first."""
        each = [(n.at, self.n_priced[n.end] - self.n_priced[n.at], self.n_divs[n.end] - self.n_divs[n.at]) for n in self.nodes if n.tag == "div"]
        each = [x for x in each if x[1] >= 2]
        most = max((p for _, p, _ in each), default=0)
        return sorted((x for x in each if x[1] >= most // 2), key=lambda x: -x[1] / x[2])

    def container(self, at: int, count: int) -> dict:
        node = self.nodes[at]
        return {"classes": sorted(set(node.classes)), "id": node.attrs.get("id"), "child_count": count}

    # Cards

    def card(self, at: int, container: int) -> int:
        """The container's child above a price div; in a list, the list's child."""
        path = [at]
        while self.nodes[path[-1]].parent not in (container, -1):
            path.append(self.nodes[path[-1]].parent)
        top = self.nodes[path[-1]]
        if len(path) > 1 and (top.tag in LISTS or top.attrs.get("role") == "list"):
            return path[-2]
        return path[-1]

    def current_price(self, at: int) -> Price | None:
        for n in self.tree.below(at):
            if n.attrs.get("itemprop") == CURRENT_PRICE or n.attrs.get("data-price-type") == CURRENT_TYPE:
                found = prices_in(self.tree.all_text(n.at))
                if found:
                    return found[-1]
        return None

    # Names

    def label(self, n: Node) -> str | None:
        """An anchor's title, aria-label or text."""
        for attr in ("title", "aria-label"):
            if value := n.attrs.get(attr, "").strip():
                return value
        text = self.tree.flat_text(n.at)
        return text if text and not shows_price(text) else None

    @staticmethod
    def is_product_anchor(n: Node) -> bool:
        return n.tag == "a" and (n.attrs.get("data-role") == NAME_ANCHOR or n.has_class(NAME_ANCHOR))

    def structured_name(self, at: int) -> str | None:
        nodes = self.tree.below(at)
        for n in nodes:
            if self.is_product_anchor(n) and (name := self.label(n)):
                return name
        for n in nodes:
            name = self.label(n) if n.tag == "a" else n.attrs.get("alt", "").strip() if n.tag == "img" else None
            if name:
                return name
        return None

    def longest_text(self, at: int) -> str:
        best = ""
        for n in self.tree.below(at):
            if not n.tag and len(n.text) > len(best):
                text = WHITE.sub(" ", n.text).strip()
                if len(text) > len(best) and any(map(str.isalpha, text)) and not shows_price(text):
                    best = text
        return best

    def name(self, at: int, container: int) -> str:
        """The first structured name on the way up to the container, else the longest text met."""
        best = ""
        while True:
            if (name := self.structured_name(at)) is not None:
                return name
            best = max(best, self.longest_text(at), key=len)
            at = self.nodes[at].parent
            if at in (container, -1):
                return best

    def brand(self, card: int) -> str | None:
        for n in self.tree.below(card):
            marked = any(n.has_class(c) for c in BRAND_CLASSES)
            if marked or (n.tag == "strong" and BRAND_WORDS <= set(n.classes)):
                text = self.tree.flat_text(n.at)
                if any(map(str.isalnum, text)) and not shows_price(text) and len(text) <= 32:
                    return text
        return None

    def selector_size(self, card: int) -> str | None:
        sizes = [(not n.has_class(SELECTED), n.at, size) for n in self.tree.below(card) if n.has_class(SIZE_SELECTOR) and (size := size_in(self.tree.flat_text(n.at)))]
        return min(sizes)[2] if sizes else None

    def full_name(self, card: int, name: str, url: str | None) -> str:
        """The name with its size and brand."""
        if not size_in(name):
            last = name.split()[-1:] or [""]
            size = self.selector_size(card) or size_in(url or "") or ("ml" if re.fullmatch("[0-9]+", last[0]) else None)
            name = f"{name} {size}" if size else name
        brand = self.brand(card)
        if brand:
            words = set(WORD.findall(name.lower()))
            if not set(WORD.findall(brand.lower())) <= words:
                return f"{brand} {name}"
        return name

    # Other fields

    def link(self, card: int) -> str | None:
        """The structured link, else the first with text, else the first."""
        links = []
        for n in self.tree.below(card):
            href = n.attrs.get("href", "").strip()
            if n.tag == "a" and href and not href.endswith("#") and not href.startswith(NO_LINK):
                links.append((0 if self.is_product_anchor(n) else 1 if self.tree.flat_text(n.at) else 2, n.at, href))
        return min(links)[2] if links else None

    def images(self, card: int) -> list[str]:
        return list(dict.fromkeys(src for n in self.tree.below(card) if n.tag == "img" and (src := n.attrs.get("src", "").strip())))

    def currency(self, card: int) -> str | None:
        text = self.tree.all_text(card).upper()
        return next((code for sign, code in CURRENCIES if sign in text), None)

    def products(self, container: int) -> list[dict]:
        """One product a card, from its price div with the most prices (the first of equals)."""
        cards: dict[int, int] = {}
        for at, prices in self.priced.items():
            if container < at < self.nodes[container].end:
                card = self.card(at, container)
                if card not in cards or len(prices) > len(self.priced[cards[card]]):
                    cards[card] = at
        out = []
        for card, at in cards.items():
            value, text = self.current_price(at) or self.priced[at][-1]
            url = self.link(card)
            out.append({"name": self.full_name(card, self.name(at, container), url), "price_text": text, "price": value, "url": url, "images": self.images(card), "currency": self.currency(card)})
        return out


def detect(source: str) -> tuple[dict, list[dict]] | None:
    """(container, products) of a page's price grid; None without one."""
    page = Page(source or "")
    if not page.ranking:
        return None
    at, count, _ = page.ranking[0]
    return page.container(at, count), page.products(at)


def diagnose(source: str) -> list[dict]:
    """All candidate containers, the densest first; the first is the one selected."""
    page = Page(source or "")
    return [{**{k: v for k, v in page.container(at, p).items() if k != "child_count"}, "price_count": p, "div_count": d, "density": p / d, "selected": i == 0} for i, (at, p, d) in enumerate(page.ranking)]


GRID = f"container {CONTAINER}, products array<{PRODUCT}>"
CANDIDATES = "array<struct<classes: array<string>, id: string, price_count: bigint, div_count: bigint, density: double, selected: boolean>>"


def detect_grids(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, container, products) of the pages that have a grid."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(i, *grid) for i, html in zip(frame["id"], frame["html"], strict=True) if (grid := detect(html))]
            yield pd.DataFrame(found, columns=[id_col, "container", "products"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(each, f"{id_col} {kind}, {GRID}")


def candidate_containers(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, candidates) of all pages."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({id_col: frame["id"], "candidates": [diagnose(h) for h in frame["html"]]})

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(each, f"{id_col} {kind}, candidates {CANDIDATES}")


def products_of(grids: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row a product, numbered within its page."""
    return grids.select(id_col, F.posexplode("products").alias("position", "p")).select(id_col, "position", "p.*")
