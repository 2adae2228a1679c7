"""Price-grid detection on inline pages."""

import random

import pytest

from marktlens.operators import detect


def card(name, price, extra=""):
    return f'<div class="card">{extra}<a href="/p/{name}" title="{name}">{name}</a><div class="price">{price}</div></div>'


def grid(*cards, classes="grid shop"):
    return f'<html><body><p>Menu<div class="{classes}" id="g">{"".join(cards)}</div></body></html>'


def found(page):
    container, products = detect.detect(page)
    return container, [(p["name"], p["price"]) for p in products]


def written(rng, value):
    """value (two decimals) in one of the ways that shops write it."""
    whole, cents = divmod(round(value * 100), 100)
    thousands = f"{whole:,}"
    return rng.choice([f"{thousands}.{cents:02}", f"{thousands.replace(',', '.')},{cents:02}", f"{whole}.{cents:02}", f"{whole},{cents:02}", f"{thousands.replace(',', ' ')},{cents:02}"])


@pytest.mark.parametrize("seed", range(8))
def test_formats(seed):
    """Random prices in the formats of many shops, with signs before or after."""
    rng = random.Random(seed)
    goods = [(f"Good {i}{chr(97 + i)}", rng.randint(100, 10**7) / 100) for i in range(rng.randint(2, 12))]
    cards = [card(n, rng.choice(["{} €", "$ {}", "£{}", "{}"]).format(written(rng, v))) for n, v in goods]
    container, got = found(grid(*cards, classes="z-list all"))
    assert got == goods and container == {"classes": ["all", "z-list"], "id": "g", "child_count": len(goods)}


@pytest.mark.parametrize("page", [None, "", "<p>no price</p>", grid(card("Aa", "$1.50"))])
def test_no_grid(page):
    assert detect.detect(page) is None


def test_larger_grid_wins():
    page = grid(card("Xx", "$1.10"), card("Yy", "$2.20")) + grid(*[card(f"P{i}", f"${i}.50") for i in range(5)], classes="main")
    assert found(page)[0]["classes"] == ["main"]


def test_bare_and_grouped_numbers():
    assert [p for _, p in found(grid(card("Aa", "1500"), card("Bb", "631 407"), card("Cc", "99")))[1]] == [1500.0, 631407.0, 99.0]


def test_price_pairs_merge_and_current_price_wins():
    both = '<div class="prices"><div>$ 870.25</div><div><span itemprop="price">$ 58.316,75</span></div></div>'
    page = grid(*[f'<div class="card"><a title="Product {i}" href="/{i}"></a>{both}</div>' for i in "ab"])
    assert found(page)[1] == [("Product a", 58316.75), ("Product b", 58316.75)]


def test_price_spans():
    span = '<div><span class="x-product-price">1</span><span class="x-product-price">.250</span></div>'
    page = grid(*[f'<div class="card"><img alt="Pic {i}" src="/{i}.png">{span}</div>' for i in "ab"])
    assert found(page)[1] == [("Pic a", 1250.0), ("Pic b", 1250.0)]


def test_list_cards():
    page = '<div class="box"><ul>' + "".join(f'<li><h2>Long name {i}</h2><div>$ {n}0.50</div>' for n, i in enumerate("abc", 1)) + "</ul></div>"
    assert found(page)[1] == [("Long name a", 10.5), ("Long name b", 20.5), ("Long name c", 30.5)]


def test_fields():
    extra = '<span class="vtex productBrandName">Ozelle</span><img src="/q.png"><img src="/r.png"><img src="/q.png"><a href="#">x</a><a href="javascript:void(0)">y</a><span class="skuSelectorItem">50 ml</span><span class="skuSelectorItem is--selected">100 ml</span>'
    products = detect.detect(grid(card("Toy", "AR$ 10.50", extra), card("ozelle Kit 30 ml", "AR$ 9.50", '<span class="productBrandName">Ozelle</span>')))[1]
    assert products[0] == {"name": "Ozelle x 100 ml", "price_text": "10.50", "price": 10.5, "url": "/p/Toy", "images": ["/q.png", "/r.png"], "currency": "ARS"}
    assert products[1]["name"] == "ozelle Kit 30 ml"


def test_size_from_url_and_bare_number():
    cards = ['<div class="card"><a href="/eau-75ml-x" title="Eau"></a><div>$ 1.50</div></div>', '<div class="card"><a href="/x" title="edp 50"></a><div>$ 2.50</div></div>']
    assert [n for n, _ in found(grid(*cards))[1]] == ["Eau 75ml", "edp 50 ml"]


def test_diagnose():
    candidates = detect.diagnose(grid(card("Aa", "$1.50"), card("Bb", "$2.50")))
    assert [c["selected"] for c in candidates] == [True] + [False] * (len(candidates) - 1)
    assert candidates[0]["price_count"] == 2 and candidates[0]["density"] == 2 / candidates[0]["div_count"]


def test_frames(spark):
    pages = spark.createDataFrame([(1, grid(card("Aa", "$1.50"), card("Bb", "$2.50"))), (2, "<p>"), (3, None)], "page_id long, html string")
    grids = detect.detect_grids(pages)
    assert [(r.page_id, r.position, r.name, r.price) for r in detect.products_of(grids).orderBy("position").collect()] == [(1, 0, "Aa", 1.5), (1, 1, "Bb", 2.5)]
    assert {r.page_id: len(r.candidates) for r in detect.candidate_containers(pages).collect()} == {1: 1, 2: 0, 3: 0}
