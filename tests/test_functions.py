"""Scalar functions against worked cases and plain-Python references."""

import math
import random
import re

from pyspark.sql import functions as F

from marktlens.functions import prices as money
from marktlens.functions import text as names
from marktlens.functions import urls
from marktlens.operators.detect import number_of, prices_in


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", column.alias("v")).orderBy("i").select("v").collect()]


def strings(spark, rows, column):
    return values(spark, rows, "x string", column)


def test_full_name_and_collapse(spark):
    assert values(spark, [(" A ", "b", ""), (None, " x ", "10 ml")], "a string, b string, c string", names.full_name(F.col("a"), F.col("b"), F.col("c"))) == ["A b", "x 10 ml"]
    assert strings(spark, [" a   b\t", ""], names.collapse(F.col("x"))) == ["a b", ""]


def test_normalize(spark):
    assert strings(spark, ["Zeta, alpha (50ML)!", "ÉTÉ b", "--", ""], names.normalize(F.col("x"))) == ["50ml alpha zeta", "b été", "", ""]


def dice(a, b):
    a, b = ("".join(sorted(re.findall(r"[^\W_]+", x.lower()))) for x in (a, b))
    if a == b:
        return 1.0
    if len(a.encode()) < 2 or len(b.encode()) < 2:
        return 0.0
    grams = [x[i : i + 2] for x in [a] for i in range(len(x) - 1)]
    hits = 0
    for g in (b[i : i + 2] for i in range(len(b) - 1)):
        if g in grams:
            grams.remove(g)
            hits += 1
    return 2 * hits / (len(a.encode()) + len(b.encode()) - 2)


def test_similarity(spark):
    rng = random.Random(3)
    words = ["amber", "basil", "of", "mist", "dry", "340", "gr", "ö", "k", "kkkk", "öre"]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(0, 5))), " ".join(rng.choices(words, k=rng.randint(0, 5)))) for _ in range(200)]
    got = values(spark, pairs, "a string, b string", names.similarity(F.col("a"), F.col("b")))
    assert all(math.isclose(g, dice(*p)) for g, p in zip(got, pairs, strict=True))


def test_brand_coverage(spark):
    cases = [("Quil n'est 40 gr", "QUIL", 1.0), ("Trill Moon", "Moon Trill", 1.0), ("Trill", "Trill Moon", 0.5), ("x", "", 0.0), ("--", "!", 1.0)]
    assert values(spark, [c[:2] for c in cases], "n string, b string", names.brand_coverage(F.col("n"), F.col("b"))) == [c[2] for c in cases]


def size_by_hand(text):
    """(name, size): the last number with a unit, or a bare one at the end, found by walking through the text."""
    best, at = None, 0
    while at < len(text):
        end = at
        while end < len(text) and text[end].isdigit():
            end += 1
        if end == at:
            at += 1
            continue
        rest, gap = text[end:], 1 if text[end : end + 1].isspace() else 0
        unit = next((u for u in ("ml", "gr", "g", "lt", "l") if rest[gap:].lower().startswith(u) and not rest[gap + len(u) : gap + len(u) + 1].isalpha()), None)
        if unit:
            best = (at, text[at:end], unit)
            at = end + gap + len(unit)
        elif not rest.strip():
            best = (at, text[at:end], "ml")
            at = len(text)
        else:
            at += 1
    return (" ".join(text.split()), None) if best is None else (" ".join(text[: best[0]].split()), f"{best[1]} {best[2]}")


def test_sizes(spark):
    rng = random.Random(31)
    bits = ["7", "12", "305", "ml", "GR", "g", "lt", "l", "x", "mlx", " ", " ", "amber", ".", "5 l", "40ml"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 7))) for _ in range(400)]
    got = strings(spark, texts, names.split_size(F.col("x")))
    units = lambda s: s and re.sub("[a-z]+", lambda m: {"gr": "g", "lt": "l"}.get(m[0], m[0]), s)
    assert [(" ".join(r["name"].split()), units(r["size"])) for r in got] == [(n, units(z)) for n, z in map(size_by_hand, texts)]
    assert strings(spark, ["Tea 40ml 75 ml", "no", "9 Gr."], names.size_found(F.col("x"))) == ["40ml", None, "9 Gr"]
    assert strings(spark, ["tea 75", "75 x", "12", ""], names.has_trailing_number(F.col("x"))) == [True, False, True, False]


def test_strip_brand(spark):
    cases = [("QUIL Amber quil", "Quil", "Amber"), ("A b", "", "A b"), (r"x a\Eb y", r"a\Eb", "x y"), ("a.b axb", "a.b", "axb")]
    assert values(spark, [c[:2] for c in cases], "n string, b string", names.strip_brand(F.col("n"), F.col("b"))) == [c[2] for c in cases]


def test_enrich(spark):
    size = names.with_size(F.col("n"), F.col("s"), F.col("u"))
    assert values(spark, [("a 5 ml", "9 ml", ""), ("a", "9 ml", "/x-8ml"), ("a", None, "/x-8ml-y"), ("a 50", None, ""), ("a", None, "")], "n string, s string, u string", size) == ["a 5 ml", "a 9 ml", "a 8ml", "a 50 ml", "a"]
    assert values(spark, [("Tea", "Quil"), ("quil tea", "Quil"), ("x", None)], "n string, b string", names.with_brand(F.col("n"), F.col("b"))) == ["Quil Tea", "quil tea", "x"]


def test_ascii_fold(spark):
    assert strings(spark, ["ÀÉîõÜñÇß Œuf l’Eau​", "Ł Ж", "ÆÿŸ"], names.ascii_fold(F.col("x"))) == ["aeiounCss oeuf l'eau".replace("C", "c"), "Ł Ж", "aeyy"]


def test_number_tokens_and_prices(spark):
    """Random amounts written with either separator, grouped or not, amid other text."""
    rng = random.Random(32)
    amounts = [rng.randint(1, 10**8) / 100 for _ in range(200)]
    texts = []
    for v in amounts:
        whole, cents = divmod(round(v * 100), 100)
        grouped = f"{whole:,}"
        number = rng.choice([f"{grouped}.{cents:02}", f"{grouped.replace(',', '.')},{cents:02}", f"{whole},{cents:02}", f"{whole}.{cents:02}", grouped.replace(",", "'") + f".{cents:02}", grouped.replace(",", " ") + f",{cents:02}"])
        texts.append(rng.choice(["$", "EUR ", "", "now: "]) + number + rng.choice(["", " each", "-"]))
    assert strings(spark, texts, money.parse_price(F.get(money.number_tokens(F.col("x")), F.lit(0)))) == amounts
    assert strings(spark, ["8 765 4321 0", "98 765", "z7,y6.5"], money.number_tokens(F.col("x"))) == [["8 765", "4321", "0"], ["98 765"], ["7", "6.5"]]


def test_prices_agree_with_detection(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("0123456789., '$%-a ", k=rng.randint(0, 12))) for _ in range(400)]
    got = strings(spark, texts, money.classify_text(F.col("x")))
    assert [[(p["value"], p["text"]) for p in g or []] for g in got] == [prices_in(t) for t in texts]
    tokens = [t for t in ("".join(rng.choices("0123456789.,", k=rng.randint(1, 9))) for _ in range(300)) if t[0].isdigit()]
    assert strings(spark, tokens, money.parse_price(F.col("x"))) == [number_of(t) for t in tokens]


def test_currency_and_display(spark):
    assert strings(spark, ["US$ 1", "ar$ 5", "5 €", "$ 5", "mars", "R$ 1", "£ 3"], money.detect_currency(F.col("x"))) == ["USD", "ARS", "EUR", None, "ARS", "BRL", "GBP"]
    assert values(spark, [631407.0, 87.25, 0.0, 98765432.1, None], "x double", money.display(F.col("x"))) == ["631407", "87.25", "0", "98765432.1", None]


def test_urls(spark):
    assert strings(spark, ["https://WWW.a.com/x?q=1", "no url", None], urls.host_of(F.col("x"))) == ["www.a.com", "", ""]
    pages = ["https://a.com/?page=2&page=x&page=7", "https://a.com/?mypage=3", "https://a.com/?page=99999999999", "page=4"]
    assert strings(spark, pages, urls.page_number(F.col("x"))) == [7, None, None, None]
    assert strings(spark, pages, urls.has_param(F.col("x"), "page")) == [True, False, True, False]
    assert strings(spark, ["https://a.com/c?page=2&x=1", "https://a.com/c", "https://a.com/c?x=1&page=2#f", "c"], urls.with_page(F.col("x"), "page", F.lit(3))) == ["https://a.com/c?x=1&page=3", "https://a.com/c?page=3", "https://a.com/c?x=1&page=3#f", "c?page=3"]
    assert strings(spark, ["#", "", "javascript:x", "/p#", "/p"], urls.is_placeholder(F.col("x"))) == [True, True, True, True, False]
    assert values(spark, [0, 1700000000], "x long", urls.iso8601(F.col("x"))) == ["1970-01-01 00:00:00.000Z", "2023-11-14 22:13:20.000Z"]
    assert strings(spark, ["https://a.com/x", "zz"], urls.capture_place("captures", F.col("x"))) == ["captures/a.com", "captures"]
    assert values(spark, [(90, True), (90, False), (70, True)], "n int, p boolean", urls.should_reload(F.col("n"), 80, F.col("p"))) == [True, False, False]
    assert strings(spark, ["Cargar MÁS productos", "Next"], names.is_load_more(F.col("x"))) == [True, False]
