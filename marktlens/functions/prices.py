"""Numbers and prices in text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits joined by . , ' before a digit, or by a space or no-break space before exactly three digits.
NUMBER = r"([0-9](?:[0-9]|[.,'](?=[0-9])|[ \x{A0}](?=[0-9]{3}(?![0-9])))*)"
SEPARATOR = r"[ \x{A0}.,']"

# What shows a currency, in order of precedence.
CURRENCIES = (("US$", "USD"), ("U$S", "USD"), ("USD", "USD"), ("AR$", "ARS"), ("ARS", "ARS"), ("€", "EUR"), ("EUR", "EUR"), ("£", "GBP"), ("GBP", "GBP"), ("R$", "BRL"), ("BRL", "BRL"))


def number_tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(NUMBER), F.lit(1))


def has_separator(token: Column) -> Column:
    return F.regexp_like(token, F.lit(SEPARATOR))


def has_confident_price(x: Column) -> Column:
    return F.exists(number_tokens(x), has_separator)


def parse_price(token: Column) -> Column:
    """A number token as a double.

    With both . and , the later is the decimal sign; one kind alone is if at
    most two digits follow its last use; else separators only group.
    """
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    dot, comma = F.contains(token, F.lit(".")), F.contains(token, F.lit(","))
    cut = F.regexp_extract(token, r"^(.*)[.,]([^.,]*)$", 1)
    rest = F.regexp_extract(token, r"^(.*)[.,]([^.,]*)$", 2)
    decimal = (dot & comma) | ((dot | comma) & (F.length(digits(rest)) <= 2))
    number = F.when(decimal, F.concat(digits(cut), F.lit("."), digits(rest))).otherwise(digits(token))
    return F.when(digits(F.when(decimal, cut).otherwise(token)) != "", number.try_cast("double"))


def classify_text(x: Column) -> Column:
    """array<struct<value, text>>: the prices of a text, null if it holds none.

    Tokens with a separator are prices; failing any, a single bare number of
    2 to 7 digits is, if the text holds no other letter or digit, - or %.
    """
    priced = lambda ts: F.transform(ts, lambda t: F.struct(parse_price(t).alias("value"), t.alias("text")))
    found = number_tokens(x)
    sure = F.filter(priced(F.filter(found, has_separator)), lambda p: p["value"].isNotNull())
    bare = F.filter(found, lambda t: ~has_separator(t) & F.length(t).between(2, 7))
    at = F.position(bare[0], x)
    others = F.concat(F.left(x, at - 1), F.substring(x, at + F.length(bare[0]), F.length(x)))
    alone = ~F.regexp_like(others, F.lit(r"[\p{IsAlphabetic}\p{N}%-]"))
    return F.when(F.size(sure) > 0, sure).when((F.size(bare) == 1) & alone, priced(bare))


def detect_currency(x: Column) -> Column:
    """The code of the first sign of CURRENCIES in the upper-cased text; null for a bare $."""
    upper = F.upper(x)
    return reduce(lambda later, sign: F.when(F.contains(upper, F.lit(sign[0])), sign[1]).otherwise(later), reversed(CURRENCIES), F.lit(None).cast("string"))


def currency_of(card: Column, default: Column) -> Column:
    return F.coalesce(card, default, F.lit(""))


def display(x: Column) -> Column:
    """A double without exponent and without trailing zeros, as 242100 or 99.5."""
    fixed = x.cast("decimal(38,10)").cast("string")
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
