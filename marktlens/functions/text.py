"""Text functions of product names. All are column expressions that stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNITS = "ml|gr|g|lt|l"
#: A number, at most one white space, and a unit that no further letter follows.
SIZE = rf"[0-9]+(?U:\s)?(?i:{UNITS})(?![A-Za-z])"
#: The same, or a bare number at the end.
LAST_SIZE = rf"({SIZE}|[0-9]+(?U:\s)*$)"

# Accented letters that fold to one letter, quotes that fold to ', signs that are removed.
FOLDS = {"a": "àáâãäå", "e": "èéêë", "i": "ìíîï", "o": "òóôõöø", "u": "ùúûü", "n": "ñ", "c": "ç", "y": "ÿ"}
LONG_FOLDS = {"ß": "ss", "ẞ": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe"}
QUOTES = "\u00b4\u2018\u2019\u201a\u201b\u02b9\u02bc"
REMOVED = "\ufeff\u200b\u200c\u200d"


def ascii_lower(x: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(x, UPPER, LOWER)


def collapse(x: Column) -> Column:
    """Runs of Unicode white space as one space, trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def full_name(brand: Column, name: Column, size: Column) -> Column:
    """The non-empty parts, trimmed, joined by a space."""
    return F.concat_ws(" ", *[F.nullif(collapse_ends(x), F.lit("")) for x in (brand, name, size)])


def collapse_ends(x: Column) -> Column:
    """Trimmed of Unicode white space."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def tokens(x: Column) -> Column:
    """The alphanumeric words of a name in Unicode lower case, sorted, repeats kept."""
    parts = F.split(F.lower(x), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.array_sort(F.filter(parts, lambda t: t != ""))


def normalize(x: Column) -> Column:
    return F.array_join(tokens(x), " ")


def compact(x: Column) -> Column:
    """The normalised name without spaces, over which similarity is measured."""
    return F.array_join(tokens(x), "")


def bigrams(c: Column) -> Column:
    """A string's bigrams; of equal ones each is numbered, so that sets of these behave as multisets."""
    pairs = F.when(F.length(c) > 1, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(
        F.transform(
            F.array_distinct(pairs),
            lambda g: F.transform(F.sequence(F.lit(1), F.size(F.filter(pairs, lambda p: p == g))), lambda n: F.concat(g, F.lit("#"), n.cast("string"))),
        )
    )


def dice(a: Column, b: Column, bigrams_a: Column | None = None, bigrams_b: Column | None = None) -> Column:
    """Sørensen-Dice similarity of two compact names: twice the common bigrams over both lengths in bytes less 2."""
    common = F.size(F.array_intersect(bigrams_a if bigrams_a is not None else bigrams(a), bigrams_b if bigrams_b is not None else bigrams(b)))
    short = (F.octet_length(a) < 2) | (F.octet_length(b) < 2)
    return F.when(a == b, 1.0).when(short, 0.0).otherwise(2.0 * common / (F.octet_length(a) + F.octet_length(b) - 2))


def similarity(a: Column, b: Column) -> Column:
    return dice(compact(a), compact(b))


def brand_coverage(name: Column, brand: Column) -> Column:
    """The share of the brand's words found in the name; an empty brand covers only an empty name."""
    n, b = tokens(name), tokens(brand)
    found = F.size(F.filter(b, lambda t: F.array_contains(n, t)))
    return F.when(F.size(b) == 0, (F.size(n) == 0).cast("double")).otherwise(found / F.size(b))


def size_found(x: Column) -> Column:
    """The first number with a unit, as written (white space collapsed); null without one."""
    return F.nullif(collapse(F.regexp_extract(x, f"({SIZE})", 1)), F.lit(""))


def has_trailing_number(x: Column) -> Column:
    return F.coalesce(F.regexp_like(x, F.lit(r"(?U)(^|\s)[0-9]+\s*$")), F.lit(False))


def split_size(x: Column) -> Column:
    """struct<name, size>: the last size, as "N unit" (ml for a bare number at the end), and what stands before it.

    Text behind the last size is dropped; a name without one is returned as it is, with a null size.
    """
    every = F.regexp_extract_all(x, F.lit(LAST_SIZE), F.lit(1))
    last = F.element_at(every, -1)
    #: The match is the last one: what precedes it ends where no later match begins.
    after = F.regexp_extract(x, rf"(?s)^(.*?){LAST_SIZE}((?:(?!{LAST_SIZE}).)*)$", 1)
    digits, unit = F.regexp_extract(last, "^([0-9]+)", 1), ascii_lower(F.regexp_extract(last, "([A-Za-z]+)", 1))
    size = F.concat(digits, F.lit(" "), F.when(unit == "", "ml").otherwise(unit))
    found = F.size(every) > 0
    return F.struct(F.when(found, collapse(after)).otherwise(x).alias("name"), F.when(found, size).alias("size"))


def strip_brand(name: Column, brand: Column) -> Column:
    """The name without the brand's text wherever it stands (ASCII case ignored), white space collapsed."""
    quoted = F.concat(F.lit(r"(?i)\Q"), F.replace(brand, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.when(brand == "", collapse(name)).otherwise(collapse(F.regexp_replace(name, quoted, F.lit(" "))))


def with_size(name: Column, sku_size: Column, url: Column) -> Column:
    """The name with a size: its own, else the selector's, else the url's, else ml behind a trailing number."""
    appended = F.coalesce(sku_size, size_found(url))
    return F.when(size_found(name).isNotNull(), name).when(appended.isNotNull(), F.concat(name, F.lit(" "), appended)).when(has_trailing_number(name), F.concat(name, F.lit(" ml"))).otherwise(name)


def with_brand(name: Column, brand: Column) -> Column:
    """The brand before a name that lacks some of its words."""
    return F.when(brand.isNull() | (brand_coverage(name, brand) >= 1.0), name).otherwise(F.concat(brand, F.lit(" "), name))


def ascii_fold(x: Column) -> Column:
    """ASCII lower case; listed accents and quotes folded; other characters as they are."""
    accents = "".join(FOLDS.values())
    plain = "".join(letter * len(group) for letter, group in FOLDS.items())
    capital = [(a.upper(), p) for a, p in zip(accents, plain, strict=True) if len(a.upper()) == 1 and a.upper() != a]
    one = UPPER + accents + "".join(a for a, _ in capital) + QUOTES
    to = LOWER + plain + "".join(p for _, p in capital) + "'" * len(QUOTES)
    folded = F.translate(x, one + REMOVED, to)  # what has no counterpart is removed
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LONG_FOLDS.items(), folded)


# What buttons that load more say.
LOAD_MORE = ("cargar más", "cargar mas", "ver más", "ver mas", "load more", "show more", "mostrar más", "mostrar mas", "ver todos")


def is_load_more(x: Column) -> Column:
    """Does a button's text ask for more results?"""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(x), F.lit(t)) for t in LOAD_MORE])
