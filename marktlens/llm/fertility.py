"""Quality rules: counts of a text's words and lines, and tokeniser fertility.

Public vocabularies measure each whole text: characters per token (a byte-
level vocabulary for many languages), the share of byte-fallback tokens and
the entropy of the token distribution in bits (a piece vocabulary with byte
fallback). A text outside its language's band is rejected; a language
without a band takes that of its main script. What few tokens say is uncertain,
so bands widen as 1 / sqrt(tokens): with s = ``slack`` / sqrt(n), characters
per token may be less or more by the factor 1 + s, the byte share more by s
and the entropy less by the share s. Texts of all sizes are judged by this rule.

Rows are judged one by one, so nothing is shuffled. Defined results: a null
or empty text has no tokens and no words, so it is in its band and fails the
base rules; a null language takes its
script's band; ties do not arise; repeated rows stay; an empty table gives an
empty table; further columns are kept by rate_quality() unless their names
are those it adds.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKENIZERS = "/opt/tokenizers"
BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
# Fixed value: the public byte-level vocabulary's word pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: (least, most characters per token), most byte-fallback share, least entropy. Languages, then scripts.
BANDS = {
    "de": ((2.3, 4.5), 0.15, 4.5),
    "en": ((2.3, 5.5), 0.15, 4.5),
    "es": ((2.1, 4.8), 0.15, 4.5),
    "fr": ((2.05, 4.8), 0.15, 4.5),
    "Latin": ((1.6, 6.0), 0.25, 4.0),
    "Greek": ((0.8, 5.0), 0.6, 4.0),
    "Cyrillic": ((1.0, 5.5), 0.3, 4.0),
    "Arabic": ((0.8, 5.0), 0.6, 4.0),
    "Han": ((0.3, 2.5), 0.8, 4.0),
    "Kana": ((0.3, 2.5), 0.8, 4.0),
    "Hangul": ((0.3, 2.5), 0.9, 4.0),
    "other": ((0.2, 6.0), 1.0, 3.0),
}
# The first code point of each range and its script; "" is none.
RANGES = (
    (0x0, ""), (0x41, "Latin"), (0x5B, ""), (0x61, "Latin"), (0x7B, ""), (0xC0, "Latin"), (0x250, "other"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "other"),
    (0x600, "Arabic"), (0x780, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0x20000, "Han"), (0x30000, "other"),
)
SCRIPTS = sorted({name for _, name in RANGES if name})
STARTS = np.array([a for a, _ in RANGES])
SCRIPT_OF = np.array([SCRIPTS.index(name) if name else len(SCRIPTS) for _, name in RANGES])

SPACES, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FERTILITY = "n_tokens long, chars_per_token double, byte_share double, entropy double, script string"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside some window of width words that the text holds twice or more."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    each = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.uint64) + np.uint64(1)
    windows = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):  # a 64-bit mix of the window's words, the place included
        x = (each[k : n - width + 1 + k] + np.uint64(k << 40)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        windows += x * np.uint64(0xBF58476D1CE4E5B9)
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(windows, twice))
    ends = np.zeros(n + 1, dtype=np.int64)
    np.add.at(ends, at, 1)
    np.add.at(ends, at + width, -1)
    return int((np.cumsum(ends)[:n] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode()
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, SPACES))
    seen: set[bytes] = set()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen.update(lines)
    return len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(seen), repeated_words(words)


@lru_cache(maxsize=2)
def tokenizers(ranks: bytes, model: bytes):
    import sentencepiece
    import tiktoken

    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={}), pieces, np.array([pieces.is_byte(i) for i in range(pieces.vocab_size())])


def main_script(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    counts = np.bincount(SCRIPT_OF[np.searchsorted(STARTS, points, side="right") - 1], minlength=len(SCRIPTS) + 1)[:-1]
    return SCRIPTS[int(counts.argmax())] if counts.any() else "other"


def fertility(text: str, byte_level, pieces, is_byte: np.ndarray) -> tuple[int, float | None, float | None, float | None, str]:
    """(tokens, characters per token, byte-fallback share, entropy in bits, main script)."""
    fine = len(byte_level.encode_ordinary(text))
    ids = np.array(pieces.encode(text), dtype=np.int64)
    if not fine or not len(ids):
        return fine, None, None, None, main_script(text)
    shares = np.bincount(ids)
    shares = shares[shares > 0] / len(ids)
    return fine, len(text) / fine, float(is_byte[ids].mean()), float(-(shares * np.log2(shares)).sum()), main_script(text)


def measure(batches: Iterator[pa.RecordBatch], text_at: str, held) -> Iterator[pa.RecordBatch]:
    tools = tokenizers(*held.value)
    for batch in batches:
        rows = []
        for text in batch[text_at]:
            text = text.as_py() or ""
            rows.append((*base_counts(text), *fertility(text, *tools)))
        types = [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.string()]
        new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 10, types, strict=True)]
        keep = [i for i, name in enumerate(batch.schema.names) if name != text_at]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *new], names=[*(batch.schema.names[i] for i in keep), *(x.split()[0] for x in f"{BASE}, {FERTILITY}".split(", "))])


def rate_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bands=None, slack: float = 6.0, min_words: int = 10, max_repeat_percent: int = 20, folder: str = TOKENIZERS) -> DataFrame:
    """docs without the text, with the counts, the fertility measures, base_failed, in_band and kept."""
    bands = bands or BANDS
    spark = docs.sparkSession
    #: The two vocabularies' files, some 1.3 MB.
    held = spark.sparkContext.broadcast(tuple(Path(folder, name).read_bytes() for name in (BYTE_VOCABULARY, PIECE_VOCABULARY)))
    added = f"{BASE}, {FERTILITY}"
    names = {x.split()[0] for x in added.split(", ")}
    rows = docs.select(*(c for c in docs.columns if c not in names and c != text_col), F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text")
    rows = rows.mapInArrow(partial(measure, text_at="__text", held=held), f"{schema}, {added}" if schema else added)
    band = lambda key: F.when(key.isin(*bands), key)
    key = F.coalesce(band(F.col(lang_col)), band(F.col("script")), F.lit("other"))
    s = slack / F.sqrt(F.greatest("n_tokens", F.lit(1)))
    fits = F.lit(False)
    for name, ((low, high), byte_share, entropy) in bands.items():
        inside = F.col("chars_per_token").between(low / (1 + s), high * (1 + s)) & (F.col("byte_share") <= byte_share + s) & (F.col("entropy") >= entropy * (1 - s))
        fits = fits | ((key == name) & inside)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("in_band", (F.col("n_tokens") == 0) | F.coalesce(fits, F.lit(False)))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("in_band"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdicts."""
    rated = rate_quality(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("chars_per_token", 6).alias("chars_per_token"), F.round("byte_share", 6).alias("byte_share"), F.round("entropy", 6).alias("entropy"),
    )
