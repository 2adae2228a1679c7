"""Language identification by Bayesian evidence fusion.

Four sources of evidence are multiplied per document:

* text: a multinomial model of byte trigrams, fitted to at most
  ``rows_per_language`` labelled documents of each label (those of smallest
  hash), so a rare language has its share; the log likelihood of the whole
  text counts with weight ``text_weight``, since overlapping trigrams are not
  independent;
* declared language (markup or metadata): P(declared | language), estimated
  over all documents from the text posteriors, smoothed. Where the label is
  the declared language too, it is no evidence for the rows that the text model
  was fitted to;
* address suffix: P(suffix | language), in the same way;
* host: a hierarchical prior. A host's language counts are smoothed towards
  those of its parent domain, and these towards all documents'
  (``prior_rows`` pseudo-documents each); counts are sums of text posteriors
  by grouped aggregation, so a hot host is a few partial sums.

Evidence that a row lacks (null) is neutral. A text whose trigrams fit no
language better than chance, or has none, has no text evidence. A row is kept
if its best language's posterior is at least ``min_posterior``, it has a
letter, and the language is wanted.

Defined results: a null, empty or letterless text is "und" and not kept;
equal posteriors go to the language first by name; repeated rows count as
often as they occur; without any labelled row everything is "und"; an empty
table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, join_small, materialise, table
from .url_filter import host_of

CELLS = 1 << 16
#: Bytes as the model sees them: letters lower-cased, what is above ASCII as it is, all else a gap.
SEEN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def trigrams(raw: bytes) -> np.ndarray:
    """Cells of a text's byte trigrams, runs of gaps taken as one."""
    x = SEEN[np.frombuffer(b" " + raw + b" ", dtype=np.uint8)]
    x = x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, dtype=np.uint32)
    return ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def count_cells(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(languages), CELLS), dtype=np.int64)
    for batch in batches:
        for raw, lang in zip(batch["raw"], batch["lang"].to_pylist(), strict=True):
            total[languages.index(lang)] += np.bincount(trigrams(raw.as_py() or b""), minlength=CELLS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], ["cell", "n"])


def draw(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A row's place in the order of samples, from 0 to 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("sample"), id_col, text_col), 11) / float(1 << 53)


def fit(docs: DataFrame, id_col: str, text_col: str, label_col: str, rows_per_language: int = 500, smoothing: float = 0.5) -> tuple[list[str], np.ndarray, dict[str, float]]:
    """(languages by name, CELLS x languages log likelihood ratios to chance, the last place in the sample's order by language)."""
    rows = docs.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("lang"), F.col(text_col).cast("binary").alias("raw"), draw(docs, id_col, text_col).alias("at"))
    sizes = dict(rows.groupBy("lang").agg(F.count("*")).collect())  # a row a language
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((CELLS, 0), np.float32), {}
    #: Some twice as many as wanted are drawn by their hash, whatever a language's size; of these, the first are taken.
    shares = F.create_map(*[F.lit(x) for name in languages for x in (name, (2.0 * rows_per_language + 50) / sizes[name])])
    few = rows.where(F.col("at") < F.try_element_at(shares, "lang"))
    few = few.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("at", "raw"))).where(F.col("nth") <= rows_per_language)
    few = materialise(few.drop("nth"), "lid-sample")
    cuts = dict(few.groupBy("lang").agg(F.max("at")).collect())
    counts = np.full((len(languages), CELLS), smoothing)
    cells = few.select("raw", "lang").mapInArrow(partial(count_cells, languages=languages), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts.ravel()[cells["cell"].to_numpy()] += cells["n"].to_numpy()
    free(few)
    shares = counts / counts.sum(axis=1, keepdims=True)
    #: Against the mean of the languages and an even spread: a text of no language gains nothing.
    return languages, np.ascontiguousarray((np.log(shares) - np.log(1 / CELLS)).T.astype(np.float32)), cuts


def score_texts(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Log likelihood ratios of each language to an even spread, and the number of trigrams."""
    model = held.value
    width = model.shape[1]
    for batch in batches:
        sums, sizes = np.zeros((batch.num_rows, width)), np.zeros(batch.num_rows, dtype=np.int64)
        for i, raw in enumerate(batch["raw"]):
            cells = trigrams(raw.as_py() or b"")
            sizes[i] = len(cells)
            for at in range(0, len(cells), 1 << 16):
                sums[i] += model[cells[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        keep = [i for i, name in enumerate(batch.schema.names) if name != "raw"]
        text = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), pa.array(sums.ravel()))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), text, pa.array(sizes)], names=[*(batch.schema.names[i] for i in keep), "text_ll", "n_grams"])


def with_softmax(rows: DataFrame, logs: Column, name: str) -> DataFrame:
    """rows with an array column of the normalised exponentials of an array of logs."""
    rows = rows.withColumn("__logs", logs)
    rows = rows.withColumn("__raised", F.transform("__logs", lambda x: F.exp(x - F.array_max("__logs"))))
    whole = F.aggregate("__raised", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn(name, F.transform("__raised", lambda x: x / whole)).drop("__logs", "__raised")


def markup_language(html: Column) -> Column:
    """The primary subtag of the root element's lang attribute, lower case; null without one."""
    found = F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,8})""", 1)
    return F.nullif(F.lower(found), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(host), r"\.([^.:]+)(?::\d+)?$", 1), F.lit(""))


def parent_of(host: Column) -> Column:
    """The last two labels of a host; null for a name of one label."""
    return F.nullif(F.regexp_extract(F.lower(host), r"([^.]+\.[^.]+)$", 1), F.lit(""))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str | None = "lang", declared: Column | None = None, host: Column | None = None, rows_per_language: int = 500, text_weight: float = 0.2, prior_rows: float = 20.0, min_posterior: float = 0.5, wanted: tuple[str, ...] | None = None, model=None) -> DataFrame:
    """(id_col, lang, posterior, kept) for every row. declared and host are column expressions over docs.

    model: what fit() returned for other rows; by default it is fitted to
    label_col, and rows of its sample have no declared language.
    """
    spark = docs.sparkSession
    languages, ratios, cuts = model or fit(docs, id_col, text_col, label_col, rows_per_language)
    n = len(languages)
    none = F.lit(None).cast("string")
    if model is None and declared is not None and cuts:
        last = F.try_element_at(F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]), F.col(label_col))
        declared = F.when(F.coalesce(draw(docs, id_col, text_col) > last, F.lit(True)), declared)
    if not n:
        return docs.select(id_col, F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))
    held = spark.sparkContext.broadcast(ratios)
    host = none if host is None else host
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"), F.lower(declared if declared is not None else none).alias("declared"), host.alias("host"))
    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(partial(score_texts, held=held), f"id {kind}, declared string, host string, text_ll array<double>, n_grams long")
    scored = with_softmax(scored, F.transform("text_ll", lambda x: x * text_weight), "text_p")
    #: Evidence needs a language that fits better than an even spread.
    speaks = (F.col("n_grams") > 0) & (F.array_max("text_ll") > 0)
    scored = materialise(scored.withColumn("p", F.when(speaks, F.col("text_p"))).drop("text_p"), "lid-text").withColumns({"suffix": suffix_of(F.col("host")), "parent": parent_of(F.col("host"))})

    sums = [F.sum(F.coalesce(F.col("p")[i], F.lit(0.0))).alias(f"s{i}") for i in range(n)]
    everywhere = scored.agg(*sums).first()
    base = [((x or 0.0) + 1.0) for x in everywhere]
    base = [x / sum(base) for x in base]

    def counts(key: str) -> DataFrame:
        return scored.where(F.col(key).isNotNull()).groupBy(key).agg(*sums)

    def smoothed(found: DataFrame, towards: list[Column]) -> list[Column]:
        size = reduce(add, [F.coalesce(found[f"s{i}"], F.lit(0.0)) for i in range(n)])
        return [(F.coalesce(found[f"s{i}"], F.lit(0.0)) + prior_rows * towards[i]) / (size + prior_rows) for i in range(n)]

    def likelihood(key: str) -> DataFrame:
        """P(value of key | language) over its mean over languages, as an array; neutral where a value is new."""
        each = counts(key)
        whole = [(x or 0.0) for x in each.agg(*[F.sum(f"s{i}") for i in range(n)]).first()]
        rate = [(F.col(f"s{i}") + 0.5) / (whole[i] + 1.0) for i in range(n)]
        return each.select(key, F.array(*[F.log(r) for r in rate]).alias(f"{key}_ll"))

    hosts, parents = counts("host"), counts("parent").select(F.col("parent").alias("above"), *[F.col(f"s{i}").alias(f"a{i}") for i in range(n)])
    hosts = hosts.withColumn("above", parent_of(F.col("host"))).join(parents, "above", "left")
    above_size = reduce(add, [F.coalesce(F.col(f"a{i}"), F.lit(0.0)) for i in range(n)])
    above = [(F.coalesce(F.col(f"a{i}"), F.lit(0.0)) + prior_rows * base[i]) / (above_size + prior_rows) for i in range(n)]
    hosts = hosts.select("host", F.array(*[F.log(x) for x in smoothed(hosts, above)]).alias("host_ll"))
    fused = scored
    for key, facts in (("host", hosts), ("declared", likelihood("declared")), ("suffix", likelihood("suffix"))):
        fused = join_small(fused, facts, key, "left", row_bytes=8 * n + 64)

    neutral = F.array_repeat(F.lit(0.0), n)
    together = lambda x, y: F.zip_with(x, y, lambda p, q: p + q)
    logs = F.coalesce("host_ll", F.array(*[F.lit(float(np.log(x))) for x in base]))
    for part in ("declared_ll", "suffix_ll"):
        logs = together(logs, F.coalesce(part, neutral))
    logs = together(logs, F.when(F.col("p").isNotNull(), F.transform("text_ll", lambda x: x * text_weight)).otherwise(neutral))
    fused = with_softmax(fused, logs, "posteriors")
    fused = fused.withColumn("best", F.array_max("posteriors"))
    best = F.col("best")
    found = F.element_at(F.array(*map(F.lit, languages)), F.array_position("posteriors", best).cast("int"))
    speaks = F.col("p").isNotNull()
    wanted_ok = found.isin(*(wanted or languages))
    return fused.select(
        F.col("id").alias(id_col), F.when(speaks, found).otherwise("und").alias("lang"), F.when(speaks, F.round(best, 6)).otherwise(0.0).alias("posterior"),
        (speaks & (best >= min_posterior) & wanted_ok).alias("kept"),
    )


def text_of(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def identify_pages(pages: DataFrame, model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """(id_col, lang, posterior, kept) of raw pages by all evidence: text, markup language, address suffix, host and parent domain."""
    rows = pages.select(F.col(id_col).alias("id"), text_of(F.col(html_col)).alias("text"), markup_language(F.col(html_col)).alias("declared"), F.nullif(host_of(F.col(url_col)), F.lit("")).alias("host"))
    return identify(rows, "id", "text", None, F.col("declared"), F.col("host"), model=model, **options).withColumnRenamed("id", id_col)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; its stated language is the declared one (but for the model's sample), and its source the host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return identify(docs, declared=F.col("lang"), host=F.col("source"))
