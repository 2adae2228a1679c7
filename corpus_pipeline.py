"""A corpus pipeline of five training-data stages over ``documents``.

Each stage takes what its predecessor kept and calls one operator of
marktlens.llm with its production parameters; all but the last return the
columns of documents. A row is named by its id and 128 bits of its text, so
texts that share an id are judged apart; equal rows are judged alike, and
near-dedup keeps one of them. Rows to drop are found as such short names and
removed by a join, whose other side is broadcast only if its counted size
allows. Texts that line dedup empties have the same empty set of shingles, so
near-dedup keeps one of them. Empty tables, null columns and further columns
of any name pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marktlens.llm.common import join_small, materialise, table, unused
from marktlens.llm.decontaminate import drop_leaks
from marktlens.llm.language_id import identify
from marktlens.llm.line_dedup import dedup_lines
from marktlens.llm.mixing import mix_sources
from marktlens.llm.near_copies import digest_of, near_copies


def row_key() -> Column:
    """A name of a row's id and text: 128 bits."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit("")))))


def by_key(docs: DataFrame, key: Column, names: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose key is (left_semi) or is not (left_anti) among names (one column).

    A broadcast name takes some 160 bytes of the driver: itself, its place in
    the hash table, and its copies while it is collected and sent.
    """
    at = unused("__key", docs.columns)
    return join_small(docs.withColumn(at, key), names.toDF(at).distinct(), at, how, row_bytes=160).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known by their text and the habits of their source."""
    named = docs.select(row_key().alias("name"), "text", "lang", "source")
    gone = materialise(identify(named, id_col="name", host=F.col("source")).where("not kept").select("name"), "stage-language")
    return by_key(docs, row_key(), gone, "left_anti")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later copies of repeated runs; n_chars follows the text."""
    gone = unused("__deleted", docs.columns)
    out = dedup_lines(docs, deleted_col=gone)
    return out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more): that of the smallest id, then text digest."""
    groups = near_copies(docs)
    rows = docs.select("doc_id", row_key().alias("name"), digest_of(F.col("text")).alias("digest")).join(groups, "digest")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "name"))
    kept = rows.groupBy("group").agg(first.alias("first"), F.count("*").alias("n")).select("first.name", "n")
    kept = materialise(kept, "stage-near")
    #: Of most groups one text is all, so those that go are fewer than those that stay.
    gone = materialise(rows.select("name").distinct().join(kept, "name", "left_anti"), "stage-near-gone")
    left = by_key(docs, row_key(), gone, "left_anti")
    #: Rows equal in id and text: the first by all columns stays.
    names = rows.groupBy("name").agg(F.count("*").alias("times")).where("times > 1").select("name")
    often = materialise(names.join(kept, "name", "left_semi"), "stage-near-often")
    once = by_key(left, row_key(), often, "left_anti")
    repeated = by_key(left, row_key(), often, "left_semi")
    one = repeated.groupBy(row_key().alias("name")).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.unionByName(one.select("row.*").select(*docs.columns))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each copy that it takes of a document, numbered from 1."""
    taken = mix_sources(docs, carry=True).where("copies > 0")
    return taken.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("decontaminate", benchmark_stage),
    ("source_mix", mixing_stage),
]
#: Several stages have no SQL form; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
