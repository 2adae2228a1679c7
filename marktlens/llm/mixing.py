"""Mixing sources to target weights by Pareto order sampling (Rosén 1997).

A source's target is its share of the whole by weight, at most
``max_repeat`` times its size; what is over is shared out again by weight.

Within a source, longer documents are wanted more often: the copies that a
document should have on average are e = min(max_repeat, lambda * w), where w is
``base`` plus the number of binary digits of its size, and lambda is set so
that all documents' copies come to the target. The whole part of e is allocated
for certain; the fraction p is the inclusion probability of one more copy, so
these are unequal. All documents of a source with p > 0 stand in one Pareto
order, by their random odds u / (1 - u) over their inclusion odds p / (1 - p).
The sample is the head of that order whose words come to the remaining target.
The words still missing then go to the one untaken document whose size is
nearest to them, if it brings the source closer to its target.

No group is gathered in one task: documents of one number of digits are one
row of a small aggregate, the cut in the order is found with a histogram of
the order per source (pre-aggregated), and only the documents of the one
histogram cell that holds the cut are ordered. Equal rows (id, source, text)
are told apart by a number, counted in each input partition and offset by the
counts of those before, so no task sees all of them; whichever row gets which
number, the result is the same. Sources themselves, one aggregated row each,
are ordered in one task.

Defined results: a null text has size 0, a null source is a source of its
own (ordered last), documents of size 0 get no copies; rows with null or
repeated ids and repeated rows are documents of their own, each drawn by
itself; an empty table gives an empty table. Only the named columns are read,
so further columns of any name do no harm.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, join_small, materialise, n_words, table

BITS, CELL_BITS = 52, 12
#: What tells rows apart but for their number.
SAME = ["source", "id", "digest"]


def random_bits(seed: str) -> Column:
    """52 reproducible random bits of a row, as a long, from its id, text and number among equal rows."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), "digest", F.col("nth").cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def same(left: str, right: str, columns: list[str]) -> Column:
    """Null-safe equality of columns of two named sides."""
    return reduce(and_, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def repeated(rows: DataFrame) -> DataFrame:
    """The hashes (key) of rows that occur more than once, and by chance of others: these are numbered, too."""
    return materialise(rows.groupBy(F.xxhash64(*SAME).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key"), "mix-often")


def with_numbers(rows: DataFrame, often: DataFrame) -> DataFrame:
    """rows (SAME, part: the input partition, ...) with nth, from 0 among equal rows. often: what repeated() gives."""
    names = rows.columns
    if often.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    rows = rows.withColumn("key", F.xxhash64(*SAME))
    once = join_small(rows, often, "key", "left_anti").select(*names, F.lit(0).cast("long").alias("nth"))
    rows = join_small(rows, often, "key", "left_semi").select(*names)
    counts = rows.groupBy(*SAME, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*SAME).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    rows = rows.withColumn("here", F.row_number().over(Window.partitionBy(*SAME, "part").orderBy(F.lit(1))) - 1)
    rows = rows.alias("r").join(counts.alias("c"), same("r", "c", [*SAME, "part"]))
    return once.unionByName(rows.select("r.*", (F.col("before") + F.col("here")).alias("nth")).drop("here"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """One row per source: source_size and target.

    sizes: columns source, size. The number of rows handled in one task is
    that of the distinct sources, after a pre-aggregation.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int")).cast("long"))
    ranked = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before, after = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(0, Window.unboundedFollowing)
    cap = F.lit(max_repeat) * F.col("source_size")
    each = (
        each.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("left_words", F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(after))
        .withColumn("capped", cap * F.col("left_weight") <= F.col("weight") * F.col("left_words"))
        .withColumn("to_share", F.col("total") - F.sum(F.when(F.col("capped"), cap).otherwise(0)).over(whole))
        .withColumn("by_weight", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(whole))
    )
    shared = F.try_divide((F.col("weight") * F.col("to_share")).cast("double"), F.col("by_weight"))
    return each.withColumn("target", F.when(F.col("capped"), cap.cast("double")).otherwise(shared)).select("source", "source_size", "target")


def wanted_copies(sizes: DataFrame, targets: DataFrame, max_repeat: int, base: int) -> DataFrame:
    """(source, digits, copies, p) of each source's documents by the digits of their size, and extra_words, what p must bring the source."""
    groups = sizes.where("size > 0").groupBy("source", "digits").agg(F.sum("size").alias("words"))
    groups = groups.alias("g").join(targets.alias("t"), same("g", "t", ["source"])).select("g.*", "target").withColumn("w", F.col("digits") + base)
    down = Window.partitionBy("source").orderBy(F.desc("digits"))
    before, after, whole = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy("source")
    groups = (
        groups.withColumn("left", F.col("target") - max_repeat * F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("full", max_repeat * F.sum(F.col("w") * F.col("words")).over(after) <= F.col("w") * F.col("left"))
        .withColumn("to_share", F.col("target") - max_repeat * F.sum(F.when(F.col("full"), F.col("words")).otherwise(0)).over(whole))
        .withColumn("by_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w") * F.col("words"))).over(whole))
    )
    wanted = F.when(F.col("full"), F.lit(float(max_repeat))).otherwise(F.col("w") * F.try_divide("to_share", F.col("by_weight").cast("double")))
    groups = groups.withColumn("wanted", wanted).withColumn("copies", F.floor("wanted")).withColumn("p", F.col("wanted") - F.col("copies"))
    extra = F.col("target") - F.sum(F.col("copies") * F.col("words")).over(whole)
    return groups.select("source", "digits", "copies", "p", extra.alias("extra_words"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", base: int = 8, carry: bool = False) -> DataFrame:
    """(id_col, source, size, source_size, target, copies) for every row of docs; copies may be 0.

    carry: return (row, copies) instead, row being a struct of all of docs' columns.
    """
    size = n_words(F.col(text_col))
    drawn = [F.col(source_col).alias("source"), F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"), size.alias("size"), F.length(F.bin(size)).alias("digits"), F.spark_partition_id().alias("part")]
    texts = materialise(docs.select(*drawn), "mix-texts")
    often = repeated(texts)
    sizes = materialise(with_numbers(texts, often).withColumn("u", random_bits(seed)).drop("part"), "mix-sizes")
    free(texts)
    targets = materialise(source_targets(sizes, weights, max_repeat), "mix-targets")
    groups = materialise(wanted_copies(sizes, targets, max_repeat, base), "mix-groups")

    def ranked(rows: DataFrame, facts: DataFrame) -> DataFrame:
        """rows with their group's copies and p, their source's facts, and their place in the Pareto order, null where p is 0."""
        #: A group a number of digits and source: few rows, but joined by size like any others.
        rows = rows.alias("d").join(groups.drop("extra_words").alias("g"), same("d", "g", ["source", "digits"]), "left").select("d.*", "copies", "p")
        rows = rows.alias("d").join(facts.alias("f"), same("d", "f", ["source"]), "left").select("d.*", *[f"f.{c}" for c in facts.columns if c != "source"])
        odds = (F.col("u") / (F.lit(float(2**BITS)) - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
        order = F.when(F.col("p") > 0, odds / (1 + odds))
        return rows.withColumn("order", order).withColumn("cell", F.floor(order * 2**CELL_BITS)).withColumn("place", F.when(F.col("p") > 0, F.struct("order", "u", "id", "digest", "nth")))

    extra = groups.groupBy("source").agg(F.max("extra_words").alias("extra_words"))
    first = materialise(ranked(sizes, extra).where("p > 0"), "mix-order")
    cells = first.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.max("extra_words").alias("extra_words"))
    cells = cells.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("cell")))
    #: The first cell that the extra words don't cover holds the cut.
    cuts = cells.where("upto > extra_words").groupBy("source").agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("words")).alias("before")), "cell").alias("cut"))
    facts = materialise(extra.alias("t").join(cuts.alias("k"), same("t", "k", ["source"]), "left").select("t.source", "t.extra_words", F.col("k.cut.cell").alias("cut_cell"), "k.cut.before"), "mix-cuts")
    inside = first.alias("d").join(facts.alias("f"), same("d", "f", ["source"]) & (F.col("d.cell") == F.col("f.cut_cell"))).select("d.*", "before")
    inside = inside.withColumn("through", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    #: The last row of the head, and the words that the head leaves missing.
    head = inside.where("through <= extra_words").groupBy("source").agg(F.max("place").alias("last"), F.max("through").alias("head_words"))
    facts2 = facts.alias("f").join(head.alias("h"), same("f", "h", ["source"]), "left").select("f.*", "last", (F.col("extra_words") - F.coalesce("head_words", "before")).alias("missing"))
    facts2 = materialise(facts2, "mix-head")
    in_head = (F.col("extra_words") > 0) & (F.col("cut_cell").isNull() | (F.col("cell") < F.col("cut_cell")) | ((F.col("cell") == F.col("cut_cell")) & F.coalesce(F.col("place") <= F.col("last"), F.lit(False))))
    gap = F.abs(F.col("size") - F.col("missing"))
    rest = first.drop("extra_words").alias("d").join(facts2.alias("f"), same("d", "f", ["source"])).select("d.*", *[f"f.{c}" for c in facts2.columns if c != "source"])
    closing = rest.where(~in_head & (gap < F.col("missing"))).groupBy("source").agg(F.min(F.struct(gap.alias("gap"), "place")).alias("closing"))
    facts3 = facts2.alias("f").join(closing.alias("c"), same("f", "c", ["source"]), "left").select("f.*", F.col("c.closing.place").alias("closes"))
    facts3 = materialise(targets.alias("t").join(facts3.alias("f"), same("t", "f", ["source"]), "left").select("t.*", *[f"f.{c}" for c in facts3.columns if c != "source"]), "mix-facts")
    free(first, facts, facts2)

    rows = with_numbers(docs.select(*drawn, F.struct(*docs.columns).alias("row")), often).withColumn("u", random_bits(seed)) if carry else sizes
    one_more = F.coalesce((F.col("p") > 0) & (in_head | F.coalesce(F.col("place") == F.col("closes"), F.lit(False))), F.lit(False))
    copies = (F.coalesce("copies", F.lit(0)) + one_more.cast("long")).alias("copies")
    found = ranked(rows, facts3)
    if carry:
        return found.select("row", copies)
    return found.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their source's size and target, and the words the mix takes of each."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH r AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id, digest) - 1 AS nth, length(bin(size)) AS digits FROM r),
d AS (SELECT *, ('0x' || substr(md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, ''), digest, nth::VARCHAR)), 1, 13))::BIGINT AS u FROM n),
s AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT source, ss, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w, (sum(ss) OVER ())::BIGINT AS total FROM s),
k AS (SELECT *, 3 * ss * sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
             <= w * (total - coalesce(sum(3 * ss) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS capped
      FROM w WINDOW r AS (ORDER BY ss::DOUBLE / w, source NULLS LAST)),
t AS (SELECT source, ss, CASE WHEN capped THEN (3 * ss)::DOUBLE ELSE
        (w * (total - sum(CASE WHEN capped THEN 3 * ss ELSE 0 END) OVER ())::BIGINT)::DOUBLE / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::BIGINT END AS target FROM k),
g AS (SELECT d.source, digits, target, sum(size)::BIGINT AS words, (digits + 8)::BIGINT AS w FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size > 0 GROUP BY ALL),
f AS (SELECT *, 3 * (sum(w * words) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT
             <= w * (target - 3 * coalesce((sum(words) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0)) AS is_full
      FROM g WINDOW r AS (PARTITION BY source ORDER BY digits DESC)),
e AS (SELECT *, CASE WHEN is_full THEN 3.0::DOUBLE ELSE w * ((target - 3 * (sum(CASE WHEN is_full THEN words ELSE 0 END) OVER (PARTITION BY source))::BIGINT)
             / (sum(CASE WHEN is_full THEN 0 ELSE w * words END) OVER (PARTITION BY source))::BIGINT::DOUBLE) END AS wanted FROM f),
c AS (SELECT *, floor(wanted)::BIGINT AS copies, wanted - floor(wanted) AS p, target - (sum(floor(wanted)::BIGINT * words) OVER (PARTITION BY source))::BIGINT AS extra FROM e),
q AS (SELECT d.*, t.ss, t.target, coalesce(c.copies, 0) AS copies, c.p, c.extra, (u / (4503599627370496.0::DOUBLE - u)) / (c.p / (1 - c.p)) AS odds
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.digits = c.digits AND d.size > 0),
o AS (SELECT *, coalesce(p > 0, false) AS drawn, CASE WHEN p > 0 THEN odds / (1 + odds) END AS place FROM q),
x AS (SELECT *, drawn AND extra > 0 AND sum(size) OVER (PARTITION BY source, drawn ORDER BY place, u, doc_id NULLS FIRST, digest, nth ROWS UNBOUNDED PRECEDING) <= extra AS in_head FROM o),
m AS (SELECT *, extra - coalesce(sum(CASE WHEN in_head THEN size END) OVER (PARTITION BY source), 0) AS missing FROM x),
z AS (SELECT *, drawn AND NOT in_head AND abs(size - missing) < missing AS may FROM m),
l AS (SELECT *, may AND row_number() OVER (PARTITION BY source, may ORDER BY abs(size - missing), place, u, doc_id NULLS FIRST, digest, nth) = 1 AS closes FROM z)
SELECT doc_id, size, ss AS source_size, target, (size * (copies + CASE WHEN in_head OR closes THEN 1 ELSE 0 END))::BIGINT AS taken FROM l
"""
