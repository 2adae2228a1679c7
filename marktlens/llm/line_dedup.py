r"""Line dedup: a suffix array over line ids, built by distributed prefix doubling.

The corpus is a set of sequences of line ids (lines without a word are left
out). A line that occurs once ends every repeat, so only repeated lines are
kept, as segments of consecutive positions. Rank 0 of a position is the order
of its line's id; in round l the pairs (rank of i, rank of i + 2^l, least at a
segment's end) are sorted over all tasks (range partitions, then an increasing
id). The last ranks give the order of all suffixes by as many lines as the
longest run needs that is looked for, at most ``min_words``; what is equal to
that depth shares a rank.

A repeated run counts from ``min_words`` words: a suffix's shortest run of so
many words, and a position's shortest run up to it (for the last lines of a
maximal run). Such a run, a suffix and a number of lines, belongs to a
longest-common-prefix interval: the stretch of the suffix array around it
whose neighbours share that many lines. So the suffixes that share the first
2^l lines of a run (2^l at most its lines) are taken in the array's order,
one row for each rank; the longest common prefix of each with the one before
is found, and where it falls short a new interval begins. The union of the
intervals' runs is what the maximal repeated runs cover. Of each interval all
but the first occurrence, by document id and place, are later copies, and
their lines are deleted.

No group of positions is gathered: they are counted and their first
occurrences found by pre-aggregated groups, a row a rank, and joined back
(adaptive execution splits the joins of very common lines). What is ordered in
one window are distinct continuations of one shared beginning, not their
occurrences. What one document's windows hold is its own lines.

A run may overlap its first occurrence: a line repeated over and over stays once.

Defined results: null and empty texts stay as they are, as does a text of
which nothing is deleted; a text of which no line with a word is left becomes
empty; repeated rows (equal id and text) are one document and get equal
results; rows of equal id and different texts are different documents,
ordered by a hash of the text; a null id comes first; an empty table gives an
empty table; further columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, free, materialise, n_words, table

KEY = ["__given", "__doc", "__th"]


def key_columns(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """A document's key without nulls; rows without an id come first."""
    x = F.col(id_col)
    return [x.isNotNull().alias(KEY[0]), F.coalesce(x, F.lit(0).cast(docs.schema[id_col].dataType)).alias(KEY[1]), F.xxhash64(text_col).alias(KEY[2])]


def worded_lines(text: Column) -> Column:
    """The lines that have a word, as array<struct<i, line>>."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    return F.filter(lines, lambda s: s["line"].rlike(WORD))


def ranked(keys: DataFrame, *cols: str) -> DataFrame:
    """keys (distinct) with rank: increasing over all tasks in the order of cols."""
    rows = keys.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("rank", F.monotonically_increasing_id())
    return materialise(rows, "lines-ranks")


def repeated_positions(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(KEY, seq, segment, forward, backward, r0) of the repeated lines.

    seq counts a document's worded lines. forward / backward: the number of
    lines of the shortest run of min_words words from / up to this line,
    inside a segment of repeated lines; null if the segment is too short.
    """
    rows = docs.select(*key_columns(docs, id_col, text_col), F.posexplode(worded_lines(F.col(text_col))).alias("seq", "s"))
    rows = rows.select(*KEY, "seq", F.unhex(F.md5("s.line")).alias("line"), n_words(F.col("s.line")).alias("w"))
    lines = materialise(rows.repartition(*KEY).dropDuplicates([*KEY, "seq"]), "lines")
    common = ranked(lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "line")
    rows = lines.join(common, "line").drop("line").withColumnRenamed("rank", "r0")
    by_seq = Window.partitionBy(*KEY).orderBy("seq")
    rows = rows.withColumn("segment", F.col("seq") - F.row_number().over(by_seq))
    segment = Window.partitionBy(*KEY, "segment")
    rows = rows.withColumn("end", F.sum("w").over(segment.orderBy("seq"))).withColumn("start", F.col("end") - F.col("w"))
    ahead, back = segment.orderBy("start").rangeBetween(0, min_words - 1), segment.orderBy("end").rangeBetween(1 - min_words, 0)
    size = lambda w: F.when(F.sum("w").over(w) >= min_words, F.count("*").over(w).cast("int"))
    found = materialise(rows.withColumn("forward", size(ahead)).withColumn("backward", size(back)).select(*KEY, "seq", "segment", "forward", "backward", "r0"), "lines-repeated")
    free(lines, common)
    return found


#: A document's repeated lines that follow one another.
ALONG = [*KEY, "segment"]


def doubled(rows: DataFrame, level: int) -> DataFrame:
    """One round of prefix doubling: adds r(level + 1), the rank of the prefix of 2^(level + 1) lines among all suffixes."""
    old, new = f"r{level}", f"r{level + 1}"
    there = F.coalesce(F.lead(old, 2**level).over(Window.partitionBy(*ALONG).orderBy("seq")), F.lit(-1))
    given, rows = rows, materialise(rows.withColumn("there", there), "lines-pairs")
    order = ranked(rows.select(old, "there").distinct(), old, "there")
    out = materialise(rows.join(order.withColumnRenamed("rank", new), [old, "there"]).drop("there"), "lines-round")
    free(given, rows, order)
    return out


def common_prefix(x: Column, y: Column) -> Column:
    """How many elements two arrays share from the beginning."""
    differ = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
    return F.when(differ == 0, F.least(F.size(x), F.size(y))).otherwise(differ - 1)


def lcp_intervals(runs: DataFrame) -> DataFrame:
    """(head, lines, top, first): to which first occurrence the runs (a suffix's ranks head and top, its lines, their ids) of each interval of two or more go back."""
    suffixes = runs.groupBy("head", "lines", "top").agg(F.first("ids").alias("ids"), F.count("*").alias("n"), F.min(F.struct(*KEY, "seq")).alias("first"))
    array = Window.partitionBy("head", "lines").orderBy("top")
    shared = common_prefix(F.lag("ids").over(array), F.col("ids"))
    suffixes = suffixes.withColumn("begins", F.coalesce(shared < F.col("lines"), F.lit(True)))
    suffixes = suffixes.withColumn("interval", F.count_if("begins").over(array)).drop("ids", "begins")
    whole = Window.partitionBy("head", "lines", "interval")
    suffixes = suffixes.withColumn("all", F.sum("n").over(whole)).withColumn("first", F.min("first").over(whole))
    return suffixes.where(F.col("all") > 1).select("head", "lines", "top", "first")


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """(KEY, gone): the worded lines, by number, of each document that later copies of repeated runs cover."""
    rows = repeated_positions(docs, id_col, text_col, min_words)
    longest = rows.agg(F.max(F.greatest("forward", "backward"))).first()[0] or 1
    rounds = (longest - 1).bit_length()
    for level in range(rounds):
        rows = doubled(rows, level)
    ahead = rows.where("forward is not null").select(*KEY, "seq", F.col("forward").alias("lines"))
    back = rows.where("backward is not null").select(*KEY, (F.col("seq") - F.col("backward") + 1).alias("seq"), F.col("backward").alias("lines"))
    ids = F.collect_list("r0").over(Window.partitionBy(*ALONG).orderBy("seq").rowsBetween(0, longest - 1))
    at = rows.select(*KEY, "seq", ids.alias("ids"), F.array(*[f"r{n}" for n in range(rounds + 1)]).alias("ranks"))
    runs = ahead.unionByName(back).distinct().join(at, [*KEY, "seq"])
    head = F.get("ranks", F.length(F.bin("lines")) - 1)
    runs = runs.select(*KEY, "seq", "lines", head.alias("head"), F.element_at("ranks", -1).alias("top"), F.slice("ids", F.lit(1), F.col("lines")).alias("ids"))
    runs = materialise(runs, "lines-runs")
    intervals = materialise(lcp_intervals(runs), "lines-intervals")
    copies = runs.join(intervals, ["head", "lines", "top"]).where(F.struct(*KEY, "seq") != F.col("first"))
    gone = copies.groupBy(*KEY).agg(F.collect_set(F.struct("seq", "lines")).alias("runs"))
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["seq"], r["seq"] + r["lines"] - 1))))
    found = materialise(gone.select(*KEY, covered.alias("gone")), "lines-gone")
    free(rows, runs, intervals)
    return found


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, deleted_col: str = "__deleted") -> DataFrame:
    """docs with the lines of later copies deleted from the text, and deleted_col, their number, last (one of that name is replaced)."""
    gone = later_copies(docs, id_col, text_col, min_words)
    #: A merge join at any size: what is deleted grows with the corpus, so it is never broadcast.
    rows = docs.select(F.struct(*docs.columns).alias("d"), *key_columns(docs, id_col, text_col)).join(gone.hint("merge").alias("g"), KEY, "left")
    text = F.col(f"d.{text_col}")
    numbers = F.transform(worded_lines(text), lambda s: s["i"])
    dead = F.transform("g.gone", lambda s: F.get(numbers, s))
    lines = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dead)
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    new = F.when(F.col("g.gone").isNull(), text).otherwise(F.when(F.size("g.gone") == F.size(numbers), F.lit("")).otherwise(kept))
    columns = [new.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns if c.lower() != deleted_col.lower()]
    return rows.select(*columns, F.coalesce(F.size("g.gone"), F.lit(0)).alias(deleted_col))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without later copies of repeated runs of 50 words or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, deleted_col="n_deleted")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
      FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY seq) AS upto FROM l),
r AS (SELECT a.doc_id, a.seq AS s, b.seq AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.seq >= a.seq AND b.upto - a.upto + a.w >= 50
        AND (b.upto - b.w - a.upto + a.w < 50 OR b.upto - a.upto < 50)),
t AS (SELECT r.doc_id, r.s, r.e, string_agg(c.line, chr(10) ORDER BY c.seq) AS run FROM r JOIN c ON c.doc_id = r.doc_id AND c.seq BETWEEN r.s AND r.e GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS nth FROM t),
g AS (SELECT DISTINCT c.doc_id, c.seq, c.i FROM c JOIN f ON f.nth > 1 AND c.doc_id = f.doc_id AND c.seq BETWEEN f.s AND f.e),
k AS (SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.i) AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i WHERE g.i IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS gone FROM g GROUP BY 1), m AS (SELECT doc_id, count(*) AS all_lines FROM l GROUP BY 1)
SELECT d.doc_id, CASE WHEN n.gone IS NULL THEN d.text WHEN n.gone = m.all_lines THEN '' ELSE k.kept END AS text, coalesce(n.gone, 0)::INTEGER AS n_deleted
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
"""
