"""URL filters: path rules, and a domain list held as a Bloom filter cascade.

The cascade is exact for every key of the corpus without a join: level 0
encodes the listed keys; level 1 the unlisted keys of the corpus's complete
key universe that pass level 0; level 2 the listed keys that pass level 1,
and so on until nothing passes wrongly. The false-positive rate of level 0
is set to about listed / universe, so all levels together take a few bits a
listed key, whatever the universe's size. A level larger than
``max_level_bytes`` is never built: keys are then dealt by hash into as many
shards as needed, each with a cascade of its own, applied one after the other.

A url's keys are its host's suffixes with as many labels as the longest
listed key at most (longer ones cannot be listed), and host + path.

Defined results: a null url, or one without ``://``, has empty host and path,
no keys, and the verdict allow; an empty table or list works; repeated rows
stay; further columns stay, but for those that have a result's name, which the
result replaces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, materialise, table, unused

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Blocked domains, subdomains included.
LISTED = tuple(f"{name}.example.{top}" for name in ("spam-farm", "cheap-pills", "casino-win", "adult-x") for top in ("com", "net", "org"))
#: Columns that judge_urls() adds.
RESULT = ("host", "path", "rule", "listed", "verdict")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host + path, its verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def keys_of(host: Column, path: Column, labels: int) -> Column:
    """The keys under which a url may be listed."""
    parts = F.split(host, r"\.")
    tail = lambda n: F.array_join(F.slice(parts, -n, n), ".")
    suffixes = [F.when(F.size(parts) >= n, tail(n)) for n in range(1, labels + 1)]
    return F.array_distinct(F.filter(F.array(*suffixes, F.concat(host, path)), lambda k: k.isNotNull() & (k != "")))


def seed(level: int, which: str) -> str:
    return f"{which}{level}"


class Cascade:
    """Levels of (bits, hashes, bitmap); level n encodes what level n - 1 passes wrongly."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, int, np.ndarray]] = []

    def bytes(self) -> int:
        return sum(b.nbytes for _, _, b in self.levels)

    def __contains__(self, key: str) -> bool:
        raw = key.encode()
        for n, (bits, hashes, words) in enumerate(self.levels):
            a, b = (xxhash.xxh64_intdigest(raw, xxhash.xxh64_intdigest(seed(n, w), 42)) for w in "ab")
            for i in range(hashes):
                at = ((a & 0x7FFFFFFF) + i * (b & 0x7FFFFFFF)) % bits
                if not words[at >> 6] >> (at & 63) & 1:
                    return n % 2 == 1
        return len(self.levels) % 2 == 1


def positions(level: int, bits: int, hashes: int) -> Column:
    """The bits of a key, as Cascade reads them."""
    low = lambda w: F.xxhash64(F.lit(seed(level, w)), F.col("key")).bitwiseAND(0x7FFFFFFF)
    return F.array(*[(low("a") + i * low("b")) % bits for i in range(hashes)])


def shape(n: int, rate: float) -> tuple[int, int]:
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / n * math.log(2)))


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """listed, universe: one column key, distinct. All levels are exact over universe."""
    out, level = Cascade(), 0
    inside = materialise(listed, "url-listed")
    outside = materialise(universe.join(listed, "key", "left_anti"), "url-universe")
    n_in, n_out = inside.count(), outside.count()
    rate = min(0.5, math.sqrt(0.5) * max(n_in, 1) / max(n_out, 1))
    while n_in:
        bits, hashes = shape(n_in, rate)
        at = F.explode(positions(level, bits, hashes))
        rows = inside.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        words = np.zeros((bits + 63) // 64, dtype=np.uint64)
        got = rows.toArrow()  # at most bits / 64 rows
        words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
        out.levels.append((bits, hashes, words))
        held = outside.sparkSession.sparkContext.broadcast((bits, hashes, words))

        def passing(batches: Iterator[pa.RecordBatch], level=level, held=held) -> Iterator[pa.RecordBatch]:
            only = Cascade()
            only.levels = [(1, 0, np.zeros(1, np.uint64))] * level + [held.value]
            for batch in batches:
                yield batch.filter(pa.array([(k in only) == (level % 2 == 0) for k in batch["key"].to_pylist()], pa.bool_()))

        passed = materialise(outside.mapInArrow(passing, "key string"), "url-level")
        free(outside)
        inside, outside, n_in, rate, level = passed, inside, passed.count(), 0.5, level + 1
    free(inside, outside)
    return out


def any_listed(held):
    """A column function: is one of the keys in the broadcast cascade?"""

    def judge(keys: pa.Array) -> pa.Array:
        known: dict[str, bool] = {}
        cascade = held.value

        def is_in(key: str) -> bool:
            if key not in known:
                known[key] = key in cascade
            return known[key]

        return pa.array([any(map(is_in, each)) for each in keys.to_pylist()], pa.bool_())

    return F.arrow_udf(judge, "boolean")


def judge_urls(pages: DataFrame, listed: DataFrame, url_col: str = "url", rules=RULES, max_level_bytes: int = 8 << 20) -> DataFrame:
    """pages with host, path, rule, verdict and listed added. listed: a column key of domains or host + path.

    Verdict: the longest rule's; without one, block if a key is listed, else allow.
    """
    spark = pages.sparkSession
    listed = listed.select("key").where("key <> ''").distinct()
    size = listed.agg(F.count("*"), F.coalesce(F.max(F.size(F.split("key", r"\."))), F.lit(0))).first()
    labels = size[1]
    taken = {c.lower() for c in RESULT} - {url_col.lower()}
    base = pages.drop(*(c for c in pages.columns if c.lower() in taken))
    base = base.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    rule, judged = longest_rule(F.col("host"), F.col("path"), rules)
    says, keys = unused("__says", base.columns), unused("__keys", base.columns)
    base = base.withColumns({"rule": rule, says: judged, keys: keys_of(F.col("host"), F.col("path"), labels)})
    universe = materialise(
        pages.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).select(F.explode(keys_of(F.col("host"), F.col("path"), labels)).alias("key")).distinct(), "url-keys"
    )
    #: Level 0 takes 1.44 log2(universe / listed) + 1 bits a listed key; 64 bits are never reached.
    shards = max(1, math.ceil(size[0] * 64 / 8 / max_level_bytes))
    shard = lambda k: F.pmod(F.xxhash64(F.lit("shard"), k), F.lit(shards))
    in_shard = lambda n: lambda k: shard(k) == n
    hit = F.lit(False)
    for n in range(shards):
        held = spark.sparkContext.broadcast(build_cascade(listed.where(shard(F.col("key")) == n), universe.where(shard(F.col("key")) == n)))

        mine = F.col(keys) if shards == 1 else F.filter(keys, in_shard(n))
        hit = hit | any_listed(held)(mine)
    free(universe)
    return base.withColumn("listed", hit).withColumn("verdict", F.coalesce(says, F.when(F.col("listed"), "block").otherwise("allow"))).drop(says, keys)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    listed = spark.createDataFrame([(k,) for k in LISTED], "key string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, p) AS (VALUES {", ".join(str(r) for r in RULES)}),
k(key) AS (VALUES {", ".join(f"('{k}')" for k in LISTED)}),
m AS (SELECT u.page_id, u.host, u.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS says
      FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY ALL)
SELECT page_id, host, path, rule,
       coalesce(says, CASE WHEN EXISTS (SELECT 1 FROM k WHERE m.host = k.key OR ends_with(m.host, '.' || k.key)) THEN 'block' ELSE 'allow' END) AS verdict
FROM m
"""
