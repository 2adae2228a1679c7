"""SimHash near-duplicates by the generalised pigeonhole principle (Qin et al. 2018).

The 64 bits are dealt into m parts, correlated bits into the same part. If
two fingerprints differ in k bits or fewer, then for any thresholds t_i >= -1
with sum(t_i) = k - m + 1 there is a part i in which they differ in t_i bits
or fewer. m and the thresholds are chosen by dynamic programming over the
estimated number of signatures and candidates of each part and threshold; a
part with threshold -1 is never probed. A part's signatures are its bits with
t_i of them left out, in every way; fingerprints that share a signature are
verified on all 64 bits.

Only distinct fingerprints are probed. A bucket of more than ``block``
fingerprints is cut into blocks, and pairs of blocks are dealt out, so no
task holds more than two blocks of one bucket; within a task only the edges
of a spanning forest are emitted, never all pairs.

Defined results: a null or empty text, and one of white space only, has
fingerprint 0, linked like any other; repeated rows and copies share a
fingerprint and so a component; null ids get their component's smallest
id; a component without any id has a null; an empty table gives an empty
table; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .graphs import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A byte's bits, each in a byte of its own.
LANES = np.array([sum((b >> i & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)
#: Costs of one signature row and one verified candidate, in the same unit.
ROW_COST, PAIR_COST = 1.0, 0.01


def fingerprint(raw: bytes, words: int) -> int:
    """The SimHash of a text's word shingles; XXH64 with seed 42, as Spark's xxhash64."""
    parts = raw.translate(LOWER).split()
    if not parts:
        return 0
    text, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ends = ends.tolist()[words - 1 :] if len(parts) >= words else [len(text)]
    hashes = np.array([digest(text[a:b], 42) for a, b in zip(starts, ends)], dtype="<u8")  # noqa: B905
    lanes = np.add.reduceat(LANES[hashes.view(np.uint8)].reshape(n, 8), np.arange(0, n, 255), axis=0)
    counts = lanes.astype("<u8").view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): one row per row of docs; fp as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x or b"", words) for x in (v.as_py() for v in batch["raw"])), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw"))
    return rows.mapInArrow(each, "id long, fp long")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """n, and how often each pair of bits is set together: 64 x 64 numbers, however many rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            values = batch["fp"].to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(values), 1 << 16):
                bits = np.unpackbits(values[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.float32)
                total += bits.T @ bits
            n += len(values)
        yield pa.RecordBatch.from_arrays([pa.array(range(64 * 64 + 1), pa.int32()), pa.array([*total.ravel(), float(n)])], ["cell", "sum"])

    cells = fps.mapInArrow(count, "cell int, sum double").groupBy("cell").agg(F.sum("sum").alias("sum")).toArrow().sort_by("cell")
    if not cells.num_rows:
        return 0, np.zeros((64, 64))
    sums = cells["sum"].to_numpy()
    return int(sums[-1]), sums[:-1].reshape(64, 64)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Deal 64 bits into parts of nearly equal size, each grown around the bit most correlated with it."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    likeness = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, out = list(range(64)), []
    for i in range(parts):
        size = len(free) // (parts - i)
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (likeness[b, group].max(), -b))
            free.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def within(p: np.ndarray, t: int) -> float:
    """The chance that two fingerprints differ in t bits or fewer, for bits set with chances p."""
    differ = [1.0]
    for q in 2 * p * (1 - p):
        differ = [a * (1 - q) + b * q for a, b in zip([*differ, 0.0], [0.0, *differ])]  # noqa: B905
    return sum(differ[: t + 1])


def allocate(n: int, together: np.ndarray, k: int, at_least: int = 1, pair_cost: float = PAIR_COST) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part, at the least estimated cost over all numbers of parts.

    Fewer than at_least fingerprints get the plan of so many; an empty table too needs a plan of few signatures.
    """
    p = np.diag(together) / max(n, 1)
    together, n = together * (max(n, at_least) / max(n, 1)), max(n, at_least)
    best = (math.inf, [])
    for m in range(1, k + 2):
        groups, total = group_bits(n, together, m), k - m + 1
        #: Least cost of the first parts with thresholds that sum to s; -1 skips a part.
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            after: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, chosen) in state.items():
                for t in range(-1, min(len(g), total + m) + 1):
                    here = 0.0 if t < 0 else ROW_COST * n * math.comb(len(g), t) + pair_cost * n * n / 2 * within(p[g], t)
                    if cost + here < after.get(s + t, (math.inf,))[0]:
                        after[s + t] = (cost + here, [*chosen, t])
            state = after
        if total in state and state[total][0] < best[0]:
            best = (state[total][0], list(zip(groups, state[total][1])))  # noqa: B905
    return best[1]


def signatures(plan: list[tuple[list[int], int]]) -> Column:
    """The signatures of column fp as an array of longs: part and left-out bits hashed with the value."""
    out = []
    for i, (bits, t) in enumerate(plan):
        if t >= 0:
            for left_out in combinations(bits, t):
                mask = sum(1 << b for b in bits if b not in left_out)
                mask = mask - (1 << 64) if mask >> 63 else mask
                out.append(F.xxhash64(F.lit(i), F.lit(mask), F.col("fp").bitwiseAND(F.lit(mask))))
    return F.array(*out)


def forest(fps: np.ndarray, groups: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links inside each run of equal groups."""
    left, right = [], []
    bounds = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
    sizes = np.diff(bounds)
    for a, size in zip(bounds[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist()):  # noqa: B905
        rest = np.unique(fps[a : a + size])
        while len(rest) > 1:  # breadth first: each popped value is held against what is unreached yet
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                x = front.pop()
                near = np.bitwise_count(rest ^ x) <= k
                if near.any():
                    new = rest[near]
                    left += [int(x)] * len(new)
                    right += new.tolist()
                    front += list(new)
                    rest = rest[~near]
    return left, right


def links_in_runs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (g, fp) come sorted by g; edges within each g go."""
    kept_g, kept_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def done(g: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = forest(fp, g, k)
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

    for batch in batches:
        kept_g = np.concatenate([kept_g, batch["g"].to_numpy(zero_copy_only=False)])
        kept_fp = np.concatenate([kept_fp, batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)])
        if len(kept_g):
            whole = int(np.searchsorted(kept_g, kept_g[-1]))
            yield done(kept_g[:whole], kept_fp[:whole])
            kept_g, kept_fp = kept_g[whole:], kept_fp[whole:]
    yield done(kept_g, kept_fp)


def in_blocks(rows: DataFrame, key: str, of: str, block: int) -> DataFrame:
    """(g, of): rows (key, of) dealt so that all rows of a key meet in some g.

    Buckets of one need no look; large ones are cut into blocks by a hash and
    every pair of blocks meets, so no g has more than two blocks. Spark takes
    exploded rows for as many as there were before, so it would broadcast
    millions of keys: the join is by shuffle, whatever it expects.
    """
    full = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    rows = rows.join(full.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n").hint("merge"), key)
    mine = F.pmod(F.xxhash64(F.lit("block"), of), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("mine")))
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(others))
    return rows.select(F.xxhash64(key, F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), of)


def link(fps: DataFrame, k: int = 4, block: int = 1024) -> DataFrame:
    """(a, b): spanning edges between distinct fingerprints that differ in k bits or fewer. fps: a column fp, distinct."""
    plan = allocate(*bit_moments(fps), k)
    if not plan:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    rows = fps.select("fp", F.explode(signatures(plan)).alias("key"))
    rows = in_blocks(rows, "key", "fp", block)
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(partial(links_in_runs, k=k), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, k: int = 4) -> DataFrame:
    """(id_col, fp, component): fp a signed long, component the smallest id reachable over links."""
    marked = materialise(fingerprints(docs, id_col, text_col, words), "simhash")
    firsts = materialise(marked.groupBy("fp").agg(F.min("id").alias("first")), "simhash-firsts")
    roots = components(link(firsts.select("fp"), k))
    smallest = firsts.join(roots, F.col("fp") == F.col("node")).groupBy("root").agg(F.min("first").alias("least"))
    found = roots.join(smallest, "root").select(F.col("node").alias("fp"), "least")
    found = materialise(firsts.join(found, "fp", "left").select("fp", F.coalesce("least", "first").alias("component")), "simhash-components")
    return marked.join(found, "fp").select(F.col("id").alias(id_col), "fp", "component")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
