"""Near copies: SimHash proposes, the whole sets of word shingles decide.

A text is the set of hashes of its shingles of ``words`` words (one shingle
of all its words where it has fewer). Equal sets are one node.

1. A node's SimHash is taken over its distinct words, 192 bits of it. An
   edit that changes five shingles changes one word, so texts whose shingles
   have a Jaccard similarity of 0.8 differ in 4 of 64 bits on average, unlike
   texts in some 25. The first 64 bits are probed by the generalised
   pigeonhole of simhash.py, with radius ``k``; what meets in a bucket is
   linked if it is within k there and within ``far`` on the other 128 bits.
2. Components of these links gather what can be alike. Within a component
   every pair that is within both radii is compared on the whole sets, which
   are made again from the texts of those few: the intersection must be
   ``least`` of the union. Components of the verified links are the groups.

A pair of similarity 0.8 is missed with a chance of some 2 in 100 (its first
64 bits differ in more than 8); a copy with fewer edits hardly ever, and a
group's copies find each other by many ways. The rate does not move with the
size of the input, since no bucket is cut off: buckets and components of more
than ``block`` nodes are cut into blocks, and every pair of blocks meets in
one task. No links are emitted beyond a spanning forest of a task.

Defined results: null, empty and wordless texts have the empty set and are
alike; letters of ASCII are taken in lower case; equal texts are one row of
the result, so repeated rows are in one group; an empty table gives an empty
table; only the named column is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, join_small, materialise
from .graphs import components
from .simhash import allocate, bit_moments, in_blocks, signatures
from .words import batches_of, mixed, word_hashes

SALTS = np.array([0, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def digest_of(text: Column) -> Column:
    """What tells texts apart: 128 bits of the whole text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a sequence of word hashes."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : len(out) + k])
    return np.unique(out)


def majority(hashes: np.ndarray) -> list[int]:
    """The SimHash of a set of hashes as three signed longs."""
    if not len(hashes):
        return [0, 0, 0]
    x = mixed(hashes[:, None] ^ SALTS)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    counts = np.ones(len(x), np.float32) @ bits.astype(np.float32)
    return np.packbits(2 * counts > len(x), bitorder="little").view("<i8").tolist()


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(digest, word hashes) of each text."""
    for batch in batches:
        digests, at = batch["digest"].to_pylist(), 0
        for texts in batches_of([t.as_py() or b"" for t in batch["raw"]]):
            hashes, sizes = word_hashes(texts)
            for part in np.split(hashes, np.cumsum(sizes)[:-1]):
                yield digests[at], part
                at += 1


def marks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(digest, name of the set, three longs of SimHash)."""
    rows = []

    def out() -> pa.RecordBatch:
        kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["digest", "name", "fp", "w1", "w2"])

    for digest, found in texts_of(batches):
        rows.append((digest, xxhash.xxh128_digest(shingles(found, words).tobytes()), *majority(np.unique(found))))
        if len(rows) == 4096:
            yield out()
            rows = []
    yield out()


def sets_of(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for digest, found in texts_of(batches):
        yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([shingles(found, words).tobytes()], pa.binary())], ["digest", "hashes"])


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def pairs_in_runs(g: np.ndarray, fps: np.ndarray, k: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of equal g (rows come sorted by it) that are within both radii, every distance in the run at a time."""
    ends = np.searchsorted(g, g, side="right")
    left, right, at = [], [], np.arange(len(g))
    for step in range(1, int((ends - at).max(initial=1))):
        at = at[at + step < ends[at]]
        near = at[np.bitwise_count(fps[at, 0] ^ fps[at + step, 0]) <= k]
        near = near[np.bitwise_count(fps[near, 1:] ^ fps[near + step, 1:]).sum(axis=1) <= far]
        left.append(near)
        right.append(near + step)
    return np.concatenate(left or [at[:0]]), np.concatenate(right or [at[:0]])


def forest(nodes: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], sets: list[np.ndarray] | None, least: float) -> tuple[list[int], list[int]]:
    """Edges that span what the pairs link; with sets, of the pairs that are alike."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    a, b = [], []
    for i, j in zip(*(p.tolist() for p in pairs), strict=True):
        x, y = find(i), find(j)
        if x != y and (sets is None or alike(sets[i], sets[j], least)):
            root[max(x, y)] = min(x, y)
            a.append(int(nodes[i]))
            b.append(int(nodes[j]))
    return a, b


def links_in_runs(batches: Iterator[pa.RecordBatch], k: int, far: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows (g, node, fp, w1, w2[, hashes]) come sorted by g; edges within each g go."""
    rows, sets = np.zeros((0, 5), np.int64), None

    def done(upto: int) -> pa.RecordBatch:
        nonlocal rows, sets
        now, rows = rows[:upto], rows[upto:]
        mine, sets = (None, None) if sets is None else (sets[:upto], sets[upto:])
        edges = forest(now[:, 1], pairs_in_runs(now[:, 0], now[:, 2:].view(np.uint64), k, far), mine, least)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in edges], ["a", "b"])

    for batch in batches:
        new = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("g", "node", "fp", "w1", "w2")], axis=1)
        rows = np.concatenate([rows, new])
        if "hashes" in batch.schema.names:
            sets = (sets or []) + [np.frombuffer(x.as_py(), np.uint64) for x in batch["hashes"]]
        if len(rows):
            yield done(int(np.searchsorted(rows[:, 0], rows[-1, 0])))
    yield done(len(rows))


def meet(rows: DataFrame, key: str, data: DataFrame, block: int, **how) -> DataFrame:
    """(a, b): links between the nodes of rows (key, node) that share a key; data holds a node's columns."""
    rows = in_blocks(rows, key, "node", block).join(data.hint("merge"), "node").select("g", "node", *[c for c in data.columns if c != "node"])
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(partial(links_in_runs, **how), "a long, b long").distinct()


def near_copies(docs: DataFrame, text_col: str = "text", words: int = 5, least: float = 0.8, k: int = 8, far: int = 28, block: int = 1024) -> DataFrame:
    """(digest, group) for every distinct text of docs, digest being digest_of() it: texts that are linked share a group."""
    how = {"k": k, "far": far, "least": least}
    texts = docs.select(digest_of(F.col(text_col)).alias("digest"), F.col(text_col).cast("binary").alias("raw"))
    marked = materialise(texts.mapInArrow(partial(marks, words=words), "digest binary, name binary, fp long, w1 long, w2 long"), "near-marks")
    nodes = marked.groupBy("name").agg(*[F.first(c).alias(c) for c in ("fp", "w1", "w2")], F.min("digest").alias("digest"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    #: Pairs of a run are compared all at once, so they cost less here; below a million nodes the plan does not move.
    plan = allocate(*bit_moments(nodes.select("fp")), k, at_least=1 << 20, pair_cost=0.002)
    points = nodes.select("node", "fp", "w1", "w2")
    probes = nodes.select("node", F.explode(signatures(plan)).alias("key")) if plan else nodes.select("node", F.col("node").alias("key")).limit(0)
    maybe = materialise(components(meet(probes, "key", points, block, **how)), "near-maybe")
    some = nodes.select("node", "digest").join(maybe.select("node"), "node", "left_semi")
    #: The texts of those few again, one of each.
    again = join_small(texts, some.select("digest"), "digest", "left_semi", row_bytes=144).groupBy("digest").agg(F.first("raw").alias("raw"))
    sets = again.select("digest", "raw").mapInArrow(partial(sets_of, words=words), "digest binary, hashes binary").join(some, "digest")
    sets = materialise(sets.select("node", "hashes"), "near-sets")
    links = meet(maybe.select("root", "node"), "root", points.join(sets, "node"), max(2, block // 4), **how)
    roots = components(links)
    found = nodes.select("name", "node").join(roots, "node", "left").select("name", F.coalesce("root", "node").alias("group"))
    found = materialise(marked.select("digest", "name").distinct().join(found, "name").select("digest", "group"), "near-groups")
    free(marked, nodes, maybe, sets)
    return found
