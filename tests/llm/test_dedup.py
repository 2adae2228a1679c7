"""Line dedup and SimHash near-dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from marktlens.llm import common, graphs, line_dedup, near_copies, simhash
from marktlens.llm.graphs import components

DOCS = "doc_id long, text string"


def brute_lines(docs, least):
    """Delete every worded line inside a run of least words or more that occurs before, in order of document and place."""
    seqs = []
    for n, (doc, text) in enumerate(docs):
        seqs.append([(i, line) for i, line in enumerate(text.split("\n")) if line.split()])
    gone = set()
    starts = [(d, i) for d, s in enumerate(seqs) for i in range(len(s))]
    for x, (d, i) in enumerate(starts):
        for e, j in starts[:x]:
            n = 0
            while i + n < len(seqs[d]) and j + n < len(seqs[e]) and seqs[d][i + n][1] == seqs[e][j + n][1]:
                n += 1
            if sum(len(seqs[d][i + k][1].split()) for k in range(n)) >= least:
                gone |= {(d, seqs[d][i + k][0]) for k in range(n)}
    out = {}
    for d, (doc, text) in enumerate(docs):
        mine = {i for e, i in gone if e == d}
        kept = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in mine)
        out[doc] = text if not mine else kept if kept.split() else ""
    return out


@pytest.mark.parametrize("seed,least", [(1, 6), (2, 9), (3, 14)])
def test_lines_against_brute_force(spark, seed, least):
    rng = random.Random(seed)
    words = ["a b c", "d", "e f", "", "  ", "g h i j", "k"]
    docs = [(i, "\n".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(14)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS), min_words=least).collect()}
    assert got == brute_lines(docs, least)


def test_lines_edges(spark):
    passage = "\n".join(f"line {i} of a passage that is long enough" for i in range(8))
    docs = [(1, "x\n" + passage + "\ny", 7), (2, passage + "\nz", 7), (3, None, 7), (4, "", 7), (None, "w\n" + passage, 7), (5, "clean text", 7), (2, passage + "\nz", 7)]
    frame = spark.createDataFrame(docs, DOCS + ", __doc long")
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(frame).collect()), key=str)
    assert got == sorted([(1, "x\ny"), (2, "z"), (2, "z"), (3, None), (4, ""), (None, "w\n" + passage), (5, "clean text")], key=str)
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    long = "\n".join(["same words here"] * 3000)
    assert line_dedup.dedup_lines(spark.createDataFrame([(1, long)], DOCS)).first().text.count("same") == 1


def brute_fingerprint(text, n=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "one", "One Two", "a b c d", "É é\ta\nb  c d e f " * 300, " \n"])
def test_fingerprint(spark, text):
    assert simhash.fingerprint((text or "").encode(), 4) == brute_fingerprint(text)
    if text and len(text.split()) < 5:
        joined = " ".join(simhash.LOWER and text.encode().translate(simhash.LOWER).decode().split())
        assert spark.sql("SELECT 1").select(F.xxhash64(F.lit(joined))).first()[0] == simhash.fingerprint(text.encode(), 4) - (1 << 64 if simhash.fingerprint(text.encode(), 4) >> 63 else 0) or not text.split()


def brute_components(values, k):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= k:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("block", [1024, 8])
def test_links_against_all_pairs(spark, block):
    rng = random.Random(block)
    values = {rng.getrandbits(64) for _ in range(60)}
    for seed in list(values)[:10]:
        for _ in range(12):
            seed ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            values.add(seed)
    values = sorted(values)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    edges = simhash.link(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, block).collect()
    unsigned = lambda x: x % (1 << 64)
    assert all((unsigned(e.a) ^ unsigned(e.b)).bit_count() <= 4 for e in edges)
    want = brute_components(values, 4)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for e in edges:
        root[find(unsigned(e.a))] = find(unsigned(e.b))
    assert {frozenset(v for v in values if find(v) == find(u)) for u in values} == {frozenset(v for v in values if want[v] == want[u]) for u in values}


def test_allocation_is_complete():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (500, 64)).astype(float)
    bits[:, 5] = bits[:, 40]
    for k in (0, 3, 4, 6):
        plan = simhash.allocate(10**6, bits.T @ bits * 2000, k)
        assert sorted(b for g, _ in plan for b in g) == list(range(64)) and sum(t for _, t in plan) == k - len(plan) + 1
    assert any({5, 40} <= set(g) for g in simhash.group_bits(500, bits.T @ bits, 4))


def test_near_duplicates(spark):
    rng = random.Random(9)
    base = " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"], k=400))
    docs = [(5, base), (3, base), (9, base + " tail"), (7, "quite another text with words of its own"), (2, None), (1, "  "), (4, ""), (None, base), (3, base)]
    got = {(r.doc_id, r.component) for r in simhash.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()}
    assert {(5, 3), (3, 3), (None, 3), (7, 7), (2, 1), (1, 1), (4, 1)} <= got
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (7, 6), (6, 3)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 1, 7: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(31)}


def test_few_edges_are_written_twice_and_agree_with_rounds(spark, monkeypatch):
    """The rounds write the edges again and again, at a dozen shuffles a time; few edges take one task."""
    written, rng = [], random.Random(5)
    monkeypatch.setattr(graphs, "materialise", lambda df, what: written.append(what) or common.materialise(df, what))
    pairs = [(rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(280)] + [(2**62 + i, 2**62 + i + 1) for i in range(40)]
    edges = spark.createDataFrame([*pairs, (-7, -7)], "a long, b long").repartition(5)
    got = sorted(map(tuple, components(edges).collect()))
    assert len(written) == 2
    assert got == sorted(map(tuple, components(edges, few=0).collect()))
    assert len(written) > 5
    root = {n: n for p in pairs for n in p if p[0] != p[1]}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert dict(got) == root
    assert components(edges.limit(0)).count() == 0


def five_words(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


@pytest.mark.parametrize("block", [12])
def test_near_copies_against_all_pairs(spark, block):
    """Copies with more and more words replaced, across similarity 0.8; every pair is held against the exact rule."""
    rng = random.Random(block)
    docs, n = [(90_001, None), (90_002, " "), (90_003, "One two"), (90_004, "one TWO")], 0
    for _ in range(30):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(60, 400))]
        for edits in (0, 0, 1, 2, 3, 4, 6, 8, 10):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = "other"
            docs.append((n, " ".join(words)))
            n += 1
    sets = {i: five_words(t) for i, t in docs}
    root = {i: i for i, _ in docs}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    frame = spark.createDataFrame(docs, DOCS).withColumns({"digest": F.lit(1), "node": F.lit(2)})
    of = {bytes(r.digest): r.group for r in near_copies.near_copies(frame, block=block).collect()}
    got = {}
    for i, text in docs:
        got.setdefault(of[hashlib.md5((text or "").encode()).digest()], set()).add(i)
    want = {}
    for i in root:
        want.setdefault(find(i), set()).add(i)
    #: No text is in a group of others than the exact rule's; of the groups nearly all are found whole.
    whole = {i: frozenset(g) for g in want.values() for i in g}
    assert all(g <= whole[min(g)] for g in got.values())
    pairs = lambda groups: sum(len(g) * (len(g) - 1) // 2 for g in groups)
    assert pairs(got.values()) >= 0.97 * pairs(want.values())


def test_near_stage_by_row(spark):
    """Texts that share an id are judged apart, and of equal rows one stays, whatever further columns they have."""
    rng = random.Random(3)
    a, b, c, d = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(80)) for _ in range(4))
    rows = [(3, a, "x"), (7, a, "x"), (7, b, "x"), (8, c, "x"), (8, d, "x"), (8, d, "w"), (None, b, "x"), (None, "alone", "x"), (9, None, "x"), (10, "", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `__key` string").withColumn("n_chars", F.lit(1))
    got = corpus_pipeline.near_duplicate_stage(spark, frame, None)
    assert got.columns == frame.columns
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == sorted([(3, a, "x"), (7, b, "x"), (8, c, "x"), (8, d, "w"), (None, "alone", "x"), (9, None, "x")], key=str)


def test_stage_drops_near_copies_far_in_bits(spark):
    """A copy of similarity 0.8 or more whose fingerprint differs in more than four bits."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id in (1, 177, 5)")
    texts = {r.doc_id: r.text for r in docs.collect()}
    a, b = five_words(texts[1]), five_words(texts[177])
    assert 5 * len(a & b) >= 4 * len(a | b) and (brute_fingerprint(texts[1]) ^ brute_fingerprint(texts[177])).bit_count() > 4
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, None).collect()) == [1, 5]


def test_exploded_keys_are_not_broadcast(spark):
    """Spark estimates exploded signatures as small as the rows they come from; a broadcast of them exhausts the driver."""
    points = spark.range(100).select(F.col("id").alias("node"), *[F.col("id").alias(c) for c in ("fp", "w1", "w2")])
    probes = points.select("node", F.explode(F.sequence(F.lit(0), F.lit(50))).alias("key"))
    dealt = simhash.in_blocks(probes, "key", "node", 64)
    links = near_copies.meet(probes, "key", points, 64, k=8, far=28, least=0.8)
    for found in (dealt, links):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert dealt.select("node").distinct().count() == 100
