"""Decontamination, LM scores, mixing, language ID, and the pipeline."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter
from functools import partial
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marktlens.llm import cross_entropy, decontaminate, language_id, mixing
from marktlens.llm.registry import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


def invented(rng, n, syllables=("ba", "do", "ki", "lu", "me", "ra", "so", "tu", "ve", "zi")):
    return ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(1)
    items = [(i, " ".join(invented(rng, rng.randint(12, 70)))) for i in range(30)] + [(99, None), (98, "!")]
    docs = [(i, " ".join(invented(rng, 300))) for i in range(60)]
    want = {}
    for i in range(40):
        words = docs[i][1].split()
        item = items[i % 30]
        leak = item[1].split()
        if i >= 30:  # a paraphrase: one word in seven replaced
            leak = [w if k % 7 else "xyz" for k, w in enumerate(leak, 1)]
        at = rng.randint(0, len(words))
        docs[i] = (i, " ".join(words[:at] + [w.upper() + "!!" for w in leak] + words[at:]))
        want[i] = [item[0]]
    docs += [(100, None), (101, ""), (0, docs[0][1])]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    for block in (256, 7):
        got = decontaminate.find_leaks(frame.withColumn("matches", F.lit(1)), bench, block_parts=block).collect()
        found = {r.doc_id: sorted({m.item for m in r.matches}) for r in got if r.matches}
        assert found == want and len(got) == len(docs)
    assert decontaminate.find_leaks(frame.limit(0), bench).count() == 0
    assert {len(r.matches) for r in decontaminate.find_leaks(frame, bench.limit(0)).collect()} == {0}


def test_leaks_of_items_without_id(spark):
    rng = random.Random(7)
    items = [(None, " ".join(invented(rng, 40))), (1, " ".join(invented(rng, 40)))]
    texts = [invented(rng, 300) for _ in range(20)]
    texts[3][100:100] = items[0][1].split()
    texts[4][100:100] = items[1][1].split()
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: {m.item for m in r.matches} for r in decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {i: found for i, found in got.items() if found} == {3: {None}, 4: {1}}


def test_leaks_in_the_tables(spark):
    """Nine in ten or more of the items that stand in a text word for word, and of paraphrases put into other texts."""
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    rng, texts = random.Random(12), [(r.doc_id, r.text) for r in docs.collect()]
    words = [w for _, t in texts for w in (t or "").split()]
    items, put = {r.item_id: r.text.split() for r in bench.collect()}, {}
    for i, ws in items.items():  # one word in eight replaced or left out
        told = [x for w in ws for x in ([w] if rng.random() > 1 / 8 else rng.choice([[], [rng.choice(words)]]))]
        at = 10_000 + i
        texts.append((at, " ".join([*rng.choices(words, k=rng.randint(0, 300)), *told, *rng.choices(words, k=rng.randint(0, 300))])))
        put[at] = i
    found = {r.doc_id: {m.item for m in r.matches} for r in decontaminate.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert sum(i in found[d] for d, i in put.items()) >= 0.9 * len(put)
    plain = {i: f" {' '.join(re.findall(r'[^\W_]+', ' '.join(ws).lower()))} " for i, ws in items.items()}
    there = {(d, i) for d, t in texts for i, x in plain.items() if x in f" {' '.join(re.findall(r'[^\W_]+', (t or '').lower()))} "}
    assert there and sum(i in found[d] for d, i in there) >= 0.9 * len(there)
    clean = {d for d, _ in texts} - set(put) - {d for d, _ in there}
    assert sum(bool(found[d]) for d in clean) <= 0.01 * len(clean)


def test_latent_space_against_dense_svd(spark):
    """With power iterations the singular values and vectors are those of the dense matrix."""
    rng = random.Random(13)
    topics = [invented(rng, 30) for _ in range(5)]
    texts = [" ".join(rng.choices(rng.choice(topics), k=rng.randint(1, 200))) for _ in range(80)]
    cells, passage = 256, 16
    task = partial(decontaminate.to_cells, cells=cells, passage=passage)
    written = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3).mapInArrow(task, "cells binary")
    items = [decontaminate.cells_of(decontaminate.word_hashes([" ".join(rng.choices(topics[0], k=9)).encode()])[0], cells) for _ in range(4)]
    space = decontaminate.latent_space(decontaminate.Corpus(written, cells, passage), items, rank=6, power=5)
    rows, df = [], np.zeros(cells)
    for t in texts:
        c = decontaminate.cells_of(decontaminate.word_hashes([t.encode()])[0], cells)
        rows += [np.bincount(c[i : i + passage], minlength=cells) for i in range(0, len(c), passage)]
    df = (np.stack(rows) > 0).sum(axis=0)
    weights = np.log((1 + len(rows)) / (1 + df))
    dense = np.stack(rows + [np.bincount(c, minlength=cells) for c in items]) * weights
    _, values, vectors = np.linalg.svd(dense, full_matrices=False)
    assert space.weights == pytest.approx(weights) and space.values[:5] == pytest.approx(values[:5], rel=1e-3)
    assert np.linalg.norm(vectors[:5] @ space.basis[:, :5]) == pytest.approx(5**0.5, abs=1e-2)


def test_leaks_of_odd_items(spark):
    """Items of one word and of very many words, answers across parts, a very long text, columns that clash."""
    rng = random.Random(14)
    fill = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    long = [f"z{i}" for i in range(20_000)]
    items = [(1, "Zyzzyva"), (2, "cc dd"), (3, " ".join(long)), (4, None), (5, " ?! "), (6, " ".join([*fill(70), "final", "answer", "is", "forty", "two"]))]
    six = items[5][1].split()
    loose = [w if i % 3 else "other" for i, w in enumerate(six[:35])]  # two thirds: only with the answer
    texts = {
        1: fill(100) + ["zyzzyva"] + fill(5), 2: fill(9) + ["cc", "DD!"], 3: fill(50) + long[7000:7300] + fill(50), 4: fill(30_000) + ["zyzzyva"],
        5: fill(30) + loose + six[35:70] + six[70:], 6: ["cc"] + fill(50) + ["dd"], 7: fill(300), 8: [], 9: fill(40) + loose + fill(60),
    }
    docs = spark.createDataFrame([(i, " ".join(ws), 1, 2) for i, ws in texts.items()] + [(10, None, 1, 2)], "doc_id long, text string, __found int, __Text int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 15, 100):
        got = {r.doc_id: {m.item for m in r.matches} for r in decontaminate.find_leaks(docs, bench, block_parts=block).collect()}
        assert got == {1: {1}, 2: {2}, 3: {3}, 4: {1}, 5: {6}, 6: set(), 7: set(), 8: set(), 9: set(), 10: set()}
    left = decontaminate.drop_leaks(docs, bench)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect()), key=str) == sorted((tuple(r) for r in docs.collect() if r.doc_id in (6, 7, 8, 9, 10)), key=str)


def test_lcs():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.randint(1, 5) for _ in range(rng.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs(np.array(a), decontaminate.masks_of(np.array(b)), len(b)) == table[-1][-1]


def brute_scores(docs, good, mu=100):
    texts = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split() for _, t in docs]
    words, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for (i, _), ws in zip(docs, texts, strict=True):
        for k in (0, 1) if i in good else (0,):
            words[k].update(ws)
            pairs[k].update(zip(ws, ws[1:]))  # noqa: B905
    totals = [sum(w.values()) + len(words[0]) + 1 for w in words]

    def p(k, h, w):
        u = (words[k][w] + 1) / totals[k]
        return u if h == "start" else (pairs[k][h, w] + mu * u) / (words[k][h] + mu)

    return [sum(math.log(p(1, h, w) / p(0, h, w)) for h, w in zip(["start", *ws[:-1]], ws, strict=True)) / len(ws) if ws else None for ws in texts]


def shown(scores):
    return np.array(sorted((-1 if i is None else i, -99.0 if s is None else round(s, 6)) for i, s in scores))


@pytest.mark.parametrize("chunk,buckets", [(2_000_000, 1), (40, 7), (300, 90)])
def test_lm_scores(spark, chunk, buckets):
    """Against plain counters: common and rare words, null and repeated ids, repeated rows, a text longer than a chunk."""
    rng = random.Random(3)
    docs = [(i, " ".join([f"only{i}", *invented(rng, rng.randint(0, 40), ("a", "B", "c")), f"pair{i // 2}"][: rng.randint(0, 42)])) for i in range(60)]
    docs += [(60, None), (61, "same " * 500), (5, "Again a text"), (5, "Again a text"), (None, "no id"), (None, "no id either\tA"), (62, " \n")]
    good = {i for i in range(0, 60, 3)}
    frame = spark.createDataFrame([(i, t, i in good) for i, t in docs], "doc_id long, text string, ok boolean").withColumns({"row": F.lit(0), "chunk": F.lit(1), "good": F.lit("x")})
    got = cross_entropy.score_documents(frame, F.col("ok"), chunk_tokens=chunk, min_buckets=buckets).collect()
    assert shown((r.doc_id, r.score) for r in got) == pytest.approx(shown((d[0], s) for d, s in zip(docs, brute_scores(docs, good), strict=True)), abs=2e-6)
    assert sorted(r.n_tokens for r in got) == sorted(len((t or "").split()) for _, t in docs)
    assert all(r.score is None for r in cross_entropy.score_documents(frame, F.lit(False)).collect())
    assert cross_entropy.score_documents(frame.limit(0), F.col("ok")).count() == 0


def test_lm_hot_bigram(spark):
    """One bigram in every document is an entry a chunk, not one a document."""
    docs = [(i, f"hot pair w{i}") for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = frame.select(F.col("doc_id").alias("id"), F.lit(False).alias("good"), F.col("text").cast("binary").alias("raw"))
    chunks = rows.mapInArrow(partial(cross_entropy.cut_chunks, chunk_tokens=1000), cross_entropy.CHUNK.format(kind="bigint"))
    asked = [len(cross_entropy.restored(bytes(r.asked), np.uint64)) for r in chunks.mapInArrow(partial(cross_entropy.ask, buckets=1), cross_entropy.ASKED).collect()]
    tokens = [r.tokens for r in chunks.collect()]
    assert sum(tokens) == 9000 and len(asked) <= 12
    assert sorted(asked) == sorted(2 * n // 3 + 3 for n in tokens)  # each w and its bigram, and hot, pair, hot pair


def taken_by_source(got):
    return got.assign(taken=got["copies"] * got["size"]).groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))


def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "c", "d", None])) for i in range(400)] + [(900, None, "e"), (901, "x", "é"), (None, "y z", "a"), (902, " ", "f")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit(9) for c in ("copies", "target", "key", "part", "row", "u")})
    got = mixing.mix_sources(frame).toPandas()
    assert len(got) == len(docs) and got.copies.max() <= 3
    each = taken_by_source(got)
    assert each["size"].sum() == pytest.approx(each.target.sum()) and (each.target <= 3 * each["size"] + 1e-9).all()
    assert ((each.taken - each.target).abs() <= 15).all()
    again = mixing.mix_sources(frame.repartition(7)).toPandas()
    key = ["doc_id", "source", "size", "copies"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    carried = mixing.mix_sources(frame, carry=True).select("row.*", F.col("copies").alias("times")).toPandas()
    assert list(carried.columns[:-1]) == frame.columns and sorted(map(str, carried[["doc_id", "source", "times"]].values.tolist())) == sorted(map(str, got[["doc_id", "source", "copies"]].values.tolist()))
    assert mixing.mix_sources(frame.limit(0)).count() == 0


def test_mix_of_equal_rows(spark):
    """Rows without ids, with one id, and equal in all columns are drawn one by one: each source comes within a document of its target."""
    rows = [(None, " ".join(["w"] * 10), "a")] * 300 + [(None, " ".join(["w"] * 10), "b")] * 300 + [(5, f"one two {i % 7}", "c") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix_sources(frame).toPandas()
    each = taken_by_source(got)
    assert len(got) == 900 and ((each.taken - each.target).abs() <= 10).all()
    carried = mixing.mix_sources(frame, carry=True).groupBy("row.source").agg(F.sum("copies").alias("n")).toPandas()
    assert dict(zip(carried.source, carried.n, strict=True)) == got.groupby("source")["copies"].sum().to_dict()


def test_mix_draws_unequally(spark):
    """Longer documents are taken more often, in one Pareto order of odds over inclusion odds."""
    rng = random.Random(8)
    docs = [(i, " ".join(["w"] * rng.choice([3, 200])), "a") for i in range(3000)] + [(10_000 + i, "x " * 400, "b") for i in range(900)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix_sources(frame, weights=(1, 4)).toPandas()
    mine = got[got.source == "a"]
    target, words = mine.target.iloc[0], mine.groupby("size")["size"].sum()
    rate = target / sum((8 + int(n).bit_length()) * w for n, w in words.items())
    for n, each in mine.groupby("size"):
        p = rate * (8 + int(n).bit_length())
        assert p < 1 and each["copies"].max() <= 1
        assert abs(each["copies"].mean() - p) < 4 * math.sqrt(p * (1 - p) / len(each)), n
    u = lambda i, n: int(hashlib.md5(f"mix:{i}:{hashlib.md5(' '.join(['w'] * n).encode()).hexdigest()}:0".encode()).hexdigest()[:13], 16) / 2**52
    p = {n: rate * (8 + int(n).bit_length()) for n in words.index}
    order = sorted(mine.itertuples(), key=lambda r: u(r.doc_id, r.size) / (1 - u(r.doc_id, r.size)) / (p[r.size] / (1 - p[r.size])))
    upto = np.cumsum([r.size for r in order]) <= target
    assert [r.copies for r, head in zip(order, upto, strict=True) if head] == [1] * int(upto.sum()) and sum(r.copies for r, head in zip(order, upto, strict=True) if not head) <= 1


def test_language(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 2 = 0"), "doc_id", "text", "lang", 1000)
    held = language_id.identify(docs.where("doc_id % 2 = 1"), model=model).toPandas().merge(docs.toPandas()[["doc_id", "lang"]], on="doc_id", suffixes=("", "_true"))
    assert (held.lang == held.lang_true).mean() >= 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... !!"), (4, "the"), (4, "the")], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang, r.kept) for r in language_id.identify(odd, model=model).collect())
    assert got[:3] == [(1, "und", False), (2, "und", False), (3, "und", False)] and len(got) == 5
    assert language_id.identify(docs.limit(0)).count() == 0


def test_language_evidence(spark):
    """A text that says little follows its markup and host."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.fit(docs, "doc_id", "text", "lang", 1000)
    texts = docs.where("lang in ('de', 'fr')").select("text", F.col("lang").alias("declared"), F.concat(F.lit("www."), F.col("lang"), F.lit("-site.example."), F.col("lang")).alias("host"))
    known = texts.withColumn("doc_id", F.monotonically_increasing_id() + 100)
    vague = spark.createDataFrame([(1, "la de", "fr", "www.fr-site.example.fr"), (2, "en de", "de", "www.de-site.example.de")], "doc_id long, text string, declared string, host string")
    got = {r.doc_id: r.lang for r in language_id.identify(known.unionByName(vague), declared=F.col("declared"), host=F.col("host"), model=model).collect()}
    assert (got[1], got[2]) == ("fr", "de")
    html = spark.createDataFrame([('<!DOCTYPE html><html class="x" lang="DE-at">',), ("<html>",), (None,)], "h string")
    assert [r[0] for r in html.select(language_id.markup_language(F.col("h"))).collect()] == ["de", None, None]


def fused_by_hand(rows, languages, weight=0.2, prior=20.0):
    """{id: (language, posterior)} from (id, text log likelihoods, trigrams, declared, host): the fusion with dictionaries."""
    n, speaks = len(languages), {}
    for i, ll, grams, *_ in rows:
        top = max(ll)
        raised = [math.exp(weight * (x - top)) for x in ll]
        speaks[i] = [x / sum(raised) for x in raised] if grams and top > 0 else None
    sums = lambda key: {k: [sum(speaks[r[0]][j] for r in rows if key(r) == k and speaks[r[0]]) for j in range(n)] for k in {key(r) for r in rows} if k is not None}
    parent = lambda h: ".".join(h.lower().split(".")[-2:]) if h and "." in h else None
    suffix = lambda h: h.lower().split(".")[-1] if h and "." in h else None
    base = [x + 1 for x in sums(lambda r: "all")["all"]]
    base = [x / sum(base) for x in base]
    smooth = lambda c, up: [(c[j] + prior * up[j]) / (sum(c) + prior) for j in range(n)]
    hosts, parents = sums(lambda r: r[4]), sums(lambda r: parent(r[4]))
    of_host = {h: smooth(c, smooth(parents.get(parent(h), [0.0] * n), base)) for h, c in hosts.items()}

    def rates(counts):
        whole = [sum(c[j] for c in counts.values()) for j in range(n)]
        return {k: [(c[j] + 0.5) / (whole[j] + 1) for j in range(n)] for k, c in counts.items()}

    declared, suffixes = rates(sums(lambda r: r[3] and r[3].lower())), rates(sums(lambda r: suffix(r[4])))
    out = {}
    for i, ll, _, said, host in rows:
        logs = [math.log(x) for x in of_host.get(host, base)]
        for known, key in ((declared, said and said.lower()), (suffixes, suffix(host))):
            logs = [x + math.log(p) for x, p in zip(logs, known[key], strict=True)] if key in known else logs
        logs = [x + weight * y for x, y in zip(logs, ll, strict=True)] if speaks[i] else logs
        raised = [math.exp(x - max(logs)) for x in logs]
        best = max(raised) / sum(raised)
        out[i] = (languages[raised.index(max(raised))], best) if speaks[i] else ("und", 0.0)
    return out


def test_pages_by_all_evidence(spark):
    """Text, markup language, suffix, host and parent domain against the fusion by hand."""
    docs, pages = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "pages"))
    model = language_id.fit(docs, "doc_id", "text", "lang", 200)
    extra = [(90_001, "http://a.example.fr/", "<html lang=FR><p>la de</p>"), (90_002, "no address", "<html>"), (90_003, None, None), (90_004, "http://x.example.de/", "<script>var the = of</script><html lang='de'>und ist nicht"), (90_004, "http://x.example.de/", "<html>!!")]
    pages = pages.unionByName(spark.createDataFrame(extra, pages.schema)).withColumn("host", F.lit("clash"))
    got = sorted((r.page_id, r.lang, r.posterior) for r in language_id.identify_pages(pages, model).collect())
    rows = []
    for nth, r in enumerate(pages.collect()):
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", r.html or "")
        cells = language_id.trigrams(text.encode())
        ll = model[1][cells].astype(float).sum(axis=0).tolist()
        said = re.search(r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,8})""", r.html or "")
        host = re.search("://([^/?#]*)", r.url or "")
        rows.append(((r.page_id, nth), ll, len(cells), said and said[1].lower(), (host and host[1].lower()) or None))
    want = sorted((i, lang, p) for (i, _), (lang, p) in fused_by_hand(rows, model[0]).items())
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-5)


def test_language_sample_is_stratified(spark):
    """A language of a few rows among many is known; the sample has a bound a language, whatever ids and rows repeat."""
    words = {"aa": "lorem ipsum dolor sit amet", "bb": "zwolf boxkampfer jagen viktor quer", "cc": "pchnac w te lodz jeza"}
    rng = random.Random(2)
    say = lambda x: " ".join(rng.choices(words[x].split(), k=30))
    docs = [(i, say("aa"), "aa") for i in range(3000)] + [(1, "same text", "bb")] * 900 + [(5000 + i, say("bb"), "bb") for i in range(100)] + [(9000 + i, say("cc"), "cc") for i in range(3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("at", F.lit(1))
    languages, _, cuts = language_id.fit(frame, "doc_id", "text", "lang", 50)
    assert languages == ["aa", "bb", "cc"] and 50 <= frame.where("lang = 'aa'").where(language_id.draw(frame, "doc_id", "text") <= cuts["aa"]).count() <= 50
    got = {r.doc_id: r.lang for r in language_id.identify(frame, declared=F.col("lang"), rows_per_language=50).collect()}
    assert all(got[9000 + i] == "cc" for i in range(3)) and got[7] == "aa"
    long = spark.createDataFrame([(1, " ".join(say("aa") for _ in range(20_000)), "aa")] * 2, "doc_id long, text string, lang string")
    assert [r.lang for r in language_id.identify(long, model=(languages, *language_id.fit(frame, "doc_id", "text", "lang", 50)[1:])).collect()] == ["aa", "aa"]


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for name in ("documents", "pages", "conversations", "benchmark", "labels"):
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return found


def simhash_by_hand(got, docs, con):
    from .test_dedup import brute_components, brute_fingerprint

    prints = {i: brute_fingerprint(t) for i, t in docs}
    roots = brute_components(sorted(set(prints.values())), 4)
    least = {}
    for i in sorted(prints):
        least.setdefault(roots[prints[i]], i)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.itertuples()} == {i: (f"{p:016x}", least[roots[p]]) for i, p in prints.items()}


def scores_by_hand(got, docs, con):
    good = {r[0] for r in con.execute("SELECT doc_id FROM labels GROUP BY 1 HAVING bool_and(quality = 1 AND coalesce(toxic, 0) = 0)").fetchall()}
    assert dict(zip(got.doc_id, got.score, strict=True)) == pytest.approx({i: s for (i, _), s in zip(docs, brute_scores(docs, good), strict=True)}, abs=2e-6, nan_ok=True)


def quality_by_hand(got, docs, con):
    from .test_rows import brute_counts

    for r, (i, text) in zip(got.sort_values("doc_id").itertuples(), docs, strict=True):
        counts = brute_counts(text)
        assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (i, *counts)
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0]) and not (r.kept and r.base_failed)


BY_HAND = {"op3_simhash": simhash_by_hand, "op5_lm_scores": scores_by_hand, "op7_quality_rules": quality_by_hand}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in SQL:
        want = con.execute(SQL[name]).df()
        show = lambda v: "" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
        rows = lambda f: sorted(tuple(show(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        table = "pages" if "page_id" in got else "documents"
        assert len(got) == con.execute(f"SELECT count(*) FROM {table}").fetchall()[0][0]
        if name in BY_HAND:
            docs = con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
            BY_HAND[name](got, docs, con)


def test_pipeline(spark, tmp_path):
    """Each stage by brute force over what its predecessor kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, None, None, 0), (10_002, "", None, None, 0), (10_003, "###", "en", "src1", 3)], docs.schema)
    repeated = docs.where("doc_id = 7")
    frame, at = docs.unionByName(extra).unionByName(repeated), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, SMALL).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        at[name] = frame.toPandas()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frame.columns == docs.columns
    first = at["language_id"]
    assert set(docs.toPandas().doc_id) == set(first.doc_id) and len(first) == docs.count() + 1
    lines, near = at["line_dedup"], at["simhash_near_dedup"]
    assert sorted(lines.doc_id) == sorted(first.doc_id) and (lines.n_chars == lines.text.str.len()).all()
    sets = {}
    for r in lines.sort_values("doc_id").itertuples():
        words = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "").split()
        sets.setdefault(r.doc_id, frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    group = {i: i for i in sets}
    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and 5 * len(x & y) >= 4 * len(x | y):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    assert sorted(near.doc_id) == sorted(set(group.values()))
    clean, bench = at["decontaminate"], spark.read.parquet(f"{SMALL}/benchmark.parquet").toPandas()
    plain = lambda x: re.findall(r"[^\W_]+", (x or "").lower())
    items = [plain(t) for t in bench.text]
    texts = {r.doc_id: plain(r.text) for r in near.itertuples()}
    leaking = {i for i, ws in texts.items() if any(f" {' '.join(x)} " in f" {' '.join(ws)} " for x in items)}
    dropped = set(near.doc_id) - set(clean.doc_id)
    assert leaking <= dropped and set(clean.doc_id) <= set(near.doc_id)
    for i in dropped - leaking:  # what is not verbatim holds most words of some item
        assert any(len(set(x) & set(texts[i])) >= 0.6 * len(set(x)) for x in items), i
    mix = at["source_mix"]
    assert set(mix.doc_id) <= set(clean.doc_id) and mix["copy"].max() <= 3


def test_pipeline_of_odd_tables(spark):
    """An empty table, and one with columns whose names the stages use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, __key int, __Deleted int, copy int, __text int, __found int"
    for rows in ([], [(1, "a b c", "en", "x", 5, 1, 2, 3, 4, 5), (None, None, None, None, None, 1, 2, 3, 4, 5)]):
        frame = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            frame = stage(spark, frame, SMALL)
            assert frame.columns == [c.split()[0] for c in schema.split(", ")], name
        assert frame.count() == len(rows)
    assert corpus_pipeline.language_stage(spark, spark.createDataFrame([], schema), SMALL).count() == 0


def test_lm_scoring_holds_few_numbers_a_token(monkeypatch):
    """A chunk of a million tokens, nearly all of its bigrams distinct, is scored in bounded memory, by parts."""
    monkeypatch.setattr(cross_entropy, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng, n = np.random.default_rng(3), 1_000_000
    words = [b"w%d" % i for i in range(20_000)]
    texts = [b" ".join(words[i] for i in part) for part in np.split(rng.integers(0, len(words), n), 500)]
    texts[3:3] = [b"", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(502)), pa.array([i % 2 == 0 for i in range(502)]), pa.array(texts, pa.binary())], ["id", "good", "raw"])
    chunks = list(cross_entropy.cut_chunks(iter([batch]), 2 * n))
    answers = pa.Table.from_batches(cross_entropy.answer(iter([b for b in pa.Table.from_batches(cross_entropy.ask(iter(chunks), 4)).sort_by("bucket").to_batches()]))).to_pylist()
    vocabulary, good = sum(a["distinct"] for a in answers) + 1, chunks[0]["good_tokens"][0].as_py()
    own = {c: chunks[0][c][0].as_py() for c in ("chunk", "ids", "sizes", "codes", "words")} | {"bucket": -1, "totals": None}
    rows = [own, *({"chunk": a["chunk"], "bucket": a["bucket"], "totals": a["totals"], "ids": None, "sizes": None, "codes": None, "words": None} for a in answers)]
    kinds = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("sizes", "codes", "words", "totals"))])
    both = pa.RecordBatch.from_pylist(rows, kinds)
    found = {}
    for size in (1 << 18, 1 << 30):
        monkeypatch.setattr(cross_entropy, "PART_TOKENS", size, raising=False)
        tracemalloc.start()
        (out,) = cross_entropy.score_chunks(iter([both]), 4, (n + vocabulary, good + vocabulary), 100.0)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        found[size] = out.to_pydict()
        if size == 1 << 18:
            assert peak < 80 * n
    a, b = found.values()
    assert a["n_tokens"] == b["n_tokens"] and a["score"] == pytest.approx(b["score"], abs=1e-12) and a["score"][3:5] == [None, None]
