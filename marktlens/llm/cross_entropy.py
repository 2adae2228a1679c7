"""LM scoring by cross-entropy difference (Moore and Lewis 2010).

A target model (documents marked as good) and a background model (all
documents) are matched: bigram models of the same form, smoothing and
vocabulary. A document's score is the mean over its tokens of
log p_target - log p_background, so higher is more like the target.

The vocabulary is every word of the corpus, none cut off. With the unigram
shares u and weight ``mu``: p(w | h) = (c(h, w) + mu u(w)) / (c(h) + mu), with
u(w) = (c(w) + 1) / (N + V), where V counts the words and one unknown.

Counts are exact and never gathered or broadcast:

1. Each task cuts its texts into chunks of about ``chunk_tokens`` tokens and
   writes a chunk once, as word codes. A chunk asks for the counts of its
   distinct words and bigrams (63 bits of a hash), stating how often it has them
   itself; what it asks is dealt by ranges of the hashes into buckets.
2. A bucket adds up what the chunks state and answers each with the totals of
   the keys that it asked for, in the same order.
3. A chunk meets its answers and scores its documents.

So a bigram that every document has is one entry for each chunk of millions of
tokens, not one for each document; buckets are ranges of mixed hashes, so they
are even. Chunks and buckets have bounded sizes, and their numbers grow with
the corpus. Only packed arrays are shuffled.

Defined results: a null or empty text and one without words has no tokens
and a null score; a null mark is not good; repeated rows count as often as
they occur and get equal scores; null and repeated ids are kept as they are;
without any good document every score is null; a text longer than a chunk is
a chunk of its own; an empty table gives an empty table; only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_small, materialise, table
from .words import batches_of, mixed, word_hashes

#: The lowest bit of a key tells bigrams from words.
BIGRAM = np.uint64(1)
#: So many tokens of a chunk are scored at a time.
PART_TOKENS = 1 << 18
CHUNK = "chunk long, ids array<{kind}>, marks binary, sizes binary, codes binary, words binary, tokens long, good_tokens long"
ASKED = "bucket int, chunk long, asked binary, stated binary, n_words int"


def squeezed(x: np.ndarray) -> bytes:
    """Numbers by planes of equal bytes, packed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def restored(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def bigram_keys(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which tokens have a word before them, the keys of those bigrams)."""
    inner = np.ones(len(words), bool)
    inner[np.cumsum(np.r_[0, sizes[:-1]])[sizes > 0]] = False
    at = np.flatnonzero(inner)
    return at, mixed(words[at - 1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[at]) | BIGRAM


def counted(keys: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, how often each occurs, how often among the good)."""
    names, n = np.unique(keys, return_counts=True)
    out = np.zeros(len(names), np.int64)
    some, times = np.unique(keys[good], return_counts=True)
    out[np.searchsorted(names, some)] = times
    return names, n, out


def edges_of(buckets: int) -> np.ndarray:
    """Where the ranges of 64-bit keys end, but for the last."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)


def cut_chunks(batches: Iterator[pa.RecordBatch], chunk_tokens: int) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of texts: its documents' ids, marks and sizes, its words, and their codes."""
    task = TaskContext.get().partitionId()
    ids, sizes, marks, hashes, held, nth = [], [], [], [], 0, 0

    def out() -> pa.RecordBatch:
        names, size, mark = pa.concat_arrays(ids), np.concatenate(sizes), np.concatenate(marks)
        found = np.concatenate(hashes) & ~BIGRAM
        words = np.unique(found)
        blobs = [squeezed(mark), squeezed(size.astype(np.uint32)), squeezed(np.searchsorted(words, found).astype(np.uint32)), squeezed(np.diff(words, prepend=np.uint64(0)))]
        lists = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
        numbers = [len(found), int(size[mark].sum())]
        return pa.RecordBatch.from_arrays([pa.array([(task << 32) + nth]), lists, *(pa.array([x], pa.binary()) for x in blobs), *(pa.array([x], pa.int64()) for x in numbers)], ["chunk", "ids", "marks", "sizes", "codes", "words", "tokens", "good_tokens"])

    for batch in batches:
        at = 0
        for texts in batches_of([t.as_py() or b"" for t in batch["raw"]]):
            found, n = word_hashes(texts)
            ids.append(batch["id"].slice(at, len(texts)))
            marks.append(np.array(batch["good"].slice(at, len(texts)).to_pylist(), bool))
            sizes.append(n)
            hashes.append(found)
            at += len(texts)
            held += len(found)
            if held >= chunk_tokens:
                yield out()
                ids, sizes, marks, hashes, held, nth = [], [], [], [], 0, nth + 1
    if ids:
        yield out()


def ask(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """For each chunk and bucket: the chunk's distinct words and then bigrams there, and how often it has them."""
    edges = edges_of(buckets)
    for batch in batches:
        for chunk, *blobs in zip(*(batch[c] for c in ("chunk", "marks", "sizes", "codes", "words")), strict=True):
            mark, size, codes, steps = (restored(x.as_py(), k) for x, k in zip(blobs, (np.bool_, np.uint32, np.uint32, np.uint64), strict=True))
            words = np.cumsum(steps, dtype=np.uint64)[codes]
            good = np.repeat(mark, size)
            at, keys = bigram_keys(words, size.astype(np.int64))
            each = [counted(words, good), counted(keys, good[at])]
            cuts = [np.r_[0, np.searchsorted(k, edges), len(k)] for k, _, _ in each]
            rows = []
            for b in range(buckets):
                mine = [slice(c[b], c[b + 1]) for c in cuts]
                n_words = mine[0].stop - mine[0].start
                if n_words or mine[1].stop > mine[1].start:
                    asked = np.concatenate([np.diff(k[m], prepend=np.uint64(0)) for (k, _, _), m in zip(each, mine, strict=True)])
                    stated = np.concatenate([e[i][m] for i in (1, 2) for e, m in zip(each, mine, strict=True)]).astype(np.uint32)
                    rows.append((b, chunk.as_py(), squeezed(asked), squeezed(stated), n_words))
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "chunk", "asked", "stated", "n_words"])


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket: the totals of what each chunk asked, and how many words a bucket has."""
    now, held = None, []

    def out() -> pa.RecordBatch:
        keys, n, good, chunks = [], [], [], []
        for chunk, asked, stated, n_words in held:
            steps, mine = restored(asked, np.uint64), restored(stated, np.uint32)
            keys += [np.cumsum(steps[:n_words], dtype=np.uint64), np.cumsum(steps[n_words:], dtype=np.uint64)]
            n.append(mine[: len(steps)])
            good.append(mine[len(steps) :])
            chunks.append(chunk)
        bounds = np.cumsum([0, *map(len, n)])
        names, place = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        totals = np.empty((2, len(place)), np.uint64)
        for i, x in enumerate((n, good)):
            totals[i] = np.bincount(place, np.concatenate(x), len(names)).astype(np.uint64)[place]
            x.clear()
        found = [squeezed(totals[:, a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        distinct = [int((names & BIGRAM == 0).sum())] + [0] * (len(chunks) - 1)
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([now] * len(chunks), pa.int32()), pa.array(found, pa.binary()), pa.array(distinct, pa.int64())], ["chunk", "bucket", "totals", "distinct"])

    for batch in batches:
        for bucket, chunk, asked, stated, n_words in zip(*(batch[c] for c in ("bucket", "chunk", "asked", "stated", "n_words")), strict=True):
            if bucket.as_py() != now and held:
                yield out()
                held = []
            now = bucket.as_py()
            held.append((chunk.as_py(), asked.as_py(), stated.as_py(), n_words.as_py()))
    if held:
        yield out()


def score_chunks(batches: Iterator[pa.RecordBatch], buckets: int, wholes: tuple[int, int], mu: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by chunk, its texts first and then its answers: (id, n_tokens, score) of its documents."""
    edges = edges_of(buckets)
    whole = np.array(wholes, np.float64)[:, None]
    chunk, answers, now = None, [], None

    def totals_of(n_words: np.ndarray, n_pairs: int) -> tuple[np.ndarray, np.ndarray]:
        """The totals of the chunk's words and of its bigrams, filled in a bucket at a time."""
        out, at = [np.empty((2, n), np.uint64) for n in (int(n_words.sum()), n_pairs)], [0, 0]
        for b, raw in answers:
            t = restored(raw, np.uint64).reshape(2, -1)
            for i, part in enumerate((t[:, : n_words[b]], t[:, n_words[b] :])):
                if at[i] + part.shape[1] > out[i].shape[1]:
                    raise ValueError("a chunk has strange answers")
                out[i][:, at[i] : at[i] + part.shape[1]] = part
                at[i] += part.shape[1]
        if at != [x.shape[1] for x in out]:
            raise ValueError("a chunk lacks answers")
        answers.clear()
        return out[0], out[1]

    def out() -> pa.RecordBatch:
        ids, size, codes, words = chunk[0], restored(chunk[1], np.uint32).astype(np.int64), restored(chunk[2], np.uint32), np.cumsum(restored(chunk[3], np.uint64), dtype=np.uint64)
        names = np.unique(bigram_keys(words[codes], size)[1])
        of_word, of_pair = totals_of(np.diff(np.r_[0, np.searchsorted(words, edges), len(words)]), len(names))
        shares = (of_word + 1.0) / whole
        alone = np.log(shares[1] / shares[0])
        #: Whole documents, some most tokens at a time, so that few numbers a token are held at once.
        ends, sums, begin = np.cumsum(size), np.zeros(len(size)), 0
        while begin < len(size):
            first = int(ends[begin] - size[begin])
            upto = max(int(np.searchsorted(ends, first + PART_TOKENS, side="right")), begin + 1)
            some, mine = size[begin:upto], codes[first : int(ends[upto - 1])]
            at, keys = bigram_keys(words[mine], some)
            gain = alone[mine]
            asked, place = np.unique(keys, return_inverse=True)  # looked up in order, which is many times as fast
            up = of_pair[:, np.searchsorted(names, asked)[place]] + mu * shares[:, mine[at]]
            down = of_word[:, mine[at - 1]] + mu
            gain[at] = np.log(up[1] * down[0] / (up[0] * down[1]))
            sums[begin:upto] = np.bincount(np.repeat(np.arange(len(some)), some), gain, len(some))
            begin = upto
        none = (size == 0) | (whole[1, 0] < 0)
        return pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(sums / np.maximum(size, 1), mask=none)], ["id", "n_tokens", "score"])

    for batch in batches:
        for i, (number, bucket) in enumerate(zip(batch["chunk"].to_pylist(), batch["bucket"].to_pylist(), strict=True)):
            if number != now and now is not None:
                yield out()
                answers = []
            now = number
            if bucket < 0:
                chunk = (batch["ids"][i].values, *(batch[c][i].as_py() for c in ("sizes", "codes", "words")))
            else:
                answers.append((bucket, batch["totals"][i].as_py()))
    if now is not None:
        yield out()


def score_documents(docs: DataFrame, good: Column, id_col: str = "doc_id", text_col: str = "text", mu: float = 100.0, chunk_tokens: int = 2_000_000, bucket_bytes: int = 8 << 20, min_buckets: int = 32) -> DataFrame:
    """(id_col, n_tokens, score) for every row of docs; score is null without tokens or without a good document.

    bucket_bytes: bytes of text for each bucket of counts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(good, F.lit(False)).alias("good"), F.col(text_col).cast("binary").alias("raw"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(min_buckets, -(-size // bucket_bytes))
    chunks = materialise(rows.mapInArrow(partial(cut_chunks, chunk_tokens=chunk_tokens), CHUNK.format(kind=kind)), "lm-chunks")
    asked = chunks.select("chunk", "marks", "sizes", "codes", "words").mapInArrow(partial(ask, buckets=buckets), ASKED)
    answers = materialise(asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, "chunk long, bucket int, totals binary, distinct long"), "lm-answers")
    tokens = chunks.agg(F.sum("tokens"), F.sum("good_tokens")).first()
    vocabulary = (answers.agg(F.sum("distinct")).first()[0] or 0) + 1
    #: Without a good token nothing is scored.
    wholes = ((tokens[0] or 0) + vocabulary, tokens[1] + vocabulary if tokens[1] else -1)
    own = chunks.select("chunk", F.lit(-1).alias("bucket"), "ids", "sizes", "codes", "words", F.lit(None).cast("binary").alias("totals"))
    both = own.unionByName(answers.select("chunk", "bucket", "totals"), allowMissingColumns=True)
    scored = both.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(partial(score_chunks, buckets=buckets, wholes=wholes, mu=mu), f"id {kind}, n_tokens long, score double")
    return scored.withColumnRenamed("id", id_col)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cross-entropy difference between labelled good (quality 1, not toxic) and all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.bool_and((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    marked = join_small(docs, labels, "doc_id", "left")
    return score_documents(marked, F.col("good")).select("doc_id", "n_tokens", F.round("score", 6).alias("score"))
