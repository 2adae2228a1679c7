"""Benchmark decontamination by latent semantic retrieval.

1. Words (lower case, punctuation removed) of every text of the corpus are
   hashed; the first bits of a hash are its cell, so the vocabulary is that of
   the whole corpus in ``cells`` terms. Texts are passages of ``passage`` words,
   written once as cells; document frequencies over all of them give TF-IDF.
2. A distributed randomised SVD of the TF-IDF passages of corpus and benchmark
   (a sketch of rank + 8 columns, each passage added to one of them with a random
   sign; ``power`` power iterations, products of A'A with it; the projection of
   all rows on its span, by whose second moments the singular vectors are found;
   all summed over all tasks) gives ``rank`` latent dimensions, whatever the
   number of items. Profiles are centred and scaled to equal variance in all
   directions. Each power iteration turns the space further towards passages
   with many copies, which tell other passages apart worst, so none is the
   default (README has the figures).
3. Items are cut into parts of at most ``part_words`` words. Windows of every
   text, one every ``step`` words and twice or four times as long, are
   projected (sums of their words' latent vectors) and held against the parts
   of a like length; candidates reach ``min_cosine``.
4. A candidate must hold enough of the part's words for the least share (an
   upper bound of the subsequence, so nothing is lost). Then its surroundings
   and the part are compared by their longest common subsequence of words: a
   share of ``sure`` is contamination, and one of ``likely`` is if the item's
   answer, its last ``answer_words`` words, stands where it would (half of it in
   order). A part of fewer than ``least_words`` words has no latent profile: it
   is held against the surroundings of every occurrence of its rarest word.

The benchmark is the stated query set; it is taken in blocks of ``block_parts``
parts, an item's parts in several blocks if need be. What is broadcast is
block_parts times some 700 bytes, and cells * (rank + 8) numbers, which are
also what a task sums; neither grows with the corpus. No pass shuffles texts,
and a row is judged where it is read, so no key of rows is needed.

Defined results: null, empty and wordless texts, and items without words,
match nothing; ties and repeated rows are judged alike and all stay; equal
items both match; an item without an id is searched like any other and its
match has a null item; an empty corpus or benchmark gives no match; further
columns are not read (drop_leaks() returns them as they are).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, materialise, table, unused
from .words import PLAIN, batches_of, mixed, word_hashes

SLICES = 64
FOUND = "__found"
#: Passages that a product takes at a time.
ROWS = 2048
#: Bits of the map of words that stand near a window.
NEAR = 1024


def plain(text: str | None) -> bytes:
    return (text or "").lower().encode()


def cells_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - (cells - 1).bit_length())).astype(np.uint16)


def to_cells(batches: Iterator[pa.RecordBatch], cells: int, passage: int) -> Iterator[pa.RecordBatch]:
    """Texts as passages of cells; what a last passage lacks is the cell after all others."""
    for batch in batches:
        for texts in batches_of([plain(t.as_py()) for t in batch["text"]], 1 << 20):
            hashes, sizes = word_hashes(texts, PLAIN)
            wide = -(-sizes // passage) * passage
            out = np.full(int(wide.sum()), cells, np.uint16)
            out[np.arange(len(hashes)) + np.repeat(np.cumsum(wide) - wide - np.cumsum(sizes) + sizes, sizes)] = cells_of(hashes, cells)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["cells"])


def passages(batches: Iterator[pa.RecordBatch], passage: int, most: int = ROWS) -> Iterator[np.ndarray]:
    """Some passages at a time, as rows of cells."""
    for batch in batches:
        for raw in batch["cells"]:
            rows = np.frombuffer(raw.as_py(), np.uint16).reshape(-1, passage)
            for at in range(0, len(rows), most):
                yield rows[at : at + most]


def added(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of each row of numbers, the sum of those rows of the table."""
    out = np.empty((len(rows), table.shape[1]), np.float32)
    one = np.ones(rows.shape[1], np.float32)
    step = max(1, 2048 // rows.shape[1])
    for at in range(0, len(rows), step):
        np.matmul(one, np.take(table, rows[at : at + step], axis=0), out=out[at : at + step])
    return out


def sliced(x: np.ndarray) -> pa.RecordBatch:
    pieces = np.array_split(x.astype(np.float32), SLICES)
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], ["slice", "sum"])


def sketch_cells(batches: Iterator[pa.RecordBatch], cells: int, passage: int, width: int, seed: int) -> Iterator[pa.RecordBatch]:
    """This task's part of C'S, and as last columns how many passages hold each cell and how many words it has; one row more has the number of passages.

    C counts cells in passages; S adds each passage, with a random sign, to one
    of width columns, which a hash of its words chooses.
    """
    out, n = np.zeros((cells + 1, width + 2)), 0
    flat = out.reshape(-1)
    for rows in passages(batches, passage, 8 * ROWS):
        random = mixed((rows.astype(np.uint64) * (np.arange(passage, dtype=np.uint64) * np.uint64(2) + np.uint64(1) + np.uint64(seed << 20))).sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        column = ((random >> np.uint64(32)) % np.uint64(width)).astype(np.int32)
        at = rows.astype(np.int32) * (width + 2) + column[:, None]
        flat += np.bincount(at.ravel(), np.repeat(np.where(random & np.uint64(1), 1.0, -1.0), passage), len(flat))
        each = np.sort(rows, axis=1)
        first = np.ones(each.shape, bool)
        first[:, 1:] = each[:, 1:] != each[:, :-1]
        out[:, width] += np.bincount(each[first], minlength=cells + 1)
        out[:, width + 1] += np.bincount(rows.ravel(), minlength=cells + 1)
        n += len(rows)
    out[cells] = 0
    out[cells, width] = n
    yield sliced(out)


def gram_times(batches: Iterator[pa.RecordBatch], held, passage: int) -> Iterator[pa.RecordBatch]:
    """This task's part of A'(A X), in row slices: A is passages by cells, X = held[1] cells by columns."""
    weights, x = held.value
    cells, width = x.shape
    scaled = np.zeros((cells + 1, width), np.float32)
    scaled[:cells] = weights[:, None] * x
    out = np.zeros((cells + 1, width), np.float64)
    for rows in passages(batches, passage):
        y = np.vstack([added(rows, scaled), np.zeros((1, width), np.float32)])
        order = np.argsort(rows, axis=None, kind="stable")
        cell, row = rows.ravel()[order], order // passage
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        counts = np.diff(np.r_[starts, len(cell)])
        #: The passages of a cell, cells of up to 1, 2, 4, ... at a time; what lacks is the row of zeros.
        size = np.ceil(np.log2(counts)).astype(int)
        for k in np.unique(size).tolist():
            some = np.flatnonzero(size == k)
            places = starts[some, None] + np.arange(1 << k)
            mine = np.where(np.arange(1 << k) < counts[some, None], row[np.minimum(places, len(row) - 1)], len(rows))
            out[cell[starts[some]]] += added(mine, y)
    yield sliced(out[:cells] * weights[:, None])


def moments(batches: Iterator[pa.RecordBatch], held, passage: int) -> Iterator[pa.RecordBatch]:
    """What moments_of() sums, over this task's passages."""
    weights, x, centre = held.value
    cells, width = x.shape
    scaled = np.zeros((cells + 1, width + 1), np.float32)
    scaled[:cells] = weights[:, None] * np.c_[x, np.ones(cells)]
    out = np.zeros((2 * width + 1, width))
    for rows in passages(batches, passage):
        out += moments_of(added(rows, scaled), centre)
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([out.astype(np.float32).tobytes()], pa.binary())], ["slice", "sum"])


def moments_of(y: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Of projections y, their words' weight last: the sums of y'y and of u'u, u being y less its share of the centre, of unit length; and how many are not zero."""
    y, weight = y[:, :-1], y[:, -1:]
    u = y - weight * centre.astype(np.float32)
    size = np.sqrt(np.einsum("ij,ij->i", u, u))
    u = u[size > 0] / size[size > 0, None]
    return np.vstack([y.T @ y, u.T @ u, np.full(y.shape[1], float(len(u)))])


def sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, raw in zip(batch["slice"].to_pylist(), batch["sum"], strict=True):
            x = np.frombuffer(raw.as_py(), np.float32)
            total[s] = total[s] + x if s in total else x.astype(np.float64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "sum"])


def summed(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of all tasks' slices: they are added up where they meet, and one matrix reaches the driver."""
    rows = parts.repartition("slice").mapInArrow(sum_slices, "slice int, sum binary").toArrow().sort_by("slice")
    return np.concatenate([np.frombuffer(raw.as_py(), np.float64) for raw in rows["sum"]] or [np.zeros(0)]).reshape(-1, width)


class Corpus:
    """The written passages of a corpus: what the decomposition asks of them."""

    def __init__(self, written: DataFrame, cells: int, passage: int) -> None:
        self.written, self.cells, self.passage = written, cells, passage

    def sketch(self, width: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(C'S, passages with each cell, words in each cell, passages)."""
        task = partial(sketch_cells, cells=self.cells, passage=self.passage, width=width, seed=seed)
        found = summed(self.written.mapInArrow(task, "slice int, sum binary"), width + 2)
        if not len(found):
            found = np.zeros((self.cells + 1, width + 2))
        return found[:-1, :-2], found[:-1, -2], found[:-1, -1], int(found[-1, -2])

    def product(self, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
        """A'(A x)."""
        held = self.written.sparkSession.sparkContext.broadcast((weights, x.astype(np.float32)))
        found = summed(self.written.mapInArrow(partial(gram_times, held=held, passage=self.passage), "slice int, sum binary"), x.shape[1])
        held.unpersist()
        return found if len(found) else np.zeros(x.shape)

    def moments(self, weights: np.ndarray, x: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """What moments() sums, over all passages."""
        held = self.written.sparkSession.sparkContext.broadcast((weights, x.astype(np.float32), centre))
        found = summed(self.written.mapInArrow(partial(moments, held=held, passage=self.passage), "slice int, sum binary"), x.shape[1])
        held.unpersist()
        return found if len(found) else np.zeros((2 * x.shape[1] + 1, x.shape[1]))


class Space:
    """The latent space: its basis (cells by dimensions, right singular vectors), singular values, and word vectors.

    A profile is the sum of its words' vectors: the projection of its TF-IDF
    row, less the corpus's mean for words of that weight, turned and scaled so
    that profiles of the corpus vary alike in all directions. So neither a common
    language nor a passage with many copies makes two profiles alike.
    """

    def __init__(self, weights: np.ndarray, basis: np.ndarray, values: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> None:
        self.weights, self.basis, self.values = weights, basis, values
        #: One row more, for what is no word.
        self.vectors = np.vstack([weights[:, None] * (basis - centre) @ turn, np.zeros((1, turn.shape[1]))]).astype(np.float32, order="C")


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]


def latent_space(corpus: Corpus, items: list[np.ndarray], rank: int, power: int, seed: int = 7) -> Space:
    """The space of the TF-IDF passages of corpus and items by a randomised SVD (Halko et al. 2011).

    items: the cells of each benchmark part, rows of A like any other.
    """
    width = min(corpus.cells, rank + 8)
    image, df, tf, n = corpus.sketch(width, seed)
    weights = np.log((1 + n) / (1 + df))
    random = np.random.default_rng(seed)
    for c in items:
        np.add.at(image, (c, int(random.integers(width))), random.choice([-1.0, 1.0]))
        np.add.at(tf, c, 1)
    x, _ = np.linalg.qr(image * weights[:, None])
    for _ in range(power):
        image = corpus.product(weights, x)
        for c in items:
            np.add.at(image, c, weights[c, None] * (weights[c, None] * x[c]).sum(axis=0))
        x, _ = np.linalg.qr(image)
    #: The mean projection for a word of weight 1.
    centre = (tf * weights) @ x / max((tf * weights).sum(), 1e-300)
    of_items = np.stack([(weights[c, None] * np.c_[x[c], np.ones(len(c))]).sum(axis=0) for c in items])
    found = corpus.moments(weights, x, centre) + moments_of(of_items, centre)
    values, turned = np.linalg.eigh(found[:width])
    best = np.argsort(-values)[:rank]
    best = best[values[best] > 1e-9 * max(values.max(), 1e-300)]
    if not len(best):
        return Space(weights, np.zeros((len(weights), 1)), np.zeros(1), np.zeros(1), np.ones((1, 1)))
    turned = turned[:, best]
    spread = turned.T @ found[width : 2 * width] @ turned / max(found[-1, 0], 1.0)
    sizes, axes = np.linalg.eigh(spread + 1e-3 * np.trace(spread) / len(best) * np.eye(len(best)))
    return Space(weights, x @ turned, np.sqrt(values[best]), centre @ turned, axes / np.sqrt(np.maximum(sizes, 1e-12)))


def lcs(region: np.ndarray, masks: dict[int, int], size: int) -> int:
    """Bit-parallel length of the longest common subsequence with a part of size words."""
    state = full = (1 << size) - 1
    for word in region.tolist():
        if word in masks:
            hit = state & masks[word]
            state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


def masks_of(part: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(part.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Parts:
    """A block of benchmark parts. Each: (item, words as hashes, words of the item after it, the item's last words)."""

    def __init__(self, parts: list[tuple], space: Space, o: dict) -> None:
        self.items, self.words = [p[0] for p in parts], [p[1] for p in parts]
        self.after, self.answers = [p[2] for p in parts], [p[3] for p in parts]
        self.sizes = np.array([len(w) for w in self.words])
        cells = [cells_of(w, len(space.weights)) for w in self.words]
        self.unit = unit_rows(np.stack([space.vectors[c].sum(axis=0) for c in cells]))
        #: Words as places in a window's map, as many times as they occur; -1 beyond the part.
        self.places = np.full((len(parts), max(map(len, cells))), -1, np.int32)
        for row, w in zip(self.places, self.words, strict=True):
            row[: len(w)] = w % np.uint64(NEAR)
        short = (self.sizes < o["least_words"]) | ~self.unit.any(axis=1)
        #: Parts by the number of pieces in their windows.
        pieces = np.clip(-(-(self.sizes + 3 * o["step"] // 5) // o["step"]), 2, 4)
        self.classes = {n: np.flatnonzero(~short & (pieces == n)) for n in (2, 3, 4)}
        #: The rarest word of each short part -> those parts.
        self.rare: dict[int, list[int]] = {}
        for q in np.flatnonzero(short).tolist():
            best = int(self.words[q][np.argmax(space.weights[cells[q]])])
            self.rare.setdefault(best, []).append(q)


def search(batches: Iterator[pa.RecordBatch], held, o: dict, text_at: str, keep: list[str], mark: str) -> Iterator[pa.RecordBatch]:
    """The columns keep of every row, and what its text leaks."""
    reader = Searcher(*held.value, o)
    names = ["item", "start", "words", "cosine", "share", "answer"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.bool_()]
    for batch in batches:
        found: list[dict[int, tuple]] = []
        for texts in batches_of([plain(t.as_py()) for t in batch[text_at]]):
            found += reader.search(*word_hashes(texts, PLAIN))
        flat = [m for each in found for m in each.values()]
        fields = [pa.array([m[i] for m in flat], k) for i, k in enumerate(kinds)]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays(fields, names))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), lists], [*keep, mark])


class Searcher:
    """Finds a block's parts in texts that are given as hashes of words."""

    def __init__(self, parts: Parts, space: Space, o: dict) -> None:
        self.parts, self.space, self.o, self.cells = parts, space, o, len(space.weights)
        self.masks: dict[int, dict[int, int]] = {}
        self.rare = np.array(sorted(parts.rare), np.uint64)

    def judged(self, text: np.ndarray, begin: int, end: int, q: int, cosine: float) -> tuple | None:
        """The match of part q with the words from begin to end, if it is one."""
        o, parts = self.o, self.parts
        begin = max(0, begin)
        region, size = text[begin:end], int(parts.sizes[q])
        if q not in self.masks:
            self.masks[q] = masks_of(parts.words[q])
        share = lcs(region, self.masks[q], size) / size
        if share < o["likely"]:
            return None
        tail = parts.answers[q]
        answer = 2 * lcs(text[begin : end + parts.after[q]], masks_of(tail), len(tail)) >= len(tail)
        return (parts.items[q], begin, len(region), cosine, share, answer) if answer or share >= o["sure"] else None

    def candidates(self, sums: np.ndarray, near: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(piece, pieces, part, cosine) of windows that may hold a part. near: the words around each piece, as places of a map."""
        parts, o = self.parts, self.o
        windows, have = sums, 1
        for n, mine in parts.classes.items():
            if not len(mine):
                continue
            while have < n:
                windows = windows[:-1] + sums[have:]
                have += 1
            units = unit_rows(windows)
            unit, least = parts.unit[mine].T, np.ceil(o["likely"] * parts.sizes[mine] - 1e-9)
            rows = max(64, (1 << 21) // len(mine))
            for at in range(0, len(windows), rows):
                cosine = units[at : at + rows] @ unit
                high = np.flatnonzero(cosine >= o["min_cosine"])
                if not len(high):
                    continue
                w, q = np.divmod(high, len(mine))
                used, local = np.unique(w, return_inverse=True)
                there = np.zeros((len(used), NEAR + 1), bool)  # the last place is for what is no word
                for k in range(n + 2):
                    there[np.arange(len(used))[:, None], near[used + at + k]] = True
                there[:, NEAR] = False
                enough = np.concatenate([there[local[i : i + 4096, None], parts.places[mine[q[i : i + 4096]]]].sum(axis=1) for i in range(0, len(q), 4096)]) >= least[q]
                for i in np.flatnonzero(enough).tolist():
                    yield int(w[i] + at), n, int(mine[q[i]]), float(cosine[w[i], q[i]])

    def search(self, hashes: np.ndarray, sizes: np.ndarray) -> list[dict[int, tuple]]:
        """Of each text, the best match of each part that it holds."""
        step, gap = self.o["step"], 4
        found: list[dict[int, tuple]] = [{} for _ in sizes]
        starts = np.cumsum(sizes) - sizes
        #: Texts stand behind each other in pieces of step words, a window's length apart, so no window spans two.
        pieces = -(-sizes // step) + gap
        base = np.cumsum(pieces) - pieces + 1
        at = np.arange(len(hashes)) - np.repeat(starts, sizes)
        piece = at // step + np.repeat(base, sizes)

        def add(doc: int, begin: int, end: int, q: int, cosine: float) -> None:
            new = self.judged(hashes[starts[doc] : starts[doc] + sizes[doc]], begin, end, q, cosine)
            if new and (q not in found[doc] or new[4] > found[doc][q][4]):
                found[doc][q] = new

        if len(hashes):
            rows = int(pieces.sum()) + 2
            placed = np.full((rows, step), self.cells, np.uint16)
            placed[piece, at % step] = cells_of(hashes, self.cells)
            sums = added(placed, self.space.vectors)
            #: near[i] is the piece before piece i, so a window's surroundings begin at its own number.
            near = np.full((rows + 2, step), NEAR, np.int16)
            near[piece + 1, at % step] = hashes % np.uint64(NEAR)
            for p, n, q, cosine in self.candidates(sums, near):
                doc = max(0, int(np.searchsorted(base, p, side="right")) - 1)
                begin = int(p - base[doc]) * step
                if 0 <= begin < sizes[doc]:
                    add(doc, begin - step, begin + (n + 1) * step, q, cosine)
        if len(self.rare):
            for i in np.flatnonzero(np.isin(hashes, self.rare)).tolist():
                doc = int(np.searchsorted(starts, i, side="right")) - 1
                for q in self.parts.rare[int(hashes[i])]:
                    begin = i - int(starts[doc])
                    wide = 2 * int(self.parts.sizes[q])
                    add(doc, begin - wide, begin + wide + 1, q, 1.0)
        return found


MATCH = "struct<item: bigint, start: int, words: int, cosine: double, share: double, answer: boolean>"


def parts_of(item: int | None, text: str | None, part_words: int, answer_words: int) -> Iterator[tuple]:
    words, _ = word_hashes([plain(text)], PLAIN)
    n = -(-len(words) // part_words)
    for i in range(n):
        a, b = i * len(words) // n, (i + 1) * len(words) // n
        yield item, words[a:b], len(words) - b, words[-answer_words:]


def with_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", passage: int = 64, step: int = 16, part_words: int = 48, answer_words: int = 5, least_words: int = 8, min_cosine: float = 0.33, sure: float = 0.8, likely: float = 0.6, cells: int = 1 << 14, rank: int = 64, power: int = 0, block_parts: int = 1 << 15) -> DataFrame:
    """The columns keep of every row of docs, and last its matches: a match has its item, first word, words, cosine, LCS share, and whether the answer was found."""
    spark = docs.sparkSession
    options = {"step": step, "least_words": least_words, "min_cosine": min_cosine, "sure": sure, "likely": likely}
    items = benchmark.select(F.col(item_col).cast("long"), item_text).orderBy(item_col, item_text)
    written = materialise(docs.select(F.col(text_col).alias("text")).mapInArrow(partial(to_cells, cells=cells, passage=passage), "cells binary"), "leaks-cells")
    corpus = Corpus(written, cells, passage)
    #: Names that docs does not have.
    mark, before, text_at = (unused(x, docs.columns) for x in (FOUND, "__before", "__text"))
    text_at = text_col if text_col in keep else text_at
    out = docs.select(*(F.col(f"`{c}`") for c in keep), *([] if text_col in keep else [F.col(text_col).alias(text_at)]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    columns, space = out.columns, None

    def pass_over(rows: DataFrame, block: list[tuple]) -> DataFrame:
        """rows, and what the block's parts add to their matches."""
        nonlocal space
        if space is None:  # the first block's parts are rows of the decomposition too
            space = latent_space(corpus, [cells_of(p[1], cells) for p in block], rank, power)
        held = spark.sparkContext.broadcast((Parts(block, space, options), space))
        again = mark in rows.columns
        kept = [*columns, before] if again else columns
        kinds = f"{schema}, {f'{before} array<{MATCH}>, ' if again else ''}{mark} array<{MATCH}>"
        task = partial(search, held=held, o=options, text_at=text_at, keep=kept, mark=mark)
        new = (rows.withColumnRenamed(mark, before) if again else rows).mapInArrow(task, kinds)
        return new.withColumn(mark, F.concat(before, mark)).drop(before) if again else new

    block: list[tuple] = []
    for row in items.toLocalIterator():
        for part in parts_of(row[0], row[1], part_words, answer_words):
            block.append(part)
            if len(block) == block_parts:
                out, block = pass_over(out, block), []
    if block:
        out = pass_over(out, block)
    free(written)
    if mark not in out.columns:
        out = out.withColumn(mark, F.expr(f"cast(array() as array<{MATCH}>)"))
    return out.select(*(F.col(f"`{c}`") for c in keep), F.col(mark).alias(FOUND) if FOUND not in keep else F.col(mark))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id_col, matches) for every row of docs."""
    return with_leaks(docs, benchmark, [id_col], **options).toDF(id_col, "matches")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    found = with_leaks(docs, benchmark, docs.columns, **options)
    return found.where(F.size(found.columns[-1]) == 0).drop(found.columns[-1])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items it leaks."""
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    return found.select("doc_id", (F.size("matches") == 0).alias("kept"), items.alias("item_ids"), F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)), 6).alias("best_share"))
