"""Words of whole texts as 64-bit hashes, many texts at a time without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: ASCII letters in lower case; white space becomes a space, all else stays.
LOWER = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, but ASCII punctuation and controls separate words too.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK = 1 << 15
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of an odd base modulo 2^64, as many as were ever needed."""

    def __init__(self, base: int) -> None:
        self.base, self.known = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            self.known = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n, BLOCK + 1) - 1, self.base)])
        return self.known[:n]


FORWARD, BACKWARD = Powers(_BASE), Powers(_INVERSE)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batches_of(texts: list[bytes], most: int = 1 << 18) -> Iterator[list[bytes]]:
    """The texts in order, some most bytes at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def word_hashes(texts: list[bytes], table: bytes = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts in order, number of words of each text)."""
    found = [hashes_at_once(some, table) for some in batches_of(texts)]
    if len(found) == 1:
        return found[0]
    return np.concatenate([h for h, _ in found] or [np.zeros(0, np.uint64)]), np.concatenate([n for _, n in found] or [np.zeros(0, np.int64)])


def hashes_at_once(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() of texts that are taken in one piece.

    A word's hash is its polynomial in an odd base modulo 2^64, mixed: a sum
    over its bytes. Blocks of bytes end between words, so they are longer
    than BLOCK only where one word is.
    """
    raw = b" " + b" ".join(t.translate(table) for t in texts) + b" "
    letters = np.frombuffer(raw, np.uint8)
    inside = letters != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        begin = starts[at]
        upto = max(int(np.searchsorted(ends, begin + BLOCK, side="right")), at + 1)
        block = letters[begin : ends[upto - 1]].astype(np.uint64) + np.uint64(1)
        block *= FORWARD.upto(len(block))
        sums = np.cumsum(block, out=block)
        a, b = starts[at:upto] - begin, ends[at:upto] - begin
        before = sums[a - 1]
        before[a == 0] = 0
        out[at:upto] = (sums[b - 1] - before) * BACKWARD.upto(len(block))[a]
        at = upto
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return mixed(out), np.diff(np.searchsorted(starts, bounds))
