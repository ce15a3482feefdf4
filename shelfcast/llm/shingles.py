"""Word shingles and MinHash inside a task; nothing here knows of Spark."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS_PER_SHINGLE = 5
# Odd multipliers that tie a word's hash to its place in the shingle (fixed, for repeatable hashes).
PLACES = np.random.default_rng(5).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
CACHE = 1 << 20


class WordHashes(dict):
    """Hash of each word met, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that sums of word hashes spread evenly."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def shingle_set(text: str | None, hashes: WordHashes, words: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of `words` words. Words are parted by ASCII white space.

    A text of fewer words is one shingle of all its words; a text without words has none.
    """
    split = text.encode("utf-8", "surrogatepass").split() if text else []
    if not split:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, split), np.uint64, len(split))
    width = min(words, len(each))
    count = len(each) - width + 1
    total = np.full(count, width, np.uint64)
    for place in range(width):
        total += each[place:place + count] * PLACES[place]
    return np.unique(mixed(total))


def minhashes(sets: list[np.ndarray], count: int, seed: int, chunk: int = 1 << 16) -> np.ndarray:
    """One row of `count` 32-bit MinHash values per non-empty set."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 63, count, dtype=np.uint64) | np.uint64(1)
    shifts = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    out = np.empty((len(sets), count), np.uint32)
    start = 0
    while start < len(sets):
        end, size = start, 0
        while end < len(sets) and (end == start or size + len(sets[end]) <= chunk):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[start:end])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[start:end]])[:-1]])
        hashed = np.empty_like(flat)
        for k in range(count):
            np.multiply(flat, factors[k], out=hashed)
            np.add(hashed, shifts[k], out=hashed)
            np.right_shift(hashed, np.uint64(32), out=hashed)
            out[start:end, k] = np.minimum.reduceat(hashed, starts)
        start = end
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of `rows` MinHash values; the band's number is part of it."""
    bands = signatures.shape[1] // rows
    keys = np.empty((len(signatures), bands), np.int64)
    for band in range(bands):
        total = np.full(len(signatures), band + 1, np.uint64)
        for row in range(rows):
            total = mixed(total + signatures[:, band * rows + row].astype(np.uint64) * PLACES[row])
        keys[:, band] = total.view(np.int64)
    return keys


def least_matches(compared: int, threshold: float, tolerance: float, bits: int) -> int:
    """The fewest equal values among `compared` that keep a pair.

    A value of `bits` bits is equal with probability p = s + (1 - s) / 2^bits for similarity s.
    With a uniform prior on p, a pair is dropped when the posterior probability that s reaches
    the threshold is below `tolerance`.
    """
    chance = 2.0 ** -bits
    p = np.linspace(chance, 1, 20001)[1:-1]
    reach = threshold + (1 - threshold) * chance
    for equal in range(compared + 1):
        log = equal * np.log(p) + (compared - equal) * np.log1p(-p)
        weight = np.exp(log - log.max())
        if weight[p >= reach].sum() / weight.sum() >= tolerance:
            return equal
    return compared


def overlaps(sets: list[np.ndarray], columns: int = 1 << 13) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays."""
    if len(sets) <= 8:
        out = np.diag([len(s) for s in sets]).astype(np.int64)
        for i, a in enumerate(sets):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(a, sets[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[code] > 1
    renumber = np.cumsum(seen > 1) - 1
    code, owner = renumber[code[shared]], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(sets), len(sets)))
    kept = int((seen > 1).sum())
    for start in range(0, kept, columns):
        low, high = np.searchsorted(code, [start, start + columns])
        held = np.zeros((len(sets), min(columns, kept - start)), np.float32)
        held[owner[low:high], code[low:high] - start] = 1
        out += held @ held.T
    out = out.astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out
