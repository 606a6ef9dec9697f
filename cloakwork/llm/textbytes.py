"""Numpy over the UTF-8 bytes of many texts at once: words, their hashes, shingles.

Texts come as Arrow arrays, so their bytes lie in one buffer. Blocks of at most BLOCK_BYTES
(or one text, if it is longer) bound the memory, and within a block bytes are looked at in
stretches of STRETCH, so that of a long text only what is found is held, not several numbers a byte.
Hashes are 64 bits: a polynomial over the bytes of a word, from prefix sums, through a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
STRETCH = 2 << 20
BASE = 0x9E3779B97F4A7C15 | 1
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, bounds of the rows in them); null is empty."""
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        past = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1)
        yield first, past, data[offsets[first] : offsets[past]], offsets[first : past + 1] - offsets[first]
        first = past


class _Kept(dict):
    """A cache of the process: it travels empty."""

    def __reduce__(self):
        return _Kept, ()


_POWERS = _Kept()


def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to a stretch."""
    if not _POWERS:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            factors = np.full(STRETCH, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def stretches(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, bytes, the texts they belong to) of each stretch of a block."""
    for first in range(0, len(data), STRETCH):
        past = min(first + STRETCH, len(data))
        size = np.clip(bounds[1:], first, past) - np.clip(bounds[:-1], first, past)
        yield first, data[first:past], np.repeat(np.arange(len(bounds) - 1), size)


def _pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sum, begin, end) of words by stretch: one that a stretch cuts comes in pieces."""
    up, down = powers()
    for first in range(0, len(data), STRETCH):
        own = data[first : first + STRETCH]
        inside = ~SPACES[own]
        edge = np.zeros(len(own) + 1, bool)  # a text begins here, so a word that reaches it ends
        low, high = np.searchsorted(bounds, [first, first + len(own)], "left")
        edge[bounds[low : high + 1][bounds[low : high + 1] <= first + len(own)] - first] = True
        edge[[0, -1]] = True
        begins = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((own.astype(np.uint64) + np.uint64(1)) * up[: len(own)], dtype=np.uint64)])
        yield (total[ends] - total[begins]) * down[begins], begins + first, ends + first


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, length in bytes) of the words between ASCII white space, in order."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums, begins, ends = (np.concatenate(x) for x in zip(*_pieces(data, bounds), strict=True))
    # A piece that goes on in the next stretch of its text joins it.
    cut = np.flatnonzero((ends[:-1] == begins[1:]) & (ends[:-1] % STRETCH == 0) & ~np.isin(ends[:-1], bounds))
    for k in cut[::-1].tolist():
        sums[k : k + 1] += sums[k + 1 : k + 2] * np.uint64(pow(BASE, int(ends[k] - begins[k]), 2**64))
        ends[k] = ends[k + 1]
    if len(cut):
        keep = np.ones(len(sums), bool)
        keep[cut + 1] = False
        sums, begins, ends = sums[keep], begins[keep], ends[keep]
    return mixed(sums, 1), np.searchsorted(bounds, begins, "right") - 1, ends - begins


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``size`` consecutive words by row, both sorted by row, then hash.

    A row of fewer words, but not none, has its whole sequence as one shingle.
    """
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    place = np.arange(len(row)) - first[row]
    starts = np.flatnonzero(place <= np.maximum(count[row] - size, 0))
    here = row[starts]
    short = count[here] < size
    combined = np.full(len(starts), 0, np.uint64)
    for k in range(size):
        there = (place[starts] + k) < count[here]
        word = np.where(there, hashes[np.minimum(starts + k, len(hashes) - 1)], np.uint64(0))
        combined = combined * np.uint64(BASE) + word
    combined = mixed(combined + np.where(short, count[here], 0).astype(np.uint64), 2)
    order = np.lexsort((combined, here))
    combined, here = combined[order], here[order]
    fresh = np.ones(len(here), bool)
    fresh[1:] = (combined[1:] != combined[:-1]) | (here[1:] != here[:-1])
    return combined[fresh], here[fresh]
