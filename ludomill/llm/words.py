"""Words of whole texts as 64-bit hashes, in numpy.

A word is a maximal run of bytes outside space and 09-0D.  UTF-8 keeps these
bytes out of longer characters, so the split works on bytes.  Word hashes come
from one running polynomial sum over a block of bytes, so their cost is a few
array operations per block whatever the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Words as the contracts state them.
WORD = r"[^\x20\x09-\x0D]+"

# Bytes worked on at a time; bounds the memory of a task whatever the texts.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole value (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def _block_hashes(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of one block; ``first`` marks bytes that begin a text."""
    word = ~_SPACE[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first))
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:] & ~first[1:]
    ends = np.flatnonzero(word & ~after) + 1
    size = max(len(data), BLOCK)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, size)[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _powers(_BACK, size)[starts]
    return starts, mix(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


class Words:
    """Word hashes of some texts: those of text ``i`` are ``hashes[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        lo, hi = int(offsets[0]), int(offsets[-1])
        starts, hashes, at = [], [], lo
        while at < hi:
            end = min(at + BLOCK, hi)
            while end < hi and not _SPACE[data[end]]:  # a block ends before a space or with the texts
                stop = min(end + BLOCK, hi)
                found = np.flatnonzero(_SPACE[data[end:stop]])
                end = end + int(found[0]) if len(found) else stop
            block = data[at:end]
            first = np.zeros(len(block), bool)
            inside = offsets[(offsets >= at) & (offsets < end)] - at
            first[inside] = True
            begun, values = _block_hashes(_LOWER[block] if lower else block, first)
            starts.append(begun + at)
            hashes.append(values)
            at = end
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        begins = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.bounds = np.searchsorted(begins, offsets)
        if texts.null_count:
            # A null may cover bytes in the buffer; its words do not count.
            null = np.asarray(texts.is_null().to_numpy(zero_copy_only=False))
            counts = np.where(null, 0, np.diff(self.bounds))
            keep = ~np.repeat(null, np.diff(self.bounds))
            self.hashes = self.hashes[keep]
            self.bounds = np.concatenate([[0], np.cumsum(counts)])

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Text number and hash of every run of ``width`` words; a shorter text is one run."""
        bounds, hashes = self.bounds, self.hashes
        counts = np.diff(bounds)
        texts = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
        if len(hashes) >= width:
            runs = hashes[: len(hashes) - width + 1].copy()
            for j in range(1, width):
                runs = mix(runs * np.uint64(0xD6E8FEB86659FD93) + hashes[j : len(hashes) - width + 1 + j])
            owner = np.repeat(np.arange(len(counts)), counts)[: len(runs)]
            runs = runs[np.arange(len(runs)) + width <= bounds[1:][owner]]
        else:
            runs = np.zeros(0, np.uint64)
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            extra = np.empty(len(short), np.uint64)
            for i, text in enumerate(short):
                value = np.array([counts[text]], np.uint64)
                for word in hashes[bounds[text] : bounds[text + 1]]:
                    value = mix(value * np.uint64(0xA0761D6478BD642F) + word)
                extra[i] = value[0]
            texts, runs = np.concatenate([texts, short]), np.concatenate([runs, extra])
            order = np.argsort(texts, kind="stable")
            texts, runs = texts[order], runs[order]
        return texts, runs


def text_parts(texts: pa.Array, limit: int = 2 * BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    total, at = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > at and total + size > limit:
            yield at, row
            at, total = row, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)
