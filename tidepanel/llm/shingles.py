"""Hashed sets of word shingles of whole texts, computed on Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidepanel.llm.common import SPACES, mix, row_runs, seeds, utf8

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_BYTE = seeds(256, 1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + n // 4, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word in the bytes and a 64-bit hash of it (A-Z lower-cased)."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return start, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    A text with fewer words than a shingle has its whole sequence as one; without words the set is empty.
    """
    data, at = utf8(column)
    factor = seeds(words, 2) | np.uint64(1)
    with np.errstate(over="ignore"):
        for lo, hi in row_runs(at):
            # a space after each row, so that words end with their text
            size = int(at[hi] - at[lo])
            rows = at[lo : hi + 1] - at[lo]
            padded = np.full(size + hi - lo, 0x20, np.uint8)
            shift = np.repeat(np.arange(hi - lo), np.diff(rows))
            padded[np.arange(size) + shift] = data[at[lo] : at[hi]]
            start, h = word_hashes(padded)
            cut = np.searchsorted(start, rows + np.arange(hi - lo + 1))
            grams = np.zeros(max(0, len(h) - words + 1), np.uint64)
            for j in range(words):
                grams += h[j : j + len(grams)] * factor[j]
            grams = mix(grams)
            for i in range(hi - lo):
                a, b = int(cut[i]), int(cut[i + 1])
                if b - a >= words:
                    yield np.unique(grams[a : b - words + 1])
                elif b > a:
                    yield mix((h[a:b] * factor[: b - a]).sum(keepdims=True) + np.uint64(b - a))
                else:
                    yield np.zeros(0, np.uint64)
