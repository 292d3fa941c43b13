"""Vectorised word and shingle hashing over batches of whole texts (numpy, used inside tasks).

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased unless told otherwise. Hashes are 64-bit and
depend on nothing but the bytes, so every executor computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, in order, and for each text the index of its first word (one more at the end)."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    firsts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    joined = b"\n".join([b"", *raw, b""])
    buf = np.frombuffer(joined.lower() if lower else joined, np.uint8)[1:]
    word = ~_SPACE[buf]
    starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    buf = buf[starts[0] :]
    at = starts - starts[0]
    long = np.diff(np.append(at, len(buf)))
    pos = np.arange(len(buf)) - np.repeat(at, long)
    hashes = mix(np.add.reduceat(_BYTE[buf] * _powers(int(long.max()))[pos], at))
    return hashes, np.searchsorted(starts, firsts)


def shingle_sets(texts: list[str | None], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each text the number of words and the sorted distinct hashes of its ``width``-word shingles; of fewer words, the whole sequence is one."""
    hashes, firsts = word_hashes(texts)
    rolled = hashes.copy()
    for j in range(1, min(width, max(len(hashes), 1))):
        rolled = mix(rolled[: len(hashes) - j] * _U(_BASE) + hashes[j:])
    for a, b in zip(firsts[:-1], firsts[1:]):
        n = int(b - a)
        if n >= width:
            yield n, np.unique(rolled[a : b - width + 1])
        elif n:
            one = hashes[a : a + 1]
            for j in range(1, n):
                one = mix(one * _U(_BASE) + hashes[a + j : a + j + 1])
            yield n, mix(one + _U(n))
        else:
            yield 0, np.zeros(0, np.uint64)


def text_chunks(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges (from, to, texts) of whole texts of about ``size`` bytes together; a longer text is a range of its own. Only one range is turned into Python strings at a time."""
    length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(length):
        if i > start and held + n > size:
            yield start, i, column.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += int(n)
    if len(length):
        yield start, len(length), column.slice(start).to_pylist()
