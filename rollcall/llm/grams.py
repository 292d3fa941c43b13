"""Hashed character n-grams of whole texts, vectorised over batches (numpy, used inside tasks)."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def gram_buckets(texts: list[str], widths: range, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every n-gram of every lower-cased text, for all widths; repeats included."""
    low = [t.lower() for t in texts]
    code = np.frombuffer(("\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(t) + 1 for t in low])
    owner = np.repeat(np.arange(len(low)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code)) - 1  # characters of the same text from here on
    rolled, docs, buckets = np.zeros(len(code), np.uint64), [], []
    for n in range(1, widths.stop):
        rolled = rolled[: len(code) - n + 1] * _U(0x100000001B3) + (code[n - 1 :] + _U(n))
        if n in widths:
            ok = left[: len(rolled)] >= n
            docs.append(owner[: len(rolled)][ok])
            buckets.append(((rolled[ok] * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(buckets)


def presence(texts: list[str], widths: range, bits: int) -> np.ndarray:
    """A row of 0 and 1 for each text: which buckets its n-grams fall in."""
    out = np.zeros((len(texts), 1 << bits), np.uint8)
    rows, cols = gram_buckets(texts, widths, bits)
    out[rows, cols] = 1
    return out
