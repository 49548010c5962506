"""Word and shingle hashes of whole batches of texts, by prefix sums over their UTF-8 bytes.

A word is hashed as a polynomial over random numbers that stand for its bytes, modulo 2**64, then
mixed with its length. The hashes of all words of a batch come from one running sum, so the cost
is a few array operations per byte. Texts are handled in parts cut between words, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PART = 1 << 20
_RNG = np.random.default_rng(20240518)
SIGNS = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # a random number for every byte
BASE = int(_RNG.integers(1 << 60, 1 << 62)) * 2 + 1
IS_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWERED_SIGNS = SIGNS[np.arange(256) + 32 * np.isin(np.arange(256), range(0x41, 0x5B))]


@lru_cache(1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""

    def row(base: int) -> np.ndarray:
        out = np.ones(size, np.uint64)
        out[1:] = np.uint64(base)
        return np.multiply.accumulate(out)

    return row(BASE), row(pow(BASE, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hashes(body: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in UTF-8 bytes, and where the words begin."""
    inside = np.zeros(len(body) + 2, bool)
    inside[1:-1] = ~IS_BLANK[body]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    up, down = powers(1 << max(16, int(len(body)).bit_length()))
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(signs[body] * up[: len(body)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)), begin


def hashes_of_words(body: bytes | np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Word hashes of one text, in parts cut between words."""
    data, found, at = np.frombuffer(body, np.uint8), [], 0
    while at < len(data):
        end = min(len(data), at + PART)
        while end < len(data):
            gap = np.flatnonzero(IS_BLANK[data[end : end + PART]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + PART)
        found.append(word_hashes(data[at:end], signs)[0])
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words."""
    size = min(n, len(words))
    if not size:
        return words
    runs = len(words) - size + 1
    out = np.full(runs, size, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0xC2B2AE3D27D4EB4F) ^ words[i : i + runs])
    return np.unique(out)


def words_of(texts: pa.Array, lower: bool) -> Iterator[np.ndarray]:
    """The word hashes of every text of an Arrow array, A-Z lowered or not; neighbours of less than a
    part are hashed together."""
    signs = LOWERED_SIGNS if lower else SIGNS
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PART, "right")) - 1)
        if j == i + 1:
            yield hashes_of_words(data[offsets[i] : offsets[j]], signs)
        else:
            # a blank behind every text keeps their words apart
            cuts = offsets[i : j + 1] - offsets[i]
            body = np.insert(data[offsets[i] : offsets[j]], cuts[1:-1], 0x20)
            words, begin = word_hashes(body, signs)
            at = np.searchsorted(begin, cuts + np.arange(len(cuts)))
            at[-1] = len(begin)
            for a, b in zip(at[:-1], at[1:]):
                yield words[a:b]
        i = j


def digest(values: np.ndarray) -> bytes:
    """128 bits that tell sequences of hashes apart."""
    return hashlib.blake2b(np.ascontiguousarray(values).tobytes(), digest_size=16).digest()
