"""Distinct word n-gram sets of whole texts, as sorted 64-bit hashes, a whole Arrow batch at a time.

Words are maximal runs of bytes other than space and ``\\t \\n \\v \\f \\r``; ``A-Z`` are lower-cased. A word's hash is
a polynomial over its bytes (differences of one prefix sum over the batch), a shingle's hash a mixed
combination of its words' hashes. A text with fewer than ``n`` words has its whole sequence as one
shingle; a text without words, or null, has none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C13)  # = 3 mod 8: powers differ in all but a few low bits
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_SPAN = 1 << 18
_SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


@lru_cache(maxsize=4)
def _byte_tables(separators: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Random value of every byte after lower-casing (0 for separators), and which bytes are in words."""
    values = np.random.default_rng(20240117).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    in_word = np.ones(256, dtype=bool)
    in_word[list(separators)] = False
    values[~in_word] = 0
    return values, in_word


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n, mod 2**64; kept for the process."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 18)
        for name, base in (("up", _P), ("down", _PINV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each (nulls are empty)."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words begin (one more entry at the end)."""
    hashes, at = hash_words(texts, _SEPARATORS)
    return hashes[0], at


def hash_words(texts: pa.Array, separators, prefixes: tuple[int, ...] = ()) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words, then of their first bytes (as many as ``prefixes`` says), and where each text's words begin."""
    raw, offsets = text_buffers(texts)
    n = len(raw)
    if n == 0:
        return [np.zeros(0, dtype=np.uint64)] * (1 + len(prefixes)), np.zeros(len(offsets), dtype=np.int64)
    values, in_word = _byte_tables(tuple(separators))
    word = in_word[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = word[cut]  # texts don't run together
    ends[cut - 1] = word[cut - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = [np.empty(len(starts), dtype=np.uint64) for _ in range(1 + len(prefixes))]
    at = 0
    while at < len(starts):  # some words at a time, to bound the memory of a long text
        to = max(at + 1, int(np.searchsorted(stops, starts[at] + _SPAN, side="right")))
        low, high = int(starts[at]), int(stops[to - 1])
        up, down = _powers(high - low + 1)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(values[raw[low:high]] * up[: high - low], out=sums[1:])
        a, b = starts[at:to] - low, stops[at:to] - low
        for out, most in zip(hashes, (None, *prefixes), strict=True):
            c = b if most is None else np.minimum(b, a + most)
            out[at:to] = mix((sums[c] - sums[a]) * down[a] + ((c - a) * 8 + (most or 0)).astype(np.uint64))
        at = to
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes (uint64)."""
    words, at = word_hashes(texts)
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(n)]
    total = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for k in range(n):
        total += words[k: k + len(total)] * factors[k]
    total = mix(total)
    out = []
    for i in range(len(at) - 1):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= n:
            found = np.sort(total[a: b - n + 1])
            keep = np.ones(len(found), dtype=bool)
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            out.append(found[keep])
        elif b > a:
            weights = np.array(factors[: b - a], dtype=np.uint64)
            length = np.array([b - a], dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D)
            out.append(mix((words[a:b] * weights).sum(dtype=np.uint64, keepdims=True) + length))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
