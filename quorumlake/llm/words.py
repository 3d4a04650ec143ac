"""Words of texts, hashed in bulk.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
Texts are walked as UTF-8 bytes with numpy, so there is no Python work per word (but for those of
more than LONGEST bytes).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; small enough to stay in a CPU's cache.
CHUNK = 1 << 19
#: Longest word that is hashed by random multipliers, one pair for each place; longer ones go through BLAKE2.
LONGEST = 1024

_rng = np.random.Generator(np.random.PCG64(20240607))
#: Independent random multipliers for each place of a word, twice.
_KEYS = _rng.integers(0, 1 << 64, (2, LONGEST), dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, *range(0x09, 0x0E)]] = True
#: A byte's value in a hash: never 0 within a word, so words of different lengths differ; 0 for separators.
_VALUE = _LOWER.astype(np.uint64) + np.uint64(1)
_VALUE[_IS_SEP] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and each text's bounds in them (null: empty)."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def segment_sums(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 56-bit sums for each of the segments of values that begin at starts (the first at 0), each of at most LONGEST values below 512.

    The sums are multilinear, over independent random multipliers (not powers of one radix, so no
    pattern cancels): two different segments agree in one with probability 2**-56, in both with 2**-112.
    """
    place = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    np.minimum(place, LONGEST - 1, out=place)
    one, two = (np.add.reduceat(values * key[place], starts) >> np.uint64(8) for key in _KEYS)
    return one, two


def hash_segments(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the same segments, made from both sums."""
    one, two = segment_sums(values, starts)
    return mix(mix(one) + two)


def _hash_part(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sep = _IS_SEP[data]
    first = np.ones(len(data), bool)
    first[1:] = sep[:-1]
    inner = bounds[1:-1]
    first[inner[inner < len(data)]] = True
    starts = np.flatnonzero(first & ~sep)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    # separators after a word weigh nothing, so a word's segment may run up to the next word
    hashes = hash_segments(_VALUE[data[starts[0] :]], starts - starts[0])
    ends = np.append(starts[1:], len(data))
    for i in np.flatnonzero(ends - starts > LONGEST):
        own = data[starts[i] : ends[i]]
        size = len(own) - int(sep[starts[i] : ends[i]][::-1].argmin())
        if size > LONGEST:
            hashes[i] = int.from_bytes(hashlib.blake2b(_LOWER[own[:size]].tobytes(), digest_size=8).digest(), "little")
    return hashes, np.diff(np.searchsorted(starts, bounds))


def hash_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, number of words of each text).

    Null and empty texts have no words.
    """
    data, bounds = text_bytes(texts)
    hashes, counts, i, n = [], [], 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, "right")) - 1)
        h, c = _hash_part(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        hashes.append(h)
        counts.append(c)
        i = j
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each text's shingles, number of them per text).

    A text of 1 to size - 1 words has one shingle, the whole sequence; one without words has none.
    """
    hashes, counts = hash_words(texts)
    starts = np.concatenate([[0], np.cumsum(counts)])
    made = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    doc = np.repeat(np.arange(len(counts)), made)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made) + starts[doc]
    short = counts[doc] < size
    out = np.full(len(doc), np.uint64(size))
    for k in range(size):
        there = ~short | (k < counts[doc])
        word = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else out
        out = np.where(there, mix(out * np.uint64(0xD6E8FEB86659FD93) + word), out)
    # a sort by text, then hash: texts are already in order, so each is sorted in its own slice
    bounds, sizes, kept = np.concatenate([[0], np.cumsum(made)]), np.zeros(len(counts), np.int64), []
    for i in np.flatnonzero(made):
        own = np.unique(out[bounds[i] : bounds[i + 1]])
        sizes[i] = len(own)
        kept.append(own)
    return (np.concatenate(kept) if kept else np.zeros(0, np.uint64)), sizes
