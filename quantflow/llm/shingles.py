"""Word shingles of whole texts as 64-bit hashes, for a run of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scatter 64-bit values (an invertible shift-multiply mix)."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word (A-Z lower-cased) of all texts in a row, and each text's number
    of words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    words = lists.flatten()
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    real = pc.not_equal(words, "")
    words = words.filter(real).dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.dictionary.cast(pa.binary()).to_pylist()),
                        np.uint64, len(words.dictionary))
    return table[words.indices.to_numpy()], np.bincount(doc[real.to_numpy(zero_copy_only=False)], minlength=len(lists))


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``n`` words of each run of words: (run, hash), sorted by both. A
    run with fewer words has its whole sequence as the one shingle; an empty run has none."""
    ends = np.cumsum(counts)
    size = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    run = np.repeat(np.arange(len(counts)), size)
    at = np.arange(int(size.sum())) + np.repeat((ends - counts) - (np.cumsum(size) - size), size)
    value = np.zeros(len(at), np.uint64)
    left = ends[run] - at
    for k in range(n):
        has = left > k
        value[has] = mix(value[has] * MULTIPLIER + hashes[at[has] + k], k)
    order = np.lexsort((value, run))
    run, value = run[order], value[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (value[1:] != value[:-1])
    return run[new], value[new]


def text_shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    return shingles(*word_hashes(column), n)


def set_keys(run: np.ndarray, value: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and a 128-bit key of each run's set, whatever order it is summed in."""
    def total(seed):
        ends = np.append(np.uint64(0), np.cumsum(mix(value, seed)))
        at = np.searchsorted(run, np.arange(runs + 1))
        return (ends[at[1:]] - ends[at[:-1]]).view(np.int64)
    return np.bincount(run, minlength=runs).astype(np.int64), total(101), total(202)
