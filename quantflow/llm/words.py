"""Words of whole texts as slices of one run of UTF-8 bytes, for a run of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quantflow.llm.shared import binary_array

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def byte_class(outside: bytes) -> np.ndarray:
    """Which bytes belong to words: all but those of ``outside`` (ASCII only)."""
    inside = np.ones(256, bool)
    inside[list(outside)] = False
    return inside


def word_slices(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every maximal run of ``inside`` bytes; runs end where texts do."""
    mask = inside[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    begins, ends = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1] | first[1:-1]
    ends[:-1] &= ~mask[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The (ordered, disjoint) slices of a byte run as an Arrow binary array."""
    edges = np.empty(2 * len(start) + 2, np.int64)
    edges[0], edges[-1] = 0, len(data)
    edges[1:-1:2], edges[2:-1:2] = start, end
    return binary_array(data, edges).take(pa.array(np.arange(len(start)) * 2 + 1)).cast(pa.binary())


def lower_words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words with A-Z lower-cased, the text of each, and where each begins."""
    start, end, doc = word_slices(data, at, inside)
    return slices(LOWER[data], start, end).dictionary_encode(), doc, start
