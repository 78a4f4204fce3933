"""Pre-tokens of byte-level BPE texts, found for a whole run of texts at once with numpy.

The pattern splits at changes between letters, digits, other marks and white space; a single
space joins the run after it, white space before a word gives up its last character, and an
English contraction at the start of a run stands alone. Characters that the Unicode tables
here do not know are not guessed: their texts are reported and the caller hands them whole to
the tokenizer library.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from quantflow.llm.shared import binary_array, worker_state

SPACE, LETTER, DIGIT, OTHER, UNKNOWN = 0, 1, 2, 3, 9

# Unicode's White_Space characters.
WHITE_SPACE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))
        if kind[0] == "L":
            table[cp] = LETTER
        elif kind[0] == "N":
            table[cp] = DIGIT
        elif kind == "Cn":
            table[cp] = UNKNOWN
    table[WHITE_SPACE] = SPACE
    return table


def token_starts(data: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the pre-tokens of the texts ``data[docs[i]:docs[i + 1]]`` start,
    and a mask of the texts that hold a character of unknown class."""
    unknown = np.zeros(len(docs) - 1, bool)
    if not len(data):
        return np.zeros(0, np.int64), unknown
    table = worker_state("char-classes", _classes)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    kind = table[cp]
    n = len(cp)
    first = np.searchsorted(at, docs[:-1][docs[:-1] < docs[1:]])
    begins = np.zeros(n + 3, bool)
    begins[first] = True
    odd = np.flatnonzero(kind == UNKNOWN)
    if len(odd):
        unknown[np.unique(np.searchsorted(docs, at[odd], side="right") - 1)] = True

    new_doc = begins[:n].copy()
    mark = begins[:n]
    mark[1:] |= kind[1:] != kind[:-1]
    # white space before a word: its last character leaves it, and a space joins the word
    after = np.flatnonzero(mark[1:] & (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~new_doc[1:]) + 1
    mark[after - 1] = True
    mark[after[cp[after - 1] == 0x20]] = False
    # contractions
    quote = np.flatnonzero(mark[:-1] & (cp[:-1] == 0x27) & (kind[1:] == LETTER) & ~new_doc[1:]) if n > 1 else []
    if len(quote):
        a = cp[quote + 1]
        short = quote[np.isin(a, [ord(c) for c in "stmd"])]
        begins[short + 1] = False
        begins[short + 2] = True
        rest = quote[(quote + 2 < n)]
        rest = rest[~new_doc[rest + 2]]
        a, b = cp[rest + 1], cp[rest + 2]
        long = rest[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e")))
                    | ((a == ord("l")) & (b == ord("l")))]
        begins[long + 1] = False
        begins[long + 3] = True
    return at[np.flatnonzero(begins[:n])], unknown


def pretokens(data: np.ndarray, docs: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The pre-tokens of a run of texts as a dictionary-encoded binary array, the number of
    pre-tokens of each text, and the mask of texts with unknown characters."""
    starts, unknown = token_starts(data, docs)
    words = binary_array(data, np.append(starts, len(data))) if len(starts) else pa.array([], pa.large_binary())
    counts = np.diff(np.searchsorted(starts, docs))
    return words.dictionary_encode(), counts, unknown
