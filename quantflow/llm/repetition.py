"""Quality rules on repetition within a document, by a suffix array over its words.

The words of a run of documents are one sequence; a document's suffixes never tie with
another's. Prefix doubling sorts them, re-sorting only suffixes that still tie, and the rank
of each level gives the common prefix of neighbours. A position's longest repeat is the
deepest common-prefix interval that holds it; the union of those spans is the union of all
maximal repeated substrings, so nothing is listed once per occurrence and interval.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantflow.llm.shared import chunks

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Limits:
    """A document fails the base rules with fewer than ``min_words`` words or with more than
    ``max_window_percent`` percent of them in repeated windows of ``window`` words. The suffix
    array rule takes repeats of ``min_repeat`` words or more: they may cover
    ``max_covered`` of the document's word characters, and none may be longer than
    ``max_longest`` words."""
    min_words: int = 10
    window: int = 5
    max_window_percent: int = 20
    min_repeat: int = 4
    max_covered: float = 0.25
    max_longest: int = 100


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and the number of each text's words."""
    lists = pc.ascii_split_whitespace(column.fill_null(""))
    words = lists.flatten()
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    real = pc.not_equal(words, "")
    return words.filter(real), np.bincount(doc[real.to_numpy(zero_copy_only=False)], minlength=len(lists))


def longest_repeats(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring that starts there and also
    starts elsewhere in its document. ``codes``: word numbers; ``ends``: end of each
    position's document."""
    n = len(codes)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    key = doc.astype(np.int64) * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    changed = np.flatnonzero(np.diff(key[order], prepend=-1))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(changed, np.diff(np.append(changed, n)))
    levels, width = [rank], 1
    place = np.arange(n)     # of each still tied entry in the suffix array
    while True:
        rank = levels[-1]
        tied = order[place]
        size = np.bincount(rank[tied], minlength=n)
        keep = size[rank[tied]] > 1
        place, tied = place[keep], tied[keep]
        if not len(tied):
            break
        reach = tied + width
        following = np.where(reach < ends[tied], rank[np.minimum(reach, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + following
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        order[place] = tied
        new = rank.copy()
        first = np.append(True, key[1:] != key[:-1])
        new[tied] = place[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        levels.append(new)
        width *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    row = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[row], b[row]
    common = np.zeros(len(row), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        fit = (a + width <= ends[order[row]]) & (b + width <= ends[order[row + 1]])
        fit[fit] &= levels[k][a[fit]] == levels[k][b[fit]]
        a[fit] += width
        b[fit] += width
        common[fit] += width
    np.maximum.at(best, order[row], common)
    np.maximum.at(best, order[row + 1], common)
    return best


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """Mask of the positions inside a repeat of ``least`` words or more."""
    n = len(best)
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(best >= least)
    step[at] += 1
    np.subtract.at(step, at + best[at], 1)
    return np.cumsum(step[:n]) > 0


def measure(column: pa.Array, limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """Measures and verdict of each text; a null text has no words."""
    column = column.fill_null("")
    n = len(column)
    words, n_words = split_words(column)
    doc = np.repeat(np.arange(n), n_words)
    ends = np.repeat(np.cumsum(n_words), n_words)
    chars = pc.utf8_length(words).to_numpy().astype(np.int64)
    word_chars = np.bincount(doc, chars, n).astype(np.int64)
    lines = pc.split_pattern(column, "\n")
    line_doc = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    lines = lines.flatten()
    full = pc.not_equal(pc.ascii_trim_whitespace(lines), "").to_numpy(zero_copy_only=False)
    line_doc, lines = line_doc[full], lines.filter(pa.array(full)).dictionary_encode()
    line_key = line_doc.astype(np.int64) * max(1, len(lines.dictionary)) + lines.indices.to_numpy()
    distinct = np.unique(line_key) // max(1, len(lines.dictionary))
    n_dup_lines = np.bincount(line_doc, minlength=n) - np.bincount(distinct, minlength=n)
    best = longest_repeats(words.dictionary_encode().indices.to_numpy(), doc, ends)
    n_repeat_words = np.bincount(doc, covered(best, limits.window), n).astype(np.int64)
    covered_chars = np.bincount(doc, covered(best, limits.min_repeat) * chars, n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, best)
    fraction = covered_chars / np.maximum(word_chars, 1)
    base_failed = (n_words < limits.min_words) | (100 * n_repeat_words > limits.max_window_percent * n_words)
    kept = ~base_failed & (fraction <= limits.max_covered) & (longest <= limits.max_longest)
    return {"n_words": n_words.astype(np.int64), "word_chars": word_chars,
            "n_symbols": pc.count_substring_regex(column, SYMBOLS).to_numpy().astype(np.int64),
            "n_dup_lines": n_dup_lines.astype(np.int64), "n_repeat_words": n_repeat_words,
            "base_failed": base_failed, "kept": kept, "covered_fraction": fraction, "longest_repeat": longest}


KINDS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
         "base_failed boolean, kept boolean, covered_fraction double, longest_repeat bigint")


def quality(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict of each row: (id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, covered_fraction, longest_repeat). Null and empty texts
    have no words and fail the base rules. Rows are judged one by one; other columns are
    ignored."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in chunks(batches, 1):
            found = measure(batch.column(1), limits)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], names=[id_col, *found])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, {KINDS}")


def repeat_spans(docs: DataFrame, least: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_word, n_words): the union of all maximal repeats of ``least`` words or more,
    as maximal runs of words."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in chunks(batches, 1):
            words, n_words = split_words(batch.column(1))
            doc = np.repeat(np.arange(len(n_words)), n_words)
            first = np.cumsum(n_words) - n_words
            mask = covered(longest_repeats(words.dictionary_encode().indices.to_numpy(), doc, first[doc] + n_words[doc]), least)
            edge = np.append(True, doc[1:] != doc[:-1])[:len(doc)]
            start = np.flatnonzero(mask & (edge | ~np.append(False, mask[:-1])[:len(mask)]))
            stop = np.flatnonzero(mask & np.append(edge[1:] | ~mask[1:], True)[:len(mask)]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc[start])), pa.array(start - first[doc[start]]), pa.array(stop - start)],
                names=[id_col, "first_word", "n_words"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type}, first_word bigint, n_words bigint")


def keep_good(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all of their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in chunks(batches, at):
            yield batch.filter(pa.array(measure(batch.column(at), limits)["kept"]))

    return docs.mapInArrow(run, docs.schema)
