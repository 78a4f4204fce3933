"""Suffix arrays by linear grouping of Lyndon prefixes, for many texts in step.

Suffixes start out in groups by first symbol. Groups are processed in descending order: each
suffix of the group looks up its previous suffix in a lower group (its previous-smaller
pointer), and the suffixes that are pointed to leave their groups for new ones right behind
them, those with more pointers behind those with fewer. In the end a group holds the suffixes
with the same longest Lyndon prefix, in order of those prefixes. A second pass in ascending
order writes the suffix array: each suffix that is reached puts the chain of previous-smaller
pointers before it into the next free places of their groups. Nothing is renamed and nothing
recurses. Texts do not depend on each other, so numpy takes one group of every text at a time.
"""

from __future__ import annotations

import numpy as np


def grouped(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """First pass: (group, pointer) of every suffix; a group is named by its first place in the
    suffix array, a pointer is -1 where no smaller suffix precedes."""
    n = len(symbols)
    text = np.repeat(np.arange(len(starts)), ends - starts)
    base = starts[text]
    order = np.lexsort((symbols, text))
    sorted_text, sorted_symbol = text[order], symbols[order]
    new = np.append(True, (sorted_text[1:] != sorted_text[:-1]) | (sorted_symbol[1:] != sorted_symbol[:-1]))[:n]
    first = np.flatnonzero(new)
    size = np.zeros(n, np.int64)
    size[first] = np.diff(np.append(first, n))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group = np.empty(n, np.int64)
    group[order] = np.repeat(first, size[first])
    pointer = np.arange(n) - 1
    pointer[starts] = -1
    mark = np.zeros(n, bool)
    top = ends.copy()
    while True:
        live = top > starts
        if not live.any():
            return group, pointer
        low = group[order[top[live] - 1]]
        width = top[live] - low
        member = order[np.arange(int(width.sum())) + np.repeat(low - (np.cumsum(width) - width), width)]
        own = group[member]
        move = np.arange(len(member))
        while len(move):  # skip suffixes of groups that are not lower; pointers double
            at = pointer[member[move]]
            move, at = move[at >= 0], at[at >= 0]
            high = group[at] >= own[move]
            move, at = move[high], at[high]
            pointer[member[move]] = pointer[at]
        target = pointer[member]
        target, times = np.unique(target[target >= 0], return_counts=True)
        for k in np.unique(times)[::-1]:
            leaving = target[times == k]
            leaving = leaving[np.argsort(group[leaving], kind="stable")]
            old, count = np.unique(group[leaving], return_counts=True)
            fresh = old + size[old] - count
            slots = np.arange(len(leaving)) + np.repeat(fresh - (np.cumsum(count) - count), count)
            at = place[leaving]
            mark[at] = True
            out, free = at[at < np.repeat(fresh, count)], slots[~mark[slots]]
            mark[at] = False
            a, b = order[out], order[free]
            order[out], order[free] = b, a
            place[a], place[b] = free, out
            size[old] -= count
            size[fresh] = count
            group[leaving] = np.repeat(fresh, count)
        top[live] = low


def suffix_arrays(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array of each text ``symbols[ends[i - 1]:ends[i]]``, in the text's own range,
    as positions in ``symbols``. The last symbol of a text must be its only smallest one; texts
    must not be empty."""
    ends = np.asarray(ends, np.int64)
    starts = np.append(0, ends[:-1])
    group, pointer = grouped(symbols, starts, ends)
    n = len(symbols)
    out = np.full(n, -1, np.int64)
    free = np.arange(n)              # next free place of a group
    placed = np.zeros(n, bool)
    out[starts] = ends - 1
    placed[ends - 1] = True
    at, base, end = starts.copy(), starts, ends
    while len(at):
        suffix = out[at] - 1
        chain = np.flatnonzero(suffix >= base)
        suffix = suffix[chain]
        while len(chain):
            open_ = ~placed[suffix]
            suffix = suffix[open_]
            if not len(suffix):
                break
            own = group[suffix]
            out[free[own]] = suffix
            free[own] += 1
            placed[suffix] = True
            suffix = pointer[suffix]
            suffix = suffix[suffix >= 0]
            chain = suffix
        at = at + 1
        more = at < end
        if not more.all():
            at, base, end = at[more], base[more], end[more]
    return out


def repeated_starts(symbols: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Mask of the positions whose ``length`` symbols also start elsewhere in their text: those
    with a neighbour in the suffix array that shares as many."""
    sa = suffix_arrays(symbols, ends)
    n = len(symbols)
    a, b = sa[:-1], sa[1:]
    text = np.searchsorted(ends, np.arange(n), side="right")
    same = text[a] == text[b]
    a, b = a[same], b[same]
    for k in range(length):
        fit = (a + k < n) & (b + k < n)
        fit[fit] &= symbols[a[fit] + k] == symbols[b[fit] + k]
        a, b = a[fit], b[fit]
    mask = np.zeros(n, bool)
    mask[a], mask[b] = True, True
    return mask
