"""Exact links between components, decided block by block in shared prefix trees.

Nodes that meet at a token form a block; a token with many nodes is dealt into parts, and every
two parts form a block of their own, so no block outgrows its bounds and a hot token is the
work of many tasks. Two passes look at blocks. The first holds sizes, places and parity
sketches against each other; the nodes that may be linked across components, tied together by
a spanning forest, make groups, so that every set is moved for one group and not for each
token. The second takes a group as a block: it puts the ordered sets of a block into one
prefix tree, walks it with all of them at once and gives out a spanning forest of the links it
finds. A group that ties chain together beyond the bounds of a block is not held against itself:
linked nodes are tied in a block of the first pass, so the nodes tied there are a block again.
Pairs of nodes are rows in such forests only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantflow.llm.shared import gather, spread
from quantflow.llm.shingles import mix

BLOCK_NODES = 1024       # nodes in a part of a token's block
BLOCK_VALUES = 1 << 19   # values of their sets
BUNDLE_NODES = 20_000    # nodes of all blocks that one task call takes
FEW = 16                 # nodes of blocks that are looked through together
BLOCK = ["token", "x", "y"]


def block_parts():
    """Parts that ``count`` nodes with ``total`` values are dealt into."""
    return F.least("count", F.ceil(F.greatest(F.col("count") / BLOCK_NODES, F.col("total") / BLOCK_VALUES)))


def with_blocks(at: DataFrame, tokens: DataFrame) -> DataFrame:
    """``at`` (token, node, ...), each row once for each block (x, y) of its token that the node
    is in. ``tokens`` (token, count, total) has the number of nodes and the sum of their sizes."""
    part = F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts"))
    return (at.join(tokens.select("token", block_parts().alias("parts")), "token").withColumn("part", part)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
            .withColumn("x", F.least("part", "other").cast("int")).withColumn("y", F.greatest("part", "other").cast("int"))
            .drop("parts", "part", "other"))


def group_blocks(able: DataFrame, ties: DataFrame, large: DataFrame) -> DataFrame:
    """Nodes ``able`` (token, node, ...), one row each, with the block they are searched in: their
    group ``token``, or for a ``large`` one (token) each set of nodes that ``ties`` (a, b, block)
    tie in a block of the first pass, equal sets once."""
    small = able.join(large, "token", "left_anti")
    tied = ties.select(F.explode(F.array("a", "b")).alias("node"), "block").distinct()
    rest = able.join(large, "token", "left_semi").drop("token").join(tied, "node").withColumnRenamed("block", "token")
    return small.unionByName(rest).withColumn("x", F.lit(0)).withColumn("y", F.lit(0))


def bundled(blocks: DataFrame, n: int, most: int):
    return blocks.withColumn("bundle", F.pmod(F.xxhash64(*BLOCK), F.lit(spread(n, most)))).groupBy("bundle")


def block_bounds(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and their end."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.append(np.flatnonzero(new), n)


class Sketches:
    """Parity sketches of the rows of a table, as slices of one run of words."""

    def __init__(self, column: pa.Array, order: np.ndarray):
        column = column.take(pa.array(order))
        at = column.offsets.to_numpy().astype(np.int64)
        self.words, self.start, self.width = column.flatten().to_numpy().view(np.uint64), at[:-1] - at[0], np.diff(at)

    def short(self) -> np.ndarray:
        """All sketches folded to one word."""
        return np.bitwise_xor.reduceat(self.words, self.start)

    def differ(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Bits in which row ``i`` and each of ``rows``, whose sketches are as long or longer, differ."""
        width, out = self.width[i], np.empty(len(rows), np.int64)
        own = self.words[self.start[i]:self.start[i] + width]
        for longer in np.unique(self.width[rows]):
            some = self.width[rows] == longer
            held = self.words[self.start[rows[some]][:, None] + np.arange(longer)]
            held = np.bitwise_xor.reduce(held.reshape(len(held), longer // width, width), axis=1)
            out[some] = np.bitwise_count(held ^ own).sum(1)
        return out


def may_hold_ties(bounds: np.ndarray, size: np.ndarray, left: np.ndarray, root: np.ndarray, word: np.ndarray | None,
                  percent: int) -> np.ndarray:
    """Blocks in which some pair may be linked, as far as sketches of one ``word`` tell. Most have
    a few nodes, which are compared for all blocks at once; larger ones count as such."""
    count = np.diff(bounds)
    hold = count > FEW
    block = np.repeat(np.arange(len(count)), count)
    stop = bounds[1:][block]
    i = np.flatnonzero(~hold[block])
    for gap in range(1, FEW):
        i = i[i + gap < stop[i]]
        i = i[~hold[block[i]]]
        j = i + gap
        total = size[i] + size[j]  # sorted by size
        able = (root[i] != root[j]) & (size[j] * percent <= size[i] * 100)
        able &= np.minimum(left[i], left[j]) * (100 + percent) >= total * percent
        if word is not None:
            able &= (total - np.bitwise_count(word[i] ^ word[j])) * (100 + percent) >= total * (2 * percent)
        hold[block[i[able]]] = True
    return hold


def may_link(table: pa.Table, percent: int) -> pa.Table:
    """Pairs (a, b) that tie together, block by block, the nodes that may be linked with one of
    another root, as far as sizes, places and sketches tell: a spanning forest of such pairs. Those
    of nodes that are tied together in a block have the same ``block``, a hash of these nodes."""
    token, x, y, node, root, size, place = (table[c].to_numpy() for c in (*BLOCK, "node", "root", "size", "place"))
    order = np.lexsort((size, y, x, token))
    token, x, y, node, root, size, place = (c[order] for c in (token, x, y, node, root, size, place))
    sketches = Sketches(table["sketch"].combine_chunks(), order) if "sketch" in table.column_names else None
    left, group, out, tied = size - place, np.arange(len(order)), [], []
    bounds = block_bounds(token, x, y) if len(order) else np.zeros(1, np.int64)
    hold = may_hold_ties(bounds, size, left, root, sketches.short() if sketches and len(order) else None, percent)
    for low, high in zip(bounds[:-1][hold], bounds[1:][hold]):
        if (root[low:high] == root[low]).all():
            continue
        # partners of a row are those after it, as they are sorted by size
        stop = low + np.searchsorted(size[low:high] * percent, size[low:high] * 100, side="right")
        for i in range(low, high - 1):
            after = slice(i + 1, stop[i - low])
            total = size[i] + size[after]
            near = (root[after] != root[i]) & (group[after] != group[i])
            rows = i + 1 + np.flatnonzero(near & (np.minimum(left[i], left[after]) * (100 + percent) >= total * percent))
            if len(rows) and sketches is not None:
                total = size[i] + size[rows]
                rows = rows[(total - sketches.differ(i, rows)) * (100 + percent) >= total * (2 * percent)]
            if len(rows):
                other, first = np.unique(group[rows], return_index=True)
                out += [(node[i], node[k]) for k in rows[first]]
                tied += [i] * len(first)
                block = group[low:high]
                block[np.isin(block, other)] = group[i]
    a, b = np.array(out, np.int64).reshape(-1, 2).T
    total = np.zeros(len(order), np.uint64)
    np.add.at(total, group, mix(node.view(np.uint64), 91))
    return pa.table({"a": a, "b": b, "block": total[group[np.array(tied, np.int64)]].view(np.int64)})


def tree_links(tree, sets: list[np.ndarray], root: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest, between different roots, of the links of ``sets``, which are inserted
    into ``tree`` under their numbers. The walk carries the overlap of every set with the path
    it has come, and leaves a subtree when no set can have a link below."""
    for k, values in enumerate(sets):
        tree.insert(values, k)
    size = np.array([len(s) for s in sets])
    known, code = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), size)[np.argsort(code, kind="stable")]
    count = np.bincount(code, minlength=len(known))
    first = np.cumsum(count) - count
    _, label = np.unique(root, return_inverse=True)
    links, walk = [], [(tree, 0, np.zeros(len(sets), np.int64), np.arange(len(sets)))]
    while walk and (label != label[0]).any():
        node, depth, overlap, live = walk.pop()
        if len(node.edge):
            at = np.searchsorted(known, node.edge)
            overlap = overlap + np.bincount(holder[gather(first[at], count[at])], minlength=len(sets))
            depth += len(node.edge)
        if node.ends:
            found = live[100 * overlap[live] >= percent * (size[live] + depth - overlap[live])]
            for end in node.ends:
                other, place = np.unique(label[found], return_index=True)
                fresh = other != label[end]
                links += [(end, int(k)) for k in found[place[fresh]]]
                label[np.isin(label, other[fresh])] = label[end]
        for child in node.children.values():
            # the longest set below, or one that ends when the own set is used up, if all that
            # is left of it overlapped
            long = np.minimum(child.longest, depth + size[live] - overlap[live])
            most = overlap[live] + long - depth
            able = live[100 * most >= percent * (size[live] + long - most)]
            if len(able) > 1:
                walk.append((child, depth, overlap, able))
    return links


def block_links(table: pa.Table, percent: int, new_tree) -> pa.Table:
    """Links (a, b) between different roots that join the sets of each block as all of its
    links would."""
    token, x, y, node, root = (table[c].to_numpy() for c in (*BLOCK, "node", "root"))
    order = np.lexsort((node, y, x, token))
    token, x, y, node, root = (c[order] for c in (token, x, y, node, root))
    values = table["values"].combine_chunks().take(pa.array(order))
    at, flat = values.offsets.to_numpy(), values.values.to_numpy()
    out = []
    bounds = block_bounds(token, x, y) if len(order) else np.zeros(1, np.int64)
    for low, high in zip(bounds[:-1], bounds[1:]):
        sets = [flat[at[k]:at[k + 1]] for k in range(low, high)]
        out += [(node[low + a], node[low + b]) for a, b in tree_links(new_tree(), sets, root[low:high], percent)]
    a, b = np.array(out, np.int64).reshape(-1, 2).T
    return pa.table({"a": a, "b": b})
