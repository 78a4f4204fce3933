"""Byte-level BPE by merge replay over a corpus's distinct pre-tokens, and decoding.

A task takes the distinct pre-tokens of a run of texts, lays their bytes out as one row of
symbols, and keeps an inverted index from merge rank (that is: token pair) to the positions
at which the pair stands. Merges are replayed in rank order; each touches only the positions
of its pair and enters the new pairs of the two neighbours into the index.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantflow.llm.pretokens import pretokens
from quantflow.llm.shared import Generations, binary_array, chunks, gather, text_bytes, worker_state

CACHE_SIZE = 150_000      # pre-tokens in each of the two generations that a worker holds
CHUNK_BYTES = 12 << 20    # text that one replay covers
LONG_WORD = 64
SHIFT = 1 << 20


class Merges:
    """Ranks of a vocabulary file, one ``base64 rank`` pair a line: token bytes <-> id, and the
    id that each pair of tokens merges to (its rank is that id)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {self.ids[t[:k]] * SHIFT + self.ids[t[k:]]: i for t, i in self.ids.items()
                      for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids}
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.ranks = np.array([self.pairs[k] for k in self.keys.tolist()], np.int32)
        top = max(self.tokens) + 1
        size = np.zeros(top, np.int64)
        for i, t in self.tokens.items():
            size[i] = len(t)
        self.size, self.first = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(top)), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair merges to, or -1."""
        key = a.astype(np.int64) * SHIFT + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1).astype(np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens in a row."""
        return self.bytes[gather(self.first[ids], self.size[ids])]


def merges(path: str) -> Merges:
    return worker_state(("merges", path), lambda: Merges(path))


def replay(words: list[bytes], m: Merges) -> list[tuple[int, ...]]:
    """Token ids of each word: every merge in rank order over all words at once.

    ``index`` maps a rank to the positions of its pairs; ``rank_at`` holds the rank of the pair
    that now begins at a position, so entries that a later merge made stale are passed over."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    n = int(ends[-1]) if len(words) else 0
    symbol = m.byte[np.frombuffer(b"".join(words), np.uint8)]
    right, left = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    last = ends[np.diff(ends, prepend=0) > 0] - 1
    right[last] = -1
    left[last[:-1] + 1] = -1
    left[:1] = -1
    rank_at = np.full(n, -1, np.int32)
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(at: np.ndarray, ranks: np.ndarray) -> None:
        rank_at[at] = ranks
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        if len(at) > 1:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, a, b in zip(ranks[np.append(0, cut)].tolist() if len(at) else [], [0, *cut.tolist()], [*cut.tolist(), len(at)]):
            if rank not in index:
                index[rank] = []
                heapq.heappush(queue, rank)
            index[rank].append(at[a:b])

    begin = np.flatnonzero(right >= 0)
    enter(begin, m.rank(symbol[begin], symbol[begin + 1]))
    backward = []  # positions at which a merge made a pair of no higher rank than its own
    while queue:
        rank = heapq.heappop(queue)
        places = np.concatenate(index.pop(rank))
        places = places[rank_at[places] == rank]
        if len(places) > 1:
            places = np.unique(places)
        if not len(places):
            continue
        second = right[places]
        linked = second[:-1] == places[1:]
        if linked.any():  # a run of one symbol: every other pair of it, from the left
            number = np.arange(len(places))
            start = np.maximum.accumulate(np.where(np.append(False, linked), 0, number))
            places = places[(number - start) % 2 == 0]
            second = right[places]
        symbol[places], symbol[second], rank_at[second] = rank, -1, -1
        after = right[second]
        right[places] = after
        has = after >= 0
        left[after[has]] = places[has]
        before = left[places]
        rank_at[places[~has]] = -1
        head = before >= 0
        at = np.concatenate([places[has], before[head]])
        ranks = m.rank(symbol[at], symbol[right[at]])
        low = (ranks >= 0) & (ranks <= rank)
        if low.any():
            backward.append(at[low])
        enter(at, ranks)
    alive = symbol >= 0
    bounds = np.append(0, np.cumsum(alive))[np.append(0, ends)].tolist()
    ids = symbol[alive].tolist()
    out = [tuple(ids[a:b]) for a, b in zip(bounds, bounds[1:])]
    for word in np.unique(np.searchsorted(ends, np.concatenate(backward), side="right")) if backward else ():
        out[word] = one_by_one(words[word], m)
    return out


def one_by_one(word: bytes, m: Merges) -> tuple[int, ...]:
    """A single word, always merging the leftmost pair of the lowest rank. For words in which
    a merge opens one of lower rank, where replaying whole ranks could differ."""
    symbol = m.byte[np.frombuffer(word, np.uint8)].tolist()
    while len(symbol) > 1:
        rank, i = min((m.pairs.get(a * SHIFT + b, SHIFT), i) for i, (a, b) in enumerate(zip(symbol, symbol[1:])))
        if rank == SHIFT:
            break
        symbol[i:i + 2] = [rank]
    return tuple(symbol)


def encode_words(words: list[bytes], path: str) -> list[tuple[int, ...]]:
    """Ids of distinct words, from the worker's cache or by a replay of those it lacks."""
    held = worker_state(("bpe-ids", path), lambda: Generations(CACHE_SIZE))
    out = held.get_all(words)
    m = merges(path)
    miss = []
    for i, w in enumerate(words):
        if out[i] is None:
            if w in m.ids:  # a pre-token of the vocabulary is its own id, without merges
                out[i] = (m.ids[w],)
            else:
                miss.append(i)
    for i, ids in zip(miss, replay([words[i] for i in miss], m)):
        out[i] = ids
        if len(words[i]) <= LONG_WORD:
            held.put(words[i], ids)
    return out


def encode_texts(column: pa.Array, ranks: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a run of texts in a row, and the offsets (n + 1) of each text's ids."""
    data, docs = text_bytes(column)
    words, counts, unknown = pretokens(data, docs)
    if unknown.any():  # unknown characters: split these texts by the pattern itself
        import regex
        split = regex.compile(pattern)
        pieces, at, parts = words.cast(pa.large_binary()).to_pylist(), 0, []
        for i, n in enumerate(counts):
            text = data[docs[i]:docs[i + 1]].tobytes()
            parts.append([w.encode() for w in split.findall(text.decode())] if unknown[i] else pieces[at:at + n])
            at += n
        words = pa.array(list(chain.from_iterable(parts)), pa.large_binary()).dictionary_encode()
        counts = np.array([len(p) for p in parts])
    ids = encode_words(words.dictionary.to_pylist(), ranks)
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum()))
    code = words.indices.to_numpy()
    tokens = flat[gather((np.cumsum(size) - size)[code], size[code])]
    ends = np.append(0, np.cumsum(size[code]))
    return tokens, ends[np.append(0, np.cumsum(counts))]


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, ids) of every whole text: ids as little-endian unsigned 32-bit integers in one
    binary value. A null or empty text has none. Rows are encoded one by one, so repeated
    rows and null ids stay as they are; other columns are ignored."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in chunks(batches, 1, CHUNK_BYTES):
            ids, at = encode_texts(batch.column(1), ranks, pattern)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), binary_array(ids.astype("<u4").view(np.uint8), at * 4).cast(pa.binary())],
                names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, ids binary")


def decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes): the bytes that each row's ids stand for. Null ids give no bytes."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        m = merges(ranks)
        for batch in chunks(batches, 1, CHUNK_BYTES):
            raw, at = text_bytes(batch.column(1))
            ids = raw.view("<u4")
            ends = np.append(0, np.cumsum(m.size[ids]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), binary_array(m.decode(ids), ends[at // 4]).cast(pa.binary())], names=[id_col, "bytes"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, bytes binary")


def digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row, encoded and decoded run by run
    in one task, so that no ids leave it."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = merges(ranks)
        for batch in chunks(batches, 1, CHUNK_BYTES):
            ids, at = encode_texts(batch.column(1), ranks, pattern)
            raw = memoryview(ids.astype("<u4").tobytes())
            ends = np.append(0, np.cumsum(m.size[ids]))[at]
            text = memoryview(m.decode(ids).tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.diff(at)),
                pa.array([hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(at, at[1:])], pa.string()),
                pa.array([hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string()),
            ], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
