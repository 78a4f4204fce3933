"""Token counts by a map-side two-tier lookup, and the token ids the packer needs.

Tier one is a broadcast hash table: pre-token -> number of tokens, for the most frequent
pre-tokens of the corpus. Tier two is a cache in each Python worker, filled by the tokenizer
library itself. No pre-token is shuffled: each task sums its texts up on its own; only bounded
summaries of frequent pre-tokens (``TABLE_SIZE`` rows a task) meet to build the table.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantflow.llm.pretokens import pretokens
from quantflow.llm.shared import Generations, bound_batches, chunks, gather, text_bytes, worker_state

TABLE_SIZE = 20_000      # pre-tokens in the broadcast table (about 1 MB), whatever the input
CACHE_SIZE = 150_000     # pre-tokens in each of the two generations that a worker holds
ID_BYTES = array("I").itemsize
LONG_WORD = 64           # longer pre-tokens are encoded, never held


def load(path: str):
    """The library's tokenizer, loaded once a worker."""
    def make():
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        return Tokenizer.from_file(path)
    return worker_state(("tokenizer", path), make)


def special_strings(path: str) -> list[bytes]:
    """Strings that the library cuts out of a text before it looks for pre-tokens."""
    return worker_state(("special", path), lambda: [
        str(t.content).encode() for t in load(path).get_added_tokens_decoder().values()])


class WordIds:
    """Token ids of pre-tokens, four bytes each: the worker's cache, filled by the library in
    batches."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.held = worker_state(("ids", path), lambda: Generations(CACHE_SIZE))

    def look_up(self, words: list[bytes]) -> list[bytes]:
        out = self.held.get_all(words)
        miss = [i for i, ids in enumerate(out) if ids is None]
        if miss:
            for a in range(0, len(miss), 4096):
                part = miss[a:a + 4096]
                made = self.tokenizer.encode_batch_fast([words[i].decode() for i in part], add_special_tokens=False)
                for i, e in zip(part, made):
                    out[i] = ids = array("I", e.ids).tobytes()
                    if len(words[i]) <= LONG_WORD:
                        self.held.put(words[i], ids)
        return out


def by_library(data: np.ndarray, docs: np.ndarray, unknown: np.ndarray, path: str) -> np.ndarray:
    """Texts that go whole to the library: those with a special string or with characters
    that the splitter does not know."""
    whole = unknown.copy()
    raw = data.tobytes()
    for s in special_strings(path):
        at = raw.find(s)
        while s and at >= 0:
            doc = int(np.searchsorted(docs, at, side="right")) - 1
            if at + len(s) <= docs[doc + 1]:
                whole[doc] = True
            at = raw.find(s, at + 1)
    return np.flatnonzero(whole)


def encode_chunk(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a run of texts: all ids in a row, and the offsets (n + 1) of each text's."""
    data, docs = text_bytes(column)
    words, counts, unknown = pretokens(data, docs)
    ids = WordIds(path).look_up(words.dictionary.to_pylist())
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // ID_BYTES
    flat = np.frombuffer(b"".join(ids), np.uintc).astype(np.int64)
    first = np.cumsum(size) - size
    code = words.indices.to_numpy()
    tokens = flat[gather(first[code], size[code])]
    ends = np.append(0, np.cumsum(size[code]))
    at = ends[np.append(0, np.cumsum(counts))]
    whole = by_library(data, docs, unknown, path)
    if not len(whole):
        return tokens, at
    parts = [tokens[at[i]:at[i + 1]] for i in range(len(docs) - 1)]
    for i in whole:
        text = data[docs[i]:docs[i + 1]].tobytes().decode()
        parts[i] = np.array(load(path).encode(text, add_special_tokens=False).ids, np.int64)
    return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))


# ---------------------------------------------------------------- frequent pre-tokens

def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}
    for batch in chunks(batches, 0):
        words, _, _ = pretokens(*text_bytes(batch.column(0)))
        seen = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
        often = np.argsort(-seen, kind="stable")[:4 * TABLE_SIZE]
        for w, n in zip(words.dictionary.take(pa.array(often)).to_pylist(), seen[often].tolist()):
            if len(w) <= LONG_WORD:
                held[w] = held.get(w, 0) + n
        if len(held) > 8 * TABLE_SIZE:
            held = dict(sorted(held.items(), key=lambda x: -x[1])[:4 * TABLE_SIZE])
    top = sorted(held.items(), key=lambda x: (-x[1], x[0]))[:TABLE_SIZE]
    if top:
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in top], pa.binary()),
                                          "n": pa.array([n for _, n in top], pa.int64())})


def frequent_pretokens(docs: DataFrame, text_col: str = "text", most: int = TABLE_SIZE) -> list[bytes]:
    """The most frequent pre-tokens over all texts. Tasks count their own texts and hand over
    their ``TABLE_SIZE`` top counts; the list has ``most`` words at most. It only decides
    which words are looked up in the first tier, never a result."""
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(
        _summaries, "word binary, n bigint")
    top = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [bytes(r["word"]) for r in top.select("word").collect()]


# ---------------------------------------------------------------- counts

def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, as the library counts them without added special tokens.

    Returns (id, n_bytes, n_tokens, over_limit). A null or empty text has 0 bytes and 0
    tokens. Repeated rows and null ids are counted row by row; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    often = frequent_pretokens(docs, text_col)
    lengths = {w: len(ids) // ID_BYTES for w, ids in zip(often, WordIds(tokenizer).look_up(often))}
    table = spark.sparkContext.broadcast(lengths)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        first, second = table.value, WordIds(tokenizer)
        for batch in chunks(batches, 1):
            data, at = text_bytes(batch.column(1))
            words, counts, unknown = pretokens(data, at)
            distinct = words.dictionary.to_pylist()
            size = [first.get(w, -1) for w in distinct]
            miss = [i for i, n in enumerate(size) if n < 0]
            for i, ids in zip(miss, second.look_up([distinct[i] for i in miss])):
                size[i] = len(ids) // ID_BYTES
            ends = np.append(0, np.cumsum(np.array(size, np.int64)[words.indices.to_numpy()]))
            n = np.diff(ends[np.append(0, np.cumsum(counts))])
            for i in by_library(data, at, unknown, tokenizer):
                text = data[at[i]:at[i + 1]].tobytes().decode()
                n[i] = len(load(tokenizer).encode(text, add_special_tokens=False).ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at)), pa.array(n), pc.greater(pa.array(n), limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
