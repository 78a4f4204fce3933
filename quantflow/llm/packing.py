"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Only the lengths decide how pieces share sequences, and there are at most ``size`` different
ones. So the plan is made from the histogram of lengths (bounded whatever the input): each
step fills one sequence greedily from the longest piece down, then replaces its smallest piece
by two unpacked ones that fit the widened gap more tightly, and repeats this filling for as
many sequences as the counts allow. Every piece then finds its place from its rank among the
pieces of its length; ranks come from windows over salted groups, so a length that many pieces
share is never sorted by one task.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantflow.llm.shared import chunks, run_folder, spread, staged
from quantflow.llm.tokens import encode_chunk

SALTS = 256             # parts of one length's pieces, at least
GROUP_ROWS = 100_000    # pieces in a part on average, at most


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids followed by ``end_id``, cut
    only where they exceed ``size``. The first piece takes what is over, so that all others
    fill a sequence. A null or empty text is the single id ``end_id``."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in chunks(batches, 1):
            ids, at = encode_chunk(batch.column(1), tokenizer)
            n = len(at) - 1
            row = np.full(len(ids) + n, end_id, "<u4")
            row[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
            raw, at = memoryview(row.tobytes()), at + np.arange(n + 1)
            length = np.diff(at)
            count = -(-length // size)
            doc = np.repeat(np.arange(n), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            over = (length - (count - 1) * size)[doc]
            start = np.where(piece == 0, 0, over + (piece - 1) * size)
            long = np.where(piece == 0, over, size)
            first = at[doc] + start
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(first.tolist(), (first + long).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(long, pa.int64()), pa.array(crc, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


@dataclass
class Plan:
    """Places by (length, rank): pieces of ``length`` with rank in [low, low + count) stand in
    the sequences from ``sequence`` on, ``each`` to a sequence, the first at ``offset``."""
    length: np.ndarray
    low: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def best_two_fit(counts: dict[int, int], size: int) -> Plan:
    """Plan for the pieces counted by length."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    ranked = np.zeros(size + 1, np.int64)
    rows, sequences = [], 0
    while left.any():
        held: dict[int, int] = {}

        def room(length):
            return int(left[length]) - held.get(length, 0)

        gap = size
        there = np.flatnonzero(left)
        at = len(there) - 1
        while gap and at >= 0:
            at = min(at, int(np.searchsorted(there, gap, side="right")) - 1)
            if at >= 0:
                length = int(there[at])
                n = min(gap // length, room(length))
                if n:
                    held[length] = held.get(length, 0) + n
                    gap -= n * length
                at -= 1
        while gap and sum(held.values()) > 1:
            smallest = min(held)
            spare = left.copy()
            for length, n in held.items():
                spare[length] -= n
            there = np.flatnonzero(spare)
            space = gap + smallest
            there = there[there < space]
            if not len(there):
                break
            mate = np.searchsorted(there, np.minimum(space - there, there), side="right") - 1
            single = (mate >= 0) & (there[mate] == there) & (spare[there] < 2)
            mate = np.where(single, mate - 1, mate)
            both = np.where(mate >= 0, there + there[mate], 0)
            best = int(both.argmax())
            if both[best] <= smallest:
                break
            held[smallest] -= 1
            if not held[smallest]:
                del held[smallest]
            for length in (int(there[best]), int(there[mate[best]])):
                held[length] = held.get(length, 0) + 1
            gap = space - int(both[best])
        times = min(int(left[length]) // n for length, n in held.items())
        offset = 0
        for length in sorted(held, reverse=True):
            n = held[length]
            rows.append((length, int(ranked[length]), n, sequences, offset))
            ranked[length] += n * times
            left[length] -= n * times
            offset += n * length
        sequences += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences)


def pack(cut: DataFrame, size: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Give every piece (id, piece, start, length, ...) a ``sequence_id`` and an ``offset``.

    Lengths must lie in 1..size. Pieces of equal length may trade places; repeated rows get
    places of their own; an empty table gives no rows.
    """
    n = cut.count()
    salts = max(SALTS, spread(n, GROUP_ROWS))
    order = [c for c in cut.columns if c != "length"]
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if counts and (min(counts) < 1 or max(counts) > size):
        raise ValueError(f"piece lengths must lie in 1..{size}")
    plan = best_two_fit(counts, size)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_salt").orderBy(*order)
    ranked = (salted.withColumn("_rank", F.row_number().over(within).cast("long") - 1)
              .join(base, ["length", "_salt"])
              .select(*cut.columns, (F.col("_base") + F.col("_rank")).alias("_rank")))
    columns, at = list(cut.columns), cut.columns.index("length")
    key = plan.length * (1 << 44) + plan.low

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (at, len(columns)))
            row = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            nth = rank - plan.low[row]
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1] + [pa.array(plan.sequence[row] + nth // plan.each[row]),
                                      pa.array(plan.offset[row] + nth % plan.each[row] * length)],
                names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequences. The pieces are written once in the shared
    folder: ranks and counts must see the same rows even if an executor is lost."""
    spark = docs.sparkSession
    folder = run_folder(spark, "packing")
    return pack(staged(pieces(docs, tokenizer, size, 0, id_col, text_col), folder, "pieces"), size, id_col)
