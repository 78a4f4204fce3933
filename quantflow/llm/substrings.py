"""Exact removal of byte strings that occur more than once in a corpus, by suffix arrays.

A string of ``LENGTH`` bytes is found again wherever it occurs through an anchor: the k-gram
of least hash inside it. Equal strings have equal anchors at equal offsets, so only texts
around anchors whose gram occurs again are looked at:

1. every text gives its anchors (about one in 60 bytes) with a hash of the ``SIDE`` bytes on
   both sides; anchors whose gram occurs once in the corpus are dropped;
2. where a whole surrounding occurs again, all strings at that anchor do, and the surroundings
   go on as one;
3. surroundings that share a gram but differ are cut into bands of offsets; all strings of a
   band share a core, which is one symbol; the suffix array of the remaining ends of all
   surroundings with that core, built by grouping Lyndon prefixes, tells which strings occur
   twice: those with a neighbour that shares a prefix of full length.

A gram with many different surroundings (the edge of a passage that many documents quote) is
dealt out by core instead, in ever narrower bands, so no task meets all of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantflow.llm.lyndon import repeated_starts
from quantflow.llm.shared import chunks, drop_staged, gather, likely_in, run_folder, spread, staged, text_bytes, worker_state
from quantflow.llm.shingles import mix

LENGTH = 200                    # bytes of a string that must not occur twice
GRAM = 40                       # bytes of an anchor
SIDE = LENGTH - GRAM            # bytes on either side of it that a string can reach
BANDS = (16, 4, 1)              # widths of the bands of offsets, each a divisor of the last
GROUP_ROWS = 64                 # surroundings of one gram or core that one suffix array takes
BUNDLE_ROWS = 8_000             # surroundings that one task call takes
FACTOR = 0x9E3779B97F4A7C15
HIGHEST = np.uint64(2 ** 64 - 1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of FACTOR and of its inverse modulo 2^64, n at least, kept by the worker."""
    held = worker_state("powers", dict)
    if len(held.get("up", ())) < n:
        size = max(n, 1 << 16)
        up = np.cumprod(np.append(np.uint64(1), np.full(size, FACTOR, np.uint64)))
        down = np.cumprod(np.append(np.uint64(1), np.full(size, pow(FACTOR, -1, 1 << 64), np.uint64)))
        held["up"], held["down"] = up, down
    return held["up"][:n], held["down"][:n]


BYTE_VALUE = mix(np.arange(256), 7)


def window_extreme(x: np.ndarray, width: int, extreme, fill) -> np.ndarray:
    """Extreme of x[i:i + width] for each i."""
    n = len(x)
    rows = np.append(x, np.full(-n % width + width, fill, x.dtype)).reshape(-1, width)
    before = extreme.accumulate(rows, 1).ravel()
    after = extreme.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return extreme(after[:n], before[width - 1:width - 1 + n])


def anchors(data: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of a run of texts: (gram hash, hash of the surroundings, text, position)."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    up, down = powers(n + 1)
    total = np.append(np.uint64(0), np.cumsum(BYTE_VALUE[data] * up[:n]))
    size = np.diff(docs)
    m = n - GRAM + 1
    doc = np.repeat(np.arange(len(size)), size)
    left = docs[1:][doc] - np.arange(n)          # bytes from here to the end of the text
    gram = mix((total[GRAM:] - total[:-GRAM]) * down[:m])
    gram[left[:m] < GRAM] = HIGHEST
    least = window_extreme(gram, SIDE + 1, np.minimum, HIGHEST)
    least[left[:m] < LENGTH] = 0                 # no string of full length starts here
    reach = window_extreme(np.append(np.zeros(SIDE, np.uint64), least), SIDE + 1, np.maximum, np.uint64(0))[:m]
    at = np.flatnonzero((reach == gram) & (left[:m] >= GRAM))
    doc = doc[at]
    begin, end = docs[:-1][doc], docs[1:][doc]
    low, high = np.maximum(at - SIDE, begin), np.minimum(at + LENGTH, end)
    around = mix((total[high] - total[low]) * down[low], 3) ^ mix((high - low) * 1000 + (at - low), 5)
    return gram[at], around, doc, at - begin


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    array = pa.array(column, pa.binary())
    return text_bytes(array)


def side_matrix(column, width: int, outward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes next to the anchor as rows of ``width``, nearest first, and their numbers. Left
    sides are stored in text order, so ``outward`` reads them backwards."""
    data, at = column_bytes(column)
    size = np.minimum(np.diff(at), width)
    rows = np.zeros((len(size), width), np.uint8)
    k = np.arange(width)
    has = k < size[:, None]
    index = (at[1:, None] - 1 - k) if outward else (at[:-1, None] + k)
    rows[has] = data[index[has]]
    return rows, size


def running_hash(rows: np.ndarray, step: int) -> np.ndarray:
    """Hash of the first 0, step, 2 step ... bytes of each row."""
    width = rows.shape[1]
    up, _ = powers(width + 1)
    total = np.cumsum(BYTE_VALUE[rows] * up[:width], 1)
    return np.column_stack([np.zeros(len(rows), np.uint64), total[:, step - 1::step]])


def cut_bands(key: np.ndarray, left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray,
              band: int) -> tuple[np.ndarray, ...]:
    """Bands of width ``band`` of each row's offsets: (row, core key, lowest offset, bytes on
    the left, their number, bytes on the right, their number), where the row has the core. An
    offset is the number of left bytes that a string takes."""
    side = left.shape[1]
    lefts, rights = running_hash(left, band), running_hash(right, band)
    out = []
    for q in range(side // band):
        low, high = q * band, (q + 1) * band
        row = np.flatnonzero((n_left >= low) & (n_right >= side - high))
        core = mix(mix(key[row] + np.uint64(q), 11) ^ mix(lefts[row, q], 12) ^ mix(rights[row, side // band - q - 1], 13), side)
        out.append((row, core, np.full(len(row), low), left[row, low:high], np.minimum(n_left[row] - low, band),
                    right[row, side - high:side - low], np.minimum(n_right[row] - (side - high), band)))
    return tuple(np.concatenate(c) for c in zip(*out))


def number_groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's group of equal values, size of each group)."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new)
    return number, np.bincount(number)


def ends_hash(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    return mix(running_hash(left, left.shape[1])[:, 1], 21) ^ mix(running_hash(right, right.shape[1])[:, 1], 22) \
        ^ mix(n_left * 64 + n_right, 23)


def repeated_offsets(core: np.ndarray, left: np.ndarray, n_left: np.ndarray, right: np.ndarray,
                     n_right: np.ndarray) -> np.ndarray:
    """For rows of (core, ends), equal ones merged by the caller, a mask rows x (band + 1):
    which strings, by the number of left bytes they take, some other row of the core has too.
    One suffix array a core, over left end, core, right end of each row."""
    band = left.shape[1]
    found = np.zeros((len(core), band + 1), bool)
    number, size = number_groups(core)
    order = np.argsort(number, kind="stable")
    order = order[size[number[order]] > 1]
    if not len(order):
        return found
    _, size = np.unique(number[order], return_counts=True)
    text = np.repeat(np.arange(len(size)), size)
    nl, nr = n_left[order], n_right[order]
    length = nl + nr + 2
    end = np.cumsum(length)
    begin = end - length
    symbols = np.zeros(int(end[-1]), np.int32)
    rank = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    above = np.repeat(size, size)                # symbols of a text: separators, bytes, core
    symbols[end - 1] = above - 1 - rank          # distinct, the last one 0
    symbols[begin + nl] = above + 256
    for k in range(band):
        has = nl > k
        symbols[(begin + nl)[has] - 1 - k] = left[order[has], k].astype(np.int32) + above[has]
        has = nr > k
        symbols[(begin + nl)[has] + 1 + k] = right[order[has], k].astype(np.int32) + above[has]
    mask = repeated_starts(symbols, end[np.cumsum(size) - 1], band + 1)
    for k in range(band + 1):
        has = nl >= k
        found[order[has], k] = mask[(begin + nl)[has] - k]
    return found


def decide(table: pd.DataFrame, side: int) -> pd.DataFrame:
    """Repeated strings of one bundle of surroundings with ``side`` bytes on each side:
    (tid, start, end) byte ranges, for the rows that are not ``done``."""
    key = table["key"].to_numpy().view(np.uint64)
    left, n_left = side_matrix(table["left"], side, True)
    right, n_right = side_matrix(table["right"], side, False)
    band = min(side, BANDS[0])
    row, core, low, left, n_left, right, n_right = cut_bands(key, left, n_left, right, n_right, band)
    number, size = number_groups(core)
    keep = size[number] > 1
    row, core, low, left, n_left, right, n_right = (c[keep] for c in (row, core, low, left, n_left, right, n_right))
    number, size = number_groups(core, ends_hash(left, n_left, right, n_right))
    one = np.unique(number, return_index=True)[1] if len(number) else number
    found = repeated_offsets(core[one], left[one], n_left[one], right[one], n_right[one])[number]
    take = np.arange(band + 1)                   # equal ends: every string that both rows have
    twice = (size[number] > 1)[:, None] & (take <= n_left[:, None]) & (band - take <= n_right[:, None])
    found |= twice
    found &= ~table["done"].to_numpy()[row][:, None]
    band_row, taken = np.nonzero(found)
    at = table["pos"].to_numpy()[row[band_row]] - low[band_row] - taken - table["low"].to_numpy()[row[band_row]]
    tid = table["tid"].to_numpy()[row[band_row]]
    return merged(tid, at, at + LENGTH)


def merged(tid: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """The union of byte ranges, by text."""
    order = np.lexsort((start, tid))
    tid, start, end = tid[order], start[order], end[order]
    if not len(tid):
        return pd.DataFrame({"tid": tid.astype(np.int64), "start": start.astype(np.int64), "end": end.astype(np.int64)})
    # a text's ranges are moved apart from the next text's, then united in one sweep
    text = np.cumsum(np.append(False, tid[1:] != tid[:-1]))
    shift = text * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    first = np.append(True, (start + shift)[1:] > reach[:-1])
    stop = np.append(np.flatnonzero(first)[1:] - 1, len(tid) - 1)
    return pd.DataFrame({"tid": tid[first], "start": start[first], "end": (reach - shift)[stop]})


ROW = "key bigint, left binary, right binary, tid bigint, pos bigint, low int, done boolean"


def narrower(table: DataFrame, band: int) -> DataFrame:
    """Rows of cores instead of rows of grams: each band of offsets of width ``band``."""
    def run(batches):
        for batch in batches:
            key = batch.column("key").to_numpy().view(np.uint64)
            ldata, lat = text_bytes(batch.column("left"))
            width = int(max(np.diff(lat).max(), np.diff(text_bytes(batch.column("right"))[1]).max(), band))
            width = next(w for w in (1, 4, 16, SIDE) if w >= width)
            left, n_left = side_matrix(batch.column("left"), width, True)
            right, n_right = side_matrix(batch.column("right"), width, False)
            row, core, low, left, n_left, right, n_right = cut_bands(key, left, n_left, right, n_right, band)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(core.view(np.int64)),
                 pa.array([bytes(v[:k][::-1]) for v, k in zip(left, n_left)], pa.binary()),
                 pa.array([bytes(v[:k]) for v, k in zip(right, n_right)], pa.binary()),
                 batch.column("tid").take(take), batch.column("pos").take(take),
                 pa.array((low + batch.column("low").to_numpy()[row]).astype(np.int32)), batch.column("done").take(take)],
                names=["key", "left", "right", "tid", "pos", "low", "done"])

    return table.mapInArrow(run, ROW)


def by_suffix_array(rows: DataFrame, side: int) -> DataFrame:
    """(tid, start, end) found among rows whose keys have ``GROUP_ROWS`` rows or so each."""
    bundles = spread(rows.count(), BUNDLE_ROWS)
    return (rows.withColumn("bundle", F.pmod(F.xxhash64("key"), F.lit(max(24, bundles))))
            .groupBy("bundle").applyInPandas(lambda t: decide(t, side), "tid bigint, start bigint, end bigint"))


def large_groups(rows: DataFrame, folder: str) -> list[DataFrame]:
    """Spans found for grams with many surroundings: by cores of ever narrower bands. At each
    width equal ends of a core go on as one row, and rows alone with their core go no further;
    cores with few different ends go to suffix arrays. A core of the narrowest band leaves two
    bytes open, which bounds its rows by 65,536."""
    found, width = [], SIDE
    for band in BANDS:
        cut = narrower(rows, band)
        name = f"band-{band}"
        cut = staged(cut, folder, name)
        many = cut.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        same = ["key", "left", "right"]
        cut_again = staged(cut.join(many, "key"), folder, f"{name}-again")  # apart: a hot key's join can be split
        merged_ends = staged(
            cut_again.groupBy(*same).agg(
                F.count("*").alias("n"), F.min(F.struct("tid", "pos", "low", "done")).alias("one"))
            .select(*same, "n", "one.*"), folder, f"{name}-ends")
        # strings of rows whose ends occur again
        twice = cut_again.where("NOT done").join(merged_ends.where("n > 1").select(*same), same, "left_semi")
        offsets = F.sequence(F.greatest(F.lit(0), band - F.length("right")), F.least(F.lit(band), F.length("left")))
        found.append(staged(twice.where((F.length("left") + F.length("right")) >= band).select(
            "tid", (F.col("pos") - F.col("low") - F.array_max(offsets)).alias("start"),
            (F.col("pos") - F.col("low") - F.array_min(offsets) + LENGTH).alias("end")), folder, f"{name}-twice"))
        rest = merged_ends.select("key", "left", "right", "tid", "pos", "low", (F.col("done") | (F.col("n") > 1)).alias("done"))
        ends = rest.groupBy("key").agg(F.count("*").alias("ends")).where("ends > 1")
        rest = rest.join(ends, "key")
        last = band == BANDS[-1]
        few = rest if last else rest.where(F.col("ends") <= GROUP_ROWS)
        found.append(staged(by_suffix_array(few.drop("ends"), band), folder, f"{name}-found"))
        if not last:
            rows = rest.where(F.col("ends") > GROUP_ROWS).drop("ends")
            if rows.isEmpty():
                break
    return found


def repeated_spans(texts: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """For rows (tid, text): (tid, spans) of all texts in which strings repeat, and the texts
    (tid, text) that share a gram with another place."""
    def find(batches):
        told = set()
        for batch in chunks(batches, 1):
            fresh = []
            for i, tid in enumerate(batch.column(0).to_pylist()):
                if tid not in told:
                    told.add(tid)
                    fresh.append(i)
            batch = batch.take(pa.array(fresh, pa.int64()))
            gram, around, doc, pos = anchors(*text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)), batch.column(0).take(pa.array(doc)),
                 pa.array(pos.astype(np.int32))], names=["gram", "around", "tid", "pos"])

    every = staged(texts.mapInArrow(find, "gram bigint, around bigint, tid bigint, pos int"), folder, "anchors")
    again = every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    # a text that several tasks have seen stands in as many rows, so its anchors may come again
    again = staged(every.join(again, "gram"), folder, "again")
    drop_staged(texts.sparkSession, folder, "anchors")
    kinds = staged(again.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("tid", "pos")).alias("one")),
                   folder, "kinds")
    per_gram = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    whole = (again.join(kinds.where("n > 1").select("gram", "around"), ["gram", "around"], "left_semi")
             .select("tid", F.struct(F.col("pos"), F.lit(True).alias("whole"), F.lit(False).alias("done"),
                                     F.lit(0).cast("bigint").alias("gram"), F.lit(0).cast("bigint").alias("kinds")).alias("at")))
    differ = (kinds.join(per_gram, "gram")
              .select("one.tid", F.struct(F.col("one.pos").alias("pos"), F.lit(False).alias("whole"), (F.col("n") > 1).alias("done"),
                                          "gram", "kinds").alias("at")))
    wanted = whole.unionByName(differ).groupBy("tid").agg(F.collect_set("at").alias("at"))
    wanted = staged(wanted, folder, "wanted")
    likely = likely_in(texts, wanted.select("tid"), "tid").where("_likely").drop("_likely")
    met = staged(likely.join(wanted, "tid").dropDuplicates(["tid"]), folder, "met")

    def surroundings(batches):
        for batch in chunks(batches, 1):
            data, docs = text_bytes(batch.column(1))
            lists = batch.column(2)
            at = lists.flatten()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            keep = ~at.field("whole").to_numpy(zero_copy_only=False)
            doc, at = doc[keep], at.filter(pa.array(keep))
            pos = at.field("pos").to_numpy().astype(np.int64)
            begin, end = docs[:-1][doc], docs[1:][doc]
            spot = begin + pos
            low, high = np.maximum(spot - SIDE, begin), np.minimum(spot + LENGTH, end)
            cut = [text_array(data, low, spot - low), text_array(data, spot + GRAM, high - spot - GRAM)]
            yield pa.RecordBatch.from_arrays(
                [at.field("gram"), *cut, batch.column(0).take(pa.array(doc)), pa.array(pos),
                 pa.array(np.zeros(len(pos), np.int32)), at.field("done"), at.field("kinds")],
                names=["key", "left", "right", "tid", "pos", "low", "done", "kinds"])

    rows = staged(met.select("tid", "text", "at").mapInArrow(surroundings, ROW + ", kinds bigint"), folder, "surroundings")
    found = [staged(by_suffix_array(rows.where(F.col("kinds") <= GROUP_ROWS).drop("kinds"), SIDE), folder, "found")]
    large = rows.where(F.col("kinds") > GROUP_ROWS).drop("kinds")
    if not large.isEmpty():
        found += large_groups(large, folder)
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    sides = met.select("tid", F.octet_length("text").alias("n"), F.explode(F.filter("at", lambda x: x["whole"])).alias("x"))
    spans = spans.unionByName(sides.select(
        "tid", F.greatest(F.lit(0), F.col("x.pos") - SIDE).cast("bigint").alias("start"),
        F.least(F.col("n"), F.col("x.pos") + LENGTH).cast("bigint").alias("end")))
    return spans.groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("spans")), met.select("tid", "text")


def text_array(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Slices of one byte run as an Arrow binary array."""
    at = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[gather(start, size)]))])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept): each text without the bytes covered
    by a string of ``LENGTH`` bytes that also starts anywhere else in the table, the same text
    included; ``kept`` is null where nothing was removed (the text itself stays).

    Strings are judged on the input; matches never cross texts. A null text is empty. Rows are
    told apart by row: a text that stands in two rows repeats in both, whatever their ids.
    Texts are numbered by a 64-bit hash.
    """
    spark = docs.sparkSession
    folder = run_folder(spark, "substrings")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tid", F.xxhash64("text", F.octet_length("text")))
    texts = rows.where(F.octet_length("text") >= LENGTH).select("tid", "text")
    copies = rows.where(F.octet_length("text") >= LENGTH).groupBy("tid").agg(F.count("*").alias("copies")).where("copies > 1")
    spans, met = repeated_spans(texts, folder)

    def cut(batches):
        for batch in chunks(batches, 1):
            rows = []
            lists = batch.column(2)
            offset, pairs = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            start, end = pairs.field("start").to_numpy(), pairs.field("end").to_numpy()
            for i, (tid, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())):
                own = slice(offset[i], offset[i + 1])
                run = merged(np.zeros(own.stop - own.start, np.int64), start[own], end[own])
                at, parts = 0, []
                for a, b in zip(run["start"], run["end"]):
                    parts.append(text[at:a])
                    at = b
                left = b"".join([*parts, text[at:]])
                rows.append((tid, len(text) - len(left), len(run), hashlib.sha256(left).hexdigest(), left))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             names=["tid", "n_removed", "n_spans", "kept_sha256", "kept"])

    less = met.join(spans, "tid").select("tid", "text", "spans").mapInArrow(
        cut, "tid bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    n = F.octet_length("text").cast("bigint")
    whole = rows.select("id", "tid", n.alias("n_bytes"), F.sha2("text", 256).alias("own_sha256"))
    out = whole.join(less, "tid", "left").join(copies, "tid", "left")
    gone = F.col("copies").isNotNull()
    return out.select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "own_sha256")).alias("kept_sha256"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
