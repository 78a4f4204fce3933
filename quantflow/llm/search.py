"""Ranked lexical search by the Best Position Algorithm.

One pass over the texts builds an index in segments: bounded runs of documents with the
postings of the queries' terms. Sums over the segments give the corpus statistics. Then each
segment orders every term's postings by impact, and a query reads its terms' lists from the
top, a round of positions at a time. A document that a list shows for the first time is
looked up in all other lists at once (a direct access, which also marks its positions there
as seen). A list's best position is the end of its gapless seen beginning; what stands next in
the lists bounds the score of every document not seen yet. The query ends in a segment once
that bound is strictly below its tenth score, which it keeps from segment to segment of a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantflow.llm.shared import chunks, gather, run_folder, spread, staged, text_bytes
from quantflow.llm.words import byte_class, lower_words

OUTSIDE = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
BLOCK_BYTES = 4 << 20         # query text that one pass over the corpus answers
SEGMENT_POSTINGS = 1 << 20    # postings after which a segment is closed
FIRST_ROUND, LAST_ROUND = 8, 512
SALTS = 64
# fixed values of the score
LENGTH_SHARE, ONE, TF_SCALE, SATURATION = 75, 1_000_000_000, 1000, 8


def terms_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    data, at = text_bytes(column)
    words, doc, _ = lower_words(data, at, byte_class(OUTSIDE))
    return words, doc


# ---------------------------------------------------------------- queries

def query_terms(items: list) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """The distinct terms of a block of query texts, and each query's (terms, repeats)."""
    words, doc = terms_of(pa.array(items, pa.string()))
    code = words.indices.to_numpy().astype(np.int64)
    first = np.searchsorted(doc, np.arange(len(items) + 1))
    return words.dictionary, [np.unique(code[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:])]


# ---------------------------------------------------------------- index

def index_segments(docs: DataFrame, vocabulary: pa.Array, id_col: str, text_col: str) -> DataFrame:
    """One row a segment: its documents (id, number of terms) and the postings of the terms of
    ``vocabulary`` (document's place, term, occurrences). Documents without a term are left out."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(vocabulary.to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.binary())
        held: list[tuple] = []
        size = n = 0
        for batch in chunks(batches, 1):
            words, doc = terms_of(batch.column(1))
            count = np.bincount(doc, minlength=batch.num_rows)
            term = pc.index_in(words.dictionary, value_set=known).fill_null(-1).to_numpy()[words.indices.to_numpy()]
            pair, tf = np.unique(doc[term >= 0] * np.int64(len(known) + 1) + term[term >= 0], return_counts=True)
            there = np.flatnonzero(count)
            place = np.zeros(batch.num_rows, np.int64)
            place[there] = np.arange(len(there)) + n
            doc, term = np.divmod(pair, len(known) + 1)
            held.append((batch.column(0).take(pa.array(there)), count[there], place[doc], term, tf))
            size, n = size + len(tf), n + len(there)
            if size >= SEGMENT_POSTINGS:
                yield row(held)
                held, size, n = [], 0, 0
        if n:
            yield row(held)

    def row(held):
        def one(values, kind):
            values = pa.concat_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values])
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind) if kind else values)
        ids, count, place, term, tf = zip(*held)
        return pa.RecordBatch.from_arrays(
            [one(ids, None), one(count, pa.int64()), one(place, pa.int32()), one(term, pa.int32()), one(tf, pa.int64())],
            names=["ids", "sizes", "place", "term", "tf"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"ids array<{id_type}>, sizes array<bigint>, place array<int>, term array<int>, tf array<bigint>")


def document_frequencies(segments: DataFrame, terms: int) -> np.ndarray:
    """Number of documents that hold each term of the vocabulary."""
    def run(batches):
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["term", "df"])

    found = segments.select("term").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(terms, np.int64)
    for r in found.collect():  # as many rows as the block's queries have terms
        out[r["term"]] = r["df"]
    return out


# ---------------------------------------------------------------- best positions

class ImpactLists:
    """A segment's postings twice: by (term, impact descending) for sorted access, and by
    (term, document) for direct access. Documents are numbered in the order of their ids."""

    def __init__(self, ids: pa.Array, sizes, place, term, tf, weight: np.ndarray, n_docs: int, n_terms: int):
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.ids = ids.take(pa.array(order))
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * sizes * n_docs) // n_terms
        impact = weight[term] * ((ONE * tf) // (TF_SCALE * tf + SATURATION * m[place]))
        useful = impact > 0
        doc, term, impact = number[place[useful]], term[useful].astype(np.int64), impact[useful]
        down = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[down], impact[down]
        self.first = np.searchsorted(term[down], np.arange(len(weight) + 1))
        key = (term * len(ids) + doc)[down]
        self.where = np.argsort(key)          # place in the impact lists of each (term, document)
        self.key = key[self.where]

    def top(self, term: np.ndarray, repeats: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best documents of a query, at least ``least`` in score: numbers and scores,
        best first, equal ones by number."""
        a, size = self.first[term], self.first[term + 1] - self.first[term]
        term, repeats, a, size = term[size > 0], repeats[size > 0], a[size > 0], size[size > 0]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(term):
            return docs, scores
        base = np.cumsum(size) - size                     # the lists one after the other
        seen_at = np.zeros(int(size.sum()) + 1, bool)     # positions seen, by either access
        known = np.zeros(len(self.ids), bool)             # documents seen
        best, depth, step = np.zeros(len(term), np.int64), 0, FIRST_ROUND
        while True:
            open_ = best < size
            bound = int((repeats[open_] * self.impact[a[open_] + best[open_]]).sum())
            kth = max(least, int(scores[k - 1]) if len(scores) >= k else least)
            if not open_.any() or bound < kth:
                return docs, scores
            # sorted access: the next positions of every list
            part = np.clip(size - depth, 0, step)
            new = np.unique(self.doc[gather(a + depth, part)])
            new = new[~known[new]]
            known[new] = True
            depth, step = depth + step, min(2 * step, LAST_ROUND)
            if len(new):
                # direct access: every list's posting of every new document, if there is one
                wanted = (term[:, None] * len(self.ids) + new).ravel()
                i = np.searchsorted(self.key, wanted)
                i[i == len(self.key)] = 0
                hit = self.key[i] == wanted
                at = self.where[i[hit]]
                lists, column = np.divmod(np.flatnonzero(hit), len(new))
                total = np.zeros(len(new), np.int64)
                np.add.at(total, column, repeats[lists] * self.impact[at])
                seen_at[base[lists] + at - a[lists]] = True
                good = total >= kth
                docs, scores = np.append(docs, new[good]), np.append(scores, total[good])
                order = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[order], scores[order]
            for j in np.flatnonzero(open_):
                rest = seen_at[base[j] + best[j]:base[j] + size[j]]
                gap = int(rest.argmin())
                best[j] += gap if not rest[gap] else len(rest)


def best_documents(segments: DataFrame, queries: list, items: list, weight: np.ndarray, n_docs: int, n_terms: int,
                   k: int, item_type: str, id_type: str) -> DataFrame:
    """Each task's best ``k`` documents of every query: (item, id, score)."""
    shared = segments.sparkSession.sparkContext.broadcast((queries, items, weight))

    def merged(batches):
        held, size = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                held.append([c.slice(row, 1).flatten() for c in batch.columns])
                size += len(held[-1][4])
                if size >= SEGMENT_POSTINGS:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(batches):
        queries, items, weight = shared.value
        best: list[list[tuple]] = [[] for _ in queries]
        for held in merged(batches):
            ids, sizes, place, term, tf = ([h[c] for h in held] for c in range(5))
            shift = np.cumsum([0] + [len(x) for x in ids[:-1]])
            lists = ImpactLists(
                pa.concat_arrays(ids), np.concatenate(sizes),
                np.concatenate([p.to_numpy() + s for p, s in zip(place, shift)]),
                np.concatenate(term), np.concatenate(tf), weight, n_docs, n_terms)
            for q, (terms, repeats) in enumerate(queries):
                least = best[q][-1][0] if len(best[q]) == k else 1
                doc, score = lists.top(terms, repeats, k, least)
                if len(doc):
                    found = best[q] + list(zip(score.tolist(), lists.ids.take(pa.array(doc)).to_pylist()))
                    best[q] = sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:k]
        rows = [(items[q], d, s) for q, found in enumerate(best) for s, d in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), kinds)],
                                             names=["item", "id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string
    kinds = [to_arrow_type(_parse_datatype_string(t)) for t in (item_type, id_type, "bigint")]
    return segments.mapInArrow(run, f"item {item_type}, id {id_type}, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` highest-scoring documents of every item: (item, rank, id, score).

    Scores are above 0; equal ones rank by ascending id, null ids last. A null or empty text
    (document or item) has no terms: it is not counted, found or answered. Repeated document
    rows are documents of their own; rows of one item id and text are one item, and texts that
    share an id (or have none) are answered each. Other columns are ignored; empty tables give no rows. The items are
    answered in blocks of about ``BLOCK_BYTES`` of text, each by a pass over all documents.
    """
    spark = docs.sparkSession
    folder = run_folder(spark, "search")
    item_type, id_type = items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    asked = staged(items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
                   .where("text IS NOT NULL").distinct(), folder, "items")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = spread(total, BLOCK_BYTES)
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("text", "item"), F.lit(blocks)) == b).collect()
        vocabulary, queries = query_terms([r["text"] for r in block])
        segments = staged(index_segments(docs, vocabulary, id_col, text_col), folder, f"segments-{b}")
        n_docs, n_terms = segments.agg(
            F.coalesce(F.sum(F.size("ids")), F.lit(0)),
            F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda x, y: x + y)), F.lit(0))).first()
        df = document_frequencies(segments, len(vocabulary)).tolist()
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df], np.int64)
        named = [(q, r["item"]) for q, r in zip(queries, block) if len(q[0])]
        # what an item is, besides its id: texts that share an id are answered each
        part = best_documents(segments, [q for q, _ in named], list(range(len(named))), weight, n_docs, n_terms, k,
                              "int", id_type)
        names = spark.createDataFrame([(i, name) for i, (_, name) in enumerate(named)], f"item int, name {item_type}")
        part = staged(part, folder, f"best-{b}")
        order = [F.desc("score"), F.asc_nulls_last("id")]
        some = Window.partitionBy("item", "salt").orderBy(*order)
        part = (part.withColumn("salt", F.pmod(F.xxhash64("id", "score"), F.lit(SALTS)))
                .withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
                .withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
                .join(F.broadcast(names), "item"))
        part = part.select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        found = part if found is None else found.unionByName(part)
    return found


# DuckDB: the scores of every document that shares a term with an item.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM sizes),
postings AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM postings, whole GROUP BY term, nd),
impacts AS (
  SELECT p.doc_id, p.term, w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * s.n * nd) // nt))) AS impact
  FROM postings p JOIN weights w USING (term) JOIN sizes s USING (doc_id), whole),
scored AS (
  SELECT a.item_id, i.doc_id, sum(a.q * i.impact)::BIGINT AS score
  FROM asked a JOIN impacts i USING (term) GROUP BY a.item_id, i.doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
