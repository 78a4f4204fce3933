"""Toxicity by a factorization machine over hashed terms.

Terms are a text's lower-cased words and their beginnings (which catch families of words),
hashed; a text has a term or not. From labelled rows a count per hash tells which hashes carry
evidence alone, and a count per pair which of the frequent ones carry it together with another;
the machine learns a weight and a short vector for each of those, so that pairs of terms (an
insult and a group mention, say) count beyond the sum of their weights. Scoring broadcasts the model, whose size is bounded, and reads each text once.
"""

from __future__ import annotations

import zlib
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantflow.llm.shared import chunks, drop_staged, run_folder, staged

TRAIN_ROWS = 20_000     # labelled rows that the fit takes at most: those of least hash of the id
BUCKETS = 1 << 22       # hash values of a term
MODEL_TERMS = 4096      # terms in the model for their own evidence, at most
LEAST_Z = 4.0           # evidence such a term must show
PAIR_TERMS = 2048       # most frequent terms that are looked at in pairs with them and each other
PAIR_Z = 5.0            # evidence of a pair beyond that of either term, for its terms to enter
PREFIXES = (4, 5, 6)
FACTORS = 4
EPOCHS = 30
THRESHOLD = 0.3


def word_terms(word: str) -> list[int]:
    """Hashes of a lower-cased word and of its beginnings."""
    found = [zlib.crc32(word.encode()) % BUCKETS]
    return found + [zlib.crc32(f"{word[:k]}*".encode()) % BUCKETS for k in PREFIXES if len(word) > k]


def doc_words(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased runs of letters and digits of all texts, and the text each belongs to."""
    plain = pc.replace_substring_regex(pc.utf8_lower(column.fill_null("")), r"[^\p{L}\p{N}]+", " ")
    lists = pc.ascii_split_whitespace(plain)
    words = lists.flatten()
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    real = pc.not_equal(words, "")
    return words.filter(real).dictionary_encode(), doc[real.to_numpy(zero_copy_only=False)]


def doc_terms(column: pa.Array, known: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) pairs, each once. With ``known`` only its hashes, by their values there."""
    words, doc = doc_words(column)
    hashes = [word_terms(w) for w in words.dictionary.to_pylist()]
    if known is not None:
        hashes = [[known[h] for h in hs if h in known] for hs in hashes]
    size = np.fromiter(map(len, hashes), np.int64, len(hashes))
    flat = np.array([h for hs in hashes for h in hs], np.int64)
    code = words.indices.to_numpy()
    used = size[code] > 0
    pair = np.unique(doc[used] * np.int64(len(words.dictionary)) + code[used]) if len(code) else np.zeros(0, np.int64)
    doc, code = np.divmod(pair, max(1, len(words.dictionary)))
    first = (np.cumsum(size) - size)[code]
    at = np.arange(int(size[code].sum())) + np.repeat(first - (np.cumsum(size[code]) - size[code]), size[code])
    pair = np.unique(np.repeat(doc, size[code]) * np.int64(BUCKETS) + flat[at])
    return pair // BUCKETS, pair % BUCKETS


@dataclass
class Model:
    """Weights of ``terms`` (hash -> row): bias, linear weights, factor vectors."""
    terms: dict[int, int]
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Probability of each of ``n`` texts, given its (text, row) pairs sorted by text."""
        total = self.bias + np.bincount(doc, self.linear[term], n)
        for v in self.factors.T:
            total += (np.bincount(doc, v[term], n) ** 2 - np.bincount(doc, v[term] ** 2, n)) / 2
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def fit(doc: np.ndarray, term: np.ndarray, label: np.ndarray, n_terms: int, seed: int = 11) -> Model:
    """Fit bias, weights and vectors by logistic loss with AdaGrad in small batches. ``doc`` is
    sorted; ``label`` holds 0 or 1 for each text."""
    rng = np.random.default_rng(seed)
    rate = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    w = np.zeros(n_terms + 1)          # the last is the bias
    w[-1] = np.log(rate / (1 - rate))
    v = rng.normal(0, 0.02, (n_terms, FACTORS))
    gw, gv = np.full(n_terms + 1, 1e-2), np.full((n_terms, FACTORS), 1e-2)
    first = np.searchsorted(doc, np.arange(len(label) + 1))
    for _ in range(EPOCHS):
        turn = rng.permutation(len(label))
        for k in range(0, len(turn), 64):
            own = turn[k:k + 64]
            size = first[own + 1] - first[own]
            row = np.repeat(np.arange(len(own)), size)
            at = np.arange(int(size.sum())) + np.repeat(first[own] - (np.cumsum(size) - size), size)
            t = term[at]
            total = w[-1] + np.bincount(row, w[t], len(own))
            sums = np.stack([np.bincount(row, v[t, f], len(own)) for f in range(FACTORS)], 1)
            squares = np.bincount(row, (v[t] ** 2).sum(1), len(own))
            total += ((sums ** 2).sum(1) - squares) / 2
            error = (1 / (1 + np.exp(-np.clip(total, -50, 50))) - label[own]) / len(own)
            seen, back = np.unique(t, return_inverse=True)
            dw = np.bincount(back, error[row], len(seen)) + 1e-5 * w[seen]
            step = error[row][:, None] * (sums[row] - v[t])
            dv = np.stack([np.bincount(back, step[:, f], len(seen)) for f in range(FACTORS)], 1) + 1e-4 * v[seen]
            gw[seen] += dw ** 2
            gv[seen] += dv ** 2
            w[seen] -= 0.3 * dw / np.sqrt(gw[seen])
            v[seen] -= 0.05 * dv / np.sqrt(gv[seen])
            db = error.sum()
            gw[-1] += db ** 2
            w[-1] -= 0.1 * db / np.sqrt(gw[-1])
    return Model({}, float(w[-1]), w[:-1], v)


def evidence(n1: np.ndarray, n0: np.ndarray, all1: int, all0: int) -> np.ndarray:
    """Root of the likelihood ratio between the shares of toxic and other texts."""
    total, whole = 0, all1 + all0
    for c1, c0 in ((n1, n0), (all1 - n1, all0 - n0)):
        for seen, size in ((c1, all1), (c0, all0)):
            mean = (c1 + c0) * (size / whole)
            total = total + seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, mean, 1))
    return np.sqrt(np.maximum(2 * total, 0))


def paired(doc: np.ndarray, term: np.ndarray, label: np.ndarray, frequent: int, n_terms: int) -> np.ndarray:
    """Which of the first ``frequent`` terms carry evidence in a pair with another term that
    neither carries alone. Texts are taken in blocks."""
    counts = np.zeros((2, frequent, n_terms), np.float32)
    alone = np.zeros((2, n_terms))
    for low in range(0, len(label), 1000):
        at = slice(*np.searchsorted(doc, (low, low + 1000)))
        has = np.zeros((min(1000, len(label) - low), n_terms), np.float32)
        has[doc[at] - low, term[at]] = 1
        for kind in (0, 1):
            own = has[label[low:low + 1000] == kind]
            counts[kind] += own[:, :frequent].T @ own
            alone[kind] += own.sum(0)
    all1, all0 = int(label.sum()), int((label == 0).sum())
    single, found = evidence(alone[1], alone[0], all1, all0), np.zeros(frequent, bool)
    for low in range(0, frequent, 128):
        rows = slice(low, min(frequent, low + 128))
        both = evidence(counts[1, rows].astype(float), counts[0, rows].astype(float), all1, all0)
        row, partner = np.nonzero(both - np.maximum(single[rows][:, None], single) >= PAIR_Z)
        found[low + row] = True
        found[partner[partner < frequent]] = True
    return found


def held_out(id_col: str):
    """Rows that are kept from every fit: crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Model:
    """Learn from the labelled rows that are not held out, ``TRAIN_ROWS`` at most: those whose
    ids have the least hashes. A document with several labels is toxic if one says so; rows
    without an id, a label or a document teach nothing; rows that share an id teach each on its
    own. With rows of one kind only, or none, the model is the smoothed share of toxic rows."""
    spark = docs.sparkSession
    folder = run_folder(spark, "toxicity")
    there = docs.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    chosen = (labels.join(there, id_col, "left_semi").where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
              .groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"))
              .orderBy(F.xxhash64(id_col), id_col).limit(TRAIN_ROWS))
    rows = (docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(staged(chosen, folder, "chosen")), id_col).select("label", "text"))

    def hashed(batches):
        for batch in chunks(batches, 1):
            doc, term = doc_terms(batch.column(1))
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(term, pa.int32()))],
                                             names=["label", "terms"])

    taught = staged(rows.mapInArrow(hashed, "label int, terms array<int>"), folder, "taught")
    n1, n = taught.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    base = Model({}, float(np.log((n1 + 1) / (n - n1 + 1))), np.zeros(0), np.zeros((0, FACTORS)))
    if not 0 < n1 < n:
        return base
    # z of the difference between the shares of toxic and other texts that have the term
    share = (F.col("n1") + 0.5) / (n1 + 1) - (F.col("n0") + 0.5) / (n - n1 + 1)
    mean = (F.col("n1") + F.col("n0") + 0.5) / (n + 1)
    counted = (taught.select("label", F.explode("terms").alias("term")).groupBy("term")
               .agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
               .withColumn("z", F.abs(share) / F.sqrt(mean * (1 - mean) * (1 / n1 + 1 / (n - n1)))))
    counted = staged(counted.withColumn("n", F.col("n1") + F.col("n0")), folder, "counted")
    often = [r["term"] for r in counted.orderBy(F.desc("n"), "term").limit(PAIR_TERMS).select("term").collect()]
    best = [r["term"] for r in counted.where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(MODEL_TERMS).select("term").collect()]
    looked_at = often + sorted(set(best) - set(often))
    place, strong = {t: k for k, t in enumerate(looked_at)}, np.isin(looked_at, best)

    def known(batches):
        """Terms that are looked at, by their places: the rest stays where it is."""
        for batch in batches:
            lists = batch.column(1)
            t = np.array([place.get(x, -1) for x in lists.flatten().to_pylist()], np.int32)
            at = np.append(0, np.cumsum(t >= 0))[lists.offsets.to_numpy() - lists.offsets[0].as_py()].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(t[t >= 0]))], names=["label", "terms"])

    def learn(batches):
        label, doc, term, n = [], [], [], 0
        for batch in batches:
            lists = batch.column(1)
            label.append(batch.column(0).to_numpy())
            doc.append(np.repeat(np.arange(n, n + len(lists)), np.diff(lists.offsets.to_numpy())))
            term.append(lists.flatten().to_numpy())
            n += len(lists)
        if n:
            label, doc, term = (np.concatenate(x).astype(np.int64) for x in (label, doc, term))
            used = strong.copy()
            used[:len(often)] |= paired(doc, term, label, len(often), len(strong))
            row = np.cumsum(used) - 1
            m = fit(doc[used[term]], row[term[used[term]]], label.astype(float), int(used.sum()))
            yield pa.RecordBatch.from_pydict({"used": [np.flatnonzero(used).tolist()], "bias": [m.bias], "linear": [m.linear.tolist()],
                                              "factors": [m.factors.ravel().tolist()]})

    few = taught.mapInArrow(known, "label int, terms array<int>").repartition(1)
    learned = staged(few.mapInArrow(learn, "used array<bigint>, bias double, linear array<double>, factors array<double>"),
                     folder, "model").first()
    drop_staged(spark, folder)
    terms = {looked_at[k]: row for row, k in enumerate(learned["used"])}
    return Model(terms, learned["bias"], np.array(learned["linear"]), np.array(learned["factors"]).reshape(-1, FACTORS))


def scores(column: pa.Array, model: Model) -> np.ndarray:
    doc, term = doc_terms(column, model.terms)
    return model.score(doc, term, len(column))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of each row; null and empty texts get the score of a
    text without terms."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))  # plain values: workers may lack the package
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in chunks(batches, 1):
            p = scores(batch.column(1), Model(*shared.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                             names=[id_col, "score", "predicted"])

    made = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type}, score double, predicted int")
    return made.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all of their columns, repeated
    rows each on its own; null and empty texts score as texts without terms."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))  # plain values: workers may lack the package
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in chunks(batches, at):
            yield batch.filter(pa.array(scores(batch.column(at), Model(*shared.value)) < threshold))

    return docs.mapInArrow(run, docs.schema)
