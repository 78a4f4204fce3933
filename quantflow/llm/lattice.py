"""Language-model scores from the lattice of all subword segmentations.

The vocabulary is a public one; its pieces get unigram scores, and a text's probability is the
sum over every way to spell it with pieces (and single bytes, where the vocabulary has byte
pieces), by a forward recursion in log space. Pieces do not cross words, so the recursion runs
once for each distinct word of the corpus and a text's score is the sum over its words and its
end. The vocabulary's own order gives the first scores; rounds of expectation-maximisation over
the words of all training texts make them fit the corpus. Words, counts and scores stay in
Spark: texts look up frequent words in a broadcast table of bounded size and join the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantflow.llm.shared import chunks, run_folder, staged, text_bytes
from quantflow.llm.words import byte_class, lower_words

BLANKS = b" \t\n\x0b\x0c\r"
SPACE = "▁".encode()      # stands before each word in the vocabulary
END = b""                      # a text's end, as a word
SMOOTH = 0.1                   # added to every count, of words and of pieces
ROUNDS = 2
TABLE_WORDS = 200_000          # words in the broadcast table at most
LONG_WORD = 64                 # longer words are never in it
LATTICE_BYTES = 1 << 18        # bytes of words whose lattices are built at a time
OUT_ROWS = 1 << 15
LOG10 = np.log(10)


# ---------------------------------------------------------------- vocabulary

@dataclass
class Pieces:
    """A vocabulary as a tree of bytes: sorted (node, byte) keys, the node each leads to, the
    piece that ends in each node (or -1), the byte pieces, the end's piece, and ln probabilities."""
    keys: np.ndarray
    nodes: np.ndarray
    ends: np.ndarray
    bytes_: np.ndarray
    end: int
    log_p: np.ndarray


def load_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece model. Models whose scores are merge ranks (negative whole
    numbers) give each piece the weight 1 / (1 + rank); bytes weigh as the last piece."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    count = model.get_piece_size()
    tree: dict[tuple[int, int], int] = {}
    ends = [-1]
    rank = np.full(count, np.inf)
    bytes_ = np.full(256, -1, np.int64)
    for i in range(count):
        if model.is_byte(i):
            bytes_[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            node = 0
            for b in model.id_to_piece(i).encode():
                if (node, b) not in tree:
                    tree[node, b] = len(ends)
                    ends.append(-1)
                node = tree[node, b]
            ends[node], rank[i] = i, -model.get_score(i)
    if (bytes_ < 0).any():
        raise ValueError("the vocabulary must have a piece for every byte")
    usable = np.isfinite(rank)
    last = rank[usable & (rank < 1e8)].max()
    rank[bytes_] = last
    rank[model.eos_id()] = 0
    keys = np.array([n * 256 + b for n, b in tree], np.int64)
    order = np.argsort(keys)
    p = 1 / (1 + np.minimum(rank, last))
    p[~np.isfinite(rank)] = 0
    with np.errstate(divide="ignore"):
        return Pieces(keys[order], np.array(list(tree.values()), np.int64)[order], np.array(ends), bytes_, model.eos_id(),
                      np.log(p / p.sum()))


# ---------------------------------------------------------------- recursions

def edges(pieces: Pieces, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces that fit somewhere in the words ``data[at[k]:at[k + 1]]``: first byte, byte
    behind, piece."""
    limit = np.repeat(at[1:], np.diff(at))
    place = np.arange(len(data))
    found = [(place, place + 1, pieces.bytes_[data])]
    node, depth = np.zeros(len(data), np.int64), 0
    while len(place):
        key = node * 256 + data[place + depth]
        i = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
        hit = pieces.keys[i] == key
        place, node, depth = place[hit], pieces.nodes[i[hit]], depth + 1
        piece = pieces.ends[node]
        whole = piece >= 0
        found.append((place[whole], place[whole] + depth, piece[whole]))
        more = place + depth < limit[place]
        place, node = place[more], node[more]
    return tuple(np.concatenate(x) for x in zip(*found))


def recursion(step: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
    """ln of the summed weights of all paths into each node of ``total``, in place: edges go from
    ``source`` to ``target``, those of a step after all of the steps before."""
    order = np.lexsort((target, step))
    step, source, target, weight = step[order], source[order], target[order], weight[order]
    first = np.append(np.searchsorted(step, np.arange(1, int(step[-1]) + 1)), len(step)) if len(step) else np.zeros(1, np.int64)
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        x, to = total[source[a:b]] + weight[a:b], target[a:b]
        head = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        most = np.maximum.reduceat(x, head)
        size = np.diff(np.append(head, b - a))
        total[to[head]] = most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, size)), head))


class Lattice:
    """The lattices of a run of words; word ``k`` has a node before each byte and one at its end."""

    def __init__(self, pieces: Pieces, data: np.ndarray, at: np.ndarray):
        self.pieces, self.at, self.words = pieces, at, len(at) - 1
        start, end, self.piece = edges(pieces, data, at)
        self.word = np.searchsorted(at, start, side="right") - 1
        self.source, self.target = start + self.word, end + self.word
        self.done, self.left = end - at[self.word], at[self.word + 1] - start
        self.weight = pieces.log_p[self.piece]
        self.first, self.last = at[:-1] + np.arange(self.words), at[1:] + np.arange(self.words)

    def forward(self) -> np.ndarray:
        total = np.zeros(int(self.at[-1]) + self.words)
        recursion(self.done, self.source, self.target, self.weight, total)
        return total

    def log_probabilities(self) -> np.ndarray:
        """ln of each word's probability, over all of its segmentations."""
        return self.forward()[self.last]

    def expected(self, count: np.ndarray) -> np.ndarray:
        """How often each piece is expected in ``count`` occurrences of the words."""
        ahead = self.forward()
        behind = np.zeros(len(ahead))
        recursion(self.left, self.target, self.source, self.weight, behind)
        share = np.exp(ahead[self.source] + self.weight + behind[self.target] - ahead[self.last][self.word])
        return np.bincount(self.piece, share * count[self.word], len(self.pieces.log_p))


def lattices(pieces: Pieces, words: pa.Array) -> Iterator[tuple[Lattice, slice]]:
    """Lattices of the words (each behind the space mark), runs of ``LATTICE_BYTES`` at a time."""
    marked = pc.binary_join_element_wise(pa.scalar(SPACE, pa.binary()), words.cast(pa.binary()), pa.scalar(b"", pa.binary()))
    size = pc.binary_length(marked).to_numpy()
    ends, a = np.cumsum(size), 0
    while a < len(words):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - size[a] + LATTICE_BYTES, side="right")))
        yield Lattice(pieces, *text_bytes(marked.slice(a, b - a))), slice(a, b)
        a = b


# ---------------------------------------------------------------- training

def is_held_out(id_col: str):
    """Rows that nothing is learnt from: crc32 of the id as text leaves 0 modulo 10. Rows without an id are learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def count_words(rows: DataFrame) -> DataFrame:
    """(word, taught, n) of rows (held_out, text): occurrences in training rows and in all; the
    end of a text is the empty word."""
    def run(batches):
        for batch in chunks(batches, 1):
            data, at = text_bytes(batch.column(1))
            words, doc, _ = lower_words(data, at, byte_class(BLANKS))
            own = ~batch.column(0).to_numpy(zero_copy_only=False)
            code = words.indices.to_numpy()
            size = len(words.dictionary)
            taught = np.bincount(code, own[doc].astype(np.int64), size).astype(np.int64)
            n = np.bincount(code, minlength=size)
            names = pa.concat_arrays([words.dictionary, pa.array([END], pa.binary())])
            yield pa.RecordBatch.from_arrays([names, pa.array(np.append(taught, own.sum())), pa.array(np.append(n, len(own)))],
                                             names=["word", "taught", "n"])

    return (rows.mapInArrow(run, "word binary, taught bigint, n bigint").groupBy("word")
            .agg(F.sum("taught").alias("taught"), F.sum("n").alias("n")))


def fit(words: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> Pieces:
    """Scores re-estimated on the training words; what is collected is one number a piece."""
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(plain(pieces))

        def run(batches):
            pieces = Pieces(*shared.value)
            total = np.zeros(len(pieces.log_p))
            for batch in batches:
                count = batch.column(1).to_numpy()
                for lattice, part in lattices(pieces, batch.column(0)):
                    total += lattice.expected(count[part])
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["piece", "n"])

        found = (words.where((F.col("taught") > 0) & (F.octet_length("word") > 0)).select("word", "taught")
                 .mapInArrow(run, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")))
        total = np.where(np.isfinite(pieces.log_p), SMOOTH, 0)
        for r in found.collect():
            total[r["piece"]] += r["n"]
        total[pieces.end] += words.where(F.octet_length("word") == 0).agg(F.coalesce(F.sum("taught"), F.lit(0))).first()[0]
        with np.errstate(divide="ignore"):
            pieces = Pieces(pieces.keys, pieces.nodes, pieces.ends, pieces.bytes_, pieces.end, np.log(total / total.sum()))
    return pieces


def plain(pieces: Pieces) -> tuple:
    return pieces.keys, pieces.nodes, pieces.ends, pieces.bytes_, pieces.end, pieces.log_p


# ---------------------------------------------------------------- scoring

def word_scores(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``words`` with ``log_p``: log10 of the probability of each word (or the end)."""
    shared = words.sparkSession.sparkContext.broadcast(plain(pieces))

    def run(batches):
        pieces = Pieces(*shared.value)
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for lattice, part in lattices(pieces, batch.column(0)):
                found[part] = lattice.log_probabilities()
            end = pc.equal(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            found[end] = pieces.log_p[pieces.end]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found / LOG10)], names=["word", "taught", "n", "log_p"])

    return words.select("word", "taught", "n").mapInArrow(run, "word binary, taught bigint, n bigint, log_p double")


def frequent(words: DataFrame, most: int = TABLE_WORDS) -> pa.Table:
    """The most frequent words that are not long, ``most`` at most, with their counts and scores. A
    histogram of counts (some hundred rows) gives the least count that keeps the bound."""
    short = words.where(F.octet_length("word").between(1, LONG_WORD)).withColumn("size", F.floor(16 * F.log2("n")))
    least, held = 1 << 62, 0
    for r in sorted(short.groupBy("size").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["size"]):
        held += r["words"]
        if held > most:
            break
        least = r["size"]
    return short.where(F.col("size") >= least).select("word", "taught", "log_p").toArrow()


def score_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``base_score`` is a smoothed word unigram, ``score`` the lattice's log10 probability. Rows
    whose id is held out teach nothing; rows without an id do. A null or empty text is its end
    alone. Repeated rows are scored (and taught) each; other columns are ignored; an empty
    table gives no rows. A word of millions of bytes costs a step of the recursion a byte.
    """
    spark = docs.sparkSession
    folder = run_folder(spark, "lattice")
    id_type = docs.schema[id_col].dataType.simpleString()
    held = is_held_out(id_col).alias("held_out")
    words = staged(count_words(docs.select(held, F.col(text_col).cast("string").alias("text"))), folder, "words")
    scored = staged(word_scores(words, fit(words, load_pieces(vocabulary), rounds)), folder, "scores")
    taught = scored.where("taught > 0")
    n, v = taught.agg(F.coalesce(F.sum("taught"), F.lit(0)), F.count("*")).first()
    per = n + SMOOTH * (v + 1)
    base = lambda c: np.log10((c + SMOOTH) / per)
    end = scored.where(F.octet_length("word") == 0).first()
    ends, end_score = (end["taught"], end["log_p"]) if end else (0, 0.0)
    table = frequent(scored)
    often = table.column("word").combine_chunks().cast(pa.binary())
    shared = spark.sparkContext.broadcast((pa.RecordBatch.from_arrays([often], names=["word"]).serialize().to_pybytes(),
                                           table.column("taught").to_numpy(), table.column("log_p").to_numpy()))

    def run(batches):
        raw, taught, log_p = shared.value
        often = pa.ipc.read_record_batch(raw, pa.schema([("word", pa.binary())])).column(0)
        word_base = base(taught)
        for batch in chunks(batches, 3):
            data, at = text_bytes(batch.column(3))
            words, doc, _ = lower_words(data, at, byte_class(BLANKS))
            rows, code = batch.num_rows, words.indices.to_numpy()
            place = pc.index_in(words.dictionary, value_set=often).fill_null(-1).to_numpy()[code]
            there = place >= 0
            sums = lambda x: np.bincount(doc[there], x[place[there]], rows)
            rest, times = np.unique(doc[~there] * np.int64(len(words.dictionary) + 1) + code[~there], return_counts=True)
            text, code = np.divmod(rest, len(words.dictionary) + 1)
            missing = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(text, np.arange(rows + 1)), pa.int32()),
                pa.StructArray.from_arrays([words.dictionary.take(pa.array(code)), pa.array(times, pa.int64())], names=["word", "times"]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.bincount(doc, minlength=rows) + 1), pa.array(sums(taught > 0).astype(np.int64) + (ends > 0)),
                 pa.array(sums(word_base) + base(ends)), pa.array(sums(log_p) + end_score), missing],
                names=["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "missing"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), held, F.col(text_col).cast("string").alias("text"))
    parts = staged(rows.mapInArrow(run, f"row bigint, id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, "
                                        "base_score double, score double, missing array<struct<word binary, times bigint>>"), folder, "texts")
    # a word outside the table may still be hot (one id held out with a third of the rows), so
    # its join stands in a job of its own that can be split
    missing = parts.where(F.size("missing") > 0).select("row", F.explode("missing").alias("m")).select("row", "m.*")
    known = F.when(F.col("taught") > 0, F.col("times")).otherwise(0)
    found = staged(missing.join(scored.select("word", "taught", "log_p"), "word").select(
        "row", known.alias("known"),
        (F.col("times") * F.log10((F.col("taught") + SMOOTH) / F.lit(float(per)))).alias("base"),
        (F.col("times") * F.col("log_p")).alias("score")), folder, "found")
    more = found.groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("score").alias("more_score"))
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return parts.drop("missing").join(more, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", plus("n_known", "more_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        plus("base_score", "more_base"), plus("score", "more_score"))
