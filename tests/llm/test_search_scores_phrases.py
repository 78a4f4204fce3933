"""Lexical search, lattice scores and collocations against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quantflow.llm import collocations, lattice, search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = "doc_id bigint, text string, lang string, score double, rank int, term string, phrase string, word string, n bigint"


def made_texts(n=120, seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "of", "ñandú", "rot", "x1", "ü", "zug", "a", "b", "c", "d"] + [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(n):
        size = rng.choice([1, 3, 12, 40, 90])
        texts.append("".join(rng.choice(words[:12] if rng.random() < .7 else words) + rng.choice([" ", " ", " ", ". ", ",", "\n", "  "])
                             for _ in range(size)))
    return texts + [texts[3]] * 15 + ["", None, " .,\t\n ", "the " * 500, "É" * 3000]


def made_docs(spark, texts, parts=5):
    langs = ["en", "de", None, "und"]
    rows = [(k, t, langs[k % 4], 0.5, 1, "the", "p", "w", 7) for k, t in enumerate(texts)]
    rows += [(None, texts[1], "en", 0.1, 1, "x", None, None, 1), rows[2], rows[2]]
    return rows, spark.createDataFrame(rows, EXTRA).repartition(parts)


# ---------------------------------------------------------------- search

def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def naive_search(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = {}
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 25 + (75 * sum(b.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m))
                    for t in terms(text) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out[item] = [(r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("segment,first,block", [(1 << 20, 8, 4 << 20), (50, 1, 3000)])
def test_search_equals_brute_force(spark, monkeypatch, segment, first, block):
    monkeypatch.setattr(search, "SEGMENT_POSTINGS", segment)
    monkeypatch.setattr(search, "FIRST_ROUND", first)
    monkeypatch.setattr(search, "BLOCK_BYTES", block)
    texts = made_texts()
    rows, docs = made_docs(spark, texts)
    items = [(1, "the ñandú ROT rot"), (2, "w1 w2 the w3"), (3, ""), (4, None), (5, "nowhere"), (6, "É" * 3000), (7, texts[3])]
    items_df = spark.createDataFrame([(i, t, 3) for i, t in items + items[:1]], "item_id bigint, text string, score int")
    want = naive_search([(r[0], r[1]) for r in rows], [x for x in items if terms(x[1])])
    got = defaultdict(list)
    for r in search.search(docs, items_df).collect():
        got[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_search_of_empty_tables(spark):
    rows, docs = made_docs(spark, made_texts(5))
    items = spark.createDataFrame([(1, "the")], "item_id bigint, text string")
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert search.search(docs, items.limit(0)).count() == 0


def test_best_positions_stop_early():
    """Two rare terms that meet in the same ten documents: the lists are not read to their ends."""
    docs = 5000
    place = np.concatenate([np.arange(docs), np.arange(docs)]).astype(np.int64)
    term = np.repeat([0, 1], docs)
    tf = np.where(place < 10, 1000, 1)
    lists = search.ImpactLists(pa.array(range(docs)), np.full(docs, 1000), place, term, tf, np.array([100, 100]), docs, docs * 1000)
    read = []
    plain = search.gather
    search.gather = lambda a, size: read.append(int(size.sum())) or plain(a, size)
    try:
        found, scores = lists.top(np.array([0, 1]), np.array([1, 1]), 10, 1)
    finally:
        search.gather = plain
    assert found.tolist() == list(range(10)) and len(set(scores.tolist())) == 1
    assert sum(read) < 100


# ---------------------------------------------------------------- lattice

def spelt(pieces):
    """Every piece's bytes, read off the tree."""
    by_node, found, stack = defaultdict(list), {}, [(0, b"")]
    for k, to in zip(pieces.keys.tolist(), pieces.nodes.tolist()):
        by_node[k // 256].append((k % 256, to))
    while stack:
        node, s = stack.pop()
        if pieces.ends[node] >= 0:
            found[s] = pieces.ends[node]
        stack += [(to, s + bytes([b])) for b, to in by_node[node]]
    return found


def naive_lattice(pieces, word, table=None):
    """Probability of a word over all segmentations, piece by piece."""
    text, table = "▁".encode() + word, table or spelt(pieces)
    probability = [1.0] + [0.0] * len(text)
    for j in range(1, len(text) + 1):
        probability[j] = probability[j - 1] * math.exp(pieces.log_p[pieces.bytes_[text[j - 1]]])
        for i in range(j):
            if text[i:j] in table:
                probability[j] += probability[i] * math.exp(pieces.log_p[table[text[i:j]]])
    return probability[-1]


@pytest.fixture(scope="module")
def vocabulary():
    return lattice.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_lattice_sums_every_segmentation(vocabulary):
    words = [b"the", b"", "ñandú".encode(), b"a", b"international", b"\xff\xfe", b"thethethe"]
    got = np.concatenate([x.log_probabilities() for x, _ in lattice.lattices(vocabulary, pa.array(words, pa.binary()))])
    assert np.allclose(got, [math.log(naive_lattice(vocabulary, w)) for w in words], rtol=1e-9)
    assert math.isclose(np.exp(vocabulary.log_p).sum(), 1)


def test_expected_pieces_spell_the_words(vocabulary):
    words, count = [b"the", "ñu".encode(), b"abcabc"], np.array([5., 2., 1.])
    (built, part), = lattice.lattices(vocabulary, pa.array(words, pa.binary()))
    size = np.bincount(built.piece, (built.target - built.source), len(vocabulary.log_p)) / np.maximum(
        np.bincount(built.piece, minlength=len(vocabulary.log_p)), 1)
    assert math.isclose((built.expected(count[part]) * size).sum(), sum(c * (len(w) + 3) for w, c in zip(words, count)))


@pytest.mark.parametrize("most", [200_000, 5])
def test_scores_equal_brute_force(spark, monkeypatch, vocabulary, most):
    monkeypatch.setattr(lattice, "TABLE_WORDS", most)
    texts = [t if t != "É" * 3000 else "É" * 40 for t in made_texts(60)]
    rows, docs = made_docs(spark, texts)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [""]
    counts = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    words = lattice.count_words(docs.selectExpr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 10 = 0, false) held", "text"))
    fitted = lattice.fit(words, vocabulary, 1)
    memo, table = {}, spelt(fitted)
    def of(w):
        if w not in memo:
            memo[w] = fitted.log_p[fitted.end] / math.log(10) if w == "" else math.log10(naive_lattice(fitted, w.encode(), table))
        return memo[w]
    got = sorted(map(tuple, lattice.score_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), rounds=1).collect()), key=str)
    want = sorted(((r[0], held(r[0]), len(tokens(r[1])), sum(counts[w] > 0 for w in tokens(r[1])), n,
                    sum(math.log10((counts[w] + .1) / (n + .1 * (v + 1))) for w in tokens(r[1])),
                    sum(map(of, tokens(r[1])))) for r in rows), key=str)
    by = lambda x: (x[0] is None, x[0] or 0, x[2])
    for a, b in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9), (a, b)


def test_rounds_raise_the_likelihood(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(made_texts(80))], "doc_id bigint, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    score = lambda r: lattice.score_texts(docs, path, rounds=r).where("NOT held_out").agg({"score": "sum"}).first()[0]
    assert score(0) < score(1) < score(2)


def test_scores_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert lattice.score_texts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect() == []
    one = spark.createDataFrame([(None, None)], "doc_id bigint, text string")
    assert lattice.score_texts(one, public_tokenizers.path("piece_bpe_32k.model")).first()["n_tokens"] == 1


# ---------------------------------------------------------------- collocations

def naive_collocations(rows, support=10, share=50, top=2000):
    count = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                count[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: c for p, c in f.items() if len(p) > 1 and c >= support}
        longest = Counter()
        for p, c in cand.items():
            if len(p) == 3:
                for sub in (p[:2], p[1:]):
                    longest[sub] = max(longest[sub], c)
        found = []
        for p, a in cand.items():
            if len(p) == 2 and p in longest and 100 * longest[p] >= share * a:
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, x[2].decode(), -x[1], x[3], x[4], n, -x[0]) for r, x in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("shard,top,support", [(1 << 21, 2000, 10), (2000, 2000, 10), (400, 7, 25)])
def test_collocations_equal_brute_force(spark, monkeypatch, shard, top, support):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    monkeypatch.setattr(collocations, "RANKED", 10)
    rows, docs = made_docs(spark, made_texts(300, 5), parts=3)
    want = naive_collocations([(r[1], r[2]) for r in rows], support, top=top)
    got = sorted(map(tuple, collocations.collocations(docs, support=support, top=top).collect()))
    assert got == want and len(want) > 4


def test_products_beyond_64_bits(spark):
    docs = spark.createDataFrame([("a b " * 40_000 + "c",)] * 40, "text string").selectExpr("text", "cast(null as string) lang")
    got = sorted(map(tuple, collocations.collocations(docs).collect()))
    assert got == naive_collocations([("a b " * 40_000 + "c", None)] * 40)


def test_collocations_of_empty_tables(spark):
    schema = "text string, lang string"
    assert collocations.collocations(spark.createDataFrame([], schema)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, "en"), ("", None), (" . ", "x")], schema)).collect() == []
