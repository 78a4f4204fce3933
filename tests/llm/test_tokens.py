"""Token counts, BPE round trip and packing against the libraries themselves."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from quantflow.llm import bpe, packing, shared, tokens  # noqa: E402
from quantflow.llm.pretokens import pretokens  # noqa: E402
from quantflow.llm.shared import text_bytes  # noqa: E402

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ROWS = [(1, "Hello there, it's  me\n\n we'll see"), (2, None), (3, ""), (4, "a<|endoftext|>b"), (5, "日本語 Ᲊabc ½"),
        (6, "word " * 3000), (6, "word " * 3000), (None, "no id"), (7, "x" * 5000), (8, "a͸b 12345!!! 're")]
SCHEMA = "doc_id bigint, text string, n_tokens string, length int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in ROWS], SCHEMA)


def key(row):
    return (row[0] is None, row)


def test_pretokens_match_the_pattern():
    import regex
    split = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "'s", "'re", "'ll", "'", "l", "e", "a", "é", "1", "!", " ", "日", "x", "²"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    found, counts, unknown = pretokens(*text_bytes(pa.array(texts)))
    assert not unknown.any()
    flat = [w.decode() for w in found.to_pylist()]
    assert flat == [w for t in texts for w in split.findall(t)]
    assert counts.tolist() == [len(split.findall(t)) for t in texts]


def test_replay_equals_the_library_on_random_bytes():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    words = [bytes(rng.choice([rng.randrange(256), 97, 98, 32, 101]) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for word, ids in zip(words, bpe.encode_words(words, RANKS)):
        assert list(ids) == library._encode_single_piece(word)


def test_counts(spark, docs):
    library = tokens.load(JSON)
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024)
                   for i, t in ROWS), key=key)
    assert sorted(map(tuple, tokens.count_tokens(docs, JSON).collect()), key=key) == want
    assert tokens.count_tokens(docs.limit(0), JSON).collect() == []


def test_bpe_round_trip(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def row(i, t):
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        return i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    found = bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, found), key=key) == sorted((row(i, t) for i, t in ROWS), key=key)
    back = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted((bytes(r["bytes"]) for r in back)) == sorted((t or "").encode() for _, t in ROWS)
    assert bpe.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def check_sequences(rows, size):
    places = defaultdict(list)
    for sequence, offset, length in rows:
        places[sequence].append((offset, length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(places)


def test_packing(spark, docs):
    library = tokens.load(JSON)
    found = packing.pack_documents(docs, JSON, size=64).collect()
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in found], 64)
    want = []
    for i, t in ROWS:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        first = (len(ids) - 1) % 64 + 1
        for k, end in enumerate(range(first, len(ids) + 1, 64)):
            start = 0 if k == 0 else end - 64
            want.append((i, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
    assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(want, key=key)
    assert packing.pack_documents(docs.limit(0), JSON).collect() == []


def test_best_two_fit_replaces_the_smallest():
    # greedy: 60 + 30, gap 10; 60 + (20 + 20) fits the gap of 40 exactly
    plan = packing.best_two_fit({60: 1, 30: 1, 20: 2}, 100)
    first = {int(x) for x, s in zip(plan.length, plan.sequence) if s == 0}
    assert first == {60, 20} and plan.sequences == 2


def test_arrow_batches_are_bounded(spark):
    held = spark.conf.get(shared.BATCH_SETTING)
    try:
        for before, after in (("64m", shared.BATCH_BYTES), ("1m", 1 << 20)):
            spark.conf.set(shared.BATCH_SETTING, before)
            shared.bound_batches(spark)
            found = spark.conf.get(shared.BATCH_SETTING)
            assert int(found.rstrip("bm")) * (1 << 20 if found.endswith("m") else 1) == after
    finally:
        spark.conf.set(shared.BATCH_SETTING, held)
