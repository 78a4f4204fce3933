"""Repetition rules against brute force; the factorization machine on held-out rows."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from quantflow.llm import repetition, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    best, places = [0] * len(words), defaultdict(list)
    for i, w in enumerate(words):
        places[w].append(i)
    for own in places.values():
        for i in own:
            for j in own:
                if i < j:
                    k = 0
                    while j + k < len(words) and words[i + k] == words[j + k]:
                        k += 1
                    best[i], best[j] = max(best[i], k), max(best[j], k)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    inside = {k for i, b in enumerate(best) if b >= 5 for k in range(i, i + b)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "longest_repeat": max(best, default=0),
            "base_failed": len(words) < 10 or 100 * len(inside) > 20 * len(words)}


def test_measures_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        texts = [None if rng.random() < 0.05 else "".join(
            rng.choice(["a", "b", "c", "aé", "#", "|x"]) + rng.choice([" ", "\n", "  ", "\t", "\x0b", "\n\n"])
            for _ in range(rng.choice([0, 1, 2, 5, 20, 60]))) for _ in range(rng.randint(1, 5))]
        found = repetition.measure(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            for name, value in brute(text).items():
                assert found[name][i] == value, (name, text)


def test_quality_edges(spark):
    clean = " ".join(f"w{i}" for i in range(300))
    rows = [(1, clean), (2, None), (3, ""), (4, "x " * 5000), (5, clean), (5, clean), (None, " \n\t"), (6, clean + " " + "a b c d e f " * 40)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, n_words string")
    found = repetition.quality(docs)
    kept = {r["doc_id"]: r["kept"] for r in found.collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: True, None: False, 6: False}
    assert found.count() == len(rows)
    stay = repetition.keep_good(docs)
    assert stay.columns == docs.columns and sorted(r["doc_id"] for r in stay.collect()) == [1, 5, 5]
    assert repetition.quality(docs.limit(0)).collect() == []
    spans = {(r["first_word"], r["n_words"]) for r in repetition.repeat_spans(docs.where("doc_id = 4")).collect()}
    assert spans == {(0, 5000)}


def test_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    has = rng.random((4000, 2)) < 0.5          # two terms; toxic only together
    label = (has.sum(1) == 2).astype(float)
    doc, term = np.nonzero(has)
    model = toxicity.fit(doc, term, label, 2)
    p = model.score(doc, term, len(label))
    assert ((p > 0.5) == (label == 1)).all()


def test_toxicity(spark):
    rng = random.Random(5)
    common = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(common) for _ in range(rng.randint(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            words += rng.sample(["vile", "scummy", "moronic", "idiotic"], 2)
            rng.shuffle(words)
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, int(toxic), 1))
    rows += [(5000, None, 0.0), (5001, "", 0.0), (None, "vile moronic", 0.0), (3, rows[3][1], 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    marks = spark.createDataFrame(labels + [(None, 1, 0), (7, None, 0), (0, 1, 1)], "doc_id bigint, toxic int, quality int")
    found = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, marks)).collect()}
    truth = dict((i, t) for i, t, _ in labels)
    held = [i for i in truth if found[i]["held_out"]]
    assert held and all(found[i]["predicted"] == truth[i] for i in held)
    assert 0 <= found[5000]["score"] == found[5001]["score"] < 0.3 and found[None]["predicted"] == 1
    alone = toxicity.score(docs, toxicity.train(docs, marks.limit(0)))
    assert alone.select("score").distinct().count() == 1
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), marks)).collect() == []


def test_terms_that_matter_only_as_a_pair(spark):
    """Both terms are equally common in toxic and other texts; what they say together decides."""
    rng = random.Random(17)
    rows, marks = [], []
    for i in range(2400):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        own = [f"w{rng.randrange(150)}" for _ in range(20)] + ["amber"] * a + ["brook"] * b
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
        marks.append((i, int(a != b)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    orphans = spark.createDataFrame([(-k, k % 2) for k in range(1, 3000)], "doc_id bigint, toxic int")  # labels of no document
    model = toxicity.train(docs, labels.unionByName(orphans))
    found = [r for r in toxicity.score(docs, model, threshold=0.5).collect() if r["held_out"]]
    right = sum(r["predicted"] == marks[r["doc_id"]][1] for r in found) / len(found)
    assert len(found) > 400 and right > 0.95
    for r in found[:50]:  # a naive sum over weights and pairs
        terms = sorted({model.terms[h] for w in rows[r["doc_id"]][1].split() for h in toxicity.word_terms(w) if h in model.terms})
        total = model.bias + sum(model.linear[t] for t in terms)
        total += sum(model.factors[s] @ model.factors[t] for k, s in enumerate(terms) for t in terms[:k])
        assert abs(1 / (1 + np.exp(-total)) - r["score"]) < 1e-9
