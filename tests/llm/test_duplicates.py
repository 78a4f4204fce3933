"""Substring removal, Jaccard join, paragraph dedup and embeddings against brute force."""

import hashlib
import math
import os
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quantflow.llm import components, embeddings, jaccard, lyndon, paragraphs, substrings
from quantflow.llm.shared import chunks
from quantflow.llm.shingles import mix  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(200):
        texts = [[rng.randint(1, rng.choice([1, 2, 26])) for _ in range(rng.choice([0, 1, 2, 5, 40]))] + [0]
                 for _ in range(rng.randint(1, 6))]
        flat, ends, base = np.array([x for t in texts for x in t]), np.cumsum([len(t) for t in texts]), 0
        found = lyndon.suffix_arrays(flat, ends)
        for t in texts:
            assert (found[base:base + len(t)] - base).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
            base += len(t)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_substring_removal(spark, monkeypatch):
    rng = random.Random(4)
    passage, copy = words(rng, 60), words(rng, 80)
    rows = [(i, f"{words(rng, rng.randint(1, 40))} {passage} {words(rng, 30)}") for i in range(100)]
    rows += [(200, copy), (201, copy), (201, copy), (202, None), (203, ""), (204, "z" * 900), (205, "z" * 200),
             (206, words(rng, 3000)), (None, passage[:210]), (207, "é" * 99 + "a"), (208, passage[3:202])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n_bytes int")
    found = substrings.remove_repeats(docs).drop("kept").collect()
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k:k + 200] for b in raw for k in range(len(b) - 199))
    want = []
    for (i, _), b in zip(rows, raw):
        gone = [False] * len(b)
        for k in range(len(b) - 199):
            if seen[b[k:k + 200]] > 1:
                gone[k:k + 200] = [True] * 200
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    order = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, found), key=order) == sorted(want, key=order)
    assert substrings.remove_repeats(docs.limit(0)).collect() == []


def test_jaccard_join(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        base = words(rng, rng.randint(1, 120)).split()
        rows.append((10 * i, " ".join(base)))
        for k in range(rng.randint(0, 5)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = "changed"
            rows.append((10 * i + k + 1, " ".join(own).upper()))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One\tTWO"), (1004, "One\tTWO"), (1005, "one")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, component_id int")
    found = jaccard.link_documents(docs).collect()

    def shingles(t):
        w = WORD.findall((t or "").lower())
        return {tuple(w[k:k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = roots(sets, links)
    assert sorted(map(tuple, found)) == sorted((i, len(sets[i]), root[i]) for i, _ in rows)
    assert jaccard.link_documents(docs.limit(0)).collect() == []


def test_prefix_tree_prunes_nothing_needed():
    rng = np.random.default_rng(2)
    sets = [np.sort(rng.choice(60, rng.integers(1, 40), replace=False)) for _ in range(80)]
    tree = jaccard.Tree(np.zeros(0, np.int64))
    for k, s in enumerate(sets):
        tree.insert(s, k)
    for s in sets[:30]:
        want = {k for k, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 50 * len(np.union1d(s, o))}
        assert set(tree.similar(s, 50)) == want


def test_parity_sketches_keep_every_link(spark):
    rng = np.random.default_rng(9)
    sets = []
    for size in (1, 2, 40, 63, 64, 65, 120, 130, 700, 1030, 70_000):
        base = rng.integers(0, 2 ** 63, size, np.uint64)
        for share in (0, 0.04, 0.12, 0.15, 0.6, 1):
            other = base.copy()
            other[:int(share * size)] = rng.integers(0, 2 ** 63, int(share * size), np.uint64)
            sets.append(np.unique(np.append(other, rng.integers(0, 2 ** 63, int(rng.integers(0, 1 + size // 9)), np.uint64))))
    size = np.array([len(s) for s in sets])
    sketch = jaccard.parity_sketches(np.repeat(np.arange(len(sets)), size), np.concatenate(sets), size).to_pylist()
    assert max(map(len, sketch)) == jaccard.SKETCH_BITS // 64
    table = spark.createDataFrame([(k, int(size[k]), sketch[k]) for k in range(len(sets))], "node bigint, size bigint, sketch array<bigint>")
    every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * min(size[i], size[j]) >= 85 * max(size[i], size[j])]
    kept = {tuple(r) for r in jaccard.plausible(spark.createDataFrame(every, "hub bigint, member bigint"), table, 85).collect()}
    overlap = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i, j in every}
    links = {(i, j) for i, j in every if 100 * overlap[i, j] >= 85 * (size[i] + size[j] - overlap[i, j])}
    assert links and links <= kept
    far = {p for p in every if not overlap[p] and 100 < size[p[0]] < 2_000}
    assert far and not far & kept


def test_paragraphs(spark):
    rng = random.Random(8)
    passage = words(rng, 70)
    rows = [(i, f"{words(rng, 60)}\n{words(rng, 17)} {passage} {words(rng, 40)}") for i in range(12)]
    rows += [(50, words(rng, 200)), (51, None), (52, ""), (53, "Licensed under the same terms as before."),
             (54, "Licensed under the same terms as before."), (55, words(rng, 4000)), (None, passage), (56, passage), (56, passage)]
    docs = spark.createDataFrame([(i, t, "src", len(t or "")) for i, t in rows], "doc_id bigint, text string, source string, n_chars bigint")
    found = paragraphs.repeated_runs(docs).collect()
    assert {r["doc_id"] for r in found} == {*range(1, 12), 56, None}
    assert all(r["source_ids"] == [0 if r["doc_id"] is not None else 56] for r in found)
    assert all(r["n_words"] >= 35 for r in found if r["doc_id"] != 56)
    less = {r["doc_id"]: r for r in paragraphs.remove_runs(docs).collect()}
    before = dict(rows)
    assert all(less[i]["text"] == before[i] for i in (0, 50, 51, 52, 53, 54, 55)) and None not in less
    inner = " ".join(passage.split()[25:45])
    assert all(inner not in less[i]["text"] and less[i]["n_chars"] == len(less[i]["text"]) for i in range(1, 12))
    assert paragraphs.remove_runs(docs).columns == docs.columns
    assert paragraphs.repeated_runs(docs.limit(0)).collect() == []


def test_paragraphs_beside_columns_of_any_name(spark):
    rng = random.Random(31)
    passage, own = words(rng, 200), [words(rng, 30) for _ in range(4)]
    rows = [(None, f"{own[0]}\n{passage}"), (None, f"{own[1]}\n{passage}"), (None, f"{own[2]}\n{passage}"), (0, own[3]), (0, None), (None, None)]
    names = ["_key", "_id", "_runs", "_likely", "_word", "_bits", "key", "c0", "number"]
    docs = spark.createDataFrame([(*(f"{n}{k}" for n in names), i, t) for k, (i, t) in enumerate(rows)],
                                 ", ".join(f"{n} string" for n in names) + ", doc_id bigint, text string")
    less = paragraphs.remove_runs(docs)
    assert less.schema == docs.schema
    left = sorted(map(tuple, less.collect()))
    assert [r[:-1] for r in left] == [(*(f"{n}{k}" for n in names), i) for k, (i, _) in enumerate(rows)]
    assert [r[-1] for r in left[3:]] == [own[3], None, None] and all(own[k] in left[k][-1] for k in range(3))
    assert sum(" ".join(passage.split()[20:180]) in r[-1] for r in left[:3]) == 1
    assert [r["source_ids"] for r in paragraphs.repeated_runs(docs).collect()] == [[None]] * 2


def test_paragraphs_of_rows_that_share_an_id(spark):
    rng = random.Random(12)
    copy, other, passage = words(rng, 40), "é" * 30 + " " + words(rng, 120), words(rng, 90)
    twin = f"{words(rng, 30)}\n{passage}\n{words(rng, 30)}"
    rows = [(1, copy), (56, copy), (56, copy), (2, passage), (70, twin), (70, other)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    found = [(r["doc_id"], r["n_words"], r["source_ids"]) for r in paragraphs.repeated_runs(docs).collect()]
    whole = [f for f in found if f[0] == 56]  # the equal rows are one document
    assert len(whole) == 1 and whole[0][1] >= 36 and whole[0][2] == [1]
    assert [f[2] for f in found if f[0] == 70] == [[2]]
    left = [(r["doc_id"], r["text"]) for r in paragraphs.remove_runs(docs).collect()]
    assert sorted(i for i, t in left if len(t.split()) > 4) == [1, 2, 70, 70]
    assert (70, other) in left and sum(" ".join(passage.split()[25:60]) in t for _, t in left) == 1


def test_short_lines_go_only_if_they_repeat(spark):
    rng = random.Random(14)
    head, foot = words(rng, 12), words(rng, 12)
    short = [words(rng, 2) for _ in range(60)]
    same = [words(rng, 3) for _ in range(6)]
    frame = lambda body: "\n".join([head, *body, foot])
    rows = [(1, frame(short[:20])), (2, frame(short[20:40])), (3, frame(same)), (4, frame(same)), (5, frame(same[:5] + short[40:41]))]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    found = paragraphs.repeated_runs(docs).collect()
    assert [(r["doc_id"], r["n_words"]) for r in found if r["doc_id"] in (2, 4)] == [(4, 42)]
    left = {r["doc_id"]: r["text"] for r in paragraphs.remove_runs(docs).collect()}
    assert left[1] == rows[0][1] and left[2] == rows[1][1] and left[3] == rows[2][1]
    assert 4 not in left and short[40] in left[5] and same[2] not in left[5]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 200)]
    edges += [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(30)] + [(None, 5), (3, 2), (3, 2)]
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    full = [(a, b) for a, b in edges if a is not None]
    want = roots({x for e in full for x in e}, full)
    groups = {}
    for r in found:
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == sorted(sorted(n for n in want if want[n] == k) for k in set(want.values()))


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        center = rng.normal(size=16)
        for k in range(rng.integers(1, 4)):
            rows.append((len(rows), (center + 0.08 * k * rng.normal(size=16)).astype(np.float32).tolist(), int(i % 3)))
    twin = rows[0][1]
    rows += [(9000, twin, 0), (9001, twin, 0), (9001, twin, 0), (9002, [2 * x for x in twin], 0), (9003, twin, None), (9004, None, 0),
             (9005, [0.0] * 16, 0), (9006, [float("nan")] + [1.0] * 15, 0), (9007, [None] + [1.0] * 15, 0), (9008, [], 0),
             (9009, [1.0, 2.0], 0), (9010, [2.0, 4.0], 0), (9011, [float("inf")] * 16, 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, kept string")
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(frame).collect())

    def cosine(a, b):
        if a[2] is None or a[2] != b[2] or not a[1] or not b[1] or len(a[1]) != len(b[1]):
            return 0
        if any(x is None or not math.isfinite(x) for x in a[1] + b[1]) or not any(a[1]) or not any(b[1]):
            return 0
        x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
        return x @ y / math.sqrt(x @ x) / math.sqrt(y @ y)

    links = [(i, j) for i in range(len(rows)) for j in range(i) if cosine(rows[i], rows[j]) >= 0.98]
    root = roots([r[0] for r in rows], [(rows[i][0], rows[j][0]) for i, j in links])
    degree = Counter(k for pair in links for k in pair)
    assert found == sorted((r[0], degree[k], root[r[0]], root[r[0]] == r[0]) for k, r in enumerate(rows))
    assert embeddings.near_duplicates(frame.limit(0)).collect() == []


def test_near_copies_of_whole_lines(spark):
    rng = random.Random(21)
    rows, pairs = [], 0
    for n in (50, 70, 100):  # similar at 0.8 with one word edited
        for _ in range(10):
            own = words(rng, n).split()
            edited = list(own)
            edited[rng.randrange(5, n - 5)] = "edited"
            for k, line in enumerate((own, edited)):
                rows.append((1000 * k + pairs, f"{words(rng, 15)}\n{' '.join(line)}\n{words(rng, 15)}"))
            pairs += 1
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    left = {r["doc_id"]: r["text"] for r in paragraphs.remove_runs(docs).collect()}
    gone = sum("edited" not in left[1000 + k] and len(left[1000 + k].split()) == 30 for k in range(pairs))
    assert gone >= 0.95 * pairs and all(left[k] == dict(rows)[k] for k in range(pairs))


def test_blocks_join_what_all_links_would(monkeypatch):
    import pyarrow as pa

    from quantflow.llm import blocks
    rng = np.random.default_rng(12)
    for percent in (50, 80, 85):
        sets = []
        for _ in range(25):
            base = rng.choice(4000, rng.integers(1, 300), replace=False)
            for _ in range(4):
                own = base.copy()
                k = int(rng.integers(0, 1 + len(base) // 6))
                own[:k] = rng.choice(4000, k) + 4000
                sets.append(np.unique(own).astype(np.int64))
        root = rng.integers(0, 60, len(sets))
        links = [(a, b) for a in range(len(sets)) for b in range(a)
                 if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))]
        same = [(a, b) for a in range(len(sets)) for b in range(a) if root[a] == root[b]]
        found = blocks.tree_links(jaccard.Tree(np.zeros(0, np.int64)), sets, root.copy(), percent)
        assert set(found) <= {(a, b) for x, y in links for a, b in ((x, y), (y, x))}
        assert roots(range(len(sets)), same + found) == roots(range(len(sets)), same + links)
        # the first pass ties together both ends of every link between different roots
        size = np.array([len(s) for s in sets])
        sketch = jaccard.parity_sketches(np.repeat(np.arange(len(sets)), size), np.concatenate(sets).view(np.uint64), size)
        none = np.zeros(len(sets), np.int32)
        table = pa.table({"token": none, "x": none, "y": none, "node": np.arange(len(sets)), "root": root, "size": size, "place": none,
                          "sketch": sketch})
        ties = blocks.may_link(table, percent).to_pydict()
        group = roots(range(len(sets)), list(zip(ties["a"], ties["b"])))
        assert all(group[a] == group[b] for a, b in links if root[a] != root[b])
        assert len(ties["a"]) < len(sets)


def test_jaccard_join_of_a_hot_token(spark, monkeypatch):
    """Many components meet at one token, whose nodes are dealt into several parts."""
    from quantflow.llm import blocks
    monkeypatch.setattr(blocks, "BLOCK_NODES", 8)
    rng = random.Random(16)
    shared, rows = words(rng, 40).split(), []
    for i in range(60):
        own = list(shared)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = "".join(rng.choice("xyz") for _ in range(6))
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")

    def shingles(t):
        w = WORD.findall(t.lower())
        return {tuple(w[k:k + 4]) for k in range(len(w) - 3)}

    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = roots(sets, links)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.link_documents(docs).collect()} == root


def test_pieces_are_gone_when_links_are_made(spark, monkeypatch):
    """Only units that may have partners are on disk while their sets are moved."""
    rng = random.Random(18)
    shared = words(rng, 60)
    docs = spark.createDataFrame([(i, f"{words(rng, 50)} {shared} {words(rng, 50)}") for i in range(6)] + [(9, words(rng, 4000))],
                                 "doc_id bigint, text string")
    seen, link_sets = {}, paragraphs.link_sets

    def look(posts, sets_of, percent, folder):
        seen["names"] = set(os.listdir(folder))
        seen["units"] = spark.read.parquet(f"{folder}/full").groupBy("id").count().collect()
        return link_sets(posts, sets_of, percent, folder)

    monkeypatch.setattr(paragraphs, "link_sets", look)
    monkeypatch.setattr(paragraphs, "run_folder", lambda s, what: str(jaccard.run_folder(s, what)).removeprefix("file:"))
    assert {r["doc_id"] for r in paragraphs.repeated_runs(docs).collect()} == {1, 2, 3, 4, 5}
    assert not {"pieces", "every", "met"} & seen["names"] and "posts" in seen["names"]
    assert sum(r["count"] for r in seen["units"] if r["id"] == 9) <= 5


def test_cutting_takes_little_memory():
    rng = random.Random(19)
    texts = pa.array([words(rng, 2_000) for _ in range(150)])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    assert texts.nbytes > 1 << 20
    tracemalloc.start()
    for part in chunks([batch], 0, paragraphs.CUT_BYTES):
        paragraphs.units(part.column(0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_paragraph_groups_do_not_grow_with_chance_meetings(spark, monkeypatch):
    """Units that meet by a common shingle, but are not alike, are not held against each other's sets."""
    from quantflow.llm import blocks
    monkeypatch.setattr(blocks, "BLOCK_NODES", 8)
    rng = random.Random(23)
    common = [words(rng, 5) for _ in range(6)]  # shingles that chain many lines together
    lines = [f"{words(rng, 3)} {rng.choice(common)} {words(rng, 3)} {rng.choice(common)} {words(rng, 2)}" for _ in range(300)]
    passage = words(rng, 60)
    rows = [(i, "\n".join(lines[i::30])) for i in range(30)] + [(i, f"{words(rng, 20)} {passage} {words(rng, 20)}") for i in (40, 41)]
    seen, block_links = [], jaccard.group_blocks

    def look(*args):
        out = block_links(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "group_blocks", look)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [(r["doc_id"], r["source_ids"]) for r in paragraphs.repeated_runs(docs).collect()] == [(41, [40])]
    assert sum(seen) <= 60


def test_groups_larger_than_a_block_are_searched_in_their_ties(spark, monkeypatch):
    """A chain of ties makes one group of all nodes: each is moved for the blocks it is tied in, not for all of the group."""
    from quantflow.llm import blocks
    monkeypatch.setattr(blocks, "BLOCK_NODES", 8)
    n, tie = 400, "a bigint, b bigint, block bigint"
    able = spark.createDataFrame([(7, k, k, 10) for k in range(n)] + [(9, k, k, 10) for k in (1000, 1001)],
                                 "token bigint, node bigint, root bigint, size bigint")
    ties = spark.createDataFrame([(k, k + 1, 5_000 + k) for k in range(n - 1)] * 2 + [(1000, 1001, 1)], tie)
    large = able.groupBy("token").agg(F.count("*").alias("count"), F.sum("size").alias("total")).where(blocks.block_parts() > 1).select("token")
    found = {}
    for r in blocks.group_blocks(able, ties, large).collect():
        found.setdefault((r["token"], r["x"], r["y"]), []).append(r["node"])
    assert sum(map(len, found.values())) == 2 * (n - 1) + 2
    assert {tuple(sorted(v)) for v in found.values()} == {(k, k + 1) for k in range(n - 1)} | {(1000, 1001)}


def test_ties_of_small_and_large_blocks():
    """Blocks that are looked through together give the ties that they give one by one."""
    from quantflow.llm import blocks
    rng = np.random.default_rng(5)
    rows = []
    for token in range(80):
        base = rng.choice(10 ** 6, int(rng.choice([8, 60, 200])), replace=False)
        for _ in range(int(rng.choice([2, 3, 5, 30]))):
            own = base.copy()
            k = int(rng.integers(0, 1 + len(own) // 5))
            own[:k] = rng.choice(10 ** 6, k) + 10 ** 6
            rows.append((token, np.unique(own)))
    size = np.array([len(v) for _, v in rows])
    sketch = jaccard.parity_sketches(np.repeat(np.arange(len(rows)), size), np.concatenate([v for _, v in rows]).view(np.uint64), size)
    none, token = np.zeros(len(rows), np.int32), np.array([t for t, _ in rows])
    for held in ({}, {"sketch": sketch}):
        table = pa.table({"token": token, "x": none, "y": none, "node": np.arange(len(rows)) * 7, "root": np.arange(len(rows)), "size": size,
                          "place": none, **held})
        whole = blocks.may_link(table, 80).to_pydict()
        one = [blocks.may_link(table.filter(pa.array(token == t)), 80).to_pydict() for t in range(80)]
        assert all(whole[c] == [v for o in one for v in o[c]] for c in ("a", "b", "block"))
        near = [(7 * i, 7 * j) for i in range(len(rows)) for j in range(i) if token[i] == token[j] and
                100 * len(np.intersect1d(rows[i][1], rows[j][1])) >= 80 * len(np.union1d(rows[i][1], rows[j][1]))]
        group = roots([7 * k for k in range(len(rows))], list(zip(whole["a"], whole["b"])))
        assert near and all(group[a] == group[b] for a, b in near)
        # the nodes tied in one block share its hash
        at = dict(zip(whole["a"], whole["block"])) | dict(zip(whole["b"], whole["block"]))
        assert all(at[a] == at[b] for a, b in near)


def test_two_bitmaps_pass_all_partners_and_few_others(spark, monkeypatch):
    from quantflow.llm import shared
    monkeypatch.setattr(shared, "BITMAP_WORDS", 64)  # 4096 bits
    rows, keys = spark.range(8_000).withColumnRenamed("id", "k"), spark.range(1_000).withColumnRenamed("id", "k")
    found = {r["k"] for r in shared.likely_rows(rows, keys, "k").collect()}
    one = shared.likely_in(rows, keys, "k").where("_likely").count()
    assert found >= set(range(1_000)) and len(found) - 1_000 < (one - 1_000) / 2
