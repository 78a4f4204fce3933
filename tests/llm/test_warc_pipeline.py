"""WARC round trip and the corpus pipeline."""

import base64
import hashlib
import io
import random

import pytest

from quantflow.llm import warc


def test_round_trip(spark):
    rows = [(1, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (5, "http://c\r\nX: 1", "<p>same</p>"), (3, None, None),
            (4, "http://d", ""), (6, "http://e", "é" * 400_000), (None, "http://f", "<p>same</p>"), (7, "u", "one"), (7, "u", "one")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, record_type string")
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html in rows:
        data, top = (html or "").encode(), last[html or ""]
        response = i == top
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit",
                     None if response else top))
    order = lambda r: (r[0] is None, str(r))
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=order) == sorted(want, key=order)
    assert warc.round_trip(pages.limit(0)).collect() == []
    small = warc.round_trip(pages, least_bytes=1).where("payload_bytes = 0").collect()
    assert [r["record_type"] for r in small] == ["response"] * 2


def test_ids_of_any_text(spark):
    ids = [" a", "b\r\nZ: 1", "", "%41", "é ", None]
    pages = spark.createDataFrame([(i, "u", f"{k // 3}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    found = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    first, last = max(ids[:3]), "é "
    assert found == {i: ("response", None) if i in (first, last) else ("revisit", first if k < 3 else last) for k, i in enumerate(ids)}


def test_reader_refuses_damage():
    import zlib

    def member(data):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()

    good = warc.record("1", "u", b"payload", None, False)
    assert [p for _, _, p in warc.read_records(io.BytesIO(member(good) * 3))] == [b"payload"] * 3
    for bad in (member(good)[:-20], member(good.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n")), member(good + good), member(good[:-4])):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(io.BytesIO(bad)))


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    rng = random.Random(9)

    def text(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))

    passage = text(70)
    clean = {i: text(150) for i in range(120)}
    rows = {**clean, 200: "spam " * 300, 201: clean[5], 202: clean[6].replace(clean[6].split()[40], "edited", 1),
            203: f"{text(60)} {passage} {text(60)}", 204: f"{text(60)} {passage} {text(60)}", 205: "", 206: None}
    for i in range(300, 400):
        rows[i] = f"{text(60)} vilest scummy"
    data = [(i, t, "en", "s", len(t or "")) for i, t in rows.items()]
    spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 300)) for i in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        kept.append({r["doc_id"]: r for r in docs.collect()})
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = set(clean) | {203, 204}
    assert set(kept[0]) == good | {201, 202} | set(range(300, 400))
    assert set(kept[1]) == good | {201, 202}
    assert set(kept[2]) == good
    assert set(kept[3]) == good and passage[200:300] in kept[3][203]["text"] and passage[200:300] not in kept[3][204]["text"]
    assert all(kept[3][i]["text"] == clean[i] for i in clean)
    assert set(kept[4]) == good
