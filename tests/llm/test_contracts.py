"""The registered queries over whole small tables against brute force."""

import hashlib
import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ratecast.llm import diagonals, hnsw, queries, two_fit
from ratecast.llm.tokens import Encoder
from tests.llm import brute

SF = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet' ORDER BY doc_id").df()


def rows(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}


def test_pii(spark, docs):
    got = rows(spark, "op1_pii")
    assert len(got) == len(docs)
    found = 0
    for d, t in zip(docs.doc_id, docs.text):
        base = brute.pii(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = got[d]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone")]
        assert {s for s in text.split(",") if s} <= set(r["spans"].split(","))
        found += len(base)
    assert found


def test_mixing(spark, docs):
    got = list(rows(spark, "op2_mixing").values())
    assert len(got) == len(docs)
    by = {s: [r for r in got if (r["source_size"], r["target"]) == s] for s in {(r["source_size"], r["target"]) for r in got}}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for (size, target), some in by.items():
        assert abs(sum(r["taken"] for r in some) - target) <= 1
        assert target <= 3 * size + 1e-6
    assert abs(sum(t for _, t in by) - sum(r["size"] for r in got)) < 1e-3


def test_token_files(spark, docs):
    got, lib, start = rows(spark, "op3_bitplanes"), Encoder("byte_bpe_50k.json").lib, 0
    for d, t in zip(docs.doc_id, docs.text):
        ids = brute.token_ids(lib, t, 2)
        assert tuple(got[d])[1:] == (start, len(ids), brute.crc(ids))
        start += len(ids)
    assert len(got) == len(docs)


def test_simhash(spark, docs):
    got = rows(spark, "op4_simhash")
    prints = [brute.fingerprint(t) for t in docs.text]
    assert [got[d]["fingerprint"] for d in docs.doc_id] == [f"{p:016x}" for p in prints]
    assert [got[d]["component_id"] for d in docs.doc_id] == brute.near(docs.doc_id.tolist(), prints)


def test_packing(spark, docs):
    got, lib = queries.op5_packing(spark, SF).toPandas(), Encoder("byte_bpe_50k.json").lib
    want, total = set(), 0
    for d, t in zip(docs.doc_id, docs.text):
        ids = brute.token_ids(lib, t, 0)
        total += len(ids)
        for n, (a, size) in enumerate(two_fit.cuts(len(ids), 2048)):
            want.add((d, n, a, size, brute.crc(ids[a:a + size])))
    assert {tuple(r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)} == want
    assert len(got) == len(want)
    bins = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert bins.length.sum().max() <= 2048
    assert (bins.length.cumsum() - got.sort_values(["sequence_id", "offset"]).length == got.sort_values(["sequence_id", "offset"]).offset).all()
    assert bins.ngroups <= 1.02 * total / 2048 + 1


def test_licenses(spark, docs):
    got = rows(spark, "op6_licenses")
    seen = 0
    for d, t in zip(docs.doc_id, docs.text):
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.license_base(t, diagonals.PHRASES)
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        seen += r["n_base"]
    assert len(got) == len(docs) and seen


def test_substrings(spark, docs):
    got = rows(spark, "op8_substrings")
    want = brute.substrings(list(zip(docs.doc_id, docs.text)))
    assert [tuple(got[d])[1:] for d in docs.doc_id] == want
    assert any(n for _, n, _ in want)


def test_quality(spark, docs):
    got = rows(spark, "op10_quality")
    for d, t in zip(docs.doc_id, docs.text):
        r = got[d]
        assert tuple(r)[1:7] == brute.quality(t)
        assert not (r["kept"] and r["base_failed"])


def test_embeddings_recall(spark):
    """Planted groups of near copies among the table's vectors."""
    e = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet' ORDER BY vec_id").df()
    rng = np.random.default_rng(1)
    data = [(int(i), [float(x) for x in v], int(n)) for i, v, n in zip(e.vec_id, e.embedding, e.label)]
    top = max(i for i, _, _ in data) + 1
    for k, (_, v, n) in enumerate(data[:40]):
        for c in range(1 + (k * 7) % 40):
            data.append((top, [float(x) for x in np.array(v) + rng.normal(0, 0.02, len(v))], n if c % 9 else (n + 1) % 10))
            top += 1
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    for shard, chunk in ((8192, 65536), (60, 100)):
        got = {r["vec_id"]: r for r in hnsw.links(table, shard=shard, queries=chunk).collect()}
        want = brute.cosine_links(data)
        true = sum(n for n, _ in want)
        assert true > 500 and 0.98 * true <= sum(r["n_links"] for r in got.values()) <= true
        assert sum(got[i]["component_id"] == c for (i, _, _), (_, c) in zip(data, want)) >= 0.98 * len(data)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_pipeline(spark, docs):
    frame, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF).cache()
        assert frame.columns == docs.columns.tolist(), name
        kept.append(frame.toPandas())
    good, single, masked, mixed = kept
    assert all(not brute.quality(t)[5] for t in good.text)
    prints = brute.near(good.doc_id.tolist(), [brute.fingerprint(t) for t in good.text])
    assert sorted(single.doc_id) == sorted(set(prints))
    assert len(masked) == len(single) and not any(brute.pii(t) for t in masked.text)
    words = sum(len(brute.WORD.findall(t)) for t in masked.text)
    assert abs(sum(len(brute.WORD.findall(t)) for t in mixed.text) - words) <= mixed.source.nunique()
    packed = corpus_pipeline.run(spark, SF)
    assert set(packed.columns) >= {"doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"}
    lengths = packed.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert lengths.max() <= 2048 and lengths.median() > 2000
