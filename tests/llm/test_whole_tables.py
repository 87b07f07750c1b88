"""Each query that SQL cannot express, over a whole driver table, against brute force, the tokenizers library or held-out labels."""

import hashlib

import numpy as np
import pytest
from brute import components, quality, secrets, simhash

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_quality(spark, docs):
    trusted = {r[0] for r in queries.trusted_ids(spark, SF).collect()}
    df = queries.op2_quality(spark, SF)
    assert got(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == sorted(quality(docs, trusted))


def test_simhash(spark, docs):
    assert got(queries.op8_simhash(spark, SF), "doc_id", "fingerprint", "component_id") == sorted(simhash(docs))


def test_secrets(spark, docs):
    assert got(queries.op5_secrets(spark, SF), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_shared") == sorted(secrets(docs))


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    told = []
    for r in docs:
        ids = own.encode(r["text"], add_special_tokens=False).ids
        told.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got(queries.op6_bpe(spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(told)


def test_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = components(len(rows), list(zip(*np.nonzero(near), strict=True)))
    ids = [r["vec_id"] for r in rows]
    least = {c: min(i for i, d in zip(ids, root, strict=True) if d == c) for c in set(root)}
    told = sorted((i, int(n), least[c], i == least[c]) for i, n, c in zip(ids, near.sum(axis=1), root, strict=True))
    assert got(queries.op3_vectors(spark, SF), "vec_id", "n_links", "component_id", "kept") == told


def test_toxicity_of_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    tested = [r for r in rows if r["held_out"]]
    right = sum(r["predicted"] == r["toxic"] for r in tested) / len(tested)
    caught = sum(r["predicted"] for r in tested if r["toxic"]) / sum(r["toxic"] for r in tested)
    assert right >= 0.95 and caught >= 0.7, (right, caught, len(tested))
