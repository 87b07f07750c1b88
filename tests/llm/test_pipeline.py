"""The pipeline against brute force, stage by stage."""

import hashlib
from collections import Counter

import numpy as np
from brute import quality, simhash

import corpus_pipeline
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def dicts(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "source_mix", "encode"]
    rows = dicts(docs)
    trusted = {r[0] for r in queries.trusted_ids(spark, SF).collect()}

    good = stages["quality_rules"](spark, docs, SF).cache()
    kept = {t[0] for t in quality(rows, trusted) if t[-1]}
    assert good.columns == COLUMNS and {r["doc_id"] for r in dicts(good)} == kept

    cleaned = stages["line_dedup"](spark, good, SF).cache()
    seen, total = Counter(), Counter()
    for r in dicts(good):
        total[r["source"]] += 1
        seen.update((r["source"], x.strip()) for x in {y.strip() for y in r["text"].split("\n")} if x)
    gone = {k for k, n in seen.items() if n >= 5 and n > 0.05 * total[k[0]]}
    told = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if not x.strip() or (r["source"], x.strip()) not in gone) for r in dicts(good)}
    assert {r["doc_id"]: r["text"] for r in dicts(cleaned)} == told and all(r["n_chars"] == len(r["text"]) for r in dicts(cleaned))

    single = stages["simhash_dedup"](spark, cleaned, SF).cache()
    assert sorted(r["doc_id"] for r in dicts(single)) == sorted(i for i, _, c in simhash(dicts(cleaned)) if i == c)

    mixed = stages["source_mix"](spark, single, SF).cache()
    rows = dicts(single)
    n, copies = Counter(r["doc_id"] for r in dicts(mixed)), plain_mix(rows)
    assert mixed.columns == COLUMNS and n == Counter({i: k for i, k in copies.items() if k})

    last = dicts(stages["encode"](spark, mixed, SF))
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    told = Counter()
    for r in rows:
        ids = own.encode(r["text"], add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        told[r["doc_id"], len(ids), digest, hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += copies[r["doc_id"]]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in last) == +told
    whole = dicts(corpus_pipeline.run(spark, SF))
    assert Counter(map(str, whole)) == Counter(map(str, last))


def plain_mix(rows):
    """How often each document is taken, from the targets by water filling and the hash-seeded draw."""
    size = lambda r: len(r["text"].encode().split())
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += size(r)
    order = sorted(sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        per = left / sum(weight[s] for s in free)
        full = {s for s in free if per * weight[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in full} if full else {s: per * weight[s] for s in free}
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    out = Counter()
    for r in rows:
        rate = target[r["source"]] / sizes[r["source"]]
        draw = int(hashlib.md5(f"mix-1:{r['doc_id']}:{hashlib.md5(r['text'].encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 16**13
        out[r["doc_id"]] += int(rate) + (draw < rate - int(rate))
    return out


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty, very long and repeated texts, a clashing extra column, then an empty table: run() has a row for each copy taken."""
    prose = [" ".join(f"word{(i * 7 + j * j) % 501}" for j in range(40)) for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(prose)] + [(3, prose[3], "en", "s0", 1)] * 3 + [(None, prose[4] + " more", None, None, None), (50, None, None, None, None), (51, "", "en", "s1", 0), (52, " ".join(f"long{i % 70_000}" for i in range(150_000)), "en", "s1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS fp")
    for name, df in (("odd", docs), ("none", docs.where("false"))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([*((i, 1) for i in range(9)), (None, 1), (10, None)], "doc_id long, quality int").write.parquet(str(tmp_path / name / "labels.parquet"))
    found = dicts(corpus_pipeline.run(spark, str(tmp_path / "odd")))
    assert {r["doc_id"] for r in found} <= {*range(12), None, 52} and len(found) >= 5 and all(r["n_tokens"] > 0 for r in found)
    assert max(Counter((r["doc_id"], r["ids_sha256"]) for r in found).values()) <= 3
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
