"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns; and what brute force says of them."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from brute import quality as brute_quality
from brute import secrets as brute_secrets
from brute import simhash as brute_simhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, lines, mixing, queries, quality, secrets, sharding, simhash, toxicity, vectors, warc
from tidemark.llm.common import materialize
from tidemark.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = f"{queries.TOKENIZERS}/byte_bpe_50k.json"
LONG = " ".join(f"word{i % 900} tail{i}" for i in range(30_000))
HEX = "0123456789abcdef" * 2
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away today", "en", "a", 1),
    (1, "The quick brown fox jumps over the lazy dog and runs far away today", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog and runs far away today", "en", "b", 1),
    (3, None, None, None, None), (4, "", "en", "a", 0), (None, "one two three four five six seven eight nine ten eleven", None, "b", 3), (None, None, "de", None, 0),
    (5, " \t\n\x0b\x0c\r ", "en", "c", 7), (6, LONG, "en", "c", len(LONG)), (7, "a b c d e a b c d e x\nsame line\nsame line\n \n \nÄÖ ß𝒳  x", "fr", "é", 2),
    (8, f'password = "hunter2hunter2" AKIA{"A1" * 10} {HEX} token=token:abcdefgh key api-key APIKEY:"x/y+z=12"', "en", "𝒳", 2),
    (9, f"𝒳𝒳 token: {HEX} secret=ab passwd='longEnough9' " + "aB3" * 14, "en", "d", 2), (10, f"copied {HEX} and AKIAAKIA{'B' * 16}", "en", "b", 2),
    (11, "x" * 5000, "en", "b", 5000), (12, "aaaaaaaa <|endoftext|> 'll don't　 \r\n\r\n  x", "en", "b", 5000),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names clash with those that the operators make."""
    names = ("size", "target", "taken", "kept", "ratio", "fp", "row", "order", "at_host", "left", "n_lines", "bad", "component_id", "n", "c1", "SCORE")
    return materialize(spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit(c) for c in names}))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def as_dicts():
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in ROWS]


def key(t):
    return tuple((x is None, str(x)) for x in t)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def test_mixing(spark, docs, empty):
    rows = mixing.mix_report(docs).collect()
    sizes = Counter()
    for r in as_dicts():
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    assert sorted({round(r["target"], 6) for r in rows}) == sorted({round(t, 6) for t in target.values()})
    assert len(rows) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in rows)
    taken = {(r["doc_id"], r["size"]): r["taken"] for r in rows}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    n = Counter(r["doc_id"] for r in out.collect())
    assert n[6] * len(LONG.split()) == taken[6, len(LONG.split())]
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_comes_near_its_targets(spark):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"))
    for r in mixing.mix_report(many).groupBy(F.col("doc_id") % 7).agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) < 0.05 * r["target"]


def test_quality(spark, docs, empty):
    trusted = spark.createDataFrame([(1,), (2,), (6,), (None,), (1,)], "doc_id long")
    told = brute_quality(as_dicts(), {1, 2, 6})
    assert got(quality.quality(docs, trusted), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == sorted(told, key=key)
    kept = quality.keep_good(docs, trusted)
    assert kept.columns == docs.columns and kept.count() == sum(t[-1] for t in told)
    assert quality.quality(empty, trusted).count() == 0
    assert quality.quality(docs, trusted.where("false")).where("kept AND ratio = 0").count() == sum(not t[-2] for t in told)
    columns = ("doc_id", "n_words", "kept", F.round("ratio", 9).alias("ratio"))
    assert got(quality.quality(docs, trusted), *columns) == got(quality.quality(docs, trusted, array_buckets=0), *columns)


def test_simhash(spark, docs, empty):
    assert got(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(brute_simhash(as_dicts()), key=key)
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns
    assert one.count() == len({t[2] if t[2] is not None else t[1] for t in brute_simhash(as_dicts())})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("segment", [1, 2, 4])
def test_simhash_links_lose_none(spark, segment):
    rng = random.Random(segment)
    values = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for v in list(values):
        for bits in (1, 2, 3, 4, 5):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), bits)))
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    told = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    assert {tuple(r) for r in simhash.links(df, segment).collect()} == told


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 101), (None, 4), (200, 300), (300, 250), (100, 101)]
    found = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 200: 200, 300: 200, 250: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_secrets(spark, docs, empty):
    assert got(secrets.find_secrets(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_shared") == sorted(brute_secrets(as_dicts()), key=key)
    assert secrets.find_secrets(empty).count() == 0


def test_bpe(spark, docs, empty):
    from tokenizers import Tokenizer

    own, coder = Tokenizer.from_file(VOCABULARY), bpe.Coder(bpe.load(VOCABULARY))
    rng = random.Random(5)
    letters = [*"aàb  \n\t1９²'.,!", "　", "\x1c", "\x85", "é", "ß", "ж", "漢", "字", "👍", "‍", "́", "<|endoftext|>", "'s", "the", " ing"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + [chr(c) * 3 for c in range(0x3000)] + ["a" * 3000, LONG]
    for t in texts:
        ids = own.encode(t, add_special_tokens=False).ids
        mine = coder.encode(t)
        assert np.frombuffer(mine, dtype="<u4").tolist() == ids, repr(t)
        assert coder.decode(mine).decode() == own.decode(ids, skip_special_tokens=False)
    assert bpe.round_trip(docs, VOCABULARY).where("n_tokens = 0").count() == 3 and bpe.round_trip(empty, VOCABULARY).count() == 0
    ids = docs.select("text", bpe.encode_column(F.col("text"), VOCABULARY).alias("ids"))
    assert all((r["text"] or "") == r["back"] for r in ids.select("text", bpe.decode_column(F.col("ids"), VOCABULARY).alias("back")).collect())


def test_sharding(spark, docs, empty):
    hot = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 100).alias("text"), F.lit(0).alias("bits"))
    rows = sharding.shard(hot.unionByName(docs.select("doc_id", "text", F.lit(1).alias("bits"))), limit=4000).collect()
    assert len(rows) == 3000 + len(ROWS)
    per = Counter()
    for r in rows:
        per[r["shard"]] += r["bytes"]
    assert all(per[r["shard"]] == r["shard_bytes"] and (r["shard_bytes"] <= 4000 or r["shard_rows"] == 1) for r in rows)
    names = sorted(per)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    assert sharding.shard(empty).count() == 0


def test_lines(spark, empty):
    rows = [(i, f"own {i}\n Boiler plate \n\nmore {i}", "h" if i < 40 else None, "x", "y") for i in range(60)] + [(60, None, "h", "x", "y"), (61, "", "z", "x", "y"), (61, "", "z", "x", "y")]
    rows += [(100 + i, f"rare {i}\nonce in a while" if i < 4 else f"rare {i}", "h", "x", "y") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars string, left string").withColumn("n_chars", F.lit(1).cast("long"))
    out = {r["doc_id"]: r for r in lines.clean_lines(df).collect()}
    assert lines.clean_lines(df).columns == df.columns and out[5]["text"] == "own 5\n\nmore 5" and out[50]["text"] == "own 50\n\nmore 50" and out[5]["n_chars"] == 13
    assert out[60]["text"] is None and out[61]["text"] == "" and "once in a while" in out[101]["text"]
    pages = spark.createDataFrame([(1, "https://U:p@Host.example:8080/x", "<p>a</p>b"), (2, None, None), (None, "mailto:x", "<"), (2, None, None)], "page_id long, url string, html string")
    assert got(lines.line_report(pages), "page_id", "host", "n_lines", "n_dropped") == sorted([(1, "host.example", 2, 0), (2, None, 0, 0), (2, None, 0, 0), (None, None, 1, 0)], key=key)
    assert lines.clean_lines(empty).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.normal(size=16) * (0.02 if i % 3 else 0.4)
        rows.append((i, [float(x) for x in v], i % 40 % 3))
    rows += [(1000 + i, rows[0][1], 0) for i in range(5)] + [(1000, rows[0][1], 0), (None, rows[0][1], 0)]
    odd = [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [1.0, None] * 8, 0), (2003, [float("nan")] * 16, 0), (2004, [float("inf")] * 16, 0), (2005, rows[0][1], None), (2006, [], 0), (2007, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(0)).withColumn("v", F.lit(0))
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    for extra in ({}, {"cell_rows": 20, "block": 16}):
        found = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.vector_groups(df, **extra).collect()}
        n = Counter((r["vec_id"], r["n_links"]) for r in vectors.vector_groups(df, **extra).collect())
        assert n == Counter((r[0], int(k)) for r, k in zip(rows, near.sum(axis=1), strict=True)) + Counter((o[0], 0) for o in odd)
        assert all(c == v for v, _, c, _ in found if v is not None and v >= 2000)
        root = {v: c for v, _, c, _ in found}
        for i, j in zip(*np.nonzero(near), strict=True):
            assert root[rows[i][0]] == root[rows[j][0]] <= (rows[i][0] if rows[i][0] is not None else 0)
    assert vectors.vector_groups(df.where("false")).count() == 0 and vectors.vector_groups(df.where("vec_id = 2000")).collect()[0]["kept"]


def test_toxicity(spark, docs, empty):
    text = [(i, f"plain {i} text of words {i % 7}" + (" nasty nastier" if i % 4 == 0 else "")) for i in range(200)]
    many = spark.createDataFrame(text, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(many, labels).collect()
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in rows) and any(r["held_out"] for r in rows)
    assert {r["score"] for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(docs, labels).count() == len(ROWS) and toxicity.toxicity(empty, labels).count() == 0


def test_warc(spark, tmp_path):
    noise = random.Random(3)
    body = "".join(chr(noise.randrange(32, 127)) for _ in range(9000))
    rows = [(i, f"http://h/{i} ü", body[:50] if i % 5 == 0 else body if i % 5 == 1 else body[i:]) for i in range(40)] + [(1, "http://h/1", body), (None, None, body), (None, "u\r\nx", None), (77, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit(1))
    told = []
    for i, _, t in rows:
        raw = (t or "").encode()
        revisit = t == body and i != 0 and i != 1 and len(raw) >= 100
        told.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None))
    smaller = {hashlib.sha256(body[k:].encode()).hexdigest() for k in range(40)}
    assert len(smaller) == 40
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    for split in ("128m", "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            assert got(warc.round_trip(df, str(tmp_path / split)), *columns) == sorted(told, key=key)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert warc.round_trip(df.where("false"), str(tmp_path / "none")).count() == 0


def test_warc_with_magics_inside_members(spark, tmp_path):
    """Stored (uncompressed) members whose content is full of member heads: no byte range may lose or double a record."""
    import zlib

    def stored(raw):
        pack = zlib.compressobj(0, zlib.DEFLATED, 31)
        return pack.compress(raw) + pack.flush()

    pages = [(str(i), (warc.MAGIC + b"WARC/1.1 \x00" * 3 + os.urandom(40)) * (i % 9)) for i in range(60)]
    whole = b"".join(stored(warc.record(i, None, raw, hashlib.sha256(raw).hexdigest(), None)) for i, raw in pages)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes(whole)
    told = sorted((i, hashlib.sha256(raw).hexdigest()) for i, raw in pages)
    for split in ("128m", "501b", "97b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            assert sorted(tuple(r) for r in warc.read_warc(spark, str(tmp_path / "a")).select("page_id", "payload_digest").collect()) == told
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(whole[:-9])
    with pytest.raises(Exception, match="archive"):
        warc.read_warc(spark, str(tmp_path / "b")).collect()


def test_warc_of_other_writers(spark, tmp_path):
    """Usual names, fields in any case, foreign ids, records that are no responses, and small byte ranges."""
    def made(kind, headers, block):
        head = ["WARC/1.0", f"warc-type: {kind}", *headers, f"content-length: {len(block)}"]
        return warc.member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    body = os.urandom(3000)
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    records = [made("warcinfo", ["WARC-RECORD-ID: <urn:uuid:1>", "Content-Type: application/warc-fields"], b"software: x\r\n\r\nmore")]
    for i in range(30):
        records.append(made("request", [f"WARC-Record-ID:<urn:uuid:q{i}>", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\n\r\n"))
        records.append(made("response", [f"Warc-Record-Id: <urn:uuid:r{i}>", "WARC-Target-URI: <http://h/>", "Content-Type: Application/HTTP;msgtype=response"], http + body[i:]))
    records.append(made("revisit", ["WARC-Record-ID: <urn:uuid:v>", "WARC-Refers-To: <urn:uuid:r0>", "WARC-Payload-Digest: sha1:ABC", "Content-Type: application/http"], http))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "CC-MAIN-1.warc.gz").write_bytes(b"".join(records))
    (tmp_path / "in" / "plain.warc").write_bytes(b"".join(records[:1]))
    told = [("warcinfo", "urn:uuid:1", None, None, 19)] * 2 + [("revisit", "urn:uuid:v", "urn:uuid:r0", None, None)]
    for i in range(30):
        told += [("request", f"urn:uuid:q{i}", None, None, 0), ("response", f"urn:uuid:r{i}", None, "http://h/", 3000 - i)]
    for split in ("128m", "997b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            read = warc.read_warc(spark, str(tmp_path / "in"))
            assert got(read, "record_type", "page_id", "refers_to", "uri", "payload_bytes") == sorted(told, key=key)
            assert {r["payload_digest"] for r in read.where("record_type = 'revisit'").collect()} == {"sha1:ABC"}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_warc_keeps_empty_ids_and_long_payloads(spark, tmp_path):
    rows = [("", "u", "x" * 200), (None, "u", "y" * 200), ("a b>", None, "long " * 1_000_000)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    found = got(warc.round_trip(df, str(tmp_path / "w")), "page_id", "payload_bytes", "record_type")
    assert found == sorted([(i, len(t), "response") for i, _, t in rows], key=key)


def test_vectors_of_many_lengths(spark):
    """Twelve lengths, each with its own pair of near vectors; none links with another length."""
    rows = [(10 * d + i, [1.0 + 0.01 * i * (j % 2) for j in range(d)], 1) for d in range(2, 14) for i in range(2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    told = sorted(((v, 1, v - v % 10, v % 10 == 0) for v, _, _ in rows), key=key)
    for extra in ({}, {"cell_rows": 1, "block": 1}):
        assert got(vectors.vector_groups(df, **extra), "vec_id", "n_links", "component_id", "kept") == told
    one = df.withColumn("label", F.lit("a b"))
    assert got(vectors.vector_groups(one), "vec_id", "n_links", "component_id", "kept") == told


def test_nnpu_and_scores_beside_plain_versions(spark):
    """The fit against a loop over rows and features; scores against a sum over words."""
    import math

    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, size=(60, 7)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] + rng.normal(size=60) > 3).astype(int)
    positive, prior = (y == 1) / (y == 1).sum(), 0.3
    unlabelled = np.stack([(y == 0) / (y == 0).sum() * 0.7 + prior * positive, np.full(60, 1 / 60)], axis=1)
    weights, bias = toxicity.fit_nnpu(x, positive, unlabelled, prior, rounds=40)
    for k in range(2):
        theta, m, v = [0.0] * 7 + [math.log(prior / (1 - prior))], [0.0] * 8, [0.0] * 8
        for t in range(1, 41):
            s = [1 / (1 + math.exp(-(sum(w * float(c) for w, c in zip(theta, row, strict=False)) + theta[7]))) for row in x]
            loss_minus = sum((unlabelled[i, k] - prior * positive[i]) * -math.log(1 - s[i]) for i in range(60))
            g = [1e-3 * w for w in theta[:7]] + [0.0]
            for i in range(60):
                plus, from_p, from_u = prior * positive[i] * (s[i] - 1), prior * positive[i] * s[i], unlabelled[i, k] * s[i]
                slope = plus - from_p + from_u if loss_minus >= 0 else from_p - from_u
                for j in range(8):
                    g[j] += slope * (float(x[i, j]) if j < 7 else 1.0)
            for j in range(8):
                m[j], v[j] = 0.9 * m[j] + 0.1 * g[j], 0.999 * v[j] + 0.001 * g[j] * g[j]
                theta[j] -= 0.05 * (m[j] / (1 - 0.9**t)) / (math.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        assert np.allclose([*weights[k], bias[k]], theta, atol=2e-3), (k, weights[k], theta)
    model = toxicity.Model({"nast": 0, "nasty$": 1, "ugly$": 2}, np.array([[1.0, 2.0, -0.5], [0.5, 0.0, 3.0]]), np.array([-1.0, -2.0]))
    text = [(1, "Nasty, NASTY nastier ugly"), (2, None), (3, "ugly " * 50_000), (3, "ugly " * 50_000), (4, "")]
    got_ = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(text, "doc_id long, text string"), model).collect()}
    plain = lambda n: sum(1 / (1 + math.exp(-(b + sum(w * math.log1p(c) for w, c in zip(row, n, strict=True))))) for row, b in zip(model.weights, model.bias, strict=True)) / 2
    assert np.allclose([got_[1], got_[2], got_[3], got_[4]], [plain((2, 1, 1)), plain((0, 0, 0)), plain((0, 0, 1)), plain((0, 0, 0))])


def test_toxicity_with_one_id_on_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 40)
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 80)
    seen = []
    monkeypatch.setattr(toxicity, "fit_nnpu", lambda x, *a, real=toxicity.fit_nnpu: seen.append(len(x)) or real(x, *a))
    text = [(i, f"plain {i} words {i % 7}" + (" nasty nastier" if i % 4 == 0 else "")) for i in range(400)] + [(5, f"plain hot {i}") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400, 3)], "doc_id long, toxic int")
    rows = toxicity.toxicity(spark.createDataFrame(text, "doc_id long, text string"), labels).collect()
    assert len(rows) == 600 and seen and seen[0] <= 160
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in rows) >= 590


def test_lines_by_exchange_and_by_broadcast_agree(spark):
    rows = [(i, f"own {i}\nBoiler {i % 3}\nshared line" + " x" * 10, None if i % 2 else f"h{i % 3}") for i in range(120)] + [(200, "a " * 200_000 + "\nshared line", "h0")]
    df = spark.createDataFrame(rows, "page_id long, html string, host string").withColumn("url", F.concat(F.lit("http://"), "host", F.lit("/")))
    columns = ("page_id", "host", "n_lines", "n_dropped", F.md5("text").alias("text"))
    assert got(lines.line_report(df), *columns) == got(lines.line_report(df, max_broadcast=0), *columns)
    assert lines.line_report(df).where("n_dropped > 0").count() > 100


def test_keep_one_of_repeated_rows(spark):
    words = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(5)]
    rows = [(1, words[0])] * 6 + [(2, words[0]), (3, words[1]), (3, words[1]), (None, words[2]), (None, words[2]), (None, words[0]), (7, None), (8, ""), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("ID", F.lit(1))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=key) == sorted([(1, words[0]), (3, words[1]), (None, words[2]), (7, None)], key=key)
