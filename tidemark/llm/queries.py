"""The queries of this subpackage with production parameters, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import os
import uuid
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession

from . import annulus, bpe, exact, lines, mixing, quality, secrets, sharding, simhash, toxicity, turns, vectors, warc
from .common import shared_dir, table

#: Folder with the public vocabulary files: that of the installed package, or where such a box keeps them.
TOKENIZERS = os.path.dirname(find_spec("public_tokenizers").origin) if find_spec("public_tokenizers") else "/opt/tokenizers"


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents labelled as good: the trusted text that quality rules compare with."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_groups(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), f"{shared_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}")


def op11_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.cluster_report(table(spark, sf_dir, "embeddings"))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(exact.file_stream(spark, sf_dir, "documents"), table(spark, sf_dir, "documents"))


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_report(turns.damage(table(spark, sf_dir, "conversations")))


#: Largest label has few hundred vectors at the driver's sizes: SQL compares all pairs and spreads the smallest id along the links.
_LINKS = """pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.embedding) = len(b.embedding)
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93)"""

QUERIES = {f.__name__: f for f in (op1_mixing, op2_quality, op3_vectors, op4_toxicity, op5_secrets, op6_bpe, op7_sharding, op8_simhash, op9_lines, op10_warc, op11_annulus, op12_exact, op13_turns)}

_SIZES = r"SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS k FROM documents"



def _clusters_sql() -> str:
    """The rounds written out one after another, as a recursive query may not group what it has found."""
    assign = """a{n} AS MATERIALIZED (SELECT vec_id, v, c, d FROM (
  SELECT vec_id, k.v AS v, c, list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept k, m{n} m)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
    move = """m{next} AS MATERIALIZED (SELECT m.c, coalesce(w.v, m.v) AS v FROM m{n} m LEFT JOIN (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
    SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY c, i) GROUP BY c) w ON m.c = w.c)"""
    rounds = ",\n".join(f"{assign.format(n=n)},\n{move.format(n=n, next=n + 1)}" for n in range(annulus.ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT 8)),
{rounds},
{assign.format(n=annulus.ROUNDS)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m{annulus.ROUNDS}.v, ',')) AS centroid_sha256 FROM a{annulus.ROUNDS} JOIN m{annulus.ROUNDS} USING (c)"""


SQL = {
    "op11_annulus": _clusters_sql(),
    "op3_vectors": f"""
WITH RECURSIVE {_LINKS},
reach AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT p.a, r.root FROM pairs p JOIN reach r ON p.b = r.vec_id),
least AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT l.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, l.vec_id = component_id AS kept FROM least l LEFT JOIN n ON l.vec_id = n.vec_id""",
    "op1_mixing": rf"""
WITH sized AS ({_SIZES}),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
dealt AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM per),
levels AS (
  SELECT *, row_number() OVER o AS rn,
    (sum(source_size) OVER ())::DOUBLE AS total,
    coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS stopped,
    (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rest
  FROM dealt WINDOW o AS (ORDER BY (source_size * 3)::DOUBLE / weight, source ASC NULLS LAST)),
fixed AS (SELECT arg_min((total - stopped) / rest, rn) AS level FROM levels WHERE source_size * 3 >= (total - stopped) / rest * weight),
targets AS (SELECT source, source_size, least((source_size * 3)::DOUBLE, level * weight) AS target FROM levels, fixed),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix-1:' || k), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u, row_number() OVER (PARTITION BY k) - 1 AS i
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
drawn AS (SELECT *, (ceil((i + 1) * rate - u) - ceil(i * rate - u))::BIGINT AS copies FROM rated)
SELECT doc_id, size, source_size, target, rate, copies, copies * size AS taken FROM drawn""",
    "op7_sharding": r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, md5(coalesce(doc_id::VARCHAR, 'text:' || text, '')) AS h FROM documents),
digits AS (
  SELECT doc_id, bytes, string_agg(list_extract(['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'], strpos('0123456789abcdef', substr(h, i, 1))), '' ORDER BY i) AS bits
  FROM rows, (SELECT unnest(range(1, 17)) AS i) GROUP BY doc_id, bytes, h),
levels AS (SELECT doc_id, bytes, d::INT AS depth, substr(bits, 1, d) AS shard FROM digits, (SELECT unnest(range(0, 25)) AS d)),
sums AS (SELECT depth, shard, sum(bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_rows FROM levels GROUP BY depth, shard),
fits AS (SELECT l.doc_id, l.bytes, l.shard, l.depth, s.shard_bytes, s.shard_rows, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.depth) AS nth
  FROM levels l JOIN sums s ON l.depth = s.depth AND l.shard = s.shard WHERE s.shard_bytes <= 1048576 OR s.shard_rows = 1)
SELECT doc_id, bytes, shard, depth, shard_bytes, shard_rows FROM fits WHERE nth = 1""",
    "op9_lines": r"""
WITH named AS (
  SELECT page_id, lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host,
    string_split(regexp_replace(coalesce(html, ''), '<[^>]+>', chr(10), 'g'), chr(10)) AS all_lines FROM pages),
lined AS (
  SELECT page_id, host, generate_subscripts(all_lines, 1) AS nth, unnest(all_lines) AS line FROM named),
bare AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS word, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM lined),
totals AS (SELECT host, count(*) AS total FROM named GROUP BY host),
often AS (
  SELECT b.host, b.bare FROM (SELECT host, bare, count(DISTINCT page_id) AS n FROM bare WHERE word GROUP BY host, bare) b
  JOIN totals t ON b.host IS NOT DISTINCT FROM t.host WHERE n >= 5 AND n > 0.05 * total),
marked AS (SELECT b.*, o.bare IS NOT NULL AND word AS gone FROM bare b LEFT JOIN often o ON b.host IS NOT DISTINCT FROM o.host AND b.bare = o.bare)
SELECT page_id, host, sum(CASE WHEN word THEN 1 ELSE 0 END)::BIGINT AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY page_id, host""",
    "op12_exact": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op10_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN first IS NOT NULL AND first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> p.page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100""",
}
