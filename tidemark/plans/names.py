"""Dictionaries of names that grow with the tables, and texts held against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities
from ..operators import dictionary
from .registry import query

_W = r"[\p{L}\p{N}\p{M}_]+"
#: Surfaces: the first two and the first four words of every document, under the smallest document's name.
_ENTRIES = rf"""pieces AS (SELECT doc_id, text, regexp_extract_all(text, '{_W}|[^\p{{L}}\p{{N}}\p{{M}}_]+') AS p FROM documents),
worded AS (SELECT doc_id, CASE WHEN regexp_matches(p[1], '^{_W}$') THEN p ELSE p[2:] END AS p, CASE WHEN regexp_matches(p[1], '^{_W}$') THEN '' ELSE p[1] END AS lead FROM pieces WHERE text <> ''),
surfaces AS (SELECT doc_id, lower(array_to_string(p[1:2 * n - 1], '')) AS phrase, n, doc_id % 5 = 0 AND n = 2 AS strict, doc_id % 7 = 0 AND n = 2 AS product
  FROM worded, (SELECT unnest([2, 4]) AS n) WHERE len(p) >= 2 * n - 1),
entries AS (SELECT phrase, any_value(n) AS n, min('D' || lpad(doc_id::VARCHAR, 9, '0')) AS name, arg_min(strict, doc_id) AS strict, arg_min(product, doc_id) AS product FROM surfaces GROUP BY phrase)"""
_SPANS = rf"""{_ENTRIES},
rows AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS x FROM worded),
runs AS (SELECT doc_id, i, x || lead(x) OVER o || lead(x, 2) OVER o AS two, lead(x, 3) OVER o || lead(x, 4) OVER o || lead(x, 5) OVER o || lead(x, 6) OVER o AS more FROM rows WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
phrases AS (SELECT doc_id, (i - 1) // 2 AS pos, 2 AS n, lower(two) AS phrase FROM runs WHERE i % 2 = 1 UNION ALL SELECT doc_id, (i - 1) // 2, 4, lower(two || more) FROM runs WHERE i % 2 = 1),
hits AS (SELECT s.doc_id, s.pos, e.n, e.name, e.strict, e.product FROM phrases s JOIN entries e ON e.phrase = s.phrase AND e.n = s.n),
longest AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC) = 1),
chained AS (SELECT l.*, (SELECT min(x.pos) FROM longest x WHERE x.doc_id = l.doc_id AND x.pos >= l.pos + l.n) AS nxt FROM longest l),
picked AS (SELECT doc_id, min(pos) AS pos FROM longest GROUP BY doc_id UNION ALL SELECT c.doc_id, c.nxt FROM picked p JOIN chained c ON p.doc_id = c.doc_id AND p.pos = c.pos WHERE c.nxt IS NOT NULL),
found AS (SELECT c.* FROM chained c JOIN picked p ON c.doc_id = p.doc_id AND c.pos = p.pos)"""


def _dictionary(docs):
    opening = lambda n: F.regexp_extract("text", rf"^[^\p{{L}}\p{{N}}\p{{M}}_]*({_W}(?:[^\p{{L}}\p{{N}}\p{{M}}_]+{_W}){{{n - 1}}})", 1)
    name = F.concat(F.lit("D"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    every = docs.select(name.alias("name"), "doc_id", F.explode(F.array(F.struct(F.lit(2).alias("n"), opening(2).alias("surface")), F.struct(F.lit(4).alias("n"), opening(4).alias("surface")))).alias("s"))
    two = F.col("s.n") == 2
    return every.select("s.surface", "name", ((F.col("doc_id") % 5 == 0) & two).alias("strict"), ((F.col("doc_id") % 7 == 0) & two).alias("product")).where("surface <> ''")


def _found(t):
    docs = t("documents")
    return dictionary.spans(docs, _dictionary(docs), "doc_id", "text")


@query(f"WITH RECURSIVE {_SPANS} SELECT doc_id, pos::INT AS pos, n::INT AS n, name, strict, product FROM found")
def dictionary_spans(t):
    """Every document against a dictionary that grows with them: spans, leftmost and longest."""
    return _found(t).select("doc_id", "pos", "n", "name", "strict", "product")


@query(f"""WITH RECURSIVE {_SPANS},
able AS (SELECT f.* FROM found f WHERE NOT strict OR EXISTS (SELECT 1 FROM found o WHERE o.doc_id = f.doc_id AND o.name = f.name AND NOT o.strict)),
firsts AS (SELECT doc_id, name, min(pos) AS pos FROM able GROUP BY doc_id, name)
SELECT doc_id, string_agg(name, ',' ORDER BY pos) AS names, count(*)::INT AS n FROM firsts GROUP BY doc_id""")
def dictionary_mentions(t):
    """Names mentioned, strict surfaces only beside a plain one of the same name."""
    return dictionary.mentions(_found(t), "doc_id").select("doc_id", F.array_join("names", ",").alias("names"), F.size("names").alias("n"))


#: Names by customer, and what the dictionary has of them beside all nations: (surface, name, kind, rank).
_NAMES = (
    "US Army", "צבא ארה״ב", "Locust X3", "image captioning", "potential suppliers", "arXiv cs.CV", "Acme Corp", "germany", "FRANCE, Japan, x", "השוק הביטחוני",
    "Elbit-Systems  uk", "Ministry of Widgets", "Breaking Defense (site) - News", "GenAI image editing", "Japan", "Nature", "",
)
_KNOWN = (
    ("US Army", "US Army", "org", 1), ("צבא ארה״ב", "US Army", "org", 1), ("Elbit Systems UK", "Elbit", "company", 0), ("Elbit", "Elbit", "company", 0),
    ("Locust X3", "Locust maker", "company", 0), ("japan", "Nippon", "company", 3),
)
_GIVEN = ("company", "country", "system", "thing", "program")


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_re(values) -> str:
    return "'" + "|".join(v.replace(".", r"\.").replace("'", "''") for v in values) + "'"


_TECH = "|".join(f"(?i:{p})" for p in entities.TECHNIQUES).replace("'", "''")


@query(rf"""WITH named AS (SELECT c_custkey AS id, {_sql_list(_NAMES)}[c_custkey % {len(_NAMES)} + 1] AS name, {_sql_list(_GIVEN)}[c_custkey % {len(_GIVEN)} + 1] AS kind FROM customer),
known AS (SELECT arg_min(name, rank) AS known, arg_min(kind, rank) AS known_kind, k FROM (
  SELECT name, kind, rank, lower(trim(regexp_replace(surface, '[^\p{{L}}\p{{N}}\p{{M}}_]+', ' ', 'g'))) AS k FROM (
    SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in _KNOWN)}) v(surface, name, kind, rank)
    UNION ALL SELECT n_name, n_name, 'country', 2 FROM nation)) GROUP BY k),
keyed AS (SELECT *, lower(trim(regexp_replace(name, '[^\p{{L}}\p{{N}}\p{{M}}_]+', ' ', 'g'))) AS k FROM named),
parts AS (SELECT id, count(*) AS countries FROM (SELECT id, lower(trim(regexp_replace(unnest(string_split(name, ',')), '[^\p{{L}}\p{{N}}\p{{M}}_]+', ' ', 'g'))) AS k FROM named WHERE contains(name, ',')) JOIN known USING (k) WHERE known_kind = 'country' GROUP BY id),
wide AS (SELECT n.id, n.name, n.kind, known, known_kind, coalesce(countries, 0) AS countries, regexp_matches(lower(n.name), {_sql_re(entities.SYSTEMS)}) AS system,
  trim(regexp_replace(regexp_replace(trim(lower(n.name)), '\s*\([^)]*\)\s*$', ''), '(?s)\s+-\s+.*$', '')) AS outlet, split_part(n.k, ' ', 1) AS first, n.k
  FROM keyed n LEFT JOIN known USING (k) LEFT JOIN parts ON parts.id = n.id)
SELECT id, name, kind, CASE WHEN system THEN name ELSE coalesce(known, name) END AS canonical,
  CASE WHEN system THEN 'system' WHEN known_kind <> 'country' AND kind IN ('system', 'program') THEN kind WHEN known_kind IS NOT NULL THEN known_kind
    WHEN regexp_matches(lower(name), {_sql_re(entities.PUBLIC_BODIES)}) THEN 'org' WHEN kind IN {entities.KINDS} THEN kind ELSE 'org' END AS canonical_kind,
  (NOT (known_kind IS NOT NULL OR system) AND (regexp_matches(trim(name), '{_TECH}') OR (regexp_matches(trim(name), '^[a-z][\w''-]*(?:\s+\S+)+$') AND regexp_matches(lower(name), {_sql_re(entities.GENERIC)}))
    OR trim(name) = '' OR (contains(name, ',') AND countries >= 2) OR regexp_matches(name, {_sql_re(entities.GENERIC_HEBREW)}))) OR k IN {entities.VENUES} OR first IN {entities.VENUES} AS junk,
  outlet <> '' AND (regexp_matches(outlet, {_sql_re(entities.PRESS)}) OR contains({_sql_list(entities.PRESS)}::VARCHAR, outlet) OR outlet = 'acme corp') AS press FROM wide""")
def entity_names(t):
    """Names as they come from texts: what they stand for, of which kind, whether anyone; and whether the press."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % len(values)).cast("int") + 1)
    customers = t("customer")
    names = customers.select(F.col("c_custkey").alias("id"), pick(_NAMES).alias("name"), pick(_GIVEN).alias("kind"))
    entries = customers.sparkSession.createDataFrame(_KNOWN, "surface string, name string, kind string, rank int")
    entries = entries.unionByName(t("nation").select(F.col("n_name").alias("surface"), F.col("n_name").alias("name"), F.lit("country").alias("kind"), F.lit(2).alias("rank")))
    polled = entities.outlet_key(F.col("name")) == "acme corp"  # the one polled source
    return dictionary.canonical(names, entries).withColumn("press", entities.is_press(F.col("name"), polled))
