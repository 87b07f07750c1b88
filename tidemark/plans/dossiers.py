"""Two runs of dossiers made from the documents, fifty to a product, and what changed between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dossiers
from .registry import query

#: By doc_id % 6 a parameter stays, changes its value, its name, goes, loses its value, or changes both; every seventh document adds one.
_RUNS = r"""base AS (SELECT doc_id, doc_id // 50 AS product, string_split(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', ' ', 'g')), ' ') AS w FROM documents),
told AS (SELECT doc_id, product, array_to_string(w[1:6], ' ') AS name, array_to_string(w[7:12], ' ') AS value, CASE WHEN product % 2 = 0 THEN 'k' || doc_id ELSE '' END AS key FROM base),
prev AS (SELECT product, doc_id AS id, key, name, value FROM told),
cur AS (SELECT product, doc_id AS id, key, CASE WHEN doc_id % 6 IN (2, 5) THEN regexp_replace(name, '^[^ ]+ ', 'renamed ') ELSE name END AS name,
    CASE doc_id % 6 WHEN 1 THEN value || ' seven eight nine ten eleven twelve' WHEN 4 THEN '' WHEN 5 THEN 'all new ' || doc_id ELSE value END AS value, doc_id % 11 <> 0 AS cited FROM told WHERE doc_id % 6 <> 3
  UNION ALL SELECT product, doc_id + 1000000000, CASE WHEN key <> '' THEN 'n' || doc_id ELSE '' END, 'fresh parameter ' || doc_id, 'first value ' || doc_id, true FROM told WHERE doc_id % 7 = 0)"""


def _runs(t):
    text = F.coalesce("text", F.lit(""))
    w = F.split(F.trim(F.regexp_replace(text, r"[ \t\n\x0b\f\r]+", " ")), " ")
    told = t("documents").select(
        "doc_id", F.floor(F.col("doc_id") / 50).alias("product"), F.array_join(F.slice(w, 1, 6), " ").alias("name"), F.array_join(F.slice(w, 7, 6), " ").alias("value")
    ).withColumn("key", F.when(F.col("product") % 2 == 0, F.concat(F.lit("k"), F.col("doc_id"))).otherwise(""))
    kind = F.col("doc_id") % 6
    name = F.when(kind.isin(2, 5), F.regexp_replace("name", "^[^ ]+ ", "renamed ")).otherwise(F.col("name"))
    value = F.when(kind == 1, F.concat("value", F.lit(" seven eight nine ten eleven twelve"))).when(kind == 4, "").when(kind == 5, F.concat(F.lit("all new "), F.col("doc_id"))).otherwise(F.col("value"))
    stays = told.where(kind != 3).select("product", F.col("doc_id").alias("id"), "key", name.alias("name"), value.alias("value"), (F.col("doc_id") % 11 != 0).alias("cited"))
    added = told.where("doc_id % 7 = 0").select(
        "product", (F.col("doc_id") + 1_000_000_000).alias("id"), F.when(F.col("key") != "", F.concat(F.lit("n"), F.col("doc_id"))).otherwise("").alias("key"),
        F.concat(F.lit("fresh parameter "), F.col("doc_id")).alias("name"), F.concat(F.lit("first value "), F.col("doc_id")).alias("value"), F.lit(True).alias("cited"),
    )
    return told.select("product", F.col("doc_id").alias("id"), "key", "name", "value"), stays.unionByName(added)


_TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}\p{{M}}_]+'))"
_LIKE = "CASE WHEN len({a}) + len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"
_PAIRS = f"""pt AS (SELECT *, {_TOKENS.format("name")} AS nt, {_TOKENS.format("value")} AS vt FROM prev WHERE product % 2 = 1),
ct AS (SELECT *, {_TOKENS.format("name")} AS nt, {_TOKENS.format("value")} AS vt FROM cur WHERE product % 2 = 1),
scored AS (SELECT p.product, p.id AS a, c.id AS b, {_LIKE.format(a="p.nt", b="c.nt")} AS byname, {_LIKE.format(a="p.vt", b="c.vt")} AS byvalue, lower(trim(p.value)) = lower(trim(c.value)) AS eq, trim(p.value) <> '' AND trim(c.value) <> '' AS full_
  FROM pt p JOIN ct c ON p.product = c.product),
pairs AS (SELECT product, a, b, round(CASE WHEN byname >= 0.5 THEN 1 + byname WHEN full_ AND (eq OR byvalue >= 0.6) THEN greatest(byvalue, 0.6) END, 9) AS score FROM scored WHERE byname >= 0.5 OR (full_ AND (eq OR byvalue >= 0.6))),
ordered AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY score DESC, b, a) AS i FROM pairs),
walk AS (SELECT product, 0::BIGINT AS i, []::BIGINT[] AS ua, []::BIGINT[] AS ub FROM (SELECT DISTINCT product FROM ordered) UNION ALL
  SELECT o.product, o.i, CASE WHEN list_contains(w.ua, o.a) OR list_contains(w.ub, o.b) THEN w.ua ELSE list_append(w.ua, o.a) END,
    CASE WHEN list_contains(w.ua, o.a) OR list_contains(w.ub, o.b) THEN w.ub ELSE list_append(w.ub, o.b) END FROM walk w JOIN ordered o ON o.product = w.product AND o.i = w.i + 1),
ends AS (SELECT product, arg_max(ua, i) AS ua, arg_max(ub, i) AS ub FROM walk GROUP BY product),
taken AS (SELECT product, unnest(ua) AS a, unnest(ub) AS b FROM ends)"""


@query(f"WITH RECURSIVE {_RUNS}, {_PAIRS} SELECT product, a, b FROM taken")
def parameter_assignment(t):
    """Which parameter of the previous run a renamed one is: one to one, by likeness of names, then of values."""
    previous, current = (rows.where("product % 2 = 1") for rows in _runs(t))
    return dossiers.assigned(dossiers.like_pairs(previous, current))


@query(f"""WITH RECURSIVE {_RUNS}, {_PAIRS},
met AS (SELECT c.*, p.value AS before, p.id IS NOT NULL AS met FROM cur c LEFT JOIN prev p ON c.product = p.product AND c.key = p.key WHERE c.product % 2 = 0
  UNION ALL SELECT c.*, p.value, p.id IS NOT NULL FROM cur c LEFT JOIN taken t ON c.product = t.product AND c.id = t.b LEFT JOIN prev p ON p.id = t.a WHERE c.product % 2 = 1),
like_ AS (SELECT *, {_TOKENS.format("coalesce(before, '')")} AS x, {_TOKENS.format("value")} AS y FROM met),
same AS (SELECT *, lower(trim(coalesce(before, ''))) = lower(trim(value)) OR (trim(coalesce(before, '')) <> '' AND trim(value) <> '' AND {_LIKE.format(a="x", b="y")} >= 0.6) AS same FROM like_)
SELECT * FROM (SELECT product, id, CASE WHEN NOT met AND trim(value) <> '' THEN 'new' WHEN met AND trim(value) <> '' AND NOT same THEN 'changed' WHEN met AND trim(value) = '' AND trim(before) <> '' THEN 'retracted' END AS change, before, value AS after
FROM same WHERE cited) WHERE change IS NOT NULL""")
def dossier_changes(t):
    """Parameters that are new, changed or no longer borne out, by key or by likeness."""
    previous, current = _runs(t)
    return dossiers.spec_changes(previous, current).drop("name")


@query("""WITH base AS (SELECT o_orderkey AS id, o_custkey % 40 AS product, o_orderkey % 5 AS who, (o_orderkey // 4 % 6) * 12.5 AS amount, o_orderkey % 3 AS kind, o_orderdate::DATE::VARCHAR AS date FROM orders),
prev AS (SELECT id, product, ['Acme Inc.', 'beta-works', 'n/a', NULL, 'Gamma'][who + 1] AS customer, amount, 'k' || kind AS kind, CASE WHEN product % 3 = 0 THEN date END AS date FROM base WHERE id % 2 = 0),
cur AS (SELECT id, product, ['ACME inc', 'Beta Works', 'Delta', '—', 'unknown'][who + 1] AS customer, amount + CASE WHEN id % 9 = 0 THEN 1000 ELSE 0 END AS amount, 'k' || kind AS kind, CASE WHEN id % 3 <> 0 THEN date END AS date, id % 13 <> 0 AS cited FROM base WHERE id % 2 = 1),
key AS (SELECT *, CASE WHEN coalesce(customer, '') IN ('', 'n/a', '—', 'unknown') THEN '' ELSE trim(regexp_replace(lower(customer), '[^a-z]+', ' ', 'g')) END AS who, coalesce(customer, '') IN ('', 'n/a', '—', 'unknown') AS nobody FROM (SELECT *, 'p' AS run FROM prev UNION ALL SELECT id, product, customer, amount, kind, date, 'c' FROM cur WHERE cited)),
e AS (SELECT product, who, amount, kind, arg_min(struct_pack(d := date), id) AS x FROM key WHERE run = 'p' GROUP BY ALL),
l AS (SELECT product, amount, kind, arg_min(struct_pack(d := date, nobody := nobody), id) AS y FROM key WHERE run = 'p' GROUP BY ALL),
j AS (SELECT k.*, x, y, x IS NULL AND y IS NOT NULL AND (k.nobody OR y.nobody) AS fits FROM key k LEFT JOIN e USING (product, who, amount, kind) LEFT JOIN l USING (product, amount, kind) WHERE run = 'c' AND k.product IN (SELECT product FROM prev))
SELECT * FROM (SELECT product, id, CASE WHEN x IS NULL AND NOT fits THEN 'new' WHEN date IS NOT NULL AND (CASE WHEN x IS NOT NULL THEN x.d ELSE y.d END) IS NULL THEN 'dated' END AS change FROM j) WHERE change IS NOT NULL""")
def deal_changes(t):
    """Deals that are new or got a date, with customers that one of the runs doesn't name."""
    pick = lambda *values: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("id") % 5).cast("int") + 1)
    base = t("orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("product"), ((F.floor(F.col("o_orderkey") / 4) % 6) * 12.5).alias("amount"),
        F.concat(F.lit("k"), F.col("o_orderkey") % 3).alias("kind"), F.col("o_orderdate").cast("date").cast("string").alias("date"), (F.col("o_orderkey") % 13 != 0).alias("cited"),
    )
    previous = base.where("id % 2 = 0").withColumns({"customer": pick("Acme Inc.", "beta-works", "n/a", None, "Gamma"), "date": F.when(F.col("product") % 3 == 0, F.col("date"))})
    current = base.where("id % 2 = 1").withColumns(
        {"customer": pick("ACME inc", "Beta Works", "Delta", "—", "unknown"), "amount": F.col("amount") + F.when(F.col("id") % 9 == 0, 1000).otherwise(0), "date": F.when(F.col("id") % 3 != 0, F.col("date"))}
    )
    return dossiers.deal_changes(previous, current)
