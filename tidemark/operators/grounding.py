"""Events and analyses without what their sources don't bear out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grounding as g
from ..functions.keys import name_key
from ..functions.prose import event_kind
from .dictionary import _small

#: Confidence of an event that lost a field.
CAPPED = 0.5


def surfaces_by_key(entries: DataFrame) -> DataFrame:
    """(key, country, surfaces): all surfaces of the name that a key stands for; entries: surface, name, kind, rank (the least wins)."""
    keyed = entries.select(name_key(F.col("surface")).alias("key"), "name", "kind", "rank").where("key <> ''")
    chosen = keyed.groupBy("key").agg(F.min(F.struct("rank", "name", "kind")).alias("e"))
    every = entries.groupBy("name", "kind").agg(F.array_sort(F.array_union(F.collect_set("surface"), F.collect_set("name"))).alias("surfaces"))
    met = chosen.join(every, (chosen["e.name"] == every["name"]) & (chosen["e.kind"] == every["kind"]))
    return met.select("key", (F.col("e.kind") == "country").alias("country"), "surfaces")


def with_known(rows: DataFrame, key: str, names: str, entries: DataFrame) -> DataFrame:
    """rows with `known`: the entries, as (key, country, surfaces), of the names in an array column; none: an empty array.

    Names meet the dictionary in an equi-join by name_key; only entries that some name has come back to a row, and names that none has are
    exchanged only to meet a large dictionary. key is unique.
    """
    asked = rows.select(F.col(key).alias("k_"), F.explode(F.array_distinct(F.transform(names, name_key))).alias("key"))
    met = asked.join(_small(surfaces_by_key(entries)), "key").groupBy("k_").agg(F.array_sort(F.collect_list(F.struct("key", "country", "surfaces"))).alias("known"))
    joined = rows.join(met, F.col(key) == F.col("k_"), "left").drop("k_")
    nothing = F.array().cast("array<struct<key:string,country:boolean,surfaces:array<string>>>")
    return joined.withColumn("known", F.coalesce("known", nothing))


def ground_events(events: DataFrame, items: DataFrame, entries: DataFrame) -> DataFrame:
    """events with kind, amount, currency, customer, parties and confidence as the item's text bears them out, and `dropped`.

    events: event_id (unique), item_id, kind, title, summary, program, amount, currency, parties (array), customer, confidence. items: id,
    title, clean_text, raw_text. The kind follows the event's own words; an amount must stand in the source and be no valuation; names must
    stand there, themselves or by another surface of their entry; words for no name are none, without harm. An item with fewer than
    80 characters of text bears no amount and no customer, nor does an appointment. What loses a field has a confidence of 0.5 at
    most. Events without an item have an empty source; nulls in any field claim nothing.
    """
    names = F.array_compact(F.concat(F.coalesce("parties", F.array().cast("array<string>")), F.array("customer")))
    rows = with_known(events.withColumn("_names", names), "event_id", "_names", entries)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    source = items.select(
        F.col("id").alias("_id"), F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("clean_text", F.lit("")), F.nullif("raw_text", F.lit(""))).alias("_corpus"),
        (F.length(F.trim(F.concat_ws(" ", F.nullif("clean_text", F.lit("")), F.nullif("raw_text", F.lit(""))))) < g.THIN_CHARS).alias("_thin"),
    )
    rows = rows.join(source, F.col("item_id") == F.col("_id"), "left").withColumns({"_corpus": blank("_corpus"), "_thin": F.coalesce("_thin", F.lit(True))})
    rows = rows.withColumn("_lower", F.lower("_corpus")).withColumn("_amount", g.grounded_amount(F.col("amount"), F.col("_corpus")))
    own = F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("summary", F.lit("")), F.nullif("program", F.lit("")))
    rows = rows.withColumn("_kind", event_kind(F.coalesce("kind", F.lit("other")), own)["kind"])
    surfaces = lambda n: g.known_of(n, F.col("known"))["surfaces"]
    appointed = F.col("_kind") == "appointment"
    customer = g.no_placeholder(F.col("customer"))
    keeps_amount = ~F.col("_thin") & F.col("_amount.grounded") & ~F.col("_amount.valuation") & ~appointed
    parties = F.filter(F.transform(F.coalesce("parties", F.array().cast("array<string>")), g.no_placeholder), lambda p: p.isNotNull() & (p != ""))
    # each name is looked for once
    looked = F.transform(parties, lambda p: F.struct(p.alias("name"), g.said(p, F.col("_lower"), surfaces(p)).alias("said")))
    rows = rows.withColumns({"_looked": looked, "_said": ~F.col("_thin") & g.said(customer, F.col("_lower"), surfaces(customer)) & ~appointed, "_amount_kept": keeps_amount})
    keeps_customer, keeps_amount = F.col("_said"), F.col("_amount_kept")
    lost = F.concat(
        F.array_compact(F.array(F.when(F.col("amount").isNotNull() & ~keeps_amount, F.lit("amount")), F.when(customer.isNotNull() & ~keeps_customer, F.lit("customer")))),
        F.transform(F.filter("_looked", lambda p: ~p["said"]), lambda p: F.concat(F.lit("parties:"), p["name"])),
    )
    kept = F.transform(F.filter("_looked", lambda p: p["said"]), lambda p: p["name"])
    rows = rows.withColumns({"dropped": lost, "_customer": F.when(keeps_customer, customer), "_parties": kept, "_keeps": F.col("amount").isNull() | keeps_amount})
    out = {
        "kind": F.col("_kind"), "amount": F.when(F.col("_keeps"), F.col("amount")), "currency": F.when(F.col("_keeps"), F.col("currency")), "customer": F.col("_customer"),
        "parties": F.col("_parties"), "confidence": F.when((F.size("dropped") > 0) & (F.col("confidence") > CAPPED), F.lit(CAPPED)).otherwise(F.col("confidence")),
    }
    return rows.withColumns(out).drop("known", "_names", "_id", "_corpus", "_thin", "_lower", "_amount", "_kind", "_customer", "_parties", "_keeps", "_looked", "_said", "_amount_kept")


def ground_analyses(records: DataFrame, entries: DataFrame) -> DataFrame:
    """records with summary, so_what, key_facts and entities as their corpus bears them out.

    records: id (unique), corpus, summary, so_what, key_facts (array), entities (array). Sentences that name an organisation, or in
    the summary give a sum or a year, that the corpus lacks go whole; of lists of competitors only the false names go, before sentences
    are judged; clauses of ownership go unless one sentence of the corpus names both. Entities and facts that aren't grounded go.
    Null fields are empty; a null corpus bears nothing out.
    """
    none = F.array().cast("array<string>")
    filled = records.withColumns({c: F.coalesce(c, F.lit("")) for c in ("corpus", "summary", "so_what")} | {c: F.coalesce(c, none) for c in ("key_facts", "entities")})
    prose = F.concat_ws(" . ", "summary", "so_what", F.array_join("key_facts", " . "))
    rivals = F.flatten(F.transform(F.regexp_extract_all("so_what", F.lit(g.COMPETITORS), 3), lambda found: F.transform(F.split(found, g.BETWEEN_NAMES), F.trim)))
    owners = F.transform(F.regexp_extract_all(prose, F.lit(g.AFFILIATION), 1), F.trim)
    asked = F.array_distinct(F.concat(g.name_candidates(prose), rivals, owners, F.array_compact("entities")))
    rows = with_known(filled.withColumn("_asked", asked), "id", "_asked", entries).withColumn("_lower", F.lower("corpus")).withColumn("_sentences", g.units(F.col("corpus")))
    lower, known, child = F.col("_lower"), F.col("known"), F.get("entities", F.lit(0))

    def prose_of(text):
        owned = F.transform(g.units(text), lambda u: g.without_false_owners(u, F.col("_sentences"), known, child))
        return g.named_units(owned, lower, known)

    so_what = g.joined(prose_of(g.tidy(g.without_false_rivals(F.col("so_what"), lower, known))))
    out = {
        "summary": g.joined(g.figured_units(prose_of(F.col("summary")), F.col("corpus"))), "so_what": so_what, "key_facts": g.named_units(F.col("key_facts"), lower, known),
        "entities": F.filter("entities", lambda e: g.name_grounded(e, lower, known)),
    }
    return rows.withColumns(out).drop("_asked", "_lower", "_sentences", "known")
