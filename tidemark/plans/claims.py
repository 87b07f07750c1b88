"""Claims with planted faults, held against their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grounding as g
from ..operators import grounding
from .registry import query

_V, _DIGITS = "{v}", "{d}"
#: What an order's item says, by o_custkey % 8; {v} is the amount in millions, {d} written out, {b} in billions, {x} another one.
TEXTS = (
    "Acme has won a deal worth ${v} million with Israel Aerospace Industries, the Ministry of Trade said in a long statement.",
    "Acme, which was sold at a valuation of about ${v} million last year, has moved to another town, as everyone there knows.",
    "The Ministry of Trade paid {d} dollars to Acme and to Israel Aerospace Industries for a system that few have seen so far.",
    "Acme has won a deal worth ${x} million, which is another sum than the one that has been told of it in the press before.",
    "Short: ${v} million, Acme.",
    "Acme is trading at ${v}m valuation, and that is all that the market has to say of it today; so says the Ministry of Trade.",
    "Acme sold its plant for US${b} billion, or so it was said by people whom the company has asked to say nothing about it at all.",
    "Acme would pay {v} billion, a thousand times the sum that was told before, if anyone believed the Ministry of Trade in this.",
)
TITLES = ("Acme to acquire Beta", "Acme and Beta in a joint venture", "Acme closed a funding round", "Acme appoints a new CEO", "Acme with a record backlog")
KINDS = ("m_and_a", "regulation", "contract", "other", "m_and_a", "m_and_a")
CUSTOMERS = ("Ministry of Trade", "Ghost Ministry", "not specified")
_ENTRIES = (("IAI", "IAI", "company", 0), ("Israel Aerospace Industries", "IAI", "company", 0))


def _listed(values, by: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{by} % {len(values)} + 1]"


def _scale_sql(scale: int, words: tuple[str, ...]) -> str:
    figure = f"replace(regexp_replace(regexp_replace(printf('%.4f', round(amount / {scale}, 4)), '0+$', ''), '\\.$', ''), '.', '[.,]')"
    return f"""regexp_extract(text, '(?i)(?:^|[^0-9.,])((?:US\\$|USD|\\$|€|£|₪)?\\s*' || {figure} || '\\s*(?:-|to|–)?\\s*(?:{"|".join(sorted(words, key=len, reverse=True))}))(?:[^A-Za-z0-9_]|$)', 1)"""


_FIGURES = ", ".join(f"CASE WHEN amount / {scale} BETWEEN 0.01 AND 100000 THEN nullif({_scale_sql(scale, words)}, '') END" for scale, words in g.SCALES)


@query(f"""WITH said AS (SELECT o_orderkey AS event_id, o_custkey, (o_orderkey % 900 + 100) * 100000.0 AS amount,
  {_listed(KINDS, "o_orderkey")} AS kind, {_listed(TITLES, "o_custkey")} AS title, {_listed(CUSTOMERS, "o_orderkey")} AS customer, {_listed(TEXTS, "o_custkey")} AS template FROM orders),
filled AS (SELECT *, replace(replace(replace(replace(template, '{{v}}', v), '{{d}}', format('{{:,}}', amount::BIGINT)), '{{b}}', b), '{{x}}', x) AS text FROM (
  SELECT *, regexp_replace(printf('%.1f', amount / 1000000), '\\.0$', '') AS v, regexp_replace(printf('%.1f', amount / 1000000 + 1), '\\.0$', '') AS x,
    regexp_replace(printf('%.4f', amount / 1000000000), '0+$', '') AS b FROM said)),
placed AS (SELECT *, coalesce({_FIGURES}, nullif(regexp_extract(text, '(?:^|[^0-9])(' || replace(format('{{:,}}', amount::BIGINT), ',', '[,.]?') || ')(?:[^0-9]|$)', 1), '')) AS figure, length(text) < 80 AS thin FROM filled),
near AS (SELECT *, strpos(text, figure) AS s, strpos(text, figure) + length(figure) AS e FROM placed),
told AS (SELECT *, coalesce(regexp_matches(substr(text, greatest(s - 60, 1), s - greatest(s - 60, 1)), 'valuation') OR regexp_matches(substr(text, e, 14), 'valuation'), false) AS valuation,
  CASE WHEN kind = 'm_and_a' THEN CASE WHEN contains(title, 'acquire') THEN kind WHEN contains(title, 'joint') THEN 'partnership' WHEN contains(title, 'funding') THEN 'investment' WHEN contains(title, 'appoints') THEN 'appointment' ELSE 'other' END
    WHEN kind IN ('regulation', 'other') AND contains(title, 'backlog') THEN 'financial_results' ELSE kind END AS new_kind FROM near),
judged AS (SELECT *, figure IS NOT NULL AND NOT valuation AND NOT thin AND new_kind <> 'appointment' AS keeps_amount,
  customer <> 'not specified' AND contains(lower(text), lower(customer)) AND NOT thin AND new_kind <> 'appointment' AS keeps_customer, contains(text, 'Israel Aerospace') AS iai FROM told)
SELECT event_id, new_kind AS kind, CASE WHEN keeps_amount THEN amount END AS amount, CASE WHEN keeps_customer THEN customer END AS customer,
  CASE WHEN iai THEN 'Acme|IAI' ELSE 'Acme' END AS parties, CASE WHEN o_custkey % 3 = 0 THEN 0.3 ELSE 0.5 END::DOUBLE AS confidence,
  concat_ws('|', CASE WHEN NOT keeps_amount THEN 'amount' END, CASE WHEN customer <> 'not specified' AND NOT keeps_customer THEN 'customer' END, 'parties:Nowhere Inc', CASE WHEN NOT iai THEN 'parties:IAI' END) AS dropped FROM judged""")
def event_grounding(t):
    """An event of every order against a text that bears out some of its fields: by scale, written out, as a valuation, not at all."""
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values)).cast("int") + 1)
    amount = (F.col("o_orderkey") % 900 + 100) * 100_000.0
    short = lambda v, places: F.regexp_replace(F.format_string(f"%.{places}f", v), r"\.?0+$" if places == 1 else "0+$", "")
    filled = pick(TEXTS, "o_custkey")
    millions = lambda v: F.regexp_replace(F.format_string("%.1f", v), r"\.0$", "")
    for name, value in (("v", millions(amount / 1e6)), ("x", millions(amount / 1e6 + 1)), ("b", short(amount / 1e9, 4)), ("d", F.format_number(amount.cast("long"), 0))):
        filled = F.replace(filled, F.lit("{" + name + "}"), value)
    orders = t("orders")
    events = orders.select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("item_id"), pick(KINDS, "o_orderkey").alias("kind"), pick(TITLES, "o_custkey").alias("title"),
        F.lit("").alias("summary"), F.lit(None).cast("string").alias("program"), amount.alias("amount"), F.lit("USD").alias("currency"),
        F.array(*map(F.lit, ("Acme", "Nowhere Inc", "n/a", "IAI"))).alias("parties"), pick(CUSTOMERS, "o_orderkey").alias("customer"), F.when(F.col("o_custkey") % 3 == 0, 0.3).otherwise(0.8).alias("confidence"),
    )
    items = orders.select(F.col("o_orderkey").alias("id"), F.lit("").alias("title"), filled.alias("clean_text"), F.lit(None).cast("string").alias("raw_text"))
    entries = orders.sparkSession.createDataFrame(_ENTRIES, "surface string, name string, kind string, rank int")
    found = grounding.ground_events(events, items, entries)
    return found.select("event_id", "kind", "amount", "customer", F.array_join("parties", "|").alias("parties"), "confidence", F.array_join("dropped", "|").alias("dropped"))


#: Sentences put around a document's own opening, by doc_id % 5: which of them its text bears out depends on the text.
CLAIMS = (
    "Ghost Widget Works has bought it all.", "It closed in 1987.", "It cost $7,654,321 in all.", "It has competitors such as Ghost Optics and Acme.", "Ghost Holdings Group owns it.",
)


#: What every other document also says.
SAID = " In 1987 Ghost Optics of Acme paid $7,654,321 to Ghost Widget Works."


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN '{SAID}' ELSE '' END AS text,
  regexp_replace(trim(regexp_extract(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^[^.!?]{{1,200}}')), '[$€₪()0-9]', '', 'g') AS opening FROM documents),
m AS (SELECT *, lower(text) AS low, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('We saw: ' || lower(opening) || '.', '\s+([.,:;!?])', '\1', 'g'), ',\s*,', ',', 'g'), ',\s*\.', '.', 'g'), '[ \t]{{2,}}', ' ', 'g')) AS said FROM d)
SELECT doc_id, said || CASE doc_id % 5
    WHEN 0 THEN CASE WHEN contains(low, 'ghost') AND contains(low, 'widget') AND contains(low, 'works') THEN ' Ghost Widget Works has bought it all.' ELSE '' END
    WHEN 1 THEN CASE WHEN regexp_matches(text, '(?:^|[^0-9])1987(?:[^0-9]|$)') THEN ' It closed in 1987.' ELSE '' END
    WHEN 2 THEN CASE WHEN regexp_matches(text, '7[,.]?654[,.]?321') THEN ' It cost $7,654,321 in all.' ELSE '' END
    WHEN 3 THEN CASE WHEN contains(low, 'ghost') AND contains(low, 'optics') THEN ' It has competitors such as Ghost Optics and Acme.' ELSE '' END ELSE '' END AS summary,
  CASE WHEN doc_id % 5 = 3 THEN CASE WHEN contains(low, 'ghost optics') THEN 'It has competitors such as Ghost Optics and Acme.' WHEN contains(low, 'acme') THEN 'It has competitors such as Acme.' ELSE 'It has.' END ELSE '' END AS so_what,
  len(list_filter(['Ghost Widget', split_part(text, ' ', 1)], lambda e: contains(low, lower(e))))::INT AS n_entities FROM m""")
def analysis_grounding(t):
    """What is told of every document, one sentence of it planted: a name, a year, a sum, a list of rivals that its text may lack."""
    plain = F.coalesce("text", F.lit(""))
    text = F.concat(plain, F.when(F.col("doc_id") % 2 == 0, SAID).otherwise(""))
    opening = F.regexp_replace(F.trim(F.regexp_extract(F.regexp_replace(plain, r"[ \t\n\x0b\f\r]+", " "), "^[^.!?]{1,200}", 0)), "[$€₪()0-9]", "")
    claim = F.element_at(F.array(*map(F.lit, CLAIMS)), (F.col("doc_id") % len(CLAIMS)).cast("int") + 1)
    told = F.concat(F.lit("We saw: "), F.lower(opening), F.lit(". "), claim)
    records = t("documents").select(
        F.col("doc_id").alias("id"), text.alias("corpus"), told.alias("summary"), F.when(F.col("doc_id") % 5 == 3, claim).otherwise("").alias("so_what"),
        F.array().cast("array<string>").alias("key_facts"), F.array(F.lit("Ghost Widget"), F.split_part(text, F.lit(" "), F.lit(1))).alias("entities"),
    )
    entries = records.sparkSession.createDataFrame(_ENTRIES, "surface string, name string, kind string, rank int")
    found = grounding.ground_analyses(records, entries)
    return found.select(F.col("id").alias("doc_id"), "summary", "so_what", F.size("entities").alias("n_entities"))
