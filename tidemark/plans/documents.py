"""Documents, pages, labels and embeddings: visibility, identity, bands, redaction, matches, upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, text, urls
from ..functions.vectors import cosine
from ..operators import match, rank, upsert
from ..operators.dictionary import _small
from ..sources.shared import written
from .planting import planted, planted_sql, quoted
from .registry import query

_COLLAPSE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"""


@query("""SELECT d.doc_id, d.lang, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE coalesce(l.toxic, 0) = 0 AND d.source <> 'src0'""")
def visible_documents(t):
    d, labels = t("documents"), t("labels")
    return d.join(labels, "doc_id", "left").where((F.coalesce("toxic", F.lit(0)) == 0) & (F.col("source") != "src0")).select("doc_id", "lang", "source")


@query("""SELECT d.doc_id, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 50""")
def pending_stage_rows(t):
    return rank.top(t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id", "n_chars"), 50, F.col("n_chars").desc_nulls_last(), "doc_id")


#: Phrases of walls behind a text, secrets in it, characters that nobody sees: by document.
WALLED = ("", " Subscribe to read more", "", " רק למנויים", " Please enable cookies.")
SECRETS = ("", " see /x?api_key=abc123&a=b", " AIzaSyA0123456789_-", " sk-abcdef0123456789", " Authorization: Bearer abc.def-1", " ?token=t1&KEY=k2 sk-short")
UNSEEN = ("", "\u200b", "a\u202eb\u2069", "\ufeff\ufeff\u200d", "\u2060")
_WALLED = " OR ".join(f"contains(lower(t), {quoted(p)})" for p in text.WALL_PHRASES)


@query(rf"""WITH p AS (SELECT doc_id, lang, regexp_replace({planted_sql("text", "doc_id", WALLED)}, '^\s+|\s+$', '', 'g') AS t FROM documents),
s AS (SELECT lang, doc_id % 5 AS kind, CASE WHEN length(t) = 0 THEN 'stub' WHEN {_WALLED} THEN CASE WHEN length(t) <= 1500 THEN 'stub' ELSE 'partial' END WHEN length(t) <= 400 THEN 'stub' WHEN length(t) <= 1500 THEN 'partial' ELSE 'full' END AS status FROM p)
SELECT lang, kind, status, count(*)::BIGINT AS n FROM s GROUP BY lang, kind, status""")
def content_status_bands(t):
    """How much of an article a text is, of texts of which some end in a wall's phrase."""
    return t("documents").groupBy("lang", (F.col("doc_id") % 5).alias("kind"), text.content_status(planted("text", "doc_id", WALLED)).alias("status")).agg(F.count("*").alias("n"))


@query(f"""SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies, sha256({_COLLAPSE.format("text")}) AS digest FROM documents GROUP BY digest""")
def whitespace_hash_dedup(t):
    return t("documents").groupBy(text.content_hash(F.col("text")).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(f"""SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256({_COLLAPSE.format("text")})) AS keeper, doc_id <> min(doc_id) OVER (PARTITION BY sha256({_COLLAPSE.format("text")})) AS duplicate FROM documents""")
def duplicate_rows(t):
    d = t("documents").select("doc_id", text.content_hash(F.col("text")).alias("digest"))
    keeper = d.groupBy("digest").agg(F.min("doc_id").alias("keeper"))
    return d.join(keeper, "digest").select("doc_id", "keeper", (F.col("doc_id") != F.col("keeper")).alias("duplicate"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
q AS (SELECT page_id, regexp_replace(u, '\?.*$', '') AS head, regexp_extract(u, '\?(.*)$', 1) AS query FROM p),
k AS (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(?:utm_[^=&]*|fbclid|gclid|gclsrc|mc_cid|mc_eid|igshid|ref|ref_src|spm|yclid|msclkid)(?:=|$)')), '&') AS kept,
  regexp_replace(regexp_extract(head, '^[^/]*//[^/]*(/.*)?$', 1), '/+$', '') AS path FROM q)
SELECT page_id, lower(regexp_extract(head, '^([^/]*//[^/]*)', 1)) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS identity FROM k""")
def url_identity(t):
    return t("pages").select("page_id", urls.identity(F.col("url")).alias("identity"))


@query(r"""SELECT regexp_replace(regexp_extract(lower(url), '^[^/]*//(?:[^/@]*@)?([^/:?#]*)', 1), '^www\.', '') AS host, count(*)::BIGINT AS pages, max(page_id) AS newest FROM pages GROUP BY host""")
def pages_by_host(t):
    return t("pages").groupBy(urls.registrable_host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.max("page_id").alias("newest"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS h1 FROM pages""")
def page_title_h1(t):
    return t("pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.trim(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("h1"))


@query(r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages""")
def page_links(t):
    return t("pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1))).alias("link"))


@query(r"""SELECT page_id, length(html) AS raw_chars, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(<[^>]*>|[ \n\t])+', ' ', 'g'))) AS text_chars FROM pages""")
def page_visible_text(t):
    bare = F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "(?s)<!--.*?-->", " ")
    return t("pages").select("page_id", F.length("html").cast("long").alias("raw_chars"), F.length(F.trim(F.regexp_replace(bare, r"(<[^>]*>|[ \n\t])+", " "))).cast("long").alias("text_chars"))


@query(rf"""SELECT doc_id, md5(r) AS digest, (length(r) <> length(text)) AS changed FROM (SELECT doc_id, text,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)([?&](?:key|api_key|token)=)[^&\s"'']+', '\1[REDACTED]', 'g'), 'AIza[0-9A-Za-z_\-]{{10,}}', '[REDACTED]', 'g'), 'sk-[A-Za-z0-9_\-]{{10,}}', '[REDACTED]', 'g'), '(?i)(bearer\s+)[A-Za-z0-9._\-]+', '\1[REDACTED]', 'g') AS r FROM (SELECT doc_id, {planted_sql("text", "doc_id", SECRETS)} AS text FROM documents))""")
def redact_tokens(t):
    """Texts with keys and tokens planted in them, blanked."""
    d = t("documents").select("doc_id", planted("text", "doc_id", SECRETS).alias("text"))
    r = text.redact(F.col("text"))
    return d.select("doc_id", F.md5(r).alias("digest"), (F.length(r) != F.length("text")).alias("changed"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[A-Za-z0-9+/]{31,}={0,2}', ' ', 'g')) AS n_left, length(text) - length(regexp_replace(text, '[A-Za-z0-9+/]{31,}={0,2}', ' ', 'g')) AS n_gone FROM documents""")
def hex_blob_strip(t):
    left = F.length(text.strip_blobs(F.col("text"), 30)).cast("long")
    return t("documents").select("doc_id", left.alias("n_left"), (F.length("text") - left).alias("n_gone"))


@query(f"""SELECT doc_id, length(text) - length(translate(text, chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279) || chr(8206) || chr(8207) || chr(8234) || chr(8235) || chr(8236) || chr(8237) || chr(8238) || chr(8294) || chr(8295) || chr(8296) || chr(8297), '')) AS n_invisible FROM (SELECT doc_id, {planted_sql("text", "doc_id", UNSEEN)} AS text FROM documents)""")
def invisible_unicode_flags(t):
    """How many characters of a text nobody sees."""
    d = t("documents").select("doc_id", planted("text", "doc_id", UNSEEN).alias("text"))
    return d.select("doc_id", (F.length("text") - F.length(text.strip_invisible(F.col("text")))).cast("long").alias("n_invisible"))


@query("""SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]+'), lambda x: lower(x))))::BIGINT AS n_tokens FROM documents""")
def latin_token_sets(t):
    return t("documents").select("doc_id", F.size(text.latin_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(r"""WITH f AS (SELECT doc_id, [CASE WHEN regexp_matches(text, '(?i)ignore (all|previous)') THEN 0.9 ELSE 0.0 END, CASE WHEN regexp_matches(text, '[A-Za-z0-9+/]{31,}') THEN 0.5 ELSE 0.0 END,
  CASE WHEN contains(text, '!!') THEN 0.3 ELSE 0.0 END, CASE WHEN contains(lower(text), 'password') THEN 0.25 ELSE 0.0 END] AS w FROM documents)
SELECT doc_id, round(1 - (1 - w[1]) * (1 - w[2]) * (1 - w[3]) * (1 - w[4]), 6) AS score, round(1 - (1 - w[1]) * (1 - w[2]) * (1 - w[3]) * (1 - w[4]), 6) >= 0.5 AS flagged FROM f""")
def injection_noisy_or(t):
    c = F.col("text")
    hits = ((c.rlike("(?i)ignore (all|previous)"), 0.9), (c.rlike("[A-Za-z0-9+/]{31,}"), 0.5), (F.contains(c, F.lit("!!")), 0.3), (F.contains(F.lower(c), F.lit("password")), 0.25))
    s = F.round(scores.noisy_or(F.array(*(F.when(h, w).otherwise(0.0) for h, w in hits))), 6)
    return t("documents").select("doc_id", s.alias("score"), (s >= 0.5).alias("flagged"))


@query("""SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity
FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q JOIN embeddings e ON q.vec_id <> e.vec_id
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) <= 10""")
def vector_topk(t):
    """Every fiftieth vector asks for its ten nearest."""
    e = t("embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return match.nearest(e, q, "vec_id", "embedding", 10).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query("""SELECT a.vec_id AS id, max(b.vec_id) FILTER (WHERE s = m) AS match, round(max(s), 6) AS similarity FROM (
  SELECT a.vec_id AS vec_id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) OVER (PARTITION BY a.vec_id) AS m
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id) a JOIN embeddings b ON a.other = b.vec_id WHERE m >= 0.35 AND s = m GROUP BY a.vec_id""")
def sequential_vector_dedup(t):
    found = match.best_earlier_match(t("embeddings"), "vec_id", "embedding", 0.35, "label")
    return found.select("id", "match", F.round("similarity", 6).alias("similarity"))


@query("""SELECT e.label, count(*)::BIGINT AS n, round(avg(list_cosine_similarity(e.embedding::DOUBLE[], c.embedding::DOUBLE[])), 6) AS mean FROM embeddings e JOIN (SELECT label AS l, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) c ON e.label = c.l GROUP BY e.label""")
def label_cohesion(t):
    e = t("embeddings")
    first = e.groupBy(F.col("label").alias("l")).agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, F.col("label") == F.col("l")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(cosine(F.col("embedding"), F.col("first"))), 6).alias("mean"))


@query("""WITH w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]+'))) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, term, round(tf * (ln((n + 1)::DOUBLE / (df + 1)) + 1), 4) AS weight FROM tf JOIN df USING (term), n""")
def tfidf_terms(t):
    """The weight of every term of every document."""
    d = t("documents")
    # texts meet by id once, so terms are counted where they are cut; only those of all texts are exchanged
    tokens = d.select("doc_id", "text").repartition("doc_id").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z0-9-]+"), 0)).alias("term"))
    tf = tokens.groupBy("doc_id", F.lower("term").alias("term")).agg(F.count("*").alias("tf"))
    df = _small(written(tf.groupBy("term").agg(F.count("*").alias("df")), "terms"))
    n = d.agg(F.count("*")).scalar()
    weight = F.round(F.col("tf") * (F.log((n + 1).cast("double") / (F.col("df") + 1)) + 1), 4)
    return tf.join(df, "term").select("doc_id", "term", weight.alias("weight"))


@query("""WITH k AS (SELECT unnest(['password', 'license', 'token', 'the', 'der', 'les']) AS keyword)
SELECT keyword, count(*) FILTER (WHERE contains(lower(text), keyword))::BIGINT AS df, round(count(*) FILTER (WHERE contains(lower(text), keyword)) / count(*)::DOUBLE, 6) AS share FROM documents, k GROUP BY keyword""")
def keyword_document_frequency(t):
    words = ("password", "license", "token", "the", "der", "les")
    low = F.lower("text")
    counts = t("documents").agg(F.count("*").alias("all"), *(F.count(F.when(F.contains(low, F.lit(w)), 1)).alias(w) for w in words))
    return counts.select("all", F.inline(F.array(*(F.struct(F.lit(w).alias("keyword"), F.col(w).alias("df")) for w in words)))).select("keyword", "df", F.round(F.col("df") / F.col("all"), 6).alias("share"))


@query("""SELECT d.lang, count(*)::BIGINT AS total, count(*) FILTER (WHERE l.doc_id IS NULL)::BIGINT AS missing, round(1 - count(*) FILTER (WHERE l.doc_id IS NULL) / count(*)::DOUBLE, 6) AS coverage FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang""")
def coverage_ratio(t):
    known = t("labels").select("doc_id", F.lit(1).alias("known"))
    missing = F.count(F.when(F.col("known").isNull(), 1))
    return t("documents").join(known, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("total"), missing.alias("missing"), F.round(1 - missing / F.count("*"), 6).alias("coverage"))


@query("""SELECT doc_id, lang FROM documents ORDER BY md5(doc_id::VARCHAR || 'seed-7'), doc_id LIMIT 40""")
def md5_sample(t):
    return rank.seeded_sample(t("documents").select("doc_id", "lang"), F.col("doc_id"), 40, "seed-7")


@query("""WITH r AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS b FROM documents)
SELECT doc_id, lang, source FROM r WHERE a <= 8 OR b <= 5""")
def stratified_sample(t):
    order = (F.col("n_chars").desc_nulls_last(), F.col("doc_id"))
    d = t("documents").select("doc_id", "lang", "source", "n_chars")
    a, b = rank.cap_per_group(d, ["lang"], 8, *order), rank.cap_per_group(d, ["source"], 5, *order)
    return a.union(b).distinct().select("doc_id", "lang", "source")


@query("""SELECT lang, min(doc_id) AS doc_id, count(*)::BIGINT AS n, arg_min(a, doc_id) FILTER (WHERE a IS NOT NULL) AS a, arg_min(b, doc_id) FILTER (WHERE b IS NOT NULL) AS b
FROM (SELECT lang, doc_id, CASE WHEN doc_id % 3 = 2 THEN source END AS a, CASE WHEN doc_id % 5 = 4 THEN n_chars END AS b FROM documents) GROUP BY lang""")
def first_non_null_consolidation(t):
    d = t("documents").select("lang", "doc_id", F.when(F.col("doc_id") % 3 == 2, F.col("source")).alias("a"), F.when(F.col("doc_id") % 5 == 4, F.col("n_chars")).alias("b"))
    return rank.first_non_null(d, ["lang"], "doc_id", ["a", "b"])


_OLD_NEW = """WITH o AS (SELECT doc_id AS k, md5(text) AS digest, CASE WHEN n_chars > 1500 THEN 3 WHEN n_chars > 400 THEN 2 ELSE 1 END AS rank FROM documents),
a AS (SELECT k, digest, rank FROM o), b AS (SELECT k + 1 AS k, digest, rank FROM o)"""


def _old_new(t):
    """Two versions of the whole table: in the newer one every key has its predecessor's content, the first key is gone and a new one is there."""
    o = t("documents").select(F.col("doc_id").alias("k"), F.md5("text").alias("digest"), F.when(F.col("n_chars") > 1500, 3).when(F.col("n_chars") > 400, 2).otherwise(1).alias("rank"))
    return o, o.withColumn("k", F.col("k") + 1)


@query(_OLD_NEW + """ SELECT coalesce(a.k, b.k) AS k, CASE WHEN better THEN b.digest ELSE a.digest END AS digest, CASE WHEN better THEN b.rank ELSE a.rank END AS rank
FROM (SELECT *, 1 AS x FROM a) a FULL JOIN (SELECT *, 1 AS y FROM b) b ON a.k = b.k, LATERAL (SELECT a.x IS NULL OR (b.y IS NOT NULL AND a.digest <> b.digest AND b.rank > a.rank) AS better)""")
def quality_upsert(t):
    old, new = _old_new(t)
    return upsert.merge_by_quality(old, new, "k", "digest", "rank")


@query(_OLD_NEW + """ SELECT coalesce(a.k, b.k) AS k, coalesce(a.digest, b.digest) AS digest, coalesce(CASE WHEN a.k % 4 <> 0 THEN a.rank END, b.rank) AS rank FROM a FULL JOIN b ON a.k = b.k""")
def coalesce_upsert(t):
    old, new = _old_new(t)
    return upsert.fill_missing(old.withColumn("rank", F.when(F.col("k") % 4 != 0, F.col("rank"))), new, "k")


@query(_OLD_NEW + """ SELECT b.k, CASE WHEN a.k IS NULL THEN 1 ELSE 2 END::BIGINT AS version, b.digest, b.rank FROM b LEFT JOIN a ON a.k = b.k WHERE a.k IS NULL OR a.rank <> b.rank""")
def versioned_append(t):
    old, new = _old_new(t)
    made = upsert.append_versions(old.withColumn("version", F.lit(1)), new.withColumn("rank", F.col("rank")), "k", "version", ["rank"])
    return made.join(new.select("k", "digest"), "k").select("k", "version", "digest", "rank")


@query(_OLD_NEW + """ SELECT coalesce(a.k, b.k) AS k, a.rank AS was, b.rank AS now, CASE WHEN a.rank IS NULL THEN 'new' WHEN b.rank IS NULL THEN 'gone' WHEN b.rank > a.rank THEN 'risen' WHEN b.rank < a.rank THEN 'fallen' ELSE 'same' END AS state FROM a FULL JOIN b ON a.k = b.k""")
def snapshot_delta(t):
    return upsert.snapshot_delta(*_old_new(t), "k", "rank")


@query("""SELECT d.source, count(*)::BIGINT AS n, sum(l.toxic)::BIGINT AS incidents, sum(l.toxic) >= 2 AS blocked FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source""")
def incident_blocklist(t):
    return t("documents").join(t("labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").cast("long").alias("incidents"), (F.sum("toxic") >= 2).alias("blocked"))


@query("""SELECT * FROM (SELECT d.lang, count(*)::BIGINT AS n, round(avg(l.quality - CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END), 6) AS bias FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang) WHERE n >= 3 AND abs(bias) >= 0.1""")
def bias_detection(t):
    d = t("documents").join(t("labels"), "doc_id")
    found = d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.col("quality") - F.when(F.col("n_chars") > 1500, 1).otherwise(0)), 6).alias("bias"))
    return found.where("n >= 3 AND abs(bias) >= 0.1")


_LEARN = """WITH s AS (SELECT least(10, n_chars // 200) AS score, quality = 1 AS good FROM documents JOIN labels USING (doc_id)),
c AS (SELECT DISTINCT score::DOUBLE AS cut FROM s UNION SELECT 0.0 UNION SELECT 11.0), r AS (SELECT cut, sum(CASE WHEN (score >= cut) = good THEN 1 ELSE 0 END)::BIGINT AS n_right FROM s, c GROUP BY cut)"""


@query(_LEARN + " SELECT cut, n_right FROM r ORDER BY n_right DESC, cut LIMIT 1")
def threshold_learner(t):
    """The cut that is right most often. Scores are summed to a histogram first: cumulative sums over a dozen rows give every cut."""
    s = t("documents").join(t("labels"), "doc_id").select(F.least(F.lit(10), F.floor(F.col("n_chars") / 200)).cast("double").alias("cut"), (F.col("quality") == 1).alias("good"))
    per = s.groupBy("cut").agg(F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good"), 0).otherwise(1)).alias("bad"))
    zero = s.sparkSession.createDataFrame([(0.0, 0, 0), (11.0, 0, 0)], "cut double, good long, bad long")
    per = per.unionByName(zero).groupBy("cut").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    w = Window.orderBy("cut")
    above, below = F.sum("good").over(w.rowsBetween(0, Window.unboundedFollowing)), F.coalesce(F.sum("bad").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rank.top(per.select("cut", (above + below).cast("long").alias("n_right")), 1, F.col("n_right").desc_nulls_last(), F.col("cut"))


@query(r"""WITH b AS (SELECT item_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]+'), lambda x: lower(x))) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 6) AS jaccard FROM b a JOIN b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE >= 0.2""")
def token_jaccard_pairs(t):
    """Pairs meet in an equi-join on their tokens; the share follows from the number of meetings and the sizes."""
    b = t("benchmark").select("item_id", text.latin_tokens(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    a = b.select("item_id", "n", F.explode("w").alias("w"))
    c = a.select(F.col("item_id").alias("b"), F.col("n").alias("m"), "w")
    pairs = a.join(c, "w").where("item_id < b").groupBy(F.col("item_id").alias("a"), "b", "n", "m").agg(F.count("*").alias("shared"))
    share = F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))
    return pairs.where(share >= 0.2).select("a", "b", F.round(share, 6).alias("jaccard"))


@query("""SELECT conv_id, count(*)::BIGINT AS turns, arg_max(role, turn) AS last_role, max(turn) AS last_turn, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id""")
def story_groups(t):
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT conv_id, turns, chars FROM (SELECT conv_id, count(*)::BIGINT AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id) ORDER BY chars DESC, conv_id LIMIT 20 OFFSET 20""")
def story_group_page(t):
    return rank.page(story_groups(t).select("conv_id", "turns", "chars"), 2, 20, F.col("chars").desc_nulls_last(), F.col("conv_id"))
