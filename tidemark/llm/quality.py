"""Quality rules: plain text rules, and a hashed n-gram log-likelihood ratio of trusted text against the raw corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, small, words

#: Word unigrams and bigrams are hashed into about BUCKET_RATE * sqrt(bytes of text) buckets, in whole chunks of CHUNK.
BUCKET_RATE, CHUNK = 36, 4096
#: Weights of at most so many buckets (64 MB) reach the tasks as one value; more are a table that the n-grams are joined with.
ARRAY_BUCKETS = 1 << 24
#: Text that one task counts, where the corpus has as much for each core.
TASK_BYTES = 1 << 26
#: At most so many ids of trusted documents are broadcast: some 40 bytes each in a task's memory.
TRUSTED_ROWS = 8_000_000
#: Added to each bucket's count, as a share of the mean count of a bucket, in both multinomials.
SMOOTHING = 1.0
#: Documents go whose mean log ratio is below -CUT times the mean log ratio of the trusted n-grams.
CUT = 2.0
MIN_WORDS = 10
#: Words that a repeated window spans, and the most that may lie in such windows, in percent.
WINDOW, MAX_REPEATED = 5, 20
SYMBOLS = r"[^#*$%&|<>]+"


def word_hashes(text: Column | str) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of `width` words that occur twice or more.

    Windows are compared by a 64-bit hash. Only texts with a repeated window sort (hash, place) pairs; in the sorted
    pairs a repeated window has an equal neighbour, and the places found are summed with their overlaps taken off.
    """

    def window(h, i):
        return F.xxhash64(*(F.get(h, i + k) for k in range(width)))

    def covered(found):
        z = F.array_sort(F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(z):
            again = F.transform(z, lambda e, j: F.when((F.get(z, j - 1)["x"] == e["x"]) | (F.get(z, j + 1)["x"] == e["x"]), e["i"]))
            return F.sort_array(F.array_compact(again))

        start = F.struct(F.lit(-width).alias("at"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(width), i - acc["at"])).alias("n"))
        return F.aggregate(let(z, places), start, step, lambda acc: acc["n"])

    def of(h):
        found = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: window(h, i))
        some = let(found, lambda f: F.when(F.size(F.array_distinct(f)) < F.size(f), covered(f)).otherwise(F.lit(0).cast("long")))
        return F.when(F.size(h) >= width, some).otherwise(F.lit(0).cast("long"))

    return let(hashes, of)


def buckets(hashes: Column, n: int) -> Column:
    """The buckets (0 to n - 1) of a text's unigrams and bigrams, repeats included."""

    def of(h):
        one = F.transform(h, lambda x: F.pmod(x, F.lit(n).cast("long")).cast("int"))
        two = F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.pmod(F.xxhash64(F.get(h, i), F.get(h, i + 1)), F.lit(n).cast("long")).cast("int"))
        return F.when(F.size(h) >= 2, F.concat(one, two)).otherwise(one)

    return let(hashes, of)


def bucket_count(text_bytes: int) -> int:
    """How many buckets a corpus of so many bytes takes.

    The root lets what is gathered grow with the corpus while the n-grams that share a bucket grow too: with one or two in
    each, the trusted counts would know the trusted documents by heart and reject others of the same kind.
    """
    return CHUNK * max(2, math.ceil(BUCKET_RATE * math.sqrt(text_bytes) / CHUNK))


def duplicate_lines(text: Column | str) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def bucket_counts(docs: DataFrame, trusted: DataFrame, n: int, doc_id="doc_id", text="text", tasks: int | None = None) -> DataFrame:
    """b, raw, good of every bucket with an n-gram, summed in each task before they are exchanged. trusted has the ids of trusted documents.

    A task sends a row for every bucket that it meets, so the input is read by no more than `tasks` tasks: larger ones send less.

    Up to TRUSTED_ROWS ids are broadcast; beyond, the texts are exchanged once by id, before any word is cut.
    """
    ids = small(trusted.select(F.col(trusted.columns[0]).alias("__id")).where("__id IS NOT NULL").distinct().withColumn("__trusted", F.lit(1)), TRUSTED_ROWS)
    texts = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text"))
    marked = (texts.coalesce(tasks) if tasks else texts).join(ids, F.col("__doc") == F.col("__id"), "left")
    each = marked.select(F.coalesce("__trusted", F.lit(0)).alias("t"), F.explode(buckets(word_hashes(F.col("__text")), n)).alias("b"))
    return each.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("good"))


def bucket_weights(counts: DataFrame, n: int, smoothing: float = SMOOTHING) -> tuple[DataFrame, float]:
    """b, weight (float) of all n buckets: log p_trusted / p_raw; and the mean weight of the trusted n-grams.

    That mean says how far trusted text lies from raw text under these counts; the cut is a multiple of it, and so follows
    the size of the corpus, the number of buckets and the smoothing. Without a trusted n-gram all weights are 0. Three sums
    come to the driver.
    """
    all_raw, all_good = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    share = lambda c, total: (F.col(c) + smoothing * total / n) / (total * (1 + smoothing))
    weight = F.log(share("good", all_good)) - F.log(share("raw", all_raw)) if all_good else F.lit(0.0)
    every = counts.sparkSession.range(n).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0, ["raw", "good"])
    weights = materialize(every.select("b", weight.cast("float").alias("weight"), "good"))
    mean = weights.agg(F.sum(F.col("good") * F.col("weight").cast("double"))).first()[0] / all_good if all_good else 0.0
    return weights.select("b", "weight"), mean


def _with_ratio(base: DataFrame, weights: DataFrame, n: int, array_buckets: int) -> DataFrame:
    """base (with __w.h, a text's word hashes) and `ratio`, the mean weight of a text's n-grams; 0 without any.

    Up to array_buckets the weights are one array of chunks, looked up in place: nothing is exchanged. Beyond, n-grams are
    summed per text and bucket and joined with the table; texts are keyed by two hashes, and copies of a text share a key,
    which leaves their mean as it is.
    """
    if n <= array_buckets:
        chunk = (F.col("b") / CHUNK).cast("int")
        rows = weights.groupBy(chunk.alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "weight"))), lambda x: x["weight"]).alias("w"))
        held = materialize(rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "w"))), lambda x: x["w"]).alias("weights")))
        base = base.withColumn("__weights", held.scalar())
        at = lambda x: F.get(F.get(F.col("__weights"), F.shiftright(x, 12)), x.bitwiseAND(F.lit(CHUNK - 1))).cast("double")
        mean = let(buckets(F.col("__w.h"), n), lambda b: F.aggregate(b, F.lit(0.0), lambda acc, x: acc + at(x)) / F.greatest(F.size(b), F.lit(1)))
        return base.withColumn("ratio", mean)
    keyed = base.select("__p", "__q", F.explode(buckets(F.col("__w.h"), n)).alias("b")).groupBy("__p", "__q", "b").agg(F.count("*").alias("k"))
    summed = keyed.join(weights.hint("shuffle_hash"), "b").groupBy("__p", "__q").agg((F.sum(F.col("k") * F.col("weight").cast("double")) / F.sum("k")).alias("ratio"))
    return base.join(summed, ["__p", "__q"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))


def quality(docs: DataFrame, trusted: DataFrame, doc_id="doc_id", text="text", n: int | None = None, cut: float = CUT, keep: tuple[str, ...] = (), array_buckets: int = ARRAY_BUCKETS) -> DataFrame:
    """doc_id, the plain counts, base_failed, the ratio per n-gram, the least ratio that is kept and the verdict kept, for every row; then the columns `keep`.

    Null texts count as empty: they have no words and fail. Repeated rows are judged alike and each counts in the corpus.
    A null id is never trusted; without any trusted text nothing is rejected by its ratio. An empty table gives no rows. The
    number of buckets follows the bytes of the corpus unless n is given.
    """
    text_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0))).first()[0]
    n, tasks = n or bucket_count(text_bytes), max(2 * docs.sparkSession.sparkContext.defaultParallelism, text_bytes // TASK_BYTES)
    weights, mean = bucket_weights(materialize(bucket_counts(docs, trusted, n, doc_id, text, tasks)), n)
    t = F.coalesce(F.col(text), F.lit(""))
    counted = lambda x: F.struct(F.size(x).cast("long").alias("n"), F.length(F.array_join(x, "")).cast("long").alias("chars"), F.transform(x, lambda y: F.xxhash64(y)).alias("h"))
    base = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("__kept") if keep else F.lit(None).cast("int").alias("__kept"),
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.lit(1), t).alias("__p"),
        F.xxhash64(F.lit(2), t).alias("__q"),
        let(words(text), counted).alias("__w"),
        F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long").alias("n_symbols"),
        duplicate_lines(t).alias("n_dup_lines"),
    )
    rated = _with_ratio(base, weights, n, array_buckets)
    scored = rated.select("__kept", "doc_id", F.col("__w.n").alias("n_words"), F.col("__w.chars").alias("word_chars"), "n_symbols", "n_dup_lines", repeated_words(F.col("__w.h")).alias("n_repeat_words"), "ratio")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    judged = scored.withColumn("base_failed", failed).withColumn("least_ratio", F.lit(-cut * mean)).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= F.col("least_ratio")))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "least_ratio"]
    return judged.select(*out, *(["__kept"] if keep else []))


def keep_good(docs: DataFrame, trusted: DataFrame, doc_id="doc_id", text="text", n: int | None = None, cut: float = CUT) -> DataFrame:
    """The rows of docs that pass, with the columns of docs; see quality() for nulls, empty and repeated rows."""
    judged = quality(docs, trusted, doc_id, text, n, cut, keep=tuple(docs.columns))
    return judged.where("kept").select(*(F.col("__kept")[c].alias(c) for c in docs.columns))
