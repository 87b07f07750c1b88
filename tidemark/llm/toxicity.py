"""Toxicity: non-negative positive-unlabelled learning of numpy classifiers over the words of a text and their stems."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows that the classifiers are fitted on at most: confirmed toxic ones, and ones taken as unlabelled. Those with the smallest hashes of their ids are taken.
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 8_000
#: How many features the fitted model has at most (those that tell most of the sampled toxic texts; a bound on the model, as the
#: sample's size is, not on what is scored), and the least number of confirmed toxic texts that hold one.
MAX_FEATURES, MIN_TEXTS = 512, 3
#: Features are whole words, and beginnings of words of these lengths: many insults share a stem.
STEMS = (4, 5, 6, 7, 8)
#: Different words whose features a task remembers.
REMEMBERED = 400_000
#: Classifiers whose scores are averaged; each sees another half of the unlabelled texts.
MODELS = 4
THRESHOLD = 0.3
#: A word, for the fit and for the scores alike; texts are lower-cased first.
WORDS = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are not learned from; a null id is never held out (it has no label either)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def different_words(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def word_set(text: Column) -> Column:
    """The different words of a text; only sampled rows come here."""

    @F.arrow_udf("array<string>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([sorted(different_words(t)) for t in texts.to_pylist()], pa.list_(pa.string()))

    return of(text)


def features(word: Column) -> Column:
    """What a word counts for: itself, marked as whole, and its beginnings."""
    stems = F.array(*(F.when(F.length(word) >= n, F.substring(word, 1, n)) for n in STEMS))
    return F.array_append(F.array_compact(stems), F.concat(word, F.lit("$")))


@dataclass
class Model:
    """ids: numbers of the features; weights and bias: one row and one number for each classifier."""

    ids: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray

    def scorer(self) -> Callable[[str | None], float]:
        """A function from a text to its score: the mean of the classifiers' probabilities."""
        ids, known = self.ids, {}

        def of(word: str) -> tuple[int, ...]:
            if len(known) >= REMEMBERED:
                known.clear()
            names = [word[:n] for n in STEMS if len(word) >= n] + [word + "$"]
            found = known[word] = tuple(ids[x] for x in names if x in ids)
            return found

        def score(text: str | None) -> float:
            at: list[int] = []
            for word in different_words(text):
                at += known[word] if word in known else of(word)
            x = np.log1p(np.bincount(np.array(at, dtype=np.int64), minlength=len(ids)))
            return float(np.mean(1 / (1 + np.exp(-np.clip(self.bias + self.weights @ x, -40, 40)))))

        return score


def fit_nnpu(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (a row for each) and biases of logistic classifiers under the non-negative risk of positive and unlabelled rows.

    x has the rows; `positive` says how much each weighs among the positives, `unlabelled` (a column per classifier) how
    much it weighs among the unlabelled; every column adds up to 1. The classifiers are fitted side by side, so that a round
    reads x twice, however many there are.

    Risk: prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)). Where the part in max() is negative, the step goes up that
    part instead, which undoes the overfit. Adam, full batches.
    """
    k = unlabelled.shape[1]
    theta = np.zeros((x.shape[1] + 1, k))  # the last row has the biases
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    of_p = prior * positive[:, None]
    for t in range(1, rounds + 1):
        s = 1 / (1 + np.exp(-np.clip(x @ theta[:-1].astype(x.dtype) + theta[-1], -40, 40)))
        negative = ((of_p - unlabelled) * np.log1p(-np.minimum(s, 1 - 1e-12))).sum(axis=0)
        from_p, from_u = of_p * s, unlabelled * s  # slopes of prior * R_p(-1) and of R_u(-1)
        slope = np.where(negative >= 0, of_p * (s - 1) - from_p + from_u, from_p - from_u)
        g = np.vstack([x.T @ slope.astype(x.dtype) + decay * theta[:-1], slope.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1].T, theta[-1]


def fit(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="toxic") -> Model | None:
    """The model, or None where no confirmed toxic text is at hand. Labels of held-out rows are never read.

    The classifiers see words only, and count a feature by the different words that have it. Unlabelled rows are a bounded sample of documents that aren't confirmed toxic; whether
    they are confirmed clean plays no part. The class prior is the share of toxic rows among the labelled ones.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).where(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("y").isNotNull())
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    n, toxic = known.agg(F.count("*"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0))).first()
    if not toxic:
        return None
    prior = min(0.95, max(1e-4, toxic / n))
    order = F.xxhash64("id", F.lit("fit"))
    yes = known.where("y = 1").withColumn("o", order).orderBy("o", "id").limit(MAX_POSITIVE).select("id", F.lit(1).alias("y"))
    # an id is one row of the sample however many rows have it: that with the least hash of its text
    text_hash = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    per_id = docs.select(F.col(doc_id).alias("id"), text_hash.alias("h")).where(F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.min("h").alias("h"))
    per_id = materialize(per_id)
    some = per_id.withColumn("o", order).orderBy("o", "id").limit(MAX_UNLABELLED + MAX_POSITIVE).select("id", F.lit(0).alias("u"))
    chosen = some.join(yes, "id", "full").withColumn("y", F.coalesce("y", F.lit(0))).select("id", "y")
    chosen = materialize(per_id.join(F.broadcast(materialize(chosen)), "id"))  # at most MAX_UNLABELLED + 2 * MAX_POSITIVE rows, here and below
    texts = docs.select(F.col(doc_id).alias("id"), text_hash.alias("h"), F.col(text).alias("text")).join(F.broadcast(chosen), ["id", "h"])
    rows = texts.dropDuplicates(["id", "h"]).select("id", "y", word_set(F.col("text")).alias("words"))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("nth"), "y", "words"))
    # all words of a text stand in one row: each text counts its features itself, and only sums per feature are exchanged
    rows = rows.select("nth", "y", F.flatten(F.transform("words", features)).alias("features"))
    per = rows.select("y", F.explode(F.array_distinct("features")).alias("feature")).groupBy("feature").agg(F.sum("y").alias("p"), F.count("*").alias("n")).where(F.col("p") >= MIN_TEXTS)
    drawn = rows.agg(F.avg("y")).first()[0] or 0.0
    # by how far a feature's toxic texts exceed what their number would lead to expect, in standard deviations; ties by name
    excess = (F.col("p") - F.lit(drawn) * F.col("n")) / F.sqrt(F.col("n"))
    picked = materialize(per.orderBy(excess.desc(), "feature").limit(MAX_FEATURES).select("feature"))
    ids = {r[0]: i for i, r in enumerate(picked.orderBy("feature").collect())}  # at most MAX_FEATURES
    if not ids:
        return None
    sample = rows.select("nth", "y").toPandas().sort_values("nth")  # one row an id, and so many ids were chosen
    cells = rows.select("nth", F.explode("features").alias("feature")).join(F.broadcast(picked), "feature").groupBy("nth", "feature").agg(F.count("*").alias("n")).toPandas()
    x = np.zeros((len(sample), len(ids)), dtype=np.float32)
    x[np.searchsorted(sample["nth"].to_numpy(), cells["nth"].to_numpy()), cells["feature"].map(ids).to_numpy()] = np.log1p(cells["n"].to_numpy())
    y = sample["y"].to_numpy()
    if not (y == 1).any():
        return None
    if (y == 1).all():  # nothing unlabelled is at hand: a text without any feature stands for it
        x, y = np.vstack([x, np.zeros((1, len(ids)), dtype=np.float32)]), np.append(y, 0)
    positive = (y == 1) / (y == 1).sum()
    rest = np.flatnonzero(y == 0)
    # positives taken out of the sample go back in at the rate of the prior: the unlabelled rows follow the corpus
    unlabelled = np.repeat(prior * positive[:, None], MODELS, axis=1)
    for seed in range(MODELS):
        own = np.random.default_rng(seed).permutation(rest)[: max(1, len(rest) // 2)]
        unlabelled[own, seed] = (1 - prior) / len(own)
    return Model(ids, *fit_nnpu(x, positive, unlabelled, prior))


def score(docs: DataFrame, model: Model | None, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null and empty texts score as no words do.

    Without a model (no confirmed toxic text) every score is 0. Repeated rows score alike; an empty table gives no rows.
    The model is a few thousand numbers. Whole texts are read.
    """

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scored = model.scorer()
        for texts in batches:
            yield pa.array([scored(t) for t in texts.to_pylist()], pa.float64())

    value = F.lit(0.0) if model is None else of(F.col(text))
    out = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), value.alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of every row, by classifiers fitted on these rows and labels: see fit() and score().

    Labels of null ids or null classes count for nothing, of repeated labels the larger counts. Rows of one id are one row of the
    sample; each is scored by its own whole text. Null and empty texts score as no words do. An empty table gives no rows.
    """
    return score(docs, fit(docs, labels, doc_id, text, label), doc_id, text)
