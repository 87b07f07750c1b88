"""Scores and levels by rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The score of each sum of three components, from 3 to 15; the levels' least scores; rough rates to dollars.
SUM_TO_SCORE = (1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10)
LEVELS = (("red", 8), ("orange", 6), ("yellow", 4))
TO_USD = {"USD": 1.0, "EUR": 1.08, "ILS": 0.27, "NIS": 0.27}


def score_of_sum(total: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SUM_TO_SCORE)), F.least(F.lit(15), F.greatest(F.lit(3), total)).cast("int") - 2)


def level_of(score: Column) -> Column:
    told = None
    for name, least in LEVELS:
        told = F.when(score >= least, name) if told is None else told.when(score >= least, name)
    return told.otherwise("archive")


def noisy_or(weights: Column) -> Column:
    """1 - product of (1 - w), each w held between 0 and 1."""
    return 1 - F.aggregate(weights, F.lit(1.0), lambda acc, w: acc * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), w))))


def focus_boost(score: Column, relevance: Column, company: Column) -> Column:
    """1 more from a relevance of 0.6, 2 more for a company, at most 10."""
    return F.least(F.lit(10), score + F.when(relevance >= 0.6, 1).otherwise(0) + F.when(company, 2).otherwise(0))


def tier_score(amount: Column, days: Column, fit: Column, large: float = 50e6, middle: float = 5e6) -> Column:
    size = F.when(amount >= large, 3).when(amount >= middle, 2).when(amount > 0, 1).otherwise(0)
    return size + F.when(days <= 30, 2).when(days <= 90, 1).otherwise(0) + F.when(fit, 1).otherwise(0)


def tier_label(score: Column) -> Column:
    return F.when(score >= 4, "A").when(score >= 2, "B").otherwise("C")


def likelihood(triggers: Column, rfi: Column, prior: Column) -> Column:
    more = F.least(0.10 * (triggers - 1), F.lit(0.30))
    raw = 0.30 + more + F.when(rfi, 0.20).otherwise(0.0) + F.when(prior, 0.15).otherwise(0.0)
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.05), raw)), 3)


def to_usd(amount: Column, currency: Column) -> Column:
    """Dollars at rough rates: no currency is taken as dollars, an unknown one keeps the amount."""
    code = F.upper(F.coalesce(currency, F.lit("USD")))
    told = F.when(code == "USD", amount.cast("double"))
    for name, rate in TO_USD.items():
        told = told.when(code == name, amount * rate)
    return told.otherwise(amount.cast("double"))


def amounts_close(a: Column, b: Column, share: float = 0.10) -> Column:
    """Within a share of the larger; zero is close to zero only."""
    most = F.greatest(F.abs(a), F.abs(b))
    return F.when((a == 0) | (b == 0), a == b).otherwise(F.abs(a - b) <= share * most)


def weighted(parts: tuple[tuple[float, Column], ...]) -> Column:
    """The sum of weighted parts, held between 0 and 1."""
    total = sum((weight * part for weight, part in parts[1:]), parts[0][0] * parts[0][1])
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
