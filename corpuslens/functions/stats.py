"""Scores over counts, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_odds_z(a: Column, b: Column, total_a: Column, total_b: Column) -> Column:
    """z-score of the log-odds ratio of two counts under the informative Dirichlet prior of their sum."""
    mine, other = 2 * a + b, a + 2 * b
    ratio = F.log(mine / (2 * total_a + total_b)) - F.log(other / (total_a + 2 * total_b))
    return ratio / F.sqrt(1 / mine + 1 / other)


def per_ten_thousand(count: Column, total: Column) -> Column:
    """Occurrences in 10,000 words, two decimals; 0 where there are none."""
    return F.coalesce(F.round(F.when(total > 0, count / total * 10000), 2), F.lit(0.0))
