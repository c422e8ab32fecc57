"""Helpers shared by the text operators: words, white space, and joins on hot keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that separates words, and what counts as a word.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]++"

# A key with more than a HOT_SHARE-th of all rows is hot, so at most HOT_SHARE keys are.
HOT_SHARE = 100
SALTS = 64


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def without_white(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def null_key(column: str) -> Column:
    """A string that stands for the value in joins: null is a key like any other, and no value equals it."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def hot_keys(counts: DataFrame, key: str, rows: str, total: int | None = None) -> list:
    """The keys with more than a HOT_SHARE-th of all rows: at most HOT_SHARE values, taken by a job over ``counts``.

    ``counts`` holds one row per key with its number of ``rows``; a second job adds
    these up unless their ``total`` is given.
    """
    total = counts.agg(F.sum(rows)).first()[0] or 0 if total is None else total
    found = counts.where(F.col(rows) * HOT_SHARE > F.lit(total)).where(F.col(key).isNotNull()).select(key).collect()
    return [r[0] for r in found]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list, spread: Column, how: str = "left") -> DataFrame:
    """Join on ``key``, of which ``right`` has one row each.

    Rows of a hot key are dealt over SALTS partitions by ``spread``, and the one
    row of that key on the right is repeated as often. Neither side is broadcast
    by force, and the result doesn't depend on which keys are listed as hot.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    salted = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(right.withColumn("_salt", F.explode(every)), [key, "_salt"], how).drop("_salt")


def beta_prior(df: DataFrame, bad: str, n: str) -> tuple[float, float]:
    """(a, b) of a beta prior by the method of moments over groups with ``bad`` of ``n`` rows each.

    The pooled rate is the mean. The spread of the groups' rates beyond what
    sampling alone gives sets the strength, held between 2 and 1,000
    observations. Without any rows the prior is even: (1, 1).
    """
    b, m, k = F.col(bad).cast("double"), F.col(n).cast("double"), F.count(F.lit(1)).cast("double")
    row = df.where(m > 0).agg(
        F.sum(b).alias("bad"), F.sum(m).alias("n"), F.sum(m * m).alias("nn"), F.sum(b * b / m).alias("bb"), k.alias("k")
    ).first()
    if not row["n"]:
        return 1.0, 1.0
    mean = min(max(row["bad"] / row["n"], 1e-4), 1 - 1e-4)
    binomial = mean * (1 - mean)
    # Weighted sum of squares between the groups, set equal to its expectation.
    between = row["bb"] - row["bad"] ** 2 / row["n"]
    scale = row["n"] - row["nn"] / row["n"]
    rho = (between - (row["k"] - 1) * binomial) / (binomial * scale) if scale > 0 else 0.0
    strength = 1 / rho - 1 if rho > 0 else math.inf
    strength = min(max(strength, 2.0), 1000.0)
    return mean * strength, (1 - mean) * strength
