"""Finding hot groups, so that operators which need a whole group in one task can go around them.

What is called heavy only steers plans: operators give the same rows for any
choice, so an outdated answer can cost time but never rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one group that a single task may sort or hold.
TASK_ROWS = 1_000_000
# Heavy groups are listed and broadcast up to this many; more stay a distributed table.
MAX_LISTED = 10_000
# A key with more than a HOT_SHARE-th of all rows is hot, so at most HOT_SHARE keys are.
HOT_SHARE = 100
SALTS = 64
# Larger tables are dealt into tasks of so many rows where a task sorts or hashes its rows; smaller ones are left to the session.
DEALT_FROM = 2_000_000
DEALT_ROWS = 500_000


@dataclass(frozen=True)
class Heavy:
    """Heavy groups as (keys, n). ``listed`` ones are at most MAX_LISTED and may be broadcast."""

    groups: DataFrame
    listed: bool

    def sized(self, df: DataFrame) -> DataFrame:
        """A frame of a row or a few per heavy group, to be broadcast if that bounds it."""
        return F.broadcast(df) if self.listed else df

    def keys(self, *keys: str) -> DataFrame:
        return self.sized(self.groups.select(*keys))


def group_sizes(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def max_group_rows(df: DataFrame, *keys: str) -> int:
    """Rows of the largest group: one partially aggregated job."""
    return group_sizes(df, *keys).agg(F.max("n")).first()[0] or 0


def deals(rows: int) -> int:
    """The tasks that a table of so many ``rows`` is dealt into; 0 for a small one, which is left as it is."""
    return 0 if rows <= DEALT_FROM else -(-rows // DEALT_ROWS)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into tasks of about DEALT_ROWS of its ``rows``, whatever the session's partitions; a small one as it is."""
    return df.repartition(deals(rows), *keys) if deals(rows) else df


def most_rows(df: DataFrame, key: str, rows: int) -> int:
    """A bound on the rows of ``df`` that share a ``key``: those of the fullest of many hashes, so that few rows are shuffled."""
    return max_group_rows(df.select(F.pmod(F.xxhash64(key), F.lit(max(4096, rows // 1000))).alias("_hash")), "_hash")


def heavy_table(df: DataFrame, *keys: str, task_rows: int = TASK_ROWS, sizes: DataFrame | None = None) -> Heavy | None:
    """The groups of more than ``task_rows`` rows, or None if there are none. Counts the groups when called, unless their ``sizes`` are given."""
    heavy = (group_sizes(df, *keys) if sizes is None else sizes).where(F.col("n") > task_rows)
    found = heavy.limit(MAX_LISTED + 1).collect()
    if not found:
        return None
    if len(found) > MAX_LISTED:
        return Heavy(heavy, listed=False)
    return Heavy(df.sparkSession.createDataFrame(found, heavy.schema), listed=True)


def same_group(keys: list[str], prefix: str) -> list[Column]:
    """Null-safe equality of the keys with their prefixed copies from :func:`prefixed`."""
    return [F.col(key).eqNullSafe(F.col(f"{prefix}{key}")) for key in keys]


def prefixed(df: DataFrame, keys: list[str], prefix: str, *others: str) -> DataFrame:
    return df.select(*[F.col(key).alias(f"{prefix}{key}") for key in keys], *others)


def hot_keys(sizes: DataFrame, key: str, rows: str, total: int) -> list:
    """The keys with more than a HOT_SHARE-th of ``total`` rows, at most HOT_SHARE; ``sizes`` has a row per key with its ``rows``."""
    found = sizes.where((F.col(rows) * HOT_SHARE > F.lit(total)) & F.col(key).isNotNull()).select(key).collect()
    return [r[0] for r in found]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list, spread: Column, how: str = "left") -> DataFrame:
    """Join on ``key``, of which ``right`` has one row each; rows of a ``hot`` key are dealt over SALTS partitions by ``spread``.

    The row of a hot key on the right is repeated as often. The result doesn't
    depend on which keys are listed as hot, nor on session settings.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    salted = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(right.withColumn("_salt", F.explode(every)), [key, "_salt"], how).drop("_salt")
