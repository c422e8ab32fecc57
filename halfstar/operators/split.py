"""Chronological per-user train/test split."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halfstar.operators import skew
from halfstar.operators.profile import rows, user_activity
from halfstar.operators.quantiles import exact_order_statistics
from halfstar.operators.skew import TASK_ROWS, group_sizes, heavy_table
from halfstar.sources.writers import materialise


def active_users(ratings: DataFrame, min_ratings: int = 5) -> DataFrame:
    """Ratings of users with at least ``min_ratings`` of them."""
    keep = user_activity(ratings).where(F.col("n") >= min_ratings).select("userId")
    return ratings.join(keep, "userId", "left_semi")


def _n_test(n: Column, test_size: float) -> Column:
    return F.greatest(F.lit(1), F.floor(n * F.lit(float(test_size))))


def label_split(
    ratings: DataFrame, test_size: float = 0.2, min_ratings: int = 5, task_rows: int = TASK_ROWS, sizes: DataFrame | None = None,
    by_user: bool = False,
) -> DataFrame:
    """Ratings of active users with ``in_test``: true for a user's last max(1, int(n * test_size)) ratings.

    Time order, ties by movieId. One shuffle on the user serves both the count
    and the rank. Users over ``task_rows`` ratings do not go through that
    window: their cut is found by an exact order statistic and compared to.
    ``sizes``, if known, holds the ratings ``n`` of each user. ``by_user`` tells that
    ratings are hashed by user already, into tasks of bounded size.
    """
    sizes = materialise(group_sizes(ratings, "userId"), "user-sizes") if sizes is None else sizes
    total = sizes.agg(F.sum("n")).first()[0] or 0
    heavy = heavy_table(ratings, "userId", task_rows=task_rows, sizes=sizes)
    latest_first = Window.partitionBy("userId").orderBy(F.desc("timestamp"), F.desc("movieId"))
    # The count shares the rank's ordering, so that one sort serves both.
    whole_user = latest_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def by_window(df: DataFrame) -> DataFrame:
        return (
            (df if by_user else skew.dealt(df, total, "userId")).select(
                "*", rows().over(whole_user).alias("n"), F.row_number().over(latest_first).alias("from_last")
            )
            .where(F.col("n") >= min_ratings)
            .select(*ratings.columns, (F.col("from_last") <= _n_test(F.col("n"), test_size)).alias("in_test"))
        )

    if heavy is None:
        return by_window(ratings)

    hot = heavy.keys("userId")
    # (timestamp, movieId) as one long: order-preserving, unique within the user.
    moment = F.col("timestamp") * F.lit(2**31) + F.col("movieId")
    keyed = ratings.join(hot, "userId", "left_semi").withColumn("moment", moment)
    cuts = exact_order_statistics(
        keyed, ["userId"], "moment", lambda n: [n - _n_test(n, test_size) + 1],
        centre=1 - test_size, few_groups=heavy.listed, min_rows=task_rows,
    ).select("userId", F.col("v0").alias("cut"), "n")
    hot_rows = (
        keyed.join(heavy.sized(cuts), "userId")
        .where(F.col("n") >= min_ratings)
        .withColumn("in_test", F.col("moment") >= F.col("cut"))
    )
    return by_window(ratings.join(hot, "userId", "left_anti")).unionByName(
        hot_rows.select(*ratings.columns, "in_test")
    )


def temporal_split(
    ratings: DataFrame, test_size: float = 0.2, min_ratings: int = 5, task_rows: int = TASK_ROWS
) -> tuple[DataFrame, DataFrame]:
    labelled = label_split(ratings, test_size, min_ratings, task_rows)
    return (
        labelled.where(~F.col("in_test")).drop("in_test"),
        labelled.where("in_test").drop("in_test"),
    )


@contextmanager
def persisted(*frames: DataFrame) -> Iterator[tuple[DataFrame, ...]]:
    """Keep frames in memory or on disk, materialised, within the block."""
    kept = tuple(df.persist(StorageLevel.MEMORY_AND_DISK) for df in frames)
    try:
        for df in kept:
            df.count()
        yield kept
    finally:
        for df in kept:
            df.unpersist()


def check_split(ratings: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """Counts that must agree: input rows, train + test rows, rows in both halves, input rows in neither."""
    key = ["userId", "movieId"]
    flag = lambda df, a, b, c: df.select(*key, F.lit(a).alias("i"), F.lit(b).alias("tr"), F.lit(c).alias("te"))
    both = flag(ratings, 1, 0, 0).unionAll(flag(train, 0, 1, 0)).unionAll(flag(test, 0, 0, 1))
    per_pair = both.groupBy(*key).agg(F.sum("i").alias("i"), F.sum("tr").alias("tr"), F.sum("te").alias("te"))
    return per_pair.agg(
        F.sum("i").alias("n_input"),
        F.sum(F.col("tr") + F.col("te")).alias("n_union"),
        F.sum(F.when((F.col("tr") > 0) & (F.col("te") > 0), 1).otherwise(0)).cast("long").alias("n_overlap"),
        F.sum(F.when((F.col("i") > 0) & (F.col("tr") + F.col("te") == 0), 1).otherwise(0)).cast("long").alias("n_missing"),
    )
