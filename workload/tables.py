"""Inputs the queries share.

``ratings`` is a join and an aggregate over the star tables, and many queries
read it or its split several times. As a real pipeline would, they are written
once per session to the shared scratch folder and scanned from there.
``fresh_ratings`` and the other mappings always run on the given tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halfstar.models.popularity import popularity_recommend
from halfstar.operators.skew import group_sizes
from halfstar.operators.split import label_split
from halfstar.plans.compare import with_speedups
from halfstar.plans.runs import agg_runs_pop_std, with_num_cores
from halfstar.sources.startables import dealt_ratings, links, movies, runs, tags
from halfstar.sources.startables import ratings as fresh_ratings
from halfstar.sources.writers import materialise, materialise_bucketed

__all__ = [
    "fresh_ratings", "links", "movies", "runs", "tags",
    "fast_results", "fitted", "labelled", "max_seen", "popular_recs", "ratings", "results",
    "saved_results", "split", "test_users", "user_sizes",
]

_staged: dict[tuple[str, str, str], DataFrame] = {}
_parts: dict[tuple[str, str], int] = {}  # the buckets by user in which ratings are stored, or 0
_max_seen: dict[tuple[str, str], int] = {}
_models: dict[tuple[str, str, str], object] = {}


def _stage(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], *partition_by: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _staged:
        _staged[key] = materialise(build(), name, *partition_by)
    return _staged[key]


def fitted(spark: SparkSession, folder: str, name: str, fit: Callable[[DataFrame], object]):
    """A model of the train half, fitted once per session; ``name`` stands for the model and its parameters."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _models:
        _models[key] = fit(split(spark, folder)[0])
    return _models[key]


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """All ratings; large tables are stored in buckets by user, unless a user has too many for a task."""
    key = (spark.sparkContext.applicationId, folder, "ratings")
    if key not in _staged:
        fresh, _parts[key[:2]] = dealt_ratings(spark, folder)
        _staged[key] = _stored(fresh, "ratings", _parts[key[:2]])
    return _staged[key]


def _stored(df: DataFrame, name: str, parts: int, *partition_by: str) -> DataFrame:
    return materialise_bucketed(df, name, parts, "userId", *partition_by) if parts else materialise(df, name, *partition_by)


def user_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """The ratings ``n`` of each user, counted once."""
    return _stage(spark, folder, "user_sizes", lambda: group_sizes(ratings(spark, folder), "userId"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings of active users with ``in_test``, stored by it: each half is a scan of its own partition."""
    key = (spark.sparkContext.applicationId, folder, "labelled")
    if key not in _staged:
        whole, sizes = ratings(spark, folder), user_sizes(spark, folder)
        parts = _parts[key[:2]]
        _staged[key] = _stored(label_split(whole, sizes=sizes, by_user=parts > 0), "labelled", parts, "in_test")
    return _staged[key]


def split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    both = labelled(spark, folder)
    return both.where(~both.in_test).drop("in_test"), both.where(both.in_test).drop("in_test")


def test_users(test: DataFrame) -> DataFrame:
    return test.select("userId").distinct()


def max_seen(spark: SparkSession, folder: str) -> int:
    """The most ratings of any user: a statistic of the stored ratings, so taken once."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _max_seen:
        _max_seen[key] = user_sizes(spark, folder).agg(F.max("n")).first()[0] or 0
    return _max_seen[key]


def popular_recs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, top-10 unseen popular items of the test users)."""
    train, test = split(spark, folder)
    return train, test, popularity_recommend(train, test_users(test), 10, max_seen(spark, folder))


def results(spark: SparkSession, folder: str) -> DataFrame:
    """One row per configuration of the run log."""
    return with_num_cores(agg_runs_pop_std(runs(spark, folder)))


def saved_results(spark: SparkSession, folder: str) -> DataFrame:
    """The same, written and scanned: comparisons read it several times, and the run log must be read once."""
    return materialise(results(spark, folder), "results")


def fast_results(spark: SparkSession, folder: str) -> DataFrame:
    return with_speedups(saved_results(spark, folder))
