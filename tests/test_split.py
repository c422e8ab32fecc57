import random

import pytest
from pyspark.sql import functions as F

from halfstar.operators import split
from tests.fixtures import random_ratings, ratings, rows_of


def expected_split(rows, size=0.2, least=5):
    by_user = {}
    for row in rows:
        by_user.setdefault(row[0], []).append(row)
    test = set()
    for mine in by_user.values():
        if len(mine) >= least:
            mine.sort(key=lambda r: (r[3], r[1]))
            test |= {(u, m) for u, m, _, _ in mine[-max(1, int(len(mine) * size)):]}
    kept = {(u, m) for u, m, _, _ in rows if len(by_user[u]) >= least}
    return kept - test, test


def test_edges(spark):
    sizes = {1: 1, 2: 4, 3: 5, 4: 9, 5: 10}
    rows = [(u, 10 + i, 3.0, 100 + i) for u, n in sizes.items() for i in range(n)]
    rows[-1] = (5, 19, 3.0, 108)  # ties with the rating before it
    _, test = split.temporal_split(ratings(spark, rows))
    counts = dict(rows_of(test.groupBy("userId").count(), "userId", "count"))
    assert counts == {3: 1, 4: 1, 5: 2}
    assert rows_of(test.where("userId = 5"), "movieId") == [(18,), (19,)]


@pytest.mark.parametrize("task_rows", [10**6, 40, 5, 0])
def test_hot_users_split_alike(spark, task_rows):
    """Whatever counts as heavy, rows are the same as brute force."""
    rows, df = random_ratings(spark, 30, 400, 900, hot_user=3)
    train, test = split.temporal_split(df, task_rows=task_rows)
    want_train, want_test = expected_split(rows)
    assert set(rows_of(train, "userId", "movieId")) == want_train
    assert set(rows_of(test, "userId", "movieId")) == want_test


@pytest.mark.parametrize("moment", [0, 1_700_000_000])
def test_hot_user_with_one_timestamp(spark, moment):
    rows = [(1, i, 3.0, moment) for i in range(500)] + [(2, i, 3.0, i) for i in range(10)]
    random.Random(3).shuffle(rows)
    _, test = split.temporal_split(ratings(spark, rows), task_rows=50)
    assert set(rows_of(test, "userId", "movieId")) == expected_split(rows)[1]


def test_large_splits_are_dealt_by_user(spark, monkeypatch):
    """The window's tasks follow the ratings, and known counts of users aren't taken again."""
    rows, df = random_ratings(spark, 30, 400, 900)
    monkeypatch.setattr(split.skew, "DEALT_FROM", 100)
    monkeypatch.setattr(split.skew, "DEALT_ROWS", 50)
    counted = split.skew.group_sizes(df, "userId").localCheckpoint()
    monkeypatch.setattr(split, "group_sizes", None)
    labelled = split.label_split(df, sizes=counted)
    total = counted.agg(F.sum("n")).first()[0]
    text = labelled._jdf.queryExecution().executedPlan().toString()
    assert total > 250 and f", {-(-total // 50)})" in text and text.count("Exchange hashpartitioning") == 1
    assert set(rows_of(labelled.where("in_test"), "userId", "movieId")) == expected_split(rows)[1]


def test_invariants(spark, sf, halves):
    from workload import tables

    train, test = halves
    row = split.check_split(split.active_users(tables.ratings(spark, sf)), train, test).first()
    assert (row.n_overlap, row.n_missing) == (0, 0) and row.n_input == row.n_union
    last = train.groupBy("userId").agg(F.max("timestamp").alias("last"))
    assert test.join(last, "userId").where(F.col("timestamp") < F.col("last")).isEmpty()


def test_persisted_releases(spark):
    df = spark.range(5)
    with split.persisted(df) as (kept,):
        assert kept.is_cached
    assert not df.is_cached
