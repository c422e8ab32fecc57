"""Exact search for the best products, and positions in groups of any size."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from halfstar.operators import factors, ranking, recommend, sampling
from tests.fixtures import random_ratings


def tables(spark, users, items, dims, seed=0, spread=1.5):
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(items, dims)) * np.exp(spread * rng.normal(size=(items, 1)))
    p = rng.normal(size=(users, dims))
    make = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m.round(3))], "id int, features array<double>")
    return p.round(3), q.round(3), make(p), make(q)


def brute(p, q, k, seen=()):
    out = []
    for u in range(len(p)):
        scores = [(-round(float(p[u] @ q[i]), 9), i) for i in range(len(q)) if (u, i) not in seen]
        out += [(u, pos, i, -s) for pos, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def rows_of(df):
    return sorted((r.userId, r.pos, r.movieId, round(r.score, 9) + 0.0) for r in df.collect())


@pytest.mark.parametrize("first,scored", [(4096, 2048), (20, 2048), (20, 17)])
def test_topk_is_exact(spark, monkeypatch, first, scored):
    monkeypatch.setattr(factors, "FIRST", first)
    monkeypatch.setattr(factors, "SCORED_USERS", scored)
    monkeypatch.setattr(factors, "SCORED_ITEMS", scored)
    p, q, users, items = tables(spark, 50, 400, 6)
    top = factors.exact_topk(users, items, 7)
    assert rows_of(top.recs) == [tuple(r) for r in sorted(brute(p, q, 7))]
    assert top.possible == 50 * 400 and (top.scored == top.possible if first == 4096 else top.scored < 0.6 * top.possible)
    text = top.recs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def block(p, q, seen=()):
    u = [*range(len(p)), *[-1] * len(q), *[a for a, _ in seen]]
    i = [*[-1] * len(p), *range(len(q)), *[b for _, b in seen]]
    return pd.DataFrame({"u": u, "i": i, "features": [*p, *q, *[None] * len(seen)]})


@pytest.mark.parametrize("digits,scale", [(1, 1.0), (3, 1.0), (3, 1e20)])
def test_tiles_of_a_block_give_its_best(monkeypatch, digits, scale):
    """Ties, seen pairs and a user with nearly nothing left, in tiles that the bar is raised between."""
    monkeypatch.setattr(factors, "TILE_USERS", 7)
    monkeypatch.setattr(factors, "TILE_ITEMS", 13)
    rng = np.random.default_rng(7)
    p, q = rng.normal(size=(30, 4)).round(digits), rng.normal(size=(90, 4)).round(digits)
    seen = {(int(a), int(b)) for a, b in rng.integers(0, (30, 90), (700, 2))} | {(3, b) for b in range(88)} | {(4, b) for b in range(90)}
    got = factors.block_topk(block(p * scale, q, sorted(seen)), 5)
    assert sorted(zip(got.userId, got.movieId)) == sorted((u, i) for u, _, i, _ in brute(p, q, 5, seen))


def test_a_large_block_holds_a_tile_of_products():
    """2,048 x 32,768 products would be 512 MB."""
    rng = np.random.default_rng(8)
    rows = block(rng.normal(size=(2_048, 4)), rng.normal(size=(32_768, 4)))
    tracemalloc.start()
    assert len(factors.block_topk(rows, 10)) == 20_480
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_topk_of_unseen_items(spark, monkeypatch):
    monkeypatch.setattr(factors, "FIRST", 16)
    p, q, users, items = tables(spark, 30, 120, 4, seed=5)
    rng = np.random.default_rng(1)
    seen = {(u, int(i)) for u in range(30) for i in rng.choice(120, 30 if u else 118, replace=False)} | {(2, i) for i in range(120)}
    known = spark.createDataFrame(sorted(seen), "userId int, movieId int")
    got = factors.exact_topk(users, items, 5, known).recs
    assert rows_of(got) == [tuple(r) for r in sorted(brute(p, q, 5, seen))]


@pytest.mark.parametrize("scored", [2048, 11])
def test_later_rounds_send_only_what_can_enter_a_list(spark, monkeypatch, scored):
    """Users bring the k-th best score of earlier rounds; items below it make no rows, and those that equal it do."""
    monkeypatch.setattr(factors, "SCORED_USERS", scored)
    monkeypatch.setattr(factors, "SCORED_ITEMS", scored)
    p, q, users, items = tables(spark, 20, 90, 4, seed=3)
    best = brute(p, q, 6, {(4, 2)})
    bars = {u: s for u, pos, _, s in best if pos == 3 and u != 7}
    with_bars = users.join(spark.createDataFrame(sorted(bars.items()), "id int, bar double"), "id", "left")
    seen = spark.createDataFrame([(4, 2), (4, 999), (999, 2)], "userId int, movieId int")
    got = factors._scored(with_bars, 20, items, 90, 6, seen).collect()
    for u in range(20):
        mine = sorted((-round(r.score, 9), r.movieId) for r in got if r.userId == u)
        assert [i for _, i in mine][:6] == [i for a, _, i, _ in best if a == u][: 3 if u in bars else 6]


def test_products_that_reach_a_bar():
    rng = np.random.default_rng(6)
    p, q = rng.normal(size=(40, 5)), rng.normal(size=(70, 5))
    whole = p @ q.T
    bar = np.sort(whole, axis=1)[:, -4] - 1e-12
    bar[3], bar[5] = np.inf, -np.inf
    products = factors.Products(p, q)
    row, place, score = products.reaching(products.rough(slice(0, 40), slice(0, 70)), slice(0, 40), slice(0, 70), bar)
    found = {(int(r), int(i)) for r, i, s in zip(row, place, score) if s >= bar[r]}
    assert found == {(r, i) for r in range(40) for i in range(70) if whole[r, i] >= bar[r]}


def test_ties_and_nothing(spark):
    make = lambda rows: spark.createDataFrame(rows, "id int, features array<float>")
    users, items = make([(1, [1.0, 0.0]), (2, [0.0, 0.0])]), make([(i, [1.0, float(i)]) for i in (5, 3, 9, 1)])
    assert [(r[0], r[2]) for r in rows_of(factors.exact_topk(users, items, 2).recs)] == [(1, 1), (1, 3), (2, 1), (2, 3)]
    assert factors.exact_topk(users, items.limit(0), 2).recs.count() == 0
    assert factors.exact_topk(users.limit(0), items, 2).recs.count() == 0


def test_a_wrong_recommender_is_noticed(spark):
    from workload.models import _list_facts

    _, _, users, items = tables(spark, 12, 60, 4, seed=2)
    train = spark.createDataFrame([(u, u, 3.0, 0) for u in range(12)], "userId int, movieId int, rating double, timestamp long")
    right = factors.exact_topk(users, items, 10, train).recs
    assert _list_facts(right, users, items, train).where("not best").isEmpty()
    worse = factors.exact_topk(users, items, 11, train).recs.where("pos > 1").withColumn("pos", F.col("pos") - 1)
    assert _list_facts(worse, users, items, train).where("best").isEmpty()
    assert _list_facts(worse, users, items, train).where("not (dense and sorted and is_dot_product and all_unseen)").isEmpty()


def test_one_user_is_ranked_over_many_tasks(spark):
    rng = np.random.default_rng(4)
    rows = [(7, i, float(s)) for i, s in enumerate(rng.integers(0, 40, 5000) / 4)] + [(u, i, float((u * i) % 7)) for u in range(6) for i in range(20)]
    df = spark.createDataFrame(rows, "userId int, movieId int, score double").repartition(4)
    got = recommend.rank_candidates(df, task_rows=500)
    plain = recommend.rank_candidates(df)
    assert sorted(map(tuple, got.select("userId", "movieId", "score", "pos").collect())) == sorted(map(tuple, plain.select("userId", "movieId", "score", "pos").collect()))
    order = recommend.ranked_order(F.col("score"))
    parts = ranking.range_ranked(df.where("userId = 7"), ["userId"], order, "pos", 20)
    assert sorted(r.pos for r in parts.collect()) == list(range(1, 5001))
    sizes = [r["count"] for r in df.where("userId = 7").repartitionByRange(20, "userId", *order).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 1000


@pytest.mark.parametrize("n", [0, 1, 499, 500, 750, 5000])
def test_sample_by_digits(spark, monkeypatch, n):
    """For every n the rows of a full sort, also if the last bucket is counted again and again."""
    monkeypatch.setattr(sampling, "DIGITS", 1)
    monkeypatch.setattr(sampling, "LAST_ROWS", 3)
    _, df = random_ratings(spark, 60, 60, 900)
    keyed = df.withColumn("k", sampling.sample_key(42, "userId", "movieId"))
    want = sorted(map(tuple, keyed.orderBy("k", "userId", "movieId").limit(n).drop("k").collect()))
    got = sampling.sample_exact(df, n, 42, "userId", "movieId")
    assert sorted(map(tuple, got.collect())) == want
    repeated = df.unionAll(df).unionAll(df.limit(1))
    assert sampling.sample_exact(repeated, n, 42, "userId", "movieId").count() == min(n, repeated.count())


def test_sample_sorts_no_table(spark):
    _, df = random_ratings(spark, 200, 200, 20_000)
    text = sampling.sample_exact(df, df.count() // 2, 42, "userId", "movieId")._jdf.queryExecution().executedPlan().toString()
    assert text.count("TakeOrderedAndProject") <= 1 and "Sort [" not in text.replace("TakeOrderedAndProject", "")
