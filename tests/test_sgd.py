"""Stratified gradient descent against going through the ratings one by one."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from halfstar.models import sgd
from halfstar.operators import evaluate
from halfstar.operators.factors import gaussian
from halfstar.session import scratch_base
from halfstar.sources.writers import discard, materialise
from tests.fixtures import planted, random_ratings, ratings


def one_by_one(rows, dims, epochs, rate=0.005, reg=0.02, seed=42, std=0.1):
    """rows of (user, item, rating) in the order of training."""
    mean = sum(r for *_, r in rows) / len(rows)
    draw = lambda ids, side: {i: v * std for i, v in zip(ids, gaussian(np.array(ids), dims, side, seed))}
    p, q = draw(sorted({u for u, *_ in rows}), 0), draw(sorted({i for _, i, _ in rows}), 1)
    bu, bi = dict.fromkeys(p, 0.0), dict.fromkeys(q, 0.0)
    for _ in range(epochs):
        for u, i, r in rows:
            error = r - (mean + bu[u] + bi[i] + float(p[u] @ q[i]))
            bu[u], bi[i] = bu[u] + rate * (error - reg * bu[u]), bi[i] + rate * (error - reg * bi[i])
            p[u], q[i] = p[u] + rate * (error * q[i] - reg * p[u]), q[i] + rate * (error * p[u] - reg * q[i])
    return p, q, bu, bi


def test_equals_the_loop(spark):
    rows, df = random_ratings(spark, 30, 25, 300, hot_user=2)
    u, i, r = (np.array([x[c] for x in rows]) for c in (0, 1, 2))
    order = sgd.train_order(u, i, r, 42)
    p, q, bu, bi = one_by_one([(int(u[k]), int(i[k]), float(r[k])) for k in order], 6, 4)
    model = sgd.sgd_fit(df, 6, 4, blocks=1)
    for table, factors, bias in ((model.users, p, bu), (model.items, q, bi)):
        got = {x.id: x for x in table.collect()}
        assert got.keys() == factors.keys()
        for k, x in got.items():
            assert x.bias == pytest.approx(bias[k], abs=1e-12) and np.allclose(x.features, factors[k], atol=1e-12)


def test_waves_have_no_common_user_or_item():
    rng = np.random.default_rng(3)
    u, i = rng.integers(0, 20, 500), rng.integers(0, 30, 500)
    wave = sgd.waves(u, i)
    for w in range(wave.max() + 1):
        assert len(set(u[wave == w])) == len(set(i[wave == w])) == (wave == w).sum()
    for a in range(500):  # ratings that share a user or item keep their order
        later = np.nonzero((u[a + 1 :] == u[a]) | (i[a + 1 :] == i[a]))[0] + a + 1
        assert (wave[later] > wave[a]).all()


def test_learns_in_strata_and_repeats(spark):
    train, test = planted(spark)
    train, test = train.cache(), test.cache()
    base = evaluate.error_metrics(test.withColumn("prediction", train.agg(F.avg("rating")).scalar())).first().rmse
    settings = {"n_factors": 4, "n_epochs": 12, "rate": 0.03, "blocks": 3}
    model = sgd.sgd_fit(train, **settings)
    predicted = model.predict(test)
    assert evaluate.error_metrics(predicted).first().rmse < 0.7 * base
    assert predicted.count() == test.count() and predicted.where(~F.col("prediction").between(0.5, 5.0)).isEmpty()
    again = sgd.sgd_fit(train.repartition(5), **settings)
    assert again.predict(test).exceptAll(predicted).where("prediction is null").isEmpty()
    a, b = ({r.id: r for r in m.users.collect()} for m in (model, again))
    assert all(np.allclose(a[k].features, b[k].features, atol=1e-9) for k in a)
    users = test.select("userId").distinct().where("userId < 15")
    got = model.recommend_unseen(train, users, k=5).cache()
    assert got.join(train, ["userId", "movieId"], "left_semi").isEmpty() and got.count() == 5 * users.count()


def test_a_hot_item_is_in_every_block(spark):
    """One item with half of all ratings: its copies are averaged, and its cells are even."""
    rows = [(u, 0 if k % 2 else 1 + (u * 7 + k) % 40, float(1 + (u + k) % 5), k) for u in range(400) for k in range(2)]
    df = ratings(spark, rows)
    held = sgd.cells(df, 4, [], [0], 1)
    sizes = [r["count"] for r in held.groupBy("ub", "ib").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2.5 * sum(sizes) / 16
    model = sgd.sgd_fit(df, 3, 3, blocks=4)
    assert {r["count"] for r in model.items.groupBy("id").count().collect()} == {1}
    assert model.items.count() == 41 and model.users.count() == 400


def test_goes_on_from_a_model(spark):
    _, df = random_ratings(spark, 20, 20, 150)
    model = sgd.sgd_fit(df, 4, 2)
    one = df.where("userId = 3").limit(1).cache()
    row = one.first()
    after, want = sgd.sgd_fit(one, 4, 1, start=model), sgd.sgd_step(model, one, 0.005, 0.02).first()
    got = after.users.where(F.col("id") == row.userId).first()
    assert got.bias == pytest.approx(want.user_bias) and got.features == pytest.approx(want.user_features)
    got = after.items.where(F.col("id") == row.movieId).first()
    assert got.bias == pytest.approx(want.item_bias) and got.features == pytest.approx(want.item_features)
    assert after.users.count() == model.users.count() and after.mean == model.mean


def test_strata_shuffle_nothing_and_equal_the_loop(spark):
    """Two blocks: a stratum reads the files of its blocks in two tasks, and all strata are the loop over their cells in turn."""
    rows, df = random_ratings(spark, 30, 25, 300)
    held = sgd.cells(df, 2, [], [], 42)
    state = held.selectExpr("'user' as side", "ub as block", "userId as id", "1L as n", "cast(null as double) as bias", "cast(null as array<double>) as features")
    one = sgd._stratum(state, held, 0, 2, 5, 1, (3.0, 0.005, 0.02, 0.1, 42))
    stratum = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in stratum and one.rdd.getNumPartitions() == 2
    cells = held.orderBy("stratum", "task", "wave").collect()
    p, q, bu, bi = one_by_one([(r.userId, r.movieId, r.rating) for r in cells], 5, 3)
    model = sgd.sgd_fit(df, 5, 3, blocks=2)
    for table, factors, bias in ((model.users, p, bu), (model.items, q, bi)):
        got = {x.id: x for x in table.collect()}
        assert got.keys() == factors.keys()
        for k, x in got.items():
            assert x.bias == pytest.approx(bias[k], abs=1e-12) and np.allclose(x.features, factors[k], atol=1e-12)


def test_only_the_last_factors_are_kept(spark):
    """Nine strata write their factors; what a later one has replaced, and the cells, are deleted, and the model isn't."""
    _, df = random_ratings(spark, 30, 25, 300, hot_user=2)
    held = lambda: {f for f in os.listdir(scratch_base(spark)) if f.startswith(("factors-", "cells-"))}
    before = held()
    model = sgd.sgd_fit(df, 4, 3, blocks=3)
    assert held() == before
    assert model.predict(df).where("prediction is not null").count() == df.count()
    other = materialise(df, "other")
    discard(other.where("userId = 3").select("movieId"))
    assert not any(f.startswith("other-") for f in os.listdir(scratch_base(spark)))


def test_discard_stays_in_the_scratch_folder(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/kept")
    discard(spark.read.parquet(f"{tmp_path}/kept"))
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 5


def test_a_state_is_packed_and_unpacked(spark):
    rows = [("user" if i % 3 else "item", i % 2, i, 1 + i, i / 7, [i / 3, -float(i)] if i % 5 else []) for i in range(60)]
    df = spark.createDataFrame(rows, "side string, block int, id int, n long, bias double, features array<double>")
    full = df.where("id % 5 > 0")
    assert sorted(map(tuple, sgd.unpacked_state(sgd.packed_state(full), 2).collect())) == sorted(map(tuple, full.collect()))
    assert sgd.packed_state(df.coalesce(1)).count() == 8  # by side, block, and whether there are factors


def test_cold_ids_and_nothing(spark):
    _, df = random_ratings(spark, 10, 10, 60)
    model = sgd.sgd_fit(df, 3, 2)
    b_u = {r.id: r.bias for r in model.users.collect()}
    some = min(b_u)
    got = {(r.userId, r.movieId): r.prediction for r in model.predict(ratings(spark, [(some, 999, 3.0, 0), (998, 999, 3.0, 0)])).collect()}
    assert got[998, 999] == pytest.approx(model.mean) and got[some, 999] == pytest.approx(model.mean + b_u[some])
    empty = sgd.sgd_fit(df.limit(0), 3, 2)
    assert empty.predict(df).count() == df.count()
