import math

import pytest
from pyspark.sql import functions as F

from halfstar.models import als, bias, item_mean, user_knn
from halfstar.operators import evaluate, factors
from tests.fixtures import planted, random_ratings, ratings, rows_of


@pytest.fixture(scope="module")
def low_rank(spark):
    train, test = planted(spark)
    train, test = train.cache(), test.cache()
    yield train, test
    train.unpersist(), test.unpersist()


def error(predictions):
    return evaluate.error_metrics(predictions).first().rmse


def mean_error(train, test):
    return error(test.withColumn("prediction", train.agg(F.avg("rating")).scalar()))


def test_als_learns_and_repeats(low_rank):
    train, test = low_rank
    model = als.als_fit(train, rank=5, max_iter=10)
    predicted = als.als_predict(model, test)
    assert error(predicted) < 0.6 * mean_error(train, test)
    again = als.als_fit(train, rank=5, max_iter=10)
    assert error(als.als_predict(again, test)) == pytest.approx(error(predicted), abs=1e-6)
    dots = als.factor_predict(model.userFactors, model.itemFactors, predicted)
    assert dots.where(F.abs(F.col("dot") - F.col("prediction")) > 1e-4).isEmpty()


def test_residual_mf_learns(low_rank):
    train, test = low_rank
    model = als.residual_mf_fit(train, n_factors=5, n_epochs=10, reg=0.05)
    predicted = model.predict(test)
    assert error(predicted) < 0.6 * mean_error(train, test)
    assert predicted.where(~F.col("prediction").between(0.5, 5.0)).isEmpty()
    assert predicted.count() == test.count()


@pytest.mark.parametrize("block", [4096, 7])
def test_als_recommends_unseen(spark, low_rank, block, monkeypatch):
    monkeypatch.setattr(factors, "SCORED_USERS", block)
    monkeypatch.setattr(factors, "SCORED_ITEMS", block)
    train, test = low_rank
    model = als.als_fit(train, rank=3, max_iter=3)
    users = test.select("userId").distinct()
    got = als.als_recommend_unseen(model, train, users, k=5)
    check_unseen(got, train, users, model.userFactors, model.itemFactors, 5)


def check_unseen(got, train, users, user_factors, item_factors, k):
    """Against exhaustive scoring; float ties may swap neighbours, so scores are compared."""
    pf = {r.id: r.features for r in user_factors.collect()}
    qf = {r.id: r.features for r in item_factors.collect()}
    seen = set(rows_of(train, "userId", "movieId"))
    mine = {}
    for u, pos, m, s in rows_of(got, "userId", "pos", "movieId", "score"):
        assert (u, m) not in seen
        mine.setdefault(u, []).append(s)
    for (u,) in rows_of(users, "userId"):
        scores = sorted((sum(a * b for a, b in zip(pf[u], q)) for m, q in qf.items() if (u, m) not in seen), reverse=True)
        assert mine[u] == pytest.approx(scores[:k], abs=1e-4)


def test_residual_mf_recommends_by_prediction(low_rank):
    train, test = low_rank
    model = als.residual_mf_fit(train, n_factors=3, n_epochs=5)
    users = test.select("userId").distinct().where("userId < 20")
    got = model.recommend_unseen(train, users, k=5).cache()
    assert {r["count"] for r in got.groupBy("userId").count().collect()} == {5}
    assert got.join(train, ["userId", "movieId"], "left_semi").isEmpty()
    # No unseen item that was left out scores above the last one taken.
    everything = users.join(train.select("movieId").distinct(), how="cross").join(train, ["userId", "movieId"], "left_anti")
    taken = model.predict(got).groupBy("userId").agg(F.min("prediction").alias("worst"))
    left = model.predict(everything.join(got, ["userId", "movieId"], "left_anti"))
    assert left.join(taken, "userId").where(F.col("prediction") > F.col("worst") + 1e-4).isEmpty()


def test_cold_pairs(spark, low_rank):
    train, _ = low_rank
    pairs = ratings(spark, [(0, 0, 3.0, 0), (0, 9999, 3.0, 0), (9999, 0, 3.0, 0), (9999, 9999, 3.0, 0)])
    assert rows_of(als.als_predict(als.als_fit(train, max_iter=1), pairs), "userId", "movieId") == [(0, 0)]
    model = bias.fit_bias(train)
    got = {(r.userId, r.movieId): r.prediction for r in model.predict(pairs).collect()}
    mean = train.agg(F.avg("rating")).first()[0]
    b_u = {r.userId: r.user_bias for r in model.users.collect()}
    b_i = {r.movieId: r.item_bias for r in model.items.collect()}
    assert got[9999, 9999] == pytest.approx(mean)
    assert got[0, 9999] == pytest.approx(mean + b_u[0])
    assert got[9999, 0] == pytest.approx(mean + b_i[0])
    full = als.residual_mf_fit(train, n_factors=2, n_epochs=1).predict(pairs)
    assert {(r.userId, r.movieId): r.prediction for r in full.collect()}[9999, 9999] == pytest.approx(mean)


def test_bias_by_hand(spark):
    train = ratings(spark, [(1, 1, 5.0, 0), (1, 2, 4.0, 0), (2, 1, 3.0, 0)])
    model = bias.fit_bias(train, item_damping=1, user_damping=2)
    assert dict(rows_of(model.items, "movieId", "item_bias")) == pytest.approx({1: 0.0, 2: 0.0})
    assert dict(rows_of(model.users, "userId", "user_bias")) == pytest.approx({1: 0.25, 2: -1 / 3})


def test_item_mean_fallback(spark):
    rows = [(u, 1, 4.0, 0) for u in range(5)] + [(u, 2, 1.0, 0) for u in range(4)]
    got = item_mean.item_mean_predict(ratings(spark, rows), ratings(spark, [(9, 1, 3.0, 0), (9, 2, 3.0, 0), (9, 3, 3.0, 0)]))
    mean = (5 * 4 + 4) / 9
    assert [r.prediction for r in got.orderBy("movieId").collect()] == pytest.approx([4.0, mean, mean])


def brute_neighbours(rows, n):
    vectors = {}
    for u, m, r, _ in rows:
        vectors.setdefault(u, {})[m] = r
    norm = {u: math.sqrt(sum(r * r for r in v.values())) for u, v in vectors.items()}
    result = []
    for u, mine in vectors.items():
        found = []
        for o, theirs in vectors.items():
            dot = sum(r * theirs[m] for m, r in mine.items() if m in theirs)
            if o != u and dot > 0:
                found.append((-dot / (norm[u] * norm[o]), o))
        result += [(u, pos, o, -s) for pos, (s, o) in enumerate(sorted(found)[:n], 1)]
    return sorted(result)


@pytest.mark.parametrize("block_users,heavy_rows", [(1024, 10**6), (7, 10**6), (7, 40), (3, 0)])
def test_user_knn(spark, block_users, heavy_rows):
    """One block, many blocks, a heavy user, only heavy users: always brute force's neighbours."""
    rows, df = random_ratings(spark, 40, 120, 500, hot_user=3)
    got = user_knn.user_knn_similarity(df, n=6, block_users=block_users, heavy_rows=heavy_rows)
    want = brute_neighbours(rows, 6)
    found = rows_of(got, "userId", "pos", "neighbourId", "similarity")
    assert [r[:3] for r in found] == [r[:3] for r in want]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in want])


def test_user_knn_in_slices_and_small_chunks(spark, monkeypatch):
    """Blocks cut by partner, and an item's raters in several chunks."""
    rows, df = random_ratings(spark, 40, 20, 400)
    monkeypatch.setattr(user_knn, "CHUNK_RATERS", 3)
    got = user_knn.user_knn_similarity(df, n=6, block_users=7, task_raters=40)
    want = brute_neighbours(rows, 6)
    found = rows_of(got, "userId", "pos", "neighbourId", "similarity")
    assert [r[:3] for r in found] == [r[:3] for r in want] and [r[3] for r in found] == pytest.approx([r[3] for r in want])


def test_products_in_runs_of_users(spark, monkeypatch):
    _, df = random_ratings(spark, 40, 20, 400)
    pdf = df.toPandas()
    own, raters = pdf.sort_values(["userId", "movieId"]), pdf.sort_values(["movieId", "userId"])
    triples = lambda: sorted(t for a, b, x in user_knn._products(own, raters) for t in zip(a.tolist(), b.tolist(), x.tolist()))
    whole = triples()
    monkeypatch.setattr(user_knn, "CHUNK_PRODUCTS", 5)
    assert triples() == whole and len(list(user_knn._products(own, raters))) > 10


def test_neighbours_move_no_more_than_co_rated_pairs(spark):
    """Rows that are shuffled to find neighbours, beside pairs of raters of an item, on two sizes."""
    for users, items, n in ((200, 400, 1500), (800, 400, 6000)):
        _, df = random_ratings(spark, users, items, n)
        pairs = df.groupBy("movieId").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
        assert user_knn.meetings(df, 16).where("not own").count() <= pairs


def test_raters_of_an_item_are_sent_in_lists(spark, monkeypatch):
    """A row per list and block that meets it, not one per rater, and tasks by the raters."""
    rows, df = random_ratings(spark, 200, 20, 2000)
    met = user_knn.meetings(df, 16).where("not own")
    assert met.count() <= 20 * 13 and met.agg(F.sum(F.size("users"))).first()[0] > 10 * met.count()
    monkeypatch.setattr(user_knn, "DEALT_RATERS", 5000)
    got = user_knn.user_knn_similarity(df, n=6, block_users=16)
    assert [r[:3] for r in rows_of(got, "userId", "pos", "neighbourId")] == [r[:3] for r in brute_neighbours(rows, 6)]


@pytest.mark.parametrize("listed_items", [0, 8, 1000])
def test_user_knn_predictions(spark, listed_items):
    """Short and long lists of items: always the plain loop's predictions, for pairs asked twice, too."""
    rows, train = random_ratings(spark, 40, 30, 400, hot_user=3)
    asked = random_ratings(spark, 44, 33, 300, seed=2)[0]
    pairs = ratings(spark, asked + asked[:20])
    neighbours = user_knn.user_knn_similarity(train, n=6)
    near, given = {}, {(u, m): x for u, m, x, _ in rows}
    for r in neighbours.collect():
        near.setdefault(r.userId, []).append((r.neighbourId, r.similarity))
    mean = lambda xs: sum(xs) / len(xs)
    want = []
    for u, m, _, _ in asked + asked[:20]:
        votes = [(s, given[v, m]) for v, s in near.get(u, []) if (v, m) in given]
        own = [x for (w, _), x in given.items() if w == u]
        want.append((u, m, sum(s * x for s, x in votes) / sum(s for s, _ in votes) if votes else mean(own or list(given.values()))))
    got = rows_of(user_knn.user_knn_predict(train, pairs, neighbours, listed_items), "userId", "movieId", "prediction")
    assert [r[:2] for r in got] == [r[:2] for r in sorted(want)] and [r[2] for r in got] == pytest.approx([r[2] for r in sorted(want)])


def test_predictions_shuffle_a_row_per_neighbour(spark, halves):
    train, pairs = halves
    near = spark.createDataFrame([(1, 2, 0.5)], user_knn.NEIGHBOUR)
    text = user_knn.user_knn_predict(train, pairs, near)._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" in text


def test_user_knn_fallbacks(spark):
    train = ratings(spark, [(1, 1, 4.0, 0), (1, 2, 2.0, 0), (2, 1, 4.0, 0), (2, 3, 5.0, 0), (3, 9, 1.0, 0)])
    neighbours = user_knn.user_knn_similarity(train)
    pairs = ratings(spark, [(1, 3, 3.0, 0), (1, 9, 3.0, 0), (8, 1, 3.0, 0)])
    got = {(r.userId, r.movieId): r.prediction for r in user_knn.user_knn_predict(train, pairs, neighbours).collect()}
    assert got == pytest.approx({(1, 3): 5.0, (1, 9): 3.0, (8, 1): 16 / 5})


def test_multi_seed(spark, low_rank):
    from halfstar.plans import runs

    train, test = low_rank
    users = test.select("userId").distinct()
    models, log = runs.multi_seed_als(train, test, n_runs=3, rank=3, max_iter=2, users=users)
    rows = log.orderBy("run_id").collect()
    assert len({r.rmse for r in rows}) == 3 and all(r.train_time > 0 and 0 <= r.ndcg_at_10 <= 1 for r in rows)
    middle = sorted(rows, key=lambda r: r.rmse)[1]
    assert runs.pick_median_model(models, log) is models[middle.run_id]
    _, svd = runs.multi_seed_biased_mf(train, test, n_runs=1, n_factors=2, n_epochs=1, users=users)
    assert svd.first().model == "SVD" and svd.first().n_factors == 2


def test_blocks_follow_the_rows_alone(spark, low_rank, monkeypatch):
    train, _ = low_rank
    monkeypatch.setattr(als, "BLOCK_WORK", 10_000)
    blocks = als.als_blocks(train, 2)
    assert blocks > 1 and blocks == als.als_blocks(train.repartition(2), 2) == als.als_blocks(train.repartition(16), 2) < als.als_blocks(train, 4)
    factors = [
        {r.id: tuple(r.features) for r in als.als_fit(part, rank=2, max_iter=1).userFactors.collect()}
        for part in (train, train.repartition(3))
    ]
    assert factors[0].keys() == factors[1].keys()
    assert all(abs(a - b) < 1e-3 for u in factors[0] for a, b in zip(factors[0][u], factors[1][u]))


def test_everything_seen(spark):
    train = ratings(spark, [(u, m, float(1 + (u * m) % 5), 0) for u in range(6) for m in range(8) if u == 0 or m % 2])
    model = als.als_fit(train, rank=2, max_iter=2)
    got = als.als_recommend_unseen(model, train, train.select("userId").distinct(), k=3)
    assert {r.userId for r in got.collect()} == {1, 2, 3, 4, 5}


def test_neighbours_without_null_ratings(spark):
    rows = [(u, m, float(1 + (u + m) % 5), 0) for u in range(5) for m in range(6)]
    clean = ratings(spark, rows)
    holes = clean.unionAll(clean.limit(1).selectExpr("userId", "77 as movieId", "cast(null as double) as rating", "timestamp"))
    pairs = lambda df: sorted((r.userId, r.neighbourId, round(r.similarity, 9)) for r in user_knn.user_knn_similarity(df).collect())
    assert pairs(holes) == pairs(clean)
