import random
import re

import pytest
from pyspark.sql import functions as F

from halfstar.models import popularity
from halfstar.operators import evaluate, recommend, sampling
from tests.fixtures import random_ratings, ratings, rows_of


def brute_topk(rows, scores, users, k):
    seen = {(u, m) for u, m, _, _ in rows}
    best = sorted(scores, key=lambda m: (-round(scores[m], 9), m))
    return sorted(
        (u, pos, m) for u in users for pos, m in enumerate([m for m in best if (u, m) not in seen][:k], 1)
    )


@pytest.mark.parametrize("head,heavy_seen", [(4096, 10**6), (2, 10**6), (2, 30), (1, 0), (16, 100)])
def test_unseen_topk(spark, head, heavy_seen):
    """Short heads force longer levels, low thresholds the item side; the rows stay those of brute force."""
    rows, df = random_ratings(spark, 25, 300, 700, hot_user=3)
    rows += [(99, m, 3.0, 1) for m in range(300)]  # has seen everything
    df = ratings(spark, rows)
    scores = {m: float((m * 37) % 11) for m in {r[1] for r in rows}}
    score_df = spark.createDataFrame(list(scores.items()), "movieId int, score double")
    users = spark.createDataFrame([(u,) for u in [*range(25), 99, 1000]], "userId int")
    got = recommend.unseen_topk(score_df, df, users, k=7, head=head, heavy_seen=heavy_seen)
    assert rows_of(got, "userId", "pos", "movieId") == brute_topk(rows, scores, [*range(25), 99, 1000], 7)


def test_too_many_heavy_users_to_list(spark, monkeypatch):
    from halfstar.operators import skew

    monkeypatch.setattr(skew, "MAX_LISTED", 3)
    rows, df = random_ratings(spark, 25, 300, 700, hot_user=3)
    scores = {m: float(m % 5) for m in {r[1] for r in rows}}
    score_df = spark.createDataFrame(list(scores.items()), "movieId int, score double")
    users = df.select("userId").distinct()
    got = recommend.unseen_topk(score_df, df, users, k=5, head=4, heavy_seen=5)
    assert rows_of(got, "userId", "pos", "movieId") == brute_topk(rows, scores, sorted({r[0] for r in rows}), 5)


def test_catalogue_counts(spark):
    rows, df = random_ratings(spark, 10, 40, 120)
    items = {r[1] for r in rows}
    users = spark.createDataFrame([(u,) for u in [*range(10), 77]], "userId int")
    got = rows_of(recommend.catalogue_counts(df, users), "userId", "n_items", "item_id_sum", "n_unseen", "unseen_id_sum")
    want = []
    for u in [*range(10), 77]:
        unseen = items - {m for v, m, _, _ in rows if v == u}
        want.append((u, len(items), sum(items), len(unseen), sum(unseen)))
    assert got == want


def test_rank_edges(spark):
    """One user without a relevant item, one with more than k, one with hits at 1, 3 and 10."""
    recs = [(u, p, 100 + p, 0.0) for u in (1, 2, 3, 4) for p in range(1, 11)]
    test = [(1, 101, 2.0, 0)]
    test += [(2, 100 + p, 5.0, 0) for p in range(1, 13)]  # twelve relevant items, ten of them recommended
    test += [(3, 101, 4.0, 0), (3, 103, 4.5, 0), (3, 110, 5.0, 0), (3, 999, 4.0, 0), (3, 105, 3.5, 0)]
    recs_df = spark.createDataFrame(recs, "userId int, pos int, movieId int, score double")
    got = {r.userId: r for r in evaluate.user_ranking_metrics(recs_df, ratings(spark, test)).collect()}
    assert set(got) == {2, 3}
    assert (got[2].precision, got[2].recall, got[2].ndcg) == (1.0, 10 / 12, pytest.approx(1.0))
    assert got[2].ap == pytest.approx(10 / 12)
    ideal = 1 + 1 / 1.584962500721156 + 1 / 2 + 1 / 2.321928094887362
    dcg = 1 + 1 / 2 + 1 / 3.4594316186372973
    assert (got[3].precision, got[3].recall) == (0.3, 0.75)
    assert got[3].ndcg == pytest.approx(dcg / ideal)
    assert got[3].ap == pytest.approx((1 + 2 / 3 + 3 / 10) / 4)


def test_report_of_nobody(spark):
    recs = spark.createDataFrame([], "userId int, pos int, movieId int, score double")
    row = evaluate.ranking_report(recs, ratings(spark, [(1, 1, 5.0, 0)])).first()
    assert row.asDict() == {
        "n_users": 0, "precision_at_10": 0.0, "recall_at_10": 0.0, "ndcg_at_10": 0.0, "map_at_10": 0.0
    }


# The ten published rows of (movieId, count, average, score).
PUBLISHED_POPULARITY = [
    (1, 34, 4.088235, 14.535099), (2, 17, 3.588235, 10.371334), (3, 10, 3.7, 8.872213), (4, 1, 3.0, 2.079442),
    (5, 12, 3.333333, 8.549831), (189043, 1, 2.5, 1.732868), (189333, 1, 4.0, 2.772589),
    (189547, 1, 1.0, 0.693147), (189713, 1, 2.5, 1.732868), (193567, 1, 3.0, 2.079442),
]


def test_popularity_anchor(spark):
    rows = []
    for movie, count, average, _ in PUBLISHED_POPULARITY:
        stars = round(average * count * 2)
        rows += [(u, movie, (stars // count + (u < stars % count)) / 2, 0) for u in range(count)]
    got = {r.movieId: r for r in popularity.popularity_model(ratings(spark, rows)).collect()}
    for movie, count, average, score in PUBLISHED_POPULARITY:
        assert got[movie]["count"] == count
        assert got[movie].avg_rating == pytest.approx(average, abs=1e-6)
        assert got[movie].popularity_score == pytest.approx(score, abs=1e-6)


def test_samples(spark):
    df = spark.range(1000).selectExpr("cast(id as int) userId", "cast(id * 7 % 1000 as int) movieId", "3.0D rating")
    a = rows_of(sampling.sample_exact(df, 100, 42, "userId", "movieId"), "userId")
    b = rows_of(sampling.sample_exact(df.repartition(13), 100, 42, "userId", "movieId"), "userId")
    assert a == b and len(a) == 100
    assert sampling.sample_exact(df, 5000, 42, "userId", "movieId").count() == 1000
    assert rows_of(sampling.sample_exact(df, 100, 43, "userId", "movieId"), "userId") != a
    for n, size in ((None, 1000), (-1, 1000), (0, 1000), (2000, 1000), (10, 10)):
        assert sampling.sample_users_exact(df, n).count() == size
    assert sampling.sample_users_about(df, -1).count() == 1000
    assert 150 < sampling.sample_users_about(df, 250).count() < 350
    assert sampling.sample_users_fraction(df, 0.0).isEmpty()
    capped = sampling.cap_candidates(df.withColumn("userId", F.col("userId") % 3), 5).groupBy("userId").count()
    assert {r["count"] for r in capped.collect()} == {5}


def test_rankings_are_judged_by_user(spark):
    """Recommendations and relevant items meet by user, so halves stored by user stay where they are; against the join of pairs."""
    rng = random.Random(8)
    recs = [(u, p, i, 1.0) for u in range(40) for p, i in enumerate(rng.sample(range(30), rng.randrange(0, 14)), 1)]
    recs += [(50, 1, 3, 1.0), (50, 4, 3, 1.0)]
    test = [(u, i, rng.choice([1.0, 4.0, 5.0]), 0) for u in range(5, 51) for i in rng.sample(range(30), 12)] + [(50, 3, 5.0, 0)]
    test = sorted({(u, i): (u, i, r, t) for u, i, r, t in test}.values())
    df, truth = spark.createDataFrame(recs, "userId int, pos int, movieId int, score double"), ratings(spark, test)
    hit = F.col("relevant").cast("int")
    judged = evaluate.running_hits(evaluate.join_user_truth(df.where("pos <= 10"), truth)).groupBy("userId", "n_relevant")
    plain = judged.agg(F.sum(hit), F.round(F.sum(hit / F.log2(F.col("pos") + 1)), 9), F.round(F.sum(hit * F.col("hits") / F.col("pos")), 9))
    got = evaluate.user_ranking_metrics(df, truth)
    ideal = evaluate.ideal_dcg(F.col("n_relevant"), 10)
    back = got.select("userId", "n_relevant", "n_hits", F.round(F.col("ndcg") * ideal, 9), F.round(F.col("ap") * F.col("n_relevant"), 9))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, plain.collect())) and back.count() > 30
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(userId" in plan and not re.search(r"hashpartitioning\(userId#\d+, movieId", plan)
