"""Popularity model: item count, average and damped score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halfstar.functions.scalars import popularity_weight
from halfstar.operators.recommend import unseen_topk


def popularity_model(train: DataFrame) -> DataFrame:
    """(movieId, count, avg_rating, popularity_score = avg * ln(1 + count))."""
    items = train.groupBy("movieId").agg(F.count(F.lit(1)).alias("count"), F.avg("rating").alias("avg_rating"))
    return items.withColumn("popularity_score", F.col("avg_rating") * popularity_weight(F.col("count")))


def popularity_scores(train: DataFrame) -> DataFrame:
    return popularity_model(train).select("movieId", F.col("popularity_score").alias("score"))


def popularity_recommend(train: DataFrame, users: DataFrame, k: int = 10, max_seen: int | None = None) -> DataFrame:
    """Top-k unseen items by popularity score."""
    return unseen_topk(popularity_scores(train), train, users, k, max_seen)


def popularity_predict(train: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with the item's average as the prediction; unknown items get the global mean."""
    items = popularity_model(train).select("movieId", "avg_rating")
    mean = train.agg(F.avg("rating")).scalar()
    return pairs.join(items, "movieId", "left").select(
        *pairs.columns, F.coalesce("avg_rating", mean).alias("prediction")
    )
