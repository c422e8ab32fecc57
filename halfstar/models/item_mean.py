"""Item-mean model ("item-based" baseline)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_COUNT = 5


def item_means(train: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(movieId, mean, count) of items with at least ``min_count`` ratings."""
    items = train.groupBy("movieId").agg(F.avg("rating").alias("mean"), F.count(F.lit(1)).alias("count"))
    return items.where(F.col("count") >= min_count)


def item_mean_predict(train: DataFrame, pairs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Pairs with the item mean, or the global mean for rare and unknown items."""
    mean = train.agg(F.avg("rating")).scalar()
    return pairs.join(item_means(train, min_count), "movieId", "left").select(
        *pairs.columns, "count", F.coalesce("mean", mean).alias("prediction")
    )
