"""Bias predictor: global mean plus damped user and item offsets (Koren 2010)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halfstar.functions.scalars import clip_rating, ratio
from halfstar.sources.writers import materialise

ITEM_DAMPING = 25.0
USER_DAMPING = 10.0


@dataclass(frozen=True)
class BiasModel:
    mean: DataFrame  # one row (mean)
    items: DataFrame  # (movieId, item_bias)
    users: DataFrame  # (userId, user_bias)

    def with_biases(self, pairs: DataFrame) -> DataFrame:
        """Pairs with ``base``, the unclipped prediction; unknown ids count as unbiased."""
        known = pairs.join(self.items, "movieId", "left").join(self.users, "userId", "left")
        zero = F.lit(0.0)
        base = self.mean.scalar() + F.coalesce("user_bias", zero) + F.coalesce("item_bias", zero)
        return known.select(*pairs.columns, base.alias("base"))

    def predict(self, pairs: DataFrame) -> DataFrame:
        """Every pair with a clipped prediction."""
        return self.with_biases(pairs).select(*pairs.columns, clip_rating(F.col("base")).alias("prediction"))


def fit_bias(train: DataFrame, item_damping: float = ITEM_DAMPING, user_damping: float = USER_DAMPING) -> BiasModel:
    """Both offsets are sums over counts, so hot users and items are reduced before their shuffle."""
    sums = train.groupBy("movieId").agg(F.sum("rating").alias("s"), F.count(F.lit(1)).alias("n"))
    # From the item sums, so that it does not read train again.
    mean = sums.agg(ratio(F.sum("s"), F.sum("n")).alias("mean"))
    mu = mean.scalar()
    items = sums.select(
        "movieId", ((F.col("s") - F.col("n") * mu) / (F.col("n") + F.lit(item_damping))).alias("item_bias")
    )
    rest = train.join(items, "movieId").groupBy("userId").agg(
        F.sum(F.col("rating") - F.col("item_bias")).alias("s"), F.count(F.lit(1)).alias("n")
    )
    users = rest.select(
        "userId", ((F.col("s") - F.col("n") * mu) / (F.col("n") + F.lit(user_damping))).alias("user_bias")
    )
    return BiasModel(mean, items, users)


def stored_bias(model: BiasModel) -> BiasModel:
    """The same model with its tables written to the scratch folder, so that no later job computes them again."""
    mean = model.items.sparkSession.createDataFrame([model.mean.first()], model.mean.schema)
    return BiasModel(mean, materialise(model.items, "item-bias"), materialise(model.users, "user-bias"))


def bias_table(model: BiasModel) -> DataFrame:
    """The model as rows of (side, id, bias)."""
    return model.users.select(F.lit("user").alias("side"), F.col("userId").alias("id"), F.col("user_bias").alias("bias")).unionAll(
        model.items.select(F.lit("item").alias("side"), F.col("movieId").alias("id"), F.col("item_bias").alias("bias"))
    )
