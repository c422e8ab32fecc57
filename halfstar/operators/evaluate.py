"""Error and ranking metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halfstar.functions.scalars import log_discount, ratio

RELEVANT_FROM = 4.0


def rmse() -> Column:
    return F.sqrt(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2)))


def mae() -> Column:
    return F.avg(F.abs(F.col("rating") - F.col("prediction")))


def error_metrics(predictions: DataFrame) -> DataFrame:
    """RMSE and MAE over rows of (rating, prediction), with the number of predicted rows."""
    return predictions.agg(
        rmse().alias("rmse"), mae().alias("mae"), F.count("prediction").alias("n_predicted")
    )


def compare_errors(first: DataFrame, second: DataFrame) -> DataFrame:
    """Errors of two models over the test pairs both of them predict."""
    key = ["userId", "movieId"]
    other = second.where(F.col("prediction").isNotNull()).select(*key, F.col("prediction").alias("other"))
    both = first.where(F.col("prediction").isNotNull()).join(other, key)
    gap = F.col("rating") - F.col("other")
    return both.agg(
        F.count(F.lit(1)).alias("n_common"),
        rmse().alias("rmse_first"), mae().alias("mae_first"),
        F.sqrt(F.avg(gap * gap)).alias("rmse_second"), F.avg(F.abs(gap)).alias("mae_second"),
    )


def prediction_coverage(train: DataFrame, test: DataFrame) -> DataFrame:
    """Share of test pairs whose user and item both occur in train."""
    known = test.join(train.select("userId").distinct(), "userId", "left_semi").join(
        train.select("movieId").distinct(), "movieId", "left_semi"
    )
    total = test.agg(F.count(F.lit(1))).scalar()
    return known.agg(F.count(F.lit(1)).alias("n_predicted")).select(
        "n_predicted", total.alias("n_test")
    ).withColumn("coverage", ratio(F.col("n_predicted"), F.col("n_test")))


def relevant_items(test: DataFrame, threshold: float = RELEVANT_FROM) -> DataFrame:
    return test.where(F.col("rating") >= threshold)


def inner_hits(recs: DataFrame, test: DataFrame, threshold: float = RELEVANT_FROM) -> DataFrame:
    """Recommendations that are relevant."""
    relevant = relevant_items(test, threshold).select("userId", "movieId")
    return recs.join(relevant, ["userId", "movieId"])


def join_user_truth(recs: DataFrame, test: DataFrame, threshold: float = RELEVANT_FROM) -> DataFrame:
    """Each recommendation with ``relevant`` and the user's ``n_relevant``; users without either drop out.

    Flags and counts stand in for the set of relevant items, so no set is
    collected.
    """
    relevant = relevant_items(test, threshold).select("userId", "movieId", F.lit(True).alias("hit"))
    counts = relevant.groupBy("userId").agg(F.count(F.lit(1)).alias("n_relevant"))
    return (
        recs.join(relevant, ["userId", "movieId"], "left")
        .join(counts, "userId")
        .withColumn("relevant", F.coalesce("hit", F.lit(False)))
        .drop("hit")
    )


def running_hits(judged: DataFrame) -> DataFrame:
    """Cumulative number of relevant items down each user's (k rows of) ranking."""
    down = Window.partitionBy("userId").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return judged.withColumn("hits", F.sum(F.col("relevant").cast("int")).over(down))


def ideal_dcg(n_relevant: Column, k: int) -> Column:
    """DCG of a perfect ranking, looked up in a list of k values."""
    sums = [math.fsum(1 / math.log2(i + 2) for i in range(upto + 1)) for upto in range(k)]
    return F.element_at(F.array(*[F.lit(s) for s in sums]), F.least(F.lit(k), n_relevant).cast("int"))


def user_ranking_metrics(recs: DataFrame, test: DataFrame, k: int = 10, threshold: float = RELEVANT_FROM) -> DataFrame:
    """Precision, recall, NDCG and average precision per evaluated user.

    Precision divides by k even for a shorter list; average precision divides by
    all relevant items, so it stays below 1 for a user with more than k.
    """
    # A row per user with the list, of k items at most, meets the user's relevant items: everything goes by user, nothing by pair.
    lists = recs.where(F.col("pos") <= k).groupBy("userId").agg(F.collect_list(F.struct("pos", "movieId")).alias("list"))
    judged = relevant_items(test, threshold).select("userId", "movieId").join(lists, "userId")
    places = F.transform(F.filter("list", lambda x: x.movieId == F.col("movieId")), lambda x: x.pos)
    # Items that miss fall away before the lists of hits are gathered.
    met = judged.select("userId", places.alias("places"))
    met = met.withColumn("places", F.when(F.size("places") > 0, F.col("places")))
    found = met.groupBy("userId").agg(
        F.count(F.lit(1)).alias("n_relevant"), F.array_sort(F.flatten(F.collect_list("places"))).alias("hits")
    )
    total = lambda of: F.aggregate(F.transform("hits", of), F.lit(0.0), lambda a, b: a + b)
    per_user = found.select(
        "userId", "n_relevant", F.size("hits").cast("long").alias("n_hits"),
        total(lambda pos: log_discount(pos)).alias("dcg"), total(lambda pos, i: (i + 1) / pos).alias("precision_sum"),
    )
    n_relevant = F.col("n_relevant")
    return per_user.select(
        "userId", "n_relevant", "n_hits",
        ratio(F.col("n_hits"), F.lit(k)).alias("precision"),
        ratio(F.col("n_hits"), n_relevant).alias("recall"),
        (F.col("dcg") / ideal_dcg(n_relevant, k)).alias("ndcg"),
        ratio(F.col("precision_sum"), n_relevant).alias("ap"),
    )


def macro_average(column: str) -> Column:
    """Mean over users, 0 if there is none."""
    return F.coalesce(F.avg(column), F.lit(0.0))


def ranking_report(recs: DataFrame, test: DataFrame, k: int = 10, threshold: float = RELEVANT_FROM) -> DataFrame:
    """All ranking metrics in one pass, with the number of users they average over."""
    return user_ranking_metrics(recs, test, k, threshold).agg(
        F.count(F.lit(1)).alias("n_users"),
        macro_average("precision").alias(f"precision_at_{k}"),
        macro_average("recall").alias(f"recall_at_{k}"),
        macro_average("ndcg").alias(f"ndcg_at_{k}"),
        macro_average("ap").alias(f"map_at_{k}"),
    )
