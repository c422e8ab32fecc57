"""Dataset statistics: counts, distributions, activity and popularity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halfstar.functions.scalars import popularity_weight, ratio


def rows() -> Column:
    return F.count(F.lit(1))


def table_counts(**tables: DataFrame) -> DataFrame:
    """Rows of each table as (table, n)."""
    parts = [df.agg(rows().alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionAll, parts)


def distinct_counts(ratings: DataFrame, tags: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct users, movies and tags as (entity, n)."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    rated = ratings.agg(count("userId").alias("users"), count("movieId").alias("movies"))
    tagged = tags.agg(count("tag").alias("tags"))
    return (
        rated.unpivot([], ["users", "movies"], "entity", "n").unionAll(tagged.unpivot([], ["tags"], "entity", "n"))
    )


def rating_summary(ratings: DataFrame) -> DataFrame:
    return ratings.agg(
        F.min("rating").alias("min_rating"),
        F.max("rating").alias("max_rating"),
        F.avg("rating").alias("avg_rating"),
        F.stddev_samp("rating").alias("std_rating"),
    )


def _shape(ratings: DataFrame) -> DataFrame:
    """Ratings, users and movies in one row."""
    return ratings.agg(
        rows().alias("n_ratings"),
        F.countDistinct("userId").alias("n_users"),
        F.countDistinct("movieId").alias("n_movies"),
    )


def avg_ratings_per_entity(ratings: DataFrame) -> DataFrame:
    return _shape(ratings).select(
        ratio(F.col("n_ratings"), F.col("n_users")).alias("avg_per_user"),
        ratio(F.col("n_ratings"), F.col("n_movies")).alias("avg_per_movie"),
    )


def rating_distribution(ratings: DataFrame) -> DataFrame:
    """Count and percentage per rating value."""
    counts = ratings.groupBy("rating").agg(rows().alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select("rating", "count", ratio(F.col("count") * F.lit(100.0), total).alias("percentage"))


def matrix_density(ratings: DataFrame) -> DataFrame:
    """Density is the filled share of the user x movie matrix, sparsity the empty one."""
    possible = F.col("n_users") * F.col("n_movies")
    filled = ratio(F.col("n_ratings") * F.lit(100.0), possible)
    return _shape(ratings).select(
        "n_users", "n_movies", "n_ratings",
        possible.alias("possible_ratings"),
        filled.alias("density_percent"),
        (F.lit(100.0) - filled).alias("sparsity_percent"),
    )


def user_activity(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("userId").agg(rows().alias("n"))


def item_popularity(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("movieId").agg(rows().alias("n"))


def activity_extremes(ratings: DataFrame) -> DataFrame:
    """Most active user and most popular movie; the smaller id wins a tie."""

    def top(counts: DataFrame, key: str, entity: str) -> DataFrame:
        best = F.max(F.struct("n", (-F.col(key)).alias("minus_id"))).alias("best")
        return counts.agg(best).select(
            F.lit(entity).alias("entity"), (-F.col("best.minus_id")).alias("id"), F.col("best.n").alias("n")
        )

    return top(user_activity(ratings), "userId", "user").unionAll(
        top(item_popularity(ratings), "movieId", "movie")
    )


def histogram(counts: DataFrame, bins: int, column: str = "n") -> DataFrame:
    """Equal-width histogram over [min, max], last bin closed: (bin, low, high, n_entities, mean_n, max_n).

    Empty bins are left out.
    """
    limits = counts.agg(
        F.struct(
            F.min(column).cast("double").alias("low"),
            F.max(column).cast("double").alias("high"),
            F.avg(column).alias("mean"),
        ).alias("limits")
    ).scalar()
    width = (F.col("limits.high") - F.col("limits.low")) / F.lit(float(bins))
    place = F.coalesce(F.floor(ratio(F.col(column) - F.col("limits.low"), width)), F.lit(0))
    return (
        counts.select(column, limits.alias("limits"))
        .select(F.least(F.lit(bins - 1), place).cast("int").alias("bin"), "limits")
        .groupBy("bin", "limits")
        .agg(rows().alias("n_entities"))
        .select(
            "bin",
            (F.col("limits.low") + F.col("bin") * width).alias("low"),
            (F.col("limits.low") + (F.col("bin") + 1) * width).alias("high"),
            "n_entities",
            F.col("limits.mean").alias("mean_n"),
            F.col("limits.high").alias("max_n"),
        )
    )


def genre_counts(movies: DataFrame, top: int = 10) -> DataFrame:
    """Movies per genre, most frequent first."""
    genres = movies.select(F.explode(F.split("genres", r"\|")).alias("genre")).where(F.col("genre") != "")
    return genres.groupBy("genre").agg(rows().alias("n")).orderBy(F.desc("n"), "genre").limit(top)


def top_items(ratings: DataFrame, n: int = 10) -> DataFrame:
    return item_popularity(ratings).orderBy(F.desc("n"), "movieId").limit(n)


def pivot_user_item(ratings: DataFrame, n_items: int) -> DataFrame:
    """Zero-filled wide matrix of all users by the ``n_items`` most popular items.

    One column per popularity rank (item_1, item_2, ...). A user's ratings of all
    other items are in ``other_n`` (their number) and ``other_sum``, so that none is
    left out.
    """
    top = top_items(ratings, n_items)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "movieId"))
    placed = F.broadcast(top.select("movieId", place.alias("place")))
    cells = [
        F.coalesce(F.max(F.when(F.col("place") == p, F.col("rating"))), F.lit(0.0)).alias(f"item_{p}")
        for p in range(1, n_items + 1)
    ]
    other = F.col("place").isNull()
    cells += [
        F.count_if(other).alias("other_n"), F.coalesce(F.sum(F.when(other, F.col("rating"))), F.lit(0.0)).alias("other_sum"),
    ]
    return ratings.join(placed, "movieId", "left").groupBy("userId").agg(*cells)
