"""The rating tables as views over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halfstar.operators import skew
from halfstar.sources.readers import latest_packed, recency_key


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """A customer rates a part: quantity 1-50 becomes a half-star, the latest line wins."""
    return dealt_ratings(spark, folder)[0]


def dealt_ratings(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """(ratings, the partitions they are hashed into by user). The latter is 0 for small tables, and where a user may have too many lines for a task."""
    given = table(spark, folder, "lineitem")
    lines = given.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").cast("int").alias("movieId"),
        F.unix_timestamp("l_shipdate").alias("timestamp"),
        (F.ceil(F.col("l_quantity") / 5) / F.lit(2.0)).alias("rating"),
    )
    buyers = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("int").alias("userId")
    )
    recency = {"l_orderkey": 18, "l_linenumber": 5}
    # A long, where the numbers of this table fit into one: half of what a decimal shuffles, and no arithmetic on it.
    found = recency_key(lines, recency)
    if found is not None:
        lines = lines.select("l_orderkey", "movieId", found[0].alias("key"))
    n = given.count()  # from the footers
    if n > skew.DEALT_FROM:
        # Bounded tasks: the aggregate before the shuffle holds all pairs of its task, and nearly all lines are pairs of their own.
        orders = buyers.count()
        hot = skew.most_rows(buyers, "userId", orders) * n > skew.TASK_ROWS * orders  # at so many lines an order
        lines, buyers = skew.dealt(lines, n, "l_orderkey"), skew.dealt(buyers, n, "l_orderkey").hint("shuffle_hash")
    joined, parts = lines.join(buyers, "l_orderkey"), 0 if n <= skew.DEALT_FROM or hot else skew.deals(n)
    if parts:  # One shuffle serves the aggregate and all that goes by user after it.
        joined = skew.dealt(joined.drop("l_orderkey") if found else joined, n, "userId")
    # Lines that agree in time, order and number differ in quantity at most, and the rating grows with it.
    return latest_packed(joined, recency, found and found[1]), parts


def movies(spark: SparkSession, folder: str) -> DataFrame:
    genres = F.concat(F.replace("p_name", F.lit(" "), F.lit("|")), F.lit("|"), "p_type")
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("int").alias("movieId"), F.col("p_name").alias("title"), genres.alias("genres")
    )


def tags(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").cast("int").alias("userId"),
        _props_k().alias("movieId"),
        F.col("event_type").alias("tag"),
        F.unix_timestamp("ts").alias("timestamp"),
    )


def links(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_partkey").cast("int").alias("movieId"))
        .agg(
            F.min("l_suppkey").cast("int").alias("imdbId"),
            F.max("l_suppkey").cast("int").alias("tmdbId"),
        )
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """A run log at scale: one event is one run."""
    is_svd = F.col("event_type") == "signup"
    # An index into a list, so that the JSON of a row is parsed once.
    masters = F.array(*[F.lit(f"local[{n}]") for n in (1, 2, 4, 8)])
    master = F.element_at(masters, (_props_k() % 4) + 1)
    rmse = F.lit(0.5) + (F.col("user_id") % 100) / F.lit(100.0)
    score = lambda modulus: (F.col("event_id") % modulus) / F.lit(100.0)
    return table(spark, folder, "events").select(
        F.col("event_id").alias("run_id"),
        F.when(is_svd, "SVD").otherwise("ALS").alias("model"),
        F.when(~is_svd, master).alias("cores"),
        F.col("value").alias("train_time"),
        (F.col("value") / 10).alias("prediction_time"),
        rmse.alias("rmse"),
        (F.lit(0.8) * rmse).alias("mae"),
        score(20).alias("precision_at_10"),
        score(25).alias("recall_at_10"),
        score(30).alias("ndcg_at_10"),
        score(15).alias("map_at_10"),
    )
