"""Schemas of the four input tables and of the run log."""

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Epoch seconds are stored as long, so they outlive 2038.
RATINGS = _schema(userId=T.IntegerType(), movieId=T.IntegerType(), rating=T.DoubleType(), timestamp=T.LongType())
MOVIES = _schema(movieId=T.IntegerType(), title=T.StringType(), genres=T.StringType())
TAGS = _schema(userId=T.IntegerType(), movieId=T.IntegerType(), tag=T.StringType(), timestamp=T.LongType())
LINKS = _schema(movieId=T.IntegerType(), imdbId=T.IntegerType(), tmdbId=T.IntegerType())

TABLES = {"ratings": RATINGS, "movies": MOVIES, "tags": TAGS, "links": LINKS}

# Metrics of one run, in report order.
ERROR_METRICS = ["rmse", "mae"]
TIME_METRICS = ["train_time", "prediction_time"]
RANKING_METRICS = ["precision_at_10", "recall_at_10", "ndcg_at_10", "map_at_10"]
RUN_METRICS = TIME_METRICS + ERROR_METRICS + RANKING_METRICS

RUNS = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("experiment", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("cores", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("n_users", T.LongType()),
    ]
    + [T.StructField(m, T.DoubleType()) for m in RUN_METRICS]
    + [
        T.StructField("n_factors", T.IntegerType()),
        T.StructField("n_epochs", T.IntegerType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("regParam", T.DoubleType()),
        T.StructField("maxIter", T.IntegerType()),
        T.StructField("blocks", T.IntegerType()),
        T.StructField("sample", T.LongType()),
    ]
)

# Runs that differ in any of these are never put together.
RUN_PARAMETERS = ["n_factors", "n_epochs", "rank", "regParam", "maxIter", "blocks", "sample"]
