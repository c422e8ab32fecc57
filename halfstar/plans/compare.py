"""Comparison of configurations: speed-up, efficiency, scores, cost and verdicts.

Every function takes aggregated results (one row per configuration, with
``num_cores``) and optional ``by`` columns, such as an experiment id, within
which it compares. Group facts are aggregates joined back, never windows over
everything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from halfstar.functions.scalars import (
    accuracy_winner, degradation_verdict, error_propagation, linear_verdict, metric_default, model_label, ratio,
)

# The compared metrics and their weights in the overall score.
SCORE_WEIGHTS = {
    "rmse": 0.25, "mae": 0.15, "train_time": 0.15, "prediction_time": 0.10,
    "precision_at_10": 0.15, "recall_at_10": 0.10, "ndcg_at_10": 0.10,
}
LOWER_IS_BETTER = {"rmse", "mae", "train_time", "prediction_time"}
COMPARED = list(SCORE_WEIGHTS)
EPSILON = 1e-8


def is_svd() -> Column:
    return F.col("model") == "SVD"


def is_als() -> Column:
    return F.col("model") == "ALS"


def attach(df: DataFrame, facts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Add the facts of each ``by`` group to its rows; without ``by``, facts is one row used as a scalar."""
    if by:
        return df.join(facts, list(by), "left")
    names = facts.columns
    one = facts.select(F.struct(*names).alias("one")).scalar()
    return df.select("*", one.alias("_one")).select(*df.columns, *[F.col(f"_one.{n}").alias(n) for n in names])


def filter_by_model(results: DataFrame, model: str) -> DataFrame:
    return results.where(F.col("model") == model)


def filter_positive_cores(results: DataFrame) -> DataFrame:
    return results.where(is_als() & (F.col("num_cores") > 0))


def lookup_at_cores(column: str, num_cores: int) -> Column:
    """Aggregate: ``column`` at a core count, 0 if it was not run."""
    return F.coalesce(F.max(F.when(F.col("num_cores") == num_cores, F.col(column))), F.lit(0.0))


def project_existing(results: DataFrame, wanted: list[str]) -> DataFrame:
    return results.select(*[c for c in wanted if c in results.columns])


def round_summary(results: DataFrame, digits: int = 4) -> DataFrame:
    """Every numeric column rounded, the others as they are."""
    return results.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, NumericType) else F.col(f.name)
            for f in results.schema.fields
        ]
    )


def broadcast_baseline(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """Each row with the SVD times and the one-core ALS train time of its group; NULL where not run."""
    one_core = is_als() & (F.col("num_cores") == 1)
    facts = results.groupBy(*by).agg(
        F.min(F.when(is_svd(), F.col("train_time"))).alias("svd_train_time"),
        F.min(F.when(is_svd(), F.col("prediction_time"))).alias("svd_prediction_time"),
        F.min(F.when(one_core, F.col("train_time"))).alias("als_1core_train_time"),
    )
    return attach(results, facts, by)


def with_speedups(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """Speed-up and efficiency against SVD and, for ALS, against its own one-core run."""
    cores = F.col("num_cores")
    vs_svd = ratio(F.col("svd_train_time"), F.col("train_time"))
    on_prediction = ratio(F.col("svd_prediction_time"), F.col("prediction_time"))
    pure = F.when(is_als(), ratio(F.col("als_1core_train_time"), F.col("train_time")))
    return broadcast_baseline(results, by).select(
        *results.columns,
        F.when(is_svd(), F.lit(1.0)).otherwise(vs_svd).alias("speedup_vs_svd"),
        pure.alias("speedup_pure_spark"),
        ratio(pure, cores).alias("efficiency_pure_spark"),
        vs_svd.alias("speedup_train"),
        ratio(vs_svd, cores).alias("efficiency_train"),
        on_prediction.alias("speedup_prediction"),
        ratio(on_prediction, cores).alias("efficiency_prediction"),
    )


def summary_performance(results: DataFrame) -> DataFrame:
    timed = ["train_time", "prediction_time", "rmse", "mae"]
    return round_summary(project_existing(results, ["model", "num_cores", *timed, *[f"{c}_std" for c in timed]]))


def summary_ranking(results: DataFrame) -> DataFrame | None:
    """Ranking metrics, or None unless all of them are there."""
    wanted = ["model", "num_cores", "precision_at_10", "recall_at_10", "ndcg_at_10", "map_at_10"]
    return round_summary(results.select(*wanted)) if set(wanted) <= set(results.columns) else None


def summary_scalability(results: DataFrame, als_only: bool = True) -> DataFrame:
    """Own speed-up of ALS, or the speed-up of all rows against SVD."""
    if not als_only:
        return round_summary(project_existing(results, ["model", "num_cores", "speedup_train", "efficiency_train"]))
    wanted = [
        "model", "num_cores", "train_time", "rmse", "precision_at_10", "speedup_pure_spark", "efficiency_pure_spark",
    ]
    return round_summary(project_existing(results.where(is_als()), wanted))


def metric_matrix(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """Wide: one row per model label, one column per compared metric; an absent metric counts as 0."""
    value = lambda m: metric_default(F.col(m)) if m in results.columns else F.lit(0.0)
    return results.select(
        *by, model_label(F.col("model"), F.col("num_cores")).alias("label"), *[value(m).alias(m) for m in COMPARED]
    )


def to_long(matrix: DataFrame, by: list[str] = (), value: str = "value") -> DataFrame:
    return matrix.unpivot([*by, "label"], COMPARED, "metric", value)


def minmax_normalise(matrix: DataFrame, by: list[str] = ()) -> DataFrame:
    """Every metric scaled to 0-1 over the rows of its group, 1 being best."""
    limits = [f(m).alias(f"{name}_{m}") for m in COMPARED for f, name in ((F.min, "low"), (F.max, "high"))]

    def scaled(m: str) -> Column:
        low, high = F.col(f"low_{m}"), F.col(f"high_{m}")
        share = (F.col(m) - low) / (high - low + F.lit(EPSILON))
        return ((F.lit(1.0) - share) if m in LOWER_IS_BETTER else share).alias(m)

    return attach(matrix, matrix.groupBy(*by).agg(*limits), by).select(*by, "label", *[scaled(m) for m in COMPARED])


def overall_score(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """Weighted sum of the normalised metrics, and whether it is the best of its group."""
    normal = minmax_normalise(metric_matrix(results, by), by)
    total = reduce(lambda a, b: a + b, [F.col(m) * F.lit(w) for m, w in SCORE_WEIGHTS.items()])
    scores = normal.select(*by, "label", total.alias("overall_score"))
    best = scores.groupBy(*by).agg(F.min_by("label", F.struct(-F.col("overall_score"), F.col("label"))).alias("best"))
    return attach(scores, best, by).select(*by, "label", "overall_score", (F.col("label") == F.col("best")).alias("is_best"))


def cost_benefit(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """Cost = cores x train time, benefit = 1/RMSE; ``is_best`` marks the ALS row with the highest ratio."""
    cost = F.col("num_cores") * F.col("train_time")
    benefit = ratio(F.lit(1.0), F.col("rmse"))
    rated = results.select(
        *by, "model", "num_cores", cost.alias("cost"), benefit.alias("benefit"), ratio(benefit, cost).alias("ratio")
    )
    best = (
        rated.where(is_als())
        .groupBy(*by)
        .agg(F.min_by("num_cores", F.struct(-F.col("ratio"), F.col("num_cores"))).alias("best_cores"))
    )
    is_best = is_als() & (F.col("num_cores") == F.col("best_cores"))
    return attach(rated, best, by).select(*rated.columns, F.coalesce(is_best, F.lit(False)).alias("is_best"))


def ideal_scaling(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """ALS rows with ``ideal_time``: the train time at the fewest cores, divided by the cores."""
    als = results.where(is_als())
    first = als.groupBy(*by).agg(F.min_by("train_time", "num_cores").alias("first_time"))
    return attach(als, first, by).select(
        *als.columns, ratio(F.col("first_time"), F.col("num_cores")).alias("ideal_time")
    )


def timing_breakdown(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """ALS times: total with propagated error, ideal time, time per core."""
    total = F.col("train_time") + F.col("prediction_time")
    spread = error_propagation(
        F.coalesce("train_time_std", F.lit(0.0)), F.coalesce("prediction_time_std", F.lit(0.0))
    )
    return ideal_scaling(results, by).select(
        *by, "num_cores", "train_time", "prediction_time",
        total.alias("total_time"), spread.alias("total_time_std"), "ideal_time",
        ratio(total, F.col("num_cores")).alias("time_per_core"),
    )


def scalability_verdict(results: DataFrame, by: list[str] = (), at_cores: int = 6) -> DataFrame:
    """One row per group, from results with speed-ups."""
    facts = results.where(is_als()).groupBy(*by).agg(
        F.max("speedup_pure_spark").alias("maximum_speedup"),
        F.max("num_cores").alias("max_cores"),
        F.max("efficiency_pure_spark").alias("best_efficiency"),
        F.min("efficiency_pure_spark").alias("worst_efficiency"),
        lookup_at_cores("speedup_pure_spark", at_cores).alias(f"speedup_at_{at_cores}_cores"),
        lookup_at_cores("efficiency_pure_spark", at_cores).alias(f"efficiency_at_{at_cores}_cores"),
    )
    two = lambda c: F.round(c, 2).alias(c)
    return facts.select(
        *by,
        linear_verdict(F.col("maximum_speedup"), F.col("max_cores")).alias("linear_speedup_achieved"),
        two("maximum_speedup"), two(f"speedup_at_{at_cores}_cores"),
        degradation_verdict(F.col("worst_efficiency")).alias("efficiency_degradation"),
        two("best_efficiency"), two(f"efficiency_at_{at_cores}_cores"),
    )


def performance_summary(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """The SVD row beside the best of ALS, one row per group, with the more accurate of the two."""
    of = lambda test, f, column: f(F.when(test, F.col(column)))
    facts = results.groupBy(*by).agg(
        of(is_svd(), F.min, "rmse").alias("svd_rmse"),
        of(is_svd(), F.min, "mae").alias("svd_mae"),
        of(is_svd(), F.min, "train_time").alias("svd_training_time"),
        F.coalesce(of(is_svd(), F.min, "precision_at_10"), F.lit(0.0)).alias("svd_precision_at_10"),
        of(is_als(), F.min, "rmse").alias("best_rmse"),
        of(is_als(), F.min, "train_time").alias("fastest_training"),
        F.coalesce(of(is_als(), F.max, "speedup_pure_spark"), F.lit(0.0)).alias("max_speedup"),
        F.coalesce(of(is_als(), F.max, "efficiency_pure_spark"), F.lit(0.0)).alias("best_efficiency"),
    )
    numbers = [c for c in facts.columns if c not in by]
    return facts.select(
        *by, *[F.round(c, 4).alias(c) for c in numbers],
        accuracy_winner(F.col("svd_rmse"), F.col("best_rmse")).alias("accuracy_winner"),
    )


def best_by_metric(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """The best configuration by each criterion: (criterion, model, num_cores, value)."""
    criteria = {
        "best_rmse": ("rmse", 1), "fastest_training": ("train_time", 1),
        "best_speedup": ("speedup_train", -1), "best_efficiency": ("efficiency_train", -1),
    }
    usable = {name: c for name, c in criteria.items() if c[0] in results.columns}

    def best(column: str, sign: int) -> Column:
        row = F.struct(
            (F.col(column) * F.lit(sign)).alias("order"), F.col("model"), F.col("num_cores"), F.col(column).alias("value")
        )
        return F.min(F.when(F.col(column).isNotNull(), row))

    facts = results.groupBy(*by).agg(*[best(*c).alias(name) for name, c in usable.items()])
    return facts.unpivot(list(by), list(usable), "criterion", "best").select(
        *by, "criterion", "best.model", "best.num_cores", "best.value"
    )
