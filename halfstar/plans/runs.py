"""The run log: one row per run, reduced to one row per configuration."""

from __future__ import annotations

import time
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halfstar.functions.scalars import parse_num_cores
from halfstar.models.als import als_blocks, als_fit, als_predict, als_recommend_unseen
from halfstar.models.sgd import sgd_fit
from halfstar.operators.evaluate import error_metrics, ranking_report
from halfstar.operators.quantiles import exact_medians, medians
from halfstar.operators.skew import heavy_table, prefixed, same_group
from halfstar.sources.schemas import RUN_METRICS, RUN_PARAMETERS, RUNS

CONFIG = ["model", "cores"]


def config_columns(runs: DataFrame, by: list[str]) -> list[str]:
    """What tells configurations apart: ``by``, model and cores, and the experiment and parameters that the log holds."""
    held = [c for c in ["experiment", *RUN_PARAMETERS] if c in runs.columns and c not in by]
    return [*by, *CONFIG, *held]
# Values per group that the built-in median may hold in one task.
MEDIAN_ROWS = 200_000
# Length of the rankings whose metrics a run records (see RANKING_METRICS).
K = 10


def run_log(spark: SparkSession, records: list[dict]) -> DataFrame:
    """A handful of run records as a frame; keys a model does not have are NULL."""
    rows = [tuple(record.get(name) for name in RUNS.names) for record in records]
    return spark.createDataFrame(rows, RUNS)


def union_results(*frames: DataFrame) -> DataFrame:
    """Stack results of different models; columns one of them lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_num_cores(results: DataFrame) -> DataFrame:
    """Adds ``num_cores`` from the logged master; a log without one is of a single-process SVD on one core."""
    alone = (F.col("model") == "SVD") & F.col("cores").isNull()
    return results.withColumn("num_cores", F.when(alone, F.lit(1)).otherwise(parse_num_cores(F.col("cores"))))


def _aggregate(
    runs: DataFrame, spreads: dict[str, Callable[[str], Column]], by: list[str], metrics: list[str], median_rows: int
) -> DataFrame:
    """Medians of the metrics, and their ``spreads`` as columns ``<metric>_<name>``."""
    config = config_columns(runs, by)
    heavy = heavy_table(runs, *config, task_rows=median_rows)
    others = [f(m).alias(f"{m}_{name}") for m in metrics for name, f in spreads.items()]
    n_runs = F.count(F.lit(1)).alias("n_runs")
    names = [column for m in metrics for column in (m, *[f"{m}_{name}" for name in spreads])]
    if heavy is None:
        middles = [F.median(m).alias(m) for m in metrics]
        return runs.groupBy(*config).agg(*middles, *others, n_runs).select(*config, *names, "n_runs")
    rest = runs.groupBy(*config).agg(*others, n_runs)  # partial sums, safe for any group
    exact = prefixed(exact_medians(runs, config, metrics, heavy), config, "m_", *metrics)
    return rest.join(exact, same_group(config, "m_")).select(*config, *names, "n_runs")


def agg_runs_sample_std(
    runs: DataFrame, by: list[str] = (), metrics: list[str] = RUN_METRICS, median_rows: int = MEDIAN_ROWS
) -> DataFrame:
    """Per configuration: median and sample std (``_std``, NULL for a single run) of each metric, and n_runs."""
    return _aggregate(runs, {"std": F.stddev_samp}, list(by), list(metrics), median_rows)


def agg_runs_pop_std(
    runs: DataFrame, by: list[str] = (), metrics: list[str] = RUN_METRICS, median_rows: int = MEDIAN_ROWS
) -> DataFrame:
    """Per configuration: median, mean and population std (0 for a single run) of each metric, and n_runs."""
    return _aggregate(runs, {"mean": F.avg, "std": F.stddev_pop}, list(by), list(metrics), median_rows)


def median_run(runs: DataFrame, by: list[str] = (), metric: str = "rmse", median_rows: int = MEDIAN_ROWS) -> DataFrame:
    """Per configuration the run nearest the median ``metric``, the first of equals: (config, run_id, metric, median)."""
    config = config_columns(runs, by)
    middle = medians(runs, config, [metric], median_rows).withColumnRenamed(metric, f"median_{metric}")
    middle = prefixed(middle, config, "m_", f"median_{metric}")
    # Rounded, so that runs equally far on either side tie in spite of float noise.
    distance = F.round(F.abs(F.col(metric) - F.col(f"median_{metric}")), 9)
    near = runs.join(middle, same_group(config, "m_"))
    # Distance, then run id, in one number: a plain minimum, which hashes; a struct's would sort.
    whole = lambda c: c.cast("decimal(38,0)")
    key = whole(whole(F.round(distance * 10**9)) * F.lit(Decimal(10) ** 19) + whole(F.col("run_id")))
    first = near.groupBy(*config, f"median_{metric}").agg(F.min(key).alias("key"), F.min("run_id").alias("any_run"))
    # A configuration without any value of the metric has its first run.
    chosen = F.coalesce(F.pmod("key", F.lit(Decimal(10) ** 19)).cast("long"), "any_run")
    first = prefixed(first.withColumn("chosen", chosen), config, "f_", "chosen", f"median_{metric}")
    met = runs.join(first, [*same_group(config, "f_"), F.col("run_id") == F.col("chosen")])
    return met.select(*config, "run_id", metric, f"median_{metric}")


def _timed(action: Callable):
    start = time.perf_counter()
    result = action()
    return result, time.perf_counter() - start


def _one_run(
    fit: Callable, predict: Callable, recommend: Callable, test: DataFrame, users: DataFrame | None
) -> tuple[object, dict]:
    model, train_time = _timed(fit)
    # The evaluation is what makes the lazy predictions run, so it is what is timed.
    errors, prediction_time = _timed(lambda: error_metrics(predict(model)).first())
    record = {
        "train_time": train_time, "prediction_time": prediction_time,
        "rmse": errors["rmse"], "mae": errors["mae"],
    }
    if users is not None:
        record |= ranking_report(recommend(model), test, K).first().asDict()
    return model, record


def multi_seed_als(
    train: DataFrame, test: DataFrame, n_runs: int = 3, rank: int = 20, reg: float = 0.1, max_iter: int = 10,
    seed: int = 42, users: DataFrame | None = None, experiment: str | None = None, sample: int | None = None,
) -> tuple[list, DataFrame]:
    """Fit ALS with seeds seed, seed + 1, ... Returns the models and their run log.

    With ``users``, the ranking metrics of their unseen top 10 are measured too.
    ``experiment`` and ``sample`` label the runs in the log; runs with other labels
    or parameters are never aggregated with them.
    """
    models, records, labels = [], [], {"experiment": experiment, "sample": sample}
    blocks = als_blocks(train, rank)
    for run in range(n_runs):
        model, record = _one_run(
            lambda: als_fit(train, rank, reg, max_iter, seed + run, blocks),
            lambda m: als_predict(m, test),
            lambda m: als_recommend_unseen(m, train, users, K),
            test, users,
        )
        models.append(model)
        master = train.sparkSession.sparkContext.master
        records.append(
            record | labels | {
                "run_id": run, "model": "ALS", "cores": master, "seed": seed + run, "rank": rank, "regParam": reg,
                "maxIter": max_iter, "blocks": blocks,
            }
        )
    return models, run_log(train.sparkSession, records)


def multi_seed_biased_mf(
    train: DataFrame, test: DataFrame, n_runs: int = 3, n_factors: int = 50, n_epochs: int = 20,
    seed: int = 42, users: DataFrame | None = None, experiment: str | None = None, sample: int | None = None,
) -> tuple[list, DataFrame]:
    """The same for biased matrix factorization, logged as model ``SVD`` with seeds seed + 1, seed + 2, ..."""
    models, records, labels = [], [], {"experiment": experiment, "sample": sample}
    master = train.sparkSession.sparkContext.master
    for run in range(n_runs):
        model, record = _one_run(
            lambda: sgd_fit(train, n_factors, n_epochs, seed=seed + run + 1),
            lambda m: m.predict(test),
            lambda m: m.recommend_unseen(train, users, K),
            test, users,
        )
        models.append(model)
        records.append(record | labels | {
            "run_id": run, "model": "SVD", "cores": master, "seed": seed + run + 1, "n_factors": n_factors,
            "n_epochs": n_epochs,
        })
    return models, run_log(train.sparkSession, records)


def pick_median_model(models: list, runs: DataFrame):
    """The model of the run nearest the median RMSE of a one-configuration log."""
    return models[median_run(runs).first()["run_id"]]
