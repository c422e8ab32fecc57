"""The whole experiment: split, fit with several seeds, evaluate, log, compare, report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halfstar.operators.sampling import sample_split, sample_users_exact
from halfstar.operators.split import label_split
from halfstar.plans.compare import with_speedups
from halfstar.plans.report import report_document, report_text
from halfstar.plans.runs import agg_runs_pop_std, multi_seed_als, multi_seed_biased_mf, with_num_cores
from halfstar.sources.readers import Dataset
from halfstar.sources.schemas import RATINGS, RUNS
from halfstar.sources.writers import append_runs, materialise, read_runs, write_csv, write_split, write_text


def run_experiment(
    data: Dataset, out: str, n_runs: int = 3, als: dict | None = None, svd: dict | None = None,
    ranking_users: int | None = None, sample: int | None = None, description: str = "", experiment: str | None = None,
) -> DataFrame:
    """Compare biased matrix factorization with ALS on ``data``; returns the results table.

    ``als`` and ``svd`` are parameters of :func:`multi_seed_als` and
    :func:`multi_seed_biased_mf`, ``sample`` trains on that many ratings only.
    ``ranking_users`` measures rankings on so many users, drawn by hash, instead of
    all of them; the log says how many were measured. ``experiment`` names the
    runs; without it they get a new id, and only runs of one id and one set of
    parameters are put together. Below ``out`` go split/, run_log/ (appended to, so that sessions of
    different sizes add up to one scalability study), results/, document/ and
    report/.
    """
    spark = data.ratings.sparkSession
    # The sample reads the halves several times, and the split sorts all ratings.
    labelled = materialise(label_split(data.ratings), "labelled", "in_test")
    train, test = (labelled.where(half).drop("in_test") for half in ("not in_test", "in_test"))
    if sample is not None:
        train, test = sample_split(train, test, sample)
    train, test = (
        spark.read.schema(RATINGS).parquet(path) for path in write_split(train, test, f"{out}/split", "parquet")
    )
    everyone = test.select("userId").distinct()
    users = materialise(everyone if ranking_users is None else sample_users_exact(test, ranking_users), "ranking-users")
    labels = {"experiment": experiment or uuid.uuid4().hex, "sample": sample, "users": users}
    _, svd_runs = multi_seed_biased_mf(train, test, n_runs, **labels, **(svd or {}))
    _, als_runs = multi_seed_als(train, test, n_runs, **labels, **(als or {}))
    append_runs(svd_runs.unionByName(als_runs), f"{out}/run_log")

    log = read_runs(spark, f"{out}/run_log", RUNS).where(F.col("experiment") == labels["experiment"])
    results = with_speedups(materialise(with_num_cores(agg_runs_pop_std(log)), "results"))
    write_csv(results, f"{out}/results", single_file=True)
    write_text(report_document(results, *data, description=description), f"{out}/document")
    write_text(report_text(results), f"{out}/report")
    return results
