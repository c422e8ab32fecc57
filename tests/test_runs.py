import json

import pytest
from pyspark.sql import functions as F

from halfstar.functions import scalars
from halfstar.plans import compare, report, runs
from halfstar.sources.schemas import RUN_METRICS
from tests.fixtures import PUBLISHED_RUNS, RUN_COLUMNS, rows_of


@pytest.fixture(scope="module")
def published(spark):
    base = runs.with_num_cores(spark.createDataFrame(PUBLISHED_RUNS, RUN_COLUMNS))
    return compare.with_speedups(base)


def log(spark, *records):
    return runs.run_log(spark, [{"run_id": i, **r} for i, r in enumerate(records)])


def test_published_speedups(published):
    got = {r.num_cores: r for r in published.where("model = 'ALS'").collect()}
    assert {c: round(r.speedup_train, 4) for c, r in got.items()} == {1: 0.0039, 2: 0.0074, 4: 0.0104, 8: 0.0142}
    assert {c: round(r.efficiency_train, 4) for c, r in got.items()} == {1: 0.0039, 2: 0.0037, 4: 0.0026, 8: 0.0018}
    assert {c: round(r.speedup_prediction, 2) for c, r in got.items()} == {1: 2.05, 2: 4.46, 4: 4.77, 8: 4.89}
    assert {c: round(r.speedup_pure_spark, 2) for c, r in got.items()} == {1: 1.0, 2: 1.93, 4: 2.7, 8: 3.68}
    assert {c: round(r.efficiency_pure_spark, 2) for c, r in got.items()} == {1: 1.0, 2: 0.96, 4: 0.67, 8: 0.46}


def test_svd_has_no_pure_speedup(published):
    row = published.where("model = 'SVD'").first()
    assert row.speedup_pure_spark is None and row.efficiency_pure_spark is None and row.speedup_vs_svd == 1.0


def test_verdicts(published):
    row = compare.scalability_verdict(published).first()
    assert (row.linear_speedup_achieved, row.maximum_speedup, row.speedup_at_6_cores) == ("No", 3.68, 0.0)
    assert (row.efficiency_degradation, row.best_efficiency) == ("Yes", 1.0)
    summary = compare.performance_summary(published.withColumn("precision_at_10", F.lit(None).cast("double"))).first()
    assert summary.accuracy_winner == "SVD" and summary.svd_rmse == 0.9806 and summary.svd_precision_at_10 == 0.0
    best = {r.criterion: (r.model, r.num_cores) for r in compare.best_by_metric(published).collect()}
    assert best["best_rmse"] == ("SVD", 1) and best["best_speedup"] == ("SVD", 1)


def test_cost_benefit_and_timing(published):
    costs = {(r.model, r.num_cores): r for r in compare.cost_benefit(published).collect()}
    assert costs["ALS", 8].cost == pytest.approx(8 * 2.1991348266601562)
    assert [key for key, r in costs.items() if r.is_best] == [("ALS", 1)]
    times = published.withColumn("train_time_std", F.lit(3.0)).withColumn("prediction_time_std", F.lit(4.0))
    rows = {r.num_cores: r for r in compare.timing_breakdown(times).collect()}
    assert rows[4].total_time_std == 5.0
    assert rows[8].ideal_time == pytest.approx(8.085296392440796 / 8)


def test_overall_score(published):
    rows = {r.label: r for r in compare.overall_score(published).collect()}
    # Without ranking metrics those three add nothing, and SVD is best by all others but prediction time.
    assert [label for label, r in rows.items() if r.is_best] == ["SVD"]
    assert rows["SVD"].overall_score == pytest.approx(0.25 + 0.15 + 0.15, abs=1e-4)


def test_by_experiment(spark):
    """Groups do not see each other's baselines."""
    rows = [("x", *r) for r in PUBLISHED_RUNS] + [("y", m, c, t * 2 if m == "ALS" else t, p, e, a) for m, c, t, p, e, a in PUBLISHED_RUNS]
    both = runs.with_num_cores(spark.createDataFrame(rows, "exp string, " + RUN_COLUMNS))
    got = compare.with_speedups(both, ["exp"])
    at = {(r.exp, r.num_cores): r for r in got.where("model = 'ALS'").collect()}
    assert at["y", 8].speedup_train == pytest.approx(at["x", 8].speedup_train / 2)
    assert at["y", 8].speedup_pure_spark == pytest.approx(at["x", 8].speedup_pure_spark)
    assert compare.overall_score(got, ["exp"]).where("is_best").count() == 2
    assert compare.scalability_verdict(got, ["exp"]).count() == 2
    assert compare.best_by_metric(got, ["exp"]).count() == 8
    assert compare.cost_benefit(got, ["exp"]).where("is_best").count() == 2


def test_std_flavours(spark):
    single = {"model": "SVD", "rmse": 1.0, "mae": None}
    several = [{"model": "ALS", "cores": "local[2]", "rmse": r} for r in (1.0, 2.0, 4.0)]
    df = log(spark, single, *several)
    sample = {r.model: r for r in runs.agg_runs_sample_std(df).collect()}
    population = {r.model: r for r in runs.agg_runs_pop_std(df).collect()}
    assert sample["SVD"].rmse_std is None and population["SVD"].rmse_std == 0.0
    assert sample["ALS"].rmse == 2.0 and sample["ALS"].n_runs == 3
    assert sample["ALS"].rmse_std == pytest.approx(1.5275252) and population["ALS"].rmse_std == pytest.approx(1.2472191)
    assert population["SVD"].mae is None


@pytest.mark.parametrize("median_rows", [10**6, 50, 0])
def test_heavy_configurations(spark, median_rows):
    df = spark.range(2000).selectExpr(
        "id as run_id", "if(id % 3 = 0, 'SVD', 'ALS') model", "if(id % 3 = 0, null, if(id % 50 = 1, 'local[2]', 'local[4]')) cores",
        *[f"((id * {7 + i}) % 1009) / 100.0D as {m}" for i, m in enumerate(RUN_METRICS)],
    )
    plain = df.groupBy("model", "cores").agg(*[F.median(m).alias(m) for m in RUN_METRICS])
    got = runs.agg_runs_pop_std(df, median_rows=median_rows)
    key = lambda r: (r[0], r[1] or "")
    assert sorted(map(tuple, got.select("model", "cores", *RUN_METRICS).collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
    picked = sorted(((r.model, r.cores or "", r.run_id) for r in runs.median_run(df, median_rows=median_rows).collect()))
    assert picked == sorted(((r.model, r.cores or "", r.run_id) for r in runs.median_run(df).collect()))
    assert len(picked) == 3


def test_missing_baselines(spark):
    df = spark.createDataFrame([("ALS", "local[2]", 0.0, 1.0, 1.0, 1.0), ("ALS", "local[*]", 2.0, 1.0, 1.0, 1.0)], RUN_COLUMNS)
    for row in compare.with_speedups(runs.with_num_cores(df)).collect():
        assert row.speedup_vs_svd is None and row.speedup_pure_spark is None and row.efficiency_train is None


def test_median_run_takes_the_first_of_equals(spark):
    df = log(spark, *[{"model": "SVD", "rmse": r} for r in (3.0, 1.0, 2.0, 4.0)])
    row = runs.median_run(df).first()
    assert (row.run_id, row.median_rmse) == (0, 2.5)


def test_cores_and_labels(spark):
    df = spark.createDataFrame([("local[4]",), (None,), ("local[*]",), ("yarn",)], "c string")
    assert [r[0] for r in df.select(scalars.parse_num_cores(F.col("c"))).collect()] == [4, 1, None, 1]
    labels = spark.createDataFrame([("SVD", 1), ("ALS", 4)], "m string, n int")
    assert [r[0] for r in labels.select(scalars.model_label(F.col("m"), F.col("n"))).collect()] == ["SVD", "ALS-4c"]
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(scalars.metric_label(F.lit("precision_at_10"))) == "precision@at@10"
    assert [pick(scalars.clip_rating(F.lit(v))) for v in (-1.0, 0.7, 9.0)] == [0.5, 0.7, 5.0]
    assert pick(scalars.ratio(F.lit(1), F.lit(0))) is None
    assert pick(scalars.accuracy_winner(F.lit(None).cast("double"), F.lit(9.0))) == "Spark ALS"
    assert pick(scalars.format_metric_line("RMSE", F.lit(0.98062), F.lit(None).cast("double"))) == "RMSE: 0.9806 ± 0.0000"


def test_summaries(published):
    assert compare.summary_ranking(published) is None
    assert compare.summary_scalability(published).columns[:3] == ["model", "num_cores", "train_time"]
    assert compare.summary_scalability(published, als_only=False).count() == 5
    assert compare.filter_positive_cores(published).count() == 4
    assert compare.filter_by_model(published, "SVD").count() == 1


def test_text_report(published):
    lines = "\n".join(r.value for r in report.report_text(published).collect()).splitlines()
    assert lines[0].startswith("# ") and "### SVD (Cores: 1)" in lines and "### ALS (Cores: 8)" in lines
    assert "Training Time: 8.0853 ± 0.0000 seconds" in lines and "Speed-up: 0.0142x" in lines
    assert "Least RMSE: 0.9806, SVD on 1 cores" in lines
    assert any(line.startswith("Greatest training speed-up: ") for line in lines)
    assert lines.index("### SVD (Cores: 1)") < lines.index("## Best of all")


def test_document(spark, sf):
    from workload import experiments

    document = json.loads(experiments.report_document_json(spark, sf).first().document)
    rows = document["detailed_results"]
    assert [len(rows["svd_baseline"]), len(rows["spark_scalability"])] == [1, 4]
    assert document["dataset_statistics"]["rows"]["links"] == 200


def test_union_fills_nulls(spark):
    a = spark.createDataFrame([("SVD", 50)], "model string, n_factors int")
    b = spark.createDataFrame([("ALS", 20)], "model string, rank int")
    assert rows_of(runs.union_results(a, b).fillna(-1), "model", "n_factors", "rank") == [("ALS", -1, 20), ("SVD", 50, -1)]


def test_unlike_runs_stay_apart(spark):
    from halfstar.plans.runs import agg_runs_pop_std, run_log

    def record(run, rmse, **labels):
        return {"run_id": run, "model": "ALS", "cores": "local[2]", "rmse": rmse, "rank": 10, **labels}

    log = run_log(spark, [
        record(0, 1.0), record(1, 3.0, rank=50), record(2, 5.0, sample=100), record(3, 7.0, experiment="b"), record(4, 9.0),
    ])
    got = sorted((r.rmse, r.n_runs) for r in agg_runs_pop_std(log).collect())
    assert got == [(3.0, 1), (5.0, 1), (5.0, 2), (7.0, 1)]


def test_cores_of_logged_svd(spark):
    from halfstar.plans.runs import run_log, with_num_cores

    log = run_log(spark, [{"model": "SVD", "cores": "local[4]"}, {"model": "SVD"}, {"model": "ALS", "cores": "local[2]"}])
    assert [r.num_cores for r in with_num_cores(log).collect()] == [4, 1, 2]
