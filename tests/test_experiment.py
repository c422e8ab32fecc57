import json

from halfstar.operators.sampling import sample_split
from halfstar.plans import experiment
from halfstar.plans.experiment import run_experiment
from halfstar.sources.readers import Dataset, read_results
from halfstar.sources.schemas import RUNS
from halfstar.sources.writers import read_runs
from tests.fixtures import planted


def test_experiment(spark, tmp_path):
    train, test = planted(spark, users=60, items=40)
    ratings = train.unionAll(test).cache()
    movies = spark.createDataFrame([(i, f"t{i}", "Drama") for i in range(40)], "movieId int, title string, genres string")
    tags = spark.createDataFrame([], "userId int, movieId int, tag string, timestamp long")
    links = movies.selectExpr("movieId", "movieId imdbId", "movieId tmdbId")
    out = str(tmp_path / "out")
    small = {"als": {"rank": 2, "max_iter": 2}, "svd": {"n_factors": 2, "n_epochs": 2}}
    results = run_experiment(Dataset(ratings, movies, tags, links), out, n_runs=2, ranking_users=20, **small)
    rows = {r.model: r for r in results.collect()}
    assert rows["SVD"].n_runs == 2 and rows["ALS"].num_cores == 8
    assert rows["SVD"].speedup_vs_svd == 1.0 and 0 < rows["ALS"].speedup_train
    assert 0 <= rows["ALS"].ndcg_at_10 <= 1 and rows["ALS"].rmse_std > 0
    assert read_results(spark, f"{out}/results").count() == 2
    document = json.loads(spark.read.text(f"{out}/document").first().value)
    assert document["dataset_statistics"]["rows"] == {"ratings": ratings.count(), "movies": 40, "tags": 0, "links": 40}
    report = [r.value for r in spark.read.text(f"{out}/report").collect()]
    assert "### SVD (Cores: 8)" in report and report[0].startswith("# 2 configurations, 2 runs each")
    assert any(line.startswith("Greatest training speed-up: ") for line in report)
    models = document["experiment_configuration"]["models"]
    assert [m["model"] for m in models] == ["ALS", "SVD"] and models[0]["rank"] == 2 and models[1]["n_factors"] == 2
    log = read_runs(spark, f"{out}/run_log", RUNS)
    assert log.count() == 4 and log.where("n_users is null or seed is null").isEmpty()
    assert log.where("model = 'ALS' and blocks is null").isEmpty()

    # A second experiment in the same log leaves the first one's rows alone.
    again = run_experiment(Dataset(ratings, movies, tags, links), out, n_runs=1, als={"rank": 3, "max_iter": 1}, svd={"n_factors": 2, "n_epochs": 1})
    assert {(r.model, r.n_runs) for r in again.collect()} == {("SVD", 1), ("ALS", 1)}
    assert read_runs(spark, f"{out}/run_log", RUNS).count() == 6


def test_the_split_is_made_once(spark, tmp_path, monkeypatch):
    """Sampling reads both halves several times: from files, not by sorting all ratings again."""
    train, test = planted(spark, users=30, items=20)
    movies = spark.createDataFrame([(i, f"t{i}", "Drama") for i in range(20)], "movieId int, title string, genres string")
    tags = spark.createDataFrame([], "userId int, movieId int, tag string, timestamp long")
    links = movies.selectExpr("movieId", "movieId imdbId", "movieId tmdbId")
    seen = []
    monkeypatch.setattr(experiment, "sample_split", lambda a, b, n: seen.extend(a.inputFiles() + b.inputFiles()) or sample_split(a, b, n))
    small = {"als": {"rank": 2, "max_iter": 1}, "svd": {"n_factors": 2, "n_epochs": 1}}
    data = Dataset(train.unionAll(test), movies, tags, links)
    run_experiment(data, str(tmp_path / "out"), n_runs=1, sample=100, **small)
    assert seen and all("/labelled-" in path for path in seen)
    assert spark.read.parquet(f"{tmp_path}/out/split/train").count() == 100
