"""Analytics of the run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from halfstar.plans import compare, experiment, report
from halfstar.session import scratch_path
from halfstar.sources import schemas
from halfstar.sources.readers import Dataset
from halfstar.sources.writers import append_runs, read_runs
from workload import tables as t
from workload.cte import sql
from workload.registry import query, rounded


@query("run_log", sql("select * from runs", "runs"))
def run_log(spark, folder):
    """Two batches, the second one appended twice and a third one killed before its commit: the log holds two."""
    path = scratch_path(spark, "run-log")
    log = t.runs(spark, folder)
    append_runs(log.where("model = 'SVD'"), path, "svd")
    for _ in range(2):
        append_runs(log.where("model = 'ALS'"), path, "als")
    log.write.parquet(f"{path}/attempts/attempt=killed")
    return read_runs(spark, path, log.schema)


def _speedup_query(column: str) -> None:
    @query(column, sql(f"select model, num_cores, round({column}, 6) as {column} from fast", "runs", "fast"))
    def run(spark, folder):
        return rounded(t.fast_results(spark, folder).select("model", "num_cores", column), column)


for _column in (
    "speedup_vs_svd", "speedup_pure_spark", "efficiency_pure_spark", "speedup_train", "efficiency_train",
    "speedup_prediction", "efficiency_prediction",
):
    _speedup_query(_column)


def _four(*columns: str) -> str:
    return ", ".join(f"round({c}, 4) as {c}" for c in columns)


@query(
    "summary_performance",
    sql(f"""
select model, num_cores, {_four("train_time", "prediction_time", "rmse", "mae",
                                "train_time_std", "prediction_time_std", "rmse_std", "mae_std")}
from results""", "runs", "results"),
)
def summary_performance(spark, folder):
    return compare.summary_performance(t.results(spark, folder))


@query(
    "summary_ranking",
    sql(f"""
select model, num_cores, {_four("precision_at_10", "recall_at_10", "ndcg_at_10", "map_at_10")}
from results""", "runs", "results"),
)
def summary_ranking(spark, folder):
    return compare.summary_ranking(t.results(spark, folder))


@query(
    "summary_scalability",
    sql(f"""
select model, num_cores, {_four("train_time", "rmse", "precision_at_10", "speedup_pure_spark", "efficiency_pure_spark")}
from fast where model = 'ALS'""", "runs", "fast"),
)
def summary_scalability(spark, folder):
    return compare.summary_scalability(t.fast_results(spark, folder))


@query(
    "summary_scalability_all",
    sql(f"select model, num_cores, {_four('speedup_train', 'efficiency_train')} from fast", "runs", "fast"),
)
def summary_scalability_all(spark, folder):
    return compare.summary_scalability(t.fast_results(spark, folder), als_only=False)


@query("metric_matrix", sql("select label, metric, round(value, 6) as value from long", "runs", "long"))
def metric_matrix(spark, folder):
    return rounded(compare.to_long(compare.metric_matrix(t.results(spark, folder))), "value")


@query(
    "overall_score",
    sql("""
select label, round(overall_score, 6) as overall_score,
       row_number() over (order by overall_score desc, label) = 1 as is_best from scores""", "runs", "scores"),
)
def overall_score(spark, folder):
    return rounded(compare.overall_score(t.saved_results(spark, folder)), "overall_score")


@query(
    "cost_benefit",
    sql("""
select model, num_cores, round(num_cores * train_time, 6) as cost, round(1 / rmse, 6) as benefit,
       round(1 / rmse / (num_cores * train_time), 6) as ratio,
       model = 'ALS' and row_number() over (partition by model
         order by 1 / rmse / (num_cores * train_time) desc, num_cores) = 1 as is_best
from results""", "runs", "results"),
)
def cost_benefit(spark, folder):
    return rounded(compare.cost_benefit(t.saved_results(spark, folder)), "cost", "benefit", "ratio")


@query(
    "timing_breakdown",
    sql("""
select num_cores, round(train_time, 6) as train_time, round(prediction_time, 6) as prediction_time,
       round(train_time + prediction_time, 6) as total_time,
       round(sqrt(train_time_std*train_time_std + prediction_time_std*prediction_time_std), 6) as total_time_std,
       round(first_value(train_time) over (order by num_cores) / num_cores, 6) as ideal_time,
       round((train_time + prediction_time) / num_cores, 6) as time_per_core
from results where model = 'ALS'""", "runs", "results"),
)
def timing_breakdown(spark, folder):
    times = compare.timing_breakdown(t.saved_results(spark, folder))
    return rounded(times, *[c for c in times.columns if c != "num_cores"])


_VERDICT = """
select case when max(speedup_pure_spark) < max(num_cores) * 0.8::double then 'No' else 'Partial' end as linear_speedup_achieved,
       round(max(speedup_pure_spark), 2) as maximum_speedup,
       round(coalesce(max(case when num_cores = 6 then speedup_pure_spark end), 0), 2) as speedup_at_6_cores,
       case when min(efficiency_pure_spark) < 0.5::double then 'Yes' else 'Minimal' end as efficiency_degradation,
       round(max(efficiency_pure_spark), 2) as best_efficiency,
       round(coalesce(max(case when num_cores = 6 then efficiency_pure_spark end), 0), 2) as efficiency_at_6_cores
from fast where model = 'ALS'"""


@query("scalability_verdict", sql(_VERDICT, "runs", "fast"))
def scalability_verdict(spark, folder):
    return compare.scalability_verdict(t.fast_results(spark, folder))


_SUMMARY = """
select round(min(case when model = 'SVD' then rmse end), 4) as svd_rmse,
       round(min(case when model = 'SVD' then mae end), 4) as svd_mae,
       round(min(case when model = 'SVD' then train_time end), 4) as svd_training_time,
       round(coalesce(min(case when model = 'SVD' then precision_at_10 end), 0), 4) as svd_precision_at_10,
       round(min(case when model = 'ALS' then rmse end), 4) as best_rmse,
       round(min(case when model = 'ALS' then train_time end), 4) as fastest_training,
       round(coalesce(max(case when model = 'ALS' then speedup_pure_spark end), 0), 4) as max_speedup,
       round(coalesce(max(case when model = 'ALS' then efficiency_pure_spark end), 0), 4) as best_efficiency,
       case when min(case when model = 'SVD' then rmse end) < min(case when model = 'ALS' then rmse end)
            then 'SVD' else 'Spark ALS' end as accuracy_winner
from fast"""


@query("performance_summary", sql(_SUMMARY, "runs", "fast"))
def performance_summary(spark, folder):
    return compare.performance_summary(t.fast_results(spark, folder))


@query(
    "report_document",
    sql(f"""
select r.n as n_ratings, m.n as n_movies, g.n as n_tags, l.n as n_links,
       u.users as n_users, round(u.mean, 6) as avg_rating,
       s.svd_rmse, s.best_rmse, s.max_speedup, s.accuracy_winner,
       v.linear_speedup_achieved, v.efficiency_degradation, d.n_als, round(d.last_time, 6) as last_als_train_time
from (select count(*) as n from ratings) r, (select count(*) as n from movies) m,
     (select count(*) as n from tags) g, (select count(*) as n from links) l,
     (select count(distinct userId) as users, avg(rating) as mean from ratings) u,
     ({_SUMMARY}) s, ({_VERDICT}) v,
     (select count(*) as n_als, max_by(train_time, cores) as last_time from fast where model = 'ALS') d""",
        "ratings", "movies", "tags", "links", "runs", "fast"),
)
def report_document(spark, folder):
    document = report_document_json(spark, folder)
    field = lambda path, kind: F.get_json_object("document", f"$.{path}").cast(kind)
    stats, best, scale = "dataset_statistics", "performance_summary", "scalability_analysis"
    details = F.from_json(
        F.get_json_object("document", "$.detailed_results.spark_scalability"), "array<struct<train_time double>>"
    )
    parsed = document.select(
        field(f"{stats}.rows.ratings", "bigint").alias("n_ratings"),
        field(f"{stats}.rows.movies", "bigint").alias("n_movies"),
        field(f"{stats}.rows.tags", "bigint").alias("n_tags"),
        field(f"{stats}.rows.links", "bigint").alias("n_links"),
        field(f"{stats}.matrix.n_users", "bigint").alias("n_users"),
        field(f"{stats}.ratings.avg_rating", "double").alias("avg_rating"),
        field(f"{best}.svd_rmse", "double").alias("svd_rmse"),
        field(f"{best}.best_rmse", "double").alias("best_rmse"),
        field(f"{best}.max_speedup", "double").alias("max_speedup"),
        field(f"{best}.accuracy_winner", "string").alias("accuracy_winner"),
        field(f"{scale}.linear_speedup_achieved", "string").alias("linear_speedup_achieved"),
        field(f"{scale}.efficiency_degradation", "string").alias("efficiency_degradation"),
        F.size(details).cast("bigint").alias("n_als"),
        F.element_at(details, -1)["train_time"].alias("last_als_train_time"),
    )
    return rounded(parsed, "avg_rating", "last_als_train_time")


def report_document_json(spark, folder):
    named = {name: getattr(t, name)(spark, folder) for name in ("ratings", "movies", "tags", "links")}
    return report.report_document(t.fast_results(spark, folder), **named)


@query(
    "run_experiment",
    sql("""
select m.model, 3::bigint as n_runs, (select count(*) from some_train)::bigint as n_train, u.n as n_users, true as plausible
from (select unnest(['ALS', 'SVD']) as model) m,
     (select count(distinct t.userId) as n from test t
      where rating >= 4.0 and t.userId in (select userId from (select distinct userId from test where userId in (select userId from some_train))
                                           order by md5(concat_ws('-', '42', userId)), userId limit 500)) u""", "test", "some_train"),
)
def run_experiment(spark, folder):
    """The whole experiment with its usual settings: 5,000 sampled ratings, 500 ranking users, three runs of each model, all reports."""
    data = Dataset(t.ratings(spark, folder), t.movies(spark, folder), t.tags(spark, folder), t.links(spark, folder))
    out = scratch_path(spark, "experiment")
    results = experiment.run_experiment(data, out, ranking_users=500, sample=5000)
    log = read_runs(spark, f"{out}/run_log", schemas.RUNS)
    users = log.groupBy("model").agg(F.max("n_users").alias("n_users"))
    n_train = spark.read.parquet(f"{out}/split/train").agg(F.count(F.lit(1))).scalar()
    sane = F.col("rmse").between(0.1, 4.5) & (F.col("mae") <= F.col("rmse")) & (F.col("train_time") > 0)
    return results.join(users, "model").select("model", "n_runs", n_train.alias("n_train"), "n_users", sane.alias("plausible"))
