"""Scans, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from halfstar.operators.evaluate import relevant_items
from halfstar.operators.sampling import sample_split
from halfstar.operators.split import persisted, temporal_split
from halfstar.plans import compare
from halfstar.plans.report import report_sections
from halfstar.plans.runs import agg_runs_sample_std
from halfstar.session import scratch_path
from halfstar.sources import readers, schemas, writers
from workload import tables as t
from workload.cte import sql
from workload.registry import query, rounded

_METRICS = schemas.RUN_METRICS


@query("scan_ratings", sql("select * from ratings", "ratings"))
def scan_ratings(spark, folder):
    return t.fresh_ratings(spark, folder)


@query("scan_movies", sql("select * from movies", "movies"))
def scan_movies(spark, folder):
    return t.movies(spark, folder)


@query("scan_tags", sql("select * from tags", "tags"))
def scan_tags(spark, folder):
    return t.tags(spark, folder)


@query("scan_links", sql("select * from links", "links"))
def scan_links(spark, folder):
    return t.links(spark, folder)


@query(
    "typed_ratings",
    sql("select userId, movieId, cast(rating as real) as rating, timestamp from ratings", "ratings"),
)
def typed_ratings(spark, folder):
    return readers.typed_ratings(t.fresh_ratings(spark, folder))


@query(
    "persist_split",
    sql("""
select 'train' as split, count(*) as n from train
union all select 'test', count(*) from test""", "train", "test"),
)
def persist_split(spark, folder):
    with persisted(*temporal_split(t.ratings(spark, folder))) as halves:
        counts = [(name, df.count()) for name, df in zip(("train", "test"), halves)]
    return spark.createDataFrame(counts, "split string, n bigint")


@query(
    "scan_checked",
    sql("""
select case when movieId % 97 = 0 or userId % 89 = 0 then 'malformed' when userId % 83 = 0 then 'incomplete' else 'good' end as kind,
       count(*) as n, sum(userId)::bigint as users from ratings group by 1""", "ratings"),
)
def scan_checked(spark, folder):
    """Ratings written as lines of which some hold words for numbers or no rating, and scanned with an account of every line."""
    text = lambda c: F.col(c).cast("string")
    rating = F.when(F.col("movieId") % 97 == 0, "good").when(F.col("userId") % 83 == 0, None).otherwise(text("rating"))
    moment = F.when(F.col("userId") % 89 == 0, "soon").otherwise(text("timestamp"))
    path = scratch_path(spark, "lines")
    writers.write_csv(t.ratings(spark, folder).select("userId", "movieId", rating.alias("rating"), moment.alias("timestamp")), f"{path}/ratings.csv")
    got = readers.scan_checked(spark, path, "ratings", max_bad=1.0)
    user = F.split("line", ",")[0].cast("int")
    both = got.rows.select(F.lit("good").alias("kind"), "userId").unionAll(got.rejects.select("reason", user))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("userId").alias("users"))


@query(
    "stored_split",
    sql("""
select a.userId, a.n as n_train, b.n as n_test, round(a.s - b.s, 6) as difference
from (select userId, count(*) as n, avg(rating) as s from train group by userId) a
join (select userId, count(*) as n, avg(rating) as s from test group by userId) b using (userId)""", "train", "test"),
)
def stored_split(spark, folder):
    """Both halves stored in buckets by user; counted and joined by user without a shuffle."""
    train, test = writers.store_split(*t.split(spark, folder), buckets=16)
    per_user = lambda df, name: df.groupBy("userId").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.avg("rating").alias(f"mean_{name}"))
    met = per_user(train, "train").join(per_user(test, "test"), "userId")
    return met.select("userId", "n_train", "n_test", F.round(F.col("mean_train") - F.col("mean_test"), 6).alias("difference"))


_BOTH_HALVES = """
select 'train' as split, userId, movieId, rating, timestamp from {train}
union all select 'test', userId, movieId, rating, timestamp from {test}"""


def _written_split(spark, train, test, name):
    """Write both halves as CSV and scan them again."""
    paths = writers.write_split(train, test, scratch_path(spark, name))
    again = [
        spark.read.schema(schemas.RATINGS).option("header", True).csv(path).select(F.lit(half).alias("split"), "*")
        for half, path in zip(("train", "test"), paths)
    ]
    return again[0].unionAll(again[1])


@query("sink_split", sql(_BOTH_HALVES.format(train="train", test="test"), "train", "test"))
def sink_split(spark, folder):
    return _written_split(spark, *t.split(spark, folder), "split")


@query(
    "sink_sample",
    sql("""
, sample as (
  select * from train order by md5(concat_ws('-', '42', userId, movieId)), userId, movieId limit 5000)
""" + _BOTH_HALVES.format(train="sample", test="test where userId in (select userId from sample)"), "train", "test"),
)
def sink_sample(spark, folder):
    return _written_split(spark, *sample_split(*t.split(spark, folder), n=5000, seed=42), "sample")


_ROUND_SAMPLE = ", ".join(f"round({m}, 6) as {m}, round({m}_std, 6) as {m}_std" for m in _METRICS)


@query("sink_results_csv", sql(f"select model, cores, {_ROUND_SAMPLE}, n_runs from agg_sample", "runs", "agg_sample"))
def sink_results_csv(spark, folder):
    results = agg_runs_sample_std(t.runs(spark, folder))
    path = scratch_path(spark, "results-csv")
    writers.write_csv(results, path, single_file=True)
    back = spark.read.schema(results.schema).option("header", True).csv(path)
    return rounded(back, *[c for c in back.columns if c not in ("model", "cores", "n_runs")])


@query(
    "scan_results_csv",
    sql(f"select model, cores, {_ROUND_SAMPLE}, cast(n_runs as int) as n_runs from agg_sample", "runs", "agg_sample"),
)
def scan_results_csv(spark, folder):
    path = scratch_path(spark, "results-scan")
    writers.write_csv(agg_runs_sample_std(t.runs(spark, folder)), path, single_file=True)
    back = readers.read_results(spark, path)
    return rounded(back, *[c for c in back.columns if c not in ("model", "cores", "n_runs")])


@query(
    "sink_results_json",
    sql("""
select model, num_cores, n_runs, round(rmse, 6) as rmse, round(train_time, 6) as train_time,
       round(train_time_std, 6) as train_time_std
from results""", "runs", "results"),
)
def sink_results_json(spark, folder):
    path = scratch_path(spark, "results-json")
    spread = F.struct(F.col("train_time_std").alias("train_time"))
    medians = F.struct("rmse", "train_time")
    nested = t.results(spark, folder).select("model", "num_cores", "n_runs", medians.alias("median"), spread.alias("std"))
    writers.write_json(nested, path)
    back = spark.read.schema(nested.schema).json(path)
    flat = back.select(
        "model", "num_cores", "n_runs", "median.rmse", "median.train_time", F.col("std.train_time").alias("train_time_std")
    )
    return rounded(flat, "rmse", "train_time", "train_time_std")


_SECTION_LINES = """
select unnest([
  concat('### ', model, ' (Cores: ', num_cores, ')'),
  concat('Training Time: ', printf('%.4f', round(train_time, 4)), ' ± ', printf('%.4f', round(train_time_std, 4)), ' seconds'),
  concat('Prediction Time: ', printf('%.4f', round(prediction_time, 4)), ' ± ', printf('%.4f', round(prediction_time_std, 4)), ' seconds'),
  concat('RMSE: ', printf('%.4f', round(rmse, 4)), ' ± ', printf('%.4f', round(rmse_std, 4))),
  concat('MAE: ', printf('%.4f', round(mae, 4)), ' ± ', printf('%.4f', round(mae_std, 4))),
  concat('Precision@10: ', printf('%.4f', round(precision_at_10, 4))),
  concat('Recall@10: ', printf('%.4f', round(recall_at_10, 4))),
  concat('NDCG@10: ', printf('%.4f', round(ndcg_at_10, 4))),
  concat('Speed-up: ', printf('%.4f', round(speedup_train, 4)), 'x'),
  concat('Efficiency: ', printf('%.4f', round(efficiency_train, 4)))]) as line
from fast"""


@query("sink_report_text", sql(_SECTION_LINES, "runs", "fast"))
def sink_report_text(spark, folder):
    path = scratch_path(spark, "report-text")
    writers.write_text(report_sections(t.fast_results(spark, folder)).select("section"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("project_triples", sql("select userId, movieId, rating from ratings", "ratings"))
def project_triples(spark, folder):
    return readers.project_triples(t.ratings(spark, folder))


@query("filter_relevant", sql("select * from relevant", "relevant"))
def filter_relevant(spark, folder):
    return relevant_items(t.split(spark, folder)[1])


@query("filter_by_model", sql("select * from runs where model = 'ALS'", "runs"))
def filter_by_model(spark, folder):
    return compare.filter_by_model(t.runs(spark, folder), "ALS")


@query(
    "filter_positive_cores",
    sql("""
select model, num_cores, round(train_time, 6) as train_time, n_runs
from results where model = 'ALS' and num_cores > 0""", "runs", "results"),
)
def filter_positive_cores(spark, folder):
    kept = compare.filter_positive_cores(t.results(spark, folder))
    return rounded(kept.select("model", "num_cores", "train_time", "n_runs"), "train_time")


@query(
    "lookup_at_cores",
    sql("""
select round(coalesce(max(case when num_cores = 6 then speedup_pure_spark end), 0), 6) as at_6,
       round(coalesce(max(case when num_cores = 8 then speedup_pure_spark end), 0), 6) as at_8
from fast""", "runs", "fast"),
)
def lookup_at_cores(spark, folder):
    found = t.fast_results(spark, folder).agg(
        compare.lookup_at_cores("speedup_pure_spark", 6).alias("at_6"),
        compare.lookup_at_cores("speedup_pure_spark", 8).alias("at_8"),
    )
    return rounded(found, "at_6", "at_8")


@query(
    "project_existing",
    sql("""
select model, num_cores, round(rmse, 6) as rmse, round(rmse_std, 6) as rmse_std from results""", "runs", "results"),
)
def project_existing(spark, folder):
    wanted = ["model", "num_cores", "no_such_metric", "rmse", "rmse_std", "no_such_metric_std"]
    return rounded(compare.project_existing(t.results(spark, folder), wanted), "rmse", "rmse_std")


_ROUND_RUNS = ", ".join(f"round({m}, 4) as {m}" for m in _METRICS)


@query("round_summary", sql(f"select run_id, model, cores, {_ROUND_RUNS} from runs", "runs"))
def round_summary(spark, folder):
    return compare.round_summary(t.runs(spark, folder))
