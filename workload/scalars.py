"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from halfstar.functions import scalars as s
from halfstar.operators import profile, recommend
from halfstar.operators.split import label_split
from halfstar.plans import compare
from halfstar.plans.runs import union_results, with_num_cores
from workload import tables as t
from workload.cte import sql
from workload.registry import query, rounded

_CORES = "coalesce(try_cast(regexp_extract(cores, 'local\\[([^\\]]*)\\]', 1) as int), 1)"


@query("parse_num_cores", sql(f"select run_id, cores, {_CORES} as num_cores from runs", "runs"))
def parse_num_cores(spark, folder):
    return t.runs(spark, folder).select("run_id", "cores", s.parse_num_cores(F.col("cores")).alias("num_cores"))


@query(
    "model_label",
    sql(f"""
select run_id, case when model = 'SVD' then 'SVD' else concat('ALS-', {_CORES}, 'c') end as label from runs""", "runs"),
)
def model_label(spark, folder):
    log = with_num_cores(t.runs(spark, folder))
    return log.select("run_id", s.model_label(F.col("model"), F.col("num_cores")).alias("label"))


@query(
    "metric_label",
    sql("select label, metric, replace(metric, '_', '@') as metric_label from long", "runs", "long"),
)
def metric_label(spark, folder):
    long = compare.to_long(compare.metric_matrix(t.results(spark, folder)))
    return long.select("label", "metric", s.metric_label(F.col("metric")).alias("metric_label"))


@query(
    "metric_default",
    sql("""
select run_id, model, round(case when model = 'SVD' then map_at_10 else 0 end, 6) as map_at_10 from runs""", "runs"),
)
def metric_default(spark, folder):
    log = t.runs(spark, folder)
    svd = log.where("model = 'SVD'").select("run_id", "model", "map_at_10")
    als = log.where("model = 'ALS'").select("run_id", "model")
    both = union_results(svd, als)
    return rounded(both.select("run_id", "model", s.metric_default(F.col("map_at_10")).alias("map_at_10")), "map_at_10")


@query(
    "clip_rating",
    sql("""
select userId, movieId, greatest(0.5::double, least(5.0::double, rating * 1.5::double - 0.75::double)) as clipped
from ratings""", "ratings"),
)
def clip_rating(spark, folder):
    stretched = F.col("rating") * F.lit(1.5) - F.lit(0.75)
    return t.ratings(spark, folder).select("userId", "movieId", s.clip_rating(stretched).alias("clipped"))


@query(
    "percent_of_total",
    sql("""
select in_test, count(*) as n, round(100.0::double * count(*) / (select count(*) from labelled), 1) as percent
from labelled group by in_test""", "labelled"),
)
def percent_of_total(spark, folder):
    sizes = label_split(t.ratings(spark, folder)).groupBy("in_test").agg(profile.rows().alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    return sizes.select("in_test", "n", s.percent_of_total(F.col("n"), total).alias("percent"))


@query(
    "log_discount",
    sql("""
select userId, movieId, round(1 / log2(pos + 1), 6) as discount from (
  select userId, movieId, row_number() over (partition by userId order by rating desc, movieId) as pos from ratings)
where pos <= 10""", "ratings"),
)
def log_discount(spark, folder):
    top = recommend.topk_per_user(t.ratings(spark, folder), 10)
    return rounded(top.select("userId", "movieId", s.log_discount(F.col("pos")).alias("discount")), "discount")


@query(
    "popularity_weight",
    sql("select movieId, round(ln(1 + count(*)), 6) as weight from ratings group by movieId", "ratings"),
)
def popularity_weight(spark, folder):
    counts = profile.item_popularity(t.ratings(spark, folder))
    return rounded(counts.select("movieId", s.popularity_weight(F.col("n")).alias("weight")), "weight")


@query(
    "error_propagation",
    sql("""
select run_id, round(sqrt(train_time*train_time + prediction_time*prediction_time), 6) as combined from runs""", "runs"),
)
def error_propagation(spark, folder):
    both = s.error_propagation(F.col("train_time"), F.col("prediction_time"))
    return rounded(t.runs(spark, folder).select("run_id", both.alias("combined")), "combined")


@query(
    "format_metric_line",
    sql("""
select run_id, concat('RMSE: ', printf('%.4f', round(rmse, 4)), ' ± ', printf('%.4f', round(mae, 4))) as line
from runs""", "runs"),
)
def format_metric_line(spark, folder):
    return t.runs(spark, folder).select("run_id", s.format_metric_line("RMSE", F.col("rmse"), F.col("mae")).alias("line"))


@query(
    "verdict_case",
    sql("""
select run_id, case when train_time < prediction_time * 100 * 0.8::double then 'No' else 'Partial' end as linear,
       case when precision_at_10 < 0.5::double then 'Yes' else 'Minimal' end as degraded,
       case when rmse < mae + 0.2::double then 'SVD' else 'Spark ALS' end as winner
from runs""", "runs"),
)
def verdict_case(spark, folder):
    c = F.col
    return t.runs(spark, folder).select(
        "run_id",
        s.linear_verdict(c("train_time"), c("prediction_time") * 100).alias("linear"),
        s.degradation_verdict(c("precision_at_10")).alias("degraded"),
        s.accuracy_winner(c("rmse"), c("mae") + F.lit(0.2)).alias("winner"),
    )
