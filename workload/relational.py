"""Joins, aggregates, windows, top-k and set operations on ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from halfstar.models import user_knn
from halfstar.models.als import als_fit, als_predict, factor_predict
from halfstar.models.bias import fit_bias
from halfstar.models.popularity import popularity_scores
from halfstar.operators import evaluate, profile, recommend, sampling
from halfstar.operators import split as splits
from halfstar.plans import compare, runs as run_plans
from halfstar.sources.schemas import RUN_METRICS
from workload import tables as t
from workload.cte import sql
from workload.registry import query, rounded

# --- joins


@query(
    "semi_active_users",
    sql("""
select * from ratings where userId in (select userId from ratings group by userId having count(*) >= 5)""", "ratings"),
)
def semi_active_users(spark, folder):
    return splits.active_users(t.ratings(spark, folder), 5)


_SAMPLE = "order by md5(concat_ws('-', '42', userId, movieId)), userId, movieId limit 5000"


@query(
    "semi_sample_test",
    sql(f"""
select * from test where userId in (select userId from (select userId, movieId from train {_SAMPLE}) s)""", "train", "test"),
)
def semi_sample_test(spark, folder):
    return sampling.sample_split(*t.split(spark, folder), n=5000, seed=42)[1]


@query(
    "cross_user_catalog",
    sql("""
select u.userId, count(*) as n_items, cast(sum(i.movieId) as bigint) as item_id_sum,
       count(*) filter (s.movieId is null) as n_unseen,
       cast(coalesce(sum(i.movieId) filter (s.movieId is null), 0) as bigint) as unseen_id_sum
from test_users u cross join (select distinct movieId from train) i
left join train s on s.userId = u.userId and s.movieId = i.movieId
group by u.userId""", "test_users", "train"),
)
def cross_user_catalog(spark, folder):
    train, test = t.split(spark, folder)
    return recommend.catalogue_counts(train, t.test_users(test))


_UNSEEN = """
select c.userId, c.movieId, round(p.popularity_score, 6) as score
from (select distinct userId, movieId from tags) c join pop p using (movieId)
where not exists (select 1 from train t where t.userId = c.userId and t.movieId = c.movieId)"""


def _unseen_tagged(spark, folder):
    """Every (user, item) that was tagged, with the item's popularity, less the pairs rated in train."""
    train, _ = t.split(spark, folder)
    tagged = t.tags(spark, folder).select("userId", "movieId").distinct()
    return recommend.drop_seen(tagged.join(popularity_scores(train), "movieId").select("userId", "movieId", "score"), train)


@query("anti_unseen", sql(_UNSEEN, "tags", "pop", "train"))
def anti_unseen(spark, folder):
    return rounded(_unseen_tagged(spark, folder), "score")


@query(
    "inner_hits",
    sql("select userId, pos, movieId from judged where relevant", "judged"),
)
def inner_hits(spark, folder):
    _, test, recs = t.popular_recs(spark, folder)
    return evaluate.inner_hits(recs, test).select("userId", "pos", "movieId")


@query("join_user_truth", sql("select userId, pos, movieId, n_relevant, relevant from judged", "judged"))
def join_user_truth(spark, folder):
    _, test, recs = t.popular_recs(spark, folder)
    return evaluate.join_user_truth(recs, test).select("userId", "pos", "movieId", "n_relevant", "relevant")


@query(
    "inner_factors_drop",
    sql("""
select userId, movieId, rating, true as is_dot_product from test
where userId in (select userId from train) and movieId in (select movieId from train)""", "train", "test"),
)
def inner_factors_drop(spark, folder):
    """Pairs ALS predicts, each with whether its prediction is the dot product of the joined factors."""
    train, test = t.split(spark, folder)
    model = t.fitted(spark, folder, "als {}", als_fit)
    predicted = als_predict(model, test.select("userId", "movieId", "rating"))
    joined = factor_predict(model.userFactors, model.itemFactors, predicted)
    return joined.select(
        "userId", "movieId", "rating", (F.abs(F.col("dot") - F.col("prediction")) < 1e-4).alias("is_dot_product")
    )


@query(
    "left_factors_fallback",
    sql("select userId, movieId, rating, round(prediction, 6) as prediction from bias_pred", "bias_pred"),
)
def left_factors_fallback(spark, folder):
    train, test = t.split(spark, folder)
    pairs = test.select("userId", "movieId", "rating")
    return rounded(fit_bias(train).predict(pairs), "prediction")


@query(
    "broadcast_baseline",
    sql("""
select model, num_cores, round(svd_train_time, 6) as svd_train_time,
       round(svd_prediction_time, 6) as svd_prediction_time, round(als_1core_train_time, 6) as als_1core_train_time
from results, base""", "runs", "base"),
)
def broadcast_baseline(spark, folder):
    facts = ["svd_train_time", "svd_prediction_time", "als_1core_train_time"]
    joined = compare.broadcast_baseline(t.saved_results(spark, folder))
    return rounded(joined.select("model", "num_cores", *facts), *facts)


@query(
    "self_join_neighbours",
    sql("""
select r.userId, count(*) filter (o.userId is not null) as n_pairs,
       round(coalesce(sum(r.rating * o.rating), 0), 6) as product_sum
from train r left join train o on o.movieId = r.movieId and o.userId <> r.userId
group by r.userId""", "train"),
)
def self_join_neighbours(spark, folder):
    return rounded(user_knn.neighbour_pairs(t.split(spark, folder)[0]), "product_sum")


# --- aggregates


@query(
    "table_counts",
    sql("""
select 'ratings' as "table", count(*) as n from ratings union all select 'movies', count(*) from movies
union all select 'tags', count(*) from tags union all select 'links', count(*) from links""",
        "ratings", "movies", "tags", "links"),
)
def table_counts(spark, folder):
    named = {name: getattr(t, name)(spark, folder) for name in ("ratings", "movies", "tags", "links")}
    return profile.table_counts(**named)


@query(
    "distinct_counts",
    sql("""
select 'users' as entity, count(distinct userId) as n from ratings
union all select 'movies', count(distinct movieId) from ratings
union all select 'tags', count(distinct tag) from tags""", "ratings", "tags"),
)
def distinct_counts(spark, folder):
    return profile.distinct_counts(t.ratings(spark, folder), t.tags(spark, folder))


@query(
    "rating_summary",
    sql("""
select min(rating) as min_rating, max(rating) as max_rating, round(avg(rating), 6) as avg_rating,
       round(stddev_samp(rating), 6) as std_rating from ratings""", "ratings"),
)
def rating_summary(spark, folder):
    return rounded(profile.rating_summary(t.ratings(spark, folder)), "avg_rating", "std_rating")


@query(
    "avg_ratings_per_entity",
    sql("""
select round(count(*) / count(distinct userId)::double, 6) as avg_per_user,
       round(count(*) / count(distinct movieId)::double, 6) as avg_per_movie from ratings""", "ratings"),
)
def avg_ratings_per_entity(spark, folder):
    return rounded(profile.avg_ratings_per_entity(t.ratings(spark, folder)), "avg_per_user", "avg_per_movie")


@query(
    "rating_distribution",
    sql("""
select rating, count(*) as count, round(100.0::double * count(*) / (select count(*) from ratings), 6) as percentage
from ratings group by rating""", "ratings"),
)
def rating_distribution(spark, folder):
    return rounded(profile.rating_distribution(t.ratings(spark, folder)), "percentage")


@query(
    "matrix_density",
    sql("""
select n_users, n_movies, n_ratings, n_users * n_movies as possible_ratings,
       round(100.0::double * n_ratings / (n_users * n_movies), 6) as density_percent,
       round(100.0::double - 100.0::double * n_ratings / (n_users * n_movies), 6) as sparsity_percent
from (select count(*) as n_ratings, count(distinct userId) as n_users, count(distinct movieId) as n_movies
      from ratings)""", "ratings"),
)
def matrix_density(spark, folder):
    return rounded(profile.matrix_density(t.ratings(spark, folder)), "density_percent", "sparsity_percent")


@query("user_activity", sql("select userId, count(*) as n from ratings group by userId", "ratings"))
def user_activity(spark, folder):
    return profile.user_activity(t.ratings(spark, folder))


@query("item_popularity", sql("select movieId, count(*) as n from ratings group by movieId", "ratings"))
def item_popularity(spark, folder):
    return profile.item_popularity(t.ratings(spark, folder))


@query(
    "activity_extremes",
    sql("""
(select 'user' as entity, userId as id, count(*) as n from ratings group by userId order by n desc, id limit 1)
union all
(select 'movie', movieId, count(*) as n from ratings group by movieId order by n desc, movieId limit 1)""", "ratings"),
)
def activity_extremes(spark, folder):
    return profile.activity_extremes(t.ratings(spark, folder))


def _histogram_sql(key: str, bins: int) -> str:
    return sql(f"""
select cast(bin as int) as bin, round(lo + bin * (hi - lo) / {bins}, 6) as low,
       round(lo + (bin + 1) * (hi - lo) / {bins}, 6) as high,
       count(*) as n_entities, round(mean, 6) as mean_n, hi as max_n
from (select least({bins - 1}, cast(floor((n - lo) / ((hi - lo) / {bins}::double)) as bigint)) as bin, lo, hi, mean
      from (select count(*) as n from ratings group by {key}) c,
           (select min(n)::double as lo, max(n)::double as hi, avg(n) as mean
            from (select count(*) as n from ratings group by {key})) l)
group by bin, lo, hi, mean""", "ratings")


@query("hist_user_activity", _histogram_sql("userId", 30))
def hist_user_activity(spark, folder):
    return rounded(profile.histogram(profile.user_activity(t.ratings(spark, folder)), 30), "low", "high", "mean_n")


@query("hist_item_popularity", _histogram_sql("movieId", 50))
def hist_item_popularity(spark, folder):
    return rounded(profile.histogram(profile.item_popularity(t.ratings(spark, folder)), 50), "low", "high", "mean_n")


@query(
    "genre_counts",
    sql("""
select genre, count(*) as n from (select unnest(string_split(genres, '|')) as genre from movies)
where genre <> '' group by genre order by n desc, genre limit 10""", "movies"),
)
def genre_counts(spark, folder):
    return profile.genre_counts(t.movies(spark, folder))


_ROUND_SAMPLE = ", ".join(f"round({m}, 6) as {m}, round({m}_std, 6) as {m}_std" for m in RUN_METRICS)
_ROUND_POP = ", ".join(
    f"round({m}, 6) as {m}, round({m}_mean, 6) as {m}_mean, round({m}_std, 6) as {m}_std" for m in RUN_METRICS
)


def _round_all(df):
    return rounded(df, *[c for c in df.columns if c.startswith(tuple(RUN_METRICS))])


@query("agg_runs_sample_std", sql(f"select model, cores, {_ROUND_SAMPLE}, n_runs from agg_sample", "runs", "agg_sample"))
def agg_runs_sample_std(spark, folder):
    return _round_all(run_plans.agg_runs_sample_std(t.runs(spark, folder)))


@query("agg_runs_pop_std", sql(f"select model, cores, {_ROUND_POP}, n_runs from agg_pop", "runs", "agg_pop"))
def agg_runs_pop_std(spark, folder):
    return _round_all(run_plans.agg_runs_pop_std(t.runs(spark, folder)))


def _best(name: str, column: str, order: str) -> str:
    return f"""(select '{name}' as criterion, model, num_cores, round({column}, 6) as value
from fast where {column} is not null order by {column} {order}, model, num_cores limit 1)"""


@query(
    "best_by_metric",
    sql(" union all ".join([
        _best("best_rmse", "rmse", "asc"), _best("fastest_training", "train_time", "asc"),
        _best("best_speedup", "speedup_train", "desc"), _best("best_efficiency", "efficiency_train", "desc"),
    ]), "runs", "fast"),
)
def best_by_metric(spark, folder):
    return rounded(compare.best_by_metric(t.fast_results(spark, folder)), "value")


@query(
    "macro_average",
    sql("""
select count(*) as n_users, round(coalesce(avg(precision), 0), 6) as precision_at_10,
       (select coalesce(avg(precision), 0) from per_user where n_relevant < 0) as nobody
from per_user""", "per_user"),
)
def macro_average(spark, folder):
    _, test, recs = t.popular_recs(spark, folder)
    per_user = evaluate.user_ranking_metrics(recs, test)
    nobody = per_user.where(F.col("n_relevant") < 0).agg(evaluate.macro_average("precision")).scalar()
    return rounded(
        per_user.agg(
            F.count(F.lit(1)).alias("n_users"), evaluate.macro_average("precision").alias("precision_at_10")
        ).withColumn("nobody", nobody),
        "precision_at_10",
    )


@query(
    "pivot_user_item",
    sql("""
select userId, """ + ", ".join(
        f"coalesce(max(case when place = {p} then rating end), 0) as item_{p}" for p in range(1, 21)
    ) + """,
       count(*) filter (place > 20) as other_n, coalesce(sum(rating) filter (place > 20), 0) as other_sum
from ratings left join (
  select movieId, row_number() over (order by n desc, movieId) as place
  from (select movieId, count(*) as n from ratings group by movieId)) using (movieId)
group by userId""", "ratings"),
)
def pivot_user_item(spark, folder):
    return profile.pivot_user_item(t.ratings(spark, folder), 20)


# --- windows


@query(
    "temporal_split",
    sql("select userId, movieId, rating, timestamp, in_test from labelled", "labelled"),
)
def temporal_split(spark, folder):
    return splits.label_split(t.ratings(spark, folder))


@query(
    "rank_candidates",
    sql(f"""
select userId, movieId, score,
       cast(row_number() over (partition by userId order by round(raw, 9) desc, movieId) as int) as pos
from (select h.*, p.popularity_score as raw from ({_UNSEEN}) h join pop p using (movieId))""", "tags", "pop", "train"),
)
def rank_candidates(spark, folder):
    return rounded(recommend.rank_candidates(_unseen_tagged(spark, folder)), "score")


@query(
    "cap_candidates",
    sql("""
select userId, movieId from (
  select userId, movieId, row_number() over (partition by userId
    order by md5(concat_ws('-', '42', userId, movieId)), movieId) as n from test)
where n <= 3""", "test"),
)
def cap_candidates(spark, folder):
    """Test pairs are unseen in train by definition; three random ones per user."""
    unseen = t.split(spark, folder)[1].select("userId", "movieId")
    return sampling.cap_candidates(unseen, cap=3, seed=42)


@query(
    "running_hits",
    sql("""
select userId, pos, movieId, relevant,
       cast(sum(relevant::int) over (partition by userId order by pos) as bigint) as hits from judged""", "judged"),
)
def running_hits(spark, folder):
    _, test, recs = t.popular_recs(spark, folder)
    judged = evaluate.join_user_truth(recs, test)
    return evaluate.running_hits(judged).select("userId", "pos", "movieId", "relevant", "hits")


@query("minmax_normalise", sql("select label, metric, round(value, 6) as value from normal", "runs", "normal"))
def minmax_normalise(spark, folder):
    normal = compare.minmax_normalise(compare.metric_matrix(t.saved_results(spark, folder)))
    return rounded(compare.to_long(normal), "value")


@query(
    "ideal_scaling",
    sql("""
select num_cores, round(train_time, 6) as train_time,
       round(first_value(train_time) over (order by num_cores) / num_cores, 6) as ideal_time
from results where model = 'ALS'""", "runs", "results"),
)
def ideal_scaling(spark, folder):
    ideal = compare.ideal_scaling(t.saved_results(spark, folder)).select("num_cores", "train_time", "ideal_time")
    return rounded(ideal, "train_time", "ideal_time")


@query(
    "median_run",
    sql("""
select model, cores, run_id, round(rmse, 6) as rmse, round(med, 6) as median_rmse from (
  select r.*, med, row_number() over (partition by r.model, r.cores
           order by round(abs(r.rmse - med), 9), run_id) as n
  from runs r join (select model, cores, median(rmse) as med from runs group by model, cores) m
    on m.model = r.model and m.cores is not distinct from r.cores)
where n = 1""", "runs"),
)
def median_run(spark, folder):
    return rounded(run_plans.median_run(t.runs(spark, folder)), "rmse", "median_rmse")


# --- top-k and samples


@query(
    "topk_per_user",
    sql("""
select userId, movieId, score, cast(pos as int) as pos from (
  select userId, movieId, rating as score,
         row_number() over (partition by userId order by rating desc, movieId) as pos from ratings)
where pos <= 10""", "ratings"),
)
def topk_per_user(spark, folder):
    return recommend.topk_per_user(t.ratings(spark, folder), 10)


@query(
    "topn_global",
    sql("select movieId, count(*) as n from ratings group by movieId order by n desc, movieId limit 10", "ratings"),
)
def topn_global(spark, folder):
    return profile.top_items(t.ratings(spark, folder), 10)


@query("sample_exact", sql(f"select * from train {_SAMPLE}", "train"))
def sample_exact(spark, folder):
    return sampling.sample_exact(t.split(spark, folder)[0], 5000, 42, "userId", "movieId")


@query(
    "sample_users_exact",
    sql("""
select userId from test_users order by md5(concat_ws('-', '42', userId)), userId limit 500""", "test_users"),
)
def sample_users_exact(spark, folder):
    return sampling.sample_users_exact(t.split(spark, folder)[1], 500)


@query(
    "sample_users_fraction",
    sql("""
select userId from test_users
where substr(md5(concat_ws('-', '42', userId)), 1, 8) < '40000000'""", "test_users"),
)
def sample_users_fraction(spark, folder):
    return sampling.sample_users_fraction(t.split(spark, folder)[1], 0.25)


# --- set operations


@query(
    "union_results",
    sql("""
select run_id, model, round(rmse, 6) as rmse, 50 as n_factors, null::int as rank, null as cores
from runs where model = 'SVD'
union all
select run_id, model, round(rmse, 6), null, 20, cores from runs where model = 'ALS'""", "runs"),
)
def union_results(spark, folder):
    log = t.runs(spark, folder)
    svd = log.where("model = 'SVD'").select("run_id", "model", "rmse", F.lit(50).alias("n_factors"))
    als = log.where("model = 'ALS'").select("run_id", "model", "rmse", F.lit(20).alias("rank"), "cores")
    return rounded(run_plans.union_results(svd, als), "rmse")


@query(
    "union_user_parts",
    sql("""
select (select count(*) from active) as n_input,
       (select count(*) from train) + (select count(*) from test) as n_union,
       (select count(*) from train join test using (userId, movieId)) as n_overlap,
       (select count(*) from active a where not exists (select 1 from train t where t.userId = a.userId and t.movieId = a.movieId)
          and not exists (select 1 from test t where t.userId = a.userId and t.movieId = a.movieId)) as n_missing
from (select 1) one""".replace(
        "active", "(select * from ratings where userId in (select userId from ratings group by userId having count(*) >= 5))"
    ), "train", "test"),
)
def union_user_parts(spark, folder):
    train, test = t.split(spark, folder)
    return splits.check_split(splits.active_users(t.ratings(spark, folder)), train, test)


@query(
    "distinct_users",
    sql("""
select 'user' as entity, userId as id from test_users
union all select 'movie', movieId from (select distinct movieId from train)""", "test_users", "train"),
)
def distinct_users(spark, folder):
    train, test = t.split(spark, folder)
    items = train.select("movieId").distinct()
    return (
        t.test_users(test).select(F.lit("user").alias("entity"), F.col("userId").alias("id"))
        .unionAll(items.select(F.lit("movie"), "movieId"))
    )
