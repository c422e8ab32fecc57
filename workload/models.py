"""Rating predictors, recommenders and their metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from halfstar.functions.scalars import clip_rating
from halfstar.models import als, bias, item_mean, popularity, sgd, user_knn
from halfstar.operators import evaluate, factors
from halfstar.operators.sampling import sample_users_fraction
from halfstar.plans.runs import multi_seed_als, multi_seed_biased_mf
from halfstar.sources.schemas import RANKING_METRICS
from halfstar.sources.writers import materialise
from workload import tables as t
from workload.cte import sql
from workload.registry import query, rounded


def _fitted_als(spark, folder, **parameters):
    """(train, test, ALS model)."""
    return *t.split(spark, folder), t.fitted(spark, folder, f"als {parameters}", lambda train: als.als_fit(train, **parameters))


# Fitted factors differ between engines, so the queries of the models return what can
# be derived without them, beside flags that are computed from the model's own output.


@query("als_fit", sql("select userId, count(*) as n, true as solved from train group by userId", "train"))
def als_fit(spark, folder):
    """Whether the last half-step's normal equations hold for every user's factors."""
    train, _, model = _fitted_als(spark, folder)
    return als.normal_equations(model, train, reg=0.1).select("userId", "n", (F.col("residual") < 1e-3).alias("solved"))


_KNOWN = """
select userId, movieId, rating, true as is_dot_product from test
where userId in (select userId from train) and movieId in (select movieId from train)"""


def _flag_dot_products(model, predicted):
    joined = factors.factor_predict(model.userFactors, model.itemFactors, predicted)
    is_dot = F.abs(F.col("dot") - F.col("prediction")) < 1e-4
    return joined.select("userId", "movieId", "rating", is_dot.alias("is_dot_product"))


@query("als_predict", sql(_KNOWN, "train", "test"))
def als_predict(spark, folder):
    _, test, model = _fitted_als(spark, folder)
    return _flag_dot_products(model, als.als_predict(model, test.select("userId", "movieId", "rating")))


def _list_facts(recs, user_factors, item_factors, train, unseen=True):
    """Per user: length of the list, and whether its places are dense, its scores sorted and dot products, its items new.

    ``best``: no item that was left out, but for seen ones, scores above the last place. All
    pairs are scored for it, apart from the search that made the list.
    """
    recs = materialise(recs, "recs")
    scored = factors.factor_predict(user_factors, item_factors, recs)
    seen = train.select("userId", "movieId").withColumn("seen", F.lit(True))
    before = F.lag("score").over(Window.partitionBy("userId").orderBy("pos"))
    rows = scored.join(seen, ["userId", "movieId"], "left").withColumn("before", before)
    bounds = recs.groupBy("userId").agg((F.min("score") + 1e-6).alias("bound"))
    above = factors.count_above(user_factors.join(bounds.withColumnRenamed("userId", "id"), "id"), item_factors)
    over = lambda pairs, score: pairs.join(bounds, "userId").where(F.col(score) > F.col("bound")).groupBy("userId").count()
    known = over(recs, "score")
    if unseen:
        rated = train.select("userId", "movieId").join(bounds.select("userId"), "userId", "left_semi")
        known = known.unionAll(over(factors.factor_predict(user_factors, item_factors, rated), "dot"))
    known = known.groupBy("userId").agg(F.sum("count").alias("known"))
    best = above.select(F.col("id").alias("userId"), "above").join(known, "userId", "left")
    best = best.select("userId", (F.col("above") == F.coalesce("known", F.lit(0))).alias("best"))
    facts = rows.groupBy("userId").agg(
        F.count(F.lit(1)).alias("n"),
        ((F.max("pos") == F.count(F.lit(1))) & (F.count_distinct("movieId") == F.count(F.lit(1)))).alias("dense"),
        F.every(F.coalesce(F.col("before") >= F.col("score") - 1e-6, F.lit(True))).alias("sorted"),
        F.every(F.abs(F.col("dot") - F.col("score")) < 1e-3).alias("is_dot_product"),
        (F.count("seen") == 0).alias("all_unseen"),
    )
    return facts.join(best, "userId")


_LISTS = """
select u.userId, least(10, i.n{less}) as n, true as dense, true as sorted, true as is_dot_product, true as best{unseen}
from ({users}) u cross join (select count(distinct movieId) as n from train) i{seen}"""
_SEEN = " join (select userId, count(*) as n from train group by userId) s on s.userId = u.userId"
_NEW_LISTS = _LISTS.format(less=" - s.n", unseen=", true as all_unseen", users="select userId from test_users", seen=_SEEN)


@query("als_recommend_subset", sql(_LISTS.format(less="", unseen="", seen="", users="""
select userId from test_users where substr(md5(concat_ws('-', '42', userId)), 1, 8) < '40000000'"""), "train", "test_users"))
def als_recommend_subset(spark, folder):
    train, test, model = _fitted_als(spark, folder)
    recs = als.als_recommend_subset(model, sample_users_fraction(test, 0.25), 10)
    return _list_facts(recs, model.userFactors, model.itemFactors, train, unseen=False).drop("all_unseen")


@query("als_recommend_all", sql(_LISTS.format(less="", unseen="", seen="", users="select distinct userId from train"), "train"))
def als_recommend_all(spark, folder):
    train, _, model = _fitted_als(spark, folder)
    return _list_facts(als.als_recommend_all(model, 10), model.userFactors, model.itemFactors, train, unseen=False).drop("all_unseen")


@query("als_recommend_unseen", sql(_NEW_LISTS, "train", "test_users"))
def als_recommend_unseen(spark, folder):
    train, test, model = _fitted_als(spark, folder)
    recs = als.als_recommend_unseen(model, train, t.test_users(test), 10)
    return _list_facts(recs, model.userFactors, model.itemFactors, train)


@query(
    "als_ranking_report",
    sql("""
select count(distinct userId) as n_users, true as within_range
from test where rating >= 4.0""", "test"),
)
def als_ranking_report(spark, folder):
    """Ranking metrics of the fitted model: over whom they are averaged, and whether they can be what they are."""
    train, test, model = _fitted_als(spark, folder)
    report = evaluate.ranking_report(als.als_recommend_unseen(model, train, t.test_users(test), 10), test)
    metrics = [F.col(c).between(0, 1) for c in report.columns if c != "n_users"]
    return report.select("n_users", reduce(lambda a, b: a & b, metrics).alias("within_range"))


@query(
    "bias_baseline",
    sql("""
select 'user' as side, userId as id, round(user_bias, 6) as bias from user_bias
union all select 'item', movieId, round(item_bias, 6) from item_bias""", "user_bias", "item_bias"),
)
def bias_baseline(spark, folder):
    return rounded(bias.bias_table(bias.fit_bias(t.split(spark, folder)[0])), "bias")


@query(
    "als_topk_report",
    sql("""
select u.n as n_users, i.n as n_items, u.n * i.n as possible, true as no_more_than_all, true as exact
from (select count(distinct userId) as n from train) u, (select count(distinct movieId) as n from train) i""", "train"),
)
def als_topk_report(spark, folder):
    """How many pairs the search for the best items of all users scored: never more than all, and the lists are the best."""
    train, _, model = _fitted_als(spark, folder)
    top = factors.exact_topk(model.userFactors, model.itemFactors, 10)
    facts = _list_facts(top.recs, model.userFactors, model.itemFactors, train, unseen=False)
    counts = facts.agg(F.count(F.lit(1)).alias("n_users"), F.every("best").alias("exact"))
    items = model.itemFactors.agg(F.count(F.lit(1)).alias("n_items")).scalar()
    possible = F.lit(top.possible).cast("long")
    return counts.select("n_users", items.alias("n_items"), possible.alias("possible"), (F.lit(top.scored) <= possible).alias("no_more_than_all"), "exact")


def _fitted_biased_mf(spark, folder):
    return *t.split(spark, folder), t.fitted(spark, folder, "biased mf", sgd.sgd_fit)


@query("biased_mf", sql("select userId, movieId, rating, true as is_sum from test", "test"))
def biased_mf(spark, folder):
    """Every test pair, and whether its prediction is the clipped sum of mean, biases and dot product."""
    _, test, model = _fitted_biased_mf(spark, folder)
    predicted = model.predict(test.select("userId", "movieId", "rating"))
    users = model.users.select(F.col("id").alias("userId"), F.col("bias").alias("bu"))
    items = model.items.select(F.col("id").alias("movieId"), F.col("bias").alias("bi"))
    known = factors.factor_predict(model.users, model.items, predicted).select("userId", "movieId", "dot")
    base = predicted.join(users, "userId", "left").join(items, "movieId", "left").join(known, ["userId", "movieId"], "left")
    none = F.lit(0.0)
    total = clip_rating(F.lit(model.mean) + F.coalesce("bu", none) + F.coalesce("bi", none) + F.coalesce("dot", none))
    return base.select("userId", "movieId", "rating", (F.abs(total - F.col("prediction")) < 1e-6).alias("is_sum"))


# A rating that comes first of its user's and of its item's by a hash: no two of these share a user or an item.
_FIRST = """
select userId, movieId, rating, true as is_update
from (select *, row_number() over (partition by userId order by h, movieId) as a, row_number() over (partition by movieId order by h, userId) as b
      from (select *, (userId::bigint * 7919 + movieId::bigint * 104729) % 1000003 as h from train)) where a = 1 and b = 1"""


@query("biased_mf_update", sql(_FIRST, "train"))
def biased_mf_update(spark, folder):
    """One more epoch over ratings without common users or items: whether each moves its biases and factors as its gradient says."""
    train, _, model = _fitted_biased_mf(spark, folder)
    h = (F.col("userId").cast("long") * 7919 + F.col("movieId").cast("long") * 104729) % 1000003
    rows = train.select("userId", "movieId", "rating", h.alias("h"))
    first = lambda key, other: rows.groupBy(key).agg(F.min(F.col("h") * 2**40 + F.col(other)).alias(f"first_{key}"))
    some = rows.join(first("userId", "movieId"), "userId").join(first("movieId", "userId"), "movieId")
    some = some.where((F.col("h") * 2**40 + F.col("movieId") == F.col("first_userId")) & (F.col("h") * 2**40 + F.col("userId") == F.col("first_movieId")))
    some = materialise(some.select("userId", "movieId", "rating"), "first-ratings")
    after = sgd.sgd_fit(some, n_epochs=1, start=model)
    want = sgd.sgd_step(model, some, 0.005, 0.02)
    users = after.users.select(F.col("id").alias("userId"), F.concat(F.array("bias"), "features").alias("u"))
    items = after.items.select(F.col("id").alias("movieId"), F.concat(F.array("bias"), "features").alias("i"))
    met = want.join(users, "userId").join(items, "movieId")
    off = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    is_update = (off("u", F.concat(F.array("user_bias"), "user_features")) < 1e-9) & (off("i", F.concat(F.array("item_bias"), "item_features")) < 1e-9)
    return met.select("userId", "movieId", "rating", is_update.alias("is_update"))


@query("biased_mf_recommend", sql(_NEW_LISTS, "train", "test_users"))
def biased_mf_recommend(spark, folder):
    train, test, model = _fitted_biased_mf(spark, folder)
    recs = model.recommend_unseen(train, t.test_users(test), 10)
    return _list_facts(recs, *model.wide_factors(), train)


@query(
    "biased_mf_ranking_report",
    sql("select count(distinct userId) as n_users, true as within_range from test where rating >= 4.0", "test"),
)
def biased_mf_ranking_report(spark, folder):
    """The same report for biased matrix factorization."""
    train, test, model = _fitted_biased_mf(spark, folder)
    report = evaluate.ranking_report(model.recommend_unseen(train, t.test_users(test), 10), test)
    metrics = [F.col(c).between(0, 1) for c in report.columns if c != "n_users"]
    return report.select("n_users", reduce(lambda a, b: a & b, metrics).alias("within_range"))


@query("mf_rank10", sql(_KNOWN, "train", "test"))
def mf_rank10(spark, folder):
    _, test, model = _fitted_als(spark, folder, rank=10, max_iter=20)
    return _flag_dot_products(model, als.als_predict(model, test.select("userId", "movieId", "rating")))


@query(
    "popularity_model",
    sql("""
select movieId, count, round(avg_rating, 6) as avg_rating, round(popularity_score, 6) as popularity_score
from pop""", "pop"),
)
def popularity_model(spark, folder):
    train, _ = t.split(spark, folder)
    return rounded(popularity.popularity_model(train), "avg_rating", "popularity_score")


@query(
    "popularity_recommend",
    sql("select userId, pos, movieId, round(popularity_score, 6) as score from recs", "recs"),
)
def popularity_recommend(spark, folder):
    return rounded(t.popular_recs(spark, folder)[2], "score")


@query(
    "popularity_predict",
    sql("""
select t.userId, t.movieId, t.rating, round(coalesce(avg_rating, (select mu from mu)), 6) as prediction
from test t left join pop using (movieId)""", "test", "pop", "mu"),
)
def popularity_predict(spark, folder):
    train, test = t.split(spark, folder)
    return rounded(popularity.popularity_predict(train, test.select("userId", "movieId", "rating")), "prediction")


@query(
    "item_mean_model",
    sql("""
select t.userId, t.movieId, t.rating, i.count, round(coalesce(i.mean, (select mu from mu)), 6) as prediction
from test t left join (select movieId, avg(rating) as mean, count(*) as count from train
                       group by movieId having count(*) >= 5) i using (movieId)""", "test", "mu", "train"),
)
def item_mean_model(spark, folder):
    train, test = t.split(spark, folder)
    return rounded(item_mean.item_mean_predict(train, test.select("userId", "movieId", "rating")), "prediction")


@query(
    "user_knn_similarity",
    sql("select userId, pos, neighbourId, round(similarity, 6) as similarity from neighbours", "neighbours"),
)
def user_knn_similarity(spark, folder):
    return rounded(user_knn.user_knn_similarity(t.split(spark, folder)[0]), "similarity")


@query(
    "user_knn_predict",
    sql("""
select t.userId, t.movieId, t.rating,
       round(coalesce(w.weighted, m.mean, (select mu from mu)), 6) as prediction
from test t
left join (select t.userId, t.movieId, sum(similarity * r.rating) / sum(abs(similarity)) as weighted
           from test t join neighbours n on n.userId = t.userId
           join train r on r.userId = n.neighbourId and r.movieId = t.movieId
           group by t.userId, t.movieId) w on w.userId = t.userId and w.movieId = t.movieId
left join (select userId, avg(rating) as mean from train group by userId) m on m.userId = t.userId""",
        "test", "neighbours", "mu"),
)
def user_knn_predict(spark, folder):
    train, test = t.split(spark, folder)
    neighbours = user_knn.user_knn_similarity(train)
    pairs = test.select("userId", "movieId", "rating")
    return rounded(user_knn.user_knn_predict(train, pairs, neighbours), "prediction")


def _run_facts(log):
    """Per run: how many users its ranking metrics are averaged over, and whether its numbers can be what they are."""
    sane = F.col("rmse").between(F.col("mae"), 5.0) & (F.col("train_time") > 0) & F.col("cores").isNotNull()
    for metric in RANKING_METRICS:
        sane = sane & F.col(metric).between(0, 1)
    return log.select("run_id", "model", "seed", "n_users", sane.alias("sane"))


_RUNS = """
select run_id, '{model}' as model, {seed} + run_id as seed, (select count(distinct userId) from test where rating >= 4.0) as n_users, true as sane
from range({n}) r(run_id)"""


@query("multi_seed_fit", sql(_RUNS.format(model="ALS", seed=42, n=3), "test"))
def multi_seed_fit(spark, folder):
    train, test = t.split(spark, folder)
    return _run_facts(multi_seed_als(train, test, n_runs=3, users=t.test_users(test))[1])


@query("multi_seed_biased_mf", sql(_RUNS.format(model="SVD", seed=43, n=3), "test"))
def multi_seed_biased(spark, folder):
    train, test = t.split(spark, folder)
    return _run_facts(multi_seed_biased_mf(train, test, users=t.test_users(test))[1])


# --- metrics


@query(
    "rmse",
    sql("select round(sqrt(avg(pow(rating - prediction, 2))), 6) as rmse from bias_pred", "bias_pred"),
)
def rmse(spark, folder):
    return rounded(_bias_predictions(spark, folder).agg(evaluate.rmse().alias("rmse")), "rmse")


def _bias_predictions(spark, folder):
    train, test = t.split(spark, folder)
    return bias.fit_bias(train).predict(test)


@query("mae", sql("select round(avg(abs(rating - prediction)), 6) as mae from bias_pred", "bias_pred"))
def mae(spark, folder):
    return rounded(_bias_predictions(spark, folder).agg(evaluate.mae().alias("mae")), "mae")


@query(
    "compare_errors",
    sql("""
select count(*) as n_common,
       round(sqrt(avg(pow(b.rating - b.prediction, 2))), 6) as rmse_first,
       round(avg(abs(b.rating - b.prediction)), 6) as mae_first,
       round(sqrt(avg(pow(b.rating - p.avg_rating, 2))), 6) as rmse_second,
       round(avg(abs(b.rating - p.avg_rating)), 6) as mae_second
from bias_pred b join pop p using (movieId)""", "bias_pred", "pop"),
)
def compare_errors(spark, folder):
    train, test = t.split(spark, folder)
    items = popularity.popularity_model(train).select("movieId", F.col("avg_rating").alias("prediction"))
    compared = evaluate.compare_errors(bias.fit_bias(train).predict(test), test.join(items, "movieId"))
    return rounded(compared, "rmse_first", "mae_first", "rmse_second", "mae_second")


def _per_user(spark, folder):
    _, test, recs = t.popular_recs(spark, folder)
    return evaluate.user_ranking_metrics(recs, test)


def _metric_query(name: str, column: str) -> None:
    @query(name, sql(f"""
select round(coalesce(avg({column}), 0), 6) as {name}, count(*) as n_users from per_user""", "per_user"))
    def run(spark, folder):
        averaged = _per_user(spark, folder).agg(
            evaluate.macro_average(column).alias(name), F.count(F.lit(1)).alias("n_users")
        )
        return rounded(averaged, name)


for _name, _column in {
    "precision_at_k": "precision", "recall_at_k": "recall", "ndcg_at_k": "ndcg", "map_at_k": "ap",
}.items():
    _metric_query(_name, _column)


@query(
    "ranking_report",
    sql("""
select count(*) as n_users, round(coalesce(avg(precision), 0), 6) as precision_at_10,
       round(coalesce(avg(recall), 0), 6) as recall_at_10, round(coalesce(avg(ndcg), 0), 6) as ndcg_at_10,
       round(coalesce(avg(ap), 0), 6) as map_at_10 from per_user""", "per_user"),
)
def ranking_report(spark, folder):
    _, test, recs = t.popular_recs(spark, folder)
    report = evaluate.ranking_report(recs, test)
    return rounded(report, "precision_at_10", "recall_at_10", "ndcg_at_10", "map_at_10")


@query(
    "prediction_coverage",
    sql("""
select count(*) filter (known) as n_predicted, count(*) as n_test,
       round(count(*) filter (known) / count(*)::double, 6) as coverage
from (select userId in (select userId from train) and movieId in (select movieId from train) as known from test)""",
        "train", "test"),
)
def prediction_coverage(spark, folder):
    return rounded(evaluate.prediction_coverage(*t.split(spark, folder)), "coverage")
