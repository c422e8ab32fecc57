"""SQL of the input mappings and shared intermediate tables."""

_K = "cast(json_extract_string(props, '$.k') as int)"

_TABLES = {
    "ratings": """
select cast(o_custkey as int) as userId, cast(l_partkey as int) as movieId,
       cast(ceil(l_quantity/5)/2 as double) as rating,
       cast(epoch_us(l_shipdate)//1000000 as bigint) as timestamp
from (select o_custkey, l_partkey, l_quantity, l_shipdate,
             row_number() over (partition by o_custkey, l_partkey
               order by l_shipdate desc, l_orderkey desc, l_linenumber desc,
                        l_quantity desc, l_extendedprice desc) as rn
      from lineitem join orders on l_orderkey = o_orderkey) t
where rn = 1""",
    "movies": """
select cast(p_partkey as int) as movieId, p_name as title,
       concat(replace(p_name,' ','|'), '|', p_type) as genres
from part""",
    "tags": f"""
select cast(user_id as int) as userId, {_K} as movieId, event_type as tag,
       cast(epoch_us(ts)//1000000 as bigint) as timestamp
from events""",
    "links": """
select cast(l_partkey as int) as movieId, cast(min(l_suppkey) as int) as imdbId,
       cast(max(l_suppkey) as int) as tmdbId
from lineitem group by l_partkey""",
    "runs": f"""
select event_id as run_id,
       case when event_type = 'signup' then 'SVD' else 'ALS' end as model,
       case when event_type = 'signup' then null
            else concat('local[', case {_K} % 4 when 0 then '1' when 1 then '2'
                                               when 2 then '4' else '8' end, ']') end as cores,
       value as train_time, value/10 as prediction_time,
       cast(0.5 as double) + (user_id % 100)/cast(100 as double) as rmse,
       cast(0.8 as double) * (cast(0.5 as double) + (user_id % 100)/cast(100 as double)) as mae,
       (event_id % 20)/cast(100 as double) as precision_at_10,
       (event_id % 25)/cast(100 as double) as recall_at_10,
       (event_id % 30)/cast(100 as double) as ndcg_at_10,
       (event_id % 15)/cast(100 as double) as map_at_10
from events""",
    # Chronological split of users with at least five ratings.
    "labelled": """
select userId, movieId, rating, timestamp, rn <= greatest(1, cast(floor(n * 0.2::double) as bigint)) as in_test
from (select *, count(*) over (partition by userId) as n,
             row_number() over (partition by userId order by timestamp desc, movieId desc) as rn
      from ratings) where n >= 5""",
    "train": "select userId, movieId, rating, timestamp from labelled where not in_test",
    "test": "select userId, movieId, rating, timestamp from labelled where in_test",
    "relevant": "select * from test where rating >= 4.0",
    "pop": """
select movieId, count(*) as count, avg(rating) as avg_rating,
       avg(rating) * ln(1 + count(*)) as popularity_score
from train group by movieId""",
    "test_users": "select distinct userId from test",
    # Top-10 unseen items of every test user by popularity, exhaustively.
    "recs": """
select userId, cast(pos as int) as pos, movieId, popularity_score from (
  select u.userId, p.movieId, p.popularity_score,
         row_number() over (partition by u.userId order by round(p.popularity_score, 9) desc, p.movieId) as pos
  from test_users u cross join pop p
  where not exists (select 1 from train t where t.userId = u.userId and t.movieId = p.movieId))
where pos <= 10""",
    "some_train": "select * from train order by md5(concat_ws('-', '42', userId, movieId)), userId, movieId limit 5000",
    "n_rel": "select userId, count(*) as n_relevant from relevant group by userId",
    "judged": """
select r.userId, r.pos, r.movieId, r.popularity_score, n.n_relevant, t.movieId is not null as relevant
from recs r join n_rel n using (userId)
left join relevant t on t.userId = r.userId and t.movieId = r.movieId""",
    "idcg": """
select n, sum(1/log2(i + 1)) as ideal from range(1, 11) a(n), range(1, 11) b(i) where i <= n group by n""",
    "per_user": """
select userId, n_relevant, count(*) filter (relevant) as n_hits,
       count(*) filter (relevant) / cast(10 as double) as precision,
       count(*) filter (relevant) / cast(n_relevant as double) as recall,
       coalesce(sum(1/log2(pos + 1)) filter (relevant), 0) / max(ideal) as ndcg,
       coalesce(sum(hits / cast(pos as double)) filter (relevant), 0) / n_relevant as ap
from (select j.*, sum(relevant::int) over (partition by userId order by pos) as hits from judged j) j
join idcg on idcg.n = least(10, n_relevant)
group by userId, n_relevant""",
    "mu": "select avg(rating) as mu from train",
    "item_bias": """
select movieId, sum(rating - mu) / (25 + count(*)) as item_bias from train, mu group by movieId""",
    "user_bias": """
select userId, sum(rating - mu - item_bias) / (10 + count(*)) as user_bias
from train join item_bias using (movieId), mu group by userId""",
    "bias_pred": """
select t.userId, t.movieId, t.rating,
       greatest(0.5::double, least(5.0::double,
         mu + coalesce(user_bias, 0) + coalesce(item_bias, 0))) as prediction
from test t left join item_bias using (movieId) left join user_bias using (userId), mu""",
    "norms": "select userId, sqrt(sum(rating*rating)) as norm from train group by userId",
    "neighbours": """
select userId, cast(pos as int) as pos, neighbourId, similarity from (
  select d.*, row_number() over (partition by userId order by similarity desc, neighbourId) as pos
  from (select p.userId, p.neighbourId, dot / (a.norm * b.norm) as similarity
        from (select a.userId, b.userId as neighbourId, sum(a.rating*b.rating) as dot
              from train a join train b on a.movieId = b.movieId and a.userId <> b.userId
              group by a.userId, b.userId) p
        join norms a on a.userId = p.userId join norms b on b.userId = p.neighbourId) d)
where pos <= 20""",
}

_METRICS = [
    "train_time", "prediction_time", "rmse", "mae",
    "precision_at_10", "recall_at_10", "ndcg_at_10", "map_at_10",
]
_POP = ", ".join(
    f"median({m}) as {m}, avg({m}) as {m}_mean, stddev_pop({m}) as {m}_std" for m in _METRICS
)
_SAMPLE = ", ".join(f"median({m}) as {m}, stddev_samp({m}) as {m}_std" for m in _METRICS)
_CORES = "coalesce(try_cast(regexp_extract(cores, 'local\\[([^\\]]*)\\]', 1) as int), 1)"

_TABLES |= {
    "agg_pop": f"select model, cores, {_POP}, count(*) as n_runs from runs group by model, cores",
    "agg_sample": f"select model, cores, {_SAMPLE}, count(*) as n_runs from runs group by model, cores",
    "results": f"select *, {_CORES} as num_cores from agg_pop",
    "base": """
select min(case when model = 'SVD' then train_time end) as svd_train_time,
       min(case when model = 'SVD' then prediction_time end) as svd_prediction_time,
       min(case when model = 'ALS' and num_cores = 1 then train_time end) as als_1core_train_time
from results""",
    "fast": """
select r.*,
  case when model = 'SVD' then 1.0::double else svd_train_time / nullif(train_time, 0) end as speedup_vs_svd,
  case when model = 'ALS' then als_1core_train_time / nullif(train_time, 0) end as speedup_pure_spark,
  case when model = 'ALS' then als_1core_train_time / nullif(train_time, 0) end / num_cores as efficiency_pure_spark,
  svd_train_time / nullif(train_time, 0) as speedup_train,
  svd_train_time / nullif(train_time, 0) / num_cores as efficiency_train,
  svd_prediction_time / nullif(prediction_time, 0) as speedup_prediction,
  svd_prediction_time / nullif(prediction_time, 0) / num_cores as efficiency_prediction
from results r, base""",
    "matrix": """
select case when model = 'SVD' then 'SVD' else concat('ALS-', num_cores, 'c') end as label,
       rmse, mae, train_time, prediction_time, precision_at_10, recall_at_10, ndcg_at_10
from results""",
    "long": """
select label, metric, value from (
  unpivot matrix on rmse, mae, train_time, prediction_time, precision_at_10, recall_at_10, ndcg_at_10
  into name metric value value)""",
    "normal": """
select label, metric,
  case when metric in ('rmse', 'mae', 'train_time', 'prediction_time')
       then 1 - (value - lo) / (hi - lo + 1e-8::double) else (value - lo) / (hi - lo + 1e-8::double) end as value
from long join (select metric, min(value) as lo, max(value) as hi from long group by metric) using (metric)""",
    "scores": """
select label, sum(value * case metric when 'rmse' then 0.25::double when 'prediction_time' then 0.10::double
  when 'recall_at_10' then 0.10::double when 'ndcg_at_10' then 0.10::double else 0.15::double end) as overall_score
from normal group by label""",
}

# What each table reads, directly.
_NEEDS = {
    "labelled": ["ratings"], "train": ["labelled"], "test": ["labelled"], "relevant": ["test"], "some_train": ["train"], "pop": ["train"],
    "test_users": ["test"], "recs": ["test_users", "pop", "train"], "n_rel": ["relevant"],
    "judged": ["recs", "n_rel", "relevant"], "idcg": [], "per_user": ["judged", "idcg"],
    "mu": ["train"], "item_bias": ["train", "mu"], "user_bias": ["train", "item_bias", "mu"],
    "bias_pred": ["test", "item_bias", "user_bias", "mu"], "norms": ["train"], "neighbours": ["train", "norms"],
    "agg_pop": ["runs"], "agg_sample": ["runs"], "results": ["agg_pop"], "base": ["results"],
    "fast": ["results", "base"], "matrix": ["results"], "long": ["matrix"], "normal": ["long"], "scores": ["normal"],
}


def sql(body: str, *needs: str) -> str:
    """``body`` after a WITH clause of the tables it needs, and of those they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for below in _NEEDS.get(name, []):
            add(below)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    parts = [f"{name} as materialized ({_TABLES[name].strip()})" for name in ordered]
    return f"with {', '.join(parts)}\n{body.strip()}" if parts else body.strip()
