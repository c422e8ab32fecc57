import os
import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from halfstar import session
from halfstar.operators import profile, skew, split
from halfstar.sources import readers, startables, writers
from tests.fixtures import ratings, rows_of


@pytest.fixture
def dataset(tmp_path):
    files = {
        "ratings": "userId,movieId,rating,timestamp\n1,1,4.0,964982703\n1,3,4.5,964981247\n",
        "movies": 'movieId,title,genres\n1,"Title, The (1995)",Adventure|Animation\n3,Other,Comedy\n',
        "tags": "userId,movieId,tag,timestamp\n",
        "links": "movieId,imdbId,tmdbId\n1,0114709,862\n3,0113228,\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return tmp_path


def test_load_dataset(spark, dataset):
    data = readers.load_dataset(spark, str(dataset))
    assert rows_of(data.ratings, "userId", "movieId", "rating") == [(1, 1, 4.0), (1, 3, 4.5)]
    assert data.movies.where("movieId = 1").first().title == "Title, The (1995)"
    assert data.tags.isEmpty() and data.links.where("movieId = 3").first().tmdbId is None
    counts = dict(rows_of(profile.distinct_counts(data.ratings, data.tags), "entity", "n"))
    assert counts == {"users": 1, "movies": 2, "tags": 0}
    assert dict(rows_of(profile.table_counts(**data._asdict()), "table", "n"))["tags"] == 0


def test_a_missing_table_is_one_error(spark, dataset):
    (dataset / "links.csv").unlink()
    with pytest.raises(readers.DatasetNotFound, match="links"):
        readers.load_dataset(spark, str(dataset))


def test_typed_ratings(spark):
    typed = readers.typed_ratings(ratings(spark, [(1, 2, 3.5, 4_000_000_000)]))
    assert [t for _, t in typed.dtypes] == ["int", "int", "float", "bigint"]
    assert typed.first().timestamp == 4_000_000_000


def test_latest_rating_wins(spark):
    got = readers.latest_ratings(ratings(spark, [(1, 2, 3.0, 5), (1, 2, 4.0, 9), (1, 2, 5.0, 7), (2, 2, 1.0, 1)]), "timestamp")
    assert rows_of(got, "userId", "movieId", "rating", "timestamp") == [(1, 2, 4.0, 9), (2, 2, 1.0, 1)]


def test_sinks(spark, tmp_path):
    df = ratings(spark, [(1, 2, 3.5, 4), (2, 3, 1.0, 5)])
    for fmt in ("csv", "parquet"):
        paths = writers.write_split(df, df.limit(0), str(tmp_path / fmt), fmt)
        again = [spark.read.schema(df.schema).option("header", True).format(fmt).load(p) for p in paths]
        assert rows_of(again[0], *df.columns) == rows_of(df, *df.columns) and again[1].isEmpty()
    writers.write_csv(df, str(tmp_path / "one"), single_file=True)
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1
    assert readers.read_results(spark, str(tmp_path / "one")).schema["rating"].dataType.simpleString() == "double"
    for _ in range(2):
        writers.append_runs(df, str(tmp_path / "log"))
    assert writers.read_runs(spark, str(tmp_path / "log"), df.schema).count() == 4


def test_appends_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "log")
    df = ratings(spark, [(1, 2, 3.5, 4), (2, 3, 1.0, 5)])
    assert writers.append_runs(df, path, "first") and not writers.append_runs(df, path, "first")
    # Killed while writing runs: an attempt without a commit.
    df.write.parquet(f"{path}/attempts/attempt=killed")
    assert writers.read_runs(spark, path, df.schema).count() == 2
    # Killed while committing: a commit without rows.
    os.makedirs(writers._commit_path(path, "second") + "/_temporary/0")
    assert not writers.batch_committed(spark, path, "second")
    assert writers.append_runs(df, path, "second") and not writers.append_runs(df, path, "second")
    again = writers.read_runs(spark, path, df.schema)
    assert again.columns == df.columns and rows_of(again, "userId") == [(1,), (1,), (2,), (2,)]


def test_stored_halves_need_no_shuffle(spark, halves):
    from halfstar.operators import evaluate, profile, recommend

    train, test = writers.store_split(*halves, buckets=4)
    assert rows_of(train, *train.columns) == rows_of(halves[0], *train.columns)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    moved = "Exchange hashpartitioning"
    keep = {key: spark.conf.get(key) for key in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for key, value in zip(keep, ("false", "-1")):
            spark.conf.set(key, value)
        per_user = train.groupBy("userId").count().join(test.groupBy("userId").count(), "userId", "left")
        lists = recommend.topk_per_user(train)
        for df in (profile.user_activity(train), lists, per_user, evaluate.join_user_truth(lists, test)):
            assert moved not in plan(df) and "Bucketed: true" in plan(df)
        assert moved in plan(recommend.topk_per_user(halves[0]))
        stored, plain = (evaluate.ranking_report(recommend.topk_per_user(a), b).first() for a, b in ((train, test), halves))
        assert stored == plain
    finally:
        for key, value in keep.items():
            spark.conf.set(key, value)


def test_every_line_is_accounted_for(spark, tmp_path):
    os.makedirs(tmp_path / "d")
    lines = ["userId,movieId,rating,timestamp", "1,2,3.5,4", "1,x,3.5,4", "1,2", "1,2,3.5,4,5", ",2,3.5,4", "2,3,,5", "3,4,1.0,", "", '"4",5,2.0,6', "5,6,good,7"]
    (tmp_path / "d/ratings.csv").write_text("\n".join(lines) + "\n")
    got = readers.scan_checked(spark, str(tmp_path / "d"), "ratings", max_bad=0.9)
    assert rows_of(got.rows, "userId", "movieId", "rating") == [(1, 2, 3.5), (3, 4, 1.0), (4, 5, 2.0)]
    rejects = sorted((r.reason, r.line) for r in got.rejects.collect())
    assert [r for r, _ in rejects] == ["incomplete"] * 2 + ["malformed"] * 4
    assert {x for r, x in rejects if r == "malformed"} == {"1,x,3.5,4", "1,2", "1,2,3.5,4,5", "5,6,good,7"}
    assert all(r.file.endswith("ratings.csv") for r in got.rejects.collect())
    assert (got.n_rows, got.n_rejects) == (3, 6)
    with pytest.raises(readers.BadLines, match="6 of 9 lines"):
        readers.scan_checked(spark, str(tmp_path / "d"), "ratings", max_bad=0.5)
    (tmp_path / "d/ratings.csv").write_text(lines[0] + "\n")
    none = readers.scan_checked(spark, str(tmp_path / "d"), "ratings")
    assert none.rows.isEmpty() and (none.n_rows, none.n_rejects) == (0, 0)


def test_checked_lines_are_not_sorted(spark, tmp_path, monkeypatch):
    """A table written by folders is sorted by them, and the task holds all its lines."""
    (tmp_path / "ratings.csv").write_text("userId,movieId,rating,timestamp\n1,2,3.5,4\nx,2,3.5,4\n")
    by = []
    monkeypatch.setattr(readers, "materialise", lambda df, name, *partition_by: by.append(partition_by) or writers.materialise(df, name, *partition_by))
    got = readers.scan_checked(spark, str(tmp_path), "ratings", max_bad=0.5)
    assert by == [()] and (got.rows.count(), got.rejects.count()) == (1, 1)


def test_packed_latest_is_the_latest(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(5), rng.randrange(4), rng.randrange(1, 11) / 2, rng.randrange(3), rng.randrange(3), rng.randrange(2)) for _ in range(400)]
    rows += [(9, 9, 5.0, 4_102_444_800, 10**17, 7), (9, 9, 0.5, 4_102_444_800, 10**17 - 1, 9)]
    df = spark.createDataFrame(rows, "userId int, movieId int, rating double, timestamp long, o long, l int")
    got = readers.latest_packed(df, {"o": 18, "l": 5})
    assert rows_of(got, *got.columns) == rows_of(readers.latest_ratings(df.withColumn("r", F.col("rating")), "timestamp", "o", "l", "r"), "userId", "movieId", "rating", "timestamp")
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text and "SortAggregate" not in text and "Sort [" not in text
    with pytest.raises(Exception, match="o is negative or has over 3 digits"):
        readers.latest_packed(df, {"o": 3, "l": 5}).collect()
    with pytest.raises(ValueError, match="digits"):
        readers.latest_packed(df, {"o": 18, "l": 18})


def test_recency_in_a_long(spark):
    """Numbers whose ranges fit into 63 bits are one long; others, nulls only and negative ones are left to the decimal."""
    rng = random.Random(6)
    make = lambda rows: spark.createDataFrame(rows, "userId int, movieId int, rating double, timestamp long, o long, l int")
    rows = [(rng.randrange(5), rng.randrange(4), rng.randrange(1, 11) / 2, 10**9 + rng.randrange(3), 10**7 - rng.randrange(3), rng.randrange(2)) for _ in range(300)]
    rows += [(7, 7, None, 1, 1, 1), (7, 8, 1.0, None, 1, 1)]
    df = make(rows)
    key, packed = readers.recency_key(df, {"o": 18, "l": 5})
    got = readers.latest_packed(df.select("userId", "movieId", key.alias("key")), {"o": 18, "l": 5}, packed)
    plain = readers.latest_packed(df, {"o": 18, "l": 5})
    assert rows_of(got, *got.columns) == rows_of(plain, *plain.columns) and got.schema == plain.schema and got.count() == 20
    assert "decimal" not in got._jdf.queryExecution().executedPlan().toString()
    assert [readers.recency_key(make([(1, 1, 1.0, *x)]), {"o": 18, "l": 5}) for x in [(-1, 1, 1), (None, 1, 1), (1, 1, 10**5)]] == [None] * 3
    assert readers.recency_key(make([(1, 1, 1.0, 0, 0, 0), (1, 1, 5.0, 2**32, 10**10, 1)]), {"o": 18, "l": 5}) is None
    with pytest.raises(Exception, match="o is not from"):
        make([(1, 1, 1.0, 10**9, 0, 1)]).select(key).collect()


def test_large_tables_are_stored_by_user(spark, sf, monkeypatch):
    """Users are counted and their halves cut without another shuffle; a user who may be too large for a task keeps all from it."""
    from workload import tables

    whole, labels = (rows_of(f(spark, sf), *f(spark, sf).columns) for f in (tables.ratings, tables.labelled))
    monkeypatch.setattr(skew, "DEALT_FROM", 1000)
    monkeypatch.setattr(skew, "DEALT_ROWS", 500)
    for staged in ("_staged", "_parts"):
        monkeypatch.setattr(tables, staged, {})
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    kept, labelled = tables.ratings(spark, sf), tables.labelled(spark, sf)
    assert next(iter(tables._parts.values())) > 4 and "hashpartitioning" not in plan(skew.group_sizes(kept, "userId"))
    cut = split.label_split(kept, sizes=tables.user_sizes(spark, sf), by_user=True)
    assert "Window" in plan(cut) and "hashpartitioning" not in plan(cut)
    assert (rows_of(kept, *kept.columns), rows_of(labelled, *labelled.columns)) == (whole, labels)
    monkeypatch.setattr(skew, "TASK_ROWS", 50)
    hot, parts = startables.dealt_ratings(spark, sf)
    assert parts == 0 and rows_of(hot, *hot.columns) == whole


def test_joined_digits(spark):
    rng = random.Random(6)
    for widths in [(10, 18, 5, 2), (10, 18, 8, 2), (18, 18, 2), (2, 18, 18), (1, 1), (10, 2), (18, 2), (9, 9, 9, 9)]:
        rows = [tuple(rng.choice([0, 1, 10**w - 1, rng.randrange(10**w)]) for w in widths) for _ in range(30)]
        names = [f"c{i}" for i in range(len(widths))]
        df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names))
        got = df.select(readers._joined_digits([(F.col(c), w) for c, w in zip(names, widths)]).cast("string")).collect()
        assert [int(r[0]) for r in got] == [int("".join(f"{v:0{w}}" for v, w in zip(row, widths))) for row in rows]


def test_large_mapped_tables_are_dealt_into_bounded_tasks(spark, sf, monkeypatch):
    """The aggregate before the shuffle would hold whatever a scan task reads: tasks follow the rows instead."""
    whole = startables.ratings(spark, sf)
    monkeypatch.setattr(skew, "DEALT_FROM", 1000)
    monkeypatch.setattr(skew, "DEALT_ROWS", 500)
    dealt = startables.ratings(spark, sf)
    n = -(-startables.table(spark, sf, "lineitem").count() // 500)
    text = dealt._jdf.queryExecution().executedPlan().toString()
    assert n > 4 and re.search(rf"hashpartitioning\(l_orderkey#\d+L, {n}\)", text) and "ShuffledHashJoin" in text
    assert rows_of(dealt, *dealt.columns) == rows_of(whole, *whole.columns)


def test_scratch_follows_the_session(spark, tmp_path):
    def fake(master, **conf):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: conf.get(key.split(".")[-1], default)),
            sparkContext=SimpleNamespace(master=master),
        )

    assert session.scratch_path(fake("yarn", dir=f"{tmp_path}/"), "x").startswith(f"{tmp_path}/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(fake("yarn"), "x")
    assert "halfstar-" in session.scratch_path(fake("local[2]"), "x")
    kept = writers.materialise(spark.range(10).withColumn("odd", F.col("id") % 2 == 1), "t", "odd")
    assert kept.where("odd").count() == 5


# The published rating distribution: (rating, count, percentage).
DISTRIBUTION = [
    (0.5, 1370, 1.3586), (1.0, 2811, 2.7877), (1.5, 1791, 1.7762), (2.0, 7551, 7.4884), (2.5, 5550, 5.5040),
    (3.0, 20047, 19.8808), (3.5, 13136, 13.0271), (4.0, 26818, 26.5957), (4.5, 8551, 8.4801), (5.0, 13211, 13.1015),
]


def test_published_distribution(spark):
    counts = spark.createDataFrame([(r, n) for r, n, _ in DISTRIBUTION], "rating double, n int")
    df = counts.select(F.explode(F.sequence(F.lit(1), "n")).alias("userId"), F.lit(1).alias("movieId"), "rating")
    got = rows_of(profile.rating_distribution(df), "rating", "count", "percentage")
    assert [(r, n, round(p, 4)) for r, n, p in got] == DISTRIBUTION
    row = profile.rating_summary(df).first()
    assert (round(row.avg_rating, 4), round(row.std_rating, 4)) == (3.5016, 1.0425)


def test_published_density(spark):
    """610 users, 9,724 movies, 100,836 ratings: 1.70% filled."""
    df = spark.range(100_836).selectExpr("cast(id % 610 as int) userId", "cast(id % 9724 as int) movieId")
    row = profile.matrix_density(df).first()
    assert (row.n_users, row.n_movies, row.possible_ratings) == (610, 9724, 5_931_640)
    assert (round(row.density_percent, 1), round(row.sparsity_percent, 1)) == (1.7, 98.3)
    per = profile.avg_ratings_per_entity(df).first()
    assert (round(per.avg_per_user, 4), round(per.avg_per_movie, 4)) == (165.3049, 10.3698)


def test_genres_edges(spark):
    df = spark.createDataFrame([(1, ""), (2, "Drama"), (3, "Drama|Comedy|Sci-Fi")], "movieId int, genres string")
    assert [tuple(r) for r in profile.genre_counts(df).collect()] == [("Drama", 2), ("Comedy", 1), ("Sci-Fi", 1)]


def test_histogram_edges(spark):
    same = profile.histogram(spark.createDataFrame([(7,), (7,)], "n int"), 30).collect()
    assert [(r.bin, r.n_entities, r.max_n) for r in same] == [(0, 2, 7.0)]
    ends = profile.histogram(spark.createDataFrame([(0,), (15,), (30,)], "n int"), 30)
    assert rows_of(ends, "bin", "n_entities") == [(0, 1), (15, 1), (29, 1)]


def test_empty_input(spark):
    none = ratings(spark, [])
    assert profile.rating_distribution(none).isEmpty()
    assert profile.avg_ratings_per_entity(none).first().avg_per_user is None
    assert profile.activity_extremes(none).where("n is not null").isEmpty()


def test_executors_apart_need_a_shared_folder():
    apart = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]")
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(apart, "x")
