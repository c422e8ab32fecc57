import random
import statistics

import pytest
from pyspark.sql import functions as F

from halfstar.operators.quantiles import exact_order_statistics, medians
from halfstar.operators.skew import heavy_table, max_group_rows


def sample(seed, kind):
    rng = random.Random(seed)
    draw = {
        "smooth": lambda: rng.gauss(0, 1),
        "tied": lambda: float(rng.randrange(3)),
        "tailed": lambda: rng.paretovariate(0.3),
        "constant": lambda: 2.5,
    }[kind]
    sizes = {"a": 2001, "b": 300, "c": 1, None: 52}
    return [(g, draw(), rng.random() if rng.random() < 0.9 else None) for g, n in sizes.items() for _ in range(n)]


@pytest.mark.parametrize("kind", ["smooth", "tied", "tailed", "constant"])
@pytest.mark.parametrize("task_rows", [10**6, 100, 0])
def test_medians(spark, kind, task_rows):
    rows = sample(5, kind)
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(7)
    got = {r.g: (r.x, r.y) for r in medians(df, ["g"], ["x", "y"], task_rows=task_rows).collect()}
    for g in ("a", "b", "c", None):
        x = statistics.median(r[1] for r in rows if r[0] == g)
        y = [r[2] for r in rows if r[0] == g and r[2] is not None]
        assert got[g][0] == pytest.approx(x, abs=0)
        assert got[g][1] == (pytest.approx(statistics.median(y)) if y else None)


def test_narrow_bracket_stays_exact(spark):
    """With a coarse sketch the bracket is a real part of the data, and the counting has to be right."""
    rng = random.Random(2)
    values = [rng.expovariate(1) for _ in range(20_000)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double").repartition(8)
    got = exact_order_statistics(df, ["g"], "v", lambda n: [F.floor(n * 0.8), F.floor(n * 0.8) + 1], 0.8, True, accuracy=1000)
    row = got.first()
    values.sort()
    assert (row.v0, row.v1) == (values[15_999], values[16_000])


def test_heavy_table(spark):
    df = spark.createDataFrame([(1,)] * 10 + [(2,)] * 3 + [(None,)] * 4, "k int")
    assert max_group_rows(df, "k") == 10
    assert heavy_table(df, "k", task_rows=10) is None
    assert sorted((r.k or 0, r.n) for r in heavy_table(df, "k", task_rows=3).groups.collect()) == [(0, 4), (1, 10)]


def test_heavy_table_beyond_the_list(spark, monkeypatch):
    from halfstar.operators import skew

    monkeypatch.setattr(skew, "MAX_LISTED", 2)
    df = spark.range(100).selectExpr("id % 5 as k")
    heavy = heavy_table(df, "k", task_rows=3)
    assert heavy.groups.count() == 5 and not heavy.listed
    got = medians(df.selectExpr("k", "k * 1.5D as v"), ["k"], ["v"], task_rows=3)
    assert {r.k: r.v for r in got.collect()} == {k: k * 1.5 for k in range(5)}
