"""Connected components of a graph given by its edges, by rounds of joins and minima.

Each round links every vertex to the least vertex around it, first for larger
neighbours and then for smaller ones (the alternation of large and small stars);
a component is a star around its least vertex after a number of rounds that
grows with the logarithm of its size. A round is two shuffles; its result is
written to the scratch folder. Hot vertices are salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halfstar.llm.common import hot_keys, salted_join
from halfstar.sources.writers import materialise


def _least_around(edges: DataFrame, name: str, total: int) -> DataFrame:
    """``edges`` (u, v), ``total`` rows, with ``m``: the least of u and all v beside it."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    least = materialise(least, f"least-{name}")
    return salted_join(edges, least.select("u", "m"), "u", hot_keys(least, "u", "n", total), F.col("v"))


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 40) -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (longs a, b): root is the least vertex of its component.

    Edges may repeat, be in either direction or be loops; nulls are left out. An
    empty table gives no rows. Runs jobs until a round changes nothing.
    """
    flat = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = flat.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialise(now, "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_around(both, "large", 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialise(large, "large")
        met = _least_around(large, "small", mark[0])
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v")))
        now = materialise(small.where("u != v").distinct(), "small")
        fresh = _mark(now)
        if fresh == mark:
            break
        mark = fresh
    else:
        raise RuntimeError("the components didn't settle; raise most_rounds")
    roots = now.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return roots.union(now.select("v", "v").distinct())


def _mark(edges: DataFrame) -> tuple:
    """What changes if any edge does."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
