"""Exact order statistics of groups that are too large for one task.

A mergeable sketch brackets the wanted rank with a guaranteed rank error. One
more partially aggregated pass counts what lies below the bracket and keeps
only the values inside it, a tiny share of the group, for the exact answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halfstar.operators.skew import TASK_ROWS, Heavy, heavy_table, prefixed, same_group

SKETCH_ACCURACY = 100_000


def exact_order_statistics(
    df: DataFrame,
    groups: list[str],
    value: str,
    ranks: Callable[[Column], list[Column]],
    centre: float,
    few_groups: bool,
    min_rows: int = TASK_ROWS,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Values at the 1-based ascending ``ranks(n)`` of each group, as columns v0, v1, ...

    The ranks must lie within 2 of ``centre * n``, in groups of ``min_rows`` rows
    at least: the bracket allows for that and for four times the sketch's error.
    With ``few_groups``, of a known bound, the brackets are broadcast and the
    values are never shuffled whole.
    """
    key = F.col(value).cast("double")
    margin = 4.0 / accuracy + 2.0 / max(1, min_rows)
    low, high = max(0.0, centre - margin), min(1.0, centre + margin)
    brackets = df.groupBy(*groups).agg(
        F.count(value).alias("n"), F.percentile_approx(key, [low, high], accuracy).alias("bracket")
    )
    keyed = prefixed(brackets, groups, "b_", "n", "bracket")
    # The lowest bracket has nothing below it, the highest nothing above.
    below = (key < F.col("bracket")[0]) if low > 0 else F.lit(False)
    slots = (
        df.where(F.col(value).isNotNull())
        .join(F.broadcast(keyed) if few_groups else keyed, same_group(groups, "b_"))
        .where(key <= F.col("bracket")[1] if high < 1 else F.lit(True))
        .groupBy(*groups, "n", F.when(~below, F.col(value)).alias("slot"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    upto = Window.partitionBy(*groups).orderBy(F.asc_nulls_first("slot"))
    running = slots.withColumn("upto", F.sum("c").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    wanted = ranks(F.col("n"))
    found = [
        F.max(F.when((F.col("upto") >= r) & (F.col("upto") - F.col("c") < r), F.col("slot"))).alias(f"v{i}")
        for i, r in enumerate(wanted)
    ]
    result = running.groupBy(*groups).agg(F.first("n").alias("n"), *found)
    missed = F.raise_error(F.lit("rank outside its bracket: raise the sketch accuracy"))
    checked = [F.coalesce(F.col(f"v{i}"), missed).alias(f"v{i}") for i in range(len(wanted))]
    return result.select(*groups, "n", *checked)


def exact_medians(df: DataFrame, groups: list[str], values: list[str], heavy: Heavy) -> DataFrame:
    """Exact medians of ``values`` per group, in columns of the same names; NULLs are skipped.

    The ``heavy`` groups (see :func:`heavy_table`) never sit in one task; the
    others use the built-in median.
    """
    hot = heavy.sized(prefixed(heavy.groups, groups, "h_"))
    is_hot = same_group(groups, "h_")
    light = df.join(hot, is_hot, "left_anti").groupBy(*groups).agg(*[F.median(v).alias(v) for v in values])

    long = (
        df.join(hot, is_hot, "left_semi")
        .select(*groups, *[F.col(v).cast("double").alias(v) for v in values])
        .unpivot(groups, values, "metric", "value")
        .where(F.col("value").isNotNull())
    )
    middle = exact_order_statistics(
        long, [*groups, "metric"], "value",
        lambda n: [F.floor((n + 1) / 2), F.floor((n + 2) / 2)], centre=0.5, few_groups=heavy.listed,
    )
    median = (F.col("v0") + F.col("v1")) / 2
    wide = middle.groupBy(*groups).agg(
        *[F.max(F.when(F.col("metric") == v, median)).alias(v) for v in values]
    )
    return light.unionByName(wide)


def medians(df: DataFrame, groups: list[str], values: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Exact medians per group; groups over ``task_rows`` rows are looked for and handled apart."""
    heavy = heavy_table(df, *groups, task_rows=task_rows)
    if heavy is None:
        return df.groupBy(*groups).agg(*[F.median(v).alias(v) for v in values])
    return exact_medians(df, groups, values, heavy)
