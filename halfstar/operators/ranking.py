"""Positions within groups of any size.

A window ranks a group in one task. Groups that are too large for that are
range-partitioned by group and order instead: positions within a part come from
a window over that part, and what stands in earlier parts of the group is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halfstar.operators.skew import TASK_ROWS, heavy_table
from halfstar.sources.writers import materialise


def range_ranked(df: DataFrame, groups: list[str], order: list[Column], pos: str, parts: int) -> DataFrame:
    """``df`` with the position of each row in its group, 1 for the first by ``order``.

    Sampled splitters cut the rows into ``parts`` ranges, written once, as a range
    may be cut elsewhere if it is computed again. The order must tell all rows
    of a group apart, or rows that tie may stand in any order; rows that tie stay
    in one part.
    """
    ranged = df.repartitionByRange(parts, *groups, *order).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    counts = ranged.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    # At most ``parts`` rows a group.
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    local = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order))
    placed = ranged.withColumn("_local", local)
    renamed = offsets.select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_part").alias("_p"), "_before")
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    met = placed.join(renamed, [*same, F.col("_part") == F.col("_p")])
    return met.select(*df.columns, (F.col("_local") + F.col("_before")).cast("int").alias(pos))


def ranked(df: DataFrame, groups: list[str], order: list[Column], pos: str = "pos", task_rows: int = TASK_ROWS) -> DataFrame:
    """Positions within groups; groups over ``task_rows`` rows are looked for and ranked over many tasks. Counts the groups."""
    window = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    heavy = heavy_table(df, *groups, task_rows=task_rows)
    if heavy is None:
        return df.withColumn(pos, window)
    hot = heavy.keys(*groups).select(*[F.col(g).alias(f"_h_{g}") for g in groups])
    is_hot = [F.col(g).eqNullSafe(F.col(f"_h_{g}")) for g in groups]
    rows = heavy.groups.agg(F.sum("n")).first()[0]
    large = range_ranked(df.join(hot, is_hot, "left_semi"), groups, order, pos, max(2, -(-2 * rows // task_rows)))
    return df.join(hot, is_hot, "left_anti").withColumn(pos, window).unionByName(large)
