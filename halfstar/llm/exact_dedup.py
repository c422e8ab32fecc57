"""Exact duplicates by content sort.

Texts are equal when they are identical without white space. Sampled splitters
range-partition the normalised texts, an external sort makes equal texts
neighbours, and a window over each run of equal ones finds the row that stays:
that is the one shuffle of texts. Splitters order texts by their first characters
and a hash of the rest, so they are small whatever the texts are. They end with a
hash of the row, so a group of copies that is larger than a partition is cut into
several runs; of each run one row without its text meets the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halfstar.llm.common import hot_keys, salted_join, text_of, without_white
from halfstar.sources.writers import materialise

HEAD = 64  # characters of a text that order it in splitters
SAMPLED = 60  # rows a partition that splitters are taken from, about


def _place(norm: Column, spread: Column) -> Column:
    """What orders a row among the splitters."""
    return F.struct(F.substring(norm, 1, HEAD).alias("head"), F.xxhash64(norm).alias("hash"), spread.alias("spread"))


def splitters(docs: DataFrame, place: Column, parts: int) -> list[tuple]:
    """At most ``parts`` - 1 places that cut ``docs`` into ranges of about equal size, from a sample of bounded size."""
    rows = docs.count()
    sample = docs.sample(fraction=min(1.0, SAMPLED * parts / max(rows, 1)), seed=17) if rows > SAMPLED * parts else docs
    found = sorted(tuple(r[0]) for r in sample.select(place).collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def part_of(place: Column, cuts: list[tuple]) -> Column:
    """The number of splitters that aren't above a place, by binary search."""
    if not cuts:
        return F.lit(0)
    listed = F.array(*[F.struct(F.lit(head).alias("head"), F.lit(h).alias("hash"), F.lit(s).alias("spread")) for head, h, s in cuts])
    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s.low + s.high) / 2).cast("int")
        above = F.element_at(listed, F.least(middle + 1, F.lit(len(cuts)))) > place
        open_ = s.low < s.high
        return F.struct(
            F.when(open_ & ~above, middle + 1).otherwise(s.low).alias("low"), F.when(open_ & above, middle).otherwise(s.high).alias("high")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), start, step, lambda s: s.low)


def runs(docs: DataFrame, id_col: str, text_col: str, whole: bool = False) -> DataFrame:
    """Every row of ``docs`` in its run of equal texts: _id, _chars, _hex (SHA-256), _rank, _first (of the run), _n (rows of the run).

    ``whole`` adds ``_doc``, the row itself. The least ``_rank`` has the most
    characters, then the least id, null ids last.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = text_of(text_col)
    spread = F.xxhash64(F.col(id_col), F.length(text))
    cuts = splitters(docs, _place(without_white(text), spread), parts)
    held = [F.struct("*").alias("_doc")] if whole else []
    rows = docs.select(
        F.col(id_col).alias("_id"), F.length(text).alias("_chars"), without_white(text).alias("_norm"), spread.alias("_spread"),
        *held, *([text.alias("_text")] if whole else []),
    )
    rows = rows.withColumn("_part", part_of(_place(F.col("_norm"), F.col("_spread")), cuts)).drop("_spread")
    if whole:  # the text is in the row already
        rows = rows.drop("_norm")
    ranged = rows.repartitionById(len(cuts) + 1, F.col("_part").cast("int"))
    if whole:
        ranged = ranged.withColumn("_norm", without_white(F.col("_text"))).drop("_text")
    rank = F.struct((-F.col("_chars")).alias("shorter"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))
    run = Window.partitionBy("_part", "_norm").orderBy("_rank")
    ranged = ranged.withColumn("_rank", rank)
    return ranged.select(
        "_id", "_chars", F.sha2("_norm", 256).alias("_hex"), "_rank", (F.row_number().over(run) == 1).alias("_first"),
        F.count(F.lit(1)).over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"),
        *(["_doc"] if whole else []),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most characters in the original text stays,
    then the smallest id, of any type that has an order; a null id is larger than
    any. A null text is the empty text, and all empty texts are one group. Of rows
    that agree in id and length one stays. An empty table gives no rows. Other
    columns of ``docs`` aren't read. Texts are shuffled once; the runs, without
    texts, are written to the scratch folder, and two jobs read them.
    """
    rows = materialise(runs(docs, id_col, text_col), "text-runs")
    groups = rows.where("_first").groupBy("_hex").agg(F.min("_rank").alias("_best"), F.sum("_n").alias("group_size"))
    groups = materialise(groups, "text-groups")
    met = salted_join(rows, groups, "_hex", hot_keys(groups, "_hex", "group_size"), F.xxhash64("_id", "_chars"))
    return met.select(
        F.col("_id").alias(id_col),
        F.col("_best.id").alias("keep_id"),
        "group_size",
        # Rows that agree in id and length are in one run, so one of them is its first.
        (F.col("_first") & (F.col("_rank") == F.col("_best"))).alias("kept"),
        F.col("_hex").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows are shuffled once, and the first of each run are written."""
    first = materialise(runs(docs, id_col, text_col, whole=True).where("_first").drop("_first", "_n"), "first-of-runs")
    # A text has several runs only where a splitter cuts it, so fewer than there are partitions lose to another run.
    again = Window.partitionBy("_hex").orderBy("_rank")
    several = first.groupBy("_hex").agg(F.count(F.lit(1)).alias("_runs")).where("_runs > 1").select("_hex")
    lost = first.select("_hex", "_rank").join(several, "_hex").withColumn("_place", F.row_number().over(again)).where("_place > 1")
    lost = lost.select(F.col("_hex").alias("_lost"), F.col("_rank").alias("_lost_rank"))
    stay = first.join(F.broadcast(lost), (F.col("_hex") == F.col("_lost")) & (F.col("_rank") == F.col("_lost_rank")), "left_anti")
    return stay.select("_doc.*")
