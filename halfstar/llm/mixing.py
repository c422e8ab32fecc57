"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are laid end to end in a shuffled order and cut into
blocks of equally many words. The mix is a sequence of slots, one block each.
Slot k takes the point frac(k * golden ratio), and the source whose part of the
cumulative targets holds that point; the r-th slot of a source takes the
source's block r modulo their number. Any stretch of the schedule so holds every
source close to its weight, and a source is repeated as a whole, in passes.

The multiples of the golden ratio are taken as integers on a lattice of two
neighbouring Fibonacci numbers, so reruns and other engines agree to the bit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halfstar.llm.common import SALTS, hot_keys, null_key, salted_join, text_of, word_count
from halfstar.sources.writers import materialise

# The 45th and 46th Fibonacci numbers; their product stays below 2^63.
STEP, PERIOD = 1134903170, 1836311903
CELLS = 4096  # the unit interval in cells, by which slots meet sources in an equality join
CHUNK = 65536  # slots ranked in one task


def weighted_targets(sources: DataFrame, weights: tuple[int, ...], limit: int) -> DataFrame:
    """Adds ``_place``, ``weight`` and ``target`` to one row per source (``source``, ``source_size``).

    Weights repeat over the sources by code point, null last. Targets share the
    total by weight, but none exceeds ``limit`` times its source's size: sorted by
    size per weight, the sources that are held at their limit come first, and the
    rest share what remains. The unpartitioned windows run over sources, not rows.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    place = F.row_number().over(order) - 1
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights)).cast("int") + 1)
    rows = sources.withColumn("_place", place).withColumn("weight", pick)
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), "_place")
    before, rest = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("_left", F.sum("source_size").over(everything) - limit * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    rows = rows.withColumn("_weight_left", F.sum("weight").over(rest))
    rows = rows.withColumn("_held", F.col("weight") * F.col("_left") > limit * F.col("source_size") * F.col("_weight_left"))
    # Of the first source that isn't held: what is left for it and all later ones.
    level = F.min(F.when(~F.col("_held"), F.struct(F.col("source_size") / F.col("weight"), "_place", "_left", "_weight_left")))
    rows = rows.withColumn("_level", level.over(everything))
    share = F.col("weight") * F.col("_level._left") / F.col("_level._weight_left")
    return rows.select(
        "source", "source_size", "_place", "weight",
        F.when(F.col("_held"), (limit * F.col("source_size")).cast("double")).otherwise(share).alias("target"),
    )


def slot_source(slots: DataFrame, sources: DataFrame, block_words: int) -> DataFrame:
    """(``k``, ``_place``, ``_blocks``): the source of each slot ``k`` by the slot's point in the cumulative targets.

    Slots and sources meet in the cells of the unit interval. Each cell holds
    equally many slots, so this join has no hot key.
    """
    upto = Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    parts = sources.where("target > 0").withColumn("_hi", F.sum("target").over(upto) / F.sum("target").over(Window.partitionBy()))
    parts = parts.withColumn("_lo", F.coalesce(F.lag("_hi").over(Window.orderBy("_place")), F.lit(0.0)))
    parts = parts.withColumn("_blocks", F.ceil(F.col("source_size") / block_words))
    last = F.least(F.floor(F.col("_hi") * CELLS), F.lit(CELLS - 1))
    parts = parts.select("_place", "_blocks", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") * CELLS), last)).alias("_cell"))
    slots = slots.withColumn("_at", (F.col("k") % PERIOD * STEP % PERIOD + 0.5) / PERIOD)
    slots = slots.withColumn("_cell", F.floor(F.col("_at") * CELLS))
    return slots.join(parts, "_cell").where("_at >= _lo and _at < _hi").select("k", "_place", "_blocks")


def block_schedule(spark: SparkSession, sources: DataFrame, slots: int, block_words: int, limit: int) -> DataFrame:
    """The schedule: slot ``k`` takes block ``_block`` of source ``_place``. No block is taken more than ``limit`` times.

    Slots are ranked within a source by chunks of the slot sequence: a window
    over a chunk's slots, after the number of slots in the chunks before.
    """
    dealt = slot_source(spark.range(slots).withColumnRenamed("id", "k"), sources, block_words)
    dealt = dealt.withColumn("_chunk", F.floor(F.col("k") / CHUNK))
    ahead = Window.partitionBy("_place").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_place", "_chunk").count()
    counts = counts.select("_place", "_chunk", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy("_place", "_chunk").orderBy("k")) - 1
    ranked = dealt.withColumn("_within", within).join(counts, ["_place", "_chunk"])
    ranked = ranked.withColumn("_rank", F.col("_ahead") + F.col("_within")).where(F.col("_rank") < limit * F.col("_blocks"))
    return ranked.select("k", "_place", (F.col("_rank") % F.col("_blocks")).alias("_block"))


@dataclass
class Mix:
    """``documents``: one row per document (id, ``_place``, ``_hash``, ``_start`` in its source, size, source_size, target).
    ``schedule``: the blocks in the order of the mix."""

    documents: DataFrame
    schedule: DataFrame
    block_words: int

    def taken(self) -> DataFrame:
        """``documents`` with ``taken``: the words that the scheduled blocks take of each, repeats counted."""
        uses = self.schedule.groupBy("_place", "_block").agg(F.count(F.lit(1)).alias("_uses"))
        full = self.documents.where("size > 0")
        end, b = F.col("_start") + F.col("size"), self.block_words
        spans = full.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_start") / b), F.floor((end - 1) / b))))
        overlap = F.least(end, (F.col("_block") + 1) * b) - F.greatest(F.col("_start"), F.col("_block") * b)
        met = spans.withColumn("_overlap", overlap).join(uses, ["_place", "_block"])
        words = met.groupBy("_place", "_start").agg(F.sum(F.col("_overlap") * F.col("_uses")).alias("_taken"))
        # _start belongs to one document of the source, so neither side of this join repeats a key.
        full = full.join(words, ["_place", "_start"], "left").withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("long"))
        return full.drop("_taken").unionByName(self.documents.where("size = 0").withColumn("taken", F.lit(0).cast("long")))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, block_words: int = 64, extra: tuple[str, ...] = (),
) -> Mix:
    """Lay out the documents and schedule their blocks.

    Null sources are one source; a null text has no words. Documents without
    words are in no block. Rows that repeat an id are documents of their own.
    With no words at all the schedule is empty. Document sizes are written to the
    scratch folder once, and texts aren't read again. ``extra`` names columns of
    ``docs`` to carry along.
    """
    spark = docs.sparkSession
    sizes = materialise(
        docs.select(
            F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(text_of(text_col)).alias("size"),
            F.md5(null_key(id_col)).alias("_hash"), F.monotonically_increasing_id().alias("_row"), *extra,
        ),
        "sizes",
    )
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = materialise(weighted_targets(totals, weights, limit).join(
        totals.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s"), "sources").withColumn("_key", null_key("source"))
    hot = hot_keys(sources, "_key", "_rows")
    facts = sources.select("_key", "_place", "source_size", "target")
    placed = salted_join(sizes.withColumn("_key", null_key("source")), facts, "_key", hot, F.col("_row")).drop("_key")
    # Places of the documents in their source: offsets of hash buckets, then places within a bucket.
    row = sources.agg(F.sum("_rows"), F.sum("source_size")).first()
    rows, words = row[0] or 0, row[1] or 0
    digits = max(2, len(f"{rows // CHUNK:x}"))
    placed = placed.withColumn("_bucket", F.substring("_hash", 1, digits))
    ahead = Window.partitionBy("_place").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_place", "_bucket").agg(F.sum("size").alias("_words"))
    offsets = offsets.select("_place", "_bucket", F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_place", "_bucket").orderBy("_hash", "_id", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["_place", "_bucket"])
    placed = placed.withColumn("_start", F.col("_offset") + F.col("_inside")).drop("_bucket", "_inside", "_offset")
    slots = -(-words // block_words)
    return Mix(placed, block_schedule(spark, sources, slots, block_words, limit), block_words)


def mix_report(mix: Mix, id_col: str = "doc_id") -> DataFrame:
    """id, size, source_size, target (rounded to 6 digits) and taken, one row per document."""
    return mix.taken().select(
        F.col("_id").alias(id_col), "size", "source_size", F.round("target", 6).alias("target"), "taken",
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The mix as whole documents, all columns kept: each as often as the taken words fill it, to the nearest number.

    A document without words comes once. Texts are shuffled once, to meet their number of copies.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    mix = mix_sources(docs.withColumn("_key64", key), id_col, text_col, extra=("_key64",), **settings)
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int"))
    # Rows that repeat both id and text share a key. Their numbers differ by a few values at most.
    numbers = mix.taken().groupBy("_key64", times.alias("_times")).agg(F.count(F.lit(1)).alias("_n"))
    numbers = numbers.groupBy("_key64").agg(F.array_sort(F.collect_list(F.struct("_times", "_n"))).alias("_numbers"), F.sum("_n").alias("_rows"))
    numbers = materialise(numbers, "numbers")
    held = docs.select(F.struct("*").alias("_doc"), key.alias("_key64"))
    alone = held.join(numbers.where("_rows = 1").select("_key64", F.col("_numbers")[0]["_times"].alias("_times")), "_key64").select("_doc", "_times")
    # Repeated rows are written with a number of their own, and counted off in SALTS parts a key.
    again = held.join(numbers.where("_rows > 1").select("_key64"), "_key64", "left_semi")
    again = materialise(again.withColumn("_row", F.monotonically_increasing_id()), "repeated")
    again = again.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    ahead = Window.partitionBy("_key64").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = again.groupBy("_key64", "_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select("_key64", "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    placed = again.withColumn("_nth", F.row_number().over(Window.partitionBy("_key64", "_part").orderBy("_row"))).join(parts, ["_key64", "_part"])
    hot = hot_keys(numbers.where("_rows > 1"), "_key64", "_rows")
    placed = salted_join(placed, numbers.select("_key64", "_numbers"), "_key64", hot, F.col("_row"), "inner")
    # The value whose share of the key's rows holds this row's place.
    start = F.struct((F.col("_nth") + F.col("_ahead")).alias("left"), F.lit(0).alias("times"))
    pick = F.aggregate("_numbers", start, lambda s, x: F.struct(
        (s["left"] - x["_n"]).alias("left"), F.when(s["left"] > 0, x["_times"]).otherwise(s["times"]).alias("times")
    ), lambda s: s["times"])
    both = alone.unionByName(placed.select("_doc", pick.alias("_times")))
    return both.select(F.explode(F.array_repeat("_doc", F.col("_times"))).alias("_doc")).select("_doc.*")
