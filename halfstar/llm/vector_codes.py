"""Compression of vectors to codes by the nearest entries of learnt codebooks, one per part of the vector.

The components become integers, so all arithmetic is exact. Blocks of vectors
each get a metric tree per part (:mod:`halfstar.llm.anchors`), once, where the
vectors are: no vector is ever shuffled. A round of learning sends the codebooks
to the trees and gets sums and counts per entry back, which a ball gives as a
whole as soon as one entry owns it.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halfstar.llm.anchors import assign, build, unpacked
from halfstar.llm.common import hot_keys, null_key, salted_join
from halfstar.sources.writers import materialise

BLOCK = 4_096  # vectors that share trees
SCALE = 4_096


def finite_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(_id, _key, _vec) of rows whose vector is not null or empty and holds finite numbers only."""
    rows = vectors.select(
        F.col(id_col).alias("_id"), null_key(label_col).alias("_key"), F.col(vector_col).cast("array<double>").alias("_vec")
    )
    finite = F.forall("_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return rows.where((F.size("_vec") > 0) & finite)


def plant(batches: Iterator[pa.RecordBatch], parts: int, types: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors: their ids and keys, integer points, and a packed tree per part."""
    for batch in batches:
        whole = np.floor(batch.column("_vec").flatten().to_numpy(zero_copy_only=False) * SCALE).astype(np.int64)
        whole = whole.reshape(batch.num_rows, -1) if batch.num_rows else whole.reshape(0, 0)
        for at in range(0, batch.num_rows, BLOCK):
            points = whole[at : at + BLOCK]
            trees = [build(part).packed() for part in np.split(points, parts, axis=1)]
            offsets = pa.array([0, len(points)], pa.int32())
            held = [pa.ListArray.from_arrays(offsets, batch.column(c).slice(at, len(points))) for c in ("_id", "_key")]
            yield pa.RecordBatch.from_arrays(
                [*held, pa.array([points.astype(np.int32).tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary()))], schema=types
            )


def blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple]:
    """(batch, row, [(tree, points) per part]) of planted rows."""
    for batch in batches:
        for row in range(batch.num_rows):
            trees = [unpacked(t) for t in batch.column("_trees")[row].as_py()]
            points = np.frombuffer(batch.column("_points")[row].as_py(), np.int32).astype(np.int64)
            points = points.reshape(len(trees[0].order), -1)
            yield batch, row, list(zip(trees, np.split(points, parts, axis=1)))


def sum_entries(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(part, entry, place, value) of all blocks of a task: sums by component, the count at place -1."""
    found: Counter = Counter()
    for _, _, trees in blocks(batches, len(books)):
        for part, ((tree, points), entries) in enumerate(zip(trees, books)):
            _, sums, counts, _ = assign(tree, points, entries)
            for e in np.nonzero(counts)[0].tolist():
                found[part, e, -1] += int(counts[e])
                for d, value in enumerate(sums[e].tolist()):
                    found[part, e, d] += value
    columns = [list(c) for c in zip(*found)] or [[], [], []]
    values = pa.array(list(found.values()), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns] + [values], names=["part", "entry", "place", "value"])


def encode(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(_id, _key, code, error) per vector."""
    digits = np.array([f"{e:02x}" for e in range(max(map(len, books)))], dtype=object)
    for batch, row, trees in blocks(batches, len(books)):
        error, code = 0, ""
        for (tree, points), entries in zip(trees, books):
            nearest = assign(tree, points, entries)[0]
            error = error + ((points - entries[nearest]) ** 2).sum(axis=1)
            code = code + digits[nearest]
        held = [batch.column(c).slice(row, 1).flatten() for c in ("_ids", "_keys")]
        yield pa.RecordBatch.from_arrays([*held, pa.array(code, pa.string()), pa.array(error, pa.int64())], schema=types)


def learn(trees: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """Codebooks after ``rounds``: each entry becomes the floored mean of what it owned; what owned nothing stays.

    What comes to the driver is the codebooks' sums: parts x entries x components.
    """
    for _ in range(rounds):
        held = books
        sums = trees.select("_points", "_trees").mapInArrow(lambda b: sum_entries(b, held), "part int, entry int, place int, value long")
        total = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        found = {(r.part, r.entry, r.place): int(r.value) for r in total.collect()}
        books = [
            np.array([
                [found[p, e, d] // found[p, e, -1] for d in range(len(entry))] if (p, e, -1) in found else entry
                for e, entry in enumerate(book.tolist())
            ], dtype=np.int64).reshape(book.shape)
            for p, book in enumerate(books)
        ]
    return books


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per kept row of ``vectors``: id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or empty, or holds null or non-finite components,
    are dropped. Each component x becomes floor(4096 * x). Each of ``parts`` equal
    parts has a codebook of ``entries`` entries, at first those of the vectors with
    the least ids (null ids last, and of equal ids the lesser vector first; fewer
    if there are fewer vectors), learnt in ``rounds``. Ties go to the lower index.
    ``code`` has two hex digits a part, ``error`` is the sum of squared distances,
    ``label_error`` its sum over rows of one label, nulls together. Repeated rows
    are all kept. No rows give an empty result.

    Vectors of different lengths, of a length that ``parts`` doesn't divide, or so
    large that squared distances pass 64 bits, are an error. The trees, about twice the
    size of the vectors, are written to the scratch folder; a round reads them.
    """
    kept = finite_vectors(vectors, id_col, vector_col, label_col)
    least, most, largest = kept.agg(F.min(F.size("_vec")), F.max(F.size("_vec")), F.max(F.array_max(F.transform("_vec", F.abs)))).first()
    if least != most or (most or 0) % parts:
        raise ValueError(f"vectors have {least} to {most} components; all must have one number of them, a multiple of {parts}")
    dims = (most or 0) // parts
    if most and SCALE * largest + 1 >= math.isqrt(2**62 // dims) // 2:
        raise ValueError(f"components up to {largest} are too large for squared distances in 64 bits")
    first = kept.orderBy(F.asc_nulls_last("_id"), "_vec").limit(entries).select("_vec").collect()
    start = np.array([[math.floor(x * SCALE) for x in r[0]] for r in first], dtype=np.int64).reshape(len(first), parts * dims)
    books = np.split(start, parts, axis=1)
    sha = F.lit(books_sha256(books)).alias("codebooks_sha256")
    if not first:
        return kept.select(
            F.col("_id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
            F.lit(0).cast("long").alias("label_error"), sha,
        )
    id_type = kept.schema["_id"].dataType.simpleString()
    kept = kept.withColumn("_key", F.col("_key"))
    probe = kept.limit(0).toArrow().schema
    planted = pa.schema([
        ("_ids", pa.list_(probe.field("_id").type)), ("_keys", pa.list_(probe.field("_key").type)),
        ("_points", pa.binary()), ("_trees", pa.list_(pa.binary())),
    ])
    trees = materialise(kept.mapInArrow(
        lambda b: plant(b, parts, planted), f"_ids array<{id_type}>, _keys array<string>, _points binary, _trees array<binary>"
    ), "trees")
    books = learn(trees, books, rounds)
    types = pa.schema([("_id", probe.field("_id").type), ("_key", probe.field("_key").type), ("code", pa.string()), ("error", pa.int64())])
    coded = materialise(trees.mapInArrow(lambda b: encode(b, books, types), f"_id {id_type}, _key string, code string, error long"), "codes")
    labels = coded.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    out = salted_join(coded, labels.drop("_n"), "_key", hot_keys(labels, "_key", "_n"), F.col("_id"))
    return out.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
