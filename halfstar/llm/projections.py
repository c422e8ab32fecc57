"""Near-duplicate vectors by collision counting on sorted one-dimensional projections.

A vector is projected on many fixed random directions, and its projections are
sorted by size. Only its largest ones, its tails, can collide: there projections
are sparse. Two vectors collide on a direction if it is a tail of both, on the
same side, and their projections lie in one query-centred window, the query's
cell and its two neighbours, wider than chords at the threshold reach. The number
of directions on which a pair collides is its count; pairs whose count reaches a
bound are verified in full. Tails and bound are calibrated by simulated pairs
exactly at the threshold, which holds for any data, as directions are random.

Vectors with the same lowest tails meet in a bucket; a pair belongs to the one
bucket of its lowest common tails, so it is counted and verified once. The
larger the largest label, the more tails make a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfstar.llm.common import hot_keys, null_key, salted_join
from halfstar.llm.components import components
from halfstar.sources.writers import materialise

DIRECTIONS = 512
RECALL = 0.998  # of pairs exactly at the threshold; closer pairs are found more often
PARTNERS = 16_384  # unlike vectors of its label that a vector may meet in all its buckets, about
BLOCK = 1_024  # vectors of a bucket that meet in one task
BIN_ROWS = 50_000  # rows of small buckets that share a task, about
TRIALS = 6_000
NARROW = 3.0  # deviations of the difference of two projections that a cell is wide


def directions(dims: int) -> np.ndarray:
    """Unit columns: random rotations of the axes, the same ones on every machine."""
    rng = np.random.default_rng(20260115)
    turns = [np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(-(-DIRECTIONS // dims))]
    return np.concatenate(turns, axis=1)[:, :DIRECTIONS]


@dataclass(frozen=True)
class Plan:
    tails: int  # of a vector
    least: int  # count that a pair must reach
    shared: int  # tails that make a bucket
    cell: float  # width of a window's cell


def largest(projected: np.ndarray, n: int) -> np.ndarray:
    """The n directions with the largest projections of each row; ties to the lower direction."""
    return np.argsort(-np.abs(projected), axis=1, kind="stable")[:, :n]


def calibrate(dims: int, threshold: float, most: int, recall: float = RECALL, partners: float = PARTNERS) -> Plan:
    """The cheapest plan by which pairs at the threshold reach their count with the recall.

    ``most`` rows have one label. The bound is the least that about one unlike
    vector of its label or fewer reaches with a vector; the shared tails are the
    fewest by which a vector meets about ``partners`` unlike ones or fewer.
    """
    rng = np.random.default_rng(7)
    u = rng.normal(size=(TRIALS, dims))
    u /= np.linalg.norm(u, axis=1)[:, None]
    off = rng.normal(size=(TRIALS, dims))
    off -= (off * u).sum(axis=1)[:, None] * u
    length = np.linalg.norm(off, axis=1)[:, None]
    off = np.divide(off, length, out=np.zeros_like(off), where=length > 1e-9)
    v = threshold * u + math.sqrt(1 - threshold * threshold) * off
    a = directions(dims)
    p, q = u @ a, v @ a
    cell = NARROW * math.sqrt((2 - 2 * threshold) / dims)
    near = (np.sign(p) == np.sign(q)) & (np.abs(np.floor(p / cell) - np.floor(q / cell)) <= 1)
    # The number of tails from which on a direction is a tail of both.
    rank = lambda x: np.argsort(largest(x, x.shape[1]), axis=1)
    needed = np.where(near, np.maximum(rank(p), rank(q)), DIRECTIONS)
    needed.sort(axis=1)
    unlike = lambda tails, n: most * math.comb(tails, n) ** 2 / (math.comb(DIRECTIONS, n) * 2.0**n)
    for least in range(2, 9):
        tails = next(t for t in range(least, DIRECTIONS + 1) if (needed[:, least - 1] < t).mean() >= recall or t == DIRECTIONS)
        if unlike(tails, least) <= 1 or least == 8:
            shared = next((s for s in range(1, least) if unlike(tails, s) <= partners), least)
            return Plan(tails, least, shared, cell)
    raise AssertionError


def tokens(units: np.ndarray, plan: Plan) -> np.ndarray:
    """Tails of each row in rising order: ``direction * 2 + side`` and the cell, as ``token * 4096 + cell``."""
    projected = units @ directions(units.shape[1])
    at = largest(projected, plan.tails)
    value = np.take_along_axis(projected, at, axis=1)
    cell = np.floor(np.abs(value) / plan.cell).astype(np.int64)
    return np.sort((at * 2 + (value < 0)) * 4096 + cell, axis=1)


def collisions(tails: np.ndarray) -> np.ndarray:
    """On how many directions every two rows collide: ``tails`` holds a row's tokens and cells in rising order."""
    n = len(tails)
    names, code = np.unique(tails, return_inverse=True)
    own = np.zeros((n, len(names)), np.float32)
    own[np.arange(n)[:, None], code.reshape(n, -1)] = 1
    window = own.copy()
    for step in (-1, 1):  # the neighbouring cells of the same token
        place = np.minimum(np.searchsorted(names, names + step), len(names) - 1)
        beside = np.nonzero((names[place] == names + step) & (names // 4096 == names[place] // 4096))[0]
        window[:, place[beside]] += own[:, beside]
    return own @ window.T


def common_upto(tails: np.ndarray, last: int) -> np.ndarray:
    """How many tokens up to ``last`` every two rows share."""
    token = tails // 4096
    names, code = np.unique(np.where(token <= last, token, -1), return_inverse=True)
    own = np.zeros((len(token), len(names)), np.float32)
    own[np.arange(len(token))[:, None], code.reshape(len(token), -1)] = 1
    own[:, names == -1] = 0
    return own @ own.T


def counted(tails: np.ndarray, key: list[int], plan: Plan) -> np.ndarray:
    """Of every two rows of the bucket ``key``: whether they belong to it, and their count reaches the bound."""
    passed = collisions(tails) > plan.least - 0.5
    np.fill_diagonal(passed, False)
    if passed.any():  # the bucket's tokens must be the lowest common ones
        passed &= np.rint(common_upto(tails, key[-1])) == len(key)
    return passed


def linkable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """All rows as (_id, _label, _vec); ``_vec`` is null where the row links with nothing."""
    vec = F.col(vector_col).cast("array<double>")
    fine = F.col(label_col).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(vec, lambda x: x != 0)
    return vectors.select(F.col(id_col).alias("_id"), null_key(label_col).alias("_label"), F.when(fine, vec).alias("_vec"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_vec`` as packed doubles, and a 128-bit hash of them; the other columns as they are."""
    for batch in batches:
        # Adding 0.0 makes one number of -0.0 and 0.0.
        raw = [None if v is None else (np.array(v, np.float64) + 0.0).tobytes() for v in batch.column("_vec").to_pylist()]
        hashes = [None if r is None else xxhash.xxh3_128_digest(r) for r in raw]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_label"), pa.array(raw, pa.binary()), pa.array(hashes, pa.binary())], names=["_id", "_label", "_vec", "_hash"]
        )


def stacked(column: pd.Series) -> np.ndarray:
    """Unit vectors of packed ones. Scaled by the largest component first, so that squares neither overflow nor vanish."""
    whole = np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)
    whole = whole / np.abs(whole).max(axis=1)[:, None]
    return whole / np.sqrt((whole * whole).sum(axis=1))[:, None]


def bucket_rows(reps: DataFrame, plan: Plan) -> DataFrame:
    """(_rep, _label, _key, _tails): a row for every ``plan.shared`` tails of a vector."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            for at in range(0, len(batch), 1_000):
                part = batch.iloc[at : at + 1_000]
                tails = tokens(stacked(part["_vec"]), plan)
                chosen = np.array(list(combinations(range(plan.tails), plan.shared)))
                keys = (tails // 4096)[:, chosen].astype(np.int16)  # rows x subsets x shared
                n = len(chosen)
                packed = [t.astype(np.int32).tobytes() for t in tails]
                yield pd.DataFrame({
                    "_rep": np.repeat(part["_rep"].to_numpy(), n), "_label": np.repeat(part["_label"].to_numpy(), n),
                    "_key": [k.tobytes() for k in keys.reshape(-1, plan.shared)], "_tails": np.repeat(np.array(packed, dtype=object), n),
                })

    return reps.select("_rep", "_label", "_vec").mapInPandas(explode, "_rep long, _label string, _key binary, _tails binary")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of buckets of two and more, with ``_task``, ``_block`` and the block pair ``_x``, ``_y`` they meet in.

    A bucket of more than BLOCK rows is cut into blocks, and every two of them meet
    in a task of their own; small buckets share tasks.
    """
    bucket = F.xxhash64("_label", "_key")
    rows = rows.withColumn("_bucket", bucket)
    sizes = materialise(rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "buckets")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    blocks = sizes.select("_bucket", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    met = salted_join(rows, blocks, "_bucket", hot_keys(sizes, "_bucket", "_n", total), F.col("_rep"), "inner")
    met = met.withColumn("_block", F.pmod(F.xxhash64("_rep"), F.col("_blocks")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least("_block", o).alias("x"), F.greatest("_block", o).alias("y"))
    )
    met = met.withColumn("_pair", F.explode(pairs))
    bins = max(1, -(-total // BIN_ROWS))
    task = F.when(F.col("_blocks") == 1, F.pmod(F.col("_bucket"), F.lit(bins))).otherwise(F.xxhash64("_bucket", "_pair"))
    return met.select(
        "_rep", "_label", "_key", "_tails", task.alias("_task"), "_block", F.col("_pair.x").alias("_x"), F.col("_pair.y").alias("_y"),
        *[c for c in rows.columns if c in ("_vec", "_weight")],
    )


def meetings(rows: pd.DataFrame, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, which of every two of them pass) for each bucket and block pair of a task; of two blocks only pairs across them do."""
    if len(rows) < 2:
        return
    tails = np.frombuffer(b"".join(rows["_tails"]), np.int32).reshape(len(rows), -1).astype(np.int64)
    key, block = rows["_key"].to_numpy(), rows["_block"].to_numpy()
    across = (rows["_x"] != rows["_y"]).to_numpy()
    codes = rows.groupby(["_label", "_key", "_x", "_y"], sort=False).ngroup().to_numpy()
    order = np.argsort(codes, kind="stable")
    edges = np.concatenate([[0], np.nonzero(np.diff(codes[order]))[0] + 1, [len(codes)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a < 2:
            continue
        group = order[a:b]
        passed = counted(tails[group], np.frombuffer(key[group[0]], np.int16).tolist(), plan)
        if across[group[0]]:
            passed &= block[group][:, None] != block[group][None, :]
        if passed.any():
            yield group, passed


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that links i-j lead to, for each of n rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        for side in (i, j):
            np.minimum.at(root, before[side], low)
            np.minimum.at(root, side, low)
        root = root[root]
        if (root == before).all():
            return root


def verified(rows: pd.DataFrame, plan: Plan, threshold: float) -> pd.DataFrame:
    """Rows (a, a, links) of a task's vectors, and links (a, b, 0) that connect what its links connect."""
    out = []
    for group, passed in meetings(rows, plan):
        some = passed.any(axis=1)
        part = rows.iloc[group[some]]
        units, rep, weight = stacked(part["_vec"]), part["_rep"].to_numpy(), part["_weight"].to_numpy()
        links = passed[np.ix_(some, some)] & (units @ units.T >= threshold)
        i, j = np.nonzero(np.triu(links, 1))
        if len(i):
            root, n_links = roots(len(rep), i, j), np.where(links, weight[None, :], 0).sum(axis=1)
            has, moved = n_links > 0, root != np.arange(len(rep))
            out.append(np.stack([rep[has], rep[has], n_links[has]]))
            out.append(np.stack([rep[moved], rep[root[moved]], np.zeros(moved.sum(), np.int64)]))
    found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    return pd.DataFrame({"a": found[0], "b": found[1], "n_links": found[2]}).astype("int64")


def members(rows: pd.DataFrame, plan: Plan) -> pd.DataFrame:
    """(_rep, _label, _key, _tails) of a task's rows that pass with any other."""
    found = [group[passed.any(axis=1)] for group, passed in meetings(rows, plan)]
    place = np.concatenate(found) if found else np.zeros(0, np.int64)
    return rows.iloc[place][["_rep", "_label", "_key", "_tails"]].drop_duplicates(["_rep", "_key"])


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    recall: float = RECALL,
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine, in double
    precision, is ``threshold`` or more. ``n_links`` counts a vector's links to other
    rows, ``component_id`` is the least id that links lead to, and ``kept`` whether
    that is the row's own id. A null or zero vector, one with null or non-finite
    components, and one without a label link with nothing; such rows, and rows
    without an id that stand alone, are kept. Equal vectors of one label are one
    vector in all work and link with each other; rows that repeat an id count as
    rows. An empty table gives no rows. Vectors that link have one length; two
    lengths under one threshold are an error.

    What is shuffled first is ids and tails, ``comb(tails, shared)`` short rows a
    vector; vectors follow for rows that share a bucket with a partner of a
    sufficient count. A pair at the threshold is found with probability ``recall``;
    no pair below it is reported. Every two members of a group of thousands of vectors
    that all link with each other are verified, in blocks of BLOCK, as their links
    must be counted; they are never rows.
    """
    rows = linkable(vectors, id_col, vector_col, label_col)
    id_type = rows.schema["_id"].dataType.simpleString()
    rows = rows.mapInArrow(_hashed, f"_id {id_type}, _label string, _vec binary, _hash binary")
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "vectors")
    linked = rows.where("_vec is not null")
    classes = linked.withColumn("_class", F.concat("_hash", F.encode("_label", "utf-8"))).groupBy("_class").agg(
        F.min("_row").alias("_rep"), F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_weight")
    )
    classes = materialise(classes, "vector-classes")
    sizes = linked.groupBy("_label").agg(F.count(F.lit(1)).alias("n"), F.min(F.octet_length("_vec")).alias("a"), F.max(F.octet_length("_vec")).alias("b"))
    most, a, b = sizes.agg(F.max("n"), F.min("a"), F.max("b")).first()
    if a != b:
        raise ValueError(f"vectors have {a // 8} to {b // 8} components; all must have one number of them")
    if most is None:
        return _labelled(rows, id_col, F.col("_id"), F.lit(0))
    plan = calibrate(a // 8, threshold, most, recall)
    reps = rows.join(classes.select(F.col("_rep").alias("_row"), "_rep", "_weight"), "_row").select("_rep", "_label", "_vec", "_weight")
    reps = materialise(reps, "distinct-vectors")
    columns = "_rep long, _label string, _key binary, _tails binary"
    some = dealt(bucket_rows(reps, plan)).groupBy("_task").applyInPandas(lambda task: members(task, plan), columns)
    some = materialise(some.dropDuplicates(["_rep", "_key"]), "members")
    held = dealt(some.join(reps.select("_rep", "_vec", "_weight"), "_rep"))
    found = held.groupBy("_task").applyInPandas(lambda task: verified(task, plan, threshold), "a long, b long, n_links long")
    found = materialise(found, "vector-links")
    links = found.where("a = b").groupBy(F.col("a").alias("_rep")).agg(F.sum("n_links").alias("_links"))
    near = components(found.where("a != b"), "a", "b").select(F.col("vertex").alias("_rep"), "root")
    facts = classes.join(links, "_rep", "left").join(near, "_rep", "left").withColumn("root", F.coalesce("root", "_rep"))
    facts = materialise(facts, "vector-facts")
    least = facts.groupBy("root").agg(F.min("_least").alias("_component"), F.count(F.lit(1)).alias("_n"))
    least = materialise(least, "vector-components")
    facts = salted_join(facts, least.drop("_n"), "root", hot_keys(least, "root", "_n"), F.col("_rep"))
    facts = facts.select("_class", "_component", "_weight", (F.coalesce("_links", F.lit(0)) + F.col("_weight") - 1).alias("_links"))
    facts = materialise(facts, "vector-results")
    keyed = rows.select("_id", "_row", F.concat("_hash", F.encode("_label", "utf-8")).alias("_class"))
    alone = keyed.where("_class is null").withColumns({"_component": F.col("_id"), "_links": F.lit(0).cast("long")})
    met = salted_join(keyed.where("_class is not null"), facts, "_class", hot_keys(facts, "_class", "_weight"), F.col("_row"))
    both = met.select("_id", "_component", "_links").unionByName(alone.select("_id", "_component", "_links"))
    return _labelled(both, id_col, F.col("_component"), F.col("_links"))


def _labelled(rows: DataFrame, id_col: str, component: Column, links: Column) -> DataFrame:
    return rows.select(
        F.col("_id").alias(id_col), links.cast("long").alias("n_links"), component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )
