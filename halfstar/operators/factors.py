"""Tables of factors (id, features): dot products, exact top-k by them, and random starts.

The top-k search looks at items in falling order of their norms. No product of a
user with an item exceeds the product of their norms, so a user whose k-th best
score is above its own norm times the largest norm left needs no further items.
Items are cut into rounds by norm, the first of FIRST items and each of GROWTH
times as many; users leave from round to round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfstar.operators.packed import runs, unpacked
from halfstar.operators.recommend import rank_candidates
from halfstar.sources.writers import materialise

FIRST, GROWTH = 4_096, 4
# Users and items that are scored against each other in one task. Each user is sent once per block of
# items and each item once per block of users, so large blocks keep the shuffle small.
SCORED_USERS, SCORED_ITEMS = 65_536, 65_536
# Users and items whose products a task holds at a time.
TILE_USERS, TILE_ITEMS = 256, 2_048
SLACK = 1e-6  # scores are rounded to 9 digits before they are ranked

_ODD = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 2**64)) for j in range(4)]


def gaussian(ids: np.ndarray, dims: int, side: int, seed: int) -> np.ndarray:
    """Standard normal numbers that follow from id, side and seed alone."""

    def uniform(draw: int) -> np.ndarray:
        h = ids.astype(np.uint64)[:, None] * _ODD[0] + np.arange(dims, dtype=np.uint64)[None, :] * _ODD[1]
        h = h + np.array([(seed * 4 + side * 2 + draw) % 2**64], np.uint64) * _ODD[2] + _ODD[3]
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(odd)
        return (((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53

    return np.sqrt(-2 * np.log(uniform(0))) * np.cos(2 * np.pi * uniform(1))


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def factor_predict(users: DataFrame, items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Dot products of joined factor tables; a pair with an unknown user or item is dropped."""
    u = users.select(F.col("id").alias("userId"), F.col("features").alias("uf"))
    i = items.select(F.col("id").alias("movieId"), F.col("features").alias("vf"))
    joined = pairs.join(u, "userId").join(i, "movieId")
    return joined.select(*pairs.columns, dot("uf", "vf").alias("dot"))


@dataclass(frozen=True)
class TopK:
    recs: DataFrame  # (userId, pos, movieId, score)
    scored: int  # user-item pairs whose product was computed
    possible: int  # all pairs


def exact_topk(user_factors: DataFrame, item_factors: DataFrame, k: int = 10, seen: DataFrame | None = None) -> TopK:
    """The k items of each user with the highest dot product, without the pairs of ``seen`` (userId, movieId).

    In each round blocks of the users that are left meet blocks of the round's
    items once; seen pairs go to the block pair that they are in and are masked
    there, so a task gives at most k items per user, and none below the k-th best of
    earlier rounds. What is shuffled is factors, packed, once per block of the other
    side, seen pairs, once in all rounds, and k rows a user and round.
    Ties go to the smaller item id.
    """
    normed = lambda df: df.select(F.col("id").cast("int").alias("id"), "features", F.sqrt(dot("features", "features")).alias("norm"))
    items = materialise(normed(item_factors), "item-norms")
    n_items = items.count()
    sizes = []
    while sum(sizes) < n_items:
        sizes.append(min(FIRST * GROWTH ** len(sizes), n_items - sum(sizes)))
    fractions = [1 - sum(sizes[: i + 1]) / n_items for i in range(len(sizes) - 1)]
    # Any cut is right; sketched quantiles make rounds of about the sizes meant.
    cuts = list(items.agg(F.percentile_approx("norm", fractions, 10_000)).first()[0]) if fractions else []
    edges = [float("inf"), *cuts, -1.0]
    users = materialise(normed(user_factors).withColumn("bar", F.lit(None).cast("double")), "user-norms")
    if seen is not None and len(sizes) > 1:  # a round takes the pairs of its items by their norm
        pairs = seen.select(F.col("userId").cast("int").alias("userId"), F.col("movieId").cast("int").alias("movieId"))
        seen = materialise(pairs.join(items.select(F.col("id").alias("movieId"), "norm"), "movieId"), "seen-norms")
    n_users = scored = users.count()
    possible, scored = n_users * n_items, 0
    found, best = [], None
    for high, low in zip(edges[:-1], edges[1:]):
        n_left = users.count()
        if not n_left:
            break
        of_round = (F.col("norm") < high) & (F.col("norm") >= low)
        some = items.where(of_round)
        n_some = some.count()
        scored += n_left * n_some
        fresh = _scored(users, n_left, some, n_some, k, seen.where(of_round) if seen is not None and len(sizes) > 1 else seen)
        best = materialise(rank_candidates(fresh if best is None else best.unionByName(fresh), k).drop("pos"), "best")
        if low < 0:
            break
        # No later item has a norm of ``low`` or more.
        last = best.groupBy(F.col("userId").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_worst"))
        judged = users.join(last, "id", "left").withColumn("bar", F.when(F.col("_n") >= k, F.col("_worst")))
        open_ = F.coalesce((F.col("_n") < k) | (F.col("_worst") <= F.col("norm") * low * (1 + 1e-9) + SLACK), F.lit(True))
        users = materialise(judged.where(open_).drop("_n", "_worst"), "users-left")
        left = users.select(F.col("id").alias("userId"))
        found.append(best.join(left, "userId", "left_anti"))
        best = best.join(left, "userId", "left_semi")
    if best is not None:
        found.append(best)
    if not found:
        none = "userId int, pos int, movieId int, score double"
        return TopK(items.sparkSession.createDataFrame([], none), 0, 0)
    recs = rank_candidates(reduce(DataFrame.unionByName, found), k)
    return TopK(recs.select("userId", "pos", "movieId", "score"), scored, possible)


_SENT = "ub int, ib int, side int, ids binary, others binary, features binary, bar binary"
_USER, _ITEM, _SEEN = range(3)


def _kind(df: DataFrame) -> type:
    return np.float32 if df.schema["features"].dataType.simpleString() == "array<float>" else np.float64


def _pack(batches: Iterator[pa.RecordBatch], side: int, kinds: dict[str, type]) -> Iterator[pa.RecordBatch]:
    """Rows of a pair of blocks as one, with the numbers of each column of ``kinds`` as bytes; nulls are NaN."""
    for batch in batches:
        ub, ib = batch["ub"].to_numpy(), batch["ib"].to_numpy()
        order = np.lexsort((ib, ub))
        batch, ub, ib = batch.take(pa.array(order)), ub[order], ib[order]
        numbers = {c: [] for c in ("ids", "others", "features", "bar")}
        pairs = list(runs(ub, ib))
        for some in pairs:
            rows = batch.slice(some.start, some.stop - some.start)
            for c, held in numbers.items():
                values = np.empty(0) if c not in kinds else rows[c].flatten().to_numpy() if c == "features" else rows[c].to_numpy(zero_copy_only=False)
                held.append(values.astype(kinds.get(c, np.float64)).tobytes())
        columns = [ub[[some.start for some in pairs]], ib[[some.start for some in pairs]], np.full(len(pairs), side, np.int32)]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int32()) for c in columns], *[pa.array(v, pa.binary()) for v in numbers.values()]], names=["ub", "ib", "side", *numbers]
        )


def _met(users: DataFrame, n_users: int, items: DataFrame, n_items: int, seen: DataFrame | None, function: Callable, schema: str) -> DataFrame:
    """``function`` over each pair of a block of ``users`` (id, features, bar) and one of ``items``, each pair in a task.

    It gets a table of packed rows. A row goes once per block of the other side, and seen pairs go where they are in.
    """
    user_blocks, item_blocks = max(1, -(-n_users // SCORED_USERS)), max(1, -(-n_items // SCORED_ITEMS))
    block = lambda c, n: F.pmod(F.xxhash64(F.col(c).cast("int")), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # The packed rows are sent, so the other side's block is a constant until then.
    kinds = {"ids": np.int32, "features": _kind(users), "bar": np.float64}
    mine = users.select(block("id", user_blocks).alias("ub"), F.lit(0).alias("ib"), F.col("id").cast("int").alias("ids"), _numbers(users), "bar")
    mine = mine.mapInArrow(lambda batches: _pack(batches, _USER, kinds), _SENT).withColumn("ib", each(item_blocks))
    item_kinds = {"ids": np.int32, "features": _kind(items)}
    theirs = items.select(F.lit(0).alias("ub"), block("id", item_blocks).alias("ib"), F.col("id").cast("int").alias("ids"), _numbers(items))
    theirs = theirs.mapInArrow(lambda batches: _pack(batches, _ITEM, item_kinds), _SENT).withColumn("ub", each(user_blocks))
    parts = [mine, theirs]
    if seen is not None:
        known = seen.select("userId", "movieId").dropna()
        known = known.select(
            block("userId", user_blocks).alias("ub"), block("movieId", item_blocks).alias("ib"), F.col("userId").cast("int").alias("ids"), F.col("movieId").cast("int").alias("others")
        )
        pair_kinds = {"ids": np.int32, "others": np.int32}
        parts.append(known.mapInArrow(lambda batches: _pack(batches, _SEEN, pair_kinds), _SENT))
    # A task for each pair, however few bytes it gets: the work is in the products.
    dealt = reduce(DataFrame.unionAll, parts).repartitionById(user_blocks * item_blocks, F.col("ub") * item_blocks + F.col("ib"))
    all_kinds = (kinds, item_kinds, {"ids": np.int32, "others": np.int32})

    def run(batches):
        whole = [batch for batch in batches if batch.num_rows]
        if not whole:
            return
        table, arrays = pa.Table.from_batches(whole), []
        for side, own in enumerate(all_kinds):
            rows = table.filter(pc.equal(table["side"], side))
            arrays.append({c: unpacked(rows[c], kind) for c, kind in own.items()})
            if "features" in own and len(arrays[-1]["ids"]):
                arrays[-1]["features"] = arrays[-1]["features"].reshape(len(arrays[-1]["ids"]), -1)
        del table, whole
        if len(arrays[_USER]["ids"]) and len(arrays[_ITEM]["ids"]):
            yield pa.RecordBatch.from_pandas(function(*arrays), preserve_index=False)

    return dealt.mapInArrow(run, schema)


def _numbers(df: DataFrame) -> Column:
    """Features as lists of a type that is packed as it is."""
    return F.col("features").cast("array<float>" if _kind(df) is np.float32 else "array<double>").alias("features")


def _scored(users: DataFrame, n_users: int, items: DataFrame, n_items: int, k: int, seen: DataFrame | None) -> DataFrame:
    """(userId, movieId, score): of every user and block of items the k best unseen ones, if they reach the user's ``bar``."""

    def best(mine, others, pairs):
        return best_unseen(mine["ids"], mine["features"], mine["bar"], others["ids"], others["features"], pairs["ids"], pairs["others"], k)

    return _met(users, n_users, items, n_items, seen, best, "userId int, movieId int, score double")


class Products:
    """Products of users' and items' factors, tile by tile: rough ones of all pairs tell which pairs need exact ones."""

    def __init__(self, users: np.ndarray, items: np.ndarray):
        self.users, self.items = users.astype(np.float64), items.astype(np.float64)
        norms = [np.sqrt(np.einsum("nf,nf->n", m, m)) for m in (self.users, self.items)]
        longest = [float(n.max(initial=0.0)) for n in norms]
        # Single precision unless it could overflow. A rough product is off by at most ``margin``, per user.
        kind = np.float32 if max(longest) < 1e15 else np.float64
        self.rough_users, self.rough_items = self.users.astype(kind), self.items.astype(kind)
        self.finite = all(bool(np.isfinite(n).all()) for n in norms)
        self.margin = (users.shape[1] + 4) * float(np.finfo(kind).eps) * norms[0] * longest[1] + 1e-9

    def rough(self, some: slice, others: slice) -> np.ndarray:
        return self.rough_users[some] @ self.rough_items[others].T

    def reaching(self, rough: np.ndarray, some: slice, others: slice, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(user, item, exact product) of all pairs whose product reaches the user's ``bar``, and of some just below."""
        low = np.nextafter((bar - self.margin[some]).astype(rough.dtype), rough.dtype.type(-np.inf))
        # Most users have nothing in most tiles, which their best product there tells; a NaN would hide it.
        hit = np.flatnonzero(rough.max(axis=1) >= low) if self.finite and rough.shape[1] else np.arange(len(rough))
        row, place = np.divmod(np.flatnonzero(rough[hit] >= low[hit, None]), max(1, rough.shape[1]))
        row, place = hit[row] + some.start, place + others.start
        exact = np.empty(len(row))
        for a in range(0, len(row), 100_000):
            part = slice(a, a + 100_000)
            exact[part] = np.einsum("nf,nf->n", self.users[row[part]], self.items[place[part]])
        return row, place, exact


def _tiles(n: int, size: int) -> list[slice]:
    return [slice(a, min(a + size, n)) for a in range(0, n, size)]


def _best(row: np.ndarray, place: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row. Scores are rounded as in ranked_order, and of equal ones the first place comes first."""
    order = np.lexsort((place, -np.round(score, 9), row))
    row = row[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], place[order][keep], score[order][keep]


def block_topk(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Rows of users (i < 0), items (u < 0) and seen pairs; the k best unseen items of each user."""
    users, items = rows[rows["i"] < 0], rows[rows["u"] < 0]
    if not len(users) or not len(items):
        return pd.DataFrame({"userId": [], "movieId": [], "score": []})
    pairs = rows[(rows["u"] >= 0) & (rows["i"] >= 0)]
    mine, others = (users["u"].to_numpy(), np.stack(users["features"])), (items["i"].to_numpy(), np.stack(items["features"]))
    return best_unseen(*mine, np.full(len(users), np.nan), *others, pairs["u"].to_numpy(), pairs["i"].to_numpy(), k)


def best_unseen(
    user_ids: np.ndarray, user_factors: np.ndarray, bars: np.ndarray, item_ids: np.ndarray, item_factors: np.ndarray,
    seen_users: np.ndarray, seen_items: np.ndarray, k: int,
) -> pd.DataFrame:
    """The k best unseen items of each user, without some that are below the user's bar, if it isn't NaN. Ids may repeat."""
    user_ids, first = np.unique(user_ids, return_index=True)
    user_factors, bars = user_factors[first], np.where(np.isnan(bars[first]), -np.inf, bars[first] - 1e-9)
    item_ids, first = np.unique(item_ids, return_index=True)
    u, i = pd.Index(user_ids), pd.Index(item_ids)
    products = Products(user_factors, item_factors[first])
    at_u, at_i = u.get_indexer(seen_users), i.get_indexer(seen_items)
    known = (at_u >= 0) & (at_i >= 0)
    seen = np.sort(at_u[known] * len(i) + at_i[known])
    found = []
    for some in _tiles(len(u), TILE_USERS):
        n = some.stop - some.start
        bar, best, fresh = bars[some], (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), []
        tiles = _tiles(len(i), TILE_ITEMS)
        for at, others in enumerate(tiles):
            rough = products.rough(some, others)
            if at == 0 and rough.shape[1] > k and np.isneginf(bar).any():
                # k unseen items of the first tile reach this bar. Items stand by id, so seen pairs are a range of keys.
                mine = seen[np.searchsorted(seen, some.start * len(i)) : np.searchsorted(seen, some.stop * len(i))]
                mine = mine[mine % len(i) < others.stop]
                unseen = rough.copy()
                unseen[mine // len(i) - some.start, mine % len(i)] = -np.inf
                kth = np.partition(unseen, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
                bar = np.maximum(bar, kth.astype(np.float64) - products.margin[some])
            row, place, score = products.reaching(rough, some, others, bar)
            key = row * len(i) + place
            spot = np.minimum(np.searchsorted(seen, key), max(0, len(seen) - 1))
            new = seen[spot] != key if len(seen) else np.ones(len(key), bool)
            fresh.append((row[new], place[new], score[new]))
            # An old bar lets too many pass, never too few: it is raised after 1, 2, 4, ... tiles.
            if (at & (at + 1)) == 0 or at == len(tiles) - 1:
                best, fresh = _best(*(np.concatenate(c) for c in zip(best, *fresh)), k), []
                rows_of = best[0] - some.start
                worst = np.full(n, np.inf)
                np.minimum.at(worst, rows_of, best[2])
                bar = np.maximum(bar, np.where(np.bincount(rows_of, minlength=n) >= k, worst - 1e-9, -np.inf))
        found.append(best)
    row, place, score = (np.concatenate(c) for c in zip(*found))
    return pd.DataFrame({"userId": u.to_numpy()[row], "movieId": i.to_numpy()[place], "score": score})


def factor_topk_unseen(user_factors: DataFrame, item_factors: DataFrame, train: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """The k items of each of ``users`` with the highest dot product that it hasn't rated in train. Users without factors have none."""
    wanted = user_factors.join(users.select(F.col("userId").alias("id")).distinct(), "id", "left_semi")
    return exact_topk(wanted, item_factors, k, train).recs


def count_above(user_factors: DataFrame, item_factors: DataFrame, bound: str = "bound") -> DataFrame:
    """(id, above): how many of all items have a dot product over the user's ``bound``.

    Scores every user with every item, in blocks: what a search for the best ones is checked against.
    """
    users = user_factors.select(F.col("id").cast("int").alias("id"), "features", F.col(bound).cast("double").alias("bar"))

    def count(mine, others, _):
        products, bound = Products(mine["features"], others["features"]), mine["bar"]
        above = np.zeros(len(bound), np.int64)
        for some in _tiles(len(bound), TILE_USERS):
            for tile in _tiles(len(others["ids"]), TILE_ITEMS):
                row, _, score = products.reaching(products.rough(some, tile), some, tile, bound[some])
                np.add.at(above, row[score > bound[row]], 1)
        return pd.DataFrame({"id": mine["ids"], "above": above})

    counted = _met(users, users.count(), item_factors, item_factors.count(), None, count, "id int, above long")
    return counted.groupBy("id").agg(F.sum("above").alias("above"))
