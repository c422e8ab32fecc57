"""Top-k recommendation of items a user has not rated yet.

Every recommender returns rows of (userId, pos, movieId, score), pos from 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halfstar.operators import skew
from halfstar.operators.ranking import ranked
from halfstar.operators.skew import TASK_ROWS, group_sizes, max_group_rows
from halfstar.sources.writers import materialise

# Places of the item ranking looked at first; users who have rated nearly all of
# them go on to a longer list.
HEAD = 4096
GROWTH = 16
# A ranking up to this many (item, score, place) rows is broadcast: at most some 40 MB.
BROADCAST_ROWS = 2_000_000


def ranked_order(score: Column) -> list[Column]:
    """Best first. Rounded, so that equal scores tie in spite of float noise; ties go to the smaller id."""
    return [F.round(score, 9).desc(), F.col("movieId").asc()]


def rank_candidates(candidates: DataFrame, k: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Position of each (userId, movieId, score) candidate within its user.

    With ``k``, only the first k are kept and the rest falls away before the
    shuffle. Without it, the candidates are counted, and users with more than
    ``task_rows`` of them are ranked over many tasks.
    """
    best = ranked_order(F.col("score"))
    if k is None:
        return ranked(candidates, ["userId"], best, "pos", task_rows)
    order = Window.partitionBy("userId").orderBy(*best)
    return candidates.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def topk_per_user(ratings: DataFrame, k: int = 10) -> DataFrame:
    """The k best rated items of each user."""
    scored = ratings.select("userId", "movieId", F.col("rating").alias("score"))
    return rank_candidates(scored, k)


def drop_seen(candidates: DataFrame, train: DataFrame) -> DataFrame:
    """Candidates without the pairs rated in train."""
    return candidates.join(train.select("userId", "movieId"), ["userId", "movieId"], "left_anti")


def catalogue_counts(train: DataFrame, users: DataFrame) -> DataFrame:
    """Per user: the size and id sum of the train catalogue and of its unseen part.

    Describes users x items less the seen pairs without building the product:
    the seen part is taken off the totals.
    """
    movie = F.col("movieId").cast("long")
    items = train.select("movieId").distinct()
    totals = items.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(movie).alias("ids")).alias("t")).scalar()
    seen = train.groupBy("userId").agg(F.count(F.lit(1)).alias("n_seen"), F.sum(movie).alias("seen_ids"))
    return users.join(seen, "userId", "left").select("userId", "n_seen", "seen_ids", totals.alias("t")).select(
        "userId",
        F.col("t.n").alias("n_items"),
        F.col("t.ids").alias("item_id_sum"),
        (F.col("t.n") - F.coalesce("n_seen", F.lit(0))).alias("n_unseen"),
        (F.col("t.ids") - F.coalesce("seen_ids", F.lit(0))).alias("unseen_id_sum"),
    )


def head_candidates(scores: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """Each user with the same n best items: the list is one bounded row, exploded per user."""
    best = scores.orderBy(*ranked_order(F.col("score"))).limit(n)
    listed = best.agg(F.collect_list(F.struct("movieId", "score"))).scalar()
    return users.select("userId", F.explode(listed).alias("item")).select("userId", "item.movieId", "item.score")


def unseen_of_heavy(items: DataFrame, train: DataFrame, heavy: DataFrame) -> DataFrame:
    """Rows of ``items`` for each of a few heavy users who has not rated them, with ``userId``.

    Runs on the item side: an item carries the short list of heavy users that
    have not seen it, so the shuffle is that of items and no user's seen items
    meet in one task. Meant to be followed by a top-k, which drops rows in the
    same stage. ``heavy`` must be a listed table.
    """
    everyone = heavy.agg(F.collect_list("userId")).scalar()
    seen_by = (
        train.join(heavy.select("userId"), "userId", "left_semi")
        .groupBy("movieId")
        .agg(F.collect_set("userId").alias("seen_by"))
    )
    missing = F.array_except(everyone, F.coalesce("seen_by", F.array().cast("array<int>")))
    joined = items.join(seen_by, "movieId", "left")
    return joined.select(*items.columns, F.explode(missing).alias("userId"))


def listed_heavy_users(
    train: DataFrame, users: DataFrame, max_seen: int | None, heavy_seen: int
) -> tuple[int, DataFrame | None]:
    """(most items seen by any other user, those of ``users`` who have seen more than ``heavy_seen``).

    Of more than MAX_LISTED heavy users the heaviest are listed, and the bound is
    that of the next. Runs up to three counts.
    """
    if max_seen is None:
        max_seen = max_group_rows(train, "userId")
    if max_seen <= heavy_seen:
        return max_seen, None
    sizes = group_sizes(train, "userId")
    listed = sizes.where(F.col("n") > heavy_seen).orderBy(F.desc("n"), "userId").limit(skew.MAX_LISTED).collect()
    if not listed:
        return max_seen, None
    heavy = train.sparkSession.createDataFrame([(r["userId"],) for r in listed], train.select("userId").schema)
    others = sizes.join(F.broadcast(heavy), "userId", "left_anti").agg(F.max("n")).first()[0] or 0
    return others, F.broadcast(heavy.join(users, "userId", "left_semi").select("userId"))


def _from_head(
    scores: DataFrame, train: DataFrame, users: DataFrame, k: int, size: int
) -> tuple[DataFrame, DataFrame]:
    """Users with ``free``, the first k unseen places among the ``size`` best items, and that ranking."""
    order = ranked_order(F.col("score"))
    best = scores.orderBy(*order).limit(size)
    # Read twice, so written once.
    top = materialise(best.select("movieId", "score", F.row_number().over(Window.orderBy(*order)).alias("place")), "head")
    if size <= BROADCAST_ROWS:
        top = F.broadcast(top)
    # Only seen items within the head matter: at most ``size`` small integers per user.
    seen = (
        train.select("userId", "movieId")
        .join(top.select("movieId", "place"), "movieId")
        .groupBy("userId")
        .agg(F.collect_set("place").alias("seen"))
    )
    seen_or_none = F.coalesce("seen", F.array().cast("array<int>"))
    places = F.array_except(F.sequence(F.lit(1), F.lit(k) + F.size(seen_or_none)), seen_or_none)
    reachable = F.filter(places, lambda place: place <= size)
    free = users.join(seen, "userId", "left").select("userId", F.slice(reachable, 1, k).alias("free"))
    return free, top


def unseen_topk(
    scores: DataFrame, train: DataFrame, users: DataFrame, k: int = 10,
    max_seen: int | None = None, head: int = HEAD, heavy_seen: int = TASK_ROWS,
) -> DataFrame:
    """Top-k unseen items per user for a score that does not depend on the user.

    ``scores`` is (movieId, score). A user's k best unseen items lie among the
    ``k + seen`` best of all, so a short ranking with the seen places cut out
    answers most users; those who have seen too much of it use one 16 times as
    long, and so on. Users with over ``heavy_seen`` seen items are answered from
    the item side. ``max_seen``, if known, is the most ratings any user has.
    """
    users = users.select("userId")
    bound, heavy = listed_heavy_users(train, users, max_seen, heavy_seen)
    found = []
    if heavy is not None:
        unseen = unseen_of_heavy(scores, train, heavy)
        found.append(rank_candidates(unseen, k).select("userId", "pos", "movieId", "score"))
        users = users.join(heavy, "userId", "left_anti")
    size = head + k
    while True:
        free, top = _from_head(scores, train, users, k, size)
        last = size >= bound + k
        done = free if last else free.where(F.size("free") >= k)
        placed = done.select("userId", F.posexplode("free").alias("i", "place"))
        found.append(placed.join(top, "place").select("userId", (F.col("i") + 1).alias("pos"), "movieId", "score"))
        if last:
            return reduce(DataFrame.unionByName, found)
        users = free.where(F.size("free") < k).select("userId")
        size = size * GROWTH
