"""Small literal inputs."""

import random

RATINGS = "userId int, movieId int, rating double, timestamp long"


def ratings(spark, rows):
    return spark.createDataFrame([(u, m, float(r), t) for u, m, r, t in rows], RATINGS)


def random_ratings(spark, users, items, n, seed=1, hot_user=None):
    """n distinct random pairs with half-star ratings; ``hot_user`` rates half of all items on top."""
    rng = random.Random(seed)
    pairs = {(rng.randrange(users), rng.randrange(items)) for _ in range(n)}
    if hot_user is not None:
        pairs |= {(hot_user, i) for i in range(items // 2)}
    rows = [(u, i, rng.randrange(1, 11) / 2, rng.randrange(50)) for u, i in sorted(pairs)]
    return rows, ratings(spark, rows)


def planted(spark, users=200, items=100, rank=3, share=0.5, seed=7):
    """Ratings of a low-rank matrix plus little noise, as (train, test)."""
    rng = random.Random(seed)
    p = [[rng.gauss(0, 1) for _ in range(rank)] for _ in range(users)]
    q = [[rng.gauss(0, 1) for _ in range(rank)] for _ in range(items)]
    rows = []
    for u in range(users):
        for i in range(items):
            if rng.random() < share:
                value = 2.75 + 0.6 * sum(a * b for a, b in zip(p[u], q[i])) + rng.gauss(0, 0.05)
                rows.append((u, i, min(5.0, max(0.5, value)), rng.randrange(1000)))
    rng.shuffle(rows)
    cut = len(rows) * 4 // 5
    return ratings(spark, rows[:cut]), ratings(spark, rows[cut:])


# The published results table, in the columns used here.
PUBLISHED_RUNS = [
    ("SVD", None, 0.03125190734863281, 0.08057165145874023, 0.9806268824825067, 0.7676759079426663),
    ("ALS", "local[1]", 8.085296392440796, 0.03923964500427246, 1.665734617905384, 1.352629404929942),
    ("ALS", "local[2]", 4.199707984924316, 0.01805400848388672, 1.6657346179053802, 1.352629404929942),
    ("ALS", "local[4]", 2.9976065158843994, 0.01690530776977539, 1.6657346179053807, 1.352629404929942),
    ("ALS", "local[8]", 2.1991348266601562, 0.016464710235595703, 1.6657346179053798, 1.352629404929942),
]
RUN_COLUMNS = "model string, cores string, train_time double, prediction_time double, rmse double, mae double"


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
