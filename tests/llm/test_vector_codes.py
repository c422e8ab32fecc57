"""Trees, codebooks and codes against plain loops."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from halfstar.llm import anchors, queries, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int, _id string, code string, _key int"


def plain(rows, parts=8, entries=16, rounds=6):
    """The contract, vector by vector; rows of (id, vector, label)."""
    kept = [(i, v, x) for i, v, x in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    points = [[math.floor(4096 * c) for c in v] for _, v, _ in kept]
    size = len(points[0]) // parts
    cut = lambda p, k: p[k * size : (k + 1) * size]
    books = [[cut(p, k) for p in points[:entries]] for k in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, book: min(range(len(book)), key=lambda e: (gap(p, book[e]), e))
    for _ in range(rounds):
        for k, book in enumerate(books):
            owned = [[] for _ in book]
            for p in points:
                owned[nearest(cut(p, k), book)].append(cut(p, k))
            books[k] = [[sum(c) // len(o) for c in zip(*o)] if o else e for e, o in zip(book, owned)]
    out = []
    for (i, _, x), p in zip(kept, points):
        codes = [nearest(cut(p, k), book) for k, book in enumerate(books)]
        out.append((i, "".join(f"{c:02x}" for c in codes), sum(gap(cut(p, k), books[k][c]) for k, c in enumerate(codes)), x))
    total = {}
    for _, _, e, x in out:
        total[x] = total.get(x, 0) + e
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, c, e, total[x], sha) for i, c, e, x in out), key=str)


def make(spark, rows):
    return spark.createDataFrame([(i, v, x, "a", "b", 1) for i, v, x in rows], VECTORS)


def hard_rows(n=150, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dims).round(1).tolist(), int(i % 3)) for i in range(n)]
    rows += [(5, rows[5][1], 2), (None, rows[7][1], None), (None, None, 1), (900, None, None), (901, [], 1), (902, [1.0] * 15 + [None], 1)]
    rows += [(903, [1.0] * 15 + [math.nan], 1), (904, [math.inf] + [1.0] * 15, 0), (905, [0.0] * dims, None), (906, [-0.0] * dims, None)]
    rows += [(1000 + i, rows[1][1], 7) for i in range(80)]
    return rows


@pytest.mark.parametrize("n,entries,rounds", [(150, 16, 6), (9, 16, 2), (60, 3, 4)])
def test_against_plain_loops(spark, n, entries, rounds):
    rows = hard_rows(n) if n > 10 else hard_rows(n)[:n]
    got = vector_codes.compress(make(spark, rows), parts=4, entries=entries, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 4, entries, rounds)


def test_in_many_blocks(spark, monkeypatch):
    rows = hard_rows(400)
    want = plain(rows, 8)
    got = vector_codes.compress(make(spark, rows).repartition(7))
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_sql_on_hard_rows(spark, tmp_path):
    rows = [r for r in hard_rows() if r[0] is not None]
    make(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    theirs = con.execute(queries.ORACLES["op11_vector_codes"]).fetchall()
    assert sorted(map(tuple, theirs), key=str) == sorted((tuple(r) for r in queries.op11(spark, str(tmp_path)).collect()), key=str)


def test_nothing_and_what_cannot_be(spark):
    assert vector_codes.compress(make(spark, [])).count() == 0
    assert vector_codes.compress(make(spark, [(1, None, 1), (2, [math.nan] * 8, 1)])).count() == 0
    with pytest.raises(ValueError, match="components"):
        vector_codes.compress(make(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)]))
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress(make(spark, [(1, [1e30] * 8, 1)]))


@pytest.mark.parametrize("n,dims,spread", [(0, 8, 100), (1, 3, 5), (30, 8, 1), (3000, 8, 500), (4000, 1, 50), (2000, 2, 3)])
def test_trees(n, dims, spread):
    rng = np.random.default_rng(n + dims)
    points = rng.integers(-spread, spread, (n, dims))
    tree = anchors.unpacked(anchors.build(points).packed())
    assert sorted(tree.order.tolist()) == list(range(n))
    for b in range(len(tree.start)):
        own = points[tree.order[tree.start[b] : tree.end[b]]]
        assert (tree.total[b] == own.sum(axis=0)).all()
        assert not len(own) or anchors.distances2(own, tree.centre[b]).max() == tree.radius2[b]
        if tree.left[b]:
            assert tree.start[tree.left[b]] == tree.start[b] and tree.end[tree.left[b]] == tree.start[tree.right[b]] and tree.end[tree.right[b]] == tree.end[b]
    entries = np.concatenate([rng.integers(-spread, spread, (14, dims)), points[:1], points[:1]])
    nearest, sums, counts, computed = anchors.assign(tree, points, entries)
    want = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == want).all() and computed <= n * len(entries)
    for e in range(len(entries)):
        assert counts[e] == (want == e).sum() and (sums[e] == points[want == e].sum(axis=0)).all()


def test_balls_are_owned_whole():
    """Where points lie in groups, nearly no distance to a point is computed."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 8))
    points = np.concatenate([c + rng.integers(-60, 60, (250, 8)) for c in centres])
    tree = anchors.build(points)
    assert anchors.assign(tree, points, centres)[3] < 0.02 * points.shape[0] * 16
