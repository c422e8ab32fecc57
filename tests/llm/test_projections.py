"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest

from halfstar.llm import projections, queries

VECTORS = "vec_id long, embedding array<double>, label int, n_links string, _row long, _rep string"


def plain(rows, threshold=0.93):
    """Every two rows."""
    fine = lambda v: v and all(c is not None and math.isfinite(c) for c in v) and any(v)
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ok = [i for i, (_, v, x) in enumerate(rows) if x is not None and fine(v)]
    units = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in ok}
    units = {i: u / np.sqrt((u * u).sum()) for i, u in units.items()}
    for a in range(len(ok)):
        for b in range(a):
            i, j = ok[a], ok[b]
            if rows[i][2] == rows[j][2] and units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i in range(n):
        r = find(i)
        ids = [x for x in (least.get(r), rows[i][0]) if x is not None]
        least[r] = min(ids) if ids else None
    return sorted(((rows[i][0], links[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(n)), key=str)


def make(spark, rows):
    return spark.createDataFrame([(i, v, x, "a", 1, "b") for i, v, x in rows], VECTORS)


def near(rng, v, cosine):
    """A vector with that cosine to v."""
    v = v / np.linalg.norm(v)
    off = rng.normal(size=len(v))
    off -= (off @ v) * v
    return cosine * v + math.sqrt(1 - cosine * cosine) * off / np.linalg.norm(off)


def rows_with_groups(dims=64, seed=5):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, 2):
        for _ in range(60):
            base = rng.normal(size=dims)
            rows.append((i, base.tolist(), label))
            for c in (0.99, 0.95, 0.94, 0.92, 0.9)[: int(rng.integers(0, 6))]:
                i += 1
                rows.append((i, (near(rng, base, c) * rng.uniform(0.1, 50)).tolist(), label if rng.random() < 0.8 else 3))
            i += 1
    dense = rng.normal(size=dims)
    rows += [(2000 + k, near(rng, dense, 0.99).tolist(), 1) for k in range(90)]
    rows += [(3000 + k, rows[4][1], rows[4][2]) for k in range(30)]
    rows += [(4000, None, 1), (4001, [0.0] * dims, 1), (4002, [1.0] * (dims - 1) + [None], 1), (4003, [math.nan] * dims, 1), (4004, [math.inf] + [1.0] * (dims - 1), 1)]
    rows += [(4005, rows[0][1], None), (None, rows[0][1], rows[0][2]), (None, None, None), (7, rows[9][1], rows[9][2]), (4006, [], 1)]
    rows += [(4007, (np.array(rows[0][1]) * 1e-200).tolist(), 0), (4008, (np.array(rows[0][1]) * 1e200).tolist(), 0)]
    return rows


def close(got, want):
    """All rows the same but for the share of links that the calibration may miss."""
    assert len(got) == len(want)
    found, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found <= all_links and found >= 0.995 * all_links
    assert sum(a != b for a, b in zip(got, want)) <= 0.01 * len(want)


@pytest.mark.parametrize("block,partners", [(1024, 16_384), (16, 16_384), (16, 1)])
def test_against_all_pairs(spark, monkeypatch, block, partners):
    """One block a bucket, many blocks, buckets of several tails."""
    monkeypatch.setattr(projections, "BLOCK", block)
    calibrate = projections.calibrate
    monkeypatch.setattr(projections, "calibrate", lambda d, t, m, r: calibrate(d, t, m, r, partners))
    rows = rows_with_groups()
    got = projections.near_duplicates(make(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    close(sorted((tuple(r) for r in got.collect()), key=str), plain(rows))


@pytest.mark.parametrize("dims", [1, 2, 5])
def test_few_dimensions(spark, dims):
    rng = np.random.default_rng(dims)
    rows = [(i, rng.normal(size=dims).tolist(), i % 2) for i in range(80)]
    close(sorted((tuple(r) for r in projections.near_duplicates(make(spark, rows)).collect()), key=str), plain(rows))


def test_whole_table(spark, sf):
    """The query on its table, against all pairs: recall of links."""
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    close(sorted((tuple(r) for r in queries.op12(spark, sf).collect()), key=str), plain(rows))


def test_nothing(spark):
    assert projections.near_duplicates(make(spark, [])).count() == 0
    got = projections.near_duplicates(make(spark, [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0], None)]))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_recall_at_the_threshold():
    """Fresh pairs exactly at the threshold reach their count as often as calibrated; unlike ones hardly ever."""
    rng = np.random.default_rng(11)
    for most in (500, 100_000):
        plan = projections.calibrate(64, 0.93, most)
        base = rng.normal(size=(2000, 64))
        base /= np.linalg.norm(base, axis=1)[:, None]
        other = np.stack([near(rng, b, 0.93) for b in base])
        tails = [projections.tokens(x, plan) for x in (base, other)]
        count = np.array([projections.collisions(np.stack([a, b]))[0, 1] for a, b in zip(*tails)])
        assert (count >= plan.least).mean() >= 0.993
        unlike = projections.collisions(tails[0][:1000])
        np.fill_diagonal(unlike, 0)
        assert (unlike >= plan.least).mean() < 2 * 4 / most + 1e-4
