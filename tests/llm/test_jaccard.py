import random
from collections import Counter

import numpy as np

from tests.llm.conftest import rows_of

from halfstar.llm import jaccard
from halfstar.llm.components import components


def brute(rows, threshold=0.8):
    """(id, copy, class, copies, links) of rows with ids, all pairs compared."""
    classes = {}
    for r in rows:
        classes.setdefault(tuple((r[1] or "").encode().split()), []).append(r[0])
    copy = {w: min(ids) for w, ids in classes.items()}
    sets = {copy[w]: {w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set() for w in classes}
    root = {c: c for c in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    reps = sorted(sets)
    for i, a in enumerate(reps):
        for b in reps[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                links.update((a, b))
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, copy[w], find(copy[w]), len(ids), links[copy[w]]) for w, ids in classes.items() for i in ids)


def variants(rng, n, words=60, edits=4):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def found(df):
    return sorted((r.doc_id, r.copy_id, r.class_id, r.n_copies, r.n_links) for r in df.collect())


def test_against_all_pairs(make_docs, monkeypatch):
    rng = random.Random(8)
    texts = [t for _ in range(25) for t in variants(rng, rng.randint(1, 9))] + variants(rng, 120) + ["a b", "a  b", "", "", "c"]
    rows = rows_of(texts)
    assert found(jaccard.similar_classes(make_docs(rows))) == brute(rows)
    # The same in blocks: a large component is cut, and every two blocks meet.
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 25)
    assert found(jaccard.similar_classes(make_docs(rows))) == brute(rows)
    one = jaccard.keep_one(make_docs(rows))
    assert {r.doc_id for r in one.collect()} == {c for _, _, c, _, _ in brute(rows)} and one.columns[:2] == ["doc_id", "text"]


def test_hard_cases(hard_docs, no_docs):
    rows = [tuple(r) for r in hard_docs.collect()]
    named = [r for r in rows if r[0] is not None]
    got = jaccard.similar_classes(hard_docs)
    assert got.count() == len(rows)
    assert {(r.doc_id, r.class_id, r.n_links) for r in got.where("doc_id is not null").collect()} == {(i, c, n) for i, _, c, _, n in brute(named)}
    assert jaccard.similar_classes(no_docs).count() == 0 and jaccard.keep_one(no_docs).count() == 0
    stay = [r.doc_id for r in jaccard.keep_one(hard_docs).collect() if r.doc_id is not None]
    assert len(stay) == len(set(stay)) == len({c for _, _, c, _, _ in brute(named)})


def test_found_share_and_filter():
    """Pairs of a similarity share a prefix as often as the formula says, and hardly any above the threshold is filtered out."""
    rng = np.random.default_rng(5)
    n, found, low = 400, {8: 0, 6: 0}, 0
    for _ in range(n):
        every = rng.integers(0, 2**63, 360, dtype=np.uint64)
        a, b = np.unique(every[:324]), np.unique(every[36:])  # similarity 0.8
        x, y = jaccard.labels_of(a), jaccard.labels_of(b)
        for depth in found:
            found[depth] += bool(((x ^ y) >> np.uint64(8 * (8 - depth)) == 0).any())
        low += (x.view(np.uint8) == y.view(np.uint8)).sum() < jaccard.least_equal(0.8)
    for depth, k in found.items():
        assert abs(k / n - jaccard.found_share(np.array([0.8]), depth)[0]) < 0.03
    assert low == 0 and jaccard.found_share(np.array([0.8]), jaccard.DEPTH)[0] > 0.98


def test_prefixes_are_shortened_until_the_recall_is_met(make_docs, monkeypatch, tmp_path):
    """Pairs just above the threshold make the search go on to shorter prefixes, exact copies and close pairs don't."""
    rng, depths = random.Random(2), []
    prefixes = jaccard.prefixes
    monkeypatch.setattr(jaccard, "prefixes", lambda classes, depth: depths.append(depth) or prefixes(classes, depth))
    close = [t for _ in range(40) for base in [[f"w{rng.randrange(10**6)}" for _ in range(300)]] for t in (" ".join(base), " ".join(base[:-1] + ["x"]))]
    jaccard.similar_classes(make_docs(rows_of(close))).count()
    assert depths == [8]
    depths.clear()
    far = []
    for _ in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        far += [" ".join(base), " ".join(base[55:] + [f"y{rng.randrange(10**6)}" for _ in range(3)])]
    rows = rows_of(far)
    got = found(jaccard.similar_classes(make_docs(rows)))
    assert depths[0] == 8 and 4 <= depths[-1] <= 7 and depths == sorted(depths, reverse=True)
    assert sum(r[4] for r in got) >= 0.99 * sum(r[4] for r in brute(rows))


def test_templates_are_not_verified(make_docs, monkeypatch):
    """Pages with a common template, pairs at 0.3 to 0.45, hardly reach the verification."""
    rng = random.Random(4)
    template = [f"t{i}" for i in range(60)]
    pages = [" ".join(template + [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 60))]) for _ in range(600)]
    classes = jaccard.sketches(make_docs(rows_of(pages)), "doc_id", "text").selectExpr("_id as _rep", "_labels")
    least, seen = jaccard.least_equal(0.8), 0
    for depth in (8, 6, 4):
        rows = jaccard.dealt(jaccard.prefixes(classes, depth)).join(classes, "_rep").toPandas()
        seen += sum(len(i) for _, task in rows.groupby("_task") for _, i, _ in jaccard.candidates(task, depth, least))
    assert seen < len(pages)


def test_ids_of_any_type_and_many_rows_without_one(make_docs):
    rows = rows_of(variants(random.Random(1), 6, edits=2) * 2)
    docs = make_docs(rows).selectExpr("concat('d', lpad(doc_id, 3, '0')) as doc_id", "text")
    want = {f"d{i:03d}": f"d{c:03d}" for i, _, c, _, _ in brute(rows)}
    assert {r.doc_id: r.class_id for r in jaccard.similar_classes(docs).collect()} == want
    nobody = make_docs([(None, "", None, None, None, None, None, None)] * 3000)
    assert jaccard.keep_one(nobody).count() == 3000


def test_minima_estimate_similarity():
    a, b = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(100, 1100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    same = (jaccard.minima(a, 192) == jaccard.minima(b, 192)).mean()
    assert abs(same - 900 / 1100) < 0.1


def test_counts_in_slabs(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    sets = [np.array(range(i, i + 40), np.uint64) for i in range(0, 30, 2)]
    i, j = np.triu_indices(15, 1)
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j)]
    assert jaccard.shared_counts(sets)[i, j].tolist() == want
    assert jaccard.common_shingles(sets, i[:5], j[:5]).tolist() == want[:5]


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (5, 5), (None, 1)] + [(1000, i) for i in range(1001, 1200)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {i: 100 for i in range(100, 161)} | {3: 3, 7: 3} | {i: 1000 for i in range(1000, 1200)}
