from collections import defaultdict

from tests.llm.conftest import PROSE, rows_of

from halfstar.llm.mixing import mix_report, mix_sources, mixed_documents


def capped_shares(sizes, weights, limit):
    """Share the total by weight, hold what exceeds its limit, and share the excess anew until none does."""
    held, total = {}, sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        level = (total - sum(held.values())) / (sum(weights[i] for i in free) or 1)
        over = [i for i in free if weights[i] * level > limit * sizes[i] + 1e-9]
        if not over:
            return [held.get(i, weights[i] * level) for i in range(len(sizes))]
        held.update({i: limit * sizes[i] for i in over})


def test_targets_and_closeness(make_docs):
    sizes = {"a": 4000, "b": 50, "c": 3000, "d": 700, None: 1500}
    rows = [(i, " ".join(["w"] * 25), "en", s, 0, "", "", "") for s, n in sizes.items() for i in range(n // 25)]
    report = mix_report(mix_sources(make_docs(rows), block_words=8)).collect()
    want = dict(zip(sorted(sizes.values()), capped_shares(*zip(*sorted((n, w) for n, w in zip(sizes.values(), (1, 2, 3, 1, 2)))), 3)))
    taken = defaultdict(int)
    for r in report:
        assert abs(r.target - want[r.source_size]) < 1e-5 and 0 <= r.taken <= 3 * r["size"] and r["size"] == 25
        taken[r.source_size] += r.taken
    assert all(abs(taken[n] - want[n]) <= 4 * 8 for n in sizes.values())


def test_hard_cases(hard_docs, no_docs):
    report = mix_report(mix_sources(hard_docs))
    again = mix_report(mix_sources(hard_docs.repartition(5)))
    assert sorted(map(repr, report.collect())) == sorted(map(repr, again.collect()))
    assert report.count() == hard_docs.count()
    assert report.where("size = 0 and taken > 0").count() == 0
    assert mix_report(mix_sources(no_docs)).count() == 0 and mixed_documents(no_docs).count() == 0
    assert mixed_documents(hard_docs).columns == hard_docs.columns


def test_texts_without_words(make_docs):
    report = mix_report(mix_sources(make_docs(rows_of(["", None, " "]))))
    assert [r.taken for r in report.collect()] == [0, 0, 0]
    assert mixed_documents(make_docs(rows_of(["", None, " "]))).count() == 3


def test_whole_documents_follow_the_words(make_docs):
    docs = make_docs(rows_of([f"{PROSE} {i}" for i in range(600)]))
    words = sum(r.taken for r in mix_report(mix_sources(docs)).collect())
    assert abs(mixed_documents(docs).count() * 20 - words) < 0.1 * words


def test_many_rows_of_one_id_and_text(make_docs):
    """Thousands of rows that agree in id and text: each comes as often as its own words are taken, in linear work."""
    rows = [(None, "", None, "a", None, None, None, None)] * 4000 + [(7, "one two three", None, "b", None, None, None, None)] * 3000
    docs = make_docs(rows)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    taken = mix_sources(docs).taken().where("size > 0").selectExpr("cast(floor(taken / size + 0.5) as int) as t").groupBy().sum("t").first()[0]
    assert out.where("text = ''").count() == 4000 and out.where("doc_id = 7").count() == taken
