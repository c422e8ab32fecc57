import random
import re

import pytest

from tests.llm.conftest import rows_of

from halfstar.llm import pii, semi_crf


def brute(text):
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def test_patterns_against_plain_ones():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a@.-+0123 ()49\n") for _ in range(rng.randint(0, 120)))
        assert pii.base_spans(text) == brute(text)
    card = "4539148803436467"
    assert pii.base_spans(f"x {card}.") == [("card", 2, 18)] and pii.base_spans("é a@b.co") == [("email", 2, 8)]


def test_patterns_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1 " * 100_000, "+1" * 100_000, "a@" * 100_000, "1." * 100_000, "+1" + " " * 200_000):
        pii.base_spans(text)


def person(rng):
    digits = "".join(rng.choice("0123456789") for _ in range(10))
    return rng.choice([
        f"call +1 ({digits[:3]}) {digits[3:6]}-{digits[6:]} now", f"write to al.{digits[:2]}@mail{digits[0]}.example.com today",
        f"from {digits[0]}.{digits[1]}.{int(digits[2:4])}.{int(digits[4:6])} came", f"in {1900 + int(digits[:2])} there were {digits[:3]} ships",
    ])


def test_model_finds_what_it_learnt():
    rng = random.Random(7)
    model = pii.train([person(rng) for _ in range(200)])
    hit = want = wrong = 0
    for _ in range(200):
        text = person(rng)
        base, got = {s for s in pii.base_spans(text)}, {(k, a, b) for a, b, k in model.best(semi_crf.lattice(text))}
        hit, want, wrong = hit + len(base & got), want + len(base), wrong + len(got - base)
    assert hit >= 0.95 * want and wrong <= 0.03 * want
    # A phone number that a card number follows is no match of the patterns.
    base, added = pii.find("call +1 (415) 555-2671 4539148803436467 now", model)
    assert not any(k == "phone" for k, _, _ in base) and ("phone", 5, 22) in added


def test_dense_text_is_read_whole():
    rng = random.Random(7)
    model = pii.train([person(rng) for _ in range(200)])
    piece = "call +1 (415) 555-2671 4539148803436467 now; "
    base, added = pii.find(piece * 200, model)
    assert {s for s in added if s[0] == "phone"} >= {("phone", i * len(piece) + 5, i * len(piece) + 22) for i in range(200)}
    text = "".join(person(rng) + rng.choice([" ", "; ", "\n"]) for _ in range(60))
    want = model.best(semi_crf.lattice(text))
    assert all(model.best_of(text, step) == want for step in (1, 7, 512)) and model.best_of("") == []


def test_stretches_hold_every_mark():
    numbers = "030 123 45 67 80; " * 1000
    assert pii.stretches(numbers) == [(0, len(numbers))]
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "b" * 40, " ", "é", "7", "@", "x " * 30]) for _ in range(rng.randint(0, 40)))
        found = pii.stretches(text)
        assert all(a < b <= c < d for (a, b), (c, d) in zip(found, found[1:]))
        assert all(any(a <= m.start() < b for a, b in found) for m in re.finditer("[0-9@]", text))
        for a, b in found:
            for cut in {a, b} - {0, len(text)}:
                assert not (text[cut - 1].isalnum() and text[cut].isalnum())


def test_gradient_against_differences():
    rng = random.Random(1)
    model = semi_crf.SemiCrf(["", "x", "y"])
    x = semi_crf.lattice("a 12@3 b")
    import numpy as np

    state = np.random.default_rng(0)
    model.weights[:, 1:] = state.normal(size=model.weights[:, 1:].shape) * 0.3
    model.moves[:] = state.normal(size=(3, 3)) * 0.3
    entities = [(2, 5, 1)]

    def likelihood():
        n, scores = len(x.first) - 1, model._scores(x)
        ahead, entry = np.full((n + 1, 3), semi_crf.MINUS), np.full((n + 1, 3), semi_crf.MINUS)
        ahead[0, 0] = 0.0
        for j in range(n + 1):
            if j:
                a, b = x.first[j - 1], x.first[j]
                ahead[j] = np.logaddexp.reduce(entry[x.start[a:b]] + scores[a:b], axis=0)
            entry[j] = np.logaddexp.reduce(ahead[j][:, None] + model.moves, axis=0)
        place = {(int(i), int(j)): s for s, (i, j) in enumerate(zip(x.start, x.end))}
        path, i, last = 0.0, 0, 0
        while i < n:
            j, y = next(((j, y) for a, j, y in entities if a == i), (i + 1, 0))
            path += model.moves[last, y] + scores[place[i, j], y]
            i, last = j, y
        return path - np.logaddexp.reduce(ahead[n])

    grad, moves = model._gradient(x, entities)
    for y, c in [(rng.randrange(3), int(c)) for c in np.unique(x.codes) if c][:12]:
        before = likelihood()
        model.weights[y, c] += 1e-5
        assert abs((likelihood() - before) / 1e-5 - grad[y, c]) < 1e-3
        model.weights[y, c] -= 1e-5
    for a in range(3):
        for b in range(3):
            before = likelihood()
            model.moves[a, b] += 1e-5
            assert abs((likelihood() - before) / 1e-5 - moves[a, b]) < 1e-3
            model.moves[a, b] -= 1e-5


def test_tables(hard_docs, no_docs, make_docs):
    rng = random.Random(9)
    docs = make_docs(rows_of([person(rng) + " é " + person(rng) for _ in range(60)]))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in pii.find_personal_data(docs).collect():
        assert [tuple(s) for s in row.base] == brute(texts[row.doc_id])
    got = pii.find_personal_data(hard_docs)
    assert got.columns == ["doc_id", "base", "added"] and got.count() == hard_docs.count()
    assert pii.find_personal_data(no_docs).count() == 0


@pytest.mark.parametrize("text", ["", "no marks", "1" * 5000, "12 " * 400])
def test_regions_are_bounded(text):
    for a, b in pii.regions(text):
        assert 0 <= a < b <= len(text) and b - a <= pii.REGION_MOST
