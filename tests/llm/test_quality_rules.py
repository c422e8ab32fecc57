import random
import re
from collections import Counter

from tests.llm.conftest import PROSE, rows_of

from halfstar.llm import quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures():
    rng = random.Random(2)
    texts = ["", None, "a\u00a0b\x1cc", PROSE, f"{PROSE}\n" * 3]
    texts += ["".join(rng.choice("ab \n\t\x1c\x85#|é") for _ in range(rng.randint(0, 300))) for _ in range(800)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for text in texts:
        assert quality_rules.measure(text) == brute(text)


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(quality_rules.xxhash, "xxh3_64_intdigest", lambda w: 7)
    rng = random.Random(1)
    for _ in range(100):
        text = " ".join(rng.choice("abc") for _ in range(rng.randint(8, 40)))
        assert quality_rules.measure(text)[4] == brute(text)[4]


def test_hosts(make_docs, hard_docs, no_docs):
    good = [f"{PROSE} {i} and then {i + 1}" for i in range(200)]
    rows = [(i, t if i % 4 else "too short", "en", "good", 0, "", "", "") for i, t in enumerate(good)]
    rows += [(1000 + i, t if i % 10 == 0 else "junk", "en", None, 0, "", "", "") for i, t in enumerate(good)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(make_docs(rows)).collect()}
    for i, text, *_ in rows:
        words, *_, repeat = brute(text)
        failed = words < 20 or 100 * repeat > 30 * words
        assert got[i].base_failed == failed and got[i].kept == (not failed and i < 1000)
    out = quality_rules.quality_rules(hard_docs)
    assert out.count() == hard_docs.count() and out.where("kept is null").count() == 0
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_long_lines_that_repeat_fail_the_host(make_docs):
    line = "read more on this site"
    text = "".join(f"{' '.join(f'w{i}x{j}' for j in range(10))}\n{line}\n" for i in range(50))
    fine = "".join(f"{' '.join(f'w{i}x{j}' for j in range(10))}\n" for i in range(50)) + f"{line}\n" * 20
    rows = [(i, text, "en", "boilerplate", 0, "", "", "") for i in range(40)] + [(100 + i, fine, "en", "fine", 0, "", "", "") for i in range(40)]
    for r in quality_rules.quality_rules(make_docs(rows)).collect():
        assert (r.n_dup_lines, r.n_repeat_words == 0) == ((49, True) if r.doc_id < 100 else (19, False))
        assert not r.base_failed and r.host_failed == (r.doc_id < 100) and r.kept == (r.doc_id >= 100)


def test_prior_is_between_the_extremes(spark):
    from halfstar.llm.common import beta_prior

    a, b = beta_prior(spark.createDataFrame([(i % 3, 20) for i in range(300)], "bad long, n long"), "bad", "n")
    assert 0.03 < a / (a + b) < 0.07 and 2 <= a + b <= 1000
    assert beta_prior(spark.createDataFrame([], "bad long, n long"), "bad", "n") == (1.0, 1.0)
    even = spark.createDataFrame([(0, 10), (10, 10)] * 50, "bad long, n long")
    assert sum(beta_prior(even, "bad", "n")) == 2.0
