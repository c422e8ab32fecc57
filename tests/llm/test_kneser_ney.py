import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import LABELS, PROSE

from halfstar.llm import kneser_ney as kn


def brute_model(texts, asked):
    """Probability of each n-gram in ``asked``, straight from the definition."""
    grams = {}
    for g in kn.text_grams(texts)[0].tolist() if texts else []:
        grams[g] = grams.get(g, 0) + 1
    levels = {kn.ORDER: grams}
    for k in range(kn.ORDER - 1, 0, -1):
        levels[k] = {}
        for g in levels[k + 1]:
            low = g & ((1 << kn.BITS * k) - 1)
            levels[k][low] = levels[k].get(low, 0) + 1
    off = {k: kn.discounts([sum(c == i for c in level.values()) for i in (1, 2, 3, 4)]) for k, level in levels.items()}

    def p(g, k):
        if k == 0:
            return 1 / kn.ALPHABET
        context = {x: c for x, c in levels[k].items() if x >> kn.BITS == g >> kn.BITS}
        lower = p(g & ((1 << kn.BITS * (k - 1)) - 1), k - 1)
        total = sum(context.values())
        if not total:
            return lower
        d = lambda c: off[k][min(c, 3) - 1] if c else 0.0
        c = levels[k].get(g, 0)
        return (c - d(c) + sum(map(d, context.values())) * lower) / total

    return {g: p(g, kn.ORDER) for g in asked}


def test_probabilities(spark):
    train, other = [PROSE, PROSE[:40], "the mill wheel"], ["the unseen 中 text!", ""]
    want = brute_model(train, set(kn.text_grams(train + other)[0].tolist()))
    counts = {}
    for g in kn.text_grams(train)[0].tolist():
        counts[g] = counts.get(g, 0) + 1
    rows = [(g, counts.get(g, 0)) for g in want]
    got = {r.g: r.bits for r in kn.gram_bits(spark.createDataFrame(rows, "g long, c long")).collect()}
    assert got.keys() == want.keys() and all(abs(2 ** -got[g] - want[g]) < 1e-12 for g in want)


def test_probabilities_add_up(spark):
    """After a known context, all symbols together have probability one."""
    train = [PROSE, PROSE[5:]]
    context = kn.text_grams(train)[0][20] >> kn.BITS
    counts = {}
    for g in kn.text_grams(train)[0].tolist():
        counts[g] = counts.get(g, 0) + 1
    every = [int(context) << kn.BITS | s for s in range(kn.ALPHABET)]
    rows = [(g, counts.get(g, 0)) for g in {*every, *counts}]
    bits = kn.gram_bits(spark.createDataFrame(rows, "g long, c long")).where(F.shiftright("g", kn.BITS) == int(context))
    assert abs(sum(2 ** -r.bits for r in bits.collect()) - 1) < 1e-9


def test_grams_are_cut_at_texts():
    grams, owner = kn.text_grams(["ab", "", "c"])
    assert owner.tolist() == [0, 0, 0, 1, 2, 2]
    low = (grams & (kn.ALPHABET - 1)).tolist()
    assert low == [ord("a") + 2, ord("b") + 2, 1, 1, ord("c") + 2, 1] and grams[3] == 1
    assert (kn.symbols("\x00é中😀\uffff") < kn.ALPHABET).all() and (kn.symbols("\x00\x01") > 1).all()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = PROSE.split()
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(30, 80)))
    bad = lambda: "".join(rng.choice("#$%&XQZ!| ") for _ in range(rng.randint(100, 300)))
    return [(i, bad() if i % 10 == 0 else good(), "en" if i % 3 else None, "s", 0, "", "", "") for i in range(1200)]


def test_junk_goes_and_clean_text_stays(spark, make_docs, corpus):
    docs = make_docs(corpus)
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(0, 1200, 2)], LABELS)
    got = {r.doc_id: r for r in kn.quality(docs, labels).collect()}
    assert len(got) == len(corpus)
    junk = [got[i].kept for i in range(0, 1200, 10)]
    clean = [got[i].kept for i in range(1200) if i % 10]
    assert sum(junk) == 0 and sum(clean) >= 0.99 * len(clean)
    stay = kn.keep_good(docs, labels)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == {i for i, r in got.items() if r.kept}


def test_scores_are_the_models(spark, make_docs, corpus):
    docs = make_docs(corpus[:60])
    trained = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "_id long")
    texts = [r[1] for r in corpus[:60]]
    want = brute_model(texts[::3], set(kn.text_grams(texts)[0].tolist()))
    for r in kn.perplexities(docs, trained, "doc_id", "text", "lang").collect():
        bits = sum(-math.log2(want[g]) for g in kn.text_grams([texts[r._id]])[0].tolist())
        assert abs(r.bits - bits) < 1e-6 * bits and r.n_symbols == len(texts[r._id]) + 1


def test_hard_cases(spark, hard_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, None), (3, None, 0), (999, 1, 1)], LABELS)
    got = kn.quality(hard_docs, labels)
    assert got.count() == hard_docs.count() and got.where("kept is null").count() == 0
    none = spark.createDataFrame([], LABELS)
    assert kn.quality(hard_docs, none).where("kept").count() == hard_docs.count()
    assert kn.keep_good(hard_docs, none).count() == hard_docs.count()
    assert kn.quality(no_docs, labels).count() == 0 and kn.keep_good(no_docs, labels).count() == 0


def test_discounts_stay_in_range():
    for n in ([0, 0, 0, 0], [5, 0, 1, 1], [1, 9, 9, 9], [100, 40, 20, 12]):
        assert all(0 < d < i for i, d in enumerate(kn.discounts(n), 1))
    assert np.allclose(kn.discounts([100, 40, 20, 12]), (1 - 2 * 100 / 180 * 0.4, 2 - 3 * 100 / 180 * 0.5, 3 - 4 * 100 / 180 * 0.6))


def test_every_character_has_symbols_of_its_own():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    seen = [tuple(kn.symbols(c).tolist()) for c in every[::37] + every[:5000]]
    assert len(set(seen)) == len(set(every[::37] + every[:5000])) and max(max(x) for x in seen) < kn.ALPHABET
    assert min(min(x) for x in seen) > 1 and kn.symbols("aбकか😀").tolist() == [y for c in "aбकか😀" for y in kn.symbols(c).tolist()]


@pytest.mark.parametrize("letters", ["かきくけこさしすせそたちつてとなにぬねのはひふへほ", "가나다라마바사아자차카타파하거너더러머버서어저처", "აბგდევზთიკლმნოპჟრსტუ"])
def test_junk_of_other_scripts_goes(spark, make_docs, letters):
    """Shuffled characters of a script score worse than its words do."""
    rng = random.Random(6)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(40)]
    rows = []
    for i in range(700):
        text = [rng.choice(words) for _ in range(rng.randint(40, 80))]
        chars = list("".join(text))
        rng.shuffle(chars)
        rows.append((i, "".join(chars) if i % 10 == 0 else " ".join(text), "xx", "s", 0, "", "", ""))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(700) if i % 10], LABELS)
    got = {r.doc_id: r.kept for r in kn.quality(make_docs(rows), labels).collect()}
    assert sum(got[i] for i in range(0, 700, 10)) == 0 and sum(got[i] for i in range(700) if i % 10) >= 0.99 * 630


def test_lists_are_as_many_as_ngrams_at_most():
    """Counting in a block is the same for any number of shards, and gives no empty lists."""
    import pickle

    import pandas as pd
    import zstandard

    texts = [PROSE, PROSE[::-1], "short"]
    blob = zstandard.ZstdCompressor().compress(pickle.dumps((["1", "2", "3"], [0, 0, 0], ["en"] * 3, texts)))
    packed, trusted = pd.DataFrame({"_block": [0], "_packed": [blob]}), pd.DataFrame({"_id": ["1", "3"]})
    whole = []
    for shards in (1, 17, 100_001):
        lists = kn._count(packed, trusted, shards)
        parts = [kn._pressed(x) for x in lists["_list"]]
        assert all(len(g) for g, _ in parts) and all((g % shards == s).all() for (g, _), s in zip(parts, lists["_shard"]))
        whole.append(sorted((int(g), int(c)) for gs, cs in parts for g, c in zip(gs, cs)))
    assert whole[0] == whole[1] == whole[2] and len(whole[0]) == len(set(kn.text_grams(texts)[0].tolist()))
