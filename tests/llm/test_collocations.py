"""Phrase counts on the parse, and the ranking, against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import PROSE, rows_of

from halfstar.llm import collocations


def plain_words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def plain_counts(texts):
    f = Counter()
    for text in texts:
        for words in plain_words(text):
            for k in range(1, 6):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return f


def plain(rows, least, top):
    """The contract, from all counts; rows of (lang, text)."""
    out = []
    for lang in {x or "und" for x, _ in rows}:
        f = plain_counts([t for x, t in rows if (x or "und") == lang])
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            longer = [q for q, b in candidates.items() if len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not longer:
                score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), " ".join(p), left, right))
        out += [(lang, i, p, -a, left, right, n, -s) for i, (s, a, _, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def texts():
    rng = random.Random(12)
    words = ["the", "River", "ran", "past", "old", "mill", "é", "Éa", "x", "日本", "a\x00b", "﻿", "a b", "#", "\x1c"]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r\n", "; "] if rng.random() < 0.3 else [" "]) for _ in range(n))
    out = [(rng.choice(["en", "de", None]), make(rng.randint(0, 400))) for _ in range(150)]
    out += [("en", out[3][1])] * 20 + [("en", PROSE), ("en", None), ("de", ""), (None, "...,;"), ("fr", "one"), ("fr", "Two words")]
    out += [("en", "again " * 9000), ("de", " ".join(f"w{i % 37}" for i in range(12_000)))]
    return out


def docs(make_docs, rows):
    return make_docs([(i, t, x, "s", 0, "", "", "") for i, (x, t) in enumerate(rows)])


@pytest.mark.parametrize("least,top", [(30, 2000), (100, 5)])
def test_against_plain_counting(make_docs, least, top):
    rows = texts()
    got = collocations.collocations(docs(make_docs, rows).repartition(5), least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, least, top)
    assert got.count() >= 10


def parsed(make_docs, rows):
    held = docs(make_docs, rows).selectExpr("coalesce(lang, 'und') as lang", "text")
    words, seed = collocations.vocabulary(held)
    return collocations.dictionary(held, seed), words


def test_all_counts_from_the_dictionary(make_docs):
    """Without a filter the parse gives every phrase's count, overlaps counted once."""
    rows = [("en", t) for _, t in texts()]
    chunks, words = parsed(make_docs, rows)
    spelling = {r.hash: r.word for r in words.collect()}
    want = plain_counts([t for _, t in rows])
    assert {r.word: r.f for r in words.collect()} == {p[0]: c for p, c in want.items() if len(p) == 1}
    for n in range(2, 6):
        got = {" ".join(spelling[h] for h in r.phrase): r.f for r in collocations.phrase_counts(chunks, n).collect()}
        assert got == {" ".join(p): c for p, c in want.items() if len(p) == n}


@pytest.mark.parametrize("least", [30, 300])
def test_infrequent_phrases_make_no_rows(make_docs, least):
    """Their places are counted first; frequent phrases are counted in full, also where one place or one task has but few of them."""
    chunks, words = parsed(make_docs, [("en", t) for _, t in texts()])
    chunks = chunks.repartition(7, "chunk")
    for n in (2, 3):
        every = {tuple(r.phrase): r.f for r in collocations.phrase_counts(chunks, n).collect()}
        some = {tuple(r.phrase): r.f for r in collocations.phrase_counts(chunks, n, collocations.reached_places(chunks, n, least)).collect()}
        frequent = {p: f for p, f in every.items() if f >= least}
        assert frequent and frequent.items() <= some.items() <= every.items()
        assert len(some) - len(frequent) < 0.01 * (len(every) - len(frequent))
    assert not collocations.reached_places(chunks.limit(0), 2, least).any()


def test_words_with_one_hash_are_noticed(make_docs, monkeypatch):
    """Hashes that clash are drawn again."""
    good = collocations.count_words

    def clashing(batches, seed):
        for batch in good(batches, seed):
            if seed < 2 and batch.num_rows:
                one = pa.array([h // 2**61 for h in batch.column("hash").to_pylist()], pa.int64())
                batch = batch.set_column(batch.schema.get_field_index("hash"), "hash", one)
            yield batch

    monkeypatch.setattr(collocations, "count_words", clashing)
    words, seed = collocations.vocabulary(docs(make_docs, texts()).selectExpr("coalesce(lang, 'und') as lang", "text"))
    assert seed == 2 and words.groupBy("hash").agg(F.count_distinct("word").alias("n")).where("n > 1").isEmpty()


def test_equal_passages_are_equal_chunks(make_docs):
    rng = random.Random(1)
    passage = " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(50)) for _ in range(2000))
    rows = [("en", f"start {i} {passage} end {i}") for i in range(50)]
    chunks = parsed(make_docs, rows)[0].collect()
    shared = sum(c.n == 50 for c in chunks)
    assert shared > 80 and len(chunks) < shared + 50 * 6


def test_chunks_cover_pieces():
    rng = random.Random(2)
    for size in (0, 1, 3, 4, 5, 40, 9000):
        for pool in ([7], list(range(1, 31))):
            line = np.array([rng.choice(pool) for _ in range(size + size // 2)], np.uint64)
            edges = np.array(sorted({0, size, len(line)}))
            start, end = edges[:-1], edges[1:]
            a, b, follows = collocations.cut(collocations.mixed(line), start, end)
            owned = np.concatenate([np.arange(x, y - 4 if f else y) for x, y, f in zip(a, b, follows)]) if len(a) else np.zeros(0, int)
            assert sorted(owned.tolist()) == list(range(len(line)))
            assert (b - a <= 2 * collocations.LONGEST_CHUNK + 8).all()


def test_words_and_their_hashes():
    text = b"one  two.one three..\xc3\xa9 one. two one two"
    start, end, first, second, piece = collocations.words_of(text, 0)
    words = [text[a:b] for a, b in zip(start, end)]
    assert words == text.replace(b".", b" ").split() and piece.tolist() == [1, 1, 2, 2, 4, 4, 5, 5, 5]
    for h in (first, second):
        assert len(set(h.tolist())) == len(set(words)) == len(set(zip(words, h.tolist())))
    code, at = collocations.grouped(np.array([5, 5, 6, 5], np.uint64), np.array([1, 2, 3, 1], np.uint64))
    assert code[0] == code[3] != code[1] and len(at) == 3 and [int(code[i]) for i in at] == [0, 1, 2]
    assert collocations.gathered(np.frombuffer(text, np.uint8), start, end).to_pylist() == words


def test_hard_cases(hard_docs, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    assert collocations.collocations(hard_docs.withColumn("text", F.lit(None).cast("string"))).count() == 0
    rows = [(r.lang, r.text) for r in hard_docs.collect()]
    assert sorted(map(tuple, collocations.collocations(hard_docs).collect())) == plain(rows, 100, 2000)


def test_large_products(spark, make_docs, monkeypatch):
    """Counts whose products pass 64 bits."""
    words = spark.createDataFrame([("en", 9, "a", 1, 5 * 10**9), ("en", 9, "b", 2, 7 * 10**9)], "lang string, salt long, word string, hash long, f long")
    phrases = [(9, [1], 5 * 10**9, 1), (9, [2], 7 * 10**9, 1), (9, [1, 2], 4 * 10**9, 2)]
    found = spark.createDataFrame(phrases, "salt long, phrase array<long>, f long, k int")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda texts, least: (found, words))
    got = collocations.collocations(make_docs(rows_of(["a b"]))).collect()
    n = 12 * 10**9
    assert [tuple(r) for r in got] == [("en", 1, "a b", 4 * 10**9, 5 * 10**9, 7 * 10**9, n, 1000 * 4 * 10**9 * n // (35 * 10**18))]
