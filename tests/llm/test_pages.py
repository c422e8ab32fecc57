"""Url filter and language identification."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import LABELS, PAGES, PROSE

from halfstar.llm import language_id, queries, url_filter

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@pytest.fixture(scope="module")
def pages(spark):
    def make(urls, html="<html lang='en'><p>x"):
        return spark.createDataFrame([(i, u, html, "h", "r", "w") for i, u in enumerate(urls)], PAGES)

    return make


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    return host, path


def plain_rule(host, path):
    fit = [(len(r), r, v) for v, r in RULES for n, _, p in [r.partition("/")] if (host == n or host.endswith("." + n)) and path.startswith("/" + p)]
    return max(fit, default=(0, None, None))[1:]


URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG/es/1", "http://a.example.org/en/12", "http://a.example.org/en/2", "https://x.com/fr/2?q",
    "http://x.com/de/1#top", "http://badexample.org/es/1", "http://org", "http://org/", "http://x.com?de/", "a://b://c/d", "http://É.com/x\ny?z", "http://x.com/DE/1",
]


def test_parts_and_rules(spark, pages):
    none = spark.createDataFrame([], "_row long, bad int")
    for r in url_filter.filter_urls(pages(URLS), none, RULES).collect():
        host, path = plain_parts(URLS[r.page_id])
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), URLS[r.page_id]


def test_reputation(spark, pages):
    urls = [f"http://{'bad' if i % 2 else 'good'}.site{i % 2}.net/{i}" for i in range(300)] + ["http://new.site1.net/x", "http://new.site0.net/x", None]
    outcomes = spark.createDataFrame([(i, i % 2 if i % 10 else 0) for i in range(200)] + [(5, None)], "_row long, bad int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages(urls), outcomes, RULES).collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(300))
    # A host without pages of its own takes after its domain.
    assert got[300].host_rate > 0.6 > 0.4 > got[301].host_rate and len(got) == len(urls)
    assert url_filter.filter_urls(pages([]), outcomes, RULES).count() == 0


def test_outcomes_of_numbers_with_a_file_ending(spark, pages, tmp_path):
    urls = [f"http://bad.a.net/en/{i}.html" for i in range(30)] + [f"http://good.b.org/en/{i}.html?x=1#top" for i in range(30, 60)]
    pages([*urls, "http://77.com", "http://77.com/x"]).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, int(i >= 30), 0) for i in range(60)] + [(77, 0, 0)] * 30, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: r for r in queries.op5(spark, str(tmp_path)).collect()}
    assert all(got[i].verdict == "block" and got[i].host_rate > 0.9 for i in range(30))
    assert all(got[i].host_rate < 0.1 for i in range(30, 60)) and got[60].host_rate < 0.9


WORDS = {"en": "the and of river mill water wheel children", "de": "der die und mühle wasser rad kinder fluß", "fr": "le la et rivière moulin eau roue enfants"}


@pytest.fixture(scope="module")
def lang_docs(make_docs):
    rows = []
    for i in range(300):
        lang = list(WORDS)[i % 3]
        w = WORDS[lang].split()
        rows.append((i, " ".join(w[(i * j) % len(w)] for j in range(1, 40)), lang, "s", 0, "", "", ""))
    return make_docs(rows + [(900, None, "en", None, None, None, None, None), (901, PROSE, None, None, None, None, None, None)])


def test_evidence(spark, lang_docs):
    rows = []
    for i in range(240):
        lang = list(WORDS)[i % 3]
        body = " ".join(WORDS[lang].split()[(i * j) % 8] for j in range(1, 30))
        rows.append((i, f"http://h{i % 3}.x.net/{i}", f"<html lang='{lang}'><script>der die und</script><p>{body}</p>", "", "", ""))
    rows += [(500, "http://h1.x.net/none", "<html lang=de>", "", "", ""), (501, "http://h2.x.net/none", "", "", "", ""), (502, None, None, None, None, None)]
    got = {r.page_id: r for r in language_id.identify(spark.createDataFrame(rows, PAGES), lang_docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang == got[i].text_lang == list(WORDS)[i % 3] for i in range(240))
    assert (got[500].text_lang, got[500].lang) == (None, "de") and got[501].lang == "fr"
    assert got[502].lang is not None and all(0 < r.confidence <= 1 for r in got.values())


def test_language_hard_cases(spark, lang_docs, no_docs, pages):
    assert language_id.identify(pages([]), lang_docs).count() == 0
    nothing = language_id.identify(pages(URLS), no_docs)
    assert nothing.where(F.col("lang").isNull()).count() == len(URLS)
    assert language_id.trigrams("ab").size == 0 and language_id.trigrams("x" * 100_000).size == 99_998


def plain_fusion(scored, k, strength=5.0):
    """Logarithms of each page's languages, from its text, declaration and the other pages, one page at a time."""
    out = []
    for i, r in enumerate(scored):
        rest = [x for j, x in enumerate(scored) if j != i]
        votes = lambda rows: [sum(x["best"] == lang for x in rows) for lang in range(k)]
        prior = [(n + 1) / (sum(votes(rest)) + k) for n in votes(rest)]
        for level in (lambda h: h.split(".")[-1], lambda h: ".".join(h.split(".")[-2:]), lambda h: h):
            n = votes([x for x in rest if level(x["host"]) == level(r["host"])])
            prior = [(c + strength * p) / (sum(n) + strength) for c, p in zip(n, prior)]
        same = votes([x for x in rest if x["declared"] == r["declared"]])
        n_rows = sum(votes(scored)) or 1.0
        share = strength * (sum(x["declared"] == r["declared"] for x in scored) + 1) / (n_rows + 1)
        said = [math.log((a + share) / (b + strength)) for a, b in zip(same, votes(rest))]
        out.append([a + math.log(p) + d for a, p, d in zip(r["likelihood"], prior, said)])
    return out


def test_fusion_page_by_page(spark, lang_docs):
    """Every page against plain loops over all others; evidence beside the text decides some."""
    rng = random.Random(3)
    rows = []
    for i in range(160):
        lang = rng.choice(list(WORDS))
        # Letters that no language has seen together say nothing.
        body = rng.choice(["zqx", " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.choice((0, 1, 2, 30))))])
        said = rng.choice(["", f" lang={lang}", " lang=xx", f" lang='{rng.choice(list(WORDS))}'"])
        host = rng.choice([f"{lang}.a.org", f"{lang}.b.com", "mixed.net", "x.a.org", ""])
        rows.append((i, f"http://{host}/{i}" if host else None, f"<html{said}><p>{body}</p>", "", "", ""))
    pages = spark.createDataFrame(rows, PAGES)
    languages, model = language_id.text_model(language_id.trigram_counts(lang_docs))
    scored = [r.asDict() for r in language_id.score_pages(pages, languages, model, "page_id", "url", "html").orderBy("_id").collect()]
    got = {r.page_id: r for r in language_id.identify(pages, lang_docs).collect()}
    moved = 0
    for r, fused in zip(scored, plain_fusion(scored, len(languages))):
        best = max(range(len(languages)), key=lambda i: (fused[i], -i))
        mine = got[r["_id"]]
        assert mine.lang == languages[best]
        assert mine.confidence == pytest.approx(1 / sum(math.exp(x - fused[best]) for x in fused), abs=2e-6)
        moved += mine.text_lang is not None and mine.lang != mine.text_lang
    assert moved > 0 and sum(r.text_lang is None for r in got.values()) > 10


def test_reputation_against_plain_shrinkage(spark):
    """Posterior of every host, from the counts of all levels and the strengths of their priors."""
    from halfstar.llm.common import beta_prior

    rng = random.Random(9)
    hosts = [f"h{i}.d{i % 5}.{'org' if i % 3 else 'com'}" for i in range(40)]
    rows = [(rng.choice(hosts), rng.choice([0, 1, None]) if i % 4 else int(i % 8 == 0)) for i in range(900)] + [("new.d1.org", None)]
    frame = spark.createDataFrame(rows, "host string, bad int")
    got = {r.host: r for r in url_filter.host_reputation(frame).collect()}
    level = {"s": lambda h: h.split(".")[-1], "d": lambda h: ".".join(h.split(".")[-2:]), "h": lambda h: h}
    counts = {name: {} for name in level}
    for host, bad in rows:
        for name, key in level.items():
            c = counts[name].setdefault(key(host), [0, 0])
            if bad is not None:
                c[0] += bad
                c[1] += 1
    strength = {n: beta_prior(spark.createDataFrame([(*c,) for c in counts[n].values()], "bad long, n long"), "bad", "n") for n in level}
    for host, row in got.items():
        rate = strength["s"][0] / sum(strength["s"])
        for name in "sdh":
            bad, n = counts[name][level[name](host)]
            p, q = bad + rate * sum(strength[name]), n - bad + (1 - rate) * sum(strength[name])
            rate = p / (p + q)
        assert row.rate == pytest.approx(rate) and row.deviation == pytest.approx(math.sqrt(p * q / ((p + q) ** 2 * (p + q + 1))))


def test_hundreds_of_languages(spark, make_docs):
    """More languages than the table has whole rows for: fewer buckets each, and still the right answers."""
    rng = random.Random(8)
    words = {f"l{i:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for i in range(300)}
    docs = make_docs([(i, " ".join(rng.choice(words[lang]) for _ in range(60)), lang, "s", 0, "", "", "") for i, lang in enumerate(words)])
    languages, model = language_id.text_model(language_id.trigram_counts(docs))
    assert len(languages) == 300 and model.shape == (300, 8192)
    rows = [(i, f"http://h{i}.net/", f"<p>{' '.join(rng.choice(words[lang]) for _ in range(30))}", "", "", "") for i, lang in enumerate(list(words)[:40])]
    got = {r.page_id: r.lang for r in language_id.identify(spark.createDataFrame(rows, PAGES), docs).collect()}
    assert sum(got[i] == lang for i, lang in enumerate(list(words)[:40])) >= 38
