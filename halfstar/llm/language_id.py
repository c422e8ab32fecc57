"""Language of web pages by Bayesian fusion of evidence.

Three kinds of evidence are added up as logarithms: how likely the visible text is
in each language (character trigrams), the language its markup declares, and what
the other pages of its host are written in. How far a declaration can be trusted is
counted over all pages; a host's languages are shrunk to those of its domain, these
to those of the address suffix, and these to the whole table's. A page's own text
is left out of every count that it is judged by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfstar.llm.common import hot_keys, null_key, salted_join, text_of
from halfstar.llm.url_filter import domain_of, suffix_of, url_host
from halfstar.sources.writers import materialise

BUCKETS = 1 << 14  # trigrams are hashed to so many
LANGUAGES = 256  # of more, a language has fewer buckets, so that the table keeps its size
TEMPER = 0.2  # neighbouring trigrams say much the same, so each counts for less than one observation
HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]{1,8};", re.S | re.I)
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})", re.I)


def visible(html: str) -> str:
    return HIDDEN.sub(" ", html)


def trigrams(text: str) -> np.ndarray:
    """Bucket of each character trigram; digits are one character and runs of white space are one space."""
    code = np.frombuffer(" ".join(re.sub(r"\d", "0", text.lower()).split()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(code) < 3:
        return np.zeros(0, np.int64)
    mixed = (code[:-2] * np.uint64(0x9E3779B1) + code[1:-1]) * np.uint64(0x85EBCA77) + code[2:]
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(50)).astype(np.int64)


def trigram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all documents with a language; batches are summed before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(batch["_lang"], batch["_text"]):
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                found = trigrams(text)
                if len(found) > BUCKETS // 8:
                    own += np.bincount(found, minlength=BUCKETS)
                else:
                    np.add.at(own, found, 1)
            for lang, own in sums.items():
                at = np.flatnonzero(own)
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": own[at]})

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("_lang"), text_of(text_col).alias("_text"))
    return rows.mapInPandas(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def text_model(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities: languages x buckets): LANGUAGES * BUCKETS numbers at most, up to 65,536 languages.

    Of more than LANGUAGES languages each has a smaller power of two of buckets, 64 at least.
    """
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    buckets = max(64, min(BUCKETS, LANGUAGES * BUCKETS >> max(0, len(languages) - 1).bit_length()))
    table = np.full((len(languages), buckets), 0.5)
    place = {lang: i for i, lang in enumerate(languages)}
    folded = counts.groupBy("lang", (F.col("bucket") % buckets).alias("bucket")).agg(F.sum("n").alias("n"))
    for row in folded.toLocalIterator():
        table[place[row["lang"]], row["bucket"]] = 0.5 + row["n"]
    return languages, np.log(table / table.sum(axis=1, keepdims=True))


def score_pages(pages: DataFrame, languages: list[str], model: np.ndarray, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(_id, host, declared, likelihood: array by language, best: its place or null, n): one pass, no shuffle."""
    kind = dict(pages.dtypes)[id_col]
    small = model.astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, host, html in zip(batch["_id"], batch["host"], batch["_html"]):
                found = trigrams(visible(html)) % small.shape[1]
                score = small[:, found].sum(axis=1, dtype=np.float64) * TEMPER
                said = DECLARED.search(html)
                best = int(score.argmax()) if len(found) and len(languages) else None
                rows.append((i, host, said[1].lower() if said else None, (score - score.max()).tolist() if len(score) else [], best, len(found)))
            out = pd.DataFrame(rows, columns=["_id", "host", "declared", "likelihood", "best", "n"])
            yield out.astype({"best": "Int64"})

    held = pages.select(F.col(id_col).alias("_id"), url_host(F.col(url_col)).alias("host"), text_of(html_col).alias("_html"))
    return held.mapInPandas(run, f"_id {kind}, host string, declared string, likelihood array<double>, best int, n int")


def _as_array(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``counts`` (keys, best, n) as one row per key: ``counts`` in the languages' order, and ``rows``. At most k + 1 counts a key."""
    held = F.map_from_entries(F.collect_list(F.when(F.col("best").isNotNull(), F.struct("best", F.col("n").cast("double")))))
    found = counts.groupBy(*keys).agg(held.alias("_held"), F.sum("n").alias("rows"))
    every = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("_held", i), F.lit(0.0)))
    return found.select(*keys, every.alias("counts"), "rows")


def _by_language(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rows per key by the language of their text, as an array in the languages' order, and their number."""
    return _as_array(rows.groupBy(*keys, "best").agg(F.count(F.lit(1)).alias("n")), keys, k)


def _shrink(counts: Column, parent: Column, strength: float) -> Column:
    """The language shares of ``counts`` with ``strength`` rows of the parent's shares added."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + strength
    return F.zip_with(counts, parent, lambda n, p: (n + p * strength) / total)


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(
    pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", strength: float = 5.0,
) -> DataFrame:
    """One row per row of ``pages``: id, host, declared, text_lang, lang, confidence.

    The trigrams of all ``docs`` with a language (``text``, ``lang``) give the text
    likelihoods. ``strength`` is the number of pages that each level's parent counts for. A page without visible
    text has a null ``text_lang`` and is decided by the other evidence; a null url has
    the empty host, null html is empty. Without any document that has a language,
    ``lang`` and ``confidence`` are null. Ties go to the first language by code point.
    Scores (no texts) are written to the scratch folder; hosts are joined salted.
    """
    languages, model = text_model(materialise(trigram_counts(docs), "trigrams"))
    k = len(languages)
    rows = materialise(score_pages(pages, languages, model, id_col, url_col, html_col), "page-scores")
    if not k:
        none = F.lit(None).cast("string")
        return rows.select(F.col("_id").alias(id_col), "host", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"))
    rows = rows.withColumns({"_said": null_key("declared"), "_suffix": suffix_of(F.col("host"))})
    hosts = materialise(_by_language(rows, ["host"], k), "host-languages")
    hosts = hosts.withColumns({"_domain": domain_of(F.col("host")), "_suffix": suffix_of(F.col("host"))})
    # What pages without text add to the rows of a level matters to joins only.
    def up(*keys: str) -> DataFrame:
        each = hosts.select(*keys, F.posexplode("counts").alias("best", "n")).groupBy(*keys, "best").agg(F.sum("n").alias("n"))
        return _as_array(each, list(keys), k)

    domains, suffixes = up("_domain", "_suffix"), up("_suffix")
    overall = [r["n"] for r in hosts.select(F.posexplode("counts").alias("best", "n")).groupBy("best").agg(F.sum("n").alias("n")).orderBy("best").collect()]
    overall = overall or [0.0] * k
    domains = salted_join(
        domains, suffixes.select("_suffix", F.col("counts").alias("_of_suffix")), "_suffix", hot_keys(suffixes, "_suffix", "rows"), F.col("_domain")
    )
    domains = domains.select("_domain", F.col("counts").alias("_of_domain"), "_of_suffix", "rows")
    hosts = salted_join(hosts, domains.drop("rows"), "_domain", hot_keys(domains, "_domain", "rows"), F.col("host"))
    hosts = materialise(hosts.select("host", F.col("counts").alias("_of_host"), "_of_domain", "_of_suffix", "rows"), "host-shares")
    said = materialise(_by_language(rows, ["_said"], k), "declarations")
    met = salted_join(rows, said.select("_said", F.col("counts").alias("_of_said"), F.col("rows").alias("_said_rows")), "_said", hot_keys(said, "_said", "rows"), F.col("_id"))
    met = salted_join(met, hosts.drop("rows"), "host", hot_keys(hosts, "host", "rows"), F.col("_id"))
    # Every count without the page's own text.
    own = F.coalesce(F.col("best"), F.lit(-1))
    others = lambda counts: F.transform(counts, lambda n, i: n - (i == own).cast("double"))
    everywhere = others(F.array(*map(F.lit, overall)))
    n_all = F.lit(sum(overall)) - F.col("best").isNotNull().cast("double")
    prior = F.transform(everywhere, lambda n: (n + 1) / (n_all + k))
    for level in ("_of_suffix", "_of_domain", "_of_host"):
        prior = _shrink(others(F.col(level)), prior, strength)
    # How often pages of each language declare the value, with the value's share of all pages added.
    n_rows = sum(overall) or 1.0
    share = strength * (F.col("_said_rows") + 1) / (n_rows + 1)
    declared = F.zip_with(others(F.col("_of_said")), everywhere, lambda n, m: F.log((n + share) / (m + strength)))
    fused = _add(_add(F.col("likelihood"), F.transform(prior, lambda p: F.log(p))), declared)
    met = met.withColumn("_fused", fused).withColumn("_most", F.array_max("_fused"))
    weight = F.aggregate("_fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_most")))
    names = F.array(*map(F.lit, languages))
    # element_at() of a constant array takes a null place for its first or last one, so nulls are kept away from it.
    name = lambda place: F.when(place.isNotNull(), F.element_at(names, F.coalesce(place, F.lit(1)).cast("int")))
    return met.select(
        F.col("_id").alias(id_col), "host", "declared", name(F.col("best") + 1).alias("text_lang"),
        name(F.array_position("_fused", F.col("_most"))).alias("lang"), F.round(1 / weight, 6).alias("confidence"),
    )
