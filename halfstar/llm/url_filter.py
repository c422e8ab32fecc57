"""Url filters: listed rules, and a reputation of hosts learnt from labelled pages.

Outcomes of labelled pages are counted by host, registered domain and suffix.
Each level's counts set the strength of a beta prior, and each name's rate is
shrunk to that of the name above it: a suffix to all pages, a domain to its
suffix, a host to its domain. A host is blocked if its posterior bound is high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfstar.llm.common import beta_prior, hot_keys, salted_join
from halfstar.sources.writers import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; else empty. A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls. Of rules of one length the first in the list wins.

    ``rules`` holds (verdict, host and path). The list is an argument, so it is part
    of the plan: no join and no shuffle.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    for verdict, rule in reversed(ranked):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found["rule"], found["verdict"]


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _below(level: DataFrame, parents: DataFrame, name: str) -> DataFrame:
    """``level`` with ``_rate``, the posterior mean of the parent that ``name`` names."""
    rates = parents.select(name, (F.col("_p") / (F.col("_p") + F.col("_q"))).alias("_rate"))
    return salted_join(level, rates, name, hot_keys(level.groupBy(name).count(), name, "count"), F.xxhash64(*level.columns))


def _posterior(level: DataFrame, strength: float) -> DataFrame:
    """Adds ``_p`` and ``_q``: bad and good outcomes on top of ``strength`` observations at ``_rate``."""
    good = F.col("n") - F.col("bad") + (1 - F.col("_rate")) * strength
    return level.withColumns({"_p": F.col("bad") + F.col("_rate") * strength, "_q": good})


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """One row per ``host`` of ``outcomes`` (host, bad: 0, 1 or null): n, bad, rate, deviation, pages.

    Hosts are kept even without labelled pages: their rate is that of their domain.
    Three small jobs over counts set the strengths of the priors.
    """
    counts = outcomes.groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"), F.count(F.lit(1)).alias("pages")
    )
    hosts = materialise(counts.withColumns({"_domain": domain_of(F.col("host")), "_suffix": suffix_of(F.col("host"))}), "hosts")
    domains = hosts.groupBy("_domain", "_suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("_suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    a, b = beta_prior(suffixes, "bad", "n")
    suffixes = _posterior(suffixes.withColumn("_rate", F.lit(a / (a + b))), a + b)
    domains = _posterior(_below(domains, suffixes, "_suffix"), sum(beta_prior(domains, "bad", "n")))
    hosts = _posterior(_below(hosts, domains, "_domain"), sum(beta_prior(hosts, "bad", "n")))
    p, q = F.col("_p"), F.col("_q")
    deviation = F.sqrt(p * q / ((p + q) * (p + q) * (p + q + 1)))
    return hosts.select("host", "n", "bad", "pages", (p / (p + q)).alias("rate"), deviation.alias("deviation"))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
    max_rate: float = 0.5, sureness: float = 2.0,
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, host_rate, host_bound.

    ``outcomes`` has ``_row`` and ``bad`` (0 or 1) of labelled pages by their id; a
    page may have none, and of several the mean counts once, rounded. A page that
    no rule fits is blocked if its host's rate, less ``sureness`` posterior
    deviations, exceeds ``max_rate``. A null url, or one without ``://``, has an
    empty host and path, and all such pages share the empty host's reputation.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    named = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    labelled = outcomes.where("bad is not null").groupBy("_row").agg(F.round(F.avg("bad")).cast("int").alias("bad"))
    judged = named.select("_id", "host").join(labelled, F.col("_id") == F.col("_row"), "left").select("host", "bad")
    hosts = materialise(host_reputation(judged), "reputation")
    hot = hot_keys(hosts, "host", "pages")
    verdicts = hosts.select("host", "rate", F.greatest(F.col("rate") - sureness * F.col("deviation"), F.lit(0.0)).alias("_bound"))
    met = salted_join(named, verdicts, "host", hot, F.xxhash64("_id", "path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("_bound") > max_rate, "block").otherwise("allow")
    return met.select(
        F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.round("rate", 6).alias("host_rate"), F.round("_bound", 6).alias("host_bound"),
    )
