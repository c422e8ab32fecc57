"""Quality rules per document, and verdicts per host from their failures.

A document's own rules need its text alone. The failures of all rules are then
counted by host; the counts set a beta prior, each host's failure rate is shrunk
towards it, and a host whose rate is high beyond doubt takes its documents along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halfstar.llm.common import beta_prior, hot_keys, null_key, salted_join
from halfstar.sources.writers import materialise

WINDOW = 8
# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_NO_SYMBOLS = str.maketrans("", "", SYMBOLS)
_ODD = np.array([pow(0x9E3779B97F4A7C15, j, 2**64) for j in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur twice or more, the first occurrence included.

    Windows meet by a 64-bit hash, and each that meets another is compared with it word by word.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    window = word[:n] * _ODD[0]
    for j in range(1, WINDOW):
        window = window + word[j : j + n] * _ODD[j]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    a, b = order[:-1][same], order[1:][same]
    twice[a] = twice[b] = True
    for j in range(WINDOW):
        if not all(words[p] == words[q] for p, q in zip((a + j).tolist(), (b + j).tolist())):
            return _repeated_exactly(words)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def _repeated_exactly(words: list[bytes]) -> int:
    """The same without hashes, for a text in which two windows share one."""
    places: dict[tuple[bytes, ...], list[int]] = {}
    for i in range(len(words) - WINDOW + 1):
        places.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    return len({i + j for found in places.values() if len(found) > 1 for i in found for j in range(WINDOW)})


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, their characters, symbols, lines that repeat an earlier one, words in repeated windows)."""
    return measure_with_lines(text)[:-1]


def measure_with_lines(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The five measures, and the number of lines with a word."""
    text = text or ""
    words = text.encode("utf-8").split()  # of bytes, split() knows the six white space characters of ASCII only
    white = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    symbols = len(text) - len(text.translate(_NO_SYMBOLS)) if any(map(text.__contains__, SYMBOLS)) else 0
    return len(words), len(text) - white, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = (*MEASURES, "_n_lines")


def measure_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its text replaced by the five measures and the number of lines; one pass, no shuffle."""
    others = [c for c in docs.columns if c != text_col]
    schema = docs.select(*[F.col(f"`{c}`") for c in others], *[F.lit(0).cast("long").alias(m) for m in MEASURED]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measure_with_lines(t.as_py()) for t in batch.column(text_col)], dtype=np.int64).reshape(-1, len(MEASURED))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], *map(pa.array, found.T.copy())], [*others, *MEASURED]
            )

    return docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`")).mapInArrow(run, schema)


def host_verdicts(failures: DataFrame, max_rate: float = 0.5, sureness: float = 2.0) -> DataFrame:
    """Adds ``host_rate`` (posterior mean), ``host_bound`` and ``host_kept`` to one row per host with ``n`` and ``failed``.

    The bound is the posterior mean less ``sureness`` posterior deviations; a host
    goes if it exceeds ``max_rate``. One small job sets the prior.
    """
    a, b = beta_prior(failures, "failed", "n")
    p, q = F.col("failed") + F.lit(a), F.col("n") - F.col("failed") + F.lit(b)
    mean = p / (p + q)
    deviation = F.sqrt(p * q / ((p + q) * (p + q) * (p + q + 1)))
    rows = failures.withColumn("host_rate", mean).withColumn("host_bound", F.greatest(mean - sureness * deviation, F.lit(0.0)))
    return rows.withColumn("host_kept", F.col("host_bound") <= max_rate)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    max_rate: float = 0.5, sureness: float = 2.0,
) -> DataFrame:
    """One row per row of ``docs``: id, the measures, base_failed, host_failed, host_rate, kept.

    ``base_failed``: under 20 words, or over 30% of the words in repeated windows.
    For the host a document also fails with a symbol to ten words' characters, over a
    third of its lines with a word repeated, or words of over 20 characters on average.
    Null hosts are one host, null texts are empty; an empty table gives no rows.
    Measures are written to the scratch folder once; no text is shuffled.
    """
    held = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).alias("_text"))
    n, chars, symbols, dup, repeat, lines = (F.col(m) for m in MEASURED)
    base = (n < 20) | (100 * repeat > 30 * n)
    other = (10 * symbols > chars) | (3 * dup > lines) | (chars > 20 * n)
    rows = measure_documents(held, "_text").withColumns({"base_failed": base, "host_failed": base | other, "_key": null_key("_host")})
    rows = materialise(rows, "measures")
    hosts = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.count_if("host_failed").alias("failed"))
    hosts = materialise(hosts, "hosts")
    hot = hot_keys(hosts, "_key", "n")
    verdicts = host_verdicts(hosts, max_rate, sureness).select("_key", "host_rate", "host_kept")
    met = salted_join(rows, verdicts, "_key", hot, F.col("_id"))
    return met.select(
        F.col("_id").alias(id_col), *MEASURES, "base_failed", "host_failed", "host_rate",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"),
    )
