"""Personal data in texts: fixed patterns, and a semi-Markov model for what they miss.

The patterns' matches label the model's training regions; the model then reads
every stretch with digits or an at sign whole and adds the spans that it finds between
the patterns' own. It so learns how such data look and what stands around them,
and finds variants in other notation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halfstar.llm.common import text_of
from halfstar.llm.semi_crf import SemiCrf, lattice, luhn

# Kinds in their order, and the patterns of their matches. Each is
# written so that no text makes it go back over a run of characters twice.
KINDS = ("email", "ip", "card", "phone")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MARK = re.compile(r"[0-9@]")

REGION_GAP, REGION_SIDE = 24, 32  # characters
REGION_MOST = 480


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, leftmost and without overlap per kind; by kind, then start."""
    found: list[tuple[str, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
            done = domain.end()
        # Without a domain, no shorter name before this sign matches either.
        at = text.find("@", max(at + 1, done))
    if not MARK.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def regions(text: str) -> list[tuple[int, int]]:
    """Pieces of the text around digits and at signs, each at most REGION_MOST characters long."""
    found: list[list[int]] = []
    for m in MARK.finditer(text):
        a, b = max(0, m.start() - REGION_SIDE), min(len(text), m.end() + REGION_SIDE)
        if found and a <= found[-1][1] + REGION_GAP and b - found[-1][0] <= REGION_MOST:
            found[-1][1] = b
        else:
            found.append([max(a, found[-1][1]) if found else a, b])
    # Begin and end between words, where there is such a place.
    cut = []
    for a, b in found:
        while a and a < b and text[a - 1].isalnum() and text[a].isalpha():
            a += 1
        cut.append((a, b))
    return [(a, b) for a, b in cut if b > a]


def stretches(text: str) -> list[tuple[int, int]]:
    """All of the text around digits and at signs, however long, from word end to word end; no two touch."""
    found: list[list[int]] = []
    for m in MARK.finditer(text):
        a, b = max(0, m.start() - REGION_SIDE), min(len(text), m.end() + REGION_SIDE)
        if found and a <= found[-1][1] + REGION_GAP:
            found[-1][1] = b
        else:
            found.append([a, b])
    whole: list[tuple[int, int]] = []
    for a, b in found:
        least = whole[-1][1] if whole else 0
        while least < a and text[a - 1].isalnum() and text[a].isalnum():
            a -= 1
        b = max(b, least)
        while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
            b += 1
        if whole and a <= least:
            whole[-1] = (whole[-1][0], b)
        else:
            whole.append((a, b))
    return whole


def train(samples: list[str], epochs: int = 5) -> SemiCrf:
    """Fit the model on regions of text, labelled by the patterns."""
    model = SemiCrf(["", *KINDS])
    data = []
    for text in samples:
        x = lattice(text)
        token = {int(o): i for i, o in enumerate(x.offsets)}
        spans, last = [], -1
        for kind, a, b in sorted(base_spans(text), key=lambda s: (s[1], -s[2])):
            if a < last or a not in token or b not in token:
                continue
            segment = (token[a], token[b], KINDS.index(kind) + 1)
            if segment[:2] in set(zip(x.start.tolist(), x.end.tolist())):
                spans.append(segment)
                last = b
        data.append((x, spans))
    model.fit(data, epochs)
    return model


def find(text: str, model: SemiCrf) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(the patterns' spans, the spans that the model adds where the patterns have none)."""
    base = base_spans(text)
    added = []
    taken = bytearray(len(text))
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)
    for a, b in stretches(text):
        for i, j, kind in model.best_of(text[a:b]):
            if taken.find(1, a + i, a + j) < 0:
                added.append((kind, a + i, a + j))
    return base, added


def sample_regions(docs: DataFrame, most: int, id_col: str, text_col: str) -> list[str]:
    """At most ``most`` regions for training: those of smallest hash, so that any row can be among them."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"region": [t[a:b] for t in batch["_text"] for a, b in regions(t)]}, dtype=object)

    rows = docs.select(text_of(text_col).alias("_text")).where(F.col("_text").rlike("[0-9@]"))
    found = rows.mapInPandas(cut, "region string").distinct()
    chosen = found.withColumn("_h", F.xxhash64("region")).orderBy("_h", "region").limit(most).collect()
    return [r[0] for r in chosen]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training_regions: int = 400) -> DataFrame:
    """One row per row of ``docs``: id, ``base`` and ``added``, arrays of (kind, start, end) in code points, end exclusive.

    A null text is the empty text and has no spans. The model is fitted on the
    driver on at most ``training_regions`` regions, which all texts can give; with
    none it adds nothing. Every text is then read whole, in one pass without a
    shuffle; a task holds one text's spans at a time.
    """
    model = train(sample_regions(docs, training_regions, id_col, text_col))
    span = "array<struct<kind:string,start:int,end:int>>"
    kind_of = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [find(t, model) for t in batch["_text"]]
            yield pd.DataFrame({
                "_id": batch["_id"],
                "base": [[dict(zip(("kind", "start", "end"), s)) for s in b] for b, _ in found],
                "added": [[dict(zip(("kind", "start", "end"), s)) for s in a] for _, a in found],
            })

    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    return rows.mapInPandas(run, f"_id {kind_of}, base {span}, added {span}").withColumnRenamed("_id", id_col)
