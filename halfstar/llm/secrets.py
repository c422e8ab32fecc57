"""Secrets in texts: fixed patterns, and sliding-window entropy for what they miss.

Everything is a column expression over one row: no shuffle and no Python. The
entropy of each window of a candidate string comes from the one before by the
counts of two characters, the one that enters and the one that leaves.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfstar.llm.common import text_of

# Kinds in their order, their patterns, and the least length of a match (of its second group for assign).
KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # runs of 16 or more are the same matches as all runs less the short ones
LEAST = {"assign": 12, "access": 18}

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 16
NOISE = 1e-9  # windows can have exactly the bits asked for, and sums of logarithms are not exact
# Least bits a character in the best window, by the candidate's character class. A
# candidate must hold digits and letters: prose and numbers alone are in no class.
CLASSES = (("hex", r"\A[0-9a-fA-F]+\z", 2.8), ("mixed", r"\A[A-Za-z0-9+/_=-]+\z", 3.5))
ALLOWED = (
    r"\A[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z",  # identifiers made to be shown
    r"(?i)example|sample|dummy|placeholder|changeme|x{8}",
    r"(?i)0123456789|123456789|abcdefghij",
)


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of the matches of a pattern that has no empty match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    sizes = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, gap: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        a = state.at + x.gap
        b = a + F.length(x.m)
        return F.struct(b.alias("at"), F.concat(state.out, F.array(F.struct(a.alias("start"), b.alias("end"), x.m.alias("text")))).alias("out"))

    return F.aggregate(sizes, start, step, lambda state: state.out)


def _kind(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(kind).alias("kind")))


def pattern_spans(text: Column) -> Column:
    """Array of (start, end, kind) of the patterns' matches, by kind and start."""
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def where(test: Column, spans: Column) -> Column:
        return F.when(test, spans).otherwise(none)

    value = lambda s: F.length(F.regexp_extract(s.text, r"\A(?:" + ASSIGN + ")", 2))
    assign = F.filter(located(text, ASSIGN), lambda s: value(s) >= LEAST["assign"])
    access = F.filter(located(text, ACCESS), lambda s: F.length(s.text) >= LEAST["access"])
    return F.concat(
        where(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), _kind("assign", assign)),
        where(F.contains(text, F.lit("AKIA")), _kind("access", access)),
        where(text.rlike(HEX), _kind("hex", located(text, HEX))),
    )


def _weight(count: Column) -> Column:
    """count * log2(count) for the counts that a window can hold."""
    values = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 2)]
    return F.element_at(F.array(*map(F.lit, values)), (count + 1).cast("int"))


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


STRETCHES = "array<struct<start:int,end:int>>"


def high_stretches(text: Column, least: Column, allowed: Column) -> Column:
    """Array of (start, end): what the windows with ``least`` bits a character cover, but for those that overlap an allowed span.

    The state holds a count per distinct character and the sum of their weights;
    each step changes at most two counts.
    """
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))

    def coded(c: Column) -> Column:
        return _held(F.array_distinct(c), lambda letters: _held(
            F.transform(c, lambda x: F.array_position(letters, x).cast("int")), lambda codes: _stretches(codes, letters, least, allowed)
        ))

    return _held(chars, coded)


def _stretches(codes: Column, letters: Column, least: Column, allowed: Column) -> Column:
    state = F.struct(
        F.transform(letters, lambda c: F.lit(0)).alias("counts"), F.lit(0.0).alias("sum"), F.array().cast(STRETCHES).alias("done"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )
    steps = F.transform(codes, lambda c, i: F.struct(
        c.alias("enter"), F.when(i >= WINDOW, F.element_at(codes, i - WINDOW + 1)).otherwise(0).alias("leave"), (i + 1).alias("end")
    ))
    closed = lambda s: F.array(F.struct(s.first.alias("start"), s["last"].alias("end")))

    def step(s: Column, x: Column) -> Column:
        entering = F.element_at(s.counts, x.enter)
        leaving = F.element_at(s.counts, F.greatest(x.leave, F.lit(1)))
        moved = x.enter != x.leave
        total = s["sum"] + F.when(moved, _weight(entering + 1) - _weight(entering)).otherwise(0.0)
        total = total + F.when(moved & (x.leave > 0), _weight(leaving - 1) - _weight(leaving)).otherwise(0.0)
        counts = F.transform(s.counts, lambda c, j: c + (j + 1 == x.enter).cast("int") - (j + 1 == x.leave).cast("int"))
        high = (x.end >= WINDOW) & (math.log2(WINDOW) - total / WINDOW >= least - NOISE)
        high = high & ~F.exists(allowed, lambda w: (w.start < x.end) & (x.end - WINDOW < w.end))
        apart = high & (x.end - WINDOW > s["last"])
        return F.struct(
            counts.alias("counts"), total.alias("sum"),
            F.when(apart, F.concat(s.done, closed(s))).otherwise(s.done).alias("done"),
            F.when(high & (s.first.isNull() | apart), x.end - WINDOW).otherwise(s.first).alias("first"),
            F.when(high, x.end).otherwise(s["last"]).alias("last"),
        )

    return F.aggregate(steps, state, step, lambda s: F.when(s.first.isNull(), s.done).otherwise(F.concat(s.done, closed(s))))


def entropy_spans(text: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Array of (start, end, kind ``entropy``) of what windows of high entropy in candidates cover, allowed matches left out."""

    def found(c: Column) -> Column:
        least = F.lit(None).cast("double")
        for _, pattern, bits in reversed(CLASSES):
            least = F.when(c.text.rlike(pattern), F.lit(bits)).otherwise(least)
        spans = F.concat(F.array().cast("array<struct<start:int,end:int,text:string>>"), *[
            F.when(c.text.rlike(p), located(c.text, p)).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>")) for p in allowed
        ])
        high = _held(spans, lambda held: high_stretches(c.text, least, held))
        return F.transform(high, lambda h: F.struct(
            (c.start + h.start).alias("start"), (c.start + h.end).alias("end"), F.lit("entropy").alias("kind")
        ))

    wanted = F.filter(located(text, CANDIDATE), lambda c: c.text.rlike("[0-9]") & c.text.rlike("[A-Za-z]"))
    spans = F.flatten(F.transform(wanted, found))
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>"))


def without(spans: Column, base: Column) -> Column:
    """``spans`` less those of ``base``; what is left of one and holds no window goes."""

    def less(left: Column, b: Column) -> Column:
        parts = F.flatten(F.transform(left, lambda p: F.array(
            F.struct(p.start.alias("start"), F.least(p.end, b.start).alias("end"), p.kind.alias("kind")),
            F.struct(F.greatest(p.start, b.end).alias("start"), p.end.alias("end"), p.kind.alias("kind")),
        )))
        return F.filter(parts, lambda p: p.end - p.start >= WINDOW)

    return F.aggregate(base, spans, less)


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: tuple[str, ...] = ALLOWED,
    entropy: Callable[[Column, tuple[str, ...]], Column] = entropy_spans,
) -> DataFrame:
    """One row per row of ``docs``: id, ``base`` and ``added``, arrays of (start, end, kind) in code points, end exclusive.

    ``base`` are the patterns' matches; ``added`` are stretches of high entropy
    less these matches. A null text is the empty text and has no spans. ``allowed`` are
    patterns of what is no secret: windows that overlap a match aren't counted; the
    patterns' matches stay anyway.
    Whole texts are read in one pass over the table, without a shuffle.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.select("_id", pattern_spans(F.col("_text")).alias("base"), entropy(F.col("_text"), allowed).alias("_high"))
    return rows.select(F.col("_id").alias(id_col), "base", without(F.col("_high"), F.col("base")).alias("added"))
