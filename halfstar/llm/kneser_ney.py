"""Quality by perplexity: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Documents are dealt into blocks of bounded size by a hash. Each block counts its
trusted documents' n-grams and lists all its n-grams; the lists are joined with
the counts, shard by shard, and every block gets back the probabilities of its
own n-grams only. So neither a document nor the model is ever in one place, and
what is moved grows with the text. Texts and lists travel packed and compressed.

Characters below PLAIN are a symbol each, and all others are two, the page of 512
characters that holds them and the place on it, so that no two characters are alike
to the model in any script.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halfstar.llm.common import hot_keys, null_key, salted_join, text_of
from halfstar.sources.writers import materialise

ORDER, BITS = 5, 12
ALPHABET = 1 << BITS  # 0 begins a text, 1 ends it
PLAIN = 1_400  # Latin, Greek, Cyrillic and Armenian letters are below
PAGE, PAGES = 512, 0x110000 // 512
BLOCK_CHARS = 16_000_000
LEAST_BLOCKS = 16
SLICE_CHARS = 500_000
FOLDS = 5  # one in FOLDS trusted documents isn't trained on, but sets the thresholds


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    wide = code >= PLAIN
    if not wide.any():
        return code + 2
    at = np.arange(len(code)) + np.cumsum(wide) - wide
    out = np.empty(len(code) + wide.sum(), np.int64)
    out[at] = np.where(wide, PLAIN + 2 + code // PAGE, code + 2)
    out[at[wide] + 1] = PLAIN + 2 + PAGES + code[wide] % PAGE
    return out


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-grams of all texts, the text that each is from): one for every character and one for the end."""
    pad = ORDER - 1
    parts, sizes = [], []
    for text in texts:
        s = symbols(text)
        parts += [np.zeros(pad, np.int64), s, np.ones(1, np.int64)]
        sizes.append(len(s) + 1)
    line = np.concatenate(parts)
    gram = line[pad:].copy()
    for j in range(1, ORDER):
        gram |= line[pad - j : len(line) - j] << (BITS * j)
    starts = np.cumsum(np.array(sizes) + pad) - np.array(sizes) - pad
    inside = np.ones(len(line), bool)
    for j in range(pad):
        inside[starts + j] = False
    return gram[inside[pad:]], np.repeat(np.arange(len(texts)), sizes)


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first, texts) of runs with about SLICE_CHARS characters; a longer text is alone."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE_CHARS:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, texts[first:]


def pack(docs: DataFrame, blocks: int) -> DataFrame:
    """(``_block``, ``_packed``) of documents (``_id``, ``_key``, ``_lang``, ``_text``): those of an Arrow batch that share a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = []
            for block, part in batch.groupby("_block"):
                held = tuple(part[c].tolist() for c in ("_id", "_key", "_lang", "_text"))
                rows.append((block, press.compress(pickle.dumps(held, protocol=5))))
            yield pd.DataFrame(rows, columns=["_block", "_packed"])

    # Ids travel as text: a column with nulls would otherwise become floats.
    held = docs.select(F.col("_id").cast("string").alias("_id"), "_key", "_lang", "_text", _block("_id", "_key", blocks).alias("_block"))
    return held.mapInPandas(run, "_block int, _packed binary")


def _block(id_col: str, key: str | None, blocks: int) -> Column:
    by_id = F.xxhash64(F.col(id_col))
    return F.pmod(by_id if key is None else F.when(F.col(id_col).isNull(), F.col(key)).otherwise(by_id), F.lit(blocks)).cast("int")


def _unpacked(packed: pd.DataFrame) -> Iterator[tuple[list, list, list, list[str]]]:
    press = zstandard.ZstdDecompressor()
    for blob in packed["_packed"]:
        yield pickle.loads(press.decompress(blob))


def _press(grams: np.ndarray, values: np.ndarray) -> bytes:
    """A sorted list of n-grams with a value each, as bytes: differences compress well."""
    steps = np.diff(grams, prepend=np.int64(0))
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps((steps, values), protocol=5))


def _pressed(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, values = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
    return np.cumsum(steps), values


LISTS = "_block int, _shard int, _list binary"


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of lists of (n-grams, counts), with their counts added up: one sort of all."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, counts = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.nonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))[0] if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


class _Sums:
    """Lists of n-grams added up as they come; what is held is put together once it has doubled."""

    def __init__(self):
        self.parts, self.size, self.known = [], 0, 0

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((grams, counts))
        self.size += len(grams)
        if self.size > 2 * self.known + 2_000_000:
            self.parts = [_merged(self.parts)]
            self.size = self.known = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return _merged(self.parts)


def _count(packed: pd.DataFrame, trusted: pd.DataFrame, shards: int) -> pd.DataFrame:
    """The block's n-grams, each with its number in trusted documents: a list per shard that has any."""
    if not len(packed):
        return pd.DataFrame({"_block": [], "_shard": [], "_list": []}).astype({"_block": "int32", "_shard": "int32"})
    known, found = set(trusted["_id"]), _Sums()
    for ids, _, _, texts in _unpacked(packed):
        train = np.array([i in known for i in ids])
        for first, part in _slices(texts):
            gram, owner = text_grams(part)
            codes, names = pd.factorize(gram)
            counts = np.bincount(codes, weights=train[first : first + len(part)][owner], minlength=len(names))
            found.add(names, counts.astype(np.int64))
    grams, counts = found.total()
    # One sort by shard cuts the list; within a shard the n-grams stay in order.
    shard = grams % shards
    order = np.argsort(shard, kind="stable")
    edges = np.concatenate([np.nonzero(np.diff(shard[order], prepend=-1))[0], [len(order)]])
    block = packed["_block"].iloc[0]
    rows = [(block, int(shard[order[a]]), _press(grams[order[a:b]], counts[order[a:b]])) for a, b in zip(edges[:-1], edges[1:])]
    return pd.DataFrame(rows, columns=["_block", "_shard", "_list"])


def _add_up(lists: pd.DataFrame) -> pd.DataFrame:
    """The counts of one shard's n-grams over all blocks."""
    found = _Sums()
    for blob in lists["_list"]:
        found.add(*_pressed(blob))
    grams, counts = found.total()
    return pd.DataFrame({"g": grams, "c": counts})


def _look_up(lists: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """The lists of one shard with bits instead of counts."""
    model = model.sort_values("g")
    grams, bits = model["g"].to_numpy(), model["bits"].to_numpy().astype(np.float32)
    rows = []
    for block, blob in zip(lists["_block"], lists["_list"]):
        asked, _ = _pressed(blob)
        rows.append((block, 0, _press(asked, bits[np.searchsorted(grams, asked)])))
    return pd.DataFrame(rows, columns=["_block", "_shard", "_list"])


def _score(packed: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """Of the block's documents: bits under the model, and the number of symbols."""
    parts = [_pressed(blob) for blob in model["_list"]]
    grams = np.concatenate([g for g, _ in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(grams)
    grams, bits = grams[order], (np.concatenate([b for _, b in parts])[order].astype(np.float64) if parts else np.zeros(0))
    rows: list[pd.DataFrame] = []
    for ids, keys, langs, texts in _unpacked(packed):
        for first, part in _slices(texts):
            gram, owner = text_grams(part)
            codes, names = pd.factorize(gram)
            each = bits[np.searchsorted(grams, names)][codes]
            to = first + len(part)
            rows.append(pd.DataFrame({
                "_id": ids[first:to], "_key": keys[first:to], "_lang": langs[first:to],
                "bits": np.bincount(owner, each, len(part)), "n_symbols": np.bincount(owner, minlength=len(part)),
            }, ))
    columns = ["_id", "_key", "_lang", "bits", "n_symbols"]
    return pd.concat(rows)[columns] if rows else pd.DataFrame(columns=columns)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts of 1, 2 and 3 or more, from the numbers of n-grams that occur 1, 2, 3 and 4 times.

    Where too few n-grams tell, half of each count's range is taken.
    """
    if not n[0] or not n[1]:
        return 0.5, 0.75, 1.0
    y = n[0] / (n[0] + 2 * n[1])
    raw = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.0)
    return tuple(min(max(d, 0.05), limit - 0.05) for d, limit in zip(raw, (1, 2, 3)))


def _taken_off(c: str, d: tuple[float, float, float]) -> Column:
    return F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2])


def gram_bits(counts: DataFrame) -> DataFrame:
    """(g, bits): -log2 of the probability of every n-gram of ``counts`` (g, c); c may be 0 for n-grams only asked about.

    Lower orders count in how many contexts an n-gram occurs. Each order is one
    window over its contexts (at most ALPHABET n-grams each) and one join with the
    order below. The orders are written to the scratch folder, one small job each.
    """
    levels = [materialise(counts, "grams")]
    for k in range(ORDER - 1, 0, -1):
        low = F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1))
        levels.append(materialise(levels[-1].groupBy(low.alias("g")).agg(F.count_if(F.col("c") > 0).alias("c")), "grams"))
    below: DataFrame | None = None
    for level in reversed(levels):
        facts = level.agg(F.sum("c").alias("total"), *[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count_if(F.col("c") > 2).alias("more")).first()
        d = discounts([facts[f"n{i}"] for i in (1, 2, 3, 4)])
        if below is None:
            total = facts["total"] or 0
            left = sum(x * n for x, n in zip(d, (facts["n1"], facts["n2"], facts["more"])))
            p = (F.col("c") - _taken_off("c", d) + left / ALPHABET) / total if total else F.lit(1 / ALPHABET)
            below = level.select("g", p.alias("p"))
            k = 1
            continue
        k += 1
        context = Window.partitionBy("h")
        rows = level.withColumn("h", F.shiftright("g", BITS)).withColumn("s", F.col("g").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)))
        rows = rows.withColumn("total", F.sum("c").over(context)).withColumn("left", F.sum(_taken_off("c", d)).over(context))
        rows = rows.join(below.select(F.col("g").alias("s"), F.col("p").alias("q")), "s")
        p = F.when(F.col("total") > 0, (F.col("c") - _taken_off("c", d) + F.col("left") * F.col("q")) / F.col("total")).otherwise(F.col("q"))
        below = materialise(rows.select("g", p.alias("p")), "probabilities")
    return below.select("g", (-F.log2("p")).alias("bits"))


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(_id, _key, _lang, bits, n_symbols) of every row of ``docs``; ``trusted`` (_id) names the documents to train on."""
    held = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_key"), F.col(lang_col).alias("_lang"), text_of(text_col).alias("_text")
    )
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-chars // BLOCK_CHARS))
    names = trusted.select(F.col("_id").cast("string").alias("_id"), _block("_id", None, blocks).alias("_block"))
    # A list per block and shard that has any n-gram, so no more lists than n-grams. Odd, so
    # that all symbols of an n-gram have a part in its remainder.
    shards = max(LEAST_BLOCKS, blocks // 4) | 1
    counted = pack(held, blocks).groupBy("_block").cogroup(names.groupBy("_block"))
    lists = materialise(counted.applyInPandas(lambda packed, known: _count(packed, known, shards), LISTS), "block-grams")
    bits = gram_bits(lists.groupBy("_shard").applyInPandas(_add_up, "g long, c long"))
    bits = bits.withColumn("_shard", (F.col("g") % shards).cast("int"))
    answers = lists.groupBy("_shard").cogroup(bits.groupBy("_shard")).applyInPandas(_look_up, LISTS)
    schema = "_id string, _key long, _lang string, bits double, n_symbols long"
    scored = pack(held, blocks).groupBy("_block").cogroup(answers.groupBy("_block")).applyInPandas(_score, schema)
    return scored.withColumn("_id", F.col("_id").cast(dict(docs.dtypes)[id_col]))


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    quantile: float = 0.99, slack: float = 1.0, prior_symbols: float = 200.0, least: int = 50,
) -> DataFrame:
    """One row per row of ``docs``: id, _key (hash of the text), lang, n_symbols, cross_entropy, threshold, kept.

    ``labels`` has the id and ``quality`` (1: trusted). Four in FOLDS trusted documents
    train the model; the others set a threshold per language: their ``quantile`` plus
    ``slack`` times its distance to their median, 0 for the quantile alone. Languages with under ``least`` of
    them take the thresholds of all languages together. The cross entropy, in bits a
    symbol, counts ``prior_symbols`` symbols at the language's median on top of the
    text's own, so that a few words alone decide nothing. Without trusted documents
    every document is kept. A null text is empty; a null language is one of its own.
    """
    fold = F.pmod(F.xxhash64("_id"), F.lit(FOLDS))
    trusted = labels.where("quality = 1").select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    rows = materialise(perplexities(docs, trusted.where(fold != 0), id_col, text_col, lang_col), "perplexities")
    own = rows.withColumns({"_lang_key": null_key("_lang"), "_raw": F.col("bits") / F.col("n_symbols")})
    held_out = own.join(trusted.where(fold == 0), "_id")
    middle = lambda df: df.agg(F.percentile_approx("_raw", 0.5, 10_000).alias("_median"), F.count(F.lit(1)).alias("_n"))
    per_lang = own.groupBy("_lang_key").agg(F.count(F.lit(1)).alias("_docs"))
    medians = middle(held_out.groupBy("_lang_key")).where(F.col("_n") >= least)
    overall = middle(held_out).first()["_median"]
    medians = per_lang.join(medians, "_lang_key", "left").withColumn("_median", F.coalesce("_median", F.lit(overall)))
    medians = materialise(medians.select("_lang_key", "_docs", "_median", F.coalesce("_n", F.lit(0)).alias("_n")), "medians")
    hot = hot_keys(medians, "_lang_key", "_docs")
    steady = (F.col("bits") + prior_symbols * F.col("_median")) / (F.col("n_symbols") + prior_symbols)
    own = salted_join(own, medians, "_lang_key", hot, F.col("_id")).withColumn("_steady", steady)
    held_out = own.join(trusted.where(fold == 0), "_id")
    high = lambda df: df.agg(F.percentile_approx("_steady", quantile, 10_000).alias("_high"))
    every = high(held_out).first()["_high"]
    highs = high(held_out.where(F.col("_n") >= least).groupBy("_lang_key"))
    cut = F.col("_high") + slack * (F.col("_high") - F.col("_median"))
    cuts = medians.join(highs, "_lang_key", "left").withColumn("_high", F.coalesce("_high", F.lit(every)))
    cuts = materialise(cuts.select("_lang_key", cut.alias("threshold")), "thresholds")
    met = salted_join(own, cuts, "_lang_key", hot, F.col("_id"))
    return met.select(
        F.col("_id").alias(id_col), "_key", F.col("_lang").alias(lang_col), "n_symbols",
        F.round("_steady", 6).alias("cross_entropy"), F.round("threshold", 6).alias("threshold"),
        F.coalesce(F.col("_steady") <= F.col("threshold"), F.lit(True)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns kept. Verdicts meet texts in one shuffle."""
    verdicts = quality(docs, labels, id_col, text_col, **settings).where("not kept").select(F.col(id_col).alias("_rejected"), "_key")
    held = docs.select(F.struct("*").alias("_doc"))
    same = held[f"_doc.`{id_col}`"].eqNullSafe(F.col("_rejected"))
    key = F.xxhash64(F.coalesce(F.col(f"_doc.`{text_col}`"), F.lit("")))
    held = held.withColumn("_own", key)
    return held.join(verdicts.distinct(), same & (F.col("_own") == F.col("_key")), "left_anti").select("_doc.*")
