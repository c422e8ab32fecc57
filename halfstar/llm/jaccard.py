"""Join of similar texts by a MinHash forest, then exact verification.

Texts are sets of shingles of five words; copies (equal words) become one class
first. A class has a label in each of TREES tries: DEPTH minimum hashes, a byte
each, in one number, so that labels in order are a trie and a prefix is a shift.
Classes match where a prefix of their labels does. The search begins with whole
labels and shortens the prefix level by level: after each level the similarities
of the links found so far tell how many links of their kind such prefixes find, and
so the recall; it ends at the target.

A pair belongs to the level of its longest common prefix and there to its first
tree, so it is looked at once. Where its labels agree in too few bytes for the
threshold it goes no further. What is left is verified on the shingles
themselves, and only verified pairs are links.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halfstar.llm.common import hot_keys, salted_join, text_of
from halfstar.llm.components import components
from halfstar.sources.writers import materialise

SHINGLE = 5
TREES, DEPTH = 24, 8
LOWEST = 3  # no shorter prefix is tried
BLOCK_MEMBERS = 1_000  # classes of one prefix that meet in a task
BIN_ROWS = 20_000  # rows of small groups that share a task, about
DEVIATIONS = 4.5  # of the share of equal bytes below the threshold, from which a pair is verified
COLUMNS = 4_096  # shingles counted in one matrix product
_ODD = np.array([pow(0x9E3779B97F4A7C15, j + 1, 2**64) for j in range(SHINGLE)], dtype=np.uint64)
_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(1, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def found_share(similarity: np.ndarray, depth: int) -> np.ndarray:
    """The share of pairs of a similarity that have a common prefix of ``depth`` hashes in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def least_equal(threshold: float) -> float:
    """Equal bytes of two labels' TREES * DEPTH from which a pair is verified; unlike hashes agree in a byte once in 256 times."""
    share = threshold + (1 - threshold) / 256
    n = TREES * DEPTH
    return n * share - DEVIATIONS * float(np.sqrt(n * share * (1 - share)))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a text of fewer words is one shingle, an empty one has none."""
    words = text.encode("utf-8").split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    mixed = h[:n] * _ODD[0]
    for j in range(1, SHINGLE):
        mixed = mixed + h[j : j + n] * _ODD[j]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed)


def minima(found: np.ndarray, hashes: int) -> np.ndarray:
    """The minimum of each hash function over the shingles."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(hashes, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 1024):
        part = low[None, at : at + 1024] * _A[:hashes, None] + _B[:hashes, None]
        np.minimum(least, (part ^ (part >> np.uint32(15))).min(axis=1), out=least)
    return least


def class_of(text: str) -> bytes:
    """128-bit hash of the words."""
    return xxhash.xxh3_128_digest(b" ".join(text.encode("utf-8").split()))


def labels_of(found: np.ndarray) -> np.ndarray:
    """The label of each tree: the low bytes of DEPTH minimum hashes, the first one highest."""
    byte = (minima(found, TREES * DEPTH) & np.uint32(255)).astype(np.uint64).reshape(TREES, DEPTH)
    return (byte << (np.uint64(8) * np.arange(DEPTH - 1, -1, -1, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        classes, labels = [], []
        for text in batch.column("_text").to_pylist():
            found = shingles(text)
            classes.append(class_of(text))
            labels.append(labels_of(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(classes, pa.binary()), pa.array(labels, pa.binary())], names=["_id", "_class", "_labels"])


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``_id``, ``_class``: hash of the words, ``_labels``: those of all trees, null for texts without words). No shuffle."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(_sketch, f"_id {rows.schema['_id'].dataType.simpleString()}, _class binary, _labels binary")


def prefixes(classes: DataFrame, depth: int) -> DataFrame:
    """(_rep, _labels, _tree, _bucket) of every tree's prefix of ``depth`` hashes that several classes have, dealt to tasks by :func:`dealt`."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.frombuffer(b"".join(batch.column("_labels").to_pylist()), np.uint64).reshape(-1, TREES)
            prefix = whole >> np.uint64(8 * (DEPTH - depth))
            keys = (prefix * np.uint64(TREES) + np.arange(TREES, dtype=np.uint64)) * _ODD[0]
            keys = (keys ^ (keys >> np.uint64(29))) * _ODD[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(batch.column("_rep").to_numpy(), TREES)), pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(whole))),
                pa.array(keys.ravel().view(np.int64)),
            ], names=["_rep", "_tree", "_bucket"])

    return classes.select("_rep", "_labels").mapInArrow(explode, "_rep long, _tree int, _bucket long")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of buckets of two or more, with the ``_task`` and the block pair ``_x``, ``_y`` that their ``_block`` meets in.

    A bucket of more than BLOCK_MEMBERS rows is cut into blocks, and every two of
    them meet in a task of their own; small buckets share tasks.
    """
    sizes = materialise(rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "buckets")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    blocks = sizes.select("_bucket", F.ceil(F.col("_n") / BLOCK_MEMBERS).cast("int").alias("_blocks"))
    met = salted_join(rows, blocks, "_bucket", hot_keys(sizes, "_bucket", "_n", total), F.col("_rep"), "inner")
    met = met.withColumn("_block", F.pmod(F.xxhash64("_rep"), F.col("_blocks")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least("_block", o).alias("x"), F.greatest("_block", o).alias("y"))
    )
    met = met.withColumn("_pair", F.explode(pairs))
    bins = max(1, -(-total // BIN_ROWS))
    task = F.when(F.col("_blocks") == 1, F.pmod("_bucket", F.lit(bins))).otherwise(F.xxhash64("_bucket", "_pair"))
    return met.select(*rows.columns, task.alias("_task"), "_block", F.col("_pair.x").alias("_x"), F.col("_pair.y").alias("_y"))


def candidates(rows: pd.DataFrame, depth: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a group, i, j): the pairs of one prefix that belong to it at this depth, and whose labels agree in ``least`` bytes."""
    if len(rows) < 2:
        return
    labels = np.frombuffer(b"".join(rows["_labels"]), np.uint64).reshape(-1, TREES)
    tree, block = rows["_tree"].to_numpy(), rows["_block"].to_numpy()
    across = (rows["_x"] != rows["_y"]).to_numpy()
    shift = np.uint64(8 * (DEPTH - depth))
    prefix = labels >> shift
    codes = rows.assign(_prefix=prefix[np.arange(len(rows)), tree]).groupby(["_tree", "_prefix", "_x", "_y"], sort=False).ngroup().to_numpy()
    order = np.argsort(codes, kind="stable")
    edges = np.concatenate([[0], np.nonzero(np.diff(codes[order]))[0] + 1, [len(codes)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a < 2:
            continue
        group = order[a:b]
        own = labels[group]
        t = int(tree[group[0]])
        mine = np.triu(np.ones((b - a, b - a), bool), 1)
        if across[group[0]]:
            mine &= block[group][:, None] != block[group][None, :]
        for earlier in range(t):  # an earlier tree with this prefix has the pair
            mine &= prefix[group][:, earlier][:, None] != prefix[group][:, earlier][None, :]
        if depth < DEPTH:  # a longer common prefix was found before
            longer = own >> np.uint64(8 * (DEPTH - depth - 1))
            for other in range(TREES):
                mine &= longer[:, other][:, None] != longer[:, other][None, :]
        i, j = np.nonzero(mine)
        bytes_ = own.view(np.uint8)
        for at in range(0, len(i), 100_000):
            x, y = i[at : at + 100_000], j[at : at + 100_000]
            alike = (bytes_[x] == bytes_[y]).sum(axis=1) >= least
            if alike.any():
                yield group, x[alike], y[alike]


def _members(rows: pd.DataFrame, depth: int, least: float) -> pd.DataFrame:
    """(_rep, _labels, _tree, _bucket) of a task's rows that are in a candidate pair."""
    found = [group[np.union1d(i, j)] for group, i, j in candidates(rows, depth, least)]
    place = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return rows.iloc[place][["_rep", "_labels", "_tree", "_bucket"]].drop_duplicates(["_rep", "_bucket"])


def common_shingles(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of shingles that each pair (i, j) of sorted sets shares."""
    if len(i) < 8 * len(sets):
        return np.array([np.intersect1d(sets[a], sets[b], assume_unique=True).size for a, b in zip(i.tolist(), j.tolist())], np.int64)
    return shared_counts(sets)[i, j]


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles every two sets share, by products of 0-1 matrices of bounded width."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    code = np.cumsum(np.concatenate([[True], flat[1:] != flat[:-1]])) - 1
    several = np.bincount(code)[code] > 1  # a shingle of one set only is in no intersection
    owner, code = owner[several], code[several]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    if len(code):
        code = np.unique(code, return_inverse=True)[1]
        edges = np.searchsorted(code, np.arange(0, code[-1] + 1 + COLUMNS, COLUMNS))
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            grid = np.zeros((len(sets), COLUMNS), np.float32)
            grid[owner[a:b], code[a:b] - k * COLUMNS] = 1
            shared += grid @ grid.T
    return np.rint(shared).astype(np.int64)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the links i-j connect, fewer than n."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


_FOUND = "a long, b long, n_links long, expected array<double>"


def _verify(rows: pd.DataFrame, depth: int, least: float, part: Fraction) -> pd.DataFrame:
    """Of a task's classes: (a, a, links, links that exist if those are what prefixes of 1, 2, ... find), and (a, b, 0, null) that connect what its links connect."""
    rows = rows.drop_duplicates(["_rep", "_bucket", "_x", "_y"], ignore_index=True)
    out: list[tuple] = []
    rep = rows["_rep"].to_numpy()
    held = rows["_set"].to_numpy()
    for group, i, j in candidates(rows, depth, least):
        some, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        sets = [np.frombuffer(held[g], np.uint64) for g in group[some]]
        i, j = place[: len(i)], place[len(i) :]
        sizes = np.array([len(s) for s in sets], np.int64)
        both = common_shingles(sets, i, j)
        union = sizes[i] + sizes[j] - both
        alike = both * part.denominator >= part.numerator * union
        i, j, similarity = i[alike], j[alike], both[alike] / union[alike]
        names = rep[group[some]]
        links = np.bincount(i, minlength=len(some)) + np.bincount(j, minlength=len(some))
        shares = [1 / found_share(similarity, d) for d in range(1, DEPTH + 1)]
        total = np.stack([np.bincount(i, x, len(some)) + np.bincount(j, x, len(some)) for x in shares], axis=1)
        out += [(int(r), int(r), int(n), e) for r, n, e in zip(names, links, total) if n]
        out += [(int(names[x]), int(names[y]), 0, None) for x, y in _forest(len(some), i, j)]
    return pd.DataFrame(out, columns=["a", "b", "n_links", "expected"]).astype({"a": "int64", "b": "int64", "n_links": "int64"})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shingles of the texts that are what their class is a hash of; a repeated id can have another text."""
    for batch in batches:
        same = [class_of(t) == bytes(c) for t, c in zip(batch["_text"], batch["_class"])]
        batch = batch[same]
        yield pd.DataFrame({"_rep": batch["_rep"], "_set": [shingles(t).tobytes() for t in batch["_text"]]})


def forest_links(classes: DataFrame, texts: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Verified links of ``classes`` (_rep, _least: an id, _class, _labels) as (a, a, n_links) and connecting (a, b, 0), level by level.

    ``texts`` has (_least, _text). Runs jobs level by level, each of which writes its links.
    """
    part, least, found = Fraction(threshold).limit_denominator(10**6), least_equal(threshold), None
    labelled = classes.where("_labels is not null and _least is not null")
    for depth in range(DEPTH, LOWEST - 1, -1):
        keys = prefixes(labelled, depth)
        shared = dealt(keys).join(labelled.select("_rep", "_labels"), "_rep")
        members = shared.groupBy("_task").applyInPandas(lambda rows: _members(rows, depth, least), "_rep long, _labels binary, _tree int, _bucket long")
        members = materialise(members.dropDuplicates(["_rep", "_bucket"]), "members")
        wanted = members.select("_rep").distinct().join(classes.select("_rep", "_least", "_class"), "_rep")
        sets = wanted.join(texts, "_least").select("_rep", "_class", "_text").mapInPandas(_sets, "_rep long, _set binary")
        held = dealt(members).join(materialise(sets, "sets"), "_rep")
        links = materialise(held.groupBy("_task").applyInPandas(lambda rows: _verify(rows, depth, least, part), _FOUND), "verified")
        # A link of similarity s stands for 1 / share links, the share being what prefixes of this depth find.
        found = links if found is None else found.unionByName(links)
        n, expected = found.agg(F.sum("n_links"), F.sum(F.element_at("expected", depth))).first()
        if not n or n >= recall * expected:
            break
    return found


def similar_classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, copy_id, class_id, n_copies, n_links.

    Rows with equal words (null text: none) have one ``copy_id``, the least id of
    them. ``n_links`` counts the other copy classes whose sets of five-word shingles
    have a Jaccard similarity of ``threshold`` or more; ``class_id`` is the least id
    that such links lead to. A text of under five words is one shingle; a text
    without words has no links. Ids may be of any type that has an order; null ids
    stay null and are in no class of others.

    Every pair at the threshold is found with probability 0.988 at least, and the
    prefix is shortened until the links found are ``recall`` of those expected.
    What is shuffled is labels, and the sets of classes in candidate pairs, once per
    prefix they share with a candidate; a bucket of any size is looked at in blocks of
    BLOCK_MEMBERS, every two of them in a task of its own, and never collected.
    """
    rows = materialise(sketches(docs, id_col, text_col), "sketches")
    classes = rows.groupBy("_class").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("n_copies"), F.max("_labels").alias("_labels"))
    classes = materialise(classes.withColumn("_rep", F.monotonically_increasing_id()), "copy-classes")
    texts = docs.select(F.col(id_col).alias("_least"), text_of(text_col).alias("_text"))
    verified = forest_links(classes, texts, threshold, recall)
    links = verified.where("a = b").groupBy(F.col("a").alias("_rep")).agg(F.sum("n_links").alias("n_links"))
    near = components(verified.where("a != b"), "a", "b").select(F.col("vertex").alias("_rep"), "root")
    facts = classes.drop("_labels").join(links, "_rep", "left").join(near, "_rep", "left").withColumn("root", F.coalesce("root", "_rep"))
    facts = materialise(facts, "class-facts")
    least = facts.groupBy("root").agg(F.min("_least").alias("_first"), F.count(F.lit(1)).alias("_n"))
    least = materialise(least, "components")
    facts = salted_join(facts, least.drop("_n"), "root", hot_keys(least, "root", "_n"), F.col("_rep"), "inner")
    facts = materialise(facts.select("_class", "_least", "_first", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "class-results")
    out = salted_join(rows.select("_id", "_class"), facts, "_class", hot_keys(facts, "_class", "n_copies"), F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.col("_least").alias("copy_id"), F.col("_first").alias("class_id"), "n_copies", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Of each class of similar documents the one with the least id, all columns kept.

    Rows that repeat both id and text count once. Rows without an id stay. Texts
    are shuffled once, to meet the ids that go.
    """
    gone = similar_classes(docs, id_col=id_col, text_col=text_col, **settings).where(F.col("class_id") != F.col(id_col))
    gone = gone.select(F.col(id_col).alias("_gone")).distinct()
    held = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_own"), F.xxhash64(text_of(text_col)).alias("_text_key"))
    left = held.join(gone, F.col("_own") == F.col("_gone"), "left_anti")
    # Rows without an id are no copies of each other, however many there are.
    place = F.row_number().over(Window.partitionBy("_own", "_text_key").orderBy("_own"))
    named = left.where("_own is not null").withColumn("_place", place).where("_place = 1")
    return named.select("_doc").unionByName(left.where("_own is null").select("_doc")).select("_doc.*")
