"""Phrase collocations, counted on a prefix-free parse.

Pieces of text are cut into chunks at words whose next few words, hashed, trigger
a cut. A chunk runs on over the words of the next trigger, so neighbouring chunks
overlap by one word less than the longest phrase has, and the same passage is
cut the same way wherever it stands. The distinct chunks and how often each
occurs are the dictionary; phrases are counted inside distinct chunks only,
weighted by that number. A phrase belongs to the chunk in which it starts before
the overlap, so what lies in an overlap is counted once. Chunks are kept as the
hashes of their words, which are checked to be distinct.

Phrases grow word by word: chunks are narrowed to the runs in which all phrases of
n words are frequent, and phrases of n + 1 words counted there. Tasks know that from a filter of fixed size, which
can let infrequent phrases through but holds no frequent one back. Before phrases are counted by their words, the
places of a filter are: a phrase whose place isn't reached often enough isn't frequent, and makes no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halfstar.llm.common import hot_keys, salted_join
from halfstar.sources.writers import materialise

LONGEST = 5  # words of a phrase
OVERLAP = LONGEST - 1
# What ends a piece, and what stands between words.
ENDS = b".,;:!?\n\x0b\x0c\r"
END = b"."
PLAIN = bytes.maketrans(bytes(range(65, 91)) + ENDS + b"\t", bytes(range(97, 123)) + END * len(ENDS) + b" ")
TRIGGER = 16  # every so many words a cut, about
LONGEST_CHUNK = 2_000  # words after which a chunk ends without a trigger
TASK_BYTES = 4_000_000  # text that a task holds at a time, about
FILTER_BITS = 27  # the filter has 2^27 bits, 16 MB
PROBES = 4
BLOCKS = 256  # parts of the filter's places, and of all phrases, that are counted apart
_ODD = np.array([pow(0x9E3779B97F4A7C15, j + 1, 2**64) for j in range(LONGEST + 1)], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of two odd numbers and of their inverses modulo 2^64, up to the longest run asked for."""

    BASES = (0xD6E8FEB86659FD93, 0xA3B195354A39B70D)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    @classmethod
    def upto(cls, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if not cls.held or len(cls.held[0][0]) < n:
            line = lambda x: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1 << 22) - 1, x, np.uint64))])
            cls.held = [(line(b), line(pow(b, -1, 2**64))) for b in cls.BASES]
        return cls.held


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run ``start``..``end`` of ``values``, from sums over all that stands before."""
    out = []
    for power, inverse in Powers.upto(len(values)):
        before = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=before[1:])
        out.append(mixed((before[end] - before[start]) * inverse[start] + (end - start).astype(np.uint64)))
    return out[0], out[1]


def grouped(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each run, a run of each group): runs that agree in both hashes. One that agrees in the first only is alone."""
    code, names = pd.factorize(first)
    at = np.empty(len(names), np.int64)
    at[code[::-1]] = np.arange(len(code))[::-1]
    odd = np.nonzero(second != second[at[code]])[0]
    if len(odd):
        code = code.copy()
        code[odd] = len(names) + np.arange(len(odd))
        at = np.concatenate([at, odd])
    return code, at


def gathered(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The runs as an array of bytes."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    data = np.ascontiguousarray(values[place])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((offsets * values.itemsize).astype(np.int32)), pa.py_buffer(data)])


def phrase_hash(words: np.ndarray, at: np.ndarray, n: int, salt: np.ndarray | int = 0) -> np.ndarray:
    """Hash of the n words, given by their hashes, from each place on."""
    total = np.full(len(at), n, np.uint64) + np.asarray(salt, np.uint64) * _ODD[LONGEST]
    for i in range(n):
        total += words[at + i] * _ODD[i]
    return mixed(total)


def cut(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, whether another follows) of the chunks of the pieces ``start``..``end``, all in the order of places."""
    n = len(words)
    piece_end = np.zeros(n, np.int64)
    lengths = end - start
    inside = np.repeat(start, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    piece_end[inside] = np.repeat(end, lengths)
    fits = inside[inside + OVERLAP <= piece_end[inside]]
    trigger = np.zeros(n + 1, bool)
    trigger[fits[phrase_hash(words, fits, OVERLAP) % np.uint64(TRIGGER) == 0]] = True
    trigger[start] = True
    places = np.nonzero(trigger)[0]
    # Too long a chunk is cut every so many words from its trigger on.
    until = np.minimum(np.append(places[1:], n), piece_end[places])
    more = np.maximum((until - places - OVERLAP - 1) // LONGEST_CHUNK, 0)
    if more.any():
        places = np.repeat(places, more + 1) + LONGEST_CHUNK * (np.arange((more + 1).sum()) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1))
    follows = np.append(piece_end[places[:-1]] == piece_end[places[1:]], False)
    ends = np.where(follows, np.append(places[1:], 0) + OVERLAP, piece_end[places])
    return places, np.minimum(ends, piece_end[places]), follows


def words_of(text: bytes, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, second hash, number of the piece) of each word of a text of words, spaces and ENDs."""
    raw = np.frombuffer(END + text + END, np.uint8)
    ends = raw == END[0]
    apart = ends | (raw == 32)
    start, end = (np.flatnonzero(x) + 1 for x in (apart[:-1] & ~apart[1:], ~apart[:-1] & apart[1:]))
    letters = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)
    first, second = run_hashes(letters[raw], start, end)
    return start - 1, end - 1, first, second, np.cumsum(ends)[start]


def slices(text: bytes) -> Iterator[bytes]:
    """The text in slices of some megabytes, cut at ends of pieces only."""
    at, size = 0, TASK_BYTES
    while len(text) - at > size:
        stop = text.find(END, at + size)
        if stop < 0:
            break
        yield text[at:stop]
        at = stop
    yield text[at:] if at else text


def _slices_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, text) of bounded size: the texts of a task, prepared and joined by ENDs."""
    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            if text.is_valid and text.as_buffer().size:
                for part in slices(text.as_buffer().to_pybytes().translate(PLAIN)):
                    held.setdefault(lang, []).append(part)
                    sizes[lang] += len(part) + 1
                    if sizes[lang] > TASK_BYTES:
                        del sizes[lang]
                        yield lang, END.join(held.pop(lang))
        if len(held) > 50:  # a task's languages may be many
            for lang in list(held):
                del sizes[lang]
                yield lang, END.join(held.pop(lang))
    for lang in list(held):
        yield lang, END.join(held.pop(lang))


def salt_of(lang: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8"), seed=seed + 1)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def count_words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """(lang, salt, word, hash, n), equal words of one slice added up."""
    for lang, text in _slices_by_language(batches):
        start, end, line, other, _ = words_of(text, seed)
        code, at = grouped(line, other)
        yield pa.RecordBatch.from_arrays([
            pa.repeat(pa.scalar(lang, pa.string()), len(at)), pa.repeat(pa.scalar(_signed(salt_of(lang, seed)), pa.int64()), len(at)),
            gathered(np.frombuffer(text, np.uint8), start[at], end[at]).cast(pa.string()), pa.array(line[at].view(np.int64)),
            pa.array(np.bincount(code, minlength=len(at)), pa.int64()),
        ], names=["lang", "salt", "word", "hash", "n"])


def vocabulary(texts: DataFrame, seed: int = 0) -> tuple[DataFrame, int]:
    """((lang, salt, word, hash, f), seed): all words of ``texts`` (lang, text) with their 64-bit hashes and numbers.

    If two words, or the salts of two languages, share a hash, all are drawn again with
    the next seed, so hashes stand for words exactly.
    """
    while True:
        this = seed
        rows = texts.mapInArrow(lambda batches: count_words(batches, this), "lang string, salt long, word string, hash long, n long")
        words = materialise(rows.groupBy("lang", "salt", "word", "hash").agg(F.sum("n").alias("f")), "words")
        clash = lambda key, of: words.groupBy(key).agg(F.min(F.xxhash64(of)).alias("a"), F.max(F.xxhash64(of)).alias("b")).where("a != b")
        if clash("hash", "word").isEmpty() and clash("salt", "lang").isEmpty():
            return words, seed
        seed += 1


def parse_text(text: bytes, salt: int, seed: int, bits: np.ndarray | None) -> Runs:
    """The chunks of a text, narrowed to runs of frequent words if ``bits`` are given."""
    _, _, line, _, piece = words_of(text, seed)
    edges = np.concatenate([np.flatnonzero(np.diff(piece, prepend=-1)), [len(piece)]])
    first, last, follows = cut(line, edges[:-1], edges[1:])
    own = last - first - np.where(follows, OVERLAP, 0)
    every = Runs(line, first, last, own, np.ones(len(first), np.int64), np.full(len(first), salt, np.uint64))
    return every if bits is None else every.narrowed(1, bits)


def parse(batches: Iterator[pa.RecordBatch], seed: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(salt, chunk, own, n) of the chunks of a task's texts, equal ones of one slice added up."""
    for lang, text in _slices_by_language(batches):
        yield from parse_text(text, salt_of(lang, seed), seed, bits).rows()


_RUNS = "salt long, chunk binary, own int, n long"


def dictionary(texts: DataFrame, seed: int, bits: np.ndarray | None = None) -> DataFrame:
    """(salt, chunk, own, n): the distinct chunks of each language, as hashes of their words, and how often each occurs.

    Phrases at a chunk's first ``own`` places are its own. With ``bits``, the filter of
    frequent words, chunks are cut to their runs of at least two such words.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bits)
    chunks = texts.mapInArrow(lambda batches: parse(batches, seed, shared.value), _RUNS)
    return chunks.groupBy("salt", "chunk", "own").agg(F.sum("n").alias("n"))


def probes(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th place of each hash in the filter."""
    return (h * _ODD[i]) >> np.uint64(64 - FILTER_BITS)


def frequent_filter(phrases: DataFrame, n: int) -> np.ndarray:
    """Bits of the ``phrases`` (salt, phrase: n hashes): 2^FILTER_BITS bits, whatever their number."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("phrase").flatten().to_numpy().view(np.uint64)
            h = phrase_hash(words, np.arange(batch.num_rows) * n, n, batch.column("salt").to_numpy().view(np.uint64))
            place = np.concatenate([probes(h, i) for i in range(PROBES)])
            word, bit = (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63))
            order = np.argsort(word, kind="stable")
            word, first = np.unique(word[order], return_index=True)
            joined = np.bitwise_or.reduceat(bit[order], first) if len(word) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(joined.view(np.int64), pa.int64())], names=["word", "bits"])

    found = phrases.select("salt", "phrase").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    return _filled(found.column("word").to_numpy(), found.column("bits").to_numpy())


def held_in(bits: np.ndarray, h: np.ndarray, places: int = PROBES) -> np.ndarray:
    """Whether the filter may hold each hash, by its first ``places``."""
    left = np.arange(len(h))
    for i in range(places):  # most go at the first place
        place = probes(h[left], i)
        left = left[(bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
    there = np.zeros(len(h), bool)
    there[left] = True
    return there


@dataclass
class Runs:
    """Runs of word hashes: places ``start``..``end`` of ``words``; phrases at the first ``own`` places are a run's own, each ``times``."""

    words: np.ndarray
    start: np.ndarray
    end: np.ndarray
    own: np.ndarray
    times: np.ndarray
    salt: np.ndarray

    def places(self, n: int, owned: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place, run) of all phrases of n words, or of a run's own ones."""
        size = np.maximum(self.end - self.start - n + 1, 0)
        if owned:
            size = np.minimum(size, self.own)
        run = np.repeat(np.arange(len(size)), size)
        return self.start[run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size), run

    def narrowed(self, n: int, bits: np.ndarray) -> Runs:
        """The parts in which every phrase of n words may be frequent and that hold a longer one of their own."""
        at, of = self.places(n, owned=False)
        some = held_in(bits, phrase_hash(self.words, at, n, self.salt[of]))
        at, of = at[some], of[some]
        edges = np.concatenate([np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(of, prepend=-1) != 0)), [len(at)]])
        first, last = at[edges[:-1]], at[edges[1:] - 1]
        of = of[edges[:-1]]
        own = np.minimum(self.start[of] + self.own[of] - first, last - first)  # a longer phrase starts at all places but the last
        good = own > 0
        return Runs(self.words, first[good], last[good] + n, own[good], self.times[of[good]], self.salt[of[good]])

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(salt, chunk, own, n), equal runs added up."""
        own = self.own.astype(np.uint64) * _ODD[1] + self.salt
        code, one = grouped(*(h + own for h in run_hashes(self.words, self.start, self.end)))
        times = np.zeros(len(one), np.int64)
        np.add.at(times, code, self.times)
        yield pa.RecordBatch.from_arrays([
            pa.array(self.salt[one].view(np.int64)), gathered(self.words, self.start[one], self.end[one]),
            pa.array(self.own[one], pa.int32()), pa.array(times),
        ], names=["salt", "chunk", "own", "n"])


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Runs]:
    """Rows (salt, chunk, own, n) in runs of bounded size."""
    held, size = [], 0

    def whole() -> Runs:
        column = lambda c: np.concatenate([b.column(c).to_numpy() for b in held])
        end = np.cumsum(np.concatenate([pc.binary_length(b.column("chunk")).to_numpy() for b in held]).astype(np.int64) // 8)
        words = np.frombuffer(b"".join(x for b in held for x in b.column("chunk").to_pylist()), np.uint64)
        return Runs(words, np.concatenate([[0], end[:-1]]), end, column("own").astype(np.int64), column("n"), column("salt").view(np.uint64))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column("chunk"))).as_py()
        if size > 2 * TASK_BYTES:
            yield whole()
            held, size = [], 0
    if held:
        yield whole()


def narrowed(chunks: DataFrame, n: int, bits: np.ndarray) -> DataFrame:
    """The parts of the chunks in which every phrase of n words may be frequent, as chunks."""
    shared = chunks.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs_of(batches):
            yield from part.narrowed(n, shared.value).rows()

    return chunks.select("salt", "chunk", "own", "n").mapInArrow(run, _RUNS)


def _filled(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The filter in which these 64-bit words hold these bits."""
    whole = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    whole[words] = bits.view(np.uint64)
    return whole


def reached_places(chunks: DataFrame, n: int, least: int) -> np.ndarray:
    """Bits of the filter's places that phrases of n words reach at least ``least`` times, all phrases of a place together.

    A task sends a row per block of places, with the places as gaps and the counts, up to ``least``, as arrays.
    """
    in_block = (1 << FILTER_BITS) // BLOCKS
    small = np.uint8 if least < 256 else np.uint32

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs_of(batches):
            at, of = part.places(n, owned=True)
            if not len(at):
                continue
            place = probes(phrase_hash(part.words, at, n, part.salt[of]), 0).astype(np.int64)
            order = np.argsort(place, kind="stable")
            place = place[order]
            first = np.flatnonzero(np.diff(place, prepend=-1))
            place, times = place[first], np.minimum(np.add.reduceat(part.times[of[order]], first), least).astype(small)
            block, place = np.divmod(place, in_block)
            edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
            gaps = np.diff(place, prepend=0)
            gaps[edges[:-1]] = place[edges[:-1]]
            rows = [(int(block[a]), gaps[a:b].astype(np.uint16 if gaps[a:b].max() < 2**16 else np.uint32).tobytes(), times[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["block", "gaps", "times"])

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, gaps, times in zip(*(batch.column(c).to_pylist() for c in ("block", "gaps", "times"))):
                held = sums.setdefault(block, np.zeros(in_block, np.uint32))
                times = np.frombuffer(times, small)
                place = np.cumsum(np.frombuffer(gaps, np.uint16 if len(gaps) == 2 * len(times) else np.uint32).astype(np.int64))
                held[place] = np.minimum(held[place] + times, least)
        for block, held in sums.items():
            bits = np.packbits(held >= least, bitorder="little").view(np.int64)
            word = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(word + block * (in_block // 64), pa.int64()), pa.array(bits[word], pa.int64())], names=["word", "bits"])

    counted = chunks.select("salt", "chunk", "own", "n").mapInArrow(places, "block int, gaps binary, times binary")
    found = counted.repartition(BLOCKS // 4, "block").mapInArrow(reached, "word long, bits long").toArrow()
    return _filled(found.column("word").to_numpy(), found.column("bits").to_numpy())


def phrase_counts(chunks: DataFrame, n: int, bits: np.ndarray | None = None) -> DataFrame:
    """(salt, phrase, f): the phrases of n words, as hashes, that chunks (or their narrowed parts) own.

    With ``bits`` (:func:`reached_places`), only those whose place is in it. A task sends its
    phrases with their counts in lists, one a block of hashes, and these are added up.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs_of(batches):
            at, of = part.places(n, owned=True)
            h = phrase_hash(part.words, at, n, part.salt[of])
            if shared.value is not None:
                some = held_in(shared.value, h, 1)
                at, of, h = at[some], of[some], h[some]
            if not len(at):
                continue
            # Phrases of equal words get one number, word by word.
            number = pd.factorize(part.salt[of])[0]
            for i in range(n):
                code, distinct = pd.factorize(part.words[at + i])
                number = pd.factorize(number * len(distinct) + code)[0]
            size = int(number.max()) + 1
            counts, first = np.zeros(size, np.int64), np.empty(size, np.int64)
            np.add.at(counts, number, part.times[of])
            first[number[::-1]] = np.arange(len(number))[::-1]
            block = (h[first] >> np.uint64(32)).astype(np.int64) % BLOCKS
            order = np.argsort(block, kind="stable")
            first, block = first[order], block[order]
            columns = [part.salt[of[first]], *[part.words[at[first] + i] for i in range(n)], counts[order]]
            columns = np.stack([c.view(np.int64) for c in columns])
            edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
            lists = pa.array([columns[:, a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]], pa.int32()), lists], names=["block", "phrases"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # (salt, words, count) of the distinct phrases of a block
        added: dict[int, list[np.ndarray]] = {}

        def summed(block: int) -> np.ndarray:
            lines = np.concatenate([*([sums[block]] if block in sums else []), *added.pop(block, [])], axis=1)
            whole = pd.DataFrame(lines.T).groupby(list(range(n + 1)), sort=False)[n + 1].sum().reset_index()
            return whole.to_numpy(np.int64).T

        for batch in batches:
            for block, phrases in zip(*(batch.column(c).to_pylist() for c in ("block", "phrases"))):
                added.setdefault(block, []).append(np.frombuffer(phrases, np.int64).reshape(n + 2, -1))
                if sum(x.shape[1] for x in added[block]) > max(20_000, sums[block].shape[1] if block in sums else 0):
                    sums[block] = summed(block)
        for block in {*sums, *added}:
            salt, *words, f = summed(block)
            phrase = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(f) + 1, n), pa.int32()), pa.array(np.stack(words, axis=1).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(salt), phrase, pa.array(f)], names=["salt", "phrase", "f"])

    lists = chunks.select("salt", "chunk", "own", "n").mapInArrow(count, "block int, phrases binary")
    return lists.repartition(BLOCKS // 4, "block").mapInArrow(add_up, "salt long, phrase array<long>, f long")


def frequent_phrases(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((salt, phrase, f, k) of all phrases of up to LONGEST words with f >= least, as hashes; the vocabulary)."""
    words, seed = vocabulary(texts)
    often = F.col("f") >= least
    levels = [materialise(words.where(often).select("salt", F.array("hash").alias("phrase"), "f"), "phrases-1")]
    chunks = materialise(dictionary(texts, seed, frequent_filter(levels[0], 1)), "chunks")
    for k in range(2, LONGEST + 1):
        if k > 2:
            chunks = materialise(narrowed(chunks, k - 1, frequent_filter(levels[-1], k - 1)), f"chunks-{k}")
        levels.append(materialise(phrase_counts(chunks, k, reached_places(chunks, k, least)).where(often), f"phrases-{k}"))
    return reduce(DataFrame.unionAll, [level.withColumn("k", F.lit(k)) for k, level in enumerate(levels, 1)]), words


def _key(salt: Column, phrase: Column) -> Column:
    return F.concat_ws(" ", salt.cast("string"), F.array_join(phrase, " "))


def collocations(docs: DataFrame, least: int = 100, top: int = 2_000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of 2 to 5 words of each language that hold together best: lang, rank, phrase, a, l, r, n, score.

    Texts, A-Z lower-cased, are split into pieces at ``.,;:!?`` and line ends, and
    these into words at spaces and tabs. Of a language's ``n`` words, a phrase that
    occurs ``a`` >= ``least`` times within pieces, overlaps included, is cut in two
    at every place; its score is the least of floor(1000 a n / (l r)), l and r the
    counts of its parts, at the first of such places. A phrase inside a longer one that
    occurs as often is left out. Ties go to the larger a, then to the lesser bytes.

    Null texts are empty; a null language is ``und``. Repeated rows count as often
    as they occur. An empty table gives no rows. All texts are read whole, twice:
    for their words, and for chunks of frequent words. Counts are exact, and scores
    take 38 digits where products need them.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    found, words = frequent_phrases(texts, least)
    found = materialise(found.withColumn("_key", _key(F.col("salt"), F.col("phrase"))), "phrases")
    # A longer phrase that holds another one holds one that is a single word longer, too, which is as frequent at least.
    size = F.col("k") - 1
    inside = found.where("k > 2").select("salt", "f", F.explode(F.array(F.slice("phrase", 1, size), F.slice("phrase", 2, size))).alias("phrase"))
    covered = inside.groupBy(_key(F.col("salt"), F.col("phrase")).alias("_key")).agg(F.max("f").alias("_longer"))
    candidates = found.where("k > 1").join(covered, "_key", "left").where("_longer is null or _longer < f")
    candidates = materialise(candidates.withColumn("_row", F.monotonically_increasing_id()), "candidates")
    cuts = candidates.select("salt", "phrase", "_row", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size)).alias("cut"), "k")
    part = lambda start, length: F.slice("phrase", start, length)
    cuts = cuts.withColumns({
        "_first": _key(F.col("salt"), part(F.lit(1), F.col("cut"))), "_rest": _key(F.col("salt"), part(F.col("cut") + 1, F.col("k") - F.col("cut"))),
    })
    cuts = materialise(cuts.drop("phrase"), "cuts")
    totals = words.groupBy("salt").agg(F.sum("f").alias("n"), F.min("lang").alias("lang"))
    for side, name in (("_first", "l"), ("_rest", "r")):
        parts = cuts.groupBy(side).agg(F.count(F.lit(1)).alias("_n"))
        sums = found.select(F.col("_key").alias(side), F.col("f").alias(name))
        cuts = salted_join(cuts, sums, side, hot_keys(parts, side, "_n"), F.xxhash64("_row", "cut"), "inner")
    cuts = salted_join(cuts, totals, "salt", hot_keys(cuts.groupBy("salt").count(), "salt", "count"), F.xxhash64("_row", "cut"), "inner")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"], wide["l"] * wide["r"])
    best = F.min(F.struct("score", "cut", "l", "r")).alias("best")
    scored = cuts.withColumn("score", score).groupBy("lang", "a", "n", "_row").agg(best)
    # Words for their hashes, for frequent phrases only.
    spelt = candidates.select("_row", F.posexplode("phrase").alias("place", "hash"))
    sizes = spelt.groupBy("hash").agg(F.count(F.lit(1)).alias("_n"))
    spelling = words.where(F.col("f") >= least).groupBy("hash").agg(F.min("word").alias("word"))
    spelt = salted_join(spelt, spelling, "hash", hot_keys(sizes, "hash", "_n"), F.col("_row"), "inner")
    spelt = spelt.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda s: s.word).alias("words"))
    scored = scored.join(spelt.select("_row", F.array_join("words", " ").alias("phrase")), "_row")
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
