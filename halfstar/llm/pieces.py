"""SentencePiece encoding and decoding of whole texts."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halfstar.llm.piece_tables import SPACE, Vocabulary, WordEncoder, read_vocabulary

WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")
KNOWN_WORDS = 200_000  # words whose ids a worker keeps before it starts anew
SLICE_ROWS = 500  # rows of a batch turned into Python objects at once
SLICE_WORDS = 100_000  # words encoded in one step, whatever documents they are from


@lru_cache(maxsize=2)
def _encoder(vocabulary: Vocabulary) -> WordEncoder:
    return WordEncoder(vocabulary)


class _Texts:
    """Encodes texts word by word, with a bounded memory of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.encoder = _encoder(vocabulary)
        self.mark = self.encoder.ids[SPACE]
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.counts: list[np.ndarray] = [np.zeros(0, np.int64)]

    def _learn(self, words: list[str]) -> None:
        bare = [w if w[1:2] != SPACE else SPACE + w.lstrip(SPACE) for w in words]
        ids, counts = self.encoder.encode(bare)
        spaced = [i for i, (w, b) in enumerate(zip(words, bare)) if len(w) > len(b)]
        if spaced:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in spaced:
                own, extra = parts[i], len(words[i]) - len(bare[i])
                if own[0] == self.mark:  # the last mark didn't join the word, so it belongs to the run
                    own, extra = own[1:], extra + 1
                parts[i] = np.concatenate([np.array(self.encoder.spaces(extra), np.int32), own])
            ids, counts = np.concatenate(parts), np.array(list(map(len, parts)), np.int64)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.ids.append(ids)
        self.counts.append(counts)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > KNOWN_WORDS:
            self._forget()
        places = list(map(self.place.get, words))
        fresh = dict.fromkeys([w for w, p in zip(words, places) if p is None])
        if fresh:
            self._learn(list(fresh))
            self.ids, self.counts = [np.concatenate(self.ids)], [np.concatenate(self.counts)]
            self.starts = np.cumsum(self.counts[0]) - self.counts[0]
            places = list(map(self.place.__getitem__, words))
        where = np.array(places, np.int64)
        counts = self.counts[0][where]
        shift = self.starts[where] - (np.cumsum(counts) - counts)
        return self.ids[0][np.repeat(shift, counts) + np.arange(counts.sum())], counts

    def batch(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        ids, sizes = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        words: list[str] = []
        owners: list[tuple[int, int]] = []  # (text, number of its words in the slice)

        def flush() -> None:
            if words:
                got, counts = self.encode(words)
                ids.append(got)
                ends = np.cumsum([n for _, n in owners])
                before = np.concatenate([[0], np.cumsum(counts)])
                sizes_here = before[ends] - before[ends - [n for _, n in owners]]
                np.add.at(sizes, [t for t, _ in owners], sizes_here)
                words.clear()
                owners.clear()

        for t, text in enumerate(texts):
            if not text:
                continue
            marked = SPACE + text.replace(" ", SPACE)
            if len(marked) < SLICE_WORDS:
                found = WORDS.findall(marked)
                words += found
                owners.append((t, len(found)))
                if len(words) >= SLICE_WORDS:
                    flush()
                continue
            n = 0  # a long text fills several slices
            for m in WORDS.finditer(marked):
                words.append(m[0])
                n += 1
                if len(words) >= SLICE_WORDS:
                    owners.append((t, n))
                    flush()
                    n = 0
            owners.append((t, n)) if n else None
        flush()
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))


def _replace_each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


def decode_ids(vocabulary: Vocabulary, texts: list[bytes], ids: list[int]) -> str:
    """The text of ids: without the leading space, control ids have no text, stray bytes become U+FFFD one by one."""
    parts = list(map(texts.__getitem__, ids))
    if b"" not in parts:
        text = b"".join(parts).decode("utf-8", "each")
    else:  # bytes on both sides of a control id make no character together
        runs: list[list[bytes]] = [[]]
        for part in parts:
            runs[-1].append(part) if part else runs.append([])
        text = "".join([b"".join(run).decode("utf-8", "each") for run in runs])
        ids = [i for i, part in zip(ids, parts) if part]
    return text[1:] if ids and vocabulary.pieces[ids[0]].startswith(SPACE) else text


def _id_texts(vocabulary: Vocabulary) -> list[bytes]:
    codecs.register_error("each", _replace_each)
    texts, byte = [], 0
    for piece, kind in zip(vocabulary.pieces, vocabulary.kinds):
        texts.append({"n": piece.replace(SPACE, " ").encode(), "c": b"", "u": " ⁇ ".encode(), "b": bytes([byte & 255])}[kind])
        byte += kind == "b"
    return texts


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most SLICE_ROWS."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def encode_texts(df: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with its text column replaced by ``ids_col`` (array of int), the ids of the whole text.

    A null or empty text has no ids. Begin and end ids aren't added. ``model`` is a
    file the driver can read; its vocabulary, of fixed size, goes with the tasks.
    One pass without a shuffle; a task keeps one Arrow batch and the ids of at most
    KNOWN_WORDS words and one slice.
    """
    vocabulary = read_vocabulary(model)
    others = [c for c in df.columns if c != text_col]
    schema = df.select(*[F.col(f"`{c}`") for c in others], F.array().cast("array<int>").alias(ids_col)).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts(vocabulary)
        for batch in _slices(batches):
            ids = texts.batch(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], ids], [*others, ids_col])

    return df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`")).mapInArrow(encode, schema)


def decode_texts(df: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col`` added: the text of its ids. Null ids give the empty text."""
    vocabulary = read_vocabulary(model)
    schema = df.withColumn(text_col, F.lit("")).schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _id_texts(vocabulary)
        for batch in _slices(batches):
            found = [decode_ids(vocabulary, texts, ids.values.to_numpy().tolist() if ids.is_valid else []) for ids in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, text_col])

    return df.mapInArrow(decode, schema)
