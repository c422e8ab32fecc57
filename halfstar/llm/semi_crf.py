"""A small semi-Markov conditional random field over short regions of text.

A labelling cuts a region's tokens into segments: single tokens outside any
entity, and entities of at most MAX_TOKENS tokens. Each segment is scored as a
whole (its digits, shape, checks and neighbours) and each two neighbouring
labels have a weight. Sums and maxima over all labellings come from dynamic
programming over (end, start, label).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\S\n]+|\n|[\s\S]")
MAX_TOKENS = 24
WIDTH = 1 << 13
SLOTS = 14
MINUS = -1e30


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _kind(token: str | None) -> str:
    if not token:
        return "^"
    return "d" if token[0] in "0123456789" else "a" if token[0].isalpha() else "_" if token.isspace() else token[0]


def _code(features: list[str]) -> list[int]:
    return [zlib.crc32(f.encode()) % (WIDTH - 1) + 1 for f in features]


def _features(tokens: list[str], i: int, j: int, word: str) -> list[str]:
    """Features of the segment tokens[i:j]; ``word`` is the last word before it."""
    left, right = _kind(tokens[i - 1] if i else None), _kind(tokens[j] if j < len(tokens) else None)
    if j == i + 1 and not tokens[i][0] in "0123456789@":
        return ["o", "o" + _kind(tokens[i]), left + "|" + right]
    span = "".join(tokens[i:j])
    groups = [t for t in tokens[i:j] if t[0] in "0123456789"]
    digits = "".join(groups)
    shape = "".join(_kind(t) if _kind(t) != "d" else f"d{min(len(t), 6)}" for t in tokens[i:j])
    found = [
        "b", f"n{min(j - i, 12)}", f"d{min(len(digits), 20)}", f"g{len(groups)}", f"l{left}", f"r{right}",
        f"f{_kind(tokens[i])}", f"e{_kind(tokens[j - 1])}", f"s{shape}", f"w{word}", f"@{span.count('@')}",
    ]
    if 16 <= len(digits) <= 19 and not span.strip("0123456789 -"):
        found.append(f"luhn{luhn(digits)}")
    if len(groups) == 4 and re.fullmatch(r"\d+(\.\d+){3}", span):
        found.append(f"ip{all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    if any(_kind(t) == "a" for t in tokens[i:j]) and groups and "@" not in span:
        found.append("mixed")
    return found[:SLOTS]


@dataclass
class Lattice:
    """All candidate segments of a region, by their ends."""

    offsets: np.ndarray  # character offset of each token, and the end
    start: np.ndarray
    end: np.ndarray
    codes: np.ndarray  # segments x SLOTS, 0 where a segment has fewer features
    first: np.ndarray  # of the segments that end at token j: first[j] .. first[j + 1]


def lattice(text: str) -> Lattice:
    tokens = TOKEN.findall(text)
    return next(_lattices(tokens, _offsets(tokens), max(len(tokens), 1)))


def _offsets(tokens: list[str]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(int)


def _lattices(tokens: list[str], offsets: np.ndarray, step: int) -> Iterator[Lattice]:
    """The segments of the tokens, those that end at ``step`` tokens after the other at a time."""
    marks = [t[0] in "0123456789@" for t in tokens]
    words, word = [], ""
    for t in tokens:
        words.append(word)
        word = t.lower() if t[0].isalpha() else word
    for low in range(0, max(len(tokens), 1), step):
        rows, starts, ends, first = [], [], [], [0]
        for j in range(low + 1, min(low + step, len(tokens)) + 1):
            marked = False
            for i in range(j - 1, max(-1, j - 1 - MAX_TOKENS), -1):
                if "\n" in tokens[i] and i < j - 1:
                    break
                marked = marked or marks[i]
                outside = j == i + 1
                if not outside and (not marked or tokens[i].isspace() or tokens[j - 1].isspace()):
                    continue
                codes = _code(_features(tokens, i, j, words[i]))
                rows.append(codes + [0] * (SLOTS - len(codes)))
                starts.append(i)
                ends.append(j)
            first.append(len(rows))
        yield Lattice(offsets, np.array(starts, int), np.array(ends, int), np.array(rows, int).reshape(-1, SLOTS), np.array(first))


class SemiCrf:
    """Label 0 is outside; the others are entities. ``weights`` is labels x WIDTH, column 0 unused."""

    def __init__(self, labels: list[str], seed_weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.labels = labels
        self.weights = np.zeros((len(labels), WIDTH)) if seed_weights is None else seed_weights
        self.moves = np.zeros((len(labels), len(labels))) if moves is None else moves

    def _scores(self, x: Lattice) -> np.ndarray:
        scores = self.weights[:, x.codes].sum(-1).T
        scores[x.end - x.start > 1, 0] = MINUS
        return scores

    def best(self, x: Lattice) -> list[tuple[int, int, str]]:
        """Entities (start, end, label) of the best labelling, in characters of the region."""
        return self._best(x.offsets, [x])

    def best_of(self, text: str, step: int = 512) -> list[tuple[int, int, str]]:
        """The same for a text of any length: segments are held for ``step`` tokens at a time, states for all."""
        tokens = TOKEN.findall(text)
        offsets = _offsets(tokens)
        return self._best(offsets, _lattices(tokens, offsets, step))

    def _best(self, offsets: np.ndarray, parts: Iterable[Lattice]) -> list[tuple[int, int, str]]:
        n, k = len(offsets) - 1, len(self.labels)
        top = np.full(k, MINUS)
        top[0] = 0.0
        entry = np.full((n + 1, k), MINUS)
        came, origin = np.zeros((n + 1, k), np.int32), np.zeros((n + 1, k), np.int32)
        through = top[:, None] + self.moves
        entry[0], origin[0] = through.max(0), through.argmax(0)
        j = 0
        for x in parts:
            scores = self._scores(x)
            for a, b in zip(x.first[:-1].tolist(), x.first[1:].tolist()):
                j += 1
                at = entry[x.start[a:b]] + scores[a:b]
                came[j] = x.start[a + at.argmax(0)]
                top = at.max(0)
                through = top[:, None] + self.moves
                entry[j], origin[j] = through.max(0), through.argmax(0)
        found, j, y = [], n, int(top.argmax())
        while j:
            i = int(came[j, y])
            if y:
                found.append((int(offsets[i]), int(offsets[j]), self.labels[y]))
            j, y = i, int(origin[i, y])
        return found[::-1]

    def fit(self, data: list[tuple[Lattice, list[tuple[int, int, int]]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-3) -> None:
        """Maximise the likelihood by AdaGrad. ``data``: lattices with their entities (first token, end token, label)."""
        seen_w, seen_m = np.full_like(self.weights, 1e-6), np.full_like(self.moves, 1e-6)
        for _ in range(epochs):
            for x, entities in data:
                grad, moves = self._gradient(x, entities)
                codes = np.unique(x.codes)
                g = grad[:, codes] - decay * self.weights[:, codes]
                seen_w[:, codes] += g * g
                self.weights[:, codes] += rate * g / np.sqrt(seen_w[:, codes])
                self.weights[:, 0] = 0.0
                m = moves - decay * self.moves
                seen_m += m * m
                self.moves += rate * m / np.sqrt(seen_m)

    def _gradient(self, x: Lattice, entities: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Observed less expected feature counts, and the same for moves between labels."""
        n, scores, k = len(x.first) - 1, self._scores(x), len(self.labels)
        ahead, entry = np.full((n + 1, k), MINUS), np.full((n + 1, k), MINUS)
        ahead[0, 0] = 0.0
        for j in range(n + 1):
            if j:
                a, b = x.first[j - 1], x.first[j]
                ahead[j] = np.logaddexp.reduce(entry[x.start[a:b]] + scores[a:b], axis=0)
            entry[j] = np.logaddexp.reduce(ahead[j][:, None] + self.moves, axis=0)
        total = np.logaddexp.reduce(ahead[n])
        after = np.full((n + 1, k), MINUS)  # from a position on, given the label that ends there
        inside = np.full((n + 1, k), MINUS)  # the same, given the label that begins there
        after[n] = 0.0
        expected = np.zeros_like(scores)
        moved = np.zeros((k, k))
        for j in range(n, 0, -1):
            if j < n:
                through = self.moves + inside[j][None, :]
                after[j] = np.logaddexp.reduce(through, axis=1)
                moved += np.exp(np.minimum(ahead[j][:, None] + through - total, 0.0))
            a, b = x.first[j - 1], x.first[j]
            rest = scores[a:b] + after[j]
            expected[a:b] = np.exp(np.minimum(entry[x.start[a:b]] + rest - total, 0.0))
            np.logaddexp.at(inside, x.start[a:b], rest)
        moved += np.exp(np.minimum(ahead[0][:, None] + self.moves + inside[0][None, :] - total, 0.0))
        place = {(int(i), int(j)): s for s, (i, j) in enumerate(zip(x.start, x.end))}
        by_start = {i: (j, y) for i, j, y in entities}
        i, last = 0, 0
        observed = np.zeros_like(scores)
        while i < n:
            j, y = by_start.get(i, (i + 1, 0))
            observed[place[i, j], y] += 1
            moved[last, y] -= 1
            i, last = j, y
        grad = np.zeros_like(self.weights)
        for y in range(k):
            np.add.at(grad[y], x.codes.ravel(), np.repeat(observed[:, y] - expected[:, y], SLOTS))
        return grad, -moved
