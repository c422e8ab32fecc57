"""Tables of a SentencePiece merge vocabulary, and exact encoding of many words at once.

A sequence of pieces is the encoding of its text if, and only if, each two
neighbours stay apart when their text is merged anew. The encoder therefore
walks from left to right with the longest piece that starts at each position
(an Aho-Corasick automaton over the reversed pieces gives it), takes the next
shorter piece where two neighbours don't go together, and steps back where none
does. A bit per position remembers where no encoding can go on, so no position
is given up twice. All words of a batch take each step together, as arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = "▁"  # fixed value: how the vocabulary writes a space
NEVER = np.iinfo(np.int32).max
CACHE_BITS = 20


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a model: texts and scores by id, and the kind of each id."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str  # n normal, b byte, c control, u unknown


def read_vocabulary(path: str) -> Vocabulary:
    """Read a merge-type model with identity normalisation and byte fallback. Other models are refused."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    if model.normalize("　Ａ  b ") != f"{SPACE}　Ａ{SPACE * 2}b{SPACE}":
        raise ValueError("only models with identity normalisation and a leading space are supported")
    kinds = "".join(
        "b" if model.is_byte(i) else "c" if model.is_control(i) else "u" if model.is_unknown(i) else "n" for i in ids
    )
    words = Vocabulary(tuple(map(model.id_to_piece, ids)), tuple(map(model.get_score, ids)), kinds)
    normal = [p for p, k in zip(words.pieces, kinds) if k == "n"]
    if any(map(model.is_unused, ids)) or any(SPACE in p.lstrip(SPACE) or (p[:2] == SPACE * 2 and p.strip(SPACE)) for p in normal):
        raise ValueError("pieces across words and unused pieces are not supported")
    if kinds.count("b") != 256:
        raise ValueError("the model has no byte fallback")
    return words


def merge_text(text: str, score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Merge a text from its characters, best score first and leftmost among equals; also the last merge."""
    parts, last = list(text), None
    while len(parts) > 1:
        pairs = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score]
        if not pairs:
            break
        i = min(pairs)[1]
        last = parts[i], parts[i + 1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


class WordEncoder:
    """Encodes words, each a space mark and characters without one."""

    def __init__(self, vocabulary: Vocabulary):
        pieces, kinds = vocabulary.pieces, vocabulary.kinds
        normal = {p: i for i, p in enumerate(pieces) if kinds[i] == "n"}
        self.byte_id = np.array([i for i, k in enumerate(kinds) if k == "b"], dtype=np.int32)
        score = {p: vocabulary.scores[i] for p, i in normal.items()}
        self.runs = {p: score[p] for p in normal if not p.strip(SPACE)}
        self.ids = normal
        n = self.n = len(pieces)
        usable: dict[str, int] = {}
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                usable[p] = i
            elif p.strip(SPACE):
                parts, last = merge_text(p, score)
                if len(parts) == 1:  # else merging never makes this piece
                    usable[p] = i
                    self.left[i], self.right[i] = normal[last[0]], normal[last[1]]
        ranked = sorted((i for p, i in usable.items() if len(p) > 1), key=lambda i: -vocabulary.scores[i])
        if len({vocabulary.scores[i] for i in ranked}) < len(ranked):
            raise ValueError("two pieces of the model have the same score")
        self.rank = np.full(n, -1, np.int32)  # single characters come before any merge
        self.rank[ranked] = np.arange(len(ranked), dtype=np.int32)
        self.length = np.array([len(p) for p in pieces], dtype=np.int32)
        self.shorter = np.full(n, -1, np.int32)
        joins = []
        for p, i in usable.items():
            heads = [k for k in range(len(p) - 1, 0, -1) if p[:k] in usable]
            if heads:
                self.shorter[i] = usable[p[: heads[0]]]
            joins += [(usable[p[:k]] * n + usable[p[k:]], i) for k in heads if p[k:] in usable]
        joins.sort()
        self.join_key = np.array([k for k, _ in joins], dtype=np.int64)
        self.join_id = np.array([i for _, i in joins], dtype=np.int32)
        self.cache_key = np.full(1 << CACHE_BITS, -1, np.int64)
        self.cache_ok = np.zeros(1 << CACHE_BITS, bool)
        self._automaton(usable)

    def _automaton(self, usable: dict[str, int]) -> None:
        """Goto table of the automaton over reversed pieces, failures resolved, and the longest piece of each state."""
        letters = sorted({c for p in usable if len(p) > 1 for c in p})
        code = {c: k for k, c in enumerate(letters)}
        width = len(letters)
        self.symbol = np.full(0x110000, width, np.int32)  # any other character is a piece by itself, or unknown
        self.single = np.full(0x110000, -1, np.int32)
        for p, i in usable.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        for c, k in code.items():
            self.symbol[ord(c)] = k
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for p, i in usable.items():
            if len(p) == 1 and p not in code:
                continue
            at = 0
            for c in reversed(p):
                to = children[at].get(code[c])
                if to is None:
                    to = children[at][code[c]] = len(children)
                    children.append({})
                    piece.append(-1)
                at = to
            piece[at] = i
        self.go = np.zeros((len(children), width + 1), np.int32)
        self.longest = np.array(piece, np.int32)
        queue = [(0, 0)]
        for state, fail in queue:  # grows while it is read
            if state:
                self.go[state] = self.go[fail]
                if piece[state] < 0:
                    self.longest[state] = self.longest[fail]
            for c, to in children[state].items():
                queue.append((to, int(self.go[fail, c]) if state else 0))
                self.go[state, c] = to

    def _together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two pieces stay apart when their text is merged anew.

        Undo the merges of both from the last to the first. The two symbols that
        then stood at the seam would have merged if the piece they make ranks
        before the merge that took the left one away, or not after the merge that
        took the right one (of equal merges the leftmost comes first).
        """
        x, y = a.copy(), b.copy()
        until_x, until_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            xs, ys = x[open_], y[open_]
            key = xs.astype(np.int64) * self.n + ys
            at = np.minimum(np.searchsorted(self.join_key, key), len(self.join_key) - 1)
            made = np.where(self.join_key[at] == key, self.rank[self.join_id[at]], NEVER)
            bad = (made < until_x[open_]) & (made <= until_y[open_])
            good[open_[bad]] = False
            rx, ry = self.rank[xs], self.rank[ys]
            undo_x = rx > ry
            more = ~bad & (np.maximum(rx, ry) >= 0)
            ix, iy = open_[more & undo_x], open_[more & ~undo_x]
            until_x[ix], until_y[iy] = rx[more & undo_x], ry[more & ~undo_x]
            x[ix], y[iy] = self.right[x[ix]], self.left[y[iy]]
            open_ = open_[more]
        return good

    def together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.n + b
        slot = ((key * np.int64(0x9E3779B1)) >> 12) & ((1 << CACHE_BITS) - 1)
        good = self.cache_ok[slot]
        miss = np.flatnonzero(self.cache_key[slot] != key)
        if len(miss):
            keys, back = np.unique(key[miss], return_inverse=True)
            fresh = self._together((keys // self.n).astype(np.int32), (keys % self.n).astype(np.int32))[back]
            good[miss] = fresh
            # One after the other, so that key and verdict of a slot come from the same pair.
            last = {int(s): int(m) for s, m in zip(slot[miss], range(len(miss)))}
            s, m = np.fromiter(last, np.int64, len(last)), np.fromiter(last.values(), np.int64, len(last))
            self.cache_key[s], self.cache_ok[s] = key[miss][m], fresh[m]
        return good

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        total = len(text)
        # Longest piece at each position: read all words from their ends, the longest words first.
        symbol, single = self.symbol[text], self.single[text]
        longest = single.copy()
        order = np.argsort(-size, kind="stable")
        at, first = (start + size - 1)[order], start[order]
        state = np.zeros(len(words), np.int32)
        while len(at):
            state = self.go[state, symbol[at]]
            found = self.longest[state]
            longest[at] = np.where(found >= 0, found, longest[at])
            at = at - 1
            n = int(np.searchsorted(first - at, 1))  # sorted by length: those that go on stand in front
            at, first, state = at[:n], first[:n], state[:n]
        # Characters outside the vocabulary stand alone; what lies between them is encoded by itself.
        unknown = single < 0
        cut = np.zeros(total + 1, bool)
        cut[start] = cut[total] = True
        cut[:-1] |= unknown
        cut[1:] |= unknown
        edges = np.flatnonzero(cut)
        begin, end = edges[:-1], edges[1:]
        known = ~unknown[begin]
        chosen = self._walk(longest, begin[known], end[known], total)
        count = (chosen >= 0).astype(np.int64)
        for p in np.flatnonzero(unknown):
            count[p] = len(chr(text[p]).encode("utf-8"))
        ids = np.repeat(chosen, count)
        if unknown.any():
            offset = np.cumsum(count) - count
            for p in np.flatnonzero(unknown):
                ids[offset[p] : offset[p] + count[p]] = self.byte_id[list(chr(text[p]).encode("utf-8"))]
        return ids, np.add.reduceat(count, start)

    def _walk(self, longest: np.ndarray, begin: np.ndarray, end: np.ndarray, total: int) -> np.ndarray:
        """The piece that starts at each position of the segments' encodings, else -1."""
        chosen = np.full(total, -1, np.int32)
        ends_here = np.full(total + 1, -1, np.int32)  # the piece before a position on the path taken
        dead = np.zeros(total + 1, bool)
        pos, goal = begin.copy(), end
        first = begin
        candidate = longest[pos]
        while len(pos):
            to = pos + self.length[candidate]
            before = np.where(pos > first, ends_here[pos], -1)
            fits = ~dead[to]
            asked = np.flatnonzero(fits & (before >= 0))
            fits[asked] = self.together(before[asked], candidate[asked])
            p, t, c = pos[fits], to[fits], candidate[fits]
            chosen[p] = c
            ends_here[t] = c
            # Where it doesn't fit: the next shorter piece, or back to the piece before.
            less = self.shorter[candidate]
            back = ~fits & (less < 0)
            dead[pos[back]] = True
            step = before[back]
            back_to = pos[back] - self.length[step]
            chosen[back_to] = -1
            next_candidate = np.where(fits, longest[np.minimum(to, total - 1)], less)
            next_candidate[back] = step
            next_pos = np.where(fits, to, pos)
            next_pos[back] = back_to
            go_on = next_pos < goal
            pos, goal, first, candidate = next_pos[go_on], goal[go_on], first[go_on], next_candidate[go_on]
        return chosen

    def spaces(self, n: int) -> list[int]:
        """A run of space marks. Their pieces have one score, so merging goes from the left."""
        most = max(map(len, self.runs))
        head, rest = divmod(n, most)
        parts, _ = merge_text(SPACE * rest, self.runs) if rest else ([], None)
        return [self.ids[SPACE * most]] * head + [self.ids[p] for p in parts]

