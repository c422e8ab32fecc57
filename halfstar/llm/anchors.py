"""Anchors hierarchy: metric trees over integer points, built from the middle out.

About sqrt(n) anchors are spread first: each new anchor is the farthest point of
the widest anchor, and takes over the points that are nearer to it than to the
anchor they had. Two anchors more than twice as far apart as a point is from its
own cannot exchange that point, so most distances are never computed. The
anchors are then merged into balls, always the pair with the smallest common
ball, and each anchor's own points become a tree the same way. Every ball holds
its points' count and exact sums, a centre and a radius.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 24  # points of a ball that isn't divided


@dataclass
class Tree:
    """Balls as columns; ball 0 is the root. Children have higher numbers than their parent; a leaf has children 0, 0."""

    order: np.ndarray  # points by place; a ball owns the places start..end
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray  # integer point
    radius2: np.ndarray  # greatest squared distance of a point from the centre
    total: np.ndarray  # sums of the points

    def packed(self) -> bytes:
        head = np.array([len(self.order), len(self.start), self.centre.shape[1]], np.int64)
        numbers = [self.order, self.start, self.end, self.left, self.right]
        return b"".join([head.tobytes(), *[a.astype(np.int32).tobytes() for a in numbers], *[
            a.astype(np.int64).tobytes() for a in (self.centre, self.radius2, self.total)]])


def unpacked(data: bytes) -> Tree:
    n, balls, dims = np.frombuffer(data, np.int64, 3)
    at, columns = 24, []
    for size, kind in [(n, np.int32), *[(balls, np.int32)] * 4, (balls * dims, np.int64), (balls, np.int64), (balls * dims, np.int64)]:
        columns.append(np.frombuffer(data, kind, size, at))
        at += size * np.dtype(kind).itemsize
    columns[5], columns[7] = columns[5].reshape(balls, dims), columns[7].reshape(balls, dims)
    return Tree(*columns)


def distances2(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points - centre
    return (gap * gap).sum(axis=-1)


def spread_anchors(points: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of each point, anchors' points): up to ``wanted`` anchors, fewer if all points lie on them.

    Of equally far points the first becomes an anchor, and a point stays with its anchor on a tie.
    """
    owner = np.zeros(len(points), np.int64)
    own2 = distances2(points, points[0])
    pivots = [0]
    while len(pivots) < wanted:
        far = int(own2.argmax())
        if own2[far] == 0:
            break
        new = len(pivots)
        # A point can only change if it is over half as far from its anchor as that is from the new one.
        between2 = distances2(points[pivots], points[far])
        maybe = np.nonzero(4 * own2.astype(np.float64) * (1 + 1e-9) >= between2[owner])[0]
        gap2 = distances2(points[maybe], points[far])
        nearer = gap2 < own2[maybe]
        owner[maybe[nearer]] = new
        own2[maybe[nearer]] = gap2[nearer]
        pivots.append(far)
    return owner, np.array(pivots)


def _middle_out(centres: np.ndarray, radii: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Merges (a, b) of balls; merge i makes ball ``len(centres) + i``. The pair with the smallest common ball goes first."""
    n = len(centres)
    if n < 2:
        return []
    middle, radius, size = np.zeros((2 * n - 1, centres.shape[1])), np.zeros(2 * n - 1), np.zeros(2 * n - 1)
    middle[:n], radius[:n], size[:n] = centres, radii, counts
    alive = np.arange(2 * n - 1) < n
    common = np.full((2 * n - 1, 2 * n - 1), np.inf)  # radius of the ball around two balls

    def reach(ball: int) -> np.ndarray:
        gap = np.sqrt(((middle - middle[ball]) ** 2).sum(axis=1))
        return np.where(alive, np.maximum((gap + radius + radius[ball]) / 2, np.maximum(radius, radius[ball])), np.inf)

    for ball in range(n):
        common[ball] = reach(ball)
    np.fill_diagonal(common, np.inf)
    merges = []
    for new in range(n, 2 * n - 1):
        a, b = divmod(int(common.argmin()), 2 * n - 1)
        merges.append((a, b))
        alive[[a, b]] = False
        common[[a, b], :] = common[:, [a, b]] = np.inf
        size[new] = size[a] + size[b]
        middle[new] = (middle[a] * size[a] + middle[b] * size[b]) / size[new]
        radius[new] = max(np.sqrt(((middle[new] - middle[x]) ** 2).sum()) + radius[x] for x in (a, b))
        common[new, :] = common[:, new] = reach(new)
        alive[new] = True
    return merges


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of the rows of ``points`` (integers). Without points it has one empty ball."""
    balls: list[list[int]] = []  # left, right
    leaves: dict[int, np.ndarray] = {}

    def ball(left: int = 0, right: int = 0) -> int:
        balls.append([left, right])
        return len(balls) - 1

    def grow(members: np.ndarray, at: int) -> None:
        """Divide ball ``at``, which holds ``members``, iteratively."""
        todo = [(members, at)]
        while todo:
            own, at = todo.pop()
            if len(own) <= leaf:
                leaves[at] = own
                continue
            owner, pivots = spread_anchors(points[own], max(2, int(np.sqrt(len(own)))))
            if len(pivots) == 1:  # all points are equal
                leaves[at] = own
                continue
            groups = [own[owner == a] for a in range(len(pivots))]
            centres = np.array([points[g].mean(axis=0) for g in groups])
            radii = np.array([np.sqrt(((points[g] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centres)])
            merges = _middle_out(centres, radii, np.array([len(g) for g in groups]))
            # The last merge is ball ``at``; numbers are given from it downwards.
            place = {len(groups) + len(merges) - 1: at}
            for i in range(len(merges) - 1, -1, -1):
                a, b = merges[i]
                place[a], place[b] = ball(), ball()
                balls[place[len(groups) + i]] = [place[a], place[b]]
            todo += [(g, place[a]) for a, g in enumerate(groups)]

    ball()
    grow(np.arange(len(points)), 0)
    n, dims = len(balls), points.shape[1]
    left, right = (np.array([b[i] for b in balls], np.int32) for i in (0, 1))
    # Places by depth first, so that a ball's points are neighbours.
    order, start, end = [], np.zeros(n, np.int32), np.zeros(n, np.int32)
    done, stack = 0, [0]
    while stack:
        at = stack.pop()
        if at < 0:
            end[~at] = done
            continue
        start[at] = done
        stack.append(~at)
        if at in leaves:
            order.append(leaves[at])
            done += len(leaves[at])
        else:
            stack += [int(right[at]), int(left[at])]
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    running = np.zeros((len(order) + 1, dims), np.int64)
    np.cumsum(points[order], axis=0, out=running[1:])
    total = running[end] - running[start]
    centre = total // np.maximum(end - start, 1)[:, None]
    sizes = (end - start).astype(np.int64)
    radius2 = np.zeros(n, np.int64)
    if len(order):
        # Every point under every ball it belongs to; depth is small, so this is a few times n.
        of = np.repeat(np.arange(n), sizes)
        place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start, sizes)
        for a in range(0, len(of), 1 << 18):
            part = slice(a, a + (1 << 18))
            np.maximum.at(radius2, of[part], distances2(points[order[place[part]]], centre[of[part]]))
    return Tree(order, start, end, left, right, centre, radius2, total)


def assign(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest entry of each point, sums per entry, counts per entry, distances computed to points); ties to the lower index.

    Balls go down the tree with the list of entries that may own one of their
    points. An entry leaves the list if no point of the ball can be as near to it
    as to the entry nearest to the centre; a ball with one entry left is owned
    whole, and its cached sum and count are taken instead of its points.
    """
    k, dims = entries.shape
    nearest = np.zeros(len(points), np.int64)
    sums, counts, computed = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
    # Of equal entries only the first can own a point.
    first = [not (entries[:e] == entries[e]).all(axis=1).any() for e in range(k)]
    apart = np.sqrt(((entries[:, None] - entries[None]).astype(np.float64) ** 2).sum(axis=2))
    balls, lists = np.zeros(1, np.int64), np.array([first])
    far = np.iinfo(np.int64).max
    while len(balls):
        gap2 = ((tree.centre[balls][:, None] - entries[None]) ** 2).sum(axis=2)
        best = np.where(lists, gap2, far).argmin(axis=1)
        lead = (gap2 - np.take_along_axis(gap2, best[:, None], axis=1)).astype(np.float64)
        # For a point at most r from the centre the lead shrinks by at most 2 r times the entries' distance.
        reach = 2 * np.sqrt(tree.radius2[balls].astype(np.float64))[:, None] * apart[best]
        lists = lists & (lead <= reach * (1 + 1e-9) + 1)
        lists[np.arange(len(balls)), best] = True
        size = (tree.end - tree.start)[balls]
        owned = lists.sum(axis=1) == 1
        np.add.at(sums, best[owned], tree.total[balls[owned]])
        np.add.at(counts, best[owned], size[owned])
        _mark(nearest, tree, balls[owned], best[owned])
        leaf = ~owned & (tree.left[balls] == 0)
        if leaf.any():
            of = np.repeat(np.nonzero(leaf)[0], size[leaf])
            members = tree.order[_places(tree, balls[leaf])]
            gap2 = ((points[members][:, None] - entries[None]) ** 2).sum(axis=2)
            computed += int(lists[of].sum())
            mine = np.where(lists[of], gap2, far).argmin(axis=1)
            nearest[members] = mine
            np.add.at(sums, mine, points[members])
            np.add.at(counts, mine, 1)
        down = ~owned & ~leaf
        balls, lists = np.concatenate([tree.left[balls[down]], tree.right[balls[down]]]), np.concatenate([lists[down]] * 2)
    return nearest, sums, counts, computed


def _places(tree: Tree, balls: np.ndarray) -> np.ndarray:
    size = (tree.end - tree.start)[balls].astype(np.int64)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(tree.start[balls], size)


def _mark(nearest: np.ndarray, tree: Tree, balls: np.ndarray, entry: np.ndarray) -> None:
    nearest[tree.order[_places(tree, balls)]] = np.repeat(entry, (tree.end - tree.start)[balls])
