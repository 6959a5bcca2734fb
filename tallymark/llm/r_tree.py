"""R-trees over whole-number vectors, packed by sorting and tiling, for inner products.

Points are sorted by one coordinate and cut into slabs, these sorted by the next and cut again,
until a tile is one leaf; some leaves next to each other share a parent, and so on. A node keeps
the least box around its points. The inner product of a query with any point of a box lies in
the sum of the intervals that the box's sides give for each coordinate.
"""

from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np

LEAF_POINTS, FANOUT, TILED = 64, 16, 4


def tiled(columns: list[np.ndarray], leaf: int) -> list[np.ndarray]:
    """Return the places of the points of each leaf, tiled by ``columns`` in turn."""
    tiles = [np.arange(len(columns[0]))]
    for at, column in enumerate(columns):
        cut = []
        for tile in tiles:
            pages = -(-len(tile) // leaf)
            slabs = int(np.ceil(pages ** (1 / (len(columns) - at))))
            size = leaf * -(-pages // slabs)
            order = tile[np.argsort(column[tile], kind="stable")]
            cut += [order[begin : begin + size] for begin in range(0, len(order), size)]
        tiles = cut
    return tiles


class RTree:
    """Points with an id and a group each; boxes have the groups' range as one more side."""

    def __init__(self, points: np.ndarray, group: np.ndarray, ids: np.ndarray, leaf: int = LEAF_POINTS):
        spread = np.argsort(-np.ptp(points, axis=0), kind="stable")[:TILED]
        leaves = tiled([group, *(points[:, at] for at in spread)], leaf)
        order = np.concatenate(leaves)
        self.points, self.group, self.ids = points[order], group[order], ids[order]
        # Of every node: its children, or if it is a leaf its points, from a place up to another.
        first = np.cumsum([0, *map(len, leaves)])
        low, high = (f.reduceat(self.points, first[:-1]) for f in (np.minimum, np.maximum))
        least, most = (f.reduceat(self.group, first[:-1]) for f in (np.minimum, np.maximum))
        levels = [(first[:-1], first[1:], low, high, least, most)]
        self.n_leaves, begin = len(leaves), 0
        while len(levels[-1][0]) > FANOUT:
            below = levels[-1]
            cuts = np.arange(0, len(below[0]), FANOUT)
            ends = np.append(cuts[1:], len(below[0]))
            sides = (
                f.reduceat(side, cuts)
                for f, side in zip((np.minimum, np.maximum) * 2, below[2:], strict=True)
            )
            levels.append((begin + cuts, begin + ends, *sides))
            begin += len(below[0])
        self.roots = slice(begin, begin + len(levels[-1][0]))
        self.begin, self.end, self.low, self.high, self.least, self.most = (
            np.concatenate(parts) for parts in zip(*levels, strict=True)
        )

    def bounds(self, nodes: slice, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Return the least and the greatest inner product that each node's box allows."""
        plus, minus = np.maximum(query, 0), np.minimum(query, 0)
        low, high = self.low[nodes], self.high[nodes]
        return low @ plus + high @ minus, high @ plus + low @ minus

    def search(self, query, group: int, same: bool, but_id: int, windows, best, k: int) -> int:
        """Put the ``k`` best points of each window into ``best``; return the leaves that were read.

        Taken are points of the same group as given, or of others, with another id than given. A
        window is the least and the greatest score to take. ``best`` has a list for each window,
        of (-score, id) in order, with what is known already. Nodes come by their greatest
        possible score; one is passed over if for each window it holds no score inside, or
        none as great as the kth that the list already has. Equal scores go by the lesser id.
        """
        floors = [_floor(window, found, k) for window, found in zip(windows, best, strict=True)]
        queue, number, read = [], count(), 0

        def push(nodes):
            lows, highs = self.bounds(nodes, query)
            if same:
                fits = (self.least[nodes] <= group) & (group <= self.most[nodes])
            else:
                fits = (self.least[nodes] != group) | (self.most[nodes] != group)
            some = np.zeros(len(lows), dtype=bool)
            for (_, top), floor in zip(windows, floors, strict=True):
                some |= (highs >= floor) & (lows <= top)
            for at in np.flatnonzero(some & fits).tolist():
                yield (-highs[at], next(number), nodes.start + at, lows[at])

        queue = list(push(self.roots))
        heapify(queue)
        while queue:
            high, _, node, low = heappop(queue)
            if -high < min(floors):
                break
            if not any(-high >= f and low <= top for f, (_, top) in zip(floors, windows, strict=True)):
                continue
            inside = slice(int(self.begin[node]), int(self.end[node]))
            if node >= self.n_leaves:
                for one in push(inside):
                    heappush(queue, one)
                continue
            read += 1
            scores = self.points[inside] @ query
            taken = ((self.group[inside] == group) == same) & (self.ids[inside] != but_id)
            for at, (_, top) in enumerate(windows):
                new = np.flatnonzero(taken & (scores >= floors[at]) & (scores <= top))
                if len(new):
                    pairs = zip((-scores[new]).tolist(), self.ids[inside][new].tolist(), strict=True)
                    best[at] = sorted([*best[at], *((int(s), i) for s, i in pairs)])[:k]
                    floors[at] = _floor(windows[at], best[at], k)
        return read


def _floor(window, found, k: int):
    """Return the least score that can still be taken into a list."""
    return max(window[0], -found[k - 1][0]) if len(found) == k else window[0]
