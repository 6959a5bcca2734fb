"""Burkhard-Keller trees over 64-bit fingerprints under the Hamming distance, many at once.

A tree's root is its first fingerprint; a child hangs on the edge that is labelled with its
distance to the parent, and all that lies below that edge has exactly this distance to the
parent. A search within a radius therefore follows only the edges whose label is within the
radius of the distance between query and node. All trees of a forest are built, and all queries
of a block searched, level by level on whole arrays.
"""

from dataclasses import dataclass

import numpy as np

_LABELS = 65


@dataclass
class Forest:
    """Trees of fingerprints: for each node its root, and the edges sorted by parent and label."""

    prints: np.ndarray
    root: np.ndarray
    edge: np.ndarray
    child: np.ndarray


def heads(values: np.ndarray) -> np.ndarray:
    """Return where a new value begins in a sorted array."""
    first = np.ones(len(values), dtype=bool)
    first[1:] = values[1:] != values[:-1]
    return first


def build(group: np.ndarray, prints: np.ndarray, is_node: np.ndarray | None = None) -> Forest:
    """Build a tree for each group; ``group`` is sorted, its fingerprints are distinct.

    With ``is_node``, only these fingerprints are in the trees; the others can be queries. The
    root is -1 where a group has no node.
    """
    nodes = np.arange(len(group)) if is_node is None else np.flatnonzero(is_node)
    first = heads(group[nodes])
    roots = np.append(nodes[first], -1)
    root = roots[np.searchsorted(group[roots[:-1]], group)]
    root[group[root] != group] = -1
    rest = nodes[~first]
    node = root[rest]
    edges, children = [], []
    while len(rest):
        edge = node * _LABELS + np.bitwise_count(prints[rest] ^ prints[node])
        order = np.argsort(edge, kind="stable")
        rest, edge = rest[order], edge[order]
        first = heads(edge)
        edges.append(edge[first])
        children.append(rest[first])
        node = rest[first][np.cumsum(first) - 1][~first]
        rest = rest[~first]
    edge = np.concatenate(edges or [np.empty(0, np.int64)])
    child = np.concatenate(children or [np.empty(0, np.int64)])
    order = np.argsort(edge, kind="stable")
    return Forest(prints, root, edge[order], child[order])


def links(
    forest: Forest, queries: np.ndarray, radius: int, every: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Return pairs (query, node) that join all fingerprints within the radius of each other.

    Every pair is within the radius, and two fingerprints of a tree within it are joined by
    such pairs, once all of the tree have been queries. A node that is near the query stands
    for all below its edges up to the radius, for these are near the node; so a dense ball
    costs each query one pair, not one for each member. With ``every``, all pairs within the
    radius are returned, for a check that drops some of them.
    """
    left, right = [], []
    query, node = queries, forest.root[queries]
    while len(query):
        distance = np.bitwise_count(forest.prints[query] ^ forest.prints[node]).astype(np.int64)
        near = distance <= radius
        other = near & (query != node)
        left.append(query[other])
        right.append(node[other])
        least = np.where(near, 1 if every else radius + 1, distance - radius)
        begin = np.searchsorted(forest.edge, node * _LABELS + least)
        end = np.searchsorted(
            forest.edge, node * _LABELS + np.minimum(distance + radius, _LABELS - 1), side="right"
        )
        count = np.maximum(end - begin, 0)
        ends = np.cumsum(count)
        at = np.arange(ends[-1]) + np.repeat(begin - (ends - count), count)
        query, node = np.repeat(query, count), forest.child[at]
    return np.concatenate(left), np.concatenate(right)


def least_labels(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Return for each of ``size`` nodes the least node that the pairs join it with."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
