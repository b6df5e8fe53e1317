"""Small groups of linked points inside one task."""

from __future__ import annotations

import numpy as np


def spanning_edges(adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of a forest of the bipartite graph of a boolean matrix, at most one edge per node.

    Columns are numbered after the rows. Smallest labels spread until nothing changes; a node's edge leads to its label.
    """
    n, m = adjacent.shape
    rows, columns = np.flatnonzero(adjacent.any(axis=1)), np.flatnonzero(adjacent.any(axis=0))
    none = np.empty(0, dtype=np.int64)
    if not len(rows):
        return none, none
    inner = adjacent[np.ix_(rows, columns)]
    nodes = np.concatenate([rows, columns + n])
    k, label = len(rows), np.arange(len(nodes))
    while True:
        before = label
        left, right = label[:k], label[k:]
        left = np.minimum(left, np.where(inner, right, len(nodes)).min(axis=1))
        right = np.minimum(right, np.where(inner, left[:, None], len(nodes)).min(axis=0))
        label = np.concatenate([left, right])
        label = np.minimum(label, label[label])
        if (label == before).all():
            break
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]
