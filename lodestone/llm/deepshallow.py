"""Deep-shallow sorting of fixed-length suffix windows.

The shallow part is a multikey quicksort on eight-byte characters: a group is
split into the rows below, at and above a pivot's character, and those at it go
on with the next one; small groups are sorted by all characters left at once.
After ``SHALLOW`` characters the rows that still agree form groups with a
long common prefix; a blind trie orders each of them, comparing a new string
with a single leaf of the trie. Equal strings share a leaf.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 2


class BlindTrie:
    """Strings of one length; inner nodes keep a position and one child for each byte seen there, edges are not labelled."""

    __slots__ = ("items", "root")

    def __init__(self):
        self.root, self.items = None, []

    def insert(self, s: bytes, item: int) -> None:
        if self.root is None:
            self.root = (s, [item])
            return
        path, node = [], self.root
        while isinstance(node, list):  # [position, children]: follow the byte, or any child where it is missing: all leaves below share the prefix
            path.append(node)
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        t = node[0]
        if t == s:
            node[1].append(item)
            return
        at = next(i for i, (x, y) in enumerate(zip(s, t)) if x != y)
        above, below = None, self.root
        for n in path:
            if n[0] >= at:
                break
            above, below = n, n[1].get(s[n[0]])
        if below is not None and isinstance(below, list) and below[0] == at:
            below[1][s[at]] = (s, [item])
            return
        if below is None:
            above[1][s[above[0]]] = (s, [item])
            return
        split = [at, {t[at]: below, s[at]: (s, [item])}]
        if above is None:
            self.root = split
        else:
            above[1][s[above[0]]] = split

    def leaves(self):
        """Items of equal strings, in the order of the strings."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node[1]


#: Groups up to this size are not split any further.
SMALL = 512


def multikey(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """chars: (m, depth) -> (order, first): the rows in the order of their characters, and where a new row of characters begins."""
    m, depth = chars.shape
    order, first = np.arange(m), np.zeros(m, bool)
    todo = [(0, m, 0)] if m else []
    while todo:
        lo, hi, d = todo.pop()
        at = order[lo:hi]
        if d == depth:
            first[lo] = True
            continue
        if len(at) <= SMALL:
            left = chars[at, d:]
            by = np.lexsort(left.T[::-1])
            order[lo:hi], left = at[by], left[by]
            first[lo] = True
            first[lo + 1 : hi] = (left[1:] != left[:-1]).any(axis=1)
            continue
        c = chars[at, d]
        pivot = np.sort(c[np.linspace(0, len(c) - 1, 9).astype(np.int64)])[4]
        below, above = at[c < pivot], at[c > pivot]
        i, j = lo + len(below), hi - len(above)
        order[lo:hi] = np.concatenate([below, at[c == pivot], above])
        todo += [(x, y, e) for x, y, e in ((lo, i, d), (i, j, d + 1), (j, hi, d)) if x < y]
    return order, first


def sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows: (m, length) bytes -> (order, first): the sorted order, and for each place of it whether a new string begins there."""
    m, length = rows.shape
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    depth = min(SHALLOW, -(-length // 8))
    wide = np.zeros((m, depth * 8), np.uint8)
    wide[:, : min(length, depth * 8)] = rows[:, : depth * 8]
    order, first = multikey(wide.view(">u8").astype(np.uint64))
    if depth * 8 < length:
        tails = np.ascontiguousarray(rows[:, depth * 8 :])
        blob, n = tails.tobytes(), tails.shape[1]
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, m))
        for at, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            members = order[at : at + size].tolist()
            if size == 2:
                a, b = members
                x, y = blob[a * n : a * n + n], blob[b * n : b * n + n]
                if x != y:
                    first[at + 1] = True
                    if y < x:
                        order[at], order[at + 1] = b, a
                continue
            trie = BlindTrie()
            for i in members:
                trie.insert(blob[i * n : i * n + n], i)
            place = at
            for leaf in trie.leaves():
                order[place : place + len(leaf)] = leaf
                first[place] = True
                first[place + 1 : place + len(leaf)] = False
                place += len(leaf)
    return order, first
