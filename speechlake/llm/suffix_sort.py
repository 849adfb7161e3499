"""Deep-shallow sorting of many short suffixes: multikey quicksort first, blind tries for what stays together."""

from __future__ import annotations

import numpy as np

#: Eight-byte words that the multikey quicksort looks at.
SHALLOW_WORDS = 6


class BlindTrie:
    """Orders strings by branching bytes alone: a search descends without comparing, one comparison with the leaf
    it ends at tells where the string belongs. Equal strings share a leaf."""

    __slots__ = ("strings", "root")

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None
        for k in range(len(strings)):
            self._insert(k)

    @staticmethod
    def _common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return n
        x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        return n - (x.bit_length() + 7) // 8

    def _insert(self, k: int) -> None:
        s = self.strings[k]
        if self.root is None:
            self.root = [k]
            return
        node = self.root
        while isinstance(node, tuple):  # (depth, {branching byte: child}); -1 is the end of a string
            depth, children = node
            byte = s[depth] if depth < len(s) else -1
            node = children.get(byte) or next(iter(children.values()))
        other = self.strings[node[0]]
        if s == other:
            node.append(k)
            return
        lcp = self._common(s, other)
        node, holder, via = self.root, None, None
        while isinstance(node, tuple) and node[0] < lcp:
            holder, via = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][via]
        mine = s[lcp] if lcp < len(s) else -1
        if isinstance(node, tuple) and node[0] == lcp:
            node[1][mine] = [k]
            return
        theirs = other[lcp] if lcp < len(other) else -1
        split = (lcp, {mine: [k], theirs: node})
        if holder is None:
            self.root = split
        else:
            holder[1][via] = split

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            elif node:
                out += node
        return out


def deep_shallow_sort(matrix: np.ndarray, lens: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): strings (rows of ``matrix``, zero beyond ``lens``) in order within each group, groups in order,
    and what each has in common with the one before it (-1 for the first of a group).

    The quicksort takes eight bytes as one character and sorts all parts of one depth in a single pass; parts
    that have more than one string after SHALLOW_WORDS characters go to blind tries.
    """
    n, width = matrix.shape
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = matrix
    words = words.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    part = group[order]
    first = np.concatenate([[True], part[1:] != part[:-1]])

    def open_places():
        return np.flatnonzero(~first | np.concatenate([~first[1:], [False]]))

    for depth in range(min(SHALLOW_WORDS, words.shape[1])):
        at = open_places()
        if not len(at):
            break
        label = np.cumsum(first)[at]
        w = words[order[at], depth]
        turn = np.lexsort((w, label))
        order[at] = order[at][turn]
        w = w[turn]
        first[at[1:]] |= (w[1:] != w[:-1]) & (label[1:] == label[:-1])
    at = open_places()
    if len(at):
        depth, begins = 8 * min(SHALLOW_WORDS, words.shape[1]), at[first[at]]
        ends = np.append(begins[1:], 0)
        label = np.cumsum(first)
        ends = np.searchsorted(label, label[begins], side="right")
        for a, z in zip(begins.tolist(), ends.tolist(), strict=True):
            rows = order[a:z]
            low = np.minimum(lens[rows], depth)
            if (low < depth).any():  # some end before: their length decides
                strings = [matrix[r, : lens[r]].tobytes() for r in rows]
            else:
                strings = [matrix[r, depth : lens[r]].tobytes() for r in rows]
            order[a:z] = rows[BlindTrie(strings).order()]
    lcp = np.full(n, -1, np.int64)
    if n > 1:
        step = max(1, (1 << 23) // max(1, width))
        for a in range(1, n, step):
            z = min(n, a + step)
            x, y = order[a - 1 : z - 1], order[a:z]
            apart = matrix[x] != matrix[y]
            lcp[a:z] = np.where(apart.any(1), apart.argmax(1), width)
            lcp[a:z] = np.minimum(lcp[a:z], np.minimum(lens[x], lens[y]))
        lcp[1:][part[1:] != part[:-1]] = -1
    return order, lcp
