"""A hierarchical index over 64-bit fingerprints in Gray order.

In Gray order neighbours differ in few bits, so a stretch of the order shares long runs of bits.  The
shared bits of a stretch are kept once, in its node, under a mask; nodes of nodes share theirs in
turn.  A search adds up the bits in which the query differs from the masks on its way down and leaves
a whole stretch as soon as the sum is over the limit.
"""

from __future__ import annotations

import numpy as np

from quillmesh.llm.common import U64

HALF = 32
STEP = 2
#: (query, node) pairs handled at once
FRONT = 400_000


def turned(x: np.ndarray, half: int) -> np.ndarray:
    """The fingerprint with the half that leads in front."""
    return x if half == 0 else (x << U64(HALF)) | (x >> U64(64 - HALF))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in the reflected Gray order."""
    out = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> U64(shift)
    return out


def top_mask(bits: int) -> np.uint64:
    return U64(((1 << bits) - 1) << (64 - bits)) if bits else U64(0)


class Router:
    """The upper nodes: which shards a fingerprint has to visit."""

    def __init__(self, leaves: dict[int, list[int]]):
        self.leaves = {d: np.sort(np.array(p, U64)) for d, p in leaves.items() if p}
        self.inner: dict[int, np.ndarray] = {}
        for d, p in self.leaves.items():
            for up in range(0, d, STEP):
                self.inner[up] = np.union1d(self.inner.get(up, np.zeros(0, U64)), p >> U64(d - up))
        self.deepest = max(self.leaves, default=0)

    @staticmethod
    def _in(x: np.ndarray, known: np.ndarray | None) -> np.ndarray:
        if known is None or not len(known):
            return np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        return known[at] == x

    def visit(self, lead: np.ndarray, within: int):
        """(row, depth, prefix) of the shards within ``within`` bits of each leading pattern."""
        rows = np.arange(len(lead))
        prefix = np.zeros(len(lead), U64)
        out = []
        depth = 0
        while len(rows):
            leaf = self._in(prefix, self.leaves.get(depth))
            if leaf.any():
                out.append((rows[leaf], np.full(int(leaf.sum()), depth), prefix[leaf]))
            on = self._in(prefix, self.inner.get(depth))
            rows, prefix = rows[on], prefix[on]
            if not len(rows) or depth >= self.deepest:
                break
            depth += STEP
            rows = np.repeat(rows, 1 << STEP)
            prefix = (prefix[:, None] << U64(STEP) | np.arange(1 << STEP, dtype=U64)[None, :]).reshape(-1)
            near = np.bitwise_count((lead[rows] >> U64(64 - depth)) ^ prefix) <= within
            rows, prefix = rows[near], prefix[near]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
        return tuple(np.concatenate(x) for x in zip(*out))


class Unions:
    """Labels of components; the smallest place in each is its label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def lead_within(half: int, within: int) -> int:
    """Bits by which the leading half may differ: links of more than this many in the first half have
    fewer in the second than its share."""
    return within // 2 if half == 0 else within - within // 2 - 1


def linked(members: np.ndarray, visitors: np.ndarray, half: int, depth: int, within: int) -> np.ndarray:
    """Labels over members and then visitors: equal where links of at most ``within`` bits connect them.

    Links between two visitors are left to other shards.  Members share their first ``depth`` leading
    bits.  Only links with at most ``lead_within`` bits in the leading half count here; the other half
    finds the rest.
    """
    n = len(members)
    turned_members = turned(members, half)
    order = np.argsort(gray_rank(turned_members), kind="stable")
    sorted_bits = turned_members[order]
    queries = np.concatenate([sorted_bits, turned(visitors, half)])
    unions = Unions(len(queries))
    levels = list(range(depth, 64, STEP))[1:] + [64] if depth < 64 else [64]
    starts, ends, patterns = [], [], []
    for d in levels:
        top = sorted_bits & top_mask(d)
        new = np.ones(n, bool)
        new[1:] = top[1:] != top[:-1]
        at = np.flatnonzero(new)
        starts.append(at)
        ends.append(np.append(at[1:], n))
        patterns.append(top[at])
    # stretches that differ in no more bits than a link may are one component
    for s, e in zip(starts, ends):
        vary = np.bitwise_or.reduceat(sorted_bits ^ np.repeat(sorted_bits[s], e - s), s)
        one = (np.bitwise_count(vary) <= within) & (e - s > 1)
        if one.any():
            inside = np.flatnonzero(np.repeat(one, e - s))
            first = np.repeat(s, e - s)[inside]
            unions.join(inside, first)
    lead = top_mask(HALF)
    children = [np.searchsorted(starts[k + 1], starts[k]) for k in range(len(levels) - 1)]
    upto = [np.searchsorted(starts[k + 1], ends[k]) for k in range(len(levels) - 1)]
    one_of: list[np.ndarray] = []

    def settle() -> None:
        """Which nodes lie in one component by now."""
        one_of.clear()
        for s in starts:
            low, high = np.minimum.reduceat(unions.label[:n], s), np.maximum.reduceat(unions.label[:n], s)
            one_of.append(low == high)

    settle()
    todo = [(0, q, np.zeros(0, np.int64)) for q in np.array_split(np.arange(len(queries)), max(1, len(queries) * max(1, len(starts[0])) // FRONT + 1))][::-1]
    joined = 0
    while todo:
        k, q, node = todo.pop()
        if k == 0 and not len(node):
            m = len(starts[0])
            q, node = np.repeat(q, m), np.tile(np.arange(m), len(q))
        differ = np.bitwise_count((queries[q] ^ patterns[k][node]) & top_mask(levels[k]))
        ahead = np.bitwise_count((queries[q] ^ patterns[k][node]) & top_mask(min(levels[k], HALF)) & lead)
        keep = (differ <= within) & (ahead <= lead_within(half, within))
        keep &= ~((q < n) & (ends[k][node] <= q))  # pairs of members are met from the smaller place
        keep &= ~(one_of[k][node] & (unions.label[q] == unions.label[starts[k][node]]))
        q, node = q[keep], node[keep]
        if not len(q):
            continue
        if levels[k] == 64:
            unions.join(q, starts[k][node])
            joined += 1
            if joined % 8 == 0:
                settle()
            continue
        size = upto[k][node] - children[k][node]
        total = np.cumsum(size)
        parts = np.searchsorted(total, np.arange(FRONT, int(total[-1]) + FRONT, FRONT))
        lo = 0
        pieces = []
        for hi in np.unique(np.minimum(parts + 1, len(q))).tolist():
            if hi > lo:
                w = size[lo:hi]
                first = np.repeat(children[k][node[lo:hi]], w)
                inside = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                pieces.append((k + 1, np.repeat(q[lo:hi], w), first + inside))
                lo = hi
        todo += pieces[::-1]
    label = np.empty(len(queries), np.int64)
    own = np.concatenate([order, np.arange(n, len(queries))])
    label[own] = own[unions.label]
    return label
