"""Recompression of token sequences: consistent symbols for equal substrings.

Each round names pairs (and the first round also runs of one token) by what they hold, so a name
means the same content in every document and no directory of names has to be kept or shipped.  A
round splits the alphabet in two by a bit of each symbol's own hash; a left symbol followed by a
right one becomes one new symbol.  With every symbol goes the stretch of tokens that its parse
depends on: wherever a window of tokens holds that stretch whole, the same symbol stands at the same
offset.  A window that holds a symbol seen only once in the corpus therefore occurs only once.
"""

from __future__ import annotations

import numpy as np

from quillmesh.llm.common import U64, mix64

_RUN, _LEN = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)
_LEFT, _RIGHT = U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25)
_OUT = 1 << 29


def symbols(units: np.ndarray, rows: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, length, context start, context end) of the symbols after ``rounds`` rounds.

    ``rows`` numbers the document of each unit; symbols don't run over a document's end.  A context
    that reaches a document's end is moved out of every window's reach.
    """
    n = len(units)
    name, row = units, rows
    begin = np.arange(n, dtype=np.int32)
    end = begin + np.int32(1)
    lo, hi = begin.copy(), end.copy()
    if not n:
        return name, end - begin, lo, hi
    # runs of one token
    first = np.ones(n, bool)
    first[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    upto = np.append(at[1:], n)
    count = upto - at
    name, row, begin, end = name[at], row[at], begin[at], end[upto - 1]
    long = count > 1
    if long.any():
        name = name.copy()
        name[long] = mix64(name[long] * _RUN + count[long].astype(U64) * _LEN)
    lo, hi = begin - np.int32(1), end + np.int32(1)
    edge = np.ones(len(row), bool)
    edge[1:] = row[1:] != row[:-1]
    lo[edge] -= _OUT
    edge[:-1] = edge[1:]
    edge[-1] = True
    hi[edge] += _OUT
    for r in range(rounds):
        m = len(name)
        if m < 2:
            break
        right = ((mix64(name + U64(77777 * r + 1)) >> U64(40)) & U64(1)).astype(bool)
        joined = row[1:] == row[:-1]
        pair = joined & ~right[:-1] & right[1:]
        heads = np.zeros(m, bool)
        heads[:-1] = pair
        tails = np.zeros(m, bool)
        tails[1:] = pair
        new_lo, new_hi = lo.copy(), hi.copy()
        alone = np.flatnonzero(right & ~tails)  # depends on the symbol to its left
        prior = np.maximum(alone - 1, 0)
        new_lo[alone] = np.where((alone > 0) & (row[prior] == row[alone]), lo[prior], -_OUT)
        alone = np.flatnonzero(~right & ~heads)
        after = np.minimum(alone + 1, m - 1)
        new_hi[alone] = np.where((alone < m - 1) & (row[after] == row[alone]), hi[after], _OUT + n)
        i = np.flatnonzero(heads)
        new_name, new_end = name.copy(), end.copy()
        new_name[i] = mix64(name[i] * _LEFT + mix64(name[i + 1] + _RIGHT))
        new_end[i] = end[i + 1]
        new_hi[i] = hi[i + 1]
        keep = ~tails
        name, row, begin, end, lo, hi = new_name[keep], row[keep], begin[keep], new_end[keep], new_lo[keep], new_hi[keep]
    return name, end - begin, lo, hi
