"""Column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

Round j inserts one symbol of every string of at least j symbols: the row of its suffix of length j.
The rows' transform, common prefixes, owners and lengths lie in files of their own, which a round reads
from front to back and writes anew from front to back. The files are in memory unless a folder is named, so that
nothing is left on a worker's disk; the caller bounds the collection. A
row's place follows from the rank of its symbol in the transform so far; its common prefix with the row
above is one more than the least common prefix between the two rows that precede them, and so with
the row below.
"""

from __future__ import annotations

import os

import numpy as np

#: Marks the row of a whole string: no symbol stands before it. UTF-8 never has this byte.
END = 255
FIELDS = (("bwt", np.uint8), ("lcp", np.uint8), ("owner", np.int32), ("length", np.uint8))


class Files:
    """Two generations of the sequential files: a round reads one and overwrites the other."""

    def __init__(self, folder: str | None) -> None:
        self.turn = 0
        make = (lambda name: os.open(f"{folder}/{name}", os.O_RDWR | os.O_CREAT)) if folder else os.memfd_create
        self.open = {(name, turn): make(f"{name}.{turn}") for name, _ in FIELDS for turn in (0, 1)}

    def read(self, name: str, kind: type, rows: int) -> np.ndarray:
        out = np.empty(rows, kind)
        view, at = memoryview(out.view(np.uint8)), 0
        while at < len(view):
            at += os.preadv(self.open[name, self.turn], [view[at:]], at)
        return out

    def write(self, name: str, values: np.ndarray) -> None:
        view, at = memoryview(np.ascontiguousarray(values).view(np.uint8)), 0
        while at < len(view):
            at += os.pwrite(self.open[name, 1 - self.turn], view[at:], at)

    def advance(self) -> None:
        self.turn = 1 - self.turn

    def close(self) -> None:
        for fd in self.open.values():
            os.close(fd)


def _least(lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least common prefix over rows low + 1 .. high of each pair."""
    if not len(low):
        return np.zeros(0, np.uint8)
    cuts = np.empty(2 * len(low), np.int64)
    cuts[0::2], cuts[1::2] = low + 1, high + 1
    return np.minimum.reduceat(lcp, cuts)[0::2]


def construct(strings: list[bytes], folder: str | None = None) -> dict[str, np.ndarray]:
    """bwt, lcp, owner and length of all suffixes' rows in their order, the empty ones first.

    Strings have at most 254 symbols, none of them 255. The end of an earlier string sorts lower."""
    m = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    longest = int(sizes.max(initial=0))
    right = np.full((longest + 1, m), END, np.uint8)  # right[j]: symbol that precedes the suffix of length j
    flat, at = np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    for j in range(longest):
        own = np.flatnonzero(sizes > j)
        right[j, own] = flat[at[own + 1] - 1 - j]
    files = Files(folder)
    for name, values in (("bwt", right[0]), ("lcp", np.zeros(m, np.uint8)), ("owner", np.arange(m, dtype=np.int32)), ("length", np.zeros(m, np.uint8))):
        files.write(name, values)
    files.advance()
    n = m
    active, position = np.arange(m), np.arange(m)
    for j in range(1, longest + 1):
        keep = sizes[active] >= j
        active, position = active[keep], position[keep]
        bwt, lcp = files.read("bwt", np.uint8, n), files.read("lcp", np.uint8, n)
        # Rows in the order of the symbol before them, ties in their own order, and where mine are.
        order = np.argsort(bwt, kind="stable")
        symbol = bwt[position]
        first = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=256))])
        mine = np.empty(len(position), np.int64)
        by_symbol = np.argsort(symbol, kind="stable")
        edges = np.searchsorted(symbol[by_symbol], np.arange(257))
        for c in np.flatnonzero(np.diff(edges)):
            some = by_symbol[edges[c] : edges[c + 1]]
            mine[some] = first[c] + np.searchsorted(order[first[c] : first[c + 1]], position[some])
        above, below = order[np.maximum(mine - 1, 0)], order[np.minimum(mine + 1, len(bwt) - 1)]
        has_above, has_below = (mine > 0) & (bwt[above] == symbol), (mine + 1 < len(bwt)) & (bwt[below] == symbol)
        padded = np.append(lcp, np.uint8(0))
        own, under = np.zeros(len(mine), np.uint8), np.zeros(len(mine), np.uint8)
        own[has_above] = _least(padded, above[has_above], position[has_above]) + np.uint8(1)
        under[has_below] = _least(padded, position[has_below], below[has_below]) + np.uint8(1)
        position = mine + m
        old = np.ones(len(bwt) + len(position), bool)
        old[position] = False
        for name, kind in FIELDS:
            before = {"bwt": bwt, "lcp": lcp}.get(name)
            before = files.read(name, kind, n) if before is None else before
            after = np.empty(len(old), kind)
            after[old] = before
            if name == "bwt":
                after[position] = right[j, active]
            elif name == "lcp":
                after[position] = own
                next_ = position + 1 < len(old)
                after[position[next_] + 1] = under[next_]
            elif name == "owner":
                after[position] = active
            else:
                after[position] = j
            files.write(name, after)
        files.advance()
        n = len(old)
    rows = {name: files.read(name, kind, n) for name, kind in FIELDS}
    files.close()
    return rows


def repeats(rows: dict[str, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, owner, length) of the suffixes whose first `width` symbols some other suffix shares."""
    near = rows["lcp"] >= width
    member = near.copy()
    member[:-1] |= near[1:]
    at = np.flatnonzero(member)
    return np.cumsum(~near[at]), rows["owner"][at], rows["length"][at].astype(np.int64)
