"""Canonical, length-limited Huffman codes over token ids; blocks of bits with checkpoints.

Every array operation works on a whole block: encoding adds each code's bits to the bytes it touches,
decoding walks all stretches between two checkpoints side by side, one table lookup per id.
"""

from __future__ import annotations

import numpy as np

#: Longest code in bits (tables of 2**20 entries), ids between two checkpoints.
LONGEST, STRETCH = 20, 64


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (package merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols need more than {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    items, leaf_flags = weights, []
    for _ in range(longest - 1):
        leaf_flags.append(None)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weights, pairs))
        rank = np.argsort(both, kind="stable")
        leaf_flags[-1] = rank < len(weights)
        items = both[rank]
    take = 2 * len(weights) - 2
    for flags in reversed(leaf_flags):
        leaves = int(flags[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    lengths[order[:take]] += 1
    return lengths


class Code:
    """Codes in order of (length, id); made from the lengths alone."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, dtype=np.uint8)
        self.order = np.flatnonzero(self.lengths)
        self.order = self.order[np.argsort(self.lengths[self.order], kind="stable")]
        own = self.lengths[self.order].astype(np.int64)
        self.bits = max(1, int(own.max(initial=1)))
        spans = np.int64(1) << (self.bits - own)
        first = np.concatenate(([0], np.cumsum(spans)[:-1])) if len(own) else own
        self.codes = np.zeros(len(self.lengths), dtype=np.uint32)
        self.codes[self.order] = first >> (self.bits - own)
        self._spans = spans

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of a block, and the bit offset of every ``STRETCH``-th id."""
        n = self.lengths[ids].astype(np.int64)
        starts = np.cumsum(n) - n
        total = int(starts[-1] + n[-1]) if len(ids) else 0
        value = self.codes[ids].astype(np.uint32) << (32 - (starts & 7) - n).astype(np.uint32)
        first, size = starts >> 3, (total + 7) // 8 + 4
        out = np.zeros(size)
        for k in range(4):
            out += np.bincount(first + k, weights=(value >> np.uint32(24 - 8 * k)) & np.uint32(255), minlength=size)[:size]
        return out[: (total + 7) // 8].astype(np.uint8), starts[::STRETCH].astype(np.uint32)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The id and the code length for every window of ``bits`` bits."""
        size = 1 << self.bits
        ids, lengths = np.zeros(size, dtype=np.uint32), np.ones(size, dtype=np.uint32)
        filled = np.repeat(self.order, self._spans)
        ids[: len(filled)] = filled
        lengths[: len(filled)] = np.repeat(self.lengths[self.order], self._spans)
        return ids, lengths


def decode(tables: tuple[np.ndarray, np.ndarray], bits: int, data: np.ndarray, checkpoints: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    ids, lengths = tables
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8))).astype(np.uint32)
    words = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    at = checkpoints.astype(np.uint32)
    last, drop = np.uint32(len(words) - 1), np.uint32(32 - bits)
    out = np.empty((STRETCH, len(at)), dtype=np.uint32)
    for k in range(STRETCH):
        window = (words[np.minimum(at >> 3, last)] << (at & np.uint32(7))) >> drop
        out[k] = ids[window]
        at += lengths[window]
    return out.T.reshape(-1)[:n]
