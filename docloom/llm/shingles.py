"""Sets of word shingles as sorted 64-bit hashes, for many texts at once.

Words are runs of anything but ASCII white space, A-Z lower-cased. A word's hash is a polynomial of random
64-bit numbers, one for each byte value; a shingle's mixes the hashes of its words in order. No table of
words is kept: a text's hashes follow from its bytes alone.
"""

from __future__ import annotations

import numpy as np

#: Words in a shingle.
WORDS = 5
#: Bytes that are hashed in one step; a longer text is cut between words.
STEP = 1 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*range(9, 14), 32]] = True
_rng = np.random.default_rng(20)
_LETTER = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_BASE, _LENGTH = (_rng.integers(1, 2**64, 2, dtype=np.uint64) | np.uint64(1)).tolist()
#: Powers of the base; those of longer words are products of two.
_NEAR = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(4095, _BASE, np.uint64))))
_FAR = np.uint64(_BASE * int(_NEAR[-1]) % 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hashed(raw: np.ndarray, blank: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hashes of the words that begin at ``starts``, the first of which is that of ``raw``'s first letter."""
    letters = raw[~blank]
    at = starts - np.cumsum(blank)[starts]
    lengths = np.diff(at, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    power = _NEAR[place & 4095]
    if lengths.max() > 4096:
        far = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(lengths.max()) >> 12, _FAR, np.uint64))))
        power = power * far[place >> 12]
    return mix(np.add.reduceat(_LETTER[letters] * power, at) + lengths.astype(np.uint64) * np.uint64(_LENGTH))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a byte string, and where each begins."""
    blank = _BLANK[raw]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    hashes, at = [], 0
    while at < len(starts):
        # As many words as a step holds, one at least.
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + STEP, side="right")) - 1)
        if end >= len(starts) - 1 and len(raw) - starts[at] <= STEP:
            end = len(starts)
        low, high = int(starts[at]), int(starts[end]) if end < len(starts) else len(raw)
        hashes.append(_hashed(raw[low:high], blank[low:high], starts[at:end] - low))
        at = end
    return np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64), starts


def _shingled(h: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(h) - width + 1)
    x = np.full(n, np.uint64(width), dtype=np.uint64)
    for k in range(width if n else 0):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return x


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate((np.ones(min(1, len(x)), dtype=bool), x[1:] != x[:-1]))]


def shingle_sets(texts: list[str | None]):
    """Yields (hashes of the words, sorted distinct hashes of the shingles) of each text.

    A text with fewer than ``WORDS`` words has its whole sequence as one shingle, one without words none.
    """
    at = 0
    while at < len(texts):
        raw, size = [], 0
        while at + len(raw) < len(texts) and (not raw or size < STEP):
            raw.append((texts[at + len(raw)] or "").encode("utf-8", "replace"))
            size += len(raw[-1])
        h, starts = word_hashes(np.frombuffer(b" ".join(raw), dtype=np.uint8))
        ends = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in raw]) - 1)
        x, low = _shingled(h, WORDS), 0
        for high in ends.tolist():
            n = high - low
            own = x[low : high - WORDS + 1] if n >= WORDS else _shingled(h[low:high], n) if n else x[:0]
            yield h[low:high], _distinct(own)
            low = high
        at += len(raw)
