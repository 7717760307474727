"""Encoding of whole texts with the ``tokenizers`` library, word by word through a bounded memory.

Both vocabularies split a text at white space before any merge, so a text's ids are its words' ids in
a row. A word that comes again costs one dictionary lookup; words not seen yet are encoded together.
Texts for which that does not hold to the letter (runs of blanks, rare white space, special tokens)
are encoded in one piece.
"""

from __future__ import annotations

import os
import re

#: White space (or what some library takes for it) besides the plain blank and newline.
_ODD_SPACE = frozenset(
    map(
        chr,
        [
            *range(9, 10), *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F,
            0x205F, 0x2060, 0x3000, 0xFEFF
        ]
    )
)
#: Here lower() works letter by letter and nothing is composed or decomposed.
_LAST_LATIN = "ɏ"
_TWO_MARKS = re.compile(r"(?:[^\w\s]|_)(?:[^\w\s]|_)")
#: Divides the words that are encoded in one call.
_MARK = "\x01"


#: Words that an encoder remembers.
KEEP = 1_000_000

_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, dtype: str = "<u4", keep: int = KEEP) -> WordEncoder:
    """This process's encoder: tasks that a Python worker runs one after another share its memory."""
    if (path, dtype, keep) not in _encoders:
        _encoders[path, dtype, keep] = WordEncoder(path, dtype, keep)
    return _encoders[path, dtype, keep]


class WordEncoder:
    """Ids of texts as little-endian arrays of ``dtype``, equal to ``Tokenizer.encode`` of the whole text.

    ``keep`` bounds the number of remembered words; beyond it the memory starts anew.
    """

    def __init__(self, path: str, dtype: str = "<u4", keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.np, self.dtype, self.keep = np, np.dtype(dtype), keep
        self.tokenizer = Tokenizer.from_file(path)
        #: Words behind a blank; first words of texts (the same, where blanks are dropped).
        self.known: dict[str, bytes] = {}
        #: Whether a blank belongs to the word behind it (byte-level vocabularies) or is dropped.
        self.blank = self._ids(" a") != self._ids("a")
        self.heads: dict[str, bytes] = {} if self.blank else self.known
        self.ends: dict[str, bytes] = {}
        self.mark = self._ids(" " + _MARK)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, ids) -> bytes:
        return self.np.asarray(ids, dtype=self.dtype).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Learns words behind a blank; what follows a word's letters is looked up by itself."""
        known, ended, broken, parts = self.known, [], [], set()
        for w in words if self.blank else ():
            if w[-1:] in (",", ".") and w[:-1].isalpha():
                ended.append(w)
                parts.add(w[:-1])
            elif "\n" in w[1:-1] and w.count("\n") == 1:
                broken.append(w)
                parts.add(w.partition("\n")[0])
        parts.difference_update(ended)
        self._encode({*words, *parts}.difference(ended, broken) if parts else words)
        for w in ended:
            known[w] = known[w[:-1]] + self._end(w[-1])
        if broken:
            first = {w.partition("\n")[2] for w in broken}
            self._alone(self.heads, [w for w in first if w not in self.heads], "")
            for w in broken:
                left, _, right = w.partition("\n")
                known[w] = known[left] + self._end("\n") + self.heads[right]

    def _end(self, mark: str) -> bytes:
        if mark not in self.ends:
            self.ends[mark] = self._bytes(self._ids(mark))
        return self.ends[mark]

    def _encode(self, words) -> None:
        np, size = self.np, self.dtype.itemsize
        plain, rest = [], []
        for w in words:
            if w not in self.known:
                (rest if not w or _MARK in w or "\n" in w else plain).append(w)
        parts = [plain[at : at + 500] for at in range(0, len(plain), 500)]
        gap = f" {_MARK} "
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([" " + gap.join(part) for part in parts], add_special_tokens=False), strict=True):
            ids, width = np.asarray(found.ids, dtype=np.int64), len(self.mark)
            at = ids == self.mark[0]
            for k in range(1, width):
                at[:-k] &= ids[k:] == self.mark[k]
            cut = np.flatnonzero(at)
            if len(cut) != len(part) - 1:  # a word looks like the mark
                rest += part
                continue
            packed = ids.astype(self.dtype).tobytes()
            starts, ends = [0, *((cut + width) * size).tolist()], [*(cut * size).tolist(), len(packed)]
            self.known.update((w, packed[a:b]) for w, a, b in zip(part, starts, ends, strict=True))
        self._alone(self.known, rest, " " if self.blank else "")

    def _alone(self, known: dict[str, bytes], words: list[str], before: str) -> None:
        found = self.tokenizer.encode_batch_fast([before + w for w in words], add_special_tokens=False)
        known.update((w, self._bytes(e.ids)) for w, e in zip(words, found, strict=True))

    def _split(self, text: str) -> list[str] | None:
        letters = set(text)
        if not letters.isdisjoint(_ODD_SPACE) or "<|" in text or "<start" in text:
            return None
        if self.blank:
            return None if "  " in text or "\n " in text else text.split(" ")
        if max(letters) <= _LAST_LATIN:
            text = text.lower()
            if not _TWO_MARKS.search(text):
                text = text.replace(",", " , ").replace(".", " . ")
        return text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, packed; null counts as empty."""
        if len(self.known) > self.keep:
            self.known.clear()
        if len(self.heads) > self.keep:
            self.heads.clear()
        known, heads = self.known, self.heads
        split = [self._split(text) if text else [] for text in texts]
        missing: set[str] = set()
        for words in split:
            if words:
                missing.update(words[1:] if self.blank else words)
        if missing := [w for w in missing if w not in known]:
            self._learn(missing)
        if self.blank and (first := [w for w in {words[0] for words in split if words} if w not in heads]):
            self._alone(heads, first, "")
        out = []
        for text, words in zip(texts, split, strict=True):
            if words is None:
                out.append(self._bytes(self._ids(text)))
            elif self.blank and words:
                out.append(heads[words[0]] + b"".join(map(known.__getitem__, words[1:])))
            else:
                out.append(b"".join(map(known.__getitem__, words)))
        return out
