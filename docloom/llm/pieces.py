"""Operator 1: SentencePiece encoding and decoding by a shared-prefix forward pass.

Words are marked (a blank becomes U+2581 and starts a word). The distinct words of a batch are sorted,
which lays them out as a trie in depth-first order: a word keeps the forward rows of the prefix it shares
with the word before it and computes only the rest. A row holds the best path to one position.

* Unigram models: the usual Viterbi rule, largest sum of piece scores; unknown characters cost ten less
  than the worst piece.
* BPE models: a prefix has exactly one encoding, and its last piece decides whether it is reachable. Of
  the pieces that end at a position, the right one is that which, put behind the path's last piece, is
  not rewritten by the merge order. So the forward row is that piece, and paths are as long as for a
  unigram model. Sums of BPE scores would give other pieces than the library does.

Characters without a piece become byte pieces where the model has them, else the unknown id. Null texts
count as empty and have no pieces. Decoding joins pieces and bytes and drops the blank before the first
word; texts come back whole but for characters that UTF-8 cannot hold.
"""

from __future__ import annotations

import re
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Chunks, words and pairs of pieces that a Python worker remembers, each.
MEMORY = 400_000
#: Marks that may end a word; those that no piece has behind a letter are cut off before words are compared.
_ENDS = ",.;:!?\"')|\n"


class Pieces:
    """A model's pieces, read with the library; the encoding itself is done here."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.score = [model.get_score(i) for i in range(n)]
        self.unknown = model.unk_id()
        self.special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.bytes = {int(self.text[i][3:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.id = {t: i for i, t in enumerate(self.text) if i not in self.special and i not in self.of_byte}
        #: Beginnings of pieces: the piece's id, or -1 where a piece only goes on.
        self.begun = dict.fromkeys((t[:k] for t in self.id for k in range(1, len(t))), -1) | self.id
        # A BPE model's scores are the pieces' ranks; a unigram model's are logarithms of probabilities.
        scores = [self.score[i] for i in self.id.values() if len(self.text[i]) > 1]
        self.is_bpe = bool(scores) and all(s == int(s) and s <= 0 for s in scores)
        self.raw = [
            bytes([self.of_byte[i]]) if i in self.of_byte else " ⁇ ".encode() if i == self.unknown else b"" if i in self.special else t.replace(MARK, " ").encode() for i,
            t in enumerate(self.text)
        ]
        self.worst = min(self.score) - 10
        self.dummy_blank = model.encode("a", out_type=str)[0].startswith(MARK)
        long = [t for t in self.id if len(t) > 1]
        ends = [c for c in _ENDS if not any(x.isalpha() and y == c for t in long for x, y in zip(t, t[1:], strict=False))]
        alone = "\n" if not any("\n" in t for t in long) else ""
        cut = rf"{MARK}*[^\W\d_]+(?=[{re.escape(''.join(ends))}])|" if ends else ""
        self.word = re.compile(f"{alone}|{cut}{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{cut}{MARK}*[^{MARK}]+|{MARK}+")
        #: The pieces as a trie: a node's children by character, its own piece's id under "".
        self.trie: dict = {}
        for t, i in self.id.items():
            node = self.trie
            for ch in t:
                node = node.setdefault(ch, {})
            node[""] = i
        self.fits_known: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the best pair of neighbours merges first, from left to right."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return parts
            if len(parts) == 2 and best is not None:
                self.halves[self.id[text]] = self.id.get(parts[0], -1), self.id.get(parts[1], -1)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def alone(self, i: int) -> bool:
        """Whether a piece is the encoding of its own text."""
        if i not in self.whole:
            self.whole[i] = self.merged(self.text[i]) == [self.text[i]]
        return self.whole[i]

    def _half(self, i: int, side: int) -> int:
        """What a piece's last merge joined, or the piece itself if it is one character."""
        if len(self.text[i]) == 1:
            return i
        if i not in self.halves:
            self.alone(i)
        return self.halves[i][side]

    def fits(self, left: int, right: int) -> bool:
        """Whether two pieces side by side stay as they are.

        Their merges are undone from the last one on. Neighbours at the border that would have merged
        before the merge that took one of them away give another encoding. Of equal ranks the merge
        further left comes first.
        """
        if left < 0 or right < 0:
            return True
        key = left << 32 | right
        known = self.fits_known.get(key)
        if known is not None:
            return known
        if len(self.fits_known) > MEMORY:
            self.fits_known.clear()
        limit, tie = float("inf"), False
        a, b = left, right
        rank = lambda i: -self.score[i] if len(self.text[i]) > 1 else -1.0
        ok = self.alone(left) and self.alone(right)
        while ok:
            i = self.id.get(self.text[a] + self.text[b])
            if i is not None and (-self.score[i] < limit or tie and -self.score[i] == limit):
                ok = False
                break
            if len(self.text[a]) == 1 and len(self.text[b]) == 1:
                break
            if rank(a) > rank(b):
                limit, tie, a = rank(a), False, self._half(a, 1)
            else:
                limit, tie, b = rank(b), True, self._half(b, 0)
            if a < 0 or b < 0:
                ok = self.merged(self.text[left] + self.text[right]) == [self.text[left], self.text[right]]
                break
        self.fits_known[key] = ok
        return ok

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words, visited in sorted order so that common prefixes are computed once.

        A forward row of a position has the last piece's id (-1: a character without one), its start, and
        the starts from which some piece may still go on, with their nodes in the trie of pieces.
        """
        if not self.is_bpe:
            return self._encode_unigram(words)
        out, last, root = {}, "", self.trie
        ids_at, start_at, open_at = [-1], [0], [[]]
        known, alone, fits = self.fits_known, self.alone, self.fits
        for word in sorted(words):
            common = 0
            for a, b in zip(word, last, strict=False):
                if a != b:
                    break
                common += 1
            del ids_at[common + 1 :], start_at[common + 1 :], open_at[common + 1 :]
            at = common
            for ch in word[common:]:
                best, first, still = -1, at, []
                for start, node in (*open_at[at], (at, root)):
                    node = node.get(ch)
                    if node is None:
                        continue
                    still.append((start, node))
                    if best < 0 and (i := node.get("")) is not None:
                        before = ids_at[start]
                        if before < 0:
                            good = alone(i)
                        else:
                            good = known.get(before << 32 | i)
                            if good is None:
                                good = fits(before, i)
                        if good:
                            best, first = i, start
                ids_at.append(best)
                start_at.append(first)
                open_at.append(still)
                at += 1
            out[word] = self._path(word, ids_at, start_at)
            last = word
        return out

    def _path(self, word: str, ids_at: list[int], start_at: list[int]) -> list[int]:
        ids: list[int] = []
        end = len(word)
        while end:
            i, start = ids_at[end], start_at[end]
            if i >= 0:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[x] for x in reversed(word[start:end].encode("utf-8", "replace"))]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
            end = start
        return ids[::-1]

    def _encode_unigram(self, words: list[str]) -> dict[str, list[int]]:
        out, last = {}, ""
        rows: list[tuple] = [(-1, 0, 0.0, ())]
        for word in sorted(words):
            common = next((k for k, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
            del rows[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                rows.append(self._unigram_row(word, end, rows))
            out[word] = self._path(word, [r[0] for r in rows], [r[1] for r in rows])
            last = word
        return out

    def _unigram_row(self, word: str, end: int, rows: list) -> tuple[int, int, float, list]:
        open_starts, best = [], (-1, end - 1, rows[end - 1][2] + self.worst)
        for start in (*rows[end - 1][3], end - 1):
            i = self.begun.get(word[start:end])
            if i is None:
                continue
            open_starts.append(start)
            if i >= 0 and rows[start][2] + self.score[i] > best[2]:
                best = i, start, rows[start][2] + self.score[i]
        return *best, open_starts

    def words_of(self, text: str | None) -> list[str]:
        if not text:
            return []
        marked = (MARK if self.dummy_blank else "") + text.replace(" ", MARK)
        return self.word.findall(marked)

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_blank and text.startswith(" ") else text

    def decode_all(self, lists) -> list[str | None]:
        """Texts of an Arrow column of lists of ids; null for null."""
        valid, ends = lists.is_valid().to_pylist(), lists.offsets.to_pylist()
        ids = lists.values.slice(ends[0], ends[-1] - ends[0]).to_numpy().tolist() if ends else []
        return [self.decode(ids[a - ends[0] : b - ends[0]]) if ok else None for a, b, ok in zip(ends, ends[1:], valid, strict=False)]


class Encoder:
    """A model with what this process has met: blank-separated chunks of texts, and the words they consist of."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        self.words.update((w, array("i", ids).tobytes()) for w, ids in self.pieces.encode_words(new).items())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed 32-bit ids of each text.

        Between two words a single blank is always a border, so a chunk is looked up whole. Texts with
        other runs of blanks are taken word by word.
        """
        for known in (self.chunks, self.words):
            if len(known) > MEMORY:
                # The older half goes; words that come often are soon back.
                for k in list(known)[: MEMORY // 2]:
                    del known[k]
        of, split, met, loose = self.pieces.words_of, [], set(), []
        for text in texts:
            if not text or not self.pieces.dummy_blank or text[0] == " " or "  " in text or MARK in text:
                loose.append(of(text))
                split.append(None)
            else:
                split.append(text.split(" "))
                met.update(split[-1])
        chunks, words = self.chunks, self.words
        parts = {c: self.pieces.word.findall(MARK + c) for c in met if c not in chunks}
        self._learn({w for own in (*parts.values(), *loose) for w in own})
        chunks.update((c, b"".join([words[w] for w in own])) for c, own in parts.items())
        rest = iter(loose)
        return [b"".join(map(words.__getitem__, next(rest))) if own is None else b"".join(map(chunks.__getitem__, own)) for own in split]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder: tasks that a Python worker runs one after another share its memory."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def model(path: str) -> Pieces:
    return encoder(path).pieces


def _encoded(path: str, decoded: bool = False):
    def of(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                packed = encoder(path).encode(part.column(part.num_columns - 1).to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
                columns, names = [*part.columns[:-1], ids], [*part.schema.names[:-1], "ids"]
                if decoded:
                    back = model(path).decode
                    columns.append(pa.array([back(array("i", x)) for x in packed], pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names)

    return of


def _decoded(path: str):
    def of(batches):
        import pyarrow as pa

        pieces = model(path)
        for batch in batches:
            texts = pieces.decode_all(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    return of


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ids) of each row's whole text."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoded(path), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(``id_col``, text) of each row's ids; null ids give a null text."""
    rows = encoded.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decoded(path), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ids, text): encoded and decoded again in one pass."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoded(path, decoded=True), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>, text string")
