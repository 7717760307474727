"""Operator 8: cost-balanced packing of documents into sequences of bounded length.

A document becomes its token ids and an end id. Whole multiples of the sequence length fill sequences
of their own; the rests of a window of documents are shared out over just as many sequences as their
tokens need. They go, in descending estimated attention cost (a linear and a quadratic term of the
length), to the sequence of lowest cost that has room; where no sequence has room for all of it, a rest is
cut at the end of the one with most room. So a window pads fewer tokens than one sequence holds. Windows belong to one partition,
nothing is shuffled, and a task that is run anew makes the same sequences.

Null or empty texts are one end id. Rows with equal or null ``doc_id`` are packed one by one.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame

from docloom.llm import tokens

SEQUENCE = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Documents whose rests are packed together.
WINDOW = 2048


def attention_cost(tokens: int, linear: float = 1.0, quadratic: float = 1.0 / 512) -> float:
    """Estimated cost of one piece: feed-forward work in its tokens, attention in their square."""
    return tokens * linear + tokens * tokens * quadratic


def share_out(lengths: list[int], size: int = SEQUENCE) -> list[list[tuple[int, int, int, int]]]:
    """Puts rests of the given lengths into ``ceil(sum / size)`` sequences.

    Returns for each sequence its pieces ``(which, start in the rest, length, offset)``.
    """
    import numpy as np

    sequences: list[list[tuple[int, int, int, int]]] = [[] for _ in range(-(-sum(lengths) // size))]
    room, cost = np.full(len(sequences), size), np.zeros(len(sequences))
    todo = sorted(range(len(lengths)), key=lambda i: (-attention_cost(lengths[i]), i))
    for i in todo:
        at, left = 0, lengths[i]
        while left:
            fits = np.flatnonzero(room >= left)
            k = int(fits[cost[fits].argmin()] if len(fits) else room.argmax())
            n = min(left, int(room[k]))
            sequences[k].append((i, at, n, size - int(room[k])))
            room[k] -= n
            cost[k] += attention_cost(n)
            at, left = at + n, left - n
    return sequences


def pack(
    docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    keep: int = tokens.KEEP
) -> DataFrame:
    """One row per piece, see ``PIECES``; ``start`` counts the document's ids before the piece.

    ``keep`` bounds the words that a Python worker remembers.
    """

    def packed(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = tokens.encoder(tokenizer, keep=keep).encode
        end = int(end_id).to_bytes(4, "little")
        following = TaskContext.get().partitionId() << 33
        names = [x.split()[0] for x in PIECES.split(", ")]
        rests: list[tuple] = []  # doc_id, number of ids, start of the rest, its ids

        def table(rows):
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        def closed():
            nonlocal following
            rows = []
            for pieces in share_out([len(r[3]) // 4 for r in rests], size):
                for i, at, n, offset in pieces:
                    doc_id, count, start, ids = rests[i]
                    rows.append((doc_id, start + at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), count, following, offset))
                following += 1
            rests.clear()
            return rows

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(doc_ids), 512):
                rows = []
                for doc_id, ids in zip(doc_ids[at : at + 512], encode(texts[at : at + 512].to_pylist()), strict=False):
                    ids += end
                    count = len(ids) // 4
                    whole = count - count % size
                    for start in range(0, whole, size):
                        rows.append((doc_id, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), count, following, 0))
                        following += 1
                    if whole < count:
                        rests.append((doc_id, count, whole, ids[4 * whole :]))
                    if len(rests) >= WINDOW:
                        rows += closed()
                yield table(rows)
        yield table(closed())

    return docs.selectExpr(f"cast({id_col} as long) doc_id", f"cast({text_col} as string) text").mapInArrow(packed, PIECES)
