"""Operator 10: token ids in binary files under one global Huffman code.

1. Documents are put in ascending order of ``doc_id`` (range partitions) and encoded; the ids, as
   unsigned 16- or 32-bit integers, are a table in the shared folder.
2. Ids are counted over that whole table; the counts, one for each id of the vocabulary at most, give
   the canonical code.
3. Each run of documents becomes a file of independent blocks.
4. The files are read back: a task decodes the blocks of a file by table lookup.

File: the magic, the blocks, a footer, the footer's length (8 bytes) and the magic. A block has a
32-bit bit offset for every 64th id, then the bits. The footer (compressed NumPy arrays) has the code
lengths, the documents' ids and sizes, and each block's place, size and number of ids.

Null or empty texts have the end id alone. Rows with equal ``doc_id`` follow each other in order of
their texts' checksums; rows without ``doc_id`` come first. An empty table makes no files.
"""

from __future__ import annotations

import io
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import storage

#: Documents of a file, about: their ids and sizes are held until it is closed.
FILE_DOCUMENTS = 1 << 20
MAGIC = b"DLTOKEN1"
#: Ids in a block.
BLOCK = 1 << 19


def token_table(docs: DataFrame, tokenizer: str, end_id: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, place, doc_id, ids) in ascending order of ``doc_id``: ``part`` is a range, ``place`` the place in it."""

    def encoded(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from docloom.llm.tokens import encoder

        encode = encoder(tokenizer, f"<u{width}").encode
        end, part, place = int(end_id).to_bytes(width, "little"), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                ids = [x + end for x in encode(rows.column(1).to_pylist())]
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()), rows.column(0),
                        pa.array(ids, pa.binary())
                    ],
                    ["part", "place", "doc_id", "ids"]
                )
                place += n

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Rows without id, or with one id, are as many ranges as their texts need.
    ordered = ordered.withColumn("sum", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    ordered = ordered.repartitionByRange("doc_id", "sum").sortWithinPartitions("doc_id", "sum").drop("sum")
    spark = docs.sparkSession
    path = storage.new_path(spark, "token-ids")
    ordered.mapInArrow(encoded, "part int, place long, doc_id long, ids binary").write.option("compression", "zstd").parquet(path)
    return spark.read.schema("part int, place long, doc_id long, ids binary").parquet(path)


def id_counts(tokens: DataFrame, width: int = 2) -> DataFrame:
    """(id, n) over all documents; every task adds up its own part first."""

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0)
            for at in range(0, len(ids), 1024):
                n = np.bincount(np.frombuffer(b"".join(ids[at : at + 1024].to_pylist()), dtype=f"<u{width}"))
                if len(n) > len(total):
                    n[: len(total)] += total
                    total = n
                else:
                    total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return tokens.select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(tokens: DataFrame, lengths: bytes, folder: str, width: int = 2) -> list[dict]:
    """Writes each run of documents of one part to a file; returns what stands where, in order.

    The list has a few entries for each task, not for each document.
    """

    def written(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        code = None
        run = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                parts, places = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                cuts = [0, *(np.flatnonzero((np.diff(parts) != 0) | (np.diff(places) != 1)) + 1).tolist(), len(parts)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if run is not None and (len(run.doc_ids) >= FILE_DOCUMENTS or (run.part, run.place + len(run.doc_ids)) != (parts[a], places[a])):
                        yield run.close(pa)
                        run = None
                    if run is None:
                        from docloom.llm.huffman import Code

                        code = code or Code(np.frombuffer(lengths, dtype=np.uint8))
                        run = _Run(folder, int(parts[a]), int(places[a]), code, width, TaskContext.get().taskAttemptId())
                    run.add(rows.column(2).slice(a, b - a).to_pylist(), rows.column(3).slice(a, b - a).to_pylist())
        if run is not None:
            yield run.close(pa)

    rows = tokens.select("part", "place", "doc_id", "ids").mapInArrow(written, "part int, place long, path string, n_docs long, n_ids long").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: (r["part"], r["place"]))


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Run:
    """A file that is being written, block by block, under a name of this attempt's own."""

    def __init__(self, folder: str, part: int, place: int, code, width: int, attempt: int):
        self.part, self.place, self.code, self.width = part, place, code, width
        self.path = f"{folder}/{part:06d}-{place:012d}.ids"
        self.files, self.name = _open(folder)
        self.files.create_dir(self.name, recursive=True)
        self.name += "/" + self.path.rpartition("/")[2]
        self.own = f"{self.name}.{attempt}"
        self.out = self.files.open_output_stream(self.own)
        self.out.write(MAGIC)
        self.doc_ids: list = []
        self.sizes: list[int] = []
        self.waiting: list[bytes] = []
        self.n_waiting = 0
        self.blocks: list[tuple[int, int, int]] = []
        self.at = len(MAGIC)

    def add(self, doc_ids: list, ids: list[bytes]) -> None:
        for doc_id, x in zip(doc_ids, ids, strict=True):
            self.doc_ids.append(doc_id)
            self.sizes.append(len(x) // self.width)
            self.waiting.append(x)
            self.n_waiting += self.sizes[-1]
            if self.n_waiting >= BLOCK:
                self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        import numpy as np

        ids = np.frombuffer(b"".join(self.waiting), dtype=f"<u{self.width}")
        at = 0
        while at < len(ids) and (all_of_it or len(ids) - at >= BLOCK):
            part = ids[at : at + BLOCK]
            data, checkpoints = self.code.encode(part)
            block = checkpoints.astype("<u4").tobytes() + data.tobytes()
            self.out.write(block)
            self.blocks.append((self.at, len(block), len(part)))
            self.at += len(block)
            at += len(part)
        self.waiting, self.n_waiting = [ids[at:].tobytes()], len(ids) - at

    def close(self, pa):
        import numpy as np

        self._flush(True)
        footer = io.BytesIO()
        valid = np.array([x is not None for x in self.doc_ids], dtype=bool)
        np.savez_compressed(
            footer, lengths=self.code.lengths, doc_ids=np.array([x or 0 for x in self.doc_ids], dtype=np.int64), valid=valid,
            sizes=np.array(self.sizes, dtype=np.int64), blocks=np.array(self.blocks, dtype=np.int64).reshape(-1, 3)
        )
        self.out.write(footer.getvalue() + len(footer.getvalue()).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.files.move(self.own, self.name)
        n = sum(self.sizes)
        return pa.RecordBatch.from_pylist(
            [{"part": self.part, "place": self.place, "path": self.path, "n_docs": len(self.sizes), "n_ids": n}],
            pa.schema([("part", pa.int32()), ("place", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        )


def read_file(path: str):
    """Yields (doc_id, ids as a NumPy array of unsigned 32-bit integers) for each document of a file."""
    import numpy as np

    from docloom.llm.huffman import STRETCH, Code, decode

    files, name = _open(path)
    with files.open_input_file(name) as f:
        size = f.size()
        tail = f.read_at(16, size - 16)
        if tail[8:] != MAGIC or f.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is not a file of token ids")
        n = int.from_bytes(tail[:8], "little")
        footer = np.load(io.BytesIO(f.read_at(n, size - 16 - n)))
        code = Code(footer["lengths"])
        tables = code.tables()
        sizes, blocks = footer["sizes"].tolist(), footer["blocks"].tolist()
        doc_ids = [x if ok else None for x, ok in zip(footer["doc_ids"].tolist(), footer["valid"].tolist(), strict=True)]
        have, doc = [], 0
        n_have = 0
        for at, length, n_ids in blocks:
            raw = np.frombuffer(f.read_at(length, at), dtype=np.uint8)
            n_points = -(-n_ids // STRETCH)
            points = raw[: 4 * n_points].view("<u4")
            have.append(decode(tables, code.bits, raw[4 * n_points :], points, n_ids))
            n_have += n_ids
            if n_have < sizes[doc]:
                continue
            ids, at_id = np.concatenate(have), 0
            while doc < len(sizes) and at_id + sizes[doc] <= len(ids):
                yield doc_ids[doc], ids[at_id : at_id + sizes[doc]]
                at_id += sizes[doc]
                doc += 1
            have, n_have = [ids[at_id:]], len(ids) - at_id


def read_digests(spark: SparkSession, files: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, one task for each file."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    first, rows = 0, []
    for f in files:
        rows.append((f["path"], first))
        first += f["n_ids"]
    if not rows:
        return spark.createDataFrame([], schema)
    listed = spark.sparkContext.broadcast(rows)  # some entries for each task that wrote files

    def decoded(batches):
        import pyarrow as pa

        for batch in batches:
            for path, start in (listed.value[k] for k in batch.column(0).to_pylist()):
                out = []
                for doc_id, ids in read_file(path):
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(rows), 1, len(rows)).mapInArrow(decoded, schema)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, width: int = 2) -> list[dict]:
    """Steps 1 to 3: the files' list, see ``write_files``."""
    import numpy as np

    from docloom.llm.huffman import code_lengths

    folder = folder or storage.new_path(docs.sparkSession, "token-files")
    tokens = token_table(docs, tokenizer, end_id, width)
    counts = id_counts(tokens, width).collect()
    by_id = np.zeros(max((r.id for r in counts), default=0) + 1, dtype=np.int64)
    for r in counts:
        by_id[r.id] = r.n
    return write_files(tokens, code_lengths(by_id).tobytes(), folder, width)
