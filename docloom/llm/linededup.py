"""Operator 6: removal of lines that many documents share.

Line keys are counted batch by batch. What is known of them is held in levels of sorted runs, as in a
log-structured merge tree: a run is a table dealt into buckets by hash and sorted in them, with the number
of documents that hold the key. All runs have the same buckets, so they are merged and anti-joined bucket
by bucket, without a shuffle. Each new batch of documents

1. is reduced to one row for each key hash (partial sums first, so a line that a third of all documents
   hold costs one row a task) and written as a run,
2. is anti-joined by merge with the runs of settled keys, those already found in enough documents,
3. is added to level 0. Whenever a level has ``FANOUT`` runs they are merged into one of the next
   level; keys that reach the limit move to the settled runs.

A last merge of all levels settles what is left. Then every document learns which of its keys are
settled (an equi-join on the hash, split by Spark where a key is hot) and drops those lines.

Keys are hashed to 128 bits (two 64-bit hashes with unrelated seeds). Null or empty texts are one empty
line, whose key has no code points and is never dropped. Equal rows are separate documents; documents
without ``doc_id`` count and are cleaned as others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import storage

#: ASCII white space, stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Batches at least, documents of a batch at most, runs of a level that are merged.
BATCHES, BATCH_DOCUMENTS, FANOUT = 4, 100_000_000, 2
#: Documents for each bucket of the runs, about.
BUCKET_DOCUMENTS = 200_000
#: Keys of at least so many code points found in at least so many documents are dropped.
MIN_CHARS, MIN_DOCS = 1, 10


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


KEYS = ["h1", "h2"]


class LineRuns:
    """Sorted runs of (h1, h2, n_docs) in levels, and the settled runs of keys in ``min_docs`` documents.

    A run stands with the tables that it reads, which go when it has been merged.
    """

    def __init__(self, buckets: int, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.buckets, self.min_docs, self.fanout = buckets, min_docs, fanout
        self.levels: list[list[tuple[DataFrame, DataFrame]]] = []
        self.settled: list[DataFrame] = []

    def add(self, hashes: DataFrame) -> None:
        """``hashes``: a row (h1, h2) for each document and key."""
        written = storage.materialise_sorted(hashes.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_docs")), "line-run", self.buckets, KEYS)
        batch = written
        for run in self.settled:
            batch = batch.join(run.hint("merge"), KEYS, "left_anti")
        self._place(batch, written, 0)

    def _place(self, run: DataFrame, written: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append((run, written))
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = storage.materialise_sorted(merge([run for run, _ in runs]), "line-level", self.buckets, KEYS, True)
            for _, old in runs:
                storage.drop(old)
            full = merged.filter(F.col("n_docs") >= self.min_docs).select(*KEYS)
            self.settled.append(storage.materialise_sorted(full, "line-settled", self.buckets, KEYS, True))
            self._place(merged.filter(F.col("n_docs") < self.min_docs), merged, level + 1)

    def frequent(self) -> DataFrame:
        """(h1, h2) of all keys in at least ``min_docs`` documents, each once."""
        left = merge([run for level in self.levels for run, _ in level])
        last = left.filter(F.col("n_docs") >= self.min_docs).select(*KEYS)
        # What a level held of a key before it was settled in another one may reach the limit again.
        return reduce(DataFrame.unionByName, self.settled, last).distinct()


def merge(runs: list[DataFrame]) -> DataFrame:
    """One run of all, with the sums of their numbers."""
    return reduce(DataFrame.unionByName, runs).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"))


def clean_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int | None = None, id_col: str = "doc_id",
    text_col: str = "text"
) -> DataFrame:
    """All columns of ``docs``, with the kept text in ``text_col``, and ``n_lines`` and ``n_dropped``.

    Columns of ``docs`` with these two names are replaced. ``batches`` follows the number of documents where
    it is not given.
    """
    n = docs.count()
    batches = batches or max(BATCHES, -(-n // BATCH_DOCUMENTS))
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // BUCKET_DOCUMENTS))
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    of_line = lambda line: key_hash(line_key(line))
    keys = F.transform(F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= min_chars), key_hash)
    ids = docs.select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(keys)).alias("k")).select("doc", "k.h1", "k.h2")
    ids = storage.materialise(ids.withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")), "line-hashes", "batch")

    runs = LineRuns(buckets, min_docs)
    for k in range(batches):
        runs.add(ids.filter(F.col("batch") == k).select(*KEYS))
    drops = ids.join(runs.frequent(), KEYS).groupBy("doc").agg(F.collect_set(F.struct(*KEYS)).alias("__drop"))

    joined = docs.alias("d").join(drops.alias("x"), F.col(f"d.{id_col}").eqNullSafe(F.col("x.doc")), "left")
    kept = F.when(F.col("x.__drop").isNull(), lines).otherwise(F.filter(lines, lambda line: ~F.array_contains(F.col("x.__drop"), of_line(line))))
    own = [F.col(f"d.`{c}`") for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    name = "__kept"
    while name in docs.columns:
        name += "_"
    out = joined.select(*own, F.size(lines).cast("long").alias("n_lines"), kept.alias(name))
    out = out.withColumns({text_col: F.array_join(name, "\n"), "n_dropped": F.col("n_lines") - F.size(name)})
    return out.select(*(f"`{c}`" for c in docs.columns), *(c for c in ("n_lines", "n_dropped") if c not in docs.columns))
