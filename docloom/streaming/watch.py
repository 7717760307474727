"""Watching a folder: what has changed is converted again, and nothing else.

``refresh`` is one look at the folder. Files are told apart by path, time and size, and compared with those of the look before, a table;
contents are read of files only that were changed at the earliest change's time or later. Converted files take
their places when all of them are done. The new table replaces the old one last: after a failure the next look does the same again.
``watch`` looks at every tick of a stream.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.sources import formats

STAMP = ["path", "modificationTime", "length"]


def to_html(files: DataFrame) -> DataFrame:
    """(path, text): Markdown files (path, content) as HTML."""
    from docloom.operators.events import parse_markdown
    from docloom.sinks.text import render

    events = parse_markdown(files.select("path", F.decode("content", "UTF-8").alias("md")), "path")
    whole = render(events, "html", "path")
    return files.select("path").join(whole, "path", "left").fillna("", ["text"])


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _hadoop(spark, path)
    return files.exists(at)


def _move(spark: SparkSession, a: str, b: str) -> None:
    """``a`` takes the place of ``b``; between the two steps there is neither, and ``b`` has another name."""
    files, old = _hadoop(spark, b)
    if files.exists(old):
        files.delete(_hadoop(spark, b + ".old")[1], True)
        files.rename(old, _hadoop(spark, b + ".old")[1])
    files.rename(_hadoop(spark, a)[1], old)
    files.delete(_hadoop(spark, b + ".old")[1], True)


def _removed(folder: str, ending: str):
    def of(batches):
        import posixpath

        from pyarrow import fs

        files, root = formats.store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                at = posixpath.join(root, name + ending)
                if files.get_file_info(at).type == fs.FileType.File:
                    files.delete_file(at)
            yield batch

    return of


def refresh(
    spark: SparkSession, folder: str, out: str, state: str, convert: Callable[[DataFrame], DataFrame] = to_html, pattern: str = "*.md", extension: str = "html"
) -> tuple[int, int]:
    """Converts the files of ``folder`` that are new or replaced since the last look and deletes what came of those that are gone.

    ``convert`` makes (path, text) of (path, content). A file's result is at its place below ``out``, by its name without
    ending. ``state`` is the table of the files seen; gives the numbers of files converted and deleted.
    """
    formats.register(spark)
    staged = f"{state}-{uuid.uuid4().hex}"
    _files(spark, folder, pattern).select(*STAMP).write.parquet(staged)
    seen = spark.read.parquet(staged)
    last = next((p for p in (state, state + ".old") if _exists(spark, p)), None)
    before = spark.read.schema(seen.schema).parquet(last) if last else seen.limit(0)
    changed = seen.join(before, STAMP, "left_anti")
    n, since = changed.agg(F.count(F.lit(1)), F.min("modificationTime")).first()
    root = F.lit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/")
    local = F.regexp_replace("path", r"^\w+:/+(?=/)|^\w+:(?=/)", "")
    name = F.regexp_replace(F.substr(local, F.length(root) + 1), r"\.[^./]*$", "")
    if n:
        contents = _files(spark, folder, pattern).filter(F.col("modificationTime") >= F.lit(since)).join(changed.select(*STAMP), STAMP, "left_semi")
        convert(contents.select("path", "content")).select(name.alias("name"), "text").write.format("files").option(
            "extension", extension
        ).mode("append").save(out)
    gone = before.join(seen, "path", "left_anti").select(name.alias("name")).mapInArrow(_removed(out, f".{extension}"), "name string").count()
    _move(spark, staged, state)
    return n, gone


def watch(spark: SparkSession, folder: str, out: str, state: str, checkpoint: str, every: str = "10 seconds", **how) -> StreamingQuery:
    """Refreshes at every tick until it is stopped."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    look = lambda _, number: refresh(spark, folder, out, state, **how) and None
    return ticks.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
