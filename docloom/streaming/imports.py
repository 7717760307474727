"""References that arrive as JSON files, appended to a library as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A web record: every field may be missing.
IMPORT = "title string, author string, authors array<string>, journal string, year string, doi string, url string, abstract_text string"


def incoming(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The stream of records in a folder."""
    return spark.readStream.schema(IMPORT).option("maxFilesPerTrigger", files_per_batch).json(folder)


def as_imported(records: DataFrame) -> DataFrame:
    """References of web records; ``id`` is a digest of the content, so a record that comes again is the same row."""
    from docloom.schemas import as_references

    authors = F.coalesce("authors", F.filter(F.split("author", r"\s*[;,]\s*"), lambda a: a != ""), F.array().cast("array<string>"))
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = records.withColumns({"authors": authors, "id": F.sha2(F.concat_ws("\x01", text("doi"), text("url"), text("title")), 256)}).drop("author")
    return as_references(rows)


def run_import(spark: SparkSession, folder: str, library: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends what arrives to the Parquet library; ids that came before are left out.

    Which ids came is the stream's state, dealt by id and kept with its checkpoint, so a batch looks up its own ids
    and reads nothing of the library. A batch that is run again after a failure replaces its own part of the table.
    """

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{library}/batch={number}")

    rows = as_imported(incoming(spark, folder)).dropDuplicates(["id"])
    writer = rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="900 milliseconds").start()
