"""Libraries that are synced by payloads: of each id the row with the greatest stamp stays.

Rows of a payload have ``payload``, the payload's number (0: the local library), and ``place``, their place in it. A row
displaces another one only if its stamp is strictly greater, so among equal stamps the one of the earliest payload and
place stays. That is an order of all rows of an id and its first row wins: the greatest by a struct, a partial
aggregate before the shuffle and, in a stream, the state of each id. However payloads are split into files, and whatever comes
first, the same rows stay. Missing stamps count as empty ones, the smallest.

The state is dealt by id and kept with the stream's checkpoint (RocksDB's provider holds more than memory does). Each batch
appends the winners of the ids that it touches to a log of changes; ``synced`` reads the last one of each id, ``compacted``
writes them anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ORDER = ("payload", "place")


def _rank(stamp: str) -> Column:
    return F.struct(F.coalesce(F.col(stamp).cast("string"), F.lit("")).alias("stamp"), *((-F.col(c).cast("long")).alias(c) for c in ORDER))


def winners(rows: DataFrame, key: str = "id", stamp: str = "date_modified") -> DataFrame:
    """The row that stays of each id, of a table or a stream (update mode)."""
    others = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*(F.col(f"`{c}`") for c in others)), _rank(stamp))
    return rows.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def members(rows: DataFrame) -> DataFrame:
    """(id, ref_id): each member of a collection once, of a table or a stream; rows have ``id`` and ``ref_ids``."""
    return rows.select("id", F.explode("ref_ids").alias("ref_id")).dropDuplicates(["id", "ref_id"])


def _log(df: DataFrame, log: str, checkpoint: str, mode: str, once: bool) -> StreamingQuery:
    def append(batch: DataFrame, number: int) -> None:
        # A batch that is run again replaces its own part.
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    writer = df.writeStream.outputMode(mode).foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="10 seconds").start()


def run_sync(payloads: DataFrame, log: str, checkpoint: str, key: str = "id", stamp: str = "date_modified", once: bool = True) -> StreamingQuery:
    """Merges the streamed rows of payloads into the log of changes."""
    return _log(winners(payloads, key, stamp), log, checkpoint, "update", once)


def run_members(payloads: DataFrame, log: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends members of collections that are new to the log; members that came before are left out."""
    return _log(members(payloads), log, checkpoint, "append", once)


def synced(spark: SparkSession, log: str, key: str = "id", stamp: str = "date_modified") -> DataFrame:
    """The library that a log of changes stands for."""
    return winners(spark.read.parquet(log).drop("batch"), key, stamp)


def compacted(spark: SparkSession, log: str, to: str, key: str = "id", stamp: str = "date_modified") -> None:
    """Writes what a log stands for as a log of one batch, to be read before those that follow."""
    synced(spark, log, key, stamp).write.mode("overwrite").parquet(f"{to}/batch=-1")
