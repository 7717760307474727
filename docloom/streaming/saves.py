"""Debounced saves: of a burst of edits only the last state is stored, once nothing has come for a while.

Time is that of the edits, not of their arrival, so what is saved does not depend on how edits are delivered. The same
plan runs over a table and over a stream. A burst is a session window of one key: edits nearer to each other than
``gap``. Its rows are merged in each task before the shuffle where ``spark.sql.sessionWindow.merge.sessions.in.local.partition``
(for streams ``spark.sql.streaming.sessionWindow...``) is set. Edits without time belong to no burst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: After so long without an edit the state is saved.
GAP = "900 milliseconds"


def bursts(edits: DataFrame, key: str, at: str, tie: str, gap: str = GAP) -> DataFrame:
    """(key, started, saved_at, n_edits, and the other columns of the burst's last edit; of edits at one time the greatest ``tie``)."""
    state = [c for c in edits.columns if c not in (key, at)]
    last = F.max_by(F.struct(*(F.col(f"`{c}`") for c in state)), F.struct(at, tie))
    rows = edits.filter(F.col(at).isNotNull()).groupBy(key, F.session_window(at, gap).alias("w"))
    rows = rows.agg(F.count(F.lit(1)).alias("n_edits"), last.alias("s"))
    return rows.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("saved_at"), "n_edits", "s.*")


def run_saves(
    spark: SparkSession, folder: str, schema: str, saved: str, checkpoint: str, key: str, at: str, tie: str, gap: str = GAP,
    lateness: str = "10 seconds", once: bool = True
) -> StreamingQuery:
    """Appends each burst of the edits that arrive as JSON files to the Parquet table ``saved``.

    A burst is written when the watermark, ``lateness`` behind the latest edit, has passed its end: edits that are late by
    less count as if they had come in time, later ones are left out. A batch that is run again after a failure
    replaces its own part of the table.
    """
    edits = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(folder).withWatermark(at, lateness)

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{saved}/batch={number}")

    writer = bursts(edits, key, at, tie, gap).writeStream.outputMode("append").foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=GAP).start()
