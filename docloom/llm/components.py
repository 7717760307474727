"""Connected components by joins: labels spread along edges and jump to their labels' labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import storage


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each end of an edge (a, b) reaches.

    A round takes the smallest label among a node and its neighbours (partial minima before the shuffle,
    so a hub costs one row a task), then follows that label twice. Each round is written to the shared
    folder and removes the tables of the one before; only whether a label changed reaches the driver.
    Raises if ``rounds`` do not suffice.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = storage.materialise(both.filter("a <> b").distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component"))
    written = labels = storage.materialise(labels, "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        new = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        near_by = new = storage.materialise(new, "labels-near")
        for _ in range(2):
            of = new.select(F.col("id").alias("component"), F.col("component").alias("further"))
            new = new.join(of, "component", "left").select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component"))
        new = storage.materialise(new, "labels")
        storage.drop(near_by)
        storage.drop(written)
        written, labels = new, new.select("id", "component")
        if not new.filter("old <> component").head(1):
            storage.drop(both)
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
