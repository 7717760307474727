"""Row numbers over large groups, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts of each group that are numbered side by side.
PARTS = 1024


def numbered(df: DataFrame, group: list[str], order: Column, name: str, part: Column | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, ... within each group, in the order of ``part``, then of ``order``.

    ``order`` (a struct) must be unique in a group for the numbers to be the same in every run. Groups are
    cut by ``part``, otherwise into ``PARTS`` by the order's hash; counts of the parts (a row for each
    group and part) give the first number of each.
    """
    df = df.withColumn("__order", order)
    df = df.withColumn("__part", F.pmod(F.xxhash64("__order"), F.lit(PARTS)) if part is None else part)
    counts = df.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy(*group, "__part").orderBy("__order")) - 1
    out = df.withColumn("__within", within).join(first, [*group, "__part"])
    return out.withColumn(name, (F.col("__first") + F.col("__within")).cast("long")).drop("__order", "__part", "__first", "__within")
