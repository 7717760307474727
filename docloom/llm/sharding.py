"""Operator 7: shards of even size that keep linked documents together.

Documents with equal texts are linked. Each starts in the shard its hash names. Then, in rounds,

1. every group of links counts its members in each shard (partial sums; a group is a star around its
   text's hash, never a list of pairs),
2. every document wishes for the shard that holds most of its group and has room,
3. wishes are granted, whole groups one after another, while the shard has room under its quota; who was
   granted is settled, the others wish again in the next round.

The rounds only move labels: a few numbers for each document, never a text. At the end documents beyond
a shard's quota, single ones first, go to the places that are left, so that the numbers of rows differ by
one at most (law ``rows``). A group larger than a quota spreads over as few shards as it needs.

A null text counts 0 bytes and checksum 0, as an empty one, but is linked with null texts only. Rows with
equal or null ``doc_id`` are told apart by a number given before the first round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import storage
from docloom.llm.ranking import numbered

SHARDS = 8
#: Members of a group that are numbered in one task; larger groups are cut.
CROWD = 4096


def _whole_groups(members: str) -> Column:
    """Parts for numbering in which groups follow one another whole; large ones are cut."""
    own = F.pmod(F.col("g1"), F.lit(1024)) * 1024
    return own + F.when(F.col(members) > CROWD, F.pmod(F.xxhash64("row"), F.lit(1024))).otherwise(F.lit(0))


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``."""
    text = F.col(text_col).cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    start = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit("shard"), text).alias("g2"),
        F.pmod(F.xxhash64(F.lit("start"), F.col(id_col)), F.lit(shards)).cast("int").alias("shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    labels = storage.materialise(start, "shard-start")
    groups = ["g1", "g2"]
    sizes = labels.groupBy(*groups).agg(F.count(F.lit(1)).alias("members"))
    linked = storage.materialise(sizes.filter("members > 1"), "shard-groups")
    # Documents without links keep their label until the end; only the others take part in the rounds.
    moving = storage.materialise(labels.select("row", *groups, "shard").join(linked, groups), "shard-linked")
    single = labels.join(linked, groups, "left_anti").groupBy("shard").agg(F.count(F.lit(1)).alias("alone"))
    n = labels.count()
    quota = -(-n // shards)
    alone = {r["shard"]: r["alone"] for r in single.collect()}  # at most one row for each shard
    settled, room = [], [quota] * shards
    for _ in range(shards):
        if not any(room) or not moving.head(1):
            break
        free = F.array(*(F.lit(x) for x in room))
        held = moving.groupBy(*groups, "shard").agg(F.count(F.lit(1)).alias("held"))
        # The most members, then the most room; a full shard is nobody's wish.
        offers = F.explode(F.array(*(F.struct(F.lit(k).alias("wish"), F.lit(x).alias("room")) for k, x in enumerate(room) if x)))
        offered = moving.select(*groups).distinct().select(*groups, offers.alias("o")).select(*groups, "o.*")
        known = held.withColumnRenamed("shard", "wish")
        best = offered.join(known, [*groups, "wish"], "left").groupBy(*groups).agg(
            F.max(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "room", "wish")).alias("b")
        ).select(*groups, F.col("b.wish").alias("wish"))
        asked = moving.join(best, groups)
        turned = numbered(asked, ["wish"], F.struct(*groups, "row"), "turn", _whole_groups("members"))
        granted = F.col("turn") < F.element_at(free, F.col("wish") + 1)
        turned = storage.materialise(
            turned.withColumn("granted", granted).withColumn("shard", F.when(granted, F.col("wish")).otherwise(F.col("shard"))),
            "shard-round"
        )
        settled.append(turned.filter("granted").select("row", "shard", "members"))
        moving = turned.filter("not granted").select("row", *groups, "shard", "members")
        for r in settled[-1].groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect():
            room[r["shard"]] -= r["n"]
    moving = reduce(DataFrame.unionByName, settled, moving.select("row", "shard", "members"))

    now = labels.drop("shard").join(moving, "row", "left")
    first = F.pmod(F.xxhash64(F.lit("start"), F.col("doc_id")), F.lit(shards)).cast("int")
    now = now.withColumns({"shard": F.coalesce("shard", first), "members": F.coalesce("members", F.lit(1)), "alone": F.col("members").isNull().cast("int")})
    now = storage.materialise(now, "shard-wanted")
    return _filled(now, n, shards, alone)


def _filled(now: DataFrame, n: int, shards: int, alone: dict[int, int]) -> DataFrame:
    """Moves what is beyond the quotas into the free places and numbers the slots."""
    held = {r["shard"]: r["n"] for r in now.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_size = sorted(range(shards), key=lambda k: (-held.get(k, 0), k))
    quota = [n // shards + (by_size.index(k) < n % shards) for k in range(shards)]
    keep = [min(quota[k], held.get(k, 0)) for k in range(shards)]
    # Single documents leave first, then linked ones, whole groups at a time as far as that goes.
    linked = [held.get(k, 0) - alone.get(k, 0) for k in range(shards)]
    at = lambda values: F.element_at(F.array(*(F.lit(x) for x in values)), F.col("shard") + 1)
    turned = numbered(now, ["shard", "alone"], F.struct("g1", "g2", "row"), "turn", _whole_groups("members"))
    place = F.col("turn") + F.when(F.col("alone") == 1, at(linked)).otherwise(F.lit(0))
    turned = turned.withColumn("beyond", place >= at(keep))
    stays = turned.filter("not beyond").drop("beyond", "turn", "alone", "members")
    leaves = numbered(turned.filter("beyond").drop("turn", "shard"), ["beyond"], F.struct("g1", "g2", "row"), "turn", _whole_groups("members"))
    free, choice = 0, F.lit(None).cast("int")
    for k in range(shards):
        free += quota[k] - keep[k]
        choice = F.when(choice.isNotNull(), choice).when(F.col("turn") < free, F.lit(k)).cast("int") if k else F.when(F.col("turn") < free, F.lit(k)).cast("int")
    leaves = leaves.withColumn("shard", choice).drop("beyond", "turn", "alone", "members")
    placed = numbered(stays.unionByName(leaves), ["shard"], F.struct("row"), "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard")
    )


def cut_links(shards: DataFrame, groups: str) -> DataFrame:
    """(links, cut): pairs of documents with equal ``groups``, and those of them in different shards."""
    held = shards.groupBy(groups, "shard").agg(F.count(F.lit(1)).alias("n"))
    pairs = held.groupBy(groups).agg(F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("kept"))
    total = F.col("all") * (F.col("all") - 1) / 2
    return pairs.agg(F.sum(total).cast("long").alias("links"), F.sum(total - F.col("kept")).cast("long").alias("cut"))
