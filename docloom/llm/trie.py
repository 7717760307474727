"""Operator 12: the trie of conversations' beginnings, by chained digests of prefixes.

1. A turn becomes the SHA-256 digest of its role and text and its number of words; texts are not shuffled.
2. A conversation is rebuilt (``rebuilt``): its first turns are those of the conversation it borrows from. Its rows,
   sorted in one task but streamed, are chained: the digest of a prefix is that of the shorter prefix's digest
   and the turn's. Every prefix is a row.
3. Rows grouped by (depth, digest) are the nodes; counts and smallest members are partial before the shuffle.
4. Sums over subtrees: every node is exploded to its ancestors. Rows of one conversation and depth are summed before they
   look up their node, and sums are partial again, so the root is no hot spot. Where a trie is deeper than ``BAND``, nodes are
   exploded to the ancestors in their own band of depths, the tops of bands to those in the band above, and tops among each other
   in the same way with wider bands: at most ``BAND`` rows a node and level of bands, however long a conversation is.
5. The conversations that end in a node are digested in order, streamed from sorted rows: memory does not grow with them.

Turns are ordered by ``turn``, null first, then by their digest (equal turns are told apart by nothing else). Null roles and
texts are empty. Rows without ``conv_id`` belong to no conversation and are left out. No rows give no nodes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import storage

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations that borrow their first turns from one of them, and turns that they borrow at most, and one.
FAMILY, BORROWED = 20, 4
#: Depths of a band, by which deep tries are summed.
BAND = 32
ROOT = hashlib.sha256(b"").digest()

_PREFIX = "c long, depth long, digest binary, parent binary, words long, last boolean"


def turn_digest(role: Column, text: Column) -> Column:
    """A digest that tells (role, text) pairs apart: the role goes with its length."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def borrowed(conv: Column) -> Column:
    """How many first turns a conversation takes from that of its family."""
    return (F.crc32(conv.cast("string").cast("binary")) % BORROWED).cast("int")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(c, turn, digest, words) of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null")
    return rows.select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), turn_digest(role, text).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """Rows of the rebuilt conversations in partitions sorted by (c, part, turn): part 0 begins a conversation and
    has the number of own turns to leave out, part 1 are borrowed turns, part 2 all own ones."""
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    heads = turns.withColumn("at", F.row_number().over(Window.partitionBy("c").orderBy(*order))).filter(F.col("at") < BORROWED)
    heads = heads.select(F.col("c").alias("base"), F.col("at").cast("long").alias("turn"), "digest", "words")
    convs = turns.groupBy("c").agg(F.lit(0).alias("part")).withColumn("skip", borrowed(F.col("c")))
    begins = convs.select("c", "part", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.col("skip").cast("long").alias("words"))
    taken = convs.withColumn("base", F.col("c") - F.col("c") % FAMILY).join(heads, "base").filter(F.col("turn") <= F.col("skip"))
    rows = begins.unionByName(taken.select("c", F.lit(1).alias("part"), "turn", "digest", "words"))
    rows = rows.unionByName(turns.select("c", F.lit(2).alias("part"), "turn", "digest", "words"))
    return rows.repartition("c").sortWithinPartitions("c", "part", *order)


def _chained(batches):
    """A row for each prefix; the last one is held back until it is known what follows."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    names = [part.split()[0] for part in _PREFIX.split(", ")]

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    held, skip = None, 0
    for batch in batches:
        out = []
        for c, part, digest, words in zip(*(batch.column(k).to_pylist() for k in ("c", "part", "digest", "words")), strict=True):
            if part == 0:
                if held:
                    out.append((*held, True))
                held, skip = (c, 0, ROOT, None, 0), words
            elif part == 2 and skip:
                skip -= 1
            else:
                out.append((*held, False))
                held = (c, held[1] + 1, hashlib.sha256(held[2] + digest).digest(), held[2], words)
        if out:
            yield told(out)
    if held:
        yield told([(*held, True)])


def _ends(batches):
    """The digest of each node's sorted members, joined by commas."""
    import pyarrow as pa

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows])], ["digest", "ends_sha256"])

    node, state = None, None
    for batch in batches:
        out = []
        for digest, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = digest, hashlib.sha256(str(c).encode())
            else:
                state.update(b",%d" % c)
        if out:
            yield told(out)
    if node is not None:
        yield told([(node, state.hexdigest())])


def _to_ancestors(values: DataFrame, prefixes: DataFrame, nodes: DataFrame, low: Column, high: Column, step: int) -> DataFrame:
    """(digest, c, depth, leaves, saved): what the nodes at depths ``low`` to ``high`` get from ``values`` of nodes below them."""
    up = values.withColumn("depth", F.explode(F.sequence(low.cast("long"), high.cast("long"), F.lit(step).cast("long"))))
    sums = [F.sum(x).alias(x) for x in ("leaves", "saved")]
    up = up.groupBy("c", "depth").agg(*sums).join(prefixes.select("c", "depth", "digest"), ["c", "depth"]).groupBy("digest").agg(*sums)
    return up.join(nodes.select("digest", "c", "depth"), "digest")


def subtree_sums(values: DataFrame, prefixes: DataFrame, nodes: DataFrame, deepest: int, step: int = 1) -> DataFrame:
    """(digest, c, depth, leaves, saved): sums over each node's subtree, of nodes at every ``step``-th depth."""
    band = BAND * step
    depth = F.col("depth")
    inside = _to_ancestors(values, prefixes, nodes, depth - depth % band, depth, step)
    if deepest < band:
        return inside
    inside = storage.materialise(inside, "trie-bands")
    tops = storage.materialise(subtree_sums(inside.filter(depth % band == 0), prefixes, nodes, deepest, band), "trie-tops")
    above = _to_ancestors(tops.filter(depth > 0), prefixes, nodes, depth - band, depth - step, step)
    both = inside.unionByName(above)
    return both.groupBy("digest", "c", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    turns = turns_of(conversations)
    prefixes = storage.materialise(rebuilt(turns).mapInArrow(_chained, _PREFIX), "prefixes")
    nodes = prefixes.groupBy("depth", "digest").agg(
        F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs"), F.any_value("parent").alias("parent"), F.any_value("words").alias("words")
    )
    nodes = storage.materialise(nodes, "trie-nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = storage.materialise(nodes.join(children, "digest", "left").fillna(0, ["n_children"]), "trie")

    values = nodes.select("c", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(values, prefixes, nodes, deepest).select("digest", "leaves", "saved")
    ends = prefixes.filter("last").select("digest", "c").repartition("digest").sortWithinPartitions("digest", "c").mapInArrow(_ends, "digest binary, ends_sha256 string")
    above = nodes.select(F.col("digest").alias("parent"), F.col("c").alias("parent_conv_id"))
    out = nodes.join(sums, "digest").join(ends, "digest", "left").join(above, "parent", "left")
    return out.select(
        F.col("c").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )
