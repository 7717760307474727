"""Operator 3: near-duplicate vectors by cross-polytope hashing.

1. Equal vectors of one label become a class with a size (a hot vector is summed up before the shuffle).
2. A class is hashed in some tables, ``TABLES`` at least: for each polytope three sign flips, each followed by a fast
   Hadamard transform, then the signed axis nearest to the result. A table's code joins the axes of some
   polytopes, the number of which follows the logarithm of the number of classes. A class also stands in
   its ``PROBES`` next best buckets. More polytopes or wider vectors make a table miss more pairs, so the
   number of tables is that by which a pair right at the threshold is missed with a chance of ``MISSED`` at most.
3. Bucket sizes come from ids and codes alone; classes alone in a bucket go. A bucket larger than
   ``BLOCK`` is cut into blocks, and every pair of blocks is a task's work by itself: numbers of links need all
   comparisons, but a vector travels once for each block of its bucket, not for each class.
4. Vectors meet in their buckets and are compared in double precision. A pair counts in the first bucket
   that both stand in, so no list of pairs is needed: a block pair gives, for each class, the number of
   vectors linked with it and the smallest class it is connected to.
5. Numbers are summed and components found by joins.

Vectors that are null, empty, zero or hold null or non-finite components, and those without label, link
with nothing. Vectors of different length are never compared. Rows with equal ``vec_id`` are separate
vectors. A component's id is its smallest ``vec_id``, null if it has none.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import storage
from docloom.llm.components import components

THRESHOLD = 0.98
#: Tables at least, and further buckets of a vector in each.
TABLES, PROBES = 4, 2
#: Bound on the share of pairs right at the threshold that meet in no table.
MISSED = 1e-4
#: Narrower vectors are padded with zeros: few axes know few rotations, and tables would miss the same pairs.
NARROWEST = 64
#: Classes of a bucket that travel together: beyond it a bucket is cut, and a class goes to each pair of blocks.
BLOCK = 4096
#: Classes that are compared with each other in one step.
PART = 512
#: Classes for each bucket of a table, about, if codes were even.
CROWD = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the length is a power of two."""
    rows, n = x.shape
    half = 1
    while half < n:
        x = x.reshape(rows, -1, 2, half)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(rows, n)
        half *= 2
    return x / math.sqrt(n)


def axes_of(dim: int) -> int:
    """The power of two to which vectors of that length are padded."""
    return max(NARROWEST, 1 << max(0, dim - 1).bit_length())


def bucket_codes(unit: np.ndarray, polytopes: int, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, 1 + probes) codes: the own bucket of each table, then the best ones next to it.

    A probe replaces the nearest axis of one polytope by its second nearest, where that loses least.
    """
    rows, dim = unit.shape
    size = axes_of(dim)
    x = np.zeros((rows, size))
    x[:, :dim] = unit
    rng = np.random.default_rng(dim)
    out = np.empty((rows, tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        first, second, loss = [], [], []
        for _ in range(polytopes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            best = np.argpartition(-np.abs(y), min(1, size - 1), axis=1)[:, :2]
            value = np.take_along_axis(y, best, axis=1)
            order = np.argsort(-np.abs(value), axis=1, kind="stable")
            best, value = np.take_along_axis(best, order, axis=1), np.take_along_axis(value, order, axis=1)
            axes = best * 2 + (value < 0)
            first.append(axes[:, 0])
            second.append(axes[:, -1])
            loss.append(np.abs(value[:, 0]) - np.abs(value[:, -1]))
        code = sum(a * (2 * size) ** p for p, a in enumerate(first))
        cheap = np.argsort(np.stack(loss, axis=1), axis=1, kind="stable")
        swap = np.stack([(b - a) * (2 * size) ** p for p, (a, b) in enumerate(zip(first, second, strict=True))], axis=1)
        out[:, t, 0] = code
        for k in range(probes):
            out[:, t, 1 + k] = code + np.take_along_axis(swap, cheap[:, [k % polytopes]], axis=1)[:, 0]
    return out


def pairs_at(cosine: float, n: int, dim: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors of that cosine."""
    rng = np.random.default_rng(seed)
    x, y = rng.standard_normal((2, n, dim))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.sqrt((y * y).sum(axis=1))[:, None]
    return x, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * y


def meet(x: np.ndarray, y: np.ndarray, polytopes: int, tables: int) -> np.ndarray:
    """(rows, tables): whether the vectors of a row share a bucket of the table."""
    a, b = bucket_codes(x, polytopes, tables), bucket_codes(y, polytopes, tables)
    return (a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3))


@functools.lru_cache
def tables_for(dim: int, polytopes: int, threshold: float = THRESHOLD) -> int:
    """Tables by which a pair at the threshold is missed with a chance of ``MISSED`` at most.

    The chance of one table comes from random pairs, plus three standard errors; tables are independent.
    """
    size = axes_of(dim)
    n = max(500, (1 << 17) // size)
    met = meet(*pairs_at(threshold, n, size), polytopes, TABLES)
    miss = 1 - met.mean() + 1 / met.size
    miss += 3 * math.sqrt(miss * max(0.0, 1 - miss) / met.size)
    if miss >= 1:
        raise ValueError(f"vectors of cosine {threshold} do not meet by hashing")
    return max(TABLES, math.ceil(math.log(MISSED) / math.log(miss)))


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _hashed(polytopes: int, tables: int):
    def of(batches):
        import pyarrow as pa

        for batch in batches:
            ids, vectors = batch.column(0).to_pylist(), [np.asarray(v, dtype="<f8") for v in batch.column(2).to_pylist()]
            scale = [v / np.abs(v).max() for v in vectors]
            for dim in sorted({len(v) for v in scale}):
                at = [i for i, v in enumerate(scale) if len(v) == dim]
                raw = [scale[i].tobytes() for i in at]
                codes = bucket_codes(_unit(raw), polytopes, tables)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in at], pa.int64()), batch.column(1).take(pa.array(at)), pa.array(raw, pa.binary()),
                        pa.array(codes.reshape(len(at), -1).tolist(), pa.list_(pa.int64())), pa.array([dim] * len(at), pa.int32())
                    ],
                    ["c", "size", "vector", "codes", "dim"]
                )

    return of


def _compare(key: tuple, rows: list, threshold: float):
    """Links between the classes of a block pair: (c, links, smallest class connected)."""
    _, _, table, code, left, right = key
    c, size, side = (np.concatenate([r[k] for r in rows]) for k in range(3))
    unit = _unit([v for r in rows for v in r[3]])
    sets = np.concatenate([r[4] for r in rows]).reshape(len(c), -1, 1 + PROBES)
    one, two = (np.arange(len(c)),) * 2 if left == right else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    links, ends = np.zeros(len(c), dtype=np.int64), []
    for x in range(0, len(one), PART):
        for y in range(x if left == right else 0, len(two), PART):
            near = unit[one[x : x + PART]] @ unit[two[y : y + PART]].T >= threshold
            if left == right and x == y:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            i, j = one[x + i], two[y + j]
            met = _met_before(sets, i, j, table, code)
            i, j = i[~met], j[~met]
            if len(i):
                np.add.at(links, i, size[j])
                np.add.at(links, j, size[i])
                root = _smallest(c, i, j)
                at = np.flatnonzero(root != c)
                # Of the links a forest is enough to go on: each class and the smallest one that it reaches.
                ends.append((at, root[at]))
    if not ends:
        return None
    places = np.argsort(c)
    i = np.concatenate([at for at, _ in ends])
    j = places[np.searchsorted(c, np.concatenate([to for _, to in ends]), sorter=places)]
    has = links > 0
    return c[has], links[has], _smallest(c, i, j)[has]


def _met_before(sets: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, code: int) -> np.ndarray:
    """Whether the classes of a pair, with buckets ``sets`` (rows, tables, buckets), share one before ``code`` of ``table``."""
    met = np.ones(len(i), dtype=bool)
    at = np.arange(len(i))
    for t in range(table + 1):
        if not len(at):
            break
        own, other = sets[i[at], t], sets[j[at], t]
        found = np.zeros(len(at), dtype=bool)
        for p in range(1 + PROBES):
            same = (other == own[:, [p]]).any(axis=1)
            found |= same & (own[:, p] < code) if t == table else same
        at = at[~found]
    met[at] = False
    return met


def _smallest(c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of ``c`` that each one is connected to by the edges (i, j)."""
    root = c.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        if (new == root).all():
            return root
        root = new


def _compared(threshold: float):
    def of(batches):
        import pyarrow as pa

        def told(found):
            c, links, root = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c), pa.array(links), pa.array(root)], ["c", "links", "root"])

        key, rows, found = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            c, size, side = (batch.column(k).to_numpy() for k in (6, 7, 8))
            vectors = batch.column(9).to_pylist()
            sets = np.asarray(batch.column(10).flatten()).reshape(len(keys), -1)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if keys[a] != key:
                    if key is not None and (x := _compare(key, rows, threshold)):
                        found.append(x)
                    key, rows = keys[a], []
                rows.append((c[a:b], size[a:b], side[a:b], vectors[a:b], sets[a:b]))
            if found:
                yield told(found)
                found = []
        if key is not None and (x := _compare(key, rows, threshold)):
            yield told([x])

    return of


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``."""
    spark = vectors.sparkSession
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v")
    )
    usable = F.coalesce(F.col("label").isNotNull() & v.isNotNull() & ~bad, F.lit(False))
    rows = rows.withColumns({"h1": F.when(usable, F.xxhash64("label", "v")), "h2": F.when(usable, F.xxhash64(F.lit("vector"), "label", "v"))})
    classes = rows.filter("h1 is not null").groupBy("h1", "h2", "label").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("size"), F.any_value("v").alias("v")
    )
    classes = storage.materialise(classes.withColumn("c", F.monotonically_increasing_id()), "vector-classes")

    widest = classes.agg(F.max(F.size("v")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    base = 2 * axes_of(widest["d"] or 1)
    polytopes = max(2, math.ceil(math.log(max(1, widest["n"] / CROWD)) / math.log(base)))
    tables = tables_for(widest["d"] or 1, polytopes, threshold)
    schema = "c long, size long, vector binary, codes array<long>, dim int"
    hashed = storage.materialise(classes.select("c", "size", "v").mapInArrow(_hashed(polytopes, tables), schema), "vector-codes")

    places = hashed.join(classes.select("c", "label"), "c").select("c", "label", "dim", F.posexplode("codes").alias("at", "code"))
    places = places.select("c", "label", "dim", F.floor(F.col("at") / (1 + PROBES)).cast("int").alias("table"), "code").distinct()
    bucket = ["label", "dim", "table", "code"]
    crowds = places.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    places = places.join(crowds, bucket).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    places = places.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    # Each block meets itself and every other one.
    places = places.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    places = places.select(
        "c", *bucket, F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right"),
        (F.col("block") > F.col("with")).cast("int").alias("side")
    )
    pair = [*bucket, "left", "right"]
    meeting = places.join(hashed.drop("dim"), "c").select(*pair, "c", "size", "side", "vector", "codes")
    meeting = meeting.repartition(*pair).sortWithinPartitions(*pair)
    found = storage.materialise(meeting.mapInArrow(_compared(threshold), "c long, links long, root long"), "vector-links")

    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    of = components(found.select(F.col("c").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "c")
    told = classes.select("c", "h1", "h2", "first_id", "size").join(links, "c", "left").join(of, "c", "left").withColumn(
        "component", F.coalesce("component", "c")
    )
    smallest = told.groupBy("component").agg(F.min("first_id").alias("component_id"))
    told = told.join(smallest, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "h1", "h2").join(told, ["h1", "h2"], "left")
    out = out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
