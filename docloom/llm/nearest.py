"""Operator 11: approximate nearest neighbours by a small-world graph per shard.

1. Equal vectors become a class, which remembers the smallest ids of its members: as many as a result can hold
   and one more, for a query's own. The window's limit works before the shuffle, so a hot vector sends a few rows a task.
2. Classes are dealt by their hash into shards of about ``SHARD`` vectors, fewer where vectors are wide. Vectors
   of different length are in different shards. A task builds one shard's graph, and the index has a row for
   each shard: vectors, hashes, ids and the neighbours of all layers as flat arrays.
3. Equal queries are one. Queries are dealt into parts of about ``QUERIES``, and every part visits every shard of
   its length: a shard travels once for each part. The walk keeps ``WIDTH`` nodes in single precision, whose
   distances are then taken in double precision.
4. The shards' results of a query are merged, ties by id, and handed to its rows, each without itself.

What is returned is exact but for nodes that a walk misses (README has the recall). Vectors that are null, empty,
zero or hold null or non-finite components take no part. A query is compared with vectors of its own length.
Rows with equal ids are separate rows, each a candidate for the others; rows without id are candidates, last among ties,
and no queries. Distances beyond double precision are infinite.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import smallworld, storage

#: Vectors of a shard, and bytes of them in double precision, about.
SHARD, SHARD_BYTES = 16384, 32 << 20
#: Tasks for each shard, most of them empty, so that few shards meet in one.
SPREAD = 3
#: Queries that visit a shard together.
QUERIES = 32768
#: Nodes that a query's walk keeps in each shard.
WIDTH = 256
NEIGHBOURS = 10

_INDEX = "dim int, shard int, n int, h1 binary, h2 binary, ids array<array<bigint>>, vectors binary, sizes array<int>, links binary"
_FOUND = "q1 long, q2 long, score double, own boolean, ids array<bigint>"


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, h1, h2, dim) of the rows that take part; equal vectors have equal hashes."""
    v = F.col("v")
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v")
    )
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    return rows.filter(v.isNotNull() & ~bad).select(
        "vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("vector"), "v").alias("h2"), F.size("v").alias("dim")
    )


def _matrix(column, n: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).reshape(n, -1)


def _build(table):
    """One shard's row of the index, the same for any order of its rows."""
    import pyarrow as pa

    h1, h2 = (table.column(k).to_numpy() for k in ("h1", "h2"))
    order = np.lexsort((h2, h1))
    x = _matrix(table.column("v"), len(h1))[order]
    graph = smallworld.build(smallworld.scaled(x))
    ids = table.column("ids").combine_chunks().take(pa.array(order))
    return pa.table(
        {
            "dim": table.column("dim").slice(0, 1), "shard": table.column("shard").slice(0, 1), "n": pa.array([len(h1)], pa.int32()),
            "h1": [h1[order].tobytes()], "h2": [h2[order].tobytes()], "ids": pa.ListArray.from_arrays(pa.array([0, len(h1)], pa.int32()), ids),
            "vectors": [x.tobytes()], "sizes": pa.array([graph.sizes], pa.list_(pa.int32())), "links": [graph.flat()]
        }
    )


def build_index(vectors: DataFrame, keep: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The index of ``vectors``, a table with a row for each shard, for searches of at most ``keep`` neighbours."""
    rows = usable_vectors(vectors, id_col, vector_col)
    first = Window.partitionBy("h1", "h2").orderBy(F.col("vec_id").asc_nulls_last())
    members = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= keep + 1)
    classes = members.groupBy("h1", "h2").agg(
        F.any_value("v").alias("v"), F.any_value("dim").alias("dim"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id"))), lambda m: m["vec_id"]).alias("ids")
    )
    classes = storage.materialise(classes, "vector-classes")
    room = F.greatest(F.lit(1), F.least(F.lit(SHARD), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    shards = classes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / room).cast("int").alias("shards"))
    dealt = classes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("h1", "h2"), F.col("shards")).cast("int"))
    # A task a shard, if hashes allow: graphs are dear, so a task is not to have several because their vectors are small.
    tasks = SPREAD * (shards.agg(F.sum("shards")).first()[0] or 1)
    dealt = dealt.repartition(tasks, "dim", "shard")
    return storage.materialise(dealt.drop("shards").groupBy("dim", "shard").applyInArrow(_build, _INDEX), "vector-index")


def distances(x: np.ndarray, nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of each row of ``q`` from the vectors that its row of ``nodes`` names, squares added in order."""
    with np.errstate(over="ignore"):
        gap = (x[nodes] - q[:, None, :]).reshape(-1, x.shape[1]).T.copy()
        return np.sqrt((gap * gap).sum(axis=0)).reshape(nodes.shape)


def _search(k: int, width: int):
    def of(index, queries):
        import pyarrow as pa

        names, kinds = zip(*(part.split(" ") for part in _FOUND.split(", ")), strict=True)
        types = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
        schema = pa.schema(list(zip(names, (types[kind] for kind in kinds), strict=True)))
        if not index.num_rows or not queries.num_rows:
            return schema.empty_table()
        one = {name: index.column(name)[0] for name in ("n", "h1", "h2", "ids", "vectors", "sizes", "links")}
        x = np.frombuffer(one["vectors"].as_buffer(), dtype="<f8").reshape(one["n"].as_py(), -1)
        h1, h2 = (np.frombuffer(one[name].as_buffer(), dtype="<i8") for name in ("h1", "h2"))
        members = one["ids"].values
        # Nearest first; of classes at one distance, the one with the smallest id.
        smallest = members.flatten().fill_null(np.iinfo(np.int64).max).to_numpy()[np.asarray(members.offsets)[:-1] - members.offsets[0].as_py()]
        graph, small, most = smallworld.from_flat(one["sizes"].as_py(), one["links"].as_buffer()), smallworld.scaled(x), np.abs(x).max()
        q1, q2 = (queries.column(name).to_numpy() for name in ("q1", "q2"))
        q = _matrix(queries.column("v"), len(q1))
        out = []
        for at in range(0, len(q), smallworld.BATCH):
            part = q[at : at + smallworld.BATCH]
            # A query far outside the shard keeps its direction only.
            found = smallworld.nearest(small, graph, np.clip(part / most, -1e15, 1e15).astype(np.float32), width)
            far = np.where(found >= 0, distances(x, found, part), np.nan)  # nan: sorted behind infinity
            best = np.lexsort((smallest[found], far))[:, : k + 1]
            found, far = np.take_along_axis(found, best, axis=1), np.take_along_axis(far, best, axis=1)
            i, j = np.nonzero(found >= 0)
            node, row = found[i, j], at + i
            own = (h1[node] == q1[row]) & (h2[node] == q2[row])
            out.append(pa.table([q1[row], q2[row], far[i, j], own, members.take(pa.array(node))], schema=schema))
        return pa.concat_tables(out)

    return of


def search_index(
    index: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, width: int = WIDTH, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row of ``queries``, itself left out.

    ``k`` is at most the number for which the index was built. A row of ``queries`` that the index does not hold has
    nothing to leave out.
    """
    rows = usable_vectors(queries, id_col, vector_col).filter("vec_id is not null")
    rows = storage.materialise(rows.select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"), "v", "dim"), "queries")
    alike = storage.materialise(rows.groupBy("q1", "q2").agg(F.any_value("v").alias("v"), F.any_value("dim").alias("dim")), "query-classes")
    counts = alike.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    visits = alike.join(counts, "dim").withColumn("part", F.pmod(F.xxhash64("q2", "q1"), F.col("parts")).cast("int"))
    visits = visits.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last")))).select("dim", "shard", "part", "q1", "q2", "v")
    parts = index.join(counts, "dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["dim", "shard", "part"]
    found = parts.groupBy(*key).cogroup(visits.groupBy(*key)).applyInArrow(_search(k, width), _FOUND)

    # Of the shards' results only the nearest members stay; the own ones are known by their first place in the own class.
    found = found.select("q1", "q2", "score", "own", "ids", F.posexplode("ids").alias("at", "vec_id")).withColumn(
        "first", F.col("own") & (F.array_position("ids", F.col("vec_id")) == F.col("at") + 1)
    )
    nearest = Window.partitionBy("q1", "q2").orderBy("score", F.col("vec_id").asc_nulls_last(), F.desc("own"), "at")
    found = found.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= k + 1)
    lists = found.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", "first"))).alias("near"))
    out = rows.select("query_id", "q1", "q2").join(lists, ["q1", "q2"])
    # A row without id is never the query's own.
    others = F.slice(F.filter("near", lambda m: ~F.coalesce(m["first"] & (m["vec_id"] == F.col("query_id")), F.lit(False))), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("at", "m"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("m.vec_id").alias("vec_id"), F.col("m.score").alias("score"))


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Builds the index of ``vectors`` and searches it for ``queries``."""
    return search_index(build_index(vectors, k, id_col, vector_col), queries, k, id_col=id_col, vector_col=vector_col)
