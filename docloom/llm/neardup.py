"""Operator 5: near-duplicate documents by bottom-k sketches.

A document's set is that of its distinct shingles of five words; words are runs of anything but ASCII
white space, A-Z lower-cased. Documents with equal word sequences form a class. Two classes are linked if
their sets' Jaccard similarity is at least 0.75.

1. One 64-bit hash function orders all shingles; a class keeps the ``SKETCH`` smallest values (the whole
   set, if that is smaller), which reach its other steps in place of the text.
2. Inverted lists are built from the ``LISTED`` smallest values. Documents that similar share at least
   ``SHARED`` of these (at 0.75 the number shared is binomial with mean 24; fewer than 12 has a
   probability of some millionths), so one shared value is among any ``LISTED - SHARED + 1`` of them.
   Each class enters the lists of that many of its values, rarest first: common passages stay out of the
   lists unless they make up a third of a document.
3. Classes of a list overlap in the values that both sketches hold. The union's sketch (the smallest values
   of both) estimates the similarity. Where both sketches are whole sets, that is exact and counts as a
   link. Otherwise pairs within ``MARGIN`` standard errors of the threshold are candidates, and verified on
   the full sets of both texts.

Two rounds keep the work of a large group in proportion to its members:

* *Contraction.* A list is cut into blocks at random, by other cuts in each of a class's first
  ``FIRST_LISTS`` lists. A block gives a spanning forest of its likeliest pairs, fewer edges than it has
  classes. The forest is verified and its components found.
* *Completion.* All lists that still hold different components are gone through whole, and only pairs
  between different components count. In a list beyond one block the largest component's classes meet the
  others, not each other; blocks hold sizes that differ by less than the threshold allows, so only
  neighbours meet. Candidates that are left are verified block by block: a block pair gets each text that
  has a candidate once, looks at its pairs in descending likeness and gives a forest of links. So no
  component misses a link, and no list of pairs is ever written.

A component's id is its smallest ``doc_id``. Documents without words (null and empty texts) have the empty
set and link with nothing. Equal rows and rows of equal ``doc_id`` are documents of their own. Rows without
``doc_id`` link as others; a component of such rows alone has a null id and keeps all of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import storage
from docloom.llm.components import components
from docloom.llm.shingles import shingle_sets

#: Values in a sketch, values that enter the inverted lists' choice, least number of these in common.
SKETCH, LISTED, SHARED = 128, 32, 12
#: Classes, and shingles of all of them, that a block of a list holds about.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Columns of a block pair's incidence matrix that are held at a time.
COLUMNS = 2048
#: Lists of each class that the contraction looks at.
FIRST_LISTS = 3
#: Standard errors by which an estimate may be off.
MARGIN = 4.5
#: The threshold as a fraction of integers: numerator * union <= denominator * intersection size.
NUMERATOR, DENOMINATOR = 75, 100

#: What a block pair tells: an exact link (a, b), or a class ``a`` with its candidates and their likeness.
_TOLD = "value long, left long, right long, a long, b long, component long, partners array<long>, likeness array<float>"


def _sketched(batches):
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            key1, key2, sizes, sketches = [], [], [], []
            for words, x in shingle_sets(part.column(1).to_pylist()):
                digest = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
                key1.append(int.from_bytes(digest[:8], "little", signed=True))
                key2.append(int.from_bytes(digest[8:], "little", signed=True))
                sizes.append(len(x))
                sketches.append(x[:SKETCH].tobytes())
            columns = [pa.array(key1, pa.int64()), pa.array(key2, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *columns], ["doc_id", "text_hash", "k1", "k2", "n", "sketch"])


def _values(batches):
    """(c, value, m): the smallest values of each sketch as signed integers; m is how many there are."""
    import pyarrow as pa

    for batch in batches:
        sketches = [np.frombuffer(s, dtype="<u8")[:LISTED] for s in batch.column(1).to_pylist()]
        m = np.array([len(s) for s in sketches], dtype=np.int32)
        c = np.repeat(batch.column(0).to_numpy(), m)
        value = np.concatenate(sketches) if sketches else np.empty(0, dtype="<u8")
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()), pa.array(value.view("<i8"), pa.int64()), pa.array(np.repeat(m, m), pa.int32())], ["c", "value", "m"]
        )


def _least_estimate(k: np.ndarray, union: np.ndarray) -> np.ndarray:
    """What an estimate from ``k`` of ``union`` values reaches almost surely at the threshold."""
    j = NUMERATOR / DENOMINATOR
    rest = np.clip(1 - (k - 1) / np.maximum(union - 1, 1), 0, 1)
    return j - MARGIN * np.sqrt(j * (1 - j) / np.maximum(k, 1) * rest) - 1e-9


def _overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``one`` shares with each of ``two``."""
    n1, n2 = [len(x) for x in one], [len(x) for x in two]
    values, inverse = np.unique(np.concatenate(one + two), return_inverse=True)
    at1, at2 = inverse[: sum(n1)], inverse[sum(n1) :]
    row1, row2 = np.repeat(np.arange(len(one)), n1), np.repeat(np.arange(len(two)), n2)
    # Values on one side only, and those of one class met with itself, need no column.
    seen1, seen2 = np.bincount(at1, minlength=len(values)), np.bincount(at2, minlength=len(values))
    both = (seen1 > 0) & (seen2 > 0) & ((seen1 + seen2 > 2) | (one is not two))
    column = np.cumsum(both) - 1
    shared = np.zeros((len(one), len(two)), dtype=np.float32)
    for first in range(0, int(both.sum()), COLUMNS):
        sides = []
        for row, at, n in ((row1, at1, len(one)), (row2, at2, len(two))):
            own = both[at] & (column[at] >= first) & (column[at] < first + COLUMNS)
            x = np.zeros((n, COLUMNS), dtype=np.float32)
            x[row[own], column[at[own]] - first] = 1
            sides.append(x)
        shared += sides[0] @ sides[1].T
    return shared


def _reach(sketches: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """[i, j]: how many values of sketch j are at most the i-th end."""
    return np.stack([np.searchsorted(x, ends, side="right").astype(np.int16) for x in sketches], axis=1)


def _meeting(lists1: list, lists2: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the sorted arrays ``lists1[i]`` and ``lists2[j]`` of each pair have a value in common."""
    if len(i) > 4 * (len(lists1) + len(lists2)):
        return _overlaps(lists1, lists2)[i, j] > 0
    of1, of2 = [set(x.tolist()) for x in lists1], [set(x.tolist()) for x in lists2]
    return np.array([not of1[a].isdisjoint(of2[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=bool)


class _Side:
    """Classes of a block, from rows (c, n, component, sketch, entries)."""

    def __init__(self, rows: list):
        self.c, self.n, self.component = (np.array([r[k] for r in rows]) for k in range(3))
        self.sketches, self.entries = [r[3] for r in rows], [r[4] for r in rows]


def near_pairs(one: _Side, two: _Side, before: int | None):
    """Indices (i, j) of links and candidates between different components, their likeness, and which are sure.

    With ``before`` a pair counts only if its classes share no list whose value is smaller.
    """
    same = one is two
    none = (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0), np.empty(0, dtype=bool))
    maybe = one.component[:, None] != two.component[None, :]
    maybe &= np.maximum(one.n[:, None], two.n[None, :]) * NUMERATOR <= np.minimum(one.n[:, None], two.n[None, :]) * DENOMINATOR
    if same:
        maybe = np.triu(maybe, 1)
    if not maybe.any():
        return none
    shared = _overlaps(one.sketches, two.sketches)
    # A generous first cut: so many shared values an admissible pair has at least.
    n1, n2 = np.minimum(one.n, SKETCH), np.minimum(two.n, SKETCH)
    maybe &= shared >= np.minimum(n1[:, None], n2[None, :]) * np.float32(0.45)
    i, j = np.nonzero(maybe)
    if before is not None and len(i):
        apart = ~_meeting([x[x < before] for x in one.entries], [x[x < before] for x in two.entries], i, j)
        i, j = i[apart], j[apart]
    if not len(i):
        return none
    common = shared[i, j].astype(np.int64)
    whole = (one.n[i] <= SKETCH) & (two.n[j] <= SKETCH)
    sure = whole & (common * DENOMINATOR >= NUMERATOR * (one.n[i] + two.n[j] - common))
    # Beyond the smaller end of a cut sketch nothing is known; what is shared lies before it.
    most = np.iinfo(np.uint64).max
    end1, end2 = (np.array([x[-1] if n > SKETCH else most for x, n in zip(s.sketches, s.n.tolist(), strict=True)], dtype=np.uint64) for s in (one, two))
    known1 = np.minimum(_reach(one.sketches, end2)[j, i], n1[i])
    known2 = np.minimum(_reach(two.sketches, end1)[i, j], n2[j])
    k = known1 + known2 - common
    likeness = common / k
    keep = sure | (~whole & (likeness >= _least_estimate(k, (one.n[i] + two.n[j]) / (1 + likeness))))
    return i[keep], j[keep], likeness[keep], sure[keep]


def spanning_forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges (a, b) of a spanning forest of largest weight, and the component of each node (its smallest one)."""
    root, chosen = np.arange(nodes), np.zeros(len(a), dtype=bool)
    order = np.argsort(-weight, kind="stable")
    a, b = a[order], b[order]
    live = np.flatnonzero(a != b)
    while len(live):
        # Each component's best edge to another one.
        best = np.full(nodes, len(a))
        np.minimum.at(best, root[a[live]], live)
        np.minimum.at(best, root[b[live]], live)
        pick = np.unique(best[best < len(a)])
        chosen[pick] = True
        x, y = root[a[pick]], root[b[pick]]
        to = np.arange(nodes)
        while True:
            new = to.copy()
            np.minimum.at(new, x, to[y])
            np.minimum.at(new, y, to[x])
            new = new[new]
            if (new == to).all():
                break
            to = new
        root = to[root]
        live = live[root[a[live]] != root[b[live]]]
    return order[chosen], root


def _told(key: tuple, one: _Side, two: _Side, contract: bool) -> list[tuple]:
    """Rows of ``_TOLD`` for a block pair."""
    i, j, likeness, sure = near_pairs(one, two, None if contract else key[0])
    if not len(i):
        return []
    names, at = np.unique(np.concatenate((one.component, two.component)), return_inverse=True)
    of1, of2 = at[: len(one.c)], at[len(one.c) :]
    edges, root = spanning_forest(of1[i[sure]], of2[j[sure]], likeness[sure], len(names))
    i_sure, j_sure = i[sure][edges], j[sure][edges]
    out = [(*key, x, y, None, None, None) for x, y in zip(one.c[i_sure].tolist(), two.c[j_sure].tolist(), strict=True)]
    # What sure links have joined already needs no text.
    i, j, likeness = i[~sure], j[~sure], likeness[~sure]
    apart = root[of1[i]] != root[of2[j]]
    i, j, likeness = i[apart], j[apart], likeness[apart]
    if contract and len(i):
        edges, _ = spanning_forest(root[of1[i]], root[of2[j]], likeness, len(names))
        i, j, likeness = i[edges], j[edges], likeness[edges]
    if not len(i):
        return out
    order = np.argsort(i, kind="stable")
    i, j, likeness = i[order], j[order], likeness[order]
    cuts = np.flatnonzero(np.diff(i, prepend=-1))
    for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(i)], strict=True):
        x = int(i[low])
        out.append((*key, int(one.c[x]), None, int(names[root[of1[x]]]), two.c[j[low:high]].tolist(), likeness[low:high].tolist()))
    lone = np.setdiff1d(two.c[j], one.c[i])
    place = dict(zip(two.c.tolist(), range(len(two.c)), strict=True))
    out += [(*key, c, None, int(names[root[of2[place[c]]]]), [], []) for c in lone.tolist()]
    return out


def _items(column) -> list:
    """A column's values; lists of numbers as arrays."""
    import pyarrow as pa

    if not pa.types.is_list(column.type):
        return column.to_pylist()
    values, cuts = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [values[low:high] for low, high in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]


def _by_pair(batches):
    """(block pair, the rows' other columns) for each run of rows with equal first three columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(_items(batch.column(k)) for k in range(batch.num_columns)), strict=True):
            if row[:3] != key:
                if rows:
                    yield key, rows
                key, rows = row[:3], []
            rows.append(row[3:])
    if rows:
        yield key, rows


def _compared(contract: bool):
    def of(batches):
        import pyarrow as pa

        types = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.list_(pa.float32())]
        names = [x.split()[0] for x in _TOLD.split(", ")]
        out = []
        for key, rows in _by_pair(batches):
            sides = [[(*r[1:4], np.frombuffer(r[4], dtype="<u8"), r[5]) for r in rows if r[0] == s] for s in (0, 1)]
            one = _Side(sides[0])
            out += _told(key, one, one if key[1] == key[2] else _Side(sides[1]), contract)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return of


def _is_link(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(x) + len(y) - len(np.union1d(x, y))
    return DENOMINATOR * common >= NUMERATOR * (len(x) + len(y) - common)


def _verified(batches):
    """A forest (a, b) of the candidates of each block pair that reach the threshold on their full sets."""
    import pyarrow as pa

    def texts_hashed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [x.tobytes() for _, x in shingle_sets(part.column(part.num_columns - 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sets, pa.binary())], part.schema.names)

    out = []
    for _, rows in _by_pair(texts_hashed(batches)):
        sets = {r[0]: np.frombuffer(r[4], dtype="<u8") for r in rows}
        group = {r[0]: r[1] for r in rows}
        root: dict[int, int] = {}

        def find(x, root=root):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        one = np.repeat([r[0] for r in rows], [len(r[2]) for r in rows])
        two, order = np.concatenate([r[2] for r in rows]), np.argsort(-np.concatenate([r[3] for r in rows]), kind="stable")
        for a, b in zip(one[order].tolist(), two[order].tolist(), strict=True):
            x, y = find(group[a]), find(group[b])
            if x != y and _is_link(sets[a], sets[b]):
                root[max(x, y)] = min(x, y)
                out.append((a, b))
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])


_PAIR = ["value", "left", "right"]


def _blocks() -> Column:
    return F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")


def _contracting(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of ``_TOLD`` from the random blocks of each class's first lists."""
    members = lists.filter(F.col("turn") < FIRST_LISTS)
    crowd = members.groupBy("value").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).filter("m > 1").select("value", _blocks().alias("blocks"))
    block = F.pmod(F.xxhash64("c", "value"), F.col("blocks"))
    met = members.join(crowd, "value").select("value", block.alias("left"), block.alias("right"), "c", "n").join(classes.select("c", "sketch"), "c")
    met = met.select(*_PAIR, F.lit(0).alias("side"), "c", "n", F.col("c").alias("component"), "sketch", F.array().cast("array<long>").alias("entries"))
    return met.repartition(*_PAIR).sortWithinPartitions(*_PAIR).mapInArrow(_compared(True), _TOLD)


def _completing(lists: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``_TOLD`` from all lists that hold different components."""
    members = lists.join(labels.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    held = members.groupBy("value", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    mixed = held.groupBy("value").agg(
        F.count(F.lit(1)).alias("components"), F.sum("m").alias("m"), F.sum("total").alias("total"),
        F.max_by("component", F.struct("m", "component")).alias("main")
    )
    mixed = mixed.filter("components > 1").select("value", "main", (_blocks() > 1).alias("large"))
    members = members.join(mixed, "value")
    entries = members.groupBy("c").agg(F.collect_list("value").alias("entries"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DENOMINATOR / NUMERATOR))).cast("int")
    members = members.withColumns(
        {"band": F.when(F.col("large"), band).otherwise(0), "main": (F.col("large") & (F.col("component") == F.col("main"))).cast("int")}
    )
    kind = ["value", "band", "main"]
    crowd = members.groupBy(*kind).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).withColumn("blocks", _blocks())
    own = members.join(crowd.select(*kind, "blocks"), kind).withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")))
    other = crowd.select(
        "value", F.col("band").alias("band2"), F.col("main").alias("main2"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    )
    met = own.join(other, "value").filter((F.abs(F.col("band") - F.col("band2")) <= 1) & (F.col("main") + F.col("main2") < 2))
    number = lambda band, main, block: (F.col(band).cast("long") * 2 + F.col(main)) * F.lit(1 << 32) + F.col(block)
    met = met.withColumns({"x": number("band", "main", "own"), "y": number("band2", "main2", "with")})
    met = met.select(
        "value", F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), (F.col("x") > F.col("y")).cast("int").alias("side"),
        "c", "n", "component"
    )
    # A block pair is worth a task's time only with different components, on both sides.
    busy = met.groupBy(*_PAIR).agg(F.min("side").alias("lo"), F.max("side").alias("hi"), F.min("component").alias("least"), F.max("component").alias("most"))
    busy = busy.filter("least <> most and (left = right or lo <> hi)").select(*_PAIR)
    met = met.join(busy, _PAIR).join(classes.select("c", "sketch").join(entries, "c"), "c")
    met = met.select(*_PAIR, "side", "c", "n", "component", "sketch", "entries").repartition(*_PAIR).sortWithinPartitions(*_PAIR)
    return met.mapInArrow(_compared(False), _TOLD)


def _links(told: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of sure links and of candidates that ``texts`` (a, text) confirm."""
    open_ones = told.filter("b is null").join(texts, "a").select(*_PAIR, "a", "component", "partners", "likeness", "text")
    checked = open_ones.repartition(*_PAIR).sortWithinPartitions(*_PAIR).mapInArrow(_verified, "a long, b long")
    return told.filter("b is not null").select("a", "b").unionByName(checked)


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketched = rows.mapInArrow(_sketched, "doc_id long, text_hash long, k1 long, k2 long, n long, sketch binary")
    sketched = storage.materialise(sketched, "near-sketches")
    classes = sketched.groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("one"), F.min("doc_id").alias("first_id"), F.max("n").alias("n"),
        F.any_value("sketch").alias("sketch")
    )
    classes = storage.materialise(classes.withColumn("c", F.monotonically_increasing_id()), "near-classes")

    values = storage.materialise(classes.filter("n > 0").select("c", "sketch").mapInArrow(_values, "c long, value long, m int"), "near-values")
    common = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # Values of one class alone come first in its order and need no list: the others fill what is left.
    counted = values.join(common, "value")
    room = F.col("m") - F.floor(F.col("m") * SHARED / LISTED) + 1 - (F.col("m") - F.size("v"))
    entries = counted.groupBy("c", "m").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    entries = entries.filter(room > 0).select("c", F.posexplode(F.slice("v", F.lit(1), room.cast("int"))).alias("turn", "v")).select("c", "turn", "v.value")
    lists = storage.materialise(entries.join(classes.select("c", "n"), "c").select("c", "n", "turn", "value"), "near-lists")

    # One text stands for a class; texts are read again for candidates alone.
    place = ["text_hash", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc")]
    ones = classes.select("c", "one.*").select(F.col("c").alias("a"), *place)

    def linked(told: DataFrame) -> DataFrame:
        told = storage.materialise(told, "near-told")
        wanted = ones.join(told.filter("b is null").select("a").distinct(), "a")
        texts = rows.select("text", *place).join(wanted, ["doc", "text_hash"]).groupBy("a").agg(F.any_value("text").alias("text"))
        return storage.materialise(_links(told, texts), "near-links")

    first = linked(_contracting(lists, classes))
    second = linked(_completing(lists, classes, components(first)))
    labels = components(first.unionByName(second)).withColumnRenamed("id", "c")
    told = classes.select("c", "k1", "k2", "first_id").join(labels, "c", "left").withColumn("component", F.coalesce("component", "c"))
    smallest = told.groupBy("component").agg(F.min("first_id").alias("component_id"))
    told = told.join(smallest, "component").select("k1", "k2", "component_id")
    out = sketched.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles")).join(told, ["k1", "k2"])
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept")
    )
