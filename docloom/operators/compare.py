"""Likeness and differences of texts."""

from __future__ import annotations

import bisect
import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import storage
from docloom.functions.text import similarity
from docloom.operators.events import structural_similarity, structure_metrics, top_level_blocks


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro similarity, raised by a common prefix of up to four characters."""

    @F.udf("double", useArrow=True)
    def of(x: str, y: str):
        if x is None or y is None:
            return None
        if x == y:
            return 1.0
        reach = max(max(len(x), len(y)) // 2 - 1, 0)
        # A letter's places in the other text, last one first. Reaches only move on: a place passed by or taken is done with.
        places: dict[str, list[int]] = {}
        for j in range(len(y) - 1, -1, -1):
            places.setdefault(y[j], []).append(j)
        taken, left = [False] * len(y), []
        for i, c in enumerate(x):
            at = places.get(c)
            while at and at[-1] < i - reach:
                at.pop()
            if at and at[-1] <= i + reach:
                taken[at.pop()] = True
                left.append(c)
        n = len(left)
        if not n:
            return 0.0
        # Half of the letters out of place, rounded down.
        moved = sum(p != q for p, q in zip(left, (c for c, t in zip(y, taken, strict=True) if t), strict=True)) // 2
        jaro = (n / len(x) + n / len(y) + (n - moved) / n) / 3
        prefix = next((k for k, (p, q) in enumerate(zip(x[:4], y[:4], strict=False)) if p != q), min(4, len(x), len(y)))
        return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro

    return of(a, b)


def compare_documents(pairs: DataFrame, id_col: str = "doc_id", a: str = "a", b: str = "b", threshold: float = 0.85) -> DataFrame:
    """(id, text_similarity, structural_similarity, roundtrip_similarity, status) of two Markdown texts of each row."""
    x, y = (structure_metrics(pairs, id_col, c).alias(n) for c, n in ((a, "x"), (b, "y")))
    structure = x.join(y, F.col(f"x.{id_col}") == F.col(f"y.{id_col}")).select(
        F.col(f"x.{id_col}"), structural_similarity("x", "y").alias("structural_similarity")
    )
    out = pairs.select(id_col, similarity(F.col(a), F.col(b)).alias("text_similarity")).join(structure, id_col)
    both = F.col("text_similarity") * 0.6 + F.col("structural_similarity") * 0.4
    status = F.when(F.col("roundtrip_similarity") >= threshold, F.lit("ok")).otherwise(
        F.format_string("similarity %.4f is below %.4f", F.col("roundtrip_similarity"), F.lit(threshold))
    )
    return out.withColumn("roundtrip_similarity", both).withColumn("status", status)


def _middle(x: list, y: list, a: int, b: int, c: int, d: int) -> tuple[int, int, int, int]:
    """The run of equal items (from and to, in each) in the middle of a shortest script from x[a:b] to y[c:d], by searches from both ends."""
    n, m = b - a, d - c
    apart, most = n - m, (n + m + 1) // 2
    # The furthest place in x on each diagonal, from the start and from the end; diagonals that leave the field are not gone on with.
    ahead, back = {1: 0}, {1: 0}

    def furthest(reach: dict[int, int], k: int) -> int:
        down, right = reach.get(k + 1, -1), reach.get(k - 1, -2) + 1
        return max(down if down - k <= m else -1, right if right <= n else -1)

    for cost in range(most + 1):
        for k in range(-cost, cost + 1, 2):
            start = i = furthest(ahead, k)
            if i < 0:
                continue
            while i < n and i - k < m and x[a + i] == y[c + i - k]:
                i += 1
            ahead[k] = i
            if apart % 2 and abs(apart - k) < cost and i + back.get(apart - k, -n - m) >= n:
                return a + start, a + i, c + start - k, c + i - k
        for k in range(-cost, cost + 1, 2):
            start = i = furthest(back, k)
            if i < 0:
                continue
            while i < n and i - k < m and x[b - 1 - i] == y[d - 1 - i + k]:
                i += 1
            back[k] = i
            if apart % 2 == 0 and abs(apart - k) <= cost and i + ahead.get(apart - k, -n - m) >= n:
                return b - i, b - start, d - i + k, d - start + k
    raise AssertionError("two searches that end everywhere meet")


def _rising(places: list[int]) -> list[int]:
    """Where a longest rising run of distinct numbers has its members."""
    tails, ends, before = [], [], []
    for k, p in enumerate(places):
        at = bisect.bisect_left(tails, p)
        before.append(ends[at - 1] if at else None)
        tails[at:], ends[at:] = [p, *tails[at + 1 :]], [k, *ends[at + 1 :]]
    out, k = [], ends[-1] if ends else None
    while k is not None:
        out.append(k)
        k = before[k]
    return out[::-1]


def in_common(old: list, new: list) -> list[tuple[int, int]]:
    """The places of a longest common subsequence of both, in order; memory grows with their lengths only.

    Items that the other one lacks are left aside first, as they are in no common subsequence. If all others are there once, it's a
    longest rising run; otherwise the sequences are halved at a point of a shortest script.
    """
    a, b = set(old), set(new)
    i, j = [k for k, v in enumerate(old) if v in b], [k for k, v in enumerate(new) if v in a]
    x, y = [old[k] for k in i], [new[k] for k in j]
    if len(a & b) == len(x) == len(y):
        at = {v: k for k, v in enumerate(y)}
        places = [at[v] for v in x]
        return [(i[k], j[places[k]]) for k in _rising(places)]
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((i[a], j[c]))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((i[b], j[d]))
        if a < b and c < d:
            p, q, r, s = _middle(x, y, a, b, c, d)
            out += [(i[p + k], j[r + k]) for k in range(q - p)]
            todo += [(a, p, c, r), (q, b, s, d)]
    return sorted(out)


def edit_script(old: list[str], new: list[str]) -> list[tuple[str, int, int]]:
    """A shortest script of (equal | delete | insert, place in old, place in new); between equal items deletions come first."""
    script, x, y = [], 0, 0
    for i, j in [*in_common(old, new), (len(old), len(new))]:
        script += [("delete", k, y) for k in range(x, i)]
        script += [("insert", i, k) for k in range(y, j)]
        if i < len(old) or j < len(new):
            script.append(("equal", i, j))
        x, y = i + 1, j + 1
    return script


def diff_rows(old: DataFrame, new: DataFrame, id_col: str = "doc_id", place: str = "pos", text: str = "block") -> DataFrame:
    """(id, pos, op, old_text, new_text) of rows (id, place, text) before and after, in order.

    Rows that stay are ``equal``; as many rows deleted as inserted in one place are ``replace``, paired in order; others are
    ``delete`` and ``insert``, deletions first. The rows whose text the other side has meet by its hash, and only their places and hashes are
    brought together to find the longest common subsequence of a document; all else is joins and windows.
    """
    sides = {n: df.select(id_col, F.col(place).cast("long").alias("at"), F.col(text).alias("text"), F.xxhash64(text).alias("h")) for n, df in (("old", old), ("new", new))}
    shared = [
        mine.join(other.select(id_col, "h").distinct(), [id_col, "h"], "left_semi").select(id_col, "at", "h", F.lit(n).alias("side"))
        for n, mine, other in (("old", sides["old"], sides["new"]), ("new", sides["new"], sides["old"]))
    ]
    kind = old.schema[id_col].dataType.simpleString()

    def matched(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = {n: table.filter(pc.equal(table.column("side"), n)).sort_by("at") for n in ("old", "new")}
        pairs = in_common(*(rows[n].column("h").to_pylist() for n in ("old", "new")))
        taken = {n: rows[n].take(pa.array([p[k] for p in pairs], pa.int64())) for k, n in enumerate(("old", "new"))}
        return pa.table({id_col: taken["old"].column(id_col), "x": taken["old"].column("at"), "y": taken["new"].column("at")})

    pairs = storage.materialise(shared[0].unionByName(shared[1]).groupBy(id_col).applyInArrow(matched, f"`{id_col}` {kind}, x long, y long"), "diff-pairs")
    w = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def gaps(n: str, column: str) -> DataFrame:
        """A side's rows with the number of equal ones up to each, and the place in the gap behind those."""
        rows = sides[n].join(pairs.select(id_col, F.col(column).alias("at"), F.lit(1).alias("same")), [id_col, "at"], "left").fillna(0, ["same"])
        rows = rows.withColumn("gap", F.sum("same").over(w))
        return rows.withColumn("k", F.row_number().over(Window.partitionBy(id_col, "gap").orderBy("at")) - F.when(F.col("gap") > 0, 2).otherwise(1))

    a, b = gaps("old", "x"), gaps("new", "y")
    same = a.filter("same = 1").select(id_col, "gap", F.col("text").alias("old_text")).join(b.filter("same = 1").select(id_col, "gap", F.col("text").alias("new_text")), [id_col, "gap"])
    gone, come = (r.filter("same = 0").select(id_col, "gap", "k", F.col("text").alias(f"{n}_text")) for n, r in (("old", a), ("new", b)))
    counts = gone.select(id_col, "gap", F.lit(1).alias("d")).unionByName(come.select(id_col, "gap", F.lit(-1).alias("d"))).groupBy(id_col, "gap")
    even = counts.agg(F.sum("d").alias("d")).filter("d = 0").drop("d")
    paired = gone.join(come, [id_col, "gap", "k"]).join(even, [id_col, "gap"], "left_semi")
    none = F.lit(None).cast("string")
    out = [
        same.select(id_col, "gap", F.lit(-1).alias("o"), F.lit(0).alias("k"), F.lit("equal").alias("op"), "old_text", "new_text"),
        paired.select(id_col, "gap", F.lit(0).alias("o"), "k", F.lit("replace").alias("op"), "old_text", "new_text"),
        gone.join(even, [id_col, "gap"], "left_anti").select(id_col, "gap", F.lit(0).alias("o"), "k", F.lit("delete").alias("op"), "old_text", none.alias("new_text")),
        come.join(even, [id_col, "gap"], "left_anti").select(id_col, "gap", F.lit(1).alias("o"), "k", F.lit("insert").alias("op"), none.alias("old_text"), "new_text")
    ]
    rows = functools.reduce(DataFrame.unionByName, out)
    pos = F.row_number().over(Window.partitionBy(id_col).orderBy("gap", "o", "k")) - 1
    return rows.select(id_col, pos.alias("pos"), "op", "old_text", "new_text")


def block_diff(pairs: DataFrame, id_col: str = "doc_id", old: str = "old", new: str = "new") -> DataFrame:
    """``diff_rows`` of the blocks of each pair of Markdown texts; ids must be unique."""
    return diff_rows(*(top_level_blocks(pairs.select(id_col, c), id_col, c) for c in (old, new)), id_col)


def word_diff(old: Column, new: Column) -> Column:
    """Two texts as one with ``<del>`` and ``<ins>`` around words that differ."""

    def of(x: str, y: str):
        import re

        a, b = (re.findall(r"\S+|\s+", t or "") for t in (x, y))
        out, last = [], None
        for op, i, j in edit_script(a, b):
            word = b[j] if op == "insert" else a[i]
            if op != last:
                out.append({"delete": "</del>", "insert": "</ins>"}.get(last, ""))
                out.append({"delete": "<del>", "insert": "<ins>"}.get(op, ""))
            out.append(word)
            last = op
        out.append({"delete": "</del>", "insert": "</ins>"}.get(last, ""))
        return "".join(out)

    return F.udf(of, "string", useArrow=False)(old, new)  # texts are large: a hundred rows at a time


def diff_html(pairs: DataFrame, id_col: str = "doc_id", old: str = "old", new: str = "new") -> DataFrame:
    """(id, html): blocks in order; replaced ones with their words' changes, others in marked divs."""
    rows = block_diff(pairs, id_col, old, new)
    box = lambda kind, c: F.concat(F.lit(f'<div class="diff-{kind}">'), c, F.lit("</div>\n"))
    piece = F.when(F.col("op") == "equal", F.concat("new_text", F.lit("\n\n"))).when(
        F.col("op") == "replace", F.concat(word_diff(F.col("old_text"), F.col("new_text")), F.lit("\n\n"))
    ).when(F.col("op") == "delete", box("del", F.col("old_text"))).otherwise(box("ins", F.col("new_text")))
    parts = rows.select(id_col, "pos", piece.alias("p"))
    return parts.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"]), "").alias("html"))
