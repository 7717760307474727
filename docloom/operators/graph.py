"""Layered layout of directed graphs: cycle removal, ranks, coordinates, paths, frames of subgraphs.

Graphs are rows: nodes (graph_id, id, label, ord), edges (graph_id, src, dst, ord). A collection has many
graphs; each step works on all of them at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import storage


def build_graph(mentions: DataFrame) -> DataFrame:
    """One row for each node of (graph_id, id, label, shape, ord) mentions.

    The first mention gives the place; the first label that isn't the id, and the first shape, are taken.
    """
    first = lambda c, when: F.min_by(c, F.when(when, F.col("ord")))
    named = F.col("label").isNotNull() & (F.col("label") != F.col("id"))
    nodes = mentions.groupBy("graph_id", "id").agg(
        F.min("ord").alias("ord"), first("label", named).alias("label"), first("shape", F.col("shape").isNotNull()).alias("shape")
    )
    return nodes.withColumn("label", F.coalesce("label", "id"))


def in_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counts = edges.groupBy("graph_id", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    return nodes.select("graph_id", "id").join(counts, ["graph_id", "id"], "left").withColumn("n_in", F.coalesce("n_in", F.lit(0)))


def remove_cycles(edges: DataFrame) -> DataFrame:
    """Reverses the edges that close a cycle in a depth-first walk (nodes and edges in the order of ``ord``).

    Edges of the same ends have the same fate, so the walk sees each pair of ends once, at its first edge: a graph's distinct pairs
    are one group's work, and the verdicts are joined to its edges. Loops of one node are dropped.
    """

    def closing(key, pairs):
        import pandas as pd

        pdf = pairs.sort_values("ord", kind="stable")
        nexts: dict[str, list[str]] = {}
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            nexts.setdefault(a, []).append(b)
            nexts.setdefault(b, [])
        done: dict[str, bool] = {}
        back = []
        for root in nexts:
            if root in done:
                continue
            done[root] = False
            walk = [(root, iter(nexts[root]))]
            while walk:
                node, rest = walk[-1]
                for b in rest:
                    if b not in done:
                        done[b] = False
                        walk.append((b, iter(nexts[b])))
                        break
                    if not done[b]:
                        back.append((key[0], node, b))
                else:
                    done[node] = True
                    walk.pop()
        return pd.DataFrame(back, columns=["graph_id", "src", "dst"])

    kind = edges.schema["graph_id"].dataType.simpleString()
    ends = ["graph_id", "src", "dst"]
    rows = edges.select("graph_id", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("ord").cast("long").alias("ord"))
    pairs = rows.groupBy(*ends).agg(F.min("ord").alias("ord"))
    back = pairs.groupBy("graph_id").applyInPandas(closing, f"graph_id {kind}, src string, dst string").withColumn("reversed", F.lit(True))
    told = rows.filter("src <> dst").join(back, ends, "left").withColumn("reversed", F.coalesce("reversed", F.lit(False)))
    turned = F.col("reversed")
    return told.select(
        "graph_id", F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"), "ord", "reversed"
    )


#: Distinct edges of a graph whose ranks are one group's work.
GROUPED = 200_000


def assign_ranks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, id, rank): the longest path from a node without incoming edges; edges must have no cycle.

    A graph of up to ``GROUPED`` distinct edges is ranked in one task, however long its paths are. A larger one is gone through edge by edge
    of its longest path (``ranks_by_rounds``).
    """
    edges = edges.select("graph_id", "src", "dst").distinct()
    nodes = nodes.select("graph_id", "id").distinct()
    large = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUPED).select("graph_id")
    large = storage.materialise(large, "large-graphs")
    kind = edges.schema["graph_id"].dataType.simpleString()

    def ranked(key, own, pairs):
        import pandas as pd

        nexts: dict[str, list[str]] = {n: [] for n in own["id"]}
        left = dict.fromkeys(nexts, 0)
        for a, b in zip(pairs["src"], pairs["dst"], strict=True):
            nexts.setdefault(a, []).append(b)
            left[b] = left.get(b, 0) + 1
        rank = {n: 0 for n in nexts if not left.get(n)}
        todo, seen = list(rank), 0
        while todo:
            a = todo.pop()
            seen += 1
            for b in nexts.get(a, ()):
                rank[b] = max(rank.get(b, 0), rank[a] + 1)
                left[b] -= 1
                if not left[b]:
                    todo.append(b)
        if seen < len({*nexts, *left}):
            raise ValueError("edges have a cycle")
        return pd.DataFrame({"graph_id": key[0], "id": list(rank), "rank": list(rank.values())})

    small = lambda df, name: df.join(large, "graph_id", "left_anti").withColumnRenamed("graph_id", name).groupBy(name)
    out = small(nodes, "of_nodes").cogroup(small(edges, "of_edges")).applyInPandas(ranked, f"graph_id {kind}, id string, rank int")
    if large.head(1):
        out = out.unionByName(ranks_by_rounds(nodes.join(large, "graph_id", "left_semi"), edges.join(large, "graph_id", "left_semi")))
    return out


def ranks_by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``assign_ranks`` of distinct nodes and edges of any number.

    A round goes one edge further from all nodes that paths of a length reach, each of which it holds once;
    it is written to the shared folder. A path longer than there are nodes is an error: a cycle.
    """
    reached = nodes.join(edges.select("graph_id", F.col("dst").alias("id")), ["graph_id", "id"], "left_anti")
    reached = storage.materialise(reached, "ranks")
    rounds, most = [], nodes.count()
    while reached.head(1):
        rounds.append(reached.withColumn("rank", F.lit(len(rounds))))
        if len(rounds) > most:
            raise ValueError("edges have a cycle")
        further = reached.join(edges, (reached["graph_id"] == edges["graph_id"]) & (reached["id"] == edges["src"]))
        reached = storage.materialise(further.select(edges["graph_id"], F.col("dst").alias("id")).distinct(), "ranks")
    if not rounds:
        return nodes.limit(0).withColumn("rank", F.lit(0))
    return reduce(DataFrame.unionByName, rounds).groupBy("graph_id", "id").agg(F.max("rank").alias("rank"))


def barycenters(ranks: DataFrame, edges: DataFrame, sweeps: int = 4) -> DataFrame:
    """(graph_id, id, rank, place): nodes of a rank ordered by their neighbours' mean place, down and up in turn."""
    w = Window.partitionBy("graph_id", "rank")
    placed = ranks.withColumn("place", F.row_number().over(w.orderBy("id")) - 1)
    for k in range(sweeps):
        near, far = ("dst", "src") if k % 2 == 0 else ("src", "dst")
        other = placed.select("graph_id", F.col("id").alias(far), F.col("place").alias("p"))
        means = edges.join(other, ["graph_id", far]).groupBy("graph_id", F.col(near).alias("id")).agg(F.avg("p").alias("mean"))
        joined = placed.join(means, ["graph_id", "id"], "left").withColumn("mean", F.coalesce("mean", F.col("place").cast("double")))
        placed = joined.withColumn("place", F.row_number().over(w.orderBy("mean", "place", "id")) - 1).drop("mean")
    return placed


#: Fixed values of the layout.
RANK_GAP, NODE_GAP, HEIGHT, CHAR, PAD = 60.0, 40.0, 40.0, 8.0, 20.0


def assign_coordinates(nodes: DataFrame, ranks: DataFrame, horizontal: bool = False) -> DataFrame:
    """(graph_id, id, rank, x, y, width, height): ranks side by side, nodes of a rank in the order of ids."""
    width = F.length("label") * CHAR + PAD
    sized = nodes.select("graph_id", "id", "label").join(ranks, ["graph_id", "id"]).withColumns({"width": width.cast("double"), "height": F.lit(HEIGHT)})
    along, across = ("height", "width") if horizontal else ("width", "height")
    before = Window.partitionBy("graph_id", "rank").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("along", F.coalesce(F.sum(F.col(along) + NODE_GAP).over(before), F.lit(0.0)))
    depths = sized.groupBy("graph_id", "rank").agg(F.max(across).alias("depth"))
    depths = depths.withColumn(
        "across",
        F.coalesce(
            F.sum(F.col("depth") + RANK_GAP).over(
                Window.partitionBy("graph_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0.0)
        )
    )
    out = placed.join(depths, ["graph_id", "rank"])
    x, y = ("across", "along") if horizontal else ("along", "across")
    return out.select("graph_id", "id", "rank", F.col(x).alias("x"), F.col(y).alias("y"), "width", "height")


def edge_paths(edges: DataFrame, boxes: DataFrame, horizontal: bool = False) -> DataFrame:
    """(graph_id, src, dst, path): from border to border with one step half-way; straight where both are in line."""
    a, b = boxes.alias("a"), boxes.alias("b")
    joined = edges.alias("e").join(
        a, (F.col("e.graph_id") == F.col("a.graph_id")) & (F.col("e.src") == F.col("a.id"))
    ).join(b, (F.col("e.graph_id") == F.col("b.graph_id")) & (F.col("e.dst") == F.col("b.id")))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    mid = lambda t, at, size: F.col(f"{t}.{at}") + F.col(f"{t}.{size}") / 2
    if horizontal:
        s, e = point(F.col("a.x") + F.col("a.width"), mid("a", "y", "height")), point(F.col("b.x"), mid("b", "y", "height"))
        half = (s["x"] + e["x"]) / 2
        bend = F.array(s, point(half, s["y"]), point(half, e["y"]), e)
        straight = s["y"] == e["y"]
    else:
        s, e = point(mid("a", "x", "width"), F.col("a.y") + F.col("a.height")), point(mid("b", "x", "width"), F.col("b.y"))
        half = (s["y"] + e["y"]) / 2
        bend = F.array(s, point(s["x"], half), point(e["x"], half), e)
        straight = s["x"] == e["x"]
    return joined.select("e.graph_id", "e.src", "e.dst", F.when(straight, F.array(s, e)).otherwise(bend).alias("path"))


def frames(members: DataFrame, parents: DataFrame, boxes: DataFrame, pad: float = 20.0) -> DataFrame:
    """(graph_id, subgraph, llx, lly, urx, ury): what a subgraph's nodes and inner subgraphs need, and a margin.

    ``members``: (graph_id, subgraph, id); ``parents``: (graph_id, subgraph, parent). Boxes grow from the
    innermost subgraphs outwards, one box a subgraph and level, until no parent is left. A subgraph that
    holds itself is an error.
    """
    sides = {"llx": F.min, "lly": F.min, "urx": F.max, "ury": F.max}
    parents = parents.filter("parent is not null").select("graph_id", "subgraph", "parent")
    corners = {"llx": F.col("x"), "lly": F.col("y"), "urx": F.col("x") + F.col("width"), "ury": F.col("y") + F.col("height")}
    own = members.join(boxes, ["graph_id", "id"]).groupBy("graph_id", "subgraph").agg(*(sides[k](c).alias(k) for k, c in corners.items()))
    levels, most = [storage.materialise(own, "frames")], parents.count()
    while levels[-1].head(1):
        if len(levels) > most + 1:
            raise ValueError("a subgraph holds itself")
        up = levels[-1].join(parents, ["graph_id", "subgraph"]).groupBy("graph_id", F.col("parent").alias("subgraph"))
        levels.append(storage.materialise(up.agg(*(of(k).alias(k) for k, of in sides.items())), "frames"))
    rows = reduce(DataFrame.unionByName, [x.withColumn("room", F.lit(pad * (k + 1))) for k, x in enumerate(levels)])
    grown = {"llx": F.col("llx") - F.col("room"), "lly": F.col("lly") - F.col("room"), "urx": F.col("urx") + F.col("room"), "ury": F.col("ury") + F.col("room")}
    return rows.groupBy("graph_id", "subgraph").agg(*(sides[k](c).alias(k) for k, c in grown.items()))


def svg(nodes: DataFrame, boxes: DataFrame, paths: DataFrame) -> DataFrame:
    """(graph_id, svg): boxes with their labels, and paths."""
    number = lambda c: F.format_string("%.1f", c)
    label = F.replace(F.replace("label", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    box = F.concat(
        F.lit('<rect x="'), number("x"), F.lit('" y="'), number("y"), F.lit('" width="'), number("width"), F.lit('" height="'),
        number("height"), F.lit('" fill="none" stroke="black"/><text x="'), number(F.col("x") + F.col("width") / 2), F.lit('" y="'),
        number(F.col("y") + F.col("height") / 2), F.lit('" text-anchor="middle">'), label, F.lit("</text>")
    )
    line = F.concat(
        F.lit('<polyline fill="none" stroke="black" points="'),
        F.array_join(F.transform("path", lambda p: F.concat(number(p["x"]), F.lit(","), number(p["y"]))), " "), F.lit('"/>')
    )
    parts = boxes.join(nodes.select("graph_id", "id", "label"), ["graph_id", "id"]).select("graph_id", F.lit(0).alias("k"), F.col("id").alias("o"), box.alias("s")).unionByName(
        paths.select("graph_id", F.lit(1).alias("k"), F.concat_ws("->", "src", "dst").alias("o"), line.alias("s"))
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "o", "s"))), lambda x: x["s"]), "")
    return parts.groupBy("graph_id").agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), joined, F.lit("</svg>")).alias("svg"))


def shares(df: DataFrame, chart: str, value: str) -> DataFrame:
    """Adds ``share`` of the chart's total (at least 1); totals are joined, so no chart has to be one task's."""
    totals = df.groupBy(chart).agg(F.sum(value).alias("__t"))
    return df.join(totals, chart).withColumn("share", F.col(value) / F.greatest(F.col("__t"), F.lit(1))).drop("__t")


def bar_scale(df: DataFrame, chart: str, start: str, length: str, width: float = 400.0) -> DataFrame:
    """(chart, max_end, scale) of a bar chart over time."""
    return df.groupBy(chart).agg(F.max(F.col(start) + F.col(length)).alias("max_end")).withColumn(
        "scale", F.lit(width) / F.greatest(F.col("max_end").cast("double"), F.lit(1.0))
    )


def section_starts(df: DataFrame, chart: str, section: str, order: list[str | Column]) -> DataFrame:
    """Adds ``starts``: whether a row's section differs from that of the row before."""
    w = Window.partitionBy(chart).orderBy(*order)
    return df.withColumn("starts", ~F.lag(section).over(w).eqNullSafe(F.col(section)) | (F.row_number().over(w) == 1))


def runs(df: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """(key, run, values, first, last, n): runs of rows with equal values."""
    w = Window.partitionBy(key).orderBy(order)
    now = F.struct(*values)
    marked = df.withColumn("__new", F.when(F.row_number().over(w) == 1, 0).when(F.lag(now).over(w).eqNullSafe(now), 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("__new").over(w))
    return numbered.groupBy(key, "run", *values).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def activations(events: DataFrame, key: list[str], order: str, step: str) -> DataFrame:
    """(key, depth, start, end): openings (+1) paired with their closings (-1); unclosed ones last to the end."""
    w = Window.partitionBy(*key).orderBy(order)
    deep = events.withColumn("__d", F.sum(step).over(w))
    deep = deep.withColumn("depth", F.when(F.col(step) > 0, F.col("__d")).otherwise(F.col("__d") + 1)).filter("depth > 0")
    pair = Window.partitionBy(*key, "depth").orderBy(order)
    ends = deep.groupBy(*key).agg(F.max(order).alias("__last"))
    out = deep.withColumns({"__next": F.lead(order).over(pair), "__closes": F.lead(step).over(pair) < 0}).filter(F.col(step) > 0).join(ends, key)
    return out.select(*key, "depth", F.col(order).alias("start"), F.when(F.col("__closes"), F.col("__next")).otherwise(F.col("__last")).alias("end"))


def tree_parents(lines: DataFrame, tree: str, order: str, level: str) -> DataFrame:
    """Adds ``parent``: the order of the last line before with a smaller level; null for roots.

    A level at a time, a running maximum of the orders of its lines is what deeper lines look back to.
    """
    levels = sorted(r[0] for r in lines.select(level).distinct().collect() if r[0] is not None)  # as many as trees are deep
    before = Window.partitionBy(tree).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    steps = Window.partitionBy(tree).orderBy(order)
    last = [F.when(F.col(level) > k, F.max(F.when(F.col(level) == k, F.col(order))).over(before)) for k in levels]
    parent = F.greatest(*last) if len(last) > 1 else last[0] if last else F.lit(None)
    return lines.withColumns({"parent": parent.cast(lines.schema[order].dataType), "depth_step": F.col(level) - F.coalesce(F.lag(level).over(steps), F.lit(0))})
