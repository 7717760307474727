"""Text on pages: spans, lines, rectangles. Coordinates grow to the right and upwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intersects(a: str, b: str) -> Column:
    """Whether two rectangles have more than a border in common; ``a``, ``b``: aliases."""
    c = F.col
    return (c(f"{a}.llx") < c(f"{b}.urx")) & (c(f"{a}.urx") > c(f"{b}.llx")) & (c(f"{a}.lly") < c(f"{b}.ury")) & (c(f"{a}.ury") > c(f"{b}.lly"))


def area(r: str) -> Column:
    return F.greatest(F.col(f"{r}.urx") - F.col(f"{r}.llx"), F.lit(0.0)) * F.greatest(F.col(f"{r}.ury") - F.col(f"{r}.lly"), F.lit(0.0))


def quad_box(quad: Column) -> Column:
    """The rectangle around a quad's four corners x1, y1, ... y4."""
    xs, ys = (F.filter(quad, lambda v, i, k=k: i % 2 == k) for k in (0, 1))
    return F.struct(F.array_min(xs).alias("llx"), F.array_min(ys).alias("lly"), F.array_max(xs).alias("urx"), F.array_max(ys).alias("ury"))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], cell: float = 100.0) -> DataFrame:
    """Pairs of intersecting rectangles (columns a.* and b.*) with equal ``on``.

    Rectangles are dealt to the cells of a grid that they touch, so rows meet by equality; a pair that
    meets in several cells is taken in the first one. A rectangle longer than four cells has a grid of
    its own, of cells doubled until it fits, so that it touches a few cells whatever its size; a pair meets
    on the coarser of its two grids, and rows are dealt to those grids only that some rectangle has.
    Rectangles with a missing or endless side meet nothing.
    """
    sides = ("llx", "lly", "urx", "ury")
    longest = F.greatest(F.col("urx") - F.col("llx"), F.col("ury") - F.col("lly"), F.lit(0.0)) / (4 * cell)
    level = F.greatest(F.ceil(F.log2(F.greatest(longest, F.lit(1.0)))), F.lit(0)).cast("int")

    def sized(df: DataFrame) -> DataFrame:
        whole = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) != float("inf")) for c in sides]
        return df.filter(whole[0] & whole[1] & whole[2] & whole[3]).withColumn("__own", level)

    a, b = sized(left), sized(right)
    grids = a.select("__own").unionByName(b.select("__own")).agg(F.collect_set("__own").alias("__grids"))  # one row
    low = lambda c, n: F.floor(F.col(c) / (cell * F.pow(F.lit(2.0), n))).cast("long")

    def dealt(df: DataFrame) -> DataFrame:
        of = F.explode(F.filter("__grids", lambda g: g >= F.col("__own")))
        rows = df.crossJoin(F.broadcast(grids)).withColumn("__grid", of).drop("__grids")
        for name, (p, q) in {"__cx": ("llx", "urx"), "__cy": ("lly", "ury")}.items():
            rows = rows.withColumn(name, F.explode(F.sequence(low(p, F.col("__grid")), F.greatest(low(p, F.col("__grid")), low(q, F.col("__grid"))))))
        return rows

    a, b = dealt(a).alias("a"), dealt(b).alias("b")
    keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*on, "__grid", "__cx", "__cy"]]
    joined = a.join(b, keys).filter(intersects("a", "b") & (F.col("a.__grid") == F.greatest("a.__own", "b.__own")))
    at = cell * F.pow(F.lit(2.0), F.col("a.__grid"))
    first = [F.col(f"a.{c}") == F.floor(F.greatest(f"a.{s}", f"b.{s}") / at) for c, s in (("__cx", "llx"), ("__cy", "lly"))]
    return joined.filter(first[0] & first[1])


def annotated_text(annotations: DataFrame, runs: DataFrame, page: str = "page") -> DataFrame:
    """(annotation_id, text): text runs under each of an annotation's quads, adjacent repeats once; quads apart by a blank.

    ``annotations``: a row for each quad (page, annotation_id, quad_no, llx, ...); ``runs``: (page, run_no, text, llx, ...).
    """
    hits = overlap_join(annotations, runs, [page]).select("a.annotation_id", "a.quad_no", "b.run_no", "b.text")
    w = Window.partitionBy("annotation_id", "quad_no").orderBy("run_no")
    kept = hits.withColumn("again", F.lag("text").over(w).eqNullSafe(F.col("text")) & (F.row_number().over(w) > 1)).filter("not again")
    in_order = lambda sep, key, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, c))), lambda x: x[c]), sep)
    quads = kept.groupBy("annotation_id", "quad_no").agg(in_order("", "run_no", "text").alias("text"))
    return quads.groupBy("annotation_id").agg(in_order(" ", "quad_no", "text").alias("text"))


def ruled_spans(spans: DataFrame, rects: DataFrame, page_widths: DataFrame) -> DataFrame:
    """Adds ``underline`` and ``strike`` to spans (page, span_no, x, y, width, font_size).

    A thin rectangle on the page, no wider than half of it, that covers more than half of the span's width
    is an underline just below the base line and a strike through the middle of the letters.
    """
    narrow = rects.join(page_widths, "page").filter((F.col("urx") - F.col("llx") <= F.col("page_width") * 0.5) & (F.col("ury") - F.col("lly") <= 2.0))
    boxes = spans.select(
        "page", "span_no", F.col("x").alias("llx"), (F.col("x") + F.col("width")).alias("urx"),
        (F.col("y") - F.col("font_size") * 0.3).alias("lly"), (F.col("y") + F.col("font_size") * 0.7).alias("ury"), "y", "font_size",
        "width"
    )
    pairs = overlap_join(boxes, narrow.select("page", "llx", "lly", "urx", F.greatest(F.col("ury"), F.col("lly") + 0.01).alias("ury")), ["page"])
    shared = F.least("a.urx", "b.urx") - F.greatest("a.llx", "b.llx")
    middle = (F.col("b.lly") + F.col("b.ury")) / 2 - F.col("a.y")
    marks = pairs.filter(shared > F.col("a.width") * 0.5).groupBy("a.page", "a.span_no").agg(
        F.bool_or(middle < F.col("a.font_size") * 0.15).alias("underline"),
        F.bool_or(middle.between(F.col("a.font_size") * 0.2, F.col("a.font_size") * 0.5)).alias("strike")
    )
    return spans.drop("underline", "strike").join(marks, ["page", "span_no"], "left").withColumns(
        {n: F.coalesce(n, F.lit(False)) for n in ("underline", "strike")}
    )


def mode_font_size(spans: DataFrame, key: list[str]) -> DataFrame:
    """(key, font_size): the commonest size of at least 6, in half points; of equally common ones the smallest."""
    sizes = spans.filter("font_size >= 6").groupBy(*key, F.round(F.col("font_size") * 2).alias("half")).agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy(*key).agg(F.max_by("half", F.struct("n", -F.col("half"))).alias("half"))
    return best.select(*key, (F.col("half") / 2).alias("font_size"))


def body_font(spans: DataFrame, key: list[str]) -> DataFrame:
    """(key, font_name): the font of most bytes of text; of equal ones the first by name."""
    sums = spans.groupBy(*key, "font_name").agg(F.sum(F.octet_length("text")).alias("n"))
    return sums.groupBy(*key).agg(F.min_by("font_name", F.struct(-F.col("n"), F.col("font_name"))).alias("font_name"))


def font_names(spans: DataFrame) -> DataFrame:
    """(font_name): each font once, by name."""
    return spans.select("font_name").filter("font_name is not null").distinct().orderBy("font_name")


def page_bounds(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, right, left): each page's right end, and the document's left one."""
    pages = spans.groupBy(key, "page").agg(F.max(F.col("x") + F.col("width")).alias("right"), F.min("x").alias("x"))
    lefts = pages.groupBy(key).agg(F.min("x").alias("left"))
    return pages.drop("x").join(lefts, key)


def cluster_lines(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``line``: a new one begins where the base line is further from the line's first span than the tolerance.

    The tolerance is half the commonest size, 2 at least. A line is anchored at its first span from the top, so
    a page's distinct base lines, of which there are far fewer than spans, are folded from top to bottom into
    the anchors; a span's line is the number of anchors that aren't below it. Spans without a base line are in line 0.
    """
    sizes = mode_font_size(spans, [key]).withColumnRenamed("font_size", "body")
    tolerance = F.greatest(F.coalesce("body", F.lit(10.0)) * 0.5, F.lit(2.0))
    levels = spans.filter("y is not null").groupBy(key, "page").agg(F.sort_array(F.collect_set(F.col("y").cast("double")), asc=False).alias("__ys"))
    levels = levels.join(sizes, key, "left").withColumn("__t", tolerance)

    def fold(acc, y):
        new = F.size(acc) == 0
        return F.when(new | (F.abs(y - F.element_at(acc, -1)) > F.col("__t")), F.concat(acc, F.array(y))).otherwise(acc)

    none = F.array().cast("array<double>")
    anchors = levels.select(key, "page", F.explode(F.aggregate("__ys", none, fold)).alias("__y"))
    rows = spans.withColumn("__y", F.col("y").cast("double")).withColumn("__begins", F.lit(0))
    marks = anchors.withColumn("__begins", F.lit(1))
    both = rows.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(key, "page").orderBy(F.col("__y").desc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = both.withColumn("line", F.sum("__begins").over(w))
    return numbered.filter("__begins = 0").select(*spans.columns, "line")


def line_texts(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, line, x, y, font_size, bold, text): a line's spans joined, blanks where a gap shows one."""
    w = Window.partitionBy(key, "page", "line").orderBy("x")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    piece = F.concat(F.when(gap > F.col("font_size") * 0.2, F.lit(" ")).otherwise(F.lit("")), "text")
    rows = lines.withColumn("piece", piece)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "piece"))), lambda v: v["piece"]), "")
    return rows.groupBy(key, "page", "line").agg(
        F.min("x").alias("x"), F.max("y").alias("y"), F.max("font_size").alias("font_size"), F.bool_and("bold").alias("bold"),
        joined.alias("text")
    )


def spans_to_markdown(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, md): lines become headings by their size, items by their bullets, paragraphs by the distance between them."""
    from docloom.functions.text import detect_bullet

    body = mode_font_size(spans, [key]).withColumnRenamed("font_size", "body")
    lines = line_texts(cluster_lines(spans, key), key).join(body, key, "left").withColumn("body", F.coalesce("body", F.lit(10.0)))
    w = Window.partitionBy(key).orderBy("page", "line")
    head = F.when(F.col("font_size") >= F.col("body") * 1.45, "# ").when(F.col("font_size") >= F.col("body") * 1.15, "## ").otherwise("")
    lines = lines.withColumns({"head": head, "item": detect_bullet(F.trim("text"))})
    lines = lines.withColumn("apart", (F.lag("y").over(w) - F.col("y") > F.col("body") * 1.8) | (F.lag("page").over(w) != F.col("page")))
    own = F.when(F.col("head") != "", F.concat("head", F.trim("text"))).when(
        F.col("item.is_item"), F.concat(F.coalesce("item.number", F.lit("-")), F.lit(" "), "item.rest")
    ).otherwise(F.trim("text"))
    sep = F.when(F.row_number().over(w) == 1, "").when(
        (F.col("head") != "") | (F.lag("head").over(w) != "") | F.col("apart"), "\n\n"
    ).when(F.col("item.is_item"), "\n").otherwise(" ")
    rows = lines.select(key, "page", "line", F.concat(sep, own).alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "piece"))), lambda v: v["piece"]), "")
    return rows.groupBy(key).agg(joined.alias("md"))


def comment_page(offset: Column, length: Column, pages: Column) -> Column:
    """The page on which a comment at ``offset`` of a text is put."""
    at = F.floor(offset * pages / F.greatest(length, F.lit(1)))
    return F.least(F.greatest(at, F.lit(0)), F.greatest(pages - 1, F.lit(0))).cast("long")
