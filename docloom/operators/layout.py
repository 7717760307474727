"""Pages of text spans as Markdown: inline marks, headings, items, rules, centred and indented blocks.

Every step is groupings and column functions. Spans and rectangles are read once and packed: a page is one row (``packed``), and what
follows is worked out within it, so a page's spans are moved once. What a line looks like follows from its own spans
(``page_lines``). What it does to the text depends on the lines before it: whether a centred or an indented block is open, and from
where; whether the line before was short; whether an item's text goes on. That is a scan with state (``step``). The first line of
a page closes all that is open, and after it the state is one of three, so a page is folded from each of the three (``folded``), all
pages side by side, and a document's row picks the text that fits the page before.

Spans: (key, page, span_no, x, y, width, font_size, font_name, text, bold, italic); rectangles: (key, page, llx, lly, urx, ury).
Coordinates grow to the right and upwards. Lines without visible text count as nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import storage
from docloom.functions import text as T
from docloom.operators import geometry

#: Marks from the outermost to the innermost, and the flags that they stand for.
MARKS = (("strike", "s"), ("underline", "u"), ("bold", "b"), ("italic", "i"))
#: What recognition makes of some words.
ARTEFACTS = {"L T X": "LaTeX", "OSX E": "OSX", "A<i>•</i>": "<i>•</i>", "A•": "•"}
INFINITE = float("inf")


def page_frames(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, page_left, page_right): of visible spans; a page's left end is the document's."""
    visible = spans.filter(T.normalize_text(F.col("text")) != "")
    pages = geometry.page_bounds(visible, key)
    return pages.withColumnsRenamed({"left": "page_left", "right": "page_right"})


def ruled(spans: DataFrame, rects: DataFrame, frames: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``underline`` and ``strike``: a rectangle not wider than half of the page that covers more than half of the span's
    width, low at its base line or through its letters."""
    size = F.col("font_size")
    boxes = spans.select(
        key, "page", "span_no", F.col("x").alias("llx"), (F.col("x") + F.col("width")).alias("urx"), (F.col("y") - size * 0.6).alias("lly"),
        (F.col("y") + size * 0.8 + 1).alias("ury"), "y", "font_size", "width"
    )
    wide = rects.join(frames, [key, "page"], "left").withColumn("__half", F.coalesce(F.col("page_right") - F.col("page_left"), F.lit(800.0)) * 0.5)
    thin = wide.filter(F.col("urx") - F.col("llx") <= F.col("__half")).select(key, "page", "llx", "lly", "urx", (F.col("lly") + 0.01).alias("ury"))
    pairs = geometry.overlap_join(boxes, thin, [key, "page"])
    size, up = F.col("a.font_size"), F.col("b.lly") - F.col("a.y")
    shared = F.least("a.urx", "b.urx") - F.greatest("a.llx", "b.llx")
    marks = pairs.filter(shared > F.col("a.width") * 0.5).groupBy(f"a.{key}", "a.page", "a.span_no").agg(
        F.bool_or((up > -size * 0.6) & (up < size * 0.2)).alias("underline"), F.bool_or((up >= size * 0.2) & (up <= size * 0.8)).alias("strike")
    )
    out = spans.drop("underline", "strike").join(marks, [key, "page", "span_no"], "left")
    return out.withColumns({n: F.coalesce(n, F.lit(False)) for n in ("underline", "strike")})


def _own_marks(t: Column, flags: Column) -> Column:
    """A run's text with marks of its own around what isn't blank."""
    names = [m for _, m in MARKS]

    def of(r: Column) -> Column:
        trail = F.substring(r["t"], F.length(r["lead"]) + F.length(r["inner"]) + 1, F.lit(2**31 - 1))
        opened, closed = ([F.when(flags[k], f"<{sign}{m}>").otherwise("") for k, m in enumerate(names)] for sign in ("", "/"))
        return F.when(r["inner"] == "", r["t"]).otherwise(F.concat(r["lead"], *opened, r["inner"], *reversed(closed), trail))

    return T.bound(t, lambda t: T.bound(F.struct(t.alias("t"), _inner(t).alias("inner"), _lead(t).alias("lead")), of))


def _inner(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)^\s+|\s+\z", "")


def _lead(t: Column) -> Column:
    return F.regexp_extract(t, r"(?U)^(\s*)", 1)


def _written(whole: Column) -> Column:
    """A line's text with its addresses linked and without what recognition made of some words."""
    text = T.auto_link(whole)
    for a, b in ARTEFACTS.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _apart(gap: Column, first: Column, body: Column) -> Column:
    """Whether a gap before a span shows a blank; ``first``: the width of its run's first span."""
    return F.coalesce(gap > F.greatest(first * 0.6, body * 0.15), F.lit(False))


def inline(lines: DataFrame, key: str = "doc_id", nested: bool = False) -> DataFrame:
    """(key, page, line, inline): a line's spans as text with marks, blanks where a gap shows one.

    Spans of equal flags that follow each other are a run. Each run has marks of its own; ``nested`` leaves a mark open over
    the runs that share it, as far as marks stay nested: a mark is closed and opened anew where one outside of it changes.
    """
    line = [key, "page", "line"]
    w = Window.partitionBy(*line).orderBy(F.col("y").desc(), "x", "span_no")
    flags = [F.coalesce(F.col(f), F.lit(False)) for f, _ in MARKS]
    rows = lines.withColumn("flags", F.array(*flags)).withColumn("before", F.lag("flags").over(w))
    begins = ~F.col("flags").eqNullSafe(F.col("before"))
    rows = rows.withColumn("run", F.sum(F.when(begins, 1).otherwise(0)).over(w))
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    first = F.last(F.when(begins, F.struct("width")), ignorenulls=True).over(w)["width"]
    rows = rows.withColumn("piece", F.concat(F.when(_apart(gap, first, F.col("body")), " ").otherwise(""), F.coalesce("text", F.lit(""))))
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("up"), "x", "span_no", "piece")))
    runs = rows.groupBy(*line, "run").agg(F.any_value("flags").alias("flags"), F.array_join(F.transform(in_order, lambda p: p["piece"]), "").alias("t"))
    if nested:
        runs = runs.withColumns({"inner": _inner(F.col("t")), "lead": _lead(F.col("t"))})
        trail = F.substring("t", F.length("lead") + F.length("inner") + 1, F.lit(2**31 - 1))
        runs = runs.withColumn("trail", F.when(F.col("inner") == "", "").otherwise(trail))
        # Blank runs take the flags of what is before them; what counts is the run before and the one behind.
        w = Window.partitionBy(*line).orderBy("run")
        runs = runs.filter("inner <> '' or lead <> ''").withColumn("shown", F.when(F.col("inner") != "", F.col("flags")))
        runs = runs.withColumn("flags", F.coalesce(F.last("shown", True).over(w), F.array(*[F.lit(False)] * 4)))
        runs = runs.withColumns({"was": F.lag("flags").over(w), "will": F.lead("flags").over(w)})
        off, own = F.lit(False), lambda k: F.col("flags")[k]
        changed = lambda other, k: F.array_contains(F.transform(F.arrays_zip(F.slice("flags", 1, k + 1).alias("a"), F.slice(other, 1, k + 1).alias("b")), lambda x: x["a"] != x["b"]), True)
        opened = [F.when(own(k) & F.coalesce(changed("was", k), ~off), f"<{m}>").otherwise("") for k, (_, m) in enumerate(MARKS)]
        closed = [F.when(own(k) & F.coalesce(changed("will", k), ~off), f"</{m}>").otherwise("") for k, (_, m) in enumerate(MARKS)]
        marked = F.concat("lead", *opened, "inner", *reversed(closed), "trail")
    else:
        marked = _own_marks(F.col("t"), F.col("flags"))
    runs = runs.withColumn("marked", marked)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "marked"))), lambda r: r["marked"]), "")
    return runs.groupBy(*line).agg(_written(whole).alias("inline"))


def without_marks(c: Column) -> Column:
    """A line's text without marks and a span around it."""
    plain = lambda t: F.when(t.startswith("<span") & t.contains(">"), F.regexp_replace(t, "(?s)^[^>]*>", "")).otherwise(t)
    return F.regexp_replace(T.bound(F.regexp_replace(c, r"\*|</?[bius]>", ""), plain), r"</span>\z", "")


def packed(spans: DataFrame, rects: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, spans, rects): a page's spans from its top and its rectangles from its foot, each input read once."""
    y = F.col("y").cast("double")
    up = F.when(F.isnan(y), F.lit(-INFINITE)).otherwise(-y)  # spans without a base line come first, as in ``geometry.cluster_lines``
    seen = F.coalesce(T.normalize_text(F.col("text")) != "", F.lit(False))
    span = F.struct(up.alias("up"), "x", "span_no", "y", "width", "font_size", "font_name", "text", "bold", "italic", seen.alias("seen"))
    items = spans.select(key, "page", span.alias("span")).unionByName(rects.select(key, "page", F.struct("lly", "llx", "urx").alias("rect")), allowMissingColumns=True)
    return items.groupBy(key, "page").agg(*(F.sort_array(F.collect_list(c)).alias(f"{c}s") for c in ("span", "rect")))


def settings(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page_left, body, font_name) of documents with visible text: their left end, commonest size and font."""
    spans = pages.select(key, F.inline("spans"))
    lefts = spans.filter("seen").groupBy(key).agg(F.min("x").alias("page_left"))
    font = geometry.body_font(spans.withColumn("font_name", T.font_family(F.coalesce("font_name", F.lit("")))), [key])
    size = geometry.mode_font_size(spans, [key])
    return lefts.join(font, key).join(size, key, "left").select(key, "page_left", F.coalesce("font_size", F.lit(10.0)).alias("body"), "font_name")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) != INFINITE)


def _stretches(rows: Column, starts: Column) -> Column:
    """The parts of an array that begin at ``starts`` (from 0, in order)."""
    return F.transform(starts, lambda s, k: F.slice(rows, s + 1, F.coalesce(F.get(starts, k + 1), F.size(rows)) - s))


def _line_starts(spans: Column, tolerance: Column) -> Column:
    """Where lines begin among a page's spans from its top: as ``geometry.cluster_lines`` has them."""

    def fold(acc: Column, s: Column) -> Column:
        y, anchor = s["y"].cast("double"), acc["anchor"]
        new = (acc["n"] == 0) | (y.isNotNull() & (anchor.isNull() | ((y != anchor) & (F.abs(y - anchor) > tolerance))))
        return T.bound(
            new, lambda b: F.struct((acc["n"] + 1).alias("n"), F.when(b, y).otherwise(anchor).alias("anchor"), F.when(b, F.concat(acc["starts"], F.array(acc["n"]))).otherwise(acc["starts"]).alias("starts"))
        )

    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(spans, none, fold, lambda acc: acc["starts"])


def _below(rects: Column, height: Column) -> Column:
    """How many of the rectangles, in order of their lower sides, begin below ``height``: by halving."""
    halves = F.array_repeat(F.lit(0), F.ceil(F.log2(F.size(rects) + 1)).cast("int"))

    def halved(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        low = F.coalesce(F.get(rects, mid)["lly"] < height, F.lit(False))
        return F.when(acc["lo"] >= acc["hi"], acc).when(low, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))

    return F.aggregate(halves, F.struct(F.lit(0).alias("lo"), F.size(rects).alias("hi")), halved, lambda acc: acc["lo"])


def _flagged(line: Column, thin: Column) -> Column:
    """A line's spans with their flags, in the order of ``MARKS``: what ``ruled`` adds, from the rectangles at the line's height."""
    foot, head = (lambda s: s["y"] - s["font_size"] * 0.6), (lambda s: s["y"] + s["font_size"] * 0.8 + 1)

    def of(near: Column, s: Column) -> Column:
        size, end = s["font_size"], s["x"] + s["width"]
        whole = _finite(s["x"]) & _finite(end) & _finite(foot(s)) & _finite(head(s))
        meets = lambda r: (s["x"] < r["urx"]) & (end > r["llx"]) & (foot(s) < r["lly"] + 0.01) & (head(s) > r["lly"])
        shared = lambda r: F.least(end, r["urx"]) - F.greatest(s["x"], r["llx"]) > s["width"] * 0.5
        met = F.when(whole, F.transform(F.filter(near, lambda r: meets(r) & shared(r)), lambda r: r["lly"] - s["y"]))
        under, through = (lambda up: (up > -size * 0.6) & (up < size * 0.2)), (lambda up: (up >= size * 0.2) & (up <= size * 0.8))
        on = lambda c: F.coalesce(c, F.lit(False))
        flags = T.bound(met, lambda m: F.array(on(F.exists(m, through)), on(F.exists(m, under)), on(s["bold"]), on(s["italic"])))
        left, right = F.when(s["seen"], s["x"]), F.when(s["seen"], end)
        return F.struct(s["x"].alias("x"), s["width"].alias("width"), s["text"].alias("text"), flags.alias("flags"), left.alias("left"), right.alias("right"), F.when(size >= 6, size).alias("size"))

    # A little more than the line's height: whether a rectangle meets a span is looked at for each span.
    size = F.greatest(F.abs(F.array_max(line["font_size"])), F.abs(F.array_min(line["font_size"])))
    low, high = F.nanvl((F.array_min(line["y"]) - size - 1).cast("double"), F.lit(-INFINITE)), F.array_max(line["y"]) + size + 2
    reach = F.struct(low.alias("low"), high.alias("high"))
    ends = T.bound(reach, lambda e: F.struct(_below(thin, e["low"]).alias("a"), _below(thin, e["high"]).alias("b")))
    near = T.bound(ends, lambda e: F.slice(thin, e["a"] + 1, F.greatest(e["b"] - e["a"], F.lit(0))))
    return T.bound(near, lambda n: F.transform(line, lambda s: of(n, s)))


def _inline(line: Column, body: Column) -> Column:
    """A line's flagged spans as text with marks: what ``inline`` makes of rows."""

    def of(at: Column, run: Column) -> Column:
        def piece(s: Column, j: Column) -> Column:
            before = F.get(line, at + j - 1)
            blank = _apart(s["x"] - (before["x"] + before["width"]), run[0]["width"], body)
            return F.concat(F.when(blank, " ").otherwise(""), F.coalesce(s["text"], F.lit("")))

        return _own_marks(F.array_join(F.transform(run, piece), ""), run[0]["flags"])

    starts = F.filter(F.sequence(F.lit(0), F.size(line) - 1), lambda i: ~line[i]["flags"].eqNullSafe(F.get(line, i - 1)["flags"]))
    runs = lambda starts: F.transform(_stretches(line, starts), lambda run, k: of(starts[k], run))
    return _written(F.array_join(T.bound(starts, runs), ""))


def page_lines(pages: DataFrame) -> DataFrame:
    """Adds to pages (spans, rects, page_left, body) their ``lines`` with visible text, what each says and how it stands on the page, and
    ``above``: the heights of rules above the first line, as far as it is known from the page.

    A rule is a rectangle wider than half of the page between a line and the one before it; it counts at the first line that it is
    above. Before a page's first line is the last line of the page before.
    """
    body, left = F.col("body"), F.col("page_left")
    pages = pages.withColumn("page_right", F.array_max(F.transform(F.filter("spans", lambda s: s["seen"]), lambda s: s["x"] + s["width"])))
    width = F.col("page_right") - left
    half, span = F.coalesce(width, F.lit(800.0)) * 0.5, lambda r: r["urx"] - r["llx"]
    thin = F.filter("rects", lambda r: (span(r) <= half) & _finite(r["llx"]) & _finite(r["urx"]) & _finite(r["lly"]))
    wide = F.transform(F.filter("rects", lambda r: (span(r) > half) & _finite(r["lly"])), lambda r: r["lly"])
    pages = pages.withColumns({"thin": thin, "wide": wide, "starts": _line_starts(F.col("spans"), F.greatest(body * 0.5, F.lit(2.0)))})

    def told(line: Column) -> Column:
        of = lambda spans: F.struct(
            _inline(spans, body).alias("inline"), line[0]["y"].alias("y"), (line[0]["y"] + line[0]["font_size"]).alias("top"), F.coalesce(line[0]["bold"], F.lit(False)).alias("bold"),
            F.array_max(spans["size"]).alias("size"), F.array_min(spans["left"]).alias("left"), F.array_max(spans["right"]).alias("right")
        )
        return T.bound(_flagged(line, F.col("thin")), of)

    lines = F.transform(_stretches(F.col("spans"), F.col("starts")), told)
    pages = pages.withColumn("shown", F.filter(lines, lambda x: (x["inline"] != "") & x["left"].isNotNull()))
    before = lambda i: F.get("shown", i - 1)["y"]
    between = lambda r: lambda x, i: F.coalesce((r > x["top"]) & (r < before(i)) & (i > 0) & _finite(x["top"]) & _finite(before(i)), F.lit(False))
    pages = pages.withColumn("at", F.transform("wide", lambda r: F.array_position(F.transform("shown", between(r)), True)))

    def looks(x: Column, i: Column) -> Column:
        return T.bound(without_marks(x["inline"]), lambda bare: T.bound(T.detect_bullet(bare), lambda item: of(x, i, bare, item)))

    def of(x: Column, i: Column, bare: Column, item: Column) -> Column:
        size, is_item, letters = F.coalesce(x["size"], body), item["is_item"], F.regexp_replace(bare, r"\P{L}", "")
        named = bare.rlike("^(?:Figure|Table)")
        return F.struct(
            (i + 1).alias("line"), x["y"].alias("y"), x["top"].alias("top"), body.alias("body"), F.coalesce(before(i) - x["top"], F.lit(INFINITE)).alias("gap"),
            F.size(F.filter("at", lambda a: a == i + 1)).alias("rules"), F.lit(False).alias("first"), is_item.alias("bullet"), (is_item & item["number"].isNotNull()).alias("numbered"),
            (~is_item & (size > body * 1.15)).alias("big"), (~is_item & x["bold"] & ~named).alias("strong"), (~is_item & T.is_title_case(bare) & ~named).alias("title"),
            T.bound(letters, lambda ls: (F.octet_length(bare) > 3) & (F.length(ls) > 3) & ~ls.rlike(r"[^\p{Lu}]")).alias("caps"),
            (x["right"] < F.col("page_right") - width * 0.15).alias("short"), x["left"].alias("left"), (x["left"] - left).alias("lgap"),
            (F.col("page_right") - x["right"]).alias("rgap"), width.alias("wide"), _content(x["inline"], bare, item, size, body).alias("content")
        )

    above = F.transform(F.filter(F.arrays_zip("wide", "at"), lambda w: w["at"] == 0), lambda w: w["wide"])
    return pages.withColumns({"lines": F.transform("shown", looks), "above": above})


def _content(inline: Column, bare: Column, item: Column, size: Column, body: Column) -> Column:
    """What a line says: as an item, a heading or text, in its size where that is not the document's."""
    head = F.when(size > body * 1.45, "# ").when(size > body * 1.15, "## ")
    numbered = F.regexp_replace(inline, "^[0-9. ]+", "")
    signed = F.trim(F.regexp_replace(F.regexp_replace(inline, "^([^•●▪◆]*)[•●▪◆]", "$1"), "<i></i>|<b></b>|<u></u>", ""))
    plain = F.when(item["is_item"], F.when(item["number"].isNotNull(), numbered).otherwise(signed)).when(head.isNotNull(), F.concat(head, bare)).otherwise(inline)

    def styled(c: Column) -> Column:
        prefix = F.regexp_extract(c, "^(#{1,3} )", 1)
        return F.concat(prefix, F.lit('<span style="font-size: '), F.format_string("%.1f", size), F.lit('pt">'), F.regexp_replace(c, r"^(#{1,3} )\1*", ""), F.lit("</span>"))

    content = T.bound(plain, lambda c: F.when(F.abs(size - body) >= 1, styled(c)).otherwise(c))
    return F.when(item["is_item"], F.concat(F.coalesce(item["number"], F.lit("-")), F.lit(" "), content)).otherwise(content)


#: State: where the open centred block began (null: none is open), how far the open indented block is (0: none), whether an item's text
#: may go on, whether the line before was short.
_STATE = "struct<centre:double,indent:double,item:boolean,short:boolean>"
_START = "named_struct('centre', cast(null as double), 'indent', 0d, 'item', false, 'short', true)"


def step(state: Column, x: Column) -> Column:
    """(state, before, opens): the state behind a line ``x``, and what is written before its content."""
    body = x["body"]
    far, ruled_off = x["gap"] > body * 1.5, x["rules"] > 0
    was_open = state["centre"].isNotNull() | (state["indent"] > 0)
    head = ~x["bullet"] & (x["big"] | x["strong"] | (x["title"] & (~state["item"] | state["short"])))

    def with_head(h: Column) -> Column:
        heading = h["heading"]
        centre, indent = h["centre"], h["indent"]
        pad, off = x["wide"] * 0.1, F.abs(x["lgap"] - x["rgap"])
        based = (x["lgap"] > pad) & ((off < body * 2) | ((off < body * 10) & heading))
        held = centre.isNotNull() & (((x["lgap"] > pad) & (x["rgap"] > pad)) | (F.abs(x["left"] - centre) < 2))
        centred = (x["wide"] > 0) & ~x["bullet"] & (based | F.coalesce(held, F.lit(False)))
        own = F.when((x["lgap"] > body) & ~(x["numbered"] & (x["lgap"] < body * 5)), F.round(x["lgap"])).otherwise(F.lit(0.0))
        goes_on = state["item"] & ~x["bullet"] & ~heading & ~far
        by = F.when((x["wide"] <= 0), F.lit(0.0)).when(goes_on, indent).otherwise(own)
        return T.bound(F.struct(heading.alias("heading"), centre.alias("centre"), indent.alias("indent"), centred.alias("centred"), F.when(centred, F.lit(0.0)).otherwise(by).alias("by")), done)

    def done(h: Column) -> Column:
        centre, indent, by, centred = h["centre"], h["indent"], h["by"], h["centred"]
        leaves = (centre.isNotNull() & ~centred) | ((indent > 0) & ((by == 0) | (by != indent) | centred))
        shuts = far | x["bullet"] | h["heading"] | ruled_off | leaves
        breaks = shuts | x["caps"]
        return T.bound(F.struct(h.alias("h"), shuts.alias("shuts"), breaks.alias("breaks")), written)

    def written(d: Column) -> Column:
        h = d["h"]
        closed = was_open & d["shuts"]
        div = F.when(closed, "\n\n</div>\n\n").otherwise("")
        clean = closed | x["first"]
        apart = F.when(clean, "").otherwise("\n\n")
        before = (
            F.when(ruled_off, F.concat(div, apart, F.repeat(F.lit("---\n\n"), x["rules"]))).when(
                d["breaks"], F.concat(div, F.when(clean, "").when(x["bullet"] & ~far, "\n").otherwise("\n\n"))
            ).when(x["gap"] < -body, "").when(state["short"] & ~state["item"], "  \n").otherwise(" ")
        )
        still = ~d["shuts"]
        centre, indent = F.when(still, h["centre"]), F.when(still, h["indent"]).otherwise(F.lit(0.0))
        opens = F.when(h["centred"], F.when(centre.isNull(), '<div align="center">\n\n').otherwise("")).when(
            (h["by"] > 0) & (indent == 0), F.concat(F.lit('<div style="margin-left: '), h["by"].cast("long").cast("string"), F.lit('pt">\n\n'))
        ).otherwise("")
        new = F.struct(
            F.when(h["centred"], F.coalesce(centre, x["left"])).otherwise(centre).alias("centre"),
            F.when(~h["centred"] & (h["by"] > 0) & (indent == 0), h["by"]).otherwise(indent).alias("indent"),
            F.when(d["breaks"], x["bullet"]).otherwise(state["item"]).alias("item"), (h["centred"] | x["short"] | h["heading"]).alias("short")
        )
        return F.struct(new.cast(_STATE).alias("state"), before.alias("before"), opens.alias("opens"))

    # A rule closes what is open before anything else is looked at.
    none = F.lit(None).cast("double")
    return T.bound(
        F.struct(head.alias("heading"), F.when(ruled_off, none).otherwise(state["centre"]).alias("centre"), F.when(ruled_off, F.lit(0.0)).otherwise(state["indent"]).alias("indent")),
        with_head
    )


def _code(state: Column) -> Column:
    """The number of a state behind a page's first line."""
    return F.when(state["centre"].isNotNull(), 0).when(state["short"], 1).otherwise(2)


def _decoded(code: Column, x: Column) -> Column:
    """The state behind a page's first line ``x``, which closes all that was open and opens nothing but its own."""
    own = F.when((x["lgap"] > x["body"]) & ~(x["numbered"] & (x["lgap"] < x["body"] * 5)) & (x["wide"] > 0), F.round(x["lgap"])).otherwise(F.lit(0.0))
    return F.struct(
        F.when(code == 0, x["left"]).alias("centre"), F.when(code == 0, F.lit(0.0)).otherwise(own).alias("indent"), x["bullet"].alias("item"),
        (code < 2).alias("short")
    ).cast(_STATE)


_NONE = "cast(array() as array<string>)"


def _next_line(acc: Column, x: Column) -> Column:
    """States and texts behind one more line: of each way apart until all have come to one state, then of all together."""
    ways = acc["s"]
    piece = lambda r: F.array(F.concat(r["before"], r["opens"], x["content"]))

    def of(states: Column, heads: Column, common: Column) -> Column:
        return F.struct(states.alias("s"), heads.alias("heads"), common.alias("common"))

    together = lambda r: of(F.array(*[r["state"]] * 3), acc["heads"], F.concat(acc["common"], piece(r)))
    apart = lambda rs: of(F.transform(rs, lambda r: r["state"]), F.zip_with(acc["heads"], rs, lambda h, r: F.concat(h, piece(r))), acc["common"])
    met = ways[0].eqNullSafe(ways[1]) & ways[1].eqNullSafe(ways[2])
    return F.when(met, T.bound(step(ways[0], x), together)).otherwise(T.bound(F.transform(ways, lambda s: step(s, x)), apart))


def folded(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each page: its first line, its text behind that from each of three states (``heads``, then ``common``, where all three
    have come to one), the states ``behind`` it, its last line's height."""
    first = F.get("lines", F.lit(0))
    rest = F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))
    began = F.struct(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: _decoded(c, first)).alias("s"), F.array(*[F.expr(_NONE)] * 3).alias("heads"), F.expr(_NONE).alias("common"))
    pages = pages.withColumn("end", F.aggregate(rest, began, _next_line))
    return pages.select(
        key, "page", first.alias("top"), "above", F.get("lines", F.size("lines") - 1)["y"].cast("double").alias("last_y"),
        F.transform("end.heads", lambda h: F.array_join(h, "")).alias("heads"), F.array_join("end.common", "").alias("common"), F.col("end.s").alias("behind")
    )


def _next_page(acc: Column, p: Column) -> Column:
    """A document's text and state behind one more page."""
    top, y = p["top"]["top"], acc["last_y"]
    rules = F.when(_finite(top) & _finite(y), F.size(F.filter(p["above"], lambda r: (r > top) & (r < y)))).otherwise(0)
    x = p["top"].withField("rules", rules).withField("first", F.size(acc["out"]) == 0)

    def of(r: Column) -> Column:
        page = lambda c: F.concat(r["before"], r["opens"], p["top"]["content"], p["heads"][c], p["common"])
        return T.bound(_code(r["state"]), lambda c: F.struct(p["behind"][c].alias("s"), p["last_y"].alias("last_y"), F.concat(acc["out"], F.array(page(c))).alias("out")))

    return T.bound(x, lambda x: T.bound(step(acc["s"], x), of))


def pages_to_markdown(spans: DataFrame, rects: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, md) of each document with visible text: settings, then its lines in order."""
    with storage.freed(spans.sparkSession):
        pages = storage.materialise(packed(spans, rects, key), "pages")
        of_docs = storage.materialise(settings(pages, key), "settings")
    lines = page_lines(pages.filter("page is not null").join(of_docs.drop("font_name"), key))
    row = F.when(F.col("top").isNotNull(), F.struct("page", "top", "above", "last_y", "heads", "common", "behind"))
    # Pages without lines go here: a filter before would be moved down, with all that it names worked out once more.
    docs = folded(lines, key).groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("pages")).filter(F.size("pages") > 0)
    began = F.struct(F.expr(_START).cast(_STATE).alias("s"), F.lit(None).cast("double").alias("last_y"), F.expr(_NONE).alias("out"))
    left_open = lambda s: F.when(s["centre"].isNotNull() | (s["indent"] > 0), "\n\n</div>\n\n").otherwise("")
    text = F.aggregate("pages", began, _next_page, lambda acc: F.concat(F.array_join(acc["out"], ""), left_open(acc["s"])))
    head = F.concat(
        F.lit("---\npage:\n  font_size: "), F.format_string("%.1f", "body"), F.lit('pt\n  font_family: "'), "font_name",
        F.lit('"\n  line_spacing: 0.65em\n---\n\n')
    )
    return docs.select(key, text.alias("text")).join(of_docs, key).select(key, F.regexp_replace(F.concat(head, "text"), r"(?U)^\s+|\s+\z", "").alias("md"))
