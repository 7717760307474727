"""Documents as ordered event rows: parsing, structure, outlines, segmentation, assembly, mail merge.

Parsing is per-document Python in Arrow batches; what follows works on event rows. Within a document
events are ordered by ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.schemas import EVENT


def parse_markdown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "md", extensions: bool = True) -> DataFrame:
    """(``id_col``, seq, kind, tag, depth, text, attrs), one row for each event."""

    def parsed(batches):
        import pyarrow as pa

        from docloom.md.parser import parse

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 64):
                rows, owner = [], []
                for k, text in enumerate(texts.slice(at, 64).to_pylist(), at):
                    events = parse(text, extensions)
                    rows += enumerate(events)
                    owner += [k] * len(events)
                columns = [
                    pa.array([s for s, _ in rows], pa.int32()),
                    *(
                        pa.array([getattr(e, n) for _, e in rows], kind) for n,
                        kind in (("kind", pa.string()), ("tag", pa.string()), ("depth", pa.int32()), ("text", pa.string()))
                    )
                ]
                attrs = pa.array([list(e.attrs.items()) for _, e in rows], pa.map_(pa.string(), pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner, pa.int32())), *columns, attrs],
                    [batch.schema.names[0], "seq", "kind", "tag", "depth", "text", "attrs"]
                )

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(parsed, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {EVENT}")


def top_level_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "md") -> DataFrame:
    """(``id_col``, pos, block): the sources of the outermost blocks."""

    @F.udf("array<string>", useArrow=False)  # texts are large: a hundred rows at a time
    def blocks(text: str):
        from docloom.md.parser import top_level_blocks

        return top_level_blocks(text)

    return docs.select(id_col, F.posexplode(blocks(text_col)).alias("pos", "block"))


def _is(kind: str, tag: str | None = None) -> Column:
    return (F.col("kind") == kind) & (F.col("tag") == tag) if tag else F.col("kind") == kind


def _counters() -> dict[str, Column]:
    return {
        "headings": _is("start", "heading"),
        "unordered_items": _is("start", "item") & (F.col("attrs")["ordered"] == "false"),
        "ordered_items": _is("start", "item") & (F.col("attrs")["ordered"] == "true"),
        "code_blocks": _is("start", "code_block"),
        "table_rows": _is("start", "table_row") | _is("start", "table_head"),
        "tables": _is("start", "table"),
        "blockquotes": _is("start", "blockquote"),
        "math_blocks": _is("display_math"),
        "inline_math": _is("inline_math"),
        "bold": _is("start", "strong"),
        "italic": _is("start", "emphasis"),
        "strikethrough": _is("start", "strikethrough"),
        "hyperlinks": _is("start", "link"),
        "footnotes": _is("start", "footnote") | _is("footnote_ref"),
        "tasklists": _is("task"),
        "images": _is("start", "image"),
    }


#: Counters over substrings of the source.
SOURCE_COUNTERS = {"comments": '<mark class="comment"', "highlights": '<mark class="highlight"', "insertions": "<ins[ >]", "deletions": "<del[ >]"}
METRICS = (
    "headings", "unordered_items", "ordered_items", "code_blocks", "table_rows", "tables", "blockquotes", "math_blocks", "inline_math",
    "bold", "italic", "strikethrough", "hyperlinks", "footnotes", "tasklists", "images", *SOURCE_COUNTERS
)


def structure_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "md") -> DataFrame:
    """The twenty counters of each document; a table's head counts as a row."""
    events = parse_markdown(docs, id_col, text_col).groupBy(id_col).agg(*(F.count_if(c).alias(n) for n, c in _counters().items()))
    source = docs.select(id_col, *(F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(p)).cast("long").alias(n) for n, p in SOURCE_COUNTERS.items()))
    return source.join(events, id_col, "left").select(id_col, *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in METRICS))


def structural_similarity(a: str, b: str) -> Column:
    """Mean over the counters of 1 - |x - y| / (x + y); two zeros are alike. ``a``, ``b``: aliases of metrics."""
    part = lambda n: F.when(F.col(f"{a}.{n}") + F.col(f"{b}.{n}") == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.abs(F.col(f"{a}.{n}") - F.col(f"{b}.{n}")) / (F.col(f"{a}.{n}") + F.col(f"{b}.{n}"))
    )
    return sum((part(n) for n in METRICS[1:]), part(METRICS[0])) / F.lit(float(len(METRICS)))


def attach_attributes(events: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A paragraph that is an attribute block goes; its classes and id are put on the block end before it.

    Of attribute blocks in a row only the first has an effect; the others go as well.
    """
    w = Window.partitionBy(id_col).orderBy("seq")
    block = T.attribute_block("text")
    triple = (F.lag("kind").over(w) == "start") & (F.lag("tag").over(w) == "paragraph") & (F.col("kind") == "text") & (F.lead("kind").over(w) == "end") & (F.lead("tag").over(w) == "paragraph")
    marked = events.withColumn("own", F.when(triple, block))
    gone = F.col("own").isNotNull() | F.lead("own").over(w).isNotNull() | F.lag("own").over(w).isNotNull()
    # Two places ahead: the block's text follows its start.
    given = F.when((F.col("kind") == "end") & ~gone, F.lead("own", 2).over(w))
    out = marked.withColumns({"gone": gone, "given": given}).filter("not gone")
    return out.withColumns({"classes": F.coalesce("given.classes", F.array().cast("array<string>")), "attr_id": F.col("given.id")}).drop("own", "gone", "given")


def _text_of(events: DataFrame, tag: str, keys: list[str], id_col: str) -> DataFrame:
    """(id, n, text, ``keys`` of the attributes) of every element of a kind, numbered in order."""
    w = Window.partitionBy(id_col).orderBy("seq")
    n = F.sum(F.when(_is("start", tag), 1).otherwise(0)).over(w)
    ended = F.sum(F.when(_is("end", tag), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    inside = events.withColumns({"n": n, "open": n > F.coalesce(ended, F.lit(0))}).filter("open")
    words = F.when(F.col("kind").isin("text", "code", "inline_math"), F.col("text")).when(F.col("kind").isin("soft_break", "hard_break"), F.lit(" "))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", words.alias("t")))), lambda x: x["t"]), "")
    attrs = F.max_by("attrs", F.when(_is("start", tag), F.lit(1)).otherwise(F.lit(0)))
    return inside.groupBy(id_col, "n").agg(whole.alias("text"), F.min("seq").alias("seq"), attrs.alias("a")).select(
        id_col, "n", "seq", "text", *(F.col("a")[k].alias(k) for k in keys)
    )


def outline(events: DataFrame, id_col: str = "doc_id", deepest: int = 6) -> DataFrame:
    """(id, seq, level, label): headings in order, labels of up to 60 characters."""
    heads = _text_of(events, "heading", ["level"], id_col)
    return heads.select(
        id_col, "seq", F.col("level").cast("int").alias("level"), F.substring(F.trim("text"), 1, 60).alias("label")
    ).filter(F.col("level") <= deepest)


def table_of_contents(events: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, seq, level, html): list items of h1 to h3, lists opened and closed by the change of level."""
    w = Window.partitionBy(id_col).orderBy("seq")
    delta = F.col("level") - F.coalesce(F.lag("level").over(w), F.lit(0))
    tags = F.concat(F.repeat(F.lit("<ul>"), F.greatest(delta, F.lit(0))), F.repeat(F.lit("</ul>"), F.greatest(-delta, F.lit(0))))
    return outline(events, id_col, 3).select(id_col, "seq", "level", F.concat(tags, F.lit("<li>"), T.xml_escape("label"), F.lit("</li>")).alias("html"))


def footnotes(events: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, label, text): the last definition of each label."""
    notes = _text_of(events, "footnote", ["label"], id_col)
    return notes.groupBy(id_col, "label").agg(F.max_by("text", "seq").alias("text"))


def resolve_footnotes(events: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, seq, label, text): references with their definition, if there is one."""
    refs = events.filter(_is("footnote_ref")).select(id_col, "seq", F.col("text").alias("label"))
    return refs.join(footnotes(events, id_col), [id_col, "label"], "left").select(id_col, "seq", "label", "text")


def cross_references(events: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, kind, n, label): headings, figures, tables, footnotes and bookmarks that can be referred to."""
    w = Window.partitionBy(id_col).orderBy("seq")
    number = lambda df, kind, label: df.select(id_col, F.lit(kind).alias("kind"), F.row_number().over(w).alias("n"), label.alias("label"))
    marks = events.filter(F.col("kind").isin("inline_html", "html")).withColumn(
        "mark", F.regexp_extract("text", r'<a\s+(?:id|name)="([^"]+)"', 1)
    ).filter("mark <> ''")
    parts = [
        number(outline(events, id_col), "heading", F.col("label")),
        number(_text_of(events, "image", ["dest"], id_col), "figure", F.col("text")),
        number(events.filter(_is("start", "table")), "table", F.lit("")),
        number(_text_of(events, "footnote", ["label"], id_col), "footnote", F.col("label")),
        number(marks, "bookmark", F.col("mark")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chapters(events: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, chapter, title, n_events): a chapter begins at each first-level heading; before it is "Content"."""
    w = Window.partitionBy(id_col).orderBy("seq")
    begins = _is("start", "heading") & (F.col("attrs")["level"] == "1")
    numbered = events.withColumn("k", F.sum(F.when(begins, 1).otherwise(0)).over(w))
    titles = _text_of(events, "heading", ["level"], id_col).filter("level = 1").select(id_col, F.row_number().over(w).alias("k"), F.trim("text").alias("title"))
    sizes = numbered.groupBy(id_col, "k").agg(F.count(F.lit(1)).alias("n_events"))
    named = sizes.join(titles, [id_col, "k"], "left").withColumn("chapter", F.row_number().over(Window.partitionBy(id_col).orderBy("k")))
    title = F.when(F.col("k") == 0, F.lit("Content")).when(
        F.coalesce("title", F.lit("")) == "", F.concat(F.lit("Chapter "), F.col("chapter").cast("string"))
    ).otherwise(F.col("title"))
    return named.select(id_col, F.col("chapter").cast("long").alias("chapter"), title.alias("title"), "n_events")


def slides(events: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, slide, title, n_events): a rule, or a first- or second-level heading after content, begins a slide.

    A heading that directly follows a rule stays on the slide that the rule began.
    """
    w = Window.partitionBy(id_col).orderBy("seq")
    heading = _is("start", "heading") & F.col("attrs")["level"].isin("1", "2")
    first = F.row_number().over(w) == 1
    begins = _is("rule") | (heading & ~first & (F.lag("kind").over(w) != "rule"))
    numbered = events.withColumn("slide", F.sum(F.when(begins, 1).otherwise(0)).over(w)).filter(~_is("rule"))
    heads = _text_of(events, "heading", ["level"], id_col).filter("level <= 2").select(id_col, "seq", F.col("text").alias("title"))
    titled = numbered.join(heads, [id_col, "seq"], "left")
    sizes = titled.groupBy(id_col, "slide").agg(
        F.min_by("title", F.when(F.col("title").isNotNull(), F.col("seq"))).alias("title"), F.count(F.lit(1)).alias("n_events")
    )
    return sizes.select(
        id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("slide")).cast("long").alias("slide"),
        F.coalesce("title", F.lit("")).alias("title"), "n_events"
    )


def mail_merge(template: DataFrame, records: DataFrame, record_col: str = "record", key: str = "record_id") -> DataFrame:
    """A template's events once for each record, fields filled in text, block HTML and targets of links and images.

    The template is one document, so it is what every task holds; its size is checked.
    """
    events = template.select("seq", "kind", "tag", "depth", "text", "attrs")
    size = F.sum(F.octet_length(F.to_json(F.struct(*events.columns))))
    n_bytes = events.agg(F.coalesce(size, F.lit(0)).alias("n")).first()["n"]
    if n_bytes > MOST_TEMPLATE_BYTES:
        raise ValueError(f"a template of {n_bytes} bytes; at most {MOST_TEMPLATE_BYTES}")
    merged = records.select(key, record_col).crossJoin(F.broadcast(events))
    fill = lambda c: F.when(F.coalesce(c, F.lit("")).contains("{{"), T.substitute(c, F.col(record_col))).otherwise(c)
    text = F.when(F.col("kind").isin("text", "html"), fill(F.col("text"))).otherwise(F.col("text"))
    attrs = F.when(F.col("tag").isin("link", "image"), F.transform_values("attrs", lambda k, v: fill(v))).otherwise(F.col("attrs"))
    return merged.select(key, "seq", "kind", "tag", "depth", text.alias("text"), attrs.alias("attrs"))


MOST_TEMPLATE_BYTES = 8 << 20


def merged_document(template: DataFrame, records: DataFrame, record_col: str = "record", key: str = "record_id") -> DataFrame:
    """One document of a template's copies, in the order of ``key``, with page breaks between them.

    ``key`` counts records from 0, and a copy's ids are those of the namespace ``merge-`` and that number. Merging
    nothing is an error.
    """
    if records.isEmpty():
        raise ValueError("no records to merge")
    return assemble(mail_merge(template, records, record_col, key), key, F.concat(F.lit("merge-"), F.col(key).cast("string")))


def assemble(events: DataFrame, order: str, namespace: Column) -> DataFrame:
    """Documents one behind the other: (doc order, seq, ...) with a page break before each but the first.

    Ids of headings, targets within the document and ids in block HTML get the document's namespace.
    """
    prefix = F.concat(namespace, F.lit("-"))
    dest, own = F.col("attrs")["dest"], F.col("attrs")["id"]
    attrs = (
        F.when(
            F.col("tag").isin("link") & dest.startswith("#"),
            F.map_concat(
                F.map_filter("attrs", lambda k, v: k != "dest"),
                F.create_map(F.lit("dest"), F.concat(F.lit("#"), prefix, F.substring(dest, 2, 2**31 - 1)))
            )
        )
        .when(
            (F.col("tag") == "heading") & own.isNotNull(),
            F.map_concat(F.map_filter("attrs", lambda k, v: k != "id"), F.create_map(F.lit("id"), F.concat(prefix, own)))
        )
        .otherwise(F.col("attrs"))
    )
    html = F.replace(F.replace("text", F.lit('id="'), F.concat(F.lit('id="'), prefix)), F.lit('href="#'), F.concat(F.lit('href="#'), prefix))
    text = F.when(F.col("kind") == "html", html).otherwise(F.col("text"))
    body = events.select(order, "seq", "kind", "tag", "depth", text.alias("text"), attrs.alias("attrs"))
    first = events.agg(F.min(order).alias("first"))
    docs = events.select(order).distinct().crossJoin(F.broadcast(first)).filter(F.col(order) > F.col("first"))  # the right side is one row
    none = F.create_map().cast("map<string,string>")
    breaks = docs.select(
        order, F.lit(-1).alias("seq"), F.lit("page_break").alias("kind"), F.lit("").alias("tag"), F.lit(0).alias("depth"),
        F.lit("").alias("text"), none.alias("attrs")
    )
    return body.unionByName(breaks)


def redact_events(events: DataFrame, marked: Column) -> DataFrame:
    """Marked events lose every text they bear: code, math, HTML, titles and targets as well."""
    attrs = F.when(
        marked, F.transform_values("attrs", lambda k, v: F.when(k.isin("title", "dest", "label"), T.redact(v)).otherwise(v))
    ).otherwise(F.col("attrs"))
    return events.withColumns({"text": F.when(marked, T.redact("text")).otherwise(F.col("text")), "attrs": attrs})
