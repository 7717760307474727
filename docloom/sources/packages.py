"""Office packages as node rows, and what their parts refer to in each other as joins.

``package_nodes`` shreds a package's XML parts once: an element is a row with the places of its start and end in its part
(``pre``, ``post``), so what stands in what is a comparison of numbers. Links, comments and notes are then joins by key and by
interval over all packages at once. A part that is no XML, and a file that is no package, give no rows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODE = "path string, part string, pre long, post long, tag string, attrs map<string,string>, text string"
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: Node rows that travel together, and places of a part that text and ranges meet by.
BATCH, CELL = 4096, 1024
DOCUMENT, RELATIONS, COMMENTS, NOTES = "word/document.xml", "word/_rels/document.xml.rels", "word/comments.xml", "word/footnotes.xml"


def _name(qualified: str, attribute: bool = False) -> str:
    uri, _, local = qualified.rpartition("}")
    return f"r:{local}" if attribute and uri[1:] == _RELATIONS else local


def part_nodes(xml) -> Iterator[tuple]:
    """(pre, post, tag, attrs, text) of each element of an open part, by their ends; elements are let go when they have ended."""
    at, open_ = 0, []
    for event, element in ElementTree.iterparse(xml, ("start", "end")):
        at += 1
        if event == "start":
            open_.append(at)
        else:
            attrs = {_name(k, True): v for k, v in element.attrib.items()}
            yield open_.pop(), at, _name(element.tag), attrs, element.text or ""
            element.clear()


def package_nodes(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, part, pre, post, tag, attrs, text) of the XML parts of packages."""

    def shredded(batches):
        import pyarrow as pa

        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
        names = ["path", "part", "pre", "post", "tag", "attrs", "text"]

        def told(rows):
            columns = [pa.array([list(v.items()) for v in c] if t == types[5] else c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            rows = []
            for path, content in ((p.as_py(), c.as_py()) for p, c in zip(batch.column(0), batch.column(1), strict=True)):
                try:
                    package = zipfile.ZipFile(io.BytesIO(content or b""))
                except zipfile.BadZipFile:
                    continue
                for part in dict.fromkeys(n for n in package.namelist() if n.endswith((".xml", ".rels"))):
                    kept = len(rows)
                    try:
                        with package.open(part) as xml:
                            rows += ((path, part, *node) for node in part_nodes(xml))
                    except (ElementTree.ParseError, zipfile.BadZipFile):
                        del rows[kept:]
                    while len(rows) > BATCH:
                        yield told(rows[:BATCH])
                        rows = rows[BATCH:]
            if rows:
                yield told(rows)

    return files.select(F.col(path_col).cast("string"), F.col(content_col).cast("binary")).mapInArrow(shredded, NODE)


def _last_of_key(nodes: DataFrame, key: str, *columns) -> DataFrame:
    """Of nodes with one key the last one counts."""
    rows = nodes.filter(F.col(key).isNotNull())
    return rows.groupBy("path", key).agg(*(F.max_by(c, "pre").alias(n) for n, c in columns))


def _texts(nodes: DataFrame) -> DataFrame:
    return nodes.filter((F.col("part") == DOCUMENT) & (F.col("tag") == "t") & (F.col("text") != "")).select("path", "pre", "text")


def _inside(ranges: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """(path, columns, inside): the text between each range's places ``a`` and ``b``; a range and a text meet by a stretch of places."""
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("a") / CELL), F.floor(F.greatest("a", "b") / CELL))))
    texts = texts.withColumn("cell", F.floor(F.col("pre") / CELL)).withColumnRenamed("pre", "at")
    met = cells.join(texts, ["path", "cell"]).filter((F.col("at") > F.col("a")) & (F.col("at") < F.col("b")))
    inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda t: t["text"]), "")
    found = met.groupBy("path", *columns).agg(inside.alias("inside"))
    return ranges.join(found, ["path", *columns], "left").fillna("", ["inside"])


def _content(nodes: DataFrame, part: str, tag: str) -> DataFrame:
    """(path, id, author, content): the elements ``tag`` of a part with all text in them; of one id the last counts. They are not in each other."""
    own = nodes.filter(F.col("part") == part)
    w = Window.partitionBy("path").orderBy("pre")
    inner = F.last(F.when(F.col("tag") == tag, F.struct("pre", "post")), ignorenulls=True).over(w)
    rows = own.withColumn("of", inner).filter("pre <= of.post")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == "t", F.struct("pre", "text")))), lambda t: t["text"]), "")
    head = F.max(F.when(F.col("tag") == tag, F.struct(F.col("attrs")["id"].alias("id"), F.coalesce(F.col("attrs")["author"], F.lit("")).alias("author"))))
    whole = rows.groupBy("path", F.col("of.pre").alias("pre")).agg(head.alias("h"), text.alias("content"))
    whole = whole.select("path", "pre", "h.id", "h.author", "content")
    return _last_of_key(whole, "id", ("author", F.col("author")), ("content", F.col("content")))


def hyperlinks(nodes: DataFrame) -> DataFrame:
    """(path, pre, url, text): links of documents; an id that has no relationship is its own address."""
    rels = nodes.filter((F.col("part") == RELATIONS) & (F.col("tag") == "Relationship")).withColumn("id", F.col("attrs")["Id"])
    targets = _last_of_key(rels, "id", ("target", F.coalesce(F.col("attrs")["Target"], F.lit(""))))
    links = nodes.filter((F.col("part") == DOCUMENT) & (F.col("tag") == "hyperlink")).select("path", F.col("pre").alias("a"), F.col("post").alias("b"), F.col("attrs")["r:id"].alias("id"))
    found = _inside(links.filter("id is not null"), _texts(nodes), "a").join(targets, ["path", "id"], "left")
    return found.select("path", F.col("a").alias("pre"), F.coalesce("target", "id").alias("url"), F.col("inside").alias("text"))


def comments(nodes: DataFrame) -> DataFrame:
    """(path, pre, comment_id, author, content, text): comments with the text under them, a row for each beginning of a range.

    A range ends at the next end with its id, otherwise with the document. A range without comment, and a comment without range, is left out.
    """
    marks = nodes.filter((F.col("part") == DOCUMENT) & F.col("tag").isin("commentRangeStart", "commentRangeEnd")).select("path", "pre", "tag", F.col("attrs")["id"].alias("id"))
    behind = Window.partitionBy("path", "id").orderBy("pre").rowsBetween(1, Window.unboundedFollowing)
    ends = F.first(F.when(F.col("tag") == "commentRangeEnd", F.col("pre")), ignorenulls=True).over(behind)
    last = nodes.filter(F.col("part") == DOCUMENT).groupBy("path").agg(F.max("post").alias("last"))
    ranges = marks.withColumn("b", ends).filter("tag = 'commentRangeStart'").join(last, "path")
    ranges = ranges.select("path", "id", F.col("pre").alias("a"), F.coalesce("b", "last").alias("b"))
    found = _inside(ranges.join(_content(nodes, COMMENTS, "comment"), ["path", "id"]), _texts(nodes), "a")
    return found.select("path", F.col("a").alias("pre"), F.col("id").alias("comment_id"), "author", "content", F.col("inside").alias("text"))


def footnotes(nodes: DataFrame) -> DataFrame:
    """(path, pre, note_id, content): references to notes in a document; content is null where there is no such note."""
    refs = nodes.filter((F.col("part") == DOCUMENT) & (F.col("tag") == "footnoteReference")).select("path", "pre", F.col("attrs")["id"].alias("id"))
    found = refs.join(_content(nodes, NOTES, "footnote").drop("author"), ["path", "id"], "left")
    return found.select("path", "pre", F.col("id").alias("note_id"), "content")
