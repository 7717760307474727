"""Office and e-book files: XML from event rows by rules, packed into an archive per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import xml_escape
from docloom.operators.events import outline
from docloom.sinks.text import render

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def _running(events: DataFrame, id_col: str, *tags: str) -> DataFrame:
    """Adds for each tag how many of its elements are open (``open_<tag>``)."""
    w = Window.partitionBy(id_col).orderBy("seq")
    step = lambda t: F.when(
        (F.col("kind") == "start") & (F.col("tag") == t), 1
    ).when((F.col("kind") == "end") & (F.col("tag") == t), -1).otherwise(0)
    return events.withColumns({f"open_{t}": F.sum(step(t)).over(w) for t in tags})


def _joined(rows: DataFrame, id_col: str, piece: Column, *more: str) -> DataFrame:
    parts = rows.select(id_col, *more, "seq", F.coalesce(piece, F.lit("")).alias("p"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "p"))), lambda x: x["p"]), "")
    return parts.groupBy(id_col, *more).agg(body.alias("xml"))


def word_xml(events: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, xml): a document's body; list items are numbered paragraphs (1 bullets, 2 numbers)."""
    rows = _running(events, id_col, "strong", "emphasis", "strikethrough", "list", "code_block", "table_cell")
    is_ = lambda kind, tag: (F.col("kind") == kind) & (F.col("tag") == tag)
    on = lambda tag, mark: F.when(F.col(f"open_{tag}") > 0, F.lit(f"<w:{mark}/>")).otherwise(F.lit(""))
    run = lambda text: F.concat(
        F.lit("<w:r><w:rPr>"), on("strong", "b"), on("emphasis", "i"), on("strikethrough", "strike"),
        F.lit('</w:rPr><w:t xml:space="preserve">'), xml_escape(text), F.lit("</w:t></w:r>")
    )
    inner = (F.col("open_list") > 0) | (F.col("open_table_cell") > 0)
    number = F.concat(
        F.lit('<w:p><w:pPr><w:numPr><w:ilvl w:val="'), (F.col("open_list") - 1).cast("string"), F.lit('"/><w:numId w:val="'),
        F.when(F.col("attrs")["ordered"] == "true", "2").otherwise("1"), F.lit('"/></w:numPr></w:pPr>')
    )
    line = F.lit("<w:r><w:br/></w:r>")
    piece = (
        F.when(is_("start", "heading"), F.concat(F.lit('<w:p><w:pPr><w:pStyle w:val="Heading'), F.col("attrs")["level"], F.lit('"/></w:pPr>')))
        .when(is_("start", "paragraph"), F.when(inner, F.lit("")).otherwise(F.lit("<w:p>")))
        .when(is_("end", "paragraph"), F.when(inner, line).otherwise(F.lit("</w:p>")))
        .when(is_("end", "heading") | is_("end", "code_block") | is_("end", "item"), F.lit("</w:p>"))
        .when(is_("start", "code_block"), F.lit('<w:p><w:pPr><w:pStyle w:val="Code"/></w:pPr>'))
        .when(is_("start", "item"), number)
        # A list inside an item ends that item's paragraph; what follows is a new one.
        .when(is_("start", "list"), F.when(F.col("open_list") > 1, F.lit("</w:p>")).otherwise(F.lit("")))
        .when(is_("end", "list"), F.when(F.col("open_list") > 0, F.lit("<w:p>")).otherwise(F.lit("")))
        .when(is_("start", "table"), F.lit("<w:tbl>"))
        .when(is_("end", "table"), F.lit("</w:tbl>"))
        .when(is_("start", "table_row") | is_("start", "table_head"), F.lit("<w:tr>"))
        .when(is_("end", "table_row") | is_("end", "table_head"), F.lit("</w:tr>"))
        .when(is_("start", "table_cell"), F.lit("<w:tc><w:p>"))
        .when(is_("end", "table_cell"), F.lit("</w:p></w:tc>"))
        .when(F.col("kind").isin("text", "code", "inline_math", "display_math"), run(F.col("text")))
        .when(F.col("kind") == "soft_break", run(F.lit(" ")))
        .when(F.col("kind") == "hard_break", line)
        .when(F.col("kind").isin("rule", "page_break"), F.lit('<w:p><w:r><w:br w:type="page"/></w:r></w:p>'))
    )
    return _joined(rows, id_col, piece)


def open_document_xml(events: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, xml): headings, paragraphs, lists and tables of an OpenDocument text."""
    rows = _running(events, id_col, "list", "table_cell")
    is_ = lambda kind, tag: (F.col("kind") == kind) & (F.col("tag") == tag)
    inner = (F.col("open_list") > 0) | (F.col("open_table_cell") > 0)
    style = {"strong": "Bold", "emphasis": "Italic", "strikethrough": "Strike"}
    piece = F.when(
        is_("start", "heading"), F.concat(F.lit('<text:h text:outline-level="'), F.col("attrs")["level"], F.lit('">'))
    ).when(is_("end", "heading"), F.lit("</text:h>"))
    piece = piece.when(is_("start", "paragraph"), F.when(inner, "").otherwise("<text:p>")).when(
        is_("end", "paragraph"), F.when(inner, "<text:line-break/>").otherwise("</text:p>")
    )
    for tag, (a, b) in {
        "code_block": ("<text:p>", "</text:p>"), "item": ("<text:list-item><text:p>", "</text:p></text:list-item>"),
        "table": ("<table:table>", "</table:table>"), "table_row": ("<table:table-row>", "</table:table-row>"),
        "table_head": ("<table:table-row>", "</table:table-row>"),
        "table_cell": ("<table:table-cell><text:p>", "</text:p></table:table-cell>")
    }.items():
        piece = piece.when(is_("start", tag), F.lit(a)).when(is_("end", tag), F.lit(b))
    name = F.when(F.col("attrs")["ordered"] == "true", "Numbers").otherwise("Bullets")
    piece = piece.when(
        is_("start", "list"),
        F.concat(F.when(F.col("open_list") > 1, "</text:p>").otherwise(""), F.lit('<text:list text:style-name="'), name, F.lit('">'))
    ).when(is_("end", "list"), F.concat(F.lit("</text:list>"), F.when(F.col("open_list") > 0, "<text:p>").otherwise("")))
    for tag, s in style.items():
        piece = piece.when(is_("start", tag), F.lit(f'<text:span text:style-name="{s}">')).when(is_("end", tag), F.lit("</text:span>"))
    piece = piece.when(
        F.col("kind").isin("text", "code", "inline_math", "display_math"), xml_escape("text")
    ).when(F.col("kind") == "soft_break", F.lit(" ")).when(F.col("kind") == "hard_break", F.lit("<text:line-break/>"))
    return _joined(rows, id_col, piece)


def packed(files: Column) -> Column:
    """An archive of (name, content) pairs, in order; the first is stored as it is."""

    @F.udf("binary", useArrow=False)  # files are large: a hundred rows at a time
    def pack(entries):
        import io
        import zipfile

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, e in enumerate(entries):
                # A fixed date: equal documents give equal files.
                z.writestr(zipfile.ZipInfo(e["name"], (1980, 1, 1, 0, 0, 0)), e["content"], zipfile.ZIP_DEFLATED if k else zipfile.ZIP_STORED)
        return out.getvalue()

    return pack(files)


def _file(name: str | Column, content: str | Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(name).alias("name"), lit(content).alias("content"))


def docx(events: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, content) of Word files."""
    types = (
        f'{_HEAD}<Types xmlns="{_TYPES}"><Default Extension="rels" '
        f'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" '
        f'ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    )
    rels = f'{_HEAD}<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>'
    body = F.concat(F.lit(f"{_HEAD}<w:document {_W}><w:body>"), "xml", F.lit("</w:body></w:document>"))
    return word_xml(events, id_col).select(
        id_col,
        packed(F.array(_file("[Content_Types].xml", types), _file("_rels/.rels", rels), _file("word/document.xml", body))).alias("content")
    )


def odt(events: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, content) of OpenDocument texts."""
    ns = "urn:oasis:names:tc:opendocument:xmlns"
    kind = "application/vnd.oasis.opendocument.text"
    styles = "".join(
        f'<style:style style:name="{n}" style:family="text"><style:text-properties {p}/></style:style>' for n,
        p in (("Bold", 'fo:font-weight="bold"'), ("Italic", 'fo:font-style="italic"'), ("Strike", 'style:text-line-through-style="solid"'))
    )
    head = (
        f'{_HEAD}<office:document-content xmlns:office="{ns}:office:1.0" xmlns:text="{ns}:text:1.0" xmlns:table="{ns}:table:1.0" '
        f'xmlns:style="{ns}:style:1.0" xmlns:fo="{ns}:xsl-fo-compatible:1.0" '
        f'office:version="1.2"><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:text>'
    )
    manifest = (
        f'{_HEAD}<manifest:manifest xmlns:manifest="{ns}:manifest:1.0"><manifest:file-entry manifest:full-path="/" '
        f'manifest:media-type="{kind}"/><manifest:file-entry manifest:full-path="content.xml" '
        f'manifest:media-type="text/xml"/></manifest:manifest>'
    )
    body = F.concat(F.lit(head), "xml", F.lit("</office:text></office:body></office:document-content>"))
    return open_document_xml(events, id_col).select(
        id_col,
        packed(F.array(_file("mimetype", kind), _file("META-INF/manifest.xml", manifest), _file("content.xml", body))).alias("content")
    )


def epub(events: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, content) of e-books: a chapter for each first-level heading."""
    w = Window.partitionBy(id_col).orderBy("seq")
    begins = (F.col("kind") == "start") & (F.col("tag") == "heading") & (F.col("attrs")["level"] == "1")
    numbered = events.withColumn("chapter", F.sum(F.when(begins, 1).otherwise(0)).over(w)).withColumn("__key", F.struct(F.col(id_col).alias("id"), "chapter"))
    text = render(numbered.drop(id_col), "xhtml", "__key").select(F.col("__key.id").alias(id_col), "__key.chapter", "text")
    name = lambda c: F.concat(F.lit("chapter"), c.cast("string"), F.lit(".xhtml"))
    books = text.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("chapter", "text"))).alias("c"))
    items = F.array_join(
        F.transform(
            "c",
            lambda x: F.concat(
                F.lit('<item id="c'), x["chapter"].cast("string"), F.lit('" href="'), name(x["chapter"]),
                F.lit('" media-type="application/xhtml+xml"/>')
            )
        ),
        ""
    )
    spine = F.array_join(F.transform("c", lambda x: F.concat(F.lit('<itemref idref="c'), x["chapter"].cast("string"), F.lit('"/>'))), "")
    title = F.concat(F.lit("Document "), F.col(id_col).cast("string"))
    opf = F.concat(
        F.lit(
            (
                f'{_HEAD}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata '
                f'xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">'
            )
        ),
        title, F.lit("</dc:identifier><dc:title>"), title, F.lit("</dc:title><dc:language>en</dc:language></metadata><manifest>"), items,
        F.lit("</manifest><spine>"), spine, F.lit("</spine></package>")
    )
    container = (
        f'{_HEAD}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile '
        f'full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    )
    files = F.concat(
        F.array(_file("mimetype", "application/epub+zip"), _file("META-INF/container.xml", container), _file("OEBPS/content.opf", opf)),
        F.transform("c", lambda x: _file(F.concat(F.lit("OEBPS/"), name(x["chapter"])), x["text"]))
    )
    return books.select(id_col, packed(files).alias("content"))


def pptx(events: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, content) of slides: the first heading is a slide's title, other blocks are its paragraphs."""
    w = Window.partitionBy(id_col).orderBy("seq")
    heading = (F.col("kind") == "start") & (F.col("tag") == "heading") & F.col("attrs")["level"].isin("1", "2")
    begins = (F.col("kind") == "rule") | (heading & (F.row_number().over(w) > 1) & (F.lag("kind").over(w) != "rule"))
    rows = _running(events, id_col, "heading").withColumn("slide", F.sum(F.when(begins, 1).otherwise(0)).over(w) + 1)
    titled = outline(events, id_col, 2).select(id_col, "seq", F.col("label").alias("title"))
    titles = rows.join(titled, [id_col, "seq"]).groupBy(id_col, "slide").agg(F.min_by("title", "seq").alias("title"))
    ends = (F.col("kind") == "end") & F.col("tag").isin("paragraph", "item", "table_row", "table_head", "code_block")
    piece = F.when(F.col("open_heading") > 0, F.lit("")).when(
        F.col("kind").isin("text", "code", "inline_math", "display_math"), xml_escape("text")
    ).when(F.col("kind").isin("soft_break", "hard_break"), F.lit(" ")).when(ends, F.lit("\n"))
    body = _joined(rows, id_col, piece, "slide").join(titles, [id_col, "slide"], "left")
    para = lambda t: F.concat(F.lit("<a:p><a:r><a:t>"), t, F.lit("</a:t></a:r></a:p>"))
    shape = lambda kind, content: F.concat(
        F.lit(
            (
                f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{kind}"/><p:cNvSpPr/><p:nvPr><p:ph '
                f'type="{kind}"/></p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/>'
            )
        ),
        content, F.lit("</p:txBody></p:sp>")
    )
    lines = F.filter(F.split("xml", "\n"), lambda x: F.trim(x) != "")
    a, p = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    slide = F.concat(
        F.lit(f'{_HEAD}<p:sld xmlns:a="{a}" xmlns:p="{p}"><p:cSld><p:spTree>'),
        F.when(F.col("title").isNotNull(), shape("title", para(xml_escape("title")))).otherwise(""),
        shape("body", F.array_join(F.transform(lines, para), "")), F.lit("</p:spTree></p:cSld></p:sld>")
    )
    # Numbers of equal width, so that the order of names is that of slides.
    name = F.concat(F.lit("ppt/slides/slide"), F.lpad(F.col("slide").cast("string"), 5, "0"), F.lit(".xml"))
    decks = body.select(id_col, "slide", _file(name, slide).alias("f")).groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slide", "f"))), lambda x: x["f"]).alias("f")
    )
    part = "application/vnd.openxmlformats-officedocument.presentationml"
    per_slide = lambda of: F.array_join(F.transform("f", of), "")
    number = lambda i: (i + 1).cast("string")
    types = F.concat(
        F.lit(
            (
                f'{_HEAD}<Types xmlns="{_TYPES}"><Default Extension="rels" '
                f'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" '
                f'ContentType="application/xml"/>'
            )
        ),
        F.lit(f'<Override PartName="/ppt/presentation.xml" ContentType="{part}.presentation.main+xml"/>'),
        per_slide(lambda x: F.concat(F.lit('<Override PartName="/'), x["name"], F.lit(f'" ContentType="{part}.slide+xml"/>'))),
        F.lit("</Types>"),
    )
    root = f'{_HEAD}<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="ppt/presentation.xml"/></Relationships>'
    target = lambda x: F.substring(x["name"], len("ppt/") + 1, 2**31 - 1)
    rels = F.concat(
        F.lit(f'{_HEAD}<Relationships xmlns="{_RELS}">'),
        per_slide(lambda x, i: F.concat(F.lit('<Relationship Id="s'), number(i), F.lit(f'" Type="{_OFFICE}/slide" Target="'), target(x), F.lit('"/>'))),
        F.lit("</Relationships>"),
    )
    deck = F.concat(
        F.lit(f'{_HEAD}<p:presentation xmlns:p="{p}" xmlns:r="{_OFFICE}"><p:sldIdLst>'),
        per_slide(lambda x, i: F.concat(F.lit('<p:sldId id="'), (i + 256).cast("string"), F.lit('" r:id="s'), number(i), F.lit('"/>'))),
        F.lit('</p:sldIdLst><p:sldSz cx="12192000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>'),
    )
    fixed = F.array(
        _file("[Content_Types].xml", types), _file("_rels/.rels", root), _file("ppt/presentation.xml", deck),
        _file("ppt/_rels/presentation.xml.rels", rels)
    )
    return decks.select(id_col, packed(F.concat(fixed, "f")).alias("content"))


FORMATS = {"docx": docx, "odt": odt, "epub": epub, "pptx": pptx}
