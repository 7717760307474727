"""Text formats from event rows: a table of rules gives each event its piece, pieces are joined in order.

A rule is a pair for the start and the end of an element, or one piece for a single event; ``{}`` is the
event's text, escaped for the format, and ``{name}`` one of its attributes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

Rules = dict[str, tuple[str, str] | str]

_HTML_STYLE = "body{max-width:48em;margin:auto;font-family:serif}table{border-collapse:collapse}td{border:1px solid #999;padding:.2em .5em}"

HTML: Rules = {
    "paragraph": ("<p>", "</p>\n"), "blockquote": ("<blockquote>\n", "</blockquote>\n"), "item": ("<li>", "</li>\n"),
    "code_block": ("<pre><code>", "</code></pre>\n"),
    "table": ("<table>\n", "</table>\n"), "table_head": ("<tr>", "</tr>\n"), "table_row": ("<tr>", "</tr>\n"), "table_cell": ("<td>", "</td>"),
    "emphasis": ("<em>", "</em>"), "strong": ("<strong>", "</strong>"), "strikethrough": ("<del>", "</del>"),
    "subscript": ("<sub>", "</sub>"), "superscript": ("<sup>", "</sup>"),
    "link": ('<a href="{dest}">', "</a>"), "image": ('<img src="{dest}" alt="', '" />'),
    "footnote": ('<div class="footnote" id="fn-{label}">', "</div>\n"), "html_block": ("", ""),
    "text": "{}", "code": "<code>{}</code>", "html": "{raw}", "inline_html": "{raw}", "inline_math": '<span class="math inline">{}</span>',
    "display_math": '<div class="math display">{}</div>',
    "soft_break": "<br />\n", "hard_break": "<br />\n", "rule": '<div class="page-break"></div>\n',
    "page_break": '<div class="page-break"></div>\n', "footnote_ref": '<sup><a href="#fn-{}">{}</a></sup>',
}
LATEX: Rules = {
    "paragraph": ("", "\n\n"), "blockquote": ("\\begin{quote}\n", "\\end{quote}\n"), "item": ("\\item ", "\n"),
    "code_block": ("\\begin{verbatim}\n", "\\end{verbatim}\n"),
    "table": ("\\begin{longtable}{{columns}}\n", "\\end{longtable}\n"), "table_head": ("", " \\\\ \\hline\n"), "table_row": ("", " \\\\\n"),
    "table_cell": ("", " & "),
    "emphasis": ("\\textit{", "}"), "strong": ("\\textbf{", "}"), "strikethrough": ("\\sout{", "}"), "subscript": ("\\textsubscript{", "}"),
    "superscript": ("\\textsuperscript{", "}"),
    "link": ("\\href{{dest}}{", "}"), "image": ("\\begin{figure}\\includegraphics{{dest}}\\caption{", "}\\end{figure}"),
    "footnote": ("\\footnotetext{", "}\n"), "html_block": ("", ""),
    "text": "{}", "code": "\\texttt{{}}", "html": "", "inline_html": "", "inline_math": "${raw}$", "display_math": "\\[{raw}\\]",
    "soft_break": "\n", "hard_break": "\\\\\n", "rule": "\\newpage\n", "page_break": "\\newpage\n", "footnote_ref": "\\footnotemark[{}]",
}
MARKDOWN: Rules = {
    "paragraph": ("", "\n\n"), "blockquote": ("> ", "\n"), "code_block": ("```{info}\n", "```\n\n"), "table": ("", "\n"),
    "table_head": ("|", "\n{rule}\n"), "table_row": ("|", "\n"), "table_cell": (" ", " |"),
    "emphasis": ("*", "*"), "strong": ("**", "**"), "strikethrough": ("~~", "~~"), "subscript": ("~", "~"), "superscript": ("^", "^"),
    "link": ("[", "]({dest})"), "image": ("![", "]({dest})"),
    "footnote": ("[^{label}]: ", "\n"), "html_block": ("", "\n"), "text": "{}", "code": "`{raw}`", "html": "{raw}", "inline_html": "{raw}",
    "inline_math": "${raw}$", "display_math": "$${raw}$$",
    "soft_break": "\n", "hard_break": "  \n", "rule": "\n---\n\n", "page_break": "\n---\n\n", "footnote_ref": "[^{}]", "task": "[{}] ",
}
TYPST: Rules = {
    "paragraph": ("", "\n\n"), "blockquote": ("#quote[", "]\n\n"), "code_block": ("```{info}\n", "```\n\n"),
    "table": ("#table(columns: {n_columns},\n", ")\n\n"), "table_head": ("", "\n"), "table_row": ("", "\n"), "table_cell": ("[", "], "),
    "emphasis": ("_", "_"), "strong": ("*", "*"), "strikethrough": ("#strike[", "]"), "subscript": ("#sub[", "]"),
    "superscript": ("#super[", "]"), "link": ('#link("{dest}")[', "]"), "image": ('#figure(image("{dest}"), caption: [', "])"),
    "footnote": ("#footnote[", "]\n"), "html_block": ("", ""), "text": "{}", "code": "`{raw}`", "html": "", "inline_html": "",
    "inline_math": "${raw}$", "display_math": "$ {raw} $",
    "soft_break": "\n", "hard_break": " \\\n", "rule": "#line(length: 100%)\n\n", "page_break": "#pagebreak()\n\n", "footnote_ref": "#super[{}]",
}
RTF: Rules = {
    "paragraph": ("{\\pard ", "\\par}\n"), "blockquote": ("{\\pard\\li720 ", "\\par}\n"), "code_block": ("{\\pard\\f1 ", "\\par}\n"),
    "table": ("", ""), "table_head": ("\\trowd ", "\\row\n"), "table_row": ("\\trowd ", "\\row\n"), "table_cell": ("\\intbl ", "\\cell "),
    "emphasis": ("{\\i ", "}"), "strong": ("{\\b ", "}"), "strikethrough": ("{\\strike ", "}"), "subscript": ("{\\sub ", "}"),
    "superscript": ("{\\super ", "}"),
    "link": ('{\\field{\\*\\fldinst HYPERLINK "{dest}"}{\\fldrslt ', "}}"), "image": ("{\\i ", "}"), "footnote": ("", ""),
    "html_block": ("", ""), "text": "{}", "code": "{\\f1 {}}", "html": "", "inline_html": "", "inline_math": "{\\i {}}",
    "display_math": "{\\i {}}",
    "soft_break": " ", "hard_break": "\\line ", "rule": "\\page\n", "page_break": "\\page\n", "footnote_ref": "{\\super {}}",
}

_SECTIONS = ("section", "subsection", "subsubsection", "paragraph", "subparagraph", "subparagraph")


def _heading(fmt: str) -> tuple[Column, Column]:
    level = F.col("attrs")["level"]
    own = F.col("attrs")["id"]
    if fmt in ("html", "xhtml"):
        return F.concat(
            F.lit("<h"), level, F.when(own.isNotNull(), F.concat(F.lit(' id="'), own, F.lit('"'))).otherwise(F.lit("")), F.lit(">")
        ), F.concat(F.lit("</h"), level, F.lit(">\n"))
    if fmt == "latex":
        name = F.element_at(F.array(*map(F.lit, _SECTIONS)), level.cast("int"))
        return F.concat(F.lit("\\"), name, F.lit("{")), F.lit("}\n\n")
    if fmt == "typst":
        return F.concat(F.repeat(F.lit("="), level.cast("int")), F.lit(" ")), F.lit("\n\n")
    if fmt == "rtf":
        size = F.element_at(F.array(*(F.lit(x) for x in ("44", "36", "30", "28", "26", "24"))), level.cast("int"))
        return F.concat(F.lit("{\\pard\\outlinelevel"), (level.cast("int") - 1).cast("string"), F.lit("\\b\\fs"), size, F.lit(" ")), F.lit("\\par}\n")
    return F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" ")), F.lit("\n\n")


def _list(fmt: str) -> tuple[Column, Column]:
    ordered = F.col("attrs")["ordered"] == "true"
    pick = lambda yes, no: F.when(ordered, F.lit(yes)).otherwise(F.lit(no))
    if fmt in ("html", "xhtml"):
        return pick("<ol>\n", "<ul>\n"), pick("</ol>\n", "</ul>\n")
    if fmt == "latex":
        return pick("\\begin{enumerate}\n", "\\begin{itemize}\n"), pick("\\end{enumerate}\n", "\\end{itemize}\n")
    return F.lit(""), F.lit("\n")


def _item(fmt: str) -> tuple[Column, Column]:
    """Pieces without the number and the indent, which ``render`` knows."""
    pick = lambda yes, no: F.when(F.col("attrs")["ordered"] == "true", F.lit(yes)).otherwise(F.lit(no))
    if fmt == "typst":
        return pick("+ ", "- "), F.lit("\n")
    if fmt == "rtf":
        return pick("{\\pard\\li720 ", "{\\pard\\li720\\bullet "), F.lit("\\par}\n")
    return pick("", "- "), F.lit("\n")


FORMATS = {
    "html": (HTML, T.xml_escape), "xhtml": (HTML, T.xml_escape), "latex": (LATEX, T.latex_escape), "marp": (MARKDOWN, lambda c: c),
    "markdown": (MARKDOWN, lambda c: c), "typst": (TYPST, T.typst_escape), "rtf": (RTF, T.rtf_escape)
}

#: What stands before and behind a document.
FRAMES = {
    "html": (f'<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<style>{_HTML_STYLE}</style>\n</head>\n<body>\n', "</body>\n</html>\n"),
    "xhtml": (
        (
            f'<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml">\n<head>\n<meta '
            f'charset="utf-8" />\n<style>{_HTML_STYLE}</style>\n</head>\n<body>\n'
        ),
        "</body>\n</html>\n"
    ),
    "latex": (
        "\\documentclass{article}\n\\usepackage[utf8]{inputenc}\n\\usepackage{hyperref,longtable,graphicx,ulem,amsmath}\n\\begin{document}\n\n",
        "\\end{document}\n"
    ),
    "marp": ("---\nmarp: true\n---\n\n", ""),
    "markdown": ("", ""),
    "typst": ("#set page(paper: \"a4\")\n#set text(size: 11pt)\n\n", ""),
    "rtf": ("{\\rtf1\\ansi\\deff0{\\fonttbl{\\f0 Times New Roman;}{\\f1 Courier New;}}\n", "}\n"),
}


def _piece(template: str, escape, raw: Column) -> Column:
    """A rule's text with its fields filled in."""
    parts = re.split(r"(\{\}|\{raw\}|\{dest\}|\{label\}|\{info\}|\{columns\}|\{n_columns\})", template)
    align = F.split(F.coalesce(F.col("attrs")["align"], F.lit("")), ",")
    fields = {
        "{}": lambda: escape(raw),
        "{raw}": lambda: raw,
        "{dest}": lambda: escape(F.col("attrs")["dest"]),
        "{label}": lambda: F.col("attrs")["label"],
        "{info}": lambda: F.col("attrs")["info"],
        "{columns}": lambda: F.array_join(
            F.transform(align, lambda a: F.when(a == "right", F.lit("r")).when(a == "center", F.lit("c")).otherwise(F.lit("l"))), ""
        ),
        "{n_columns}": lambda: F.size(align).cast("string"),
    }
    return F.concat(*(F.coalesce(fields[p](), F.lit("")) if p in fields else F.lit(p) for p in parts if p)) if template else F.lit("")


#: Rows that running counts look at; a number in the row says which it is. An item that has a number is ``numbered``, a heading that opens a slide ``slide``.
_MARKS = {
    m: k for k, m in enumerate(
        ("text", "list", "/list", "item", "numbered", "code_block", "/code_block", "table_head", "/table_head", "table_cell", "heading", "slide", "link", "/link", "image", "/image"), 1
    )
}
#: Partitions for each core that documents' pieces are dealt into: a task holds a small part of them, however large the tables are.
PARTS = 16


def _marked() -> Column:
    tag, attrs = F.col("tag"), F.col("attrs")
    of = F.when(F.col("kind") == "text", F.lit("text")).when(F.col("kind") == "end", F.concat(F.lit("/"), tag)).when(F.col("kind") == "start", tag)
    begins = F.col("kind") == "start"
    of = F.when(begins & (tag == "item") & (attrs["ordered"] == "true"), "numbered").when(begins & (tag == "heading") & attrs["level"].isin("1", "2"), "slide").otherwise(of)
    numbers = F.create_map(*(F.lit(x) for kv in _MARKS.items() for x in kv))
    return F.coalesce(F.try_element_at(numbers, of), F.lit(0)).cast("byte")


def render(events: DataFrame, fmt: str, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, text) of every document in a format of ``FORMATS``.

    An event becomes its piece first, so that only short rows are dealt and sorted. Numbers of items, depths of lists and widths of tables
    are running counts over a document's rows, put into their pieces then; a document's pieces are one task's work, as its text is.
    """
    rules, escape = FORMATS[fmt]
    starts = lambda tag: (F.col("kind") == "start") & (F.col("tag") == tag)
    ends = lambda tag: (F.col("kind") == "end") & (F.col("tag") == tag)
    raw = F.coalesce("text", F.lit(""))
    # Text in code stands as it is in some formats: there it's escaped when that is known.
    late = fmt in ("latex", "typst")
    piece = F.when(F.col("kind") == "text", raw if late else escape(raw))
    dynamic = {"heading": _heading(fmt), "list": _list(fmt)} | ({"item": _item(fmt)} if "item" not in rules or fmt in ("typst", "rtf") else {})
    for tag, (a, b) in dynamic.items():
        piece = piece.when(starts(tag), a).when(ends(tag), b)
    for name, rule in rules.items():
        if name == "text" or name in dynamic:
            continue
        if isinstance(rule, tuple):
            # Other fields of a closing piece are not its own event's; they are put in below.
            end = F.lit(rule[1]) if "{dest}" in rule[1] or "{rule}" in rule[1] else _piece(rule[1], escape, raw)
            piece = piece.when(starts(name), _piece(rule[0], escape, raw)).when(ends(name), end)
        else:
            piece = piece.when(F.col("kind") == name, _piece(rule, escape, raw))
    # The one other string of an event that may be asked for: a list's first number, an address.
    more = F.when(starts("list"), F.try_element_at("attrs", F.lit("start"))).when(starts("link") | starts("image"), F.col("attrs")["dest"])
    spark = events.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS * spark.sparkContext.defaultParallelism)
    rows = events.select(id_col, "seq", _marked().alias("mark"), F.coalesce(piece, F.lit("")).alias("p"), more.alias("more")).repartition(parts, id_col)

    w = Window.partitionBy(id_col).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = lambda *marks: F.col("mark").isin(*(_MARKS[m] for m in marks))
    count = lambda *marks: F.sum(F.when(at(*marks), 1).otherwise(0)).over(w)
    open_ = lambda tag: F.sum(F.when(at(tag), 1).when(at(f"/{tag}"), -1).otherwise(0)).over(w)
    p = F.col("p")
    if late:
        rows = rows.withColumn("in_code", open_("code_block") > 0).withColumn("p", F.when(at("text") & ~F.col("in_code"), escape(p)).otherwise(p))
    if fmt in ("marp", "markdown"):
        cells = rows.withColumn("cells", count("table_cell"))
        n_cells = F.col("cells") - F.coalesce(F.last(F.when(at("table_head"), F.col("cells")), ignorenulls=True).over(w), F.lit(0))
        filled = F.when(at("/table_head"), F.replace(p, F.lit("{rule}"), F.concat(F.lit("|"), F.repeat(F.lit("---|"), n_cells.cast("int")))))
        for tag in ("link", "image"):
            dest = F.last(F.when(at(tag), F.col("more")), ignorenulls=True).over(w)
            filled = filled.when(at(f"/{tag}"), F.replace(p, F.lit("{dest}"), F.coalesce(dest, F.lit(""))))
        slide = F.when(at("slide") & (count("heading", "slide") > 1), F.lit("---\n\n")).otherwise(F.lit("")) if fmt == "marp" else F.lit("")
        rows = cells.withColumn("p", F.concat(slide, filled.otherwise(p))).drop("cells")
    if fmt in ("marp", "markdown", "rtf"):
        rows = rows.select(id_col, "seq", "mark", "p", F.when(at("list"), F.col("more")).alias("more"), open_("list").cast("int").alias("list_depth"))
        # An item's number counts the items of its list: those at its depth since that list began.
        deep = Window.partitionBy(id_col, "list_depth").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("items", F.sum(F.when(at("item", "numbered"), 1).otherwise(0)).over(deep))
        began = F.last(F.when(at("list"), F.struct("items", F.col("more").try_cast("int").alias("first"))), ignorenulls=True).over(deep)
        number = F.col("items") - F.coalesce(began["items"], F.lit(0)) + F.coalesce(began["first"], F.lit(1)) - 1
        mark = F.when(at("numbered"), F.concat(p, number.cast("string"), F.lit(". "))).otherwise(p)
        if fmt != "rtf":
            inner = F.col("list_depth") > 1
            indent = F.concat(F.when(inner, F.lit("\n")).otherwise(F.lit("")), F.repeat(F.lit("  "), F.greatest(F.col("list_depth") - 1, F.lit(0))))
            mark = F.when(at("item", "numbered"), F.concat(indent, mark)).otherwise(p)
        rows = rows.withColumn("p", mark)
    before, behind = FRAMES[fmt]
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "p"))), lambda x: x["p"]), "")
    return rows.groupBy(id_col).agg(F.concat(F.lit(before), body, F.lit(behind)).alias("text"))


def write_text(df: DataFrame, path: str, text_col: str = "text") -> None:
    """Texts as they are, one file for each partition."""
    df.select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)
