"""Documents of many formats as (path, md): one row for each file.

Text formats are column expressions where they can be; packed formats are opened in Arrow batches, one
file at a time, with the standard library.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import cleanup_markdown
from docloom.html.markdown import html_to_markdown, html_to_markdown_text


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Merge records of CSV files with a header: all strings, trimmed; a ragged row is an error."""
    rows = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="FAILFAST")
    return rows.withColumn("record", F.create_map(*(x for c in rows.columns for x in (F.lit(c), F.coalesce(F.col(f"`{c}`"), F.lit(""))))))


#: Directives of slide decks.
_DIRECTIVES = "theme|style|headingDivider|size|math|title|author|description|keywords|url|image|marp|paginate|header|footer|class|backgroundColor|backgroundImage|backgroundPosition|backgroundRepeat|backgroundSize|color|transition"


def marp_to_markdown(text: Column) -> Column:
    """Slides without the leading settings and the directive comments; other comments stay."""
    body = F.regexp_replace(text, r"(?s)\A\s*---\s*\n.*?\n---[ \t]*(?:\n|\z)", "")
    return cleanup_markdown(F.regexp_replace(body, rf"(?s)<!--\s*_?(?:{_DIRECTIVES})\s*:.*?-->", ""))


#: What LaTeX markup becomes, in this order.
_LATEX = [
    (r"(?s)\A.*?\\begin\{document\}", ""), (r"(?s)\\end\{document\}.*\z", ""), (r"(?m)(?<!\\)%.*$", ""),
    (r"\\section\*?\{([^{}]*)\}", "\n\n# $1\n\n"), (r"\\subsection\*?\{([^{}]*)\}", "\n\n## $1\n\n"),
    (r"\\subsubsection\*?\{([^{}]*)\}", "\n\n### $1\n\n"), (r"\\paragraph\*?\{([^{}]*)\}", "\n\n#### $1\n\n"),
    (r"(?s)\\begin\{verbatim\}\n?(.*?)\\end\{verbatim\}", "\n\n```\n$1```\n\n"),
    (
        r"(?s)\\begin\{figure\}.*?\\includegraphics(?:\[[^\]]*\])?\{([^{}]*)\}.*?(?:\\caption\{([^{}]*)\}.*?)?\\end\{figure\}",
        "\n\n![$2]($1)\n\n"
    ),
    (r"\\textbf\{([^{}]*)\}", "**$1**"), (r"\\(?:textit|emph)\{([^{}]*)\}", "*$1*"), (r"\\texttt\{([^{}]*)\}", "`$1`"),
    (r"\\sout\{([^{}]*)\}", "~~$1~~"), (r"\\href\{([^{}]*)\}\{([^{}]*)\}", "[$2]($1)"), (r"\\url\{([^{}]*)\}", "<$1>"),
    (r"\\footnotemark\[([^\]]*)\]", "[^$1]"), (r"\\footnote\{([^{}]*)\}", "^[$1]"), (r"(?s)\\\[(.*?)\\\]", "\n\n\\$\\$$1\\$\\$\n\n"),
    (r"\\item\s*", "\n- "), (r"\\(?:begin|end)\{[^{}]*\}(?:\{[^{}]*\})?", "\n\n"), (r"\\(?:newpage|hrule|hline)\b", "\n\n---\n\n"),
    (r"\\\\", "  \n"), (r"\\textbackslash(?:\{\})?", "\\\\"), (r"\\([&%$#_{}])", "$1"),
]


def latex_to_markdown(text: Column) -> Column:
    for pattern, value in _LATEX:
        text = F.regexp_replace(text, pattern, value)
    return cleanup_markdown(text)


#: What Typst markup becomes.
_TYPST = [
    (r"(?m)^#(?:set|show|let|import)\b.*$", ""), (r"(?m)^(=+)\s+(.*)$", "$1 $2"), (r"(?m)^======\s", "###### "),
    (r"(?m)^=====\s", "##### "), (r"(?m)^====\s", "#### "), (r"(?m)^===\s", "### "), (r"(?m)^==\s", "## "), (r"(?m)^=\s", "# "),
    (r"(?<![*\w])\*([^*\n]+)\*(?!\*)", "**$1**"), (r"(?<!\w)_([^_\n]+)_(?!\w)", "*$1*"), (r"#strike\[([^\]]*)\]", "~~$1~~"),
    (r'#link\("([^"]*)"\)\[([^\]]*)\]', "[$2]($1)"), (r'#image\("([^"]*)"[^)]*\)', "![]($1)"), (r"#footnote\[([^\]]*)\]", "^[$1]"),
    (r"#(?:pagebreak\(\)|line\([^)]*\))", "\n\n---\n\n"), (r"(?m)^\+ ", "1. ")
]


def typst_to_markdown(text: Column) -> Column:
    for pattern, value in _TYPST:
        text = F.regexp_replace(text, pattern, value)
    return cleanup_markdown(text)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attr(node, name: str) -> str:
    return next((v for k, v in node.attrib.items() if _local(k) == name), "")


def pptx_text(data: bytes) -> str:
    """Slides in the order of their files' names: the title as a heading, other paragraphs one a line."""
    slides = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide[^/]*\.xml", n)):
            lines = []
            for shape in (x for x in ElementTree.fromstring(z.read(name)).iter() if _local(x.tag) == "sp"):
                is_title = any(_local(x.tag) == "ph" and _attr(x, "type") in ("title", "ctrTitle") for x in shape.iter())
                for p in (x for x in shape.iter() if _local(x.tag) == "p"):
                    text = "".join(x.text or "" for x in p.iter() if _local(x.tag) == "t").strip()
                    if text:
                        lines.append(f"# {text}\n" if is_title else text)
            slides.append("\n".join(lines))
    return "\n\n---\n\n".join(slides)


def epub_text(data: bytes) -> str:
    """Chapters in the order of the spine; items without a file are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(_attr(x, "full-path") for x in container.iter() if _local(x.tag) == "rootfile")
        package, base = ElementTree.fromstring(z.read(opf)), opf.rpartition("/")[0]
        files = {_attr(x, "id"): _attr(x, "href") for x in package.iter() if _local(x.tag) == "item"}
        chapters = []
        for ref in (x for x in package.iter() if _local(x.tag) == "itemref"):
            href = files.get(_attr(ref, "idref"))
            name = f"{base}/{href}" if base and href else href
            if name in names:
                chapters.append(html_to_markdown_text(z.read(name).decode("utf-8", "replace"), nested=True))
    return "\n\n---\n\n".join(c for c in chapters if c)


def docx_text(data: bytes) -> str:
    """Paragraphs with their headings, lists, runs, links, tables, footnotes and tracked changes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        rels = {
            _attr(x, "Id"): _attr(x, "Target") for x in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))
        } if "word/_rels/document.xml.rels" in names else {}
        body = next(x for x in ElementTree.fromstring(z.read("word/document.xml")) if _local(x.tag) == "body")
        notes = {}
        if "word/footnotes.xml" in names:
            for note in ElementTree.fromstring(z.read("word/footnotes.xml")):
                if _attr(note, "id") not in ("-1", "0", ""):
                    notes[_attr(note, "id")] = "".join(x.text or "" for x in note.iter() if _local(x.tag) == "t").strip()

    def on(props, name: str) -> bool:
        return any(_local(x.tag) == name and _attr(x, "val") not in ("0", "false", "none") for x in (props if props is not None else ()))

    def child(node, name: str):
        return next((x for x in node if _local(x.tag) == name), None)

    def inline(node) -> str:
        out = []
        for x in node:
            tag = _local(x.tag)
            if tag == "r":
                props, text = child(x, "rPr"), ""
                for t in x:
                    kind = _local(t.tag)
                    text += (t.text or "") if kind in ("t", "delText") else "\n" if kind == "br" else "\t" if kind == "tab" else f"[^{_attr(t, 'id')}]" if kind == "footnoteReference" else ""
                if text.strip():
                    for name, mark in (("strike", "~~"), ("i", "*"), ("b", "**")):
                        text = f"{mark}{text}{mark}" if on(props, name) else text
                out.append(text)
            elif tag in ("ins", "del"):
                out.append(f'<{tag} data-author="{_attr(x, "author")}" data-date="{_attr(x, "date")}">{inline(x)}</{tag}>')
            elif tag == "hyperlink":
                out.append(f"[{inline(x)}]({rels.get(_attr(x, 'id'), '#' + _attr(x, 'anchor'))})")
            elif tag in ("smartTag", "sdt", "sdtContent", "fldSimple"):
                out.append(inline(x))
        return "".join(out)

    def table(node) -> str:
        rows = [
            [
                "<br>".join(inline(p).strip() for p in cell if _local(p.tag) == "p") for cell in row if _local(cell.tag) == "tc"
            ] for row in node if _local(row.tag) == "tr"
        ]
        wide = max(map(len, rows), default=0)
        lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
        return "\n".join([*lines[:1], "|" + "---|" * wide, *lines[1:]]) if lines else ""

    blocks = []
    for x in body:
        if _local(x.tag) == "tbl":
            blocks.append(table(x))
        elif _local(x.tag) == "p":
            props, text = child(x, "pPr"), inline(x).strip()
            style = next((_attr(s, "val") for s in (props if props is not None else ()) if _local(s.tag) == "pStyle"), "")
            numbering = next((s for s in (props if props is not None else ()) if _local(s.tag) == "numPr"), None)
            if m := re.fullmatch(r"[Hh]eading\s*([1-6])", style):
                text = f"{'#' * int(m[1])} {text}"
            elif style == "Title":
                text = f"# {text}"
            elif numbering is not None:
                level = next((int(_attr(s, "val") or 0) for s in numbering if _local(s.tag) == "ilvl"), 0)
                ordered = any(_local(s.tag) == "numId" and _attr(s, "val") == "2" for s in numbering)
                text = "    " * level + ("1. " if ordered else "- ") + text
            elif style and style not in ("Normal", "BodyText", "ListParagraph"):
                text += f"\n\n{{.{style}}}" if text else ""
            if text.strip():
                blocks.append(text)
    blocks += [f"[^{k}]: {v}" for k, v in sorted(notes.items(), key=lambda kv: int(kv[0]))]
    return "\n\n".join(blocks)


def odt_text(data: bytes) -> str:
    """Headings, paragraphs, lists and tables of an OpenDocument text; style names give emphasis."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    marks = {}
    for style in (x for x in root.iter() if _local(x.tag) == "style"):
        for p in (x for x in style if _local(x.tag) == "text-properties"):
            marks[_attr(style, "name")] = ("**" if _attr(p, "font-weight") == "bold" else "") + ("*" if _attr(p, "font-style") == "italic" else "") + (
                "~~" if _attr(p, "text-line-through-style") not in ("", "none") else ""
            )

    def inline(node) -> str:
        out = node.text or ""
        for x in node:
            tag = _local(x.tag)
            if tag == "span":
                mark = marks.get(_attr(x, "style-name"), "")
                text = inline(x)
                out += f"{mark}{text}{mark[::-1]}" if text.strip() else text
            elif tag == "a":
                out += f"[{inline(x)}]({_attr(x, 'href')})"
            else:
                out += "  \n" if tag == "line-break" else " " * int(_attr(x, "c") or 1) if tag == "s" else "\t" if tag == "tab" else "" if tag in ("note", "tracked-changes") else inline(x)
            out += x.tail or ""
        return out

    def block(node, level: int = 0) -> list[str]:
        out = []
        for x in node:
            tag = _local(x.tag)
            if tag == "h":
                out.append(f"{'#' * int(_attr(x, 'outline-level') or 1)} {inline(x).strip()}")
            elif tag == "p" and inline(x).strip():
                out.append(inline(x).strip())
            elif tag == "list":
                for n, item in enumerate((i for i in x if _local(i.tag) == "list-item"), 1):
                    inner = block(item, level + 1)
                    sign = f"{n}. " if "umber" in _attr(x, "style-name") else "- "
                    out += ["    " * level + sign + inner[0], *inner[1:]] if inner else []
            elif tag == "table":
                rows = [[" ".join(block(c)) for c in r if _local(c.tag) == "table-cell"] for r in x.iter() if _local(r.tag) == "table-row"]
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                out.append("\n".join([*lines[:1], "|" + "---|" * len(rows[0]), *lines[1:]]) if rows else "")
            elif tag in ("section", "text", "body"):
                out += block(x, level)
        return out

    body = next((x for x in root.iter() if _local(x.tag) == "text" and len(x)), None)
    return "\n\n".join(b for b in block(body) if b) if body is not None else ""


#: Destinations of RTF that hold no text of the document.
_RTF_SKIPPED = frozenset(
    "fonttbl colortbl stylesheet info pict object header footer headerl headerr headerf footerl footerr footerf footnote themedata colorschememapping latentstyles datastore xmlnstbl listtable listoverridetable rsidtbl generator fldinst bkmkstart bkmkend".split()
)
_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


def rtf_text(data: bytes) -> str:
    """Paragraphs with bold and italic; headings by outline level or by large bold type; deleted text goes."""
    source = data.decode("latin-1")
    state = {"skip": False, "b": False, "i": False, "deleted": False, "fs": 24, "uc": 1, "level": None}
    stack, out, para, head, swallow = [], [], [], [None, 0, True], 0

    def text(s: str) -> None:
        nonlocal swallow
        if swallow and s:
            s, swallow = s[swallow:], max(0, swallow - len(s))
        if s and not state["skip"] and not state["deleted"]:
            para.append((s, state["b"], state["i"]))
            head[1], head[2] = max(head[1], state["fs"]), head[2] and (state["b"] or not s.strip())

    def paragraph() -> None:
        level = head[0]
        whole = "".join(s for s, _, _ in para).strip()
        if level is None and whole and head[2] and head[1] >= 30:
            level = 0 if head[1] >= 44 else 1 if head[1] >= 36 else 2
        if whole:
            if level is not None:
                out.append(f"{'#' * (level + 1)} {whole}")
            else:
                parts = []
                for s, b, i in para:
                    mark = "**" * b + "*" * i
                    if parts and parts[-1][0] == mark:
                        parts[-1][1] += s
                    else:
                        parts.append([mark, s])
                out.append("".join(f"{m}{s.strip()}{m}{' ' if s.endswith(' ') else ''}" if m and s.strip() else s for m, s in parts).strip())
        para.clear()
        head[:] = [None, 0, True]

    for m in _RTF.finditer(source):
        word, number, code, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append(dict(state))
        elif brace == "}":
            state = stack.pop() if stack else state
        elif plain:
            text(plain)
        elif code:
            text(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif sign:
            if sign == "*":
                state["skip"] = True
            else:
                text({"~": "\xa0", "_": "‑", "-": ""}.get(sign, sign))
        elif word:
            n = int(number) if number else None
            if word in _RTF_SKIPPED:
                state["skip"] = True
            elif word in ("b", "i", "deleted"):
                state[word] = n != 0
            elif word == "fs":
                state["fs"] = n or 24
            elif word == "plain":
                state.update(b=False, i=False, fs=24)
            elif word == "outlinelevel":
                head[0] = n if n is not None and n < 6 else None
            elif word == "uc":
                state["uc"] = n if n is not None else 1
            elif word == "u":
                text(chr((n or 0) % 65536))
                swallow = 0 if state["skip"] else state["uc"]
            elif word in ("par", "sect", "page"):
                paragraph()
            elif word in ("line", "tab"):
                text("\n" if word == "line" else "\t")
    paragraph()
    joined = "\n\n".join(out)
    return joined.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def pdf_info(data: bytes) -> dict[str, str]:
    """Title, author, subject and creator of a PDF's plain information dictionary."""
    out = {}
    for name in ("Title", "Author", "Subject", "Creator"):
        m = re.search(rb"/" + name.encode() + rb"\s*\(((?:[^()\\]|\\.)*)\)", data)
        raw = re.sub(rb"\\([()\\])", rb"\1", m[1]) if m else b""
        out[name.lower()] = raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")
    return out


BINARY = {"docx": docx_text, "odt": odt_text, "pptx": pptx_text, "epub": epub_text, "rtf": rtf_text}
TEXT = {
    "md": lambda c: c, "markdown": lambda c: c, "html": html_to_markdown, "htm": html_to_markdown,
    "xhtml": lambda c: html_to_markdown(c, nested=True), "tex": latex_to_markdown, "typ": typst_to_markdown, "marp": marp_to_markdown
}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, format, md) of all files of known formats below ``path``, by their extensions.

    A file that cannot be opened gives a null ``md``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.select(
        "path", F.col("modificationTime").alias("modified"), F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("format"),
        "content"
    )

    @F.udf("string", useArrow=True)
    def unpack(kind: str, content: bytes):
        try:
            return BINARY[kind](bytes(content))
        except (KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError, ValueError):
            return None

    packed = files.filter(F.col("format").isin(*BINARY)).withColumn("md", unpack("format", "content")).drop("content")
    texts = files.filter(F.col("format").isin(*TEXT)).withColumn("text", F.decode("content", "UTF-8"))
    out = packed
    for kind, convert in TEXT.items():
        out = out.unionByName(texts.filter(F.col("format") == kind).withColumn("md", convert(F.col("text"))).drop("content", "text"))
    return out


def latest_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the file that was modified last; of equal ones the last by name.

    Only that file, and others of just its time, are read.
    """
    files = spark.read.format("binaryFile").load(path)
    last = files.agg(F.max(F.struct("modificationTime", "path")).alias("last")).first()["last"]
    if last is None:
        return files.select("path", "content").limit(0)
    return files.filter((F.col("modificationTime") == F.lit(last["modificationTime"])) & (F.col("path") == last["path"])).select("path", "content")
