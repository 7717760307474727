"""Readers of files, and the stream of imports."""

import io
import json
import zipfile

from docloom.html.markdown import html_to_markdown_text
from docloom.md.parser import parse, top_level_blocks
from docloom.sources import documents
from docloom.streaming.imports import run_import


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_html():
    html = (
        "<html><head><title>t</title></head><body><h1>A</h1><p>x <b>b</b> <a href='u'>l</a><ul><li>1<ul><li>n</ul><li>2</ul><pre "
        "class='mermaid'>g</pre><span class='math'>x</span><table><tr><td>a<td>b</table></body>"
    )
    assert html_to_markdown_text(html, nested=True) == "# A\n\nx **b** [l](u)\n\n- 1\n    - n\n- 2\n\n```mermaid\ng\n```\n\n$x$\n\n| a | b |\n|---|---|"
    assert html_to_markdown_text(None) is None and html_to_markdown_text("") == ""


def test_rtf():
    of = lambda s: documents.rtf_text(s.encode("latin-1"))
    assert of("") == "" and of("{\\rtf1 plain\\par}") == "plain"
    assert of("{\\rtf1{\\fonttbl{\\f0 Times;}}a {\\b bold} {\\i it}\\par}") == "a **bold** *it*"
    assert of("{\\rtf1 caf\\'e9 \\u8364? {\\deleted gone}x\\par}") == "café € x"
    assert of("{\\rtf1\\outlinelevel1 Head\\par text\\par}") == "## Head\n\ntext"
    assert of("{\\rtf1{\\b\\fs44 Big}\\par}") == "# Big"


def test_packed_formats(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = packed(
        {
            "word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:ins w:author="me" w:date="d"><w:r><w:t>new</w:t></w:r></w:ins></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
        }
    )
    slide = lambda t: f'<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sp></p:sld>'
    pptx = packed({f"ppt/slides/slide{n}.xml": slide(n) for n in (2, 10, 1)})
    epub = packed(
        {
            "META-INF/container.xml": '<c><rootfile full-path="O/c.opf"/></c>',
            "O/c.opf": (
                '<p><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/><itemref idref="b"/><itemref idref="gone"/><itemref '
                'idref="a"/></p>'
            ),
            "O/a.xhtml": "<p>A</p>", "O/b.xhtml": "<p>B</p>"
        }
    )
    odt = packed({"content.xml": '<d xmlns:t="t" xmlns:o="o"><o:body><o:text><t:h t:outline-level="2">H</t:h><t:p>x</t:p></o:text></o:body></d>'})
    files = {
        "a.docx": docx, "b.pptx": pptx, "c.epub": epub, "d.odt": odt, "e.docx": b"broken", "f.md": b"# M", "g.html": b"<p>h",
        "h.tex": b"\\begin{document}\\section{S}\\textbf{b}\\end{document}",
        "i.marp": b"---\nmarp: true\n---\n# S\n<!-- paginate: true -->\n<!-- note -->", "j.typ": b"= T\n*b* _i_",
        "k.rtf": b"{\\rtf1 r\\par}"
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rpartition("/")[2]: r.md for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == '# T\n\n**bold**<ins data-author="me" data-date="d">new</ins>\n\n| a |\n|---|'
    assert got["b.pptx"].split() == ["#", "1", "---", "#", "10", "---", "#", "2"]
    assert got["c.epub"] == "B\n\n---\n\nA" and got["d.odt"] == "## H\n\nx" and got["e.docx"] is None
    assert got["f.md"] == "# M" and got["g.html"] == "h" and got["h.tex"] == "# S\n\n**b**" and got["k.rtf"] == "r"
    assert got["i.marp"] == "# S\n\n<!-- note -->" and got["j.typ"] == "# T\n**b** *i*"


def test_pdf_information():
    assert documents.pdf_info(b"<< /Title (A \\(b\\)) /Author (C) >>") == {"title": "A (b)", "author": "C", "subject": "", "creator": ""}


def test_records(spark, tmp_path):
    (tmp_path / "r.csv").write_text("name, city\n A , B \n,C\n")
    got = [r.record for r in documents.read_records(spark, str(tmp_path / "r.csv")).collect()]
    assert got == [{"name": "A", "city": "B"}, {"name": "", "city": "C"}]


def test_stream_of_imports(spark, tmp_path):
    drop, library, state = (tmp_path / n for n in ("drop", "lib", "state"))
    drop.mkdir()
    write = lambda name, *rows: (drop / name).write_text("\n".join(map(json.dumps, rows)))
    write("a.json", {"title": "One", "author": "A; B"}, {"title": "Two", "doi": "10.1/x"})
    run_import(spark, str(drop), str(library), str(state)).awaitTermination()
    write("b.json", {"title": "Two", "doi": "10.1/x"}, {"title": "Three"})
    run_import(spark, str(drop), str(library), str(state)).awaitTermination()
    rows = spark.read.parquet(str(library)).collect()
    assert sorted(r.title for r in rows) == ["One", "Three", "Two"]
    assert next(r.authors for r in rows if r.title == "One") == ["A", "B"]


def test_parser_nests_and_balances():
    import random

    random.seed(4)
    parts = [
        "# h", "- a\n  - b\n\n    c", "> q\n> - x", "| a |\n|---|\n| b |", "```\nx\n```", "*a **b* c**", "[x](y) ![z](w)", "1. a\n2. b",
        "~~s~~ $m$ [^1]", "[^1]: n", "<div>\nx\n</div>", "---", "a  \nb", "Set\n==="
    ]
    for _ in range(200):
        open_tags = []
        for e in parse("\n\n".join(random.choices(parts, k=6))):
            if e.kind == "start":
                assert e.depth == len(open_tags)
                open_tags.append(e.tag)
            elif e.kind == "end":
                assert open_tags.pop() == e.tag
        assert open_tags == []


def test_blocks_are_slices_of_the_source():
    text = "# A\n\npara\nmore\n\n- x\n\n- y\n\n```\na\n\nb\n```"
    assert top_level_blocks(text) == ["# A", "para\nmore", "- x\n\n- y", "```\na\n\nb\n```"]
