"""What parts of packages refer to, by joins over node rows."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.sinks import packed
from docloom.sources import packages

W = 'xmlns:w="w" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def package(**parts):
    out = io.BytesIO()
    names = {"document": packages.DOCUMENT, "rels": packages.RELATIONS, "comments": packages.COMMENTS, "notes": packages.NOTES}
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(names[name], xml)
    return out.getvalue()


def text(t):
    return f"<w:r><w:t>{t}</w:t></w:r>"


@pytest.mark.parametrize("cell", [1, 3, 1024])
def test_links_comments_and_notes(spark, monkeypatch, cell):
    monkeypatch.setattr(packages, "CELL", cell)
    start, end = (lambda i: f'<w:commentRangeStart w:id="{i}"/>'), (lambda i: f'<w:commentRangeEnd w:id="{i}"/>')
    body = (
        f"<w:p>{start(1)}{text('a')}{start(2)}{text('b')}{end(1)}{text('c')}{end(2)}{start(9)}{text('d')}{end(9)}</w:p>"
        f'<w:p><w:hyperlink r:id="x">{text("l")}{text("m")}</w:hyperlink><w:hyperlink r:id="none">{text("n")}</w:hyperlink><w:hyperlink r:id="x"/></w:p>'
        f'<w:p>{start(3)}{text("e")}<w:footnoteReference w:id="7"/><w:footnoteReference w:id="8"/>{text("f")}</w:p>{end(4)}'
    )
    comments = "".join(f'<w:comment w:id="{i}" w:author="{a}">{text(t)}</w:comment>' for i, a, t in ((1, "A", "one"), (2, "B", "old"), (2, "B", "new"), (3, "C", "open"), (4, "D", "unused")))
    full = package(
        document=f"<w:document {W}>{body}</w:document>", comments=f"<w:comments {W}>{comments}</w:comments>", notes=f'<w:f {W}><w:footnote w:id="7">{text("seven")}</w:footnote></w:f>',
        rels='<R><Relationship Id="x" Target="http://old"/><Relationship Id="x" Target="http://new"/></R>'
    )
    files = [("p", full), ("q", package(document="<w:document>broken", rels="<R/>")), ("r", b"no package"), ("s", None), ("t", package(document=f"<w:document {W}>{start(1)}{text('t')}</w:document>"))]
    nodes = packages.package_nodes(spark.createDataFrame(files, "path string, content binary"))
    assert {(r.path, r.part) for r in nodes.collect()} == {("p", n) for n in (packages.DOCUMENT, packages.RELATIONS, packages.COMMENTS, packages.NOTES)} | {("q", packages.RELATIONS), ("t", packages.DOCUMENT)}
    links = [(r.path, r.url, r.text) for r in packages.hyperlinks(nodes).orderBy("path", "pre").collect()]
    assert links == [("p", "http://new", "lm"), ("p", "none", "n"), ("p", "http://new", "")]
    found = [(r.comment_id, r.author, r.content, r.text) for r in packages.comments(nodes).orderBy("pre").collect()]
    assert found == [("1", "A", "one", "ab"), ("2", "B", "new", "bc"), ("3", "C", "open", "ef")]
    assert [(r.note_id, r.content) for r in packages.footnotes(nodes).orderBy("pre").collect()] == [("7", "seven"), ("8", None)]


def test_files_are_packed_by_hundreds(spark):
    """A batch of Arrow's has ten thousand files."""
    files = spark.range(2).select(packed.packed(F.array(F.struct(F.lit("a").alias("name"), F.col("id").cast("string").alias("content")))).alias("content"))
    told = files._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in told and "ArrowEvalPython" not in told
    assert [zipfile.ZipFile(io.BytesIO(r.content)).read("a") for r in files.collect()] == [b"0", b"1"]
