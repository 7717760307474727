"""Operators on small tables."""

import io
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from docloom.html.markdown import html_to_markdown
from docloom.operators import citations, compare, events, extras, geometry, graph, library
from docloom.schemas import as_references
from docloom.sinks import text as sinks
from docloom.sources import bibliography, diagrams


@pytest.fixture(scope="module")
def refs(spark):
    rows = [
        ("r1", "Journal Article", "On X", ["Doe, Jane A.", "John Roe"], "Nature", "2001", "3", "2", "1-9", "10.1/A", ["t"], True),
        ("r2", "Book", "Über Y", ["Plato"], "", "", "", "", "", "", [], False),
        ("r3", "Thesis", "On Z", [], "Acta", "1999", "7", "", "", "10.1/a ", ["u", "v"], False),
        ("r4", "Patent", "zeta", [f"First{k} Last{k}" for k in range(9)], "J", "2020", "", "4", "5", "10.2/b", [], True),
    ]
    fields = (
        "id string, reference_type string, title string, authors array<string>, journal string, year string, volume string, issue "
        "string, pages string, doi string, tags array<string>, starred boolean"
    )
    return as_references(spark.createDataFrame(rows, fields))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_search_and_filters(refs, spark):
    assert ids(library.search(refs, "JANE")) == ["r1"]
    assert ids(library.search(refs, "")) == ["r1", "r2", "r3", "r4"]
    assert ids(library.starred(refs)) == ["r1", "r4"]
    assert ids(library.of_type(refs, "Book")) == ["r2"]
    sets = spark.createDataFrame([("c", "C", ["r1", "r3", "gone"])], "id string, name string, ref_ids array<string>")
    assert ids(library.in_collection(refs, sets, "c")) == ["r1", "r3"]
    assert ids(library.in_collection(refs, sets, "no")) == []
    assert ids(library.pick_source(refs, "Roeon")) == ["r1"]


def test_sorting(refs):
    assert [r.id for r in library.sort_refs(refs, "title").collect()] == ["r1", "r3", "r2", "r4"]
    assert [r.id for r in library.csl_sort(refs, [("year", False)]).collect()] == ["r2", "r3", "r1", "r4"]
    assert [r.id for r in library.csl_sort(refs, [("year", True)]).collect()] == ["r4", "r1", "r3", "r2"]


def test_dedup_keeps_the_first_and_all_without_key(refs):
    assert ids(library.dedup_first_seen(refs, F.col("doi"), F.col("id"))) == ["r1", "r2", "r4"]


def test_last_writer_wins(spark):
    a = spark.createDataFrame([("1", "2024-01-01", "a"), ("2", "2024-01-02", "a"), ("3", "2024-01-01", "a")], "id string, date_modified string, v string")
    b = spark.createDataFrame([("1", "2024-01-01", "b"), ("2", "2024-01-03", "b"), ("4", "2024-01-01", "b")], "id string, date_modified string, v string")
    assert {r.id: r.v for r in library.last_writer_wins(a, b).collect()} == {"1": "a", "2": "b", "3": "a", "4": "b"}
    assert {r.id: r.v for r in library.last_writer_wins(a, a).collect()} == {"1": "a", "2": "a", "3": "a"}


def test_library_hash_ignores_order(refs):
    one = library.library_hash(refs).first()
    assert one == library.library_hash(refs.orderBy(F.col("id").desc())).first()
    assert one.library_hash != library.library_hash(refs.filter("id <> 'r1'")).first().library_hash


def test_library_hash_covers_collections(refs, spark):
    one = spark.createDataFrame([("c", "mine", ["r1"]), ("d", "other", [])], "id string, name string, ref_ids array<string>")
    found = library.library_hash(refs, one).first()
    assert found == library.library_hash(refs, one.orderBy(F.col("id").desc()).select("ref_ids", "name", "id")).first()
    assert found.n == refs.count() and found.library_hash != library.library_hash(refs).first().library_hash
    assert found.library_hash != library.library_hash(refs, one.withColumn("ref_ids", F.array(F.lit("r2")))).first().library_hash


def test_lines_sorted_by_numbers(spark):
    row = spark.createDataFrame([("10 b\n9 a\nx\n\n-1.5 c\n9 0\na",)], "t string")
    assert row.select(extras.sorted_lines(F.col("t"), numbers=True)).first()[0] == "-1.5 c\n9 0\n9 a\n10 b\na\nx"
    assert row.select(extras.sorted_lines(F.col("t"))).first()[0] == "-1.5 c\n10 b\n9 0\n9 a\na\nx"


def test_citation_numbers_have_gaps(refs, spark):
    cites = spark.createDataFrame([(1, "r3", 1), (1, "none", 2), (1, "r1", 3), (1, "r3", 4)], "doc_id int, ref_id string, seq int")
    assert sorted((r.number, r.ref_id) for r in library.resolve_citations(cites, refs).collect()) == [(1, "r3"), (3, "r1")]


def test_styles(refs):
    got = {s: {r.id: r.citation for r in citations.cite(refs, s).collect()} for s in citations.STYLES}
    assert got["apa"]["r1"] == "Doe, J. A., & Roe, J. (2001).  On X.  *Nature*, *3*(2), 1-9. https://doi.org/10.1/A"
    assert got["apa"]["r2"] == "Plato,  (n.d.).  Über Y."
    assert got["apa"]["r4"].startswith("Last0, F., Last1, F., Last2, F., Last3, F., Last4, F., Last5, F., ... Last8, F. (2020).")
    assert got["mla"]["r1"] == 'Doe, Jane A., et al.. "On X" *Nature*, vol. 3, no. 2, 2001, pp. 1-9, doi:10.1/A.'
    assert got["chicago"]["r1"] == 'Doe, Jane A., and John Roe 2001 "On X" *Nature* 3 (2): 1-9. https://doi.org/10.1/A'
    assert got["vancouver"]["r1"] == "Doe JA, Roe J. On X. Nature. 2001;3(2):1-9."
    assert got["ieee"]["r1"] == 'J. A. Doe and J. Roe, "On X", *Nature*, vol. 3, no. 2, pp. 1-9, 2001, doi: 10.1/A'
    with pytest.raises(ValueError, match="unknown citation style"):
        citations.cite(refs, "x")


def test_ris_and_bibtex_come_back(refs):
    ris = bibliography.read_ris(refs.select(F.col("id").alias("file"), citations.ris().alias("text")))
    back = {r.id[:2]: r for r in ris.collect()}
    assert back["r1"].authors == ["Doe, Jane A.", "John Roe"] and back["r1"].doi == "10.1/A" and back["r1"].tags == ["t"]
    assert back["r4"].reference_type == "Journal Article"
    bib = bibliography.read_bibtex(refs.select(F.col("id").alias("file"), citations.bibtex().alias("text")))
    back = {r.id[:2]: r for r in bib.collect()}
    assert back["r1"].pages == "1-9" and back["r1"].title == "On X" and back["r3"].authors == []


def test_ris_records(spark):
    text = "AU  - lost\nTY  - BOOK\nT1  - A\nEP  - 9\nSP  - 1\nSN  - 1234567890\nER  - \nTY  - X\nAU  - B\nKW  - k1\nKW  - k2\nPY  - 2001/02"
    r = bibliography.read_ris(spark.createDataFrame([("f", text)], "file string, text string")).orderBy("id").collect()
    assert [(x.reference_type, x.title, x.pages, x.isbn, x.authors, x.tags, x.year) for x in r] == [
        ("Book", "A", "1-9", "1234567890", [], [], ""), ("Journal Article", "", "", "", ["B"], ["k1", "k2"], "2001")
    ]


def md(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, md string")


def test_structure_metrics(spark):
    text = (
        "# A\n\n## B\n\n- x\n- [ ] y\n\n1. z\n\n```\n# not\n```\n\n| a |\n|---|\n| 1 |\n\n> q **b** *i* ~~s~~ [l](u) ![i](u) $m$ $$d$$ "
        "[^1] <ins>n</ins>\n\n[^1]: note\n"
    )
    r = events.structure_metrics(md(spark, text)).first()
    got = {k: r[k] for k in events.METRICS}
    want = {
        "headings": 2, "unordered_items": 2, "ordered_items": 1, "code_blocks": 1, "table_rows": 2, "tables": 1, "blockquotes": 1,
        "bold": 1, "italic": 1, "strikethrough": 1, "hyperlinks": 1, "images": 1, "inline_math": 1, "math_blocks": 1, "footnotes": 2,
        "tasklists": 1, "insertions": 1, "deletions": 0, "comments": 0, "highlights": 0
    }
    assert got == want


def test_similarities(spark):
    pairs = spark.createDataFrame([(0, "# a\n\n# b\n\n# c", "# a"), (1, "x", "x")], "doc_id long, a string, b string")
    r = {x.doc_id: x for x in compare.compare_documents(pairs).collect()}
    assert r[0].structural_similarity == pytest.approx(0.975) and r[1].roundtrip_similarity == pytest.approx(1.0) and r[1].status == "ok"


def test_jaro_winkler(spark):
    rows = spark.createDataFrame([("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), ("", ""), ("a", "")], "a string, b string")
    got = [r.s for r in rows.select(compare.jaro_winkler(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == pytest.approx([0.9611, 0.8133, 1.0, 0.0], abs=1e-4)


def test_edit_scripts_rebuild_both_sides():
    import random

    random.seed(2)
    for _ in range(300):
        a, b = ([random.choice("abc") for _ in range(random.randint(0, 9))] for _ in range(2))
        script = compare.edit_script(a, b)
        assert [a[i] for op, i, _ in script if op != "insert"] == a
        assert [b[j] for op, _, j in script if op != "delete"] == b
        assert all(a[i] == b[j] for op, i, j in script if op == "equal")


def test_what_is_in_common_is_as_long_as_can_be():
    import random

    random.seed(3)
    for _ in range(2000):
        a, b = ([random.randrange(random.choice([1, 2, 4, 12])) for _ in range(random.randint(0, 12))] for _ in range(2))
        most = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                most[i + 1][j + 1] = most[i][j] + 1 if x == y else max(most[i][j + 1], most[i + 1][j])
        found = compare.in_common(a, b)
        assert len(found) == most[-1][-1] and all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))


def test_long_sequences_take_little_memory():
    import random
    import tracemalloc

    random.seed(4)
    repeated = [[random.randrange(30) for _ in range(1200)] for _ in range(2)]
    moved = random.sample(range(10_000), 10_000)
    for a, b in ((list(range(10_000)), list(range(10_000, 20_000))), (list(range(10_000)), moved), repeated):
        tracemalloc.start()
        compare.in_common(a, b)
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
        tracemalloc.stop()


def test_diff_of_rows_is_that_of_the_script(spark):
    import random

    random.seed(5)
    docs = {k: tuple([random.choice("abcdefgh") for _ in range(random.randint(0, 9))] for _ in range(2)) for k in range(40)}
    frames = [spark.createDataFrame([(k, 3 * i, t) for k, d in docs.items() for i, t in enumerate(d[side])], "doc_id int, pos int, block string") for side in (0, 1)]
    found = {k: [] for k in docs}
    for r in compare.diff_rows(*frames).orderBy("doc_id", "pos").collect():
        assert r.pos == len(found[r.doc_id])
        found[r.doc_id].append(r)
    for k, (a, b) in docs.items():
        assert [r.old_text for r in found[k] if r.old_text is not None] == a and [r.new_text for r in found[k] if r.new_text is not None] == b
        assert sum(r.op == "equal" for r in found[k]) == len(compare.in_common(a, b))
        gap = []
        for r in [*found[k], None]:
            if r is None or r.op == "equal":
                kinds = {op: gap.count(op) for op in gap}
                assert set(kinds) <= {"replace"} or set(kinds) <= {"delete", "insert"} and kinds.get("delete") != kinds.get("insert") and gap == sorted(gap)
                gap = []
            else:
                gap.append(r.op)


def test_block_diff(spark):
    pairs = spark.createDataFrame([(0, "one two\n\nsame\n\ngone", "one 2\n\nsame")], "doc_id long, old string, new string")
    rows = compare.block_diff(pairs).orderBy("pos").collect()
    assert [(r.op, r.old_text, r.new_text) for r in rows] == [("replace", "one two", "one 2"), ("equal", "same", "same"), ("delete", "gone", None)]
    html = compare.diff_html(pairs).first().html
    assert "<del>two</del><ins>2</ins>" in html and '<div class="diff-del">gone</div>' in html


def test_texts_are_compared_by_hundreds(spark):
    """A batch of Arrow's has ten thousand texts."""
    texts = spark.createDataFrame([(0, "a b\n\nc", "a d")], "doc_id long, old string, new string")
    blocks = events.top_level_blocks(texts, text_col="old")
    words = texts.select(compare.word_diff(F.col("old"), F.col("new")).alias("t"))
    for df in (blocks, words):
        assert "BatchEvalPython" in plan(df) and "ArrowEvalPython" not in plan(df)
    assert [r.block for r in blocks.orderBy("pos").collect()] == ["a b", "c"]
    assert words.first().t == "a <del>b\n\nc</del><ins>d</ins>"


def test_outline_contents_chapters_slides(spark):
    e = events.parse_markdown(md(spark, "intro\n\n# A *b*\n\n## C\n\n---\n\n# \n\ntext"))
    assert [(r.level, r.label) for r in events.outline(e).orderBy("seq").collect()] == [(1, "A b"), (2, "C"), (1, "")]
    assert [r.html for r in events.table_of_contents(e).orderBy("seq").collect()] == ["<ul><li>A b</li>", "<ul><li>C</li>", "</ul><li></li>"]
    assert [(r.chapter, r.title) for r in events.chapters(e).orderBy("chapter").collect()] == [(1, "Content"), (2, "A b"), (3, "Chapter 3")]
    assert [r.title for r in events.slides(e).orderBy("slide").collect()] == ["", "A b", "C", ""]


def test_attributes_go_to_the_block_before(spark):
    e = events.attach_attributes(events.parse_markdown(md(spark, "# T\n\n{.a #b}\n\ntext")))
    rows = e.orderBy("seq").collect()
    assert [(r.tag, r.classes, r.attr_id) for r in rows if r.attr_id] == [("heading", ["a"], "b")]
    assert [r.text for r in rows if r.kind == "text"] == ["T", "text"]


def test_mail_merge_and_assembly(spark):
    e = events.parse_markdown(md(spark, "# Hi {{n}} {#h}\n\n[x](http://{{n}}) `{{n}}` [y](#h)"))
    records = spark.createDataFrame([(1, {"n": "A"}), (2, {"n": "{{n}}"})], "record_id int, record map<string,string>")
    merged = events.mail_merge(e, records)
    assert sorted(
        (r.record_id, r.text) for r in merged.filter(
            "kind in ('text', 'code') and text <> ' '"
        ).collect() if "Hi" in r.text or r.kind == "code"
    ) == [(1, "Hi A"), (1, "{{n}}"), (2, "Hi {{n}}"), (2, "{{n}}")]
    book = events.assemble(merged, "record_id", F.concat(F.lit("merge-"), F.col("record_id").cast("string")))
    assert book.filter("kind = 'page_break'").count() == 1
    assert sorted(
        r.d for r in book.filter("kind = 'start' and tag = 'link'").select(F.col("attrs")["dest"].alias("d")).collect()
    ) == ["#merge-1-h", "#merge-2-h", "http://A", "http://{{n}}"]


@pytest.mark.parametrize("fmt", list(sinks.FORMATS))
def test_every_format_has_every_text(spark, fmt):
    text = "# T\n\np **b** *i*\n\n- x\n- y\n\n1. one\n2. two\n\n> q\n\n| a | b |\n|---|--:|\n| 1 | 2 |\n\n```\ncode\n```\n"
    out = sinks.render(events.parse_markdown(md(spark, text)), fmt).first().text
    at = -1
    for word in ("T", "p ", "b", "i", "x", "y", "one", "two", "q", "a", "1", "2", "code"):
        at = out.index(word, at + 1)
    wanted = {
        "html": "<ol>\n<li>one</li>", "xhtml": '<h1>T</h1>', "latex": "\\section{T}", "marp": "1. one\n2. two", "markdown": "- x\n- y",
        "typst": "= T", "rtf": "{\\b b}"
    }
    assert wanted[fmt] in out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("fmt", ["markdown", "marp", "rtf"])
def test_pieces_are_dealt_as_short_rows(spark, fmt):
    """A task's memory: two sorts at most of rows without attributes, of documents dealt into many parts."""
    text = "3. a\n   - b\n     7. c\n     8. d\n4. e\n\n> 1. f\n\n- g\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n| z |\n|---|\n| [l ![i](u)](v) |\n"
    out = sinks.render(events.parse_markdown(md(spark, text)), fmt)
    told = plan(out)
    assert told.count("Sort [") <= 2
    assert "attrs" not in told[: told.index("Exchange")]
    assert f", {16 * spark.sparkContext.defaultParallelism})" in told
    body = out.first().text
    marks = ["3. ", "7. ", "8. ", "4. ", "1. "]
    at = -1
    for mark in marks:
        at = body.index(mark, at + 1)
    if fmt != "rtf":
        assert "| x | y |\n|---|---|\n" in body and "| z |\n|---|\n" in body and "[l ![i](u)](v)" in body


def test_pages_go_to_python_by_hundreds(spark):
    """A batch of Arrow's has ten thousand pages."""
    pages = spark.createDataFrame([("<p>a <b>b</b></p>",), (None,)], "html string").select(html_to_markdown(F.col("html")).alias("md"))
    assert "BatchEvalPython" in plan(pages) and "ArrowEvalPython" not in plan(pages)
    assert [r.md for r in pages.collect()] == ["a **b**", None]


def test_markdown_comes_back(spark):
    text = "# T\n\np **b**\n\n- x\n- y\n"
    first = events.parse_markdown(md(spark, text))
    again = sinks.render(first, "markdown").withColumnRenamed("text", "md")
    second = events.parse_markdown(again)
    shape = lambda e: [(r.kind, r.tag, r.text) for r in e.orderBy("seq").collect()]
    assert shape(first) == shape(second)


def test_lines_are_anchored(spark):
    rows = [(1, 0, k, "w", float(k), y, 5.0, 10.0, "f", False) for k, y in enumerate((100.0, 96.0, 92.0, 50.0))]
    spans = spark.createDataFrame(
        rows,
        "doc_id int, page int, span_no int, text string, x double, y double, width double, font_size double, font_name string, bold boolean"
    )
    assert [r.line for r in geometry.cluster_lines(spans).orderBy("span_no").collect()] == [1, 1, 2, 3]


def test_overlaps_across_cells(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 250.0, 250.0)], "page int, no int, llx double, lly double, urx double, ury double")
    b = spark.createDataFrame([(1, 1, 90.0, 90.0, 260.0, 260.0), (1, 2, 250.0, 0.0, 300.0, 10.0), (2, 3, 0.0, 0.0, 9.0, 9.0)], a.schema)
    assert [r.no for r in geometry.overlap_join(a, b, ["page"]).select("b.no").collect()] == [1]


def test_overlaps_of_all_sizes(spark):
    import random

    random.seed(2)
    nan = float("nan")

    def boxes(n):
        out = [(1, n, 0.0, nan, 9.0, 9.0), (1, n + 1, None, 0.0, 9.0, 9.0), (1, n + 2, -float("inf"), 0.0, 9.0, 9.0)]
        for k in range(n):
            x, y, side = random.uniform(-3000, 3000), random.uniform(-3000, 3000), 10 ** random.uniform(0, 6.5)
            out.append((k % 2, k, x, y, x + side, y + side * random.random()))
        return out

    schema = "page int, no int, llx double, lly double, urx double, ury double"
    left, right = boxes(80), boxes(90)
    got = geometry.overlap_join(
        spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["page"]
    ).select("a.no", F.col("b.no").alias("other")).collect()
    want = [(a[1], b[1]) for a in left[3:] for b in right[3:] if a[0] == b[0] and a[2] < b[4] and a[4] > b[2] and a[3] < b[5] and a[5] > b[3]]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_lines_of_a_long_page(spark):
    import random

    random.seed(3)
    ys = [random.choice((None, *(random.randrange(4000) / 10 for _ in range(20)))) for _ in range(3000)]
    rows = [(1, 0, k, "w", y, y, 5.0, 10.0, "f", False) for k, y in enumerate(ys)]
    spans = spark.createDataFrame(
        rows,
        "doc_id int, page int, span_no int, text string, x double, y double, width double, font_size double, font_name string, bold boolean"
    )
    want, line, anchor = {None: 0}, 0, None
    for y in sorted({y for y in ys if y is not None}, reverse=True):
        if anchor is None or abs(y - anchor) > 5:
            line, anchor = line + 1, y
        want[y] = line
    assert all(r.line == want[r.y] for r in geometry.cluster_lines(spans).collect())


def test_merged_document_needs_records(spark):
    e = events.parse_markdown(md(spark, "# Hi {{n}}"))
    none = spark.createDataFrame([], "record_id int, record map<string,string>")
    with pytest.raises(ValueError, match="no records"):
        events.merged_document(e, none)


def test_style_file(spark):
    from docloom.operators import citations
    from docloom.plans.queries import STYLE

    layout, macros, keys = citations.read_style(STYLE)
    assert layout["suffix"] == "." and list(macros) == ["source"] and keys == [("year", True), ("title", False)]
    with pytest.raises(ValueError, match="without a citation"):
        citations.read_style(STYLE, "citation")


def test_unknown_ending(spark):
    from docloom.sources.bibliography import read_bibliography

    files = spark.createDataFrame([("a.txt", "x")], "file string, text string")
    with pytest.raises(Exception, match="no reader for a.txt"):
        read_bibliography(files).collect()


def test_cycles_and_ranks(spark):
    edges = spark.createDataFrame([("g", "A", "B", 1), ("g", "B", "C", 2), ("g", "C", "A", 3)], "graph_id string, src string, dst string, ord long")
    got = graph.remove_cycles(edges)
    assert sorted((r.src, r.dst) for r in got.collect()) == [("A", "B"), ("A", "C"), ("B", "C")]
    nodes = spark.createDataFrame([("g", n) for n in "ABC"], "graph_id string, id string")
    assert {r.id: r["rank"] for r in graph.assign_ranks(nodes, got).collect()} == {"A": 0, "B": 1, "C": 2}


def test_ranks_of_many_paths_and_long_ones(spark):
    """A lattice has more paths than could be listed; a chain goes beyond any fixed depth."""
    lattice = [("d", f"{k}{a}", f"{k + 1}{b}") for k in range(25) for a in "xy" for b in "xy"]
    chain = [("c", f"{k}", f"{k + 1}") for k in range(30)]
    edges = spark.createDataFrame(lattice + chain, "graph_id string, src string, dst string")
    nodes = spark.createDataFrame(sorted({(g, x) for g, a, b in lattice + chain for x in (a, b)}), "graph_id string, id string")
    found = {(r.graph_id, r.id): r["rank"] for r in graph.assign_ranks(nodes, edges).collect()}
    assert found == {(g, x): int(x.rstrip("xy")) for g, x in [(r.graph_id, r.id) for r in nodes.collect()]}
    with pytest.raises(Exception, match="cycle"):
        graph.assign_ranks(
            nodes.limit(0).union(spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "r")], nodes.schema)),
            spark.createDataFrame([("g", "r", "a"), ("g", "a", "b"), ("g", "b", "a")], edges.schema)
        ).collect()


def test_frames_of_any_depth(spark):
    members = spark.createDataFrame([("g", "s0", "a")], "graph_id string, subgraph string, id string")
    parents = spark.createDataFrame([("g", f"s{k}", f"s{k + 1}") for k in range(12)], "graph_id string, subgraph string, parent string")
    boxes = spark.createDataFrame([("g", "a", 0.0, 0.0, 10.0, 10.0)], "graph_id string, id string, x double, y double, width double, height double")
    got = {r.subgraph: (r.llx, r.ury) for r in graph.frames(members, parents, boxes).collect()}
    assert got == {f"s{k}": (-20.0 * (k + 1), 10 + 20.0 * (k + 1)) for k in range(13)}


def test_frames_hold_inner_frames(spark):
    members = spark.createDataFrame([("g", "in", "a"), ("g", "out", "b")], "graph_id string, subgraph string, id string")
    parents = spark.createDataFrame([("g", "in", "out"), ("g", "out", None)], "graph_id string, subgraph string, parent string")
    boxes = spark.createDataFrame(
        [("g", "a", 0.0, 0.0, 10.0, 10.0), ("g", "b", 100.0, 0.0, 10.0, 10.0)],
        "graph_id string, id string, x double, y double, width double, height double"
    )
    got = {r.subgraph: (r.llx, r.lly, r.urx, r.ury) for r in graph.frames(members, parents, boxes).collect()}
    assert got == {"in": (-20, -20, 30, 30), "out": (-40, -40, 130, 50)}


def test_flowcharts(spark):
    source = "graph TD\n  A[Start] -->|yes| B((End)) --> C\n  subgraph one\n    D{q} ==> A\n  end\n  %% comment\n  E -.-> B & C"
    mentions, edges, members = diagrams.flowchart(spark.createDataFrame([(1, source)], "graph_id int, source string"))
    nodes = {r.id: (r.label, r.shape) for r in graph.build_graph(mentions).collect()}
    assert nodes == {"A": ("Start", "rect"), "B": ("End", "circle"), "C": ("C", None), "D": ("q", "diamond"), "E": ("E", None)}
    assert sorted((r.src, r.dst, r.style, r.label) for r in edges.collect()) == [
        ("A", "B", "solid", "yes"), ("B", "C", "solid", None), ("D", "A", "thick", None), ("E", "B", "dotted", None),
        ("E", "C", "dotted", None)
    ]
    assert sorted((r.id, r.subgraph) for r in members.collect()) == [("A", "one"), ("D", "one")]


def test_other_diagrams(spark):
    of = lambda reader, source: reader(spark.createDataFrame([(1, source)], "chart_id int, source string")).orderBy("ord").collect()
    assert [(r.label, r.value) for r in of(diagrams.pie, 'pie title X\n "a" : 3\n "b" : 1.5')] == [("a", 3.0), ("b", 1.5)]
    assert [
        (r.src, r.dst, r.text, r.step) for r in of(diagrams.sequence, "sequenceDiagram\nA->>B: hi\nactivate B\nB-->>A: yo\ndeactivate B")
    ] == [("A", "B", "hi", 0), ("B", "", "", 1), ("B", "A", "yo", 0), ("B", "", "", -1)]
    assert [
        (r.section, r.task, r.start, r.length) for r in of(
            diagrams.gantt, "gantt\nsection S\na : done, 2024-01-01, 3d\nb : 2024-01-03, 2024-01-10"
        )
    ] == [("S", "a", 0, 3), ("S", "b", 2, 7)]
    assert [(r.src, r.dst, r.label) for r in of(diagrams.states, "stateDiagram-v2\n[*] --> A\nA --> B : go")] == [("[*]", "A", ""), ("A", "B", "go")]
    assert [(r.level, r.label) for r in of(diagrams.mindmap, "mindmap\nroot((R))\n  a\n    b")] == [(0, "R"), (1, "a"), (2, "b")]
    assert [(r.period, r.event) for r in of(diagrams.timeline, "timeline\n2001 : a : b\n: c")] == [("2001", "a"), ("2001", "b"), ("2001", "c")]
    assert [(r.task, r.score, r.actors) for r in of(diagrams.journey, "journey\nsection S\nWork: 3: Me, You")] == [("Work", 3, ["Me", "You"])]
    assert [(r.src, r.arrow, r.dst) for r in of(diagrams.relations, "classDiagram\nA <|-- B : is\nC --> D")] == [("A", "<|--", "B"), ("C", "-->", "D")]


def test_activations_pair_up(spark):
    rows = spark.createDataFrame([("p", 1, 1), ("p", 2, 1), ("p", 3, -1), ("p", 4, 0), ("p", 5, 1)], "k string, t int, step int")
    got = sorted((r.start, r.end, r.depth) for r in graph.activations(rows, ["k"], "t", "step").collect())
    assert got == [(1, 5, 1), (2, 3, 2), (5, 5, 2)]


def test_packed_formats_come_back(spark):
    from docloom.sinks import packed
    from docloom.sources.documents import BINARY

    text = "# T & U\n\np **b** *i*\n\n- x\n  - n\n- y\n\n1. one\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n# Next\n\nend\n"
    e = events.parse_markdown(md(spark, text))
    back = {}
    for name, write in packed.FORMATS.items():
        content = bytes(write(e).first().content)
        assert content == bytes(write(e).first().content)
        back[name] = BINARY[name](content)
        at = -1
        for word in ("T & U", "p ", "b", "x", "n", "y", "one", "a", "1", "Next", "end"):
            at = back[name].index(word, at + 1)
    assert "# T & U" in back["docx"] and "**b**" in back["docx"] and "    - n" in back["docx"] and "1. one" in back["docx"] and "| 1 | 2 |" in back["docx"]
    assert "# T & U" in back["odt"] and "*i*" in back["odt"] and "| a | b |" in back["odt"]
    assert back["epub"].count("---") >= 1 and "**b**" in back["epub"]
    assert back["pptx"].count("---") == 1 and "# Next" in back["pptx"]
    with zipfile.ZipFile(io.BytesIO(bytes(packed.FORMATS["pptx"](e).first().content))) as z:
        parts = {n: ElementTree.fromstring(z.read(n)) for n in z.namelist()}
    assert [x.get("Target") for x in parts["ppt/_rels/presentation.xml.rels"]] == ["slides/slide00001.xml", "slides/slide00002.xml"]
    assert {"[Content_Types].xml", "_rels/.rels", "ppt/presentation.xml"} <= set(parts)


def test_extras(spark):
    from docloom.operators import extras

    docs = spark.createDataFrame([(1, "Teh cat could of teh")], "doc_id int, text string")
    assert sorted(
        (r["at"], r.matched, r.correction) for r in extras.grammar_matches(docs).collect()
    ) == [(0, "Teh", "the"), (8, "could of", "could have"), (17, "teh", "the")]
    marked = md(spark, 'a <mark class="comment" data-id="1" data-author="me" data-content="why">b</mark> $x$ and $$y^2$$ 5$')
    found = extras.comments(marked)
    assert [tuple(r)[1:] for r in found.collect()] == [("1", "me", "why", "b")]
    stored = spark.createDataFrame([(0, "1"), (0, "2")], "doc_id long, comment_id string")
    assert [r.comment_id for r in extras.prune_comments(stored, found).collect()] == ["1"]
    assert [(r.number, r.display, r.latex) for r in extras.formulas(marked).orderBy("number").collect()] == [(1, False, "x"), (2, True, "y^2")]
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000000200000001008")
    sizes = spark.createDataFrame([(bytearray(png),), (bytearray(b"no"),)], "c binary").select(extras.png_size(F.col("c")).alias("s")).collect()
    assert [tuple(r.s) if r.s else None for r in sizes] == [(32, 16), None]
    extras.register_filter("no_rules", lambda e: e.filter("kind <> 'rule'"))
    assert extras.apply_filters(events.parse_markdown(md(spark, "a\n\n---\n")), "no_rules").filter("kind = 'rule'").count() == 0
    with pytest.raises(KeyError, match="unknown filter"):
        extras.apply_filters(marked, "none")


def brute_jaro_winkler(x, y):
    if x == y:
        return 1.0
    reach, left, taken = max(max(len(x), len(y)) // 2 - 1, 0), [], set()
    for i, c in enumerate(x):
        j = next((j for j in range(max(0, i - reach), min(len(y), i + reach + 1)) if y[j] == c and j not in taken), None)
        if j is not None:
            taken.add(j)
            left.append(c)
    if not left:
        return 0.0
    n, moved = len(left), sum(p != y[j] for p, j in zip(left, sorted(taken), strict=True)) // 2
    jaro = (n / len(x) + n / len(y) + (n - moved) / n) / 3
    prefix = next((k for k in range(4) if x[k : k + 1] != y[k : k + 1] or k >= len(x)), 4)
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def test_jaro_winkler_query_compares_whole_turns(spark, tmp_path):
    from random import Random

    from docloom.plans.queries import QUERIES

    draw = Random(1)
    turns = ["same opening " * 8 + "then one thing", "same opening " * 8 + "but quite another end, and a longer one", ""]
    turns += ["".join(draw.choices("abcde ", k=draw.randrange(1, 400))) for _ in range(40)]
    spark.createDataFrame([(1, k, t) for k, t in enumerate(turns)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.similarity for r in QUERIES["jaro_winkler"](spark, str(tmp_path)).collect()}
    assert got == {k: pytest.approx(brute_jaro_winkler(t, turns[k - 1] if k else ""), abs=2e-9) for k, t in enumerate(turns)}
    assert got[1] < 1


def test_long_chains_and_large_graphs_have_ranks(spark, monkeypatch):
    import random
    import time

    names = lambda rows: spark.createDataFrame(rows, "graph_id int, id string")
    ends = lambda rows: spark.createDataFrame(rows, "graph_id int, src string, dst string")
    chain = ends([(0, f"n{k}", f"n{k + 1}") for k in range(200)])
    began = time.time()
    ranks = graph.assign_ranks(names([(0, f"n{k}") for k in range(201)]), chain).collect()
    assert {r.id: r["rank"] for r in ranks} == {f"n{k}": k for k in range(201)} and time.time() - began < 10
    random.seed(8)
    edges = sorted({(g, str(a), str(b)) for g in range(3) for a in range(9) for b in range(a + 1, 9) if random.random() < 0.3})
    nodes = names([(g, str(k)) for g in range(4) for k in range(9)])
    found = [sorted(map(tuple, graph.assign_ranks(nodes, ends(edges)).collect()))]
    monkeypatch.setattr(graph, "GROUPED", 8)
    found.append(sorted(map(tuple, graph.assign_ranks(nodes, ends(edges)).collect())))
    assert found[0] == found[1] and len(found[0]) == 36
    monkeypatch.setattr(graph, "GROUPED", 100)
    with pytest.raises(Exception, match="cycle"):
        graph.assign_ranks(nodes, ends([(0, "0", "1"), (0, "1", "2"), (0, "2", "1")])).collect()


def test_edges_of_the_same_ends_are_turned_together(spark):
    rows = [(1, "a", "b", 0), (1, "b", "c", 1), (1, "c", "a", 2), (1, "c", "a", 3), (1, "a", "b", 4), (1, "b", "b", 5), (1, "a", "c", 6)]
    found = graph.remove_cycles(spark.createDataFrame(rows, "graph_id int, src string, dst string, ord long")).collect()
    assert sorted((r.src, r.dst, r.ord, r.reversed) for r in found) == [
        ("a", "b", 0, False), ("a", "b", 4, False), ("a", "c", 2, True), ("a", "c", 3, True), ("a", "c", 6, False), ("b", "c", 1, False)
    ]


def test_latest_file(spark, tmp_path):
    import os

    from docloom.sources.documents import latest_file

    for name, at in (("a", 100), ("b", 300), ("c", 300), ("d", 200)):
        (tmp_path / name).write_text(name)
        os.utime(tmp_path / name, (at, at))
    assert [bytes(r.content) for r in latest_file(spark, str(tmp_path)).collect()] == [b"c"]
