"""Automata by composed maps, and pages as Markdown."""

import random

import pytest

from docloom.operators import layout, scans


@pytest.mark.parametrize("part", [1, 3, 1024])
def test_states_before_each_row(spark, monkeypatch, part):
    monkeypatch.setattr(scans, "PART", part)
    random.seed(part)
    rows, want = [], {}
    for key in range(5):
        start = state = random.randint(0, 3)
        for place in range(random.choice([1, 7, 20])):
            step = [random.randint(0, 3) for _ in range(4)]
            rows.append((key, place, step, start))
            want[key, place] = state
            state = step[state]
    frame = spark.createDataFrame(rows, "k int, place long, step array<int>, start int")
    assert {(r.k, r.place): r.state for r in scans.states_before(frame, ["k"], "place", "step", 4, "start").collect()} == want


SPAN = "doc_id int, page int, span_no int, y double, x double, width double, text string, bold boolean, italic boolean, font_size double, font_name string"
RECT = "doc_id int, page int, llx double, lly double, urx double, ury double"


def spans_of(spark, *lines):
    """A document of lines (page, y, x, width, text, bold, italic)."""
    return spark.createDataFrame([(1, p, k, float(y), float(x), float(w), t, b, i, 10.0, "Arial") for k, (p, y, x, w, t, b, i) in enumerate(lines)], SPAN)


def test_blocks_open_and_close_over_pages(spark):
    spans = spans_of(
        spark, (0, 700, 0, 400, "first line of text here,", False, False), (0, 688, 0, 400, "which goes on.", False, False), (0, 640, 150, 100, "in the middle,", False, False),
        (0, 628, 150, 40, "still there.", False, False), (1, 700, 40, 360, "indented text,", False, False), (1, 688, 40, 360, "more of it", False, False),
        (1, 600, 0, 400, "• an item", False, False), (1, 588, 10, 390, "goes on", False, False), (2, 700, 0, 400, " ", False, False), (2, 600, 0, 400, "the end.", False, False)
    )
    rects = spark.createDataFrame([(1, 2, 0.0, 650.0, 390.0, 651.0), (1, 1, 0.0, 610.5, 390.0, 611.0)], RECT)
    (row,) = layout.pages_to_markdown(spans, rects).collect()
    head, _, body = row.md.partition("0.65em\n---\n\n")
    assert head.startswith('---\npage:\n  font_size: 10.0pt\n  font_family: "Arial"')
    assert body == (
        'first line of text here, which goes on.\n\n<div align="center">\n\nin the middle,  \nstill there.\n\n</div>\n\n'
        '<div style="margin-left: 40pt">\n\nindented text, more of it\n\n</div>\n\n---\n\n- an item goes on\n\nthe end.'
    )
    assert layout.pages_to_markdown(spans.limit(0), rects.limit(0)).collect() == []


def test_marks_stay_nested(spark):
    random.seed(6)
    words = [(0, 100 * (k // 8), 60 * (k % 8), 20, f"w{k}", random.random() < 0.5, random.random() < 0.6) for k in range(80)]
    spans = spans_of(spark, *words)
    rects = spark.createDataFrame([(1, 0, float(x), float(y) - 1, x + 20.0, y + 0.0) for _, y, x, *_ in words if random.random() < 0.5], RECT)
    frames = layout.page_frames(spans)
    marked = layout.ruled(spans, rects, frames)
    flags = {r.span_no: (r.underline, r.bold, r.italic) for r in marked.collect()}
    lines = layout.geometry.cluster_lines(marked, "doc_id").selectExpr("*", "10d AS body")
    for nested in (False, True):
        for row in layout.inline(lines, nested=nested).collect():
            open_marks = []
            for token in row.inline.replace("<", " <").replace(">", "> ").split():
                if token.startswith("</"):
                    assert open_marks.pop() == token[2:-1]
                elif token.startswith("<"):
                    open_marks.append(token[1:-1])
                else:
                    assert tuple(m in open_marks for m in "ubi") == flags[int(token[1:])]
            assert not open_marks


def test_spans_are_made_once(spark):
    """What spans are made of may be costly, a sort of a large table; they are read several times."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    row = "1L doc_id, 0 page, id span_no, 72d x, 700 - 14d * id y, 100d width, 10d font_size, 'Arial' font_name, 'words' text, false bold, false italic"
    spans = spark.range(3).selectExpr(*row.split(", "))
    spans = spans.mapInArrow(counted, spans.schema)
    rects = spark.createDataFrame([], "doc_id long, page int, llx double, lly double, urx double, ury double")
    assert layout.pages_to_markdown(spans, rects).count() == 1
    assert made.value == 3


def test_spans_are_moved_once(spark, monkeypatch):
    """What moves spans takes disk: they are packed to pages, and pages become text, with one exchange of each; documents' settings are small."""
    made = {}

    def moves(df, *small):
        text = df._jdf.queryExecution().executedPlan().toString().split("\n")
        return sum("Exchange hashpartitioning" in line for line in text)

    def kept(df, name, by=None, make=layout.storage.materialise):
        made[name] = moves(df)
        return make(df, name, by)

    monkeypatch.setattr(layout.storage, "materialise", kept)
    spans = spans_of(spark, *((p, 700 - 14 * k, 0, 400, f"line {k}", False, False) for p in range(3) for k in range(4)))
    rects = spark.createDataFrame([(1, 0, 0.0, 650.0, 390.0, 651.0)], RECT)
    result = layout.pages_to_markdown(spans, rects)
    assert made.pop("pages") == 1 and moves(result) == 1 and set(made) == {"settings"}
    dealt = spans.repartition("doc_id"), rects.repartition("doc_id")
    assert moves(layout.packed(*dealt)) == 2  # those two themselves: pages are grouped where they are


def test_packed_pages_say_what_rows_say(spark):
    random.seed(8)
    nan, rows, boxes = float("nan"), [], []
    for page in range(40):
        for k in range(random.choice([1, 5, 60])):
            x, y, w = random.choice([0.0, 50.0, 300.0]), random.choice([700.0 - 14 * (k // 3), 700.0 - 3 * k, None, nan]), random.choice([40.0, 200.0, None])
            rows.append((1, page, k, y, x, w, random.choice(["words", " ", "a  b", None]), random.random() < 0.3, random.choice([True, False, None]), random.choice([10.0, 10.0, 16.0, 4.0]), "Arial"))
            if None not in (y, w) and random.random() < 0.6:
                boxes.append((1, page, x, y + random.choice([-1.0, 4.0, 40.0]), x + w, y))
        boxes.append((1, page, 0.0, random.choice([nan, 690.0, None]), 90.0, 1.0))
    spans, rects = spark.createDataFrame(rows, SPAN), spark.createDataFrame(boxes, RECT)
    marked = layout.ruled(spans, rects, layout.page_frames(spans))
    want, got = {}, {}
    for r in layout.inline(layout.geometry.cluster_lines(marked).selectExpr("*", "10d AS body")).filter("inline <> ''").orderBy("page", "line").collect():
        want.setdefault(r.page, []).append(r.inline)
    for r in layout.page_lines(layout.packed(spans, rects).selectExpr("*", "0d AS page_left", "10d AS body")).filter("size(shown) > 0").collect():
        got[r.page] = [x.inline for x in r.shown]
    assert got == want and len(want) > 25 and all(any(m in t for page in want.values() for t in page) for m in ("<u>", "<s>", "<b>"))


def test_rules_above_a_pages_first_line(spark):
    spans = spans_of(spark, (0, 700, 0, 400, "high on the page,", False, False), (0, 650, 0, 400, "and lower.", False, False), (1, 300, 0, 400, "below that", False, False))
    rects = spark.createDataFrame([(1, 1, 0.0, y, 390.0, y + 1) for y in (320.0, 500.0, 660.0, 305.0)] + [(1, 0, 0.0, 750.0, 390.0, 751.0)], RECT)
    (row,) = layout.pages_to_markdown(spans, rects).collect()
    assert row.md.endswith("---\n\nhigh on the page,\n\nand lower.\n\n---\n\n---\n\nbelow that")


def test_shuffle_files_go_with_the_table_they_made(spark):
    """Else they stay until the driver's memory is cleaned: all shuffles of a job together."""
    from docloom import storage

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    was, before = spark.conf.get(storage._FREED, None), files()
    with storage.freed(spark):
        table = storage.materialise(spark.range(1000).repartition(3, "id"), "dealt")
    assert not files() - before and spark.conf.get(storage._FREED, None) == was and table.count() == 1000
    spans = spans_of(spark, (0, 700, 0, 400, "words", False, False)).repartition("doc_id")
    before = files()
    layout.pages_to_markdown(spans, spark.createDataFrame([], RECT))
    assert not files() - before
