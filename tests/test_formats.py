"""Formats by name: reading as the column functions do, writing all or nothing."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.operators import citations
from docloom.schemas import as_references
from docloom.sources import bibliography, formats

RIS = [
    "TY  - JOUR\r\nT1  - One\r\nAU  - A, B\nAU  - C\nSP  - 1\nEP  - 9\nPY  - 2001/02\nSN  - 1234-567X\nSN  - 9781234567890\nKW  - k\nER  - \n\nTY  - BOOK\nTI  - Two",
    "T1  - before\nTY  - XXX\nT1  -  spaced  \nT1  - last\nER  - end\nT1  - lost\nTY  - THES\nEP  - 9\nSP  - 3\nN1  - é \U0001f600\n", "", "no records\nTY  -", "TY  - RPRT",
]
BIB = [
    "@article{k,\n  title = {A {B} C},\n  author = {X, Y and Z},\n  pages = {1--9},\n year=2001,\n keywords = {a, b,, c}\n}\n@misc{n, note = {none}}\n@book{b,\r\n title = \"Q = R\",\r\n booktitle = {Z},\r\n journal={J}}",
    "text @ONLINE{x\ntitle = one,\ntitle = two\n", "", "@", "@@inproceedings {a,\n author = B\n}",
]


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    formats.register(spark)


def as_tuples(frame):
    return sorted((Path(r.id).name, *map(str, tuple(r)[1:])) for r in frame.collect())


@pytest.mark.parametrize(("fmt", "texts", "read"), [("ris", RIS, bibliography.read_ris), ("bib", BIB, bibliography.read_bibtex)])
def test_reads_as_the_column_functions_do(spark, tmp_path, monkeypatch, fmt, texts, read):
    random.seed(2)
    lines = [x for t in texts for x in t.splitlines(keepends=True)]
    texts = texts + ["".join(random.choices(lines, k=25)) for _ in range(20)]
    (tmp_path / "sub").mkdir()
    names = [f"{'sub/' if k % 2 else ''}{k}.{fmt.upper() if k == 3 else fmt}" for k in range(len(texts))]
    for name, text in zip(names, texts, strict=True):
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "other.txt").write_text("TY  - JOUR\n@article{t,\n title = {x}}")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / f"h.{fmt}").write_text("TY  - JOUR\n@article{t,\n title = {x}}")
    found = spark.read.format(fmt).load(str(tmp_path))
    want = read(spark.createDataFrame(list(zip(names, texts, strict=True)), "file string, text string"))
    assert found.schema.names == want.schema.names and as_tuples(found) == as_tuples(want)
    one = spark.read.format(fmt).load(f"file://{tmp_path}/{names[0]}")
    assert [r[1:] for r in as_tuples(one)] == [r[1:] for r in as_tuples(want) if r[0].startswith(f"0.{fmt}#")]
    with pytest.raises(Exception, match="missing"):
        spark.read.format(fmt).load(str(tmp_path / "missing")).collect()
    # Files are dealt by their sizes.
    monkeypatch.setattr(formats, "PARTITION", 200)
    parts = formats.ReferenceReader(str(tmp_path), f".{fmt}", None).partitions()
    assert len(parts) > 3 and sorted(p for x in parts for p in x.paths) == sorted(str(tmp_path / n) for n in names)


def test_round_trip_by_name(spark, tmp_path):
    rows = [(f"r{k}", f"Title {k}", [f"Doe, J{k}", "Roe, A"], str(2000 + k), f"10.1/{k}") for k in range(30)]
    refs = as_references(spark.createDataFrame(rows, "id string, title string, authors array<string>, year string, doi string"))
    for fmt in ("ris", "bib"):
        to = str(tmp_path / fmt)
        formats.write_references(refs.withColumn("name", F.concat(F.lit("part/"), F.substring("id", 2, 1))), fmt, to, mode="overwrite")
        files = sorted(p.relative_to(to).as_posix() for p in Path(to).rglob("*") if p.is_file() and not p.name.startswith("."))
        assert files == [f"part/{k}.{fmt}" for k in range(10)]
        back = spark.read.format(fmt).load(to)
        assert sorted((r.title, r.authors, r.year, r.doi) for r in back.collect()) == sorted((t, a, y, d) for _, t, a, y, d in rows)


def files_in(path):
    return {p.relative_to(path).as_posix(): p.read_text() for p in Path(path).rglob("*") if p.is_file()}


def test_one_file_a_document_replacing_and_overwriting(spark, tmp_path):
    to = str(tmp_path / "out")
    docs = lambda *rows: spark.createDataFrame(list(rows), "name string, text string")
    docs(("a", "1"), ("b/c", "2"), ("é", None)).write.format("files").option("extension", "md").mode("append").save(to)
    assert files_in(to) == {"a.md": "1", "b/c.md": "2", "é.md": ""}
    docs(("a", "new"), ("d", "4")).write.format("files").option("extension", "md").mode("append").save(to)
    assert files_in(to) == {"a.md": "new", "b/c.md": "2", "d.md": "4", "é.md": ""}
    docs(("x", "only")).write.format("files").mode("overwrite").save(to)
    assert files_in(to) == {"x": "only"}
    with pytest.raises(Exception, match="written only"):
        spark.read.format("files").load(to).collect()
    for bad in ("../up", "/root", "", None):
        with pytest.raises(Exception, match="no name"):
            docs((bad, "t")).write.format("files").mode("append").save(to)
    with pytest.raises(Exception, match="two tasks"):
        docs(("y", "1"), ("y", "2")).repartitionByRange(2, "text").write.format("files").mode("append").save(to)
    assert "y" not in files_in(to)


def test_a_task_that_fails_midway_leaves_no_file(spark, tmp_path):
    to = str(tmp_path / "out")
    spark.createDataFrame([("kept", "1")], "name string, text string").write.format("files").mode("append").save(to)
    rows = spark.range(400).repartition(4).select(
        F.col("id").cast("string").alias("name"), F.when(F.col("id") == 390, F.raise_error(F.lit("broken"))).otherwise("text").alias("text")
    )
    with pytest.raises(Exception, match="broken"):
        rows.write.format("files").mode("overwrite").save(to)
    assert files_in(to) == {"kept": "1"}
    assert citations.ris() is not None
