"""Looking at a folder again converts what has changed, and nothing else."""

import os
import time

import pytest
from pyspark.sql import functions as F

from docloom.streaming import watch


def texts(folder):
    return {p.relative_to(folder).as_posix(): p.read_text() for p in folder.rglob("*") if p.is_file()}


def test_only_changed_files_are_converted(spark, tmp_path):
    src, out, state = tmp_path / "src", tmp_path / "out", str(tmp_path / "state")
    (src / "sub dir").mkdir(parents=True)
    names = ["a", "b", "sub dir/c", "d.e"]
    for n in names:
        (src / f"{n}.md").write_text(f"# {n}")
        os.utime(src / f"{n}.md", (1_700_000_000, 1_700_000_000))
    (src / "other.txt").write_text("no")
    read = spark.sparkContext.accumulator(0)

    def upper(files):
        def count(batches):
            for b in batches:
                read.add(b.num_rows)
                yield b

        return files.mapInArrow(count, files.schema).select("path", F.upper(F.decode("content", "UTF-8")).alias("text"))

    look = lambda: watch.refresh(spark, str(src), str(out), state, upper)
    assert look() == (4, 0) and texts(out) == {f"{n}.html": f"# {n}".upper() for n in names}
    first = {p: p.stat().st_mtime_ns for p in out.rglob("*.html")}
    assert look() == (0, 0) and read.value == 4
    (src / "b.md").write_text("# new")
    assert look() == (1, 0) and read.value == 5
    assert texts(out)["b.html"] == "# NEW"
    assert {p for p, at in first.items() if p.stat().st_mtime_ns != at} == {out / "b.html"}
    # One goes, one comes with an old time, one has another size at the same time.
    (src / "a.md").unlink()
    (src / "z.md").write_text("# z")
    (src / "d.e.md").write_text("# longer")
    for n in ("z", "d.e"):
        os.utime(src / f"{n}.md", (1_700_000_000, 1_700_000_000))
    assert look() == (2, 1) and read.value == 7
    assert texts(out) == {"b.html": "# NEW", "sub dir/c.html": "# SUB DIR/C", "d.e.html": "# LONGER", "z.html": "# Z"}


def test_a_look_that_fails_is_done_again(spark, tmp_path):
    src, out, state = tmp_path / "src", tmp_path / "out", str(tmp_path / "state")
    src.mkdir()
    (src / "a.md").write_text("a")
    with pytest.raises(Exception, match="broken"):
        watch.refresh(spark, str(src), str(out), state, lambda f: f.select("path", F.raise_error(F.lit("broken")).cast("string").alias("text")))
    assert not list(out.rglob("*.html"))
    assert watch.refresh(spark, str(src), str(out), state) == (1, 0) and "<p>a</p>" in texts(out)["a.html"]
    # The table was moved away and nothing has taken its place.
    os.rename(state, state + ".old")
    assert watch.refresh(spark, str(src), str(out), state) == (0, 0)


def test_watching(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    (src / "a.md").write_text("*one*")
    query = watch.watch(spark, str(src), str(out), str(tmp_path / "state"), str(tmp_path / "ticks"), every="1 second")
    try:
        for text, want in (("*one*", "<em>one</em>"), ("*two*", "<em>two</em>")):
            (src / "a.md").write_text(text)
            until = time.time() + 60
            while not any(want in t for t in texts(out).values()) and time.time() < until:
                time.sleep(0.5)
            assert want in texts(out)["a.html"]
    finally:
        query.stop()
