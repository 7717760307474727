"""Streams give what the same plan gives over a table, however the rows arrive."""

import json
import random

from pyspark.sql import functions as F

from docloom.operators import library
from docloom.streaming import saves, sync

EDIT = "doc string, at timestamp, n int, text string"


def rows_of(frame):
    return sorted(tuple(map(str, r)) for r in frame.collect())


def test_edits_at_the_gap_belong_together(spark):
    base = "2024-01-01 00:00:00"
    rows = [("a", base, 1, "x"), ("a", f"{base}.900", 2, "y"), ("a", "2024-01-01 00:00:01.801", 3, "z"), ("a", "2024-01-01 00:00:01.801", 4, "w"), ("b", base, 5, "v"), ("b", None, 6, "u")]
    frame = spark.createDataFrame(rows, "doc string, at string, n int, text string").withColumn("at", F.to_timestamp("at"))
    found = {(r.doc, r.n): (r.n_edits, r.text) for r in saves.bursts(frame, "doc", "at", "n").collect()}
    assert found == {("a", 2): (2, "y"), ("a", 4): (2, "w"), ("b", 5): (1, "v")}


def test_late_and_unordered_edits_are_saved_as_in_time(spark, tmp_path):
    random.seed(7)
    at = lambda ms: f"2024-01-01T00:{ms // 60000:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}Z"
    edits = [(f"d{random.randint(0, 3)}", random.randint(0, 60_000), n, f"t{n}") for n in range(300)]
    # Each arrives up to eight seconds late; the files are written as edits arrive.
    arrived = sorted(edits, key=lambda e: e[1] + random.randint(0, 8000))
    drop, saved, state = (str(tmp_path / n) for n in ("drop", "saved", "state"))
    (tmp_path / "drop").mkdir()

    def deliver(name, part):
        (tmp_path / "drop" / name).write_text("\n".join(json.dumps({"doc": d, "at": at(ms), "n": n, "text": t}) for d, ms, n, t in part))
        saves.run_saves(spark, drop, EDIT, saved, state, "doc", "at", "n").awaitTermination()

    for k in range(4):
        deliver(f"{k}.json", arrived[75 * k : 75 * k + 75])
    before = spark.read.parquet(saved).count()
    deliver("end.json", [("clock", 59 * 60_000, 0, "")])
    whole = spark.createDataFrame([(d, at(ms), n, t) for d, ms, n, t in edits], "doc string, at string, n int, text string")
    want = saves.bursts(whole.withColumn("at", F.to_timestamp("at")), "doc", "at", "n")
    assert rows_of(spark.read.parquet(saved).drop("batch")) == rows_of(want) and 0 < before < want.count()
    # Far behind the watermark: left out.
    deliver("late.json", [("d0", 10, 999, "too late")])
    assert spark.read.parquet(saved).count() == want.count()


def payload(rows, number):
    return [{"id": i, "date_modified": stamp, "title": title, "payload": number, "place": k} for k, (i, stamp, title) in enumerate(rows)]


def test_synced_library_is_that_of_the_merge_however_payloads_are_split(spark, tmp_path):
    random.seed(3)
    make = lambda name, n: [(f"r{k}", random.choice(["2024-01-01", "2024-01-02", "2024-01-03", None]), f"{name}{k}") for k in random.sample(range(40), n)]
    sides = [make("local", 25), make("first", 25), make("second", 25)]
    fields = "id string, date_modified string, title string"
    frames = [spark.createDataFrame(s, fields).fillna("") for s in sides]
    want = rows_of(library.last_writer_wins(library.last_writer_wins(frames[0], frames[1]), frames[2]))
    everything = [r for k, s in enumerate(sides) for r in payload(s, k)]
    schema = fields + ", payload long, place long"
    for split in range(3):
        random.shuffle(everything)
        drop, log, state = (str(tmp_path / f"{n}{split}") for n in ("drop", "log", "state"))
        (tmp_path / f"drop{split}").mkdir()
        # A new query takes over from the checkpoint for each part.
        for part in range(3):
            for file, lines in enumerate([everything[part::3][::2], everything[part::3][1::2]]):
                (tmp_path / f"drop{split}" / f"{part}-{file}.json").write_text("\n".join(map(json.dumps, lines)))
            rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(drop)
            sync.run_sync(rows, log, state).awaitTermination()
        got = sync.synced(spark, log).fillna("")
        assert rows_of(got.select("id", "date_modified", "title")) == want
        sync.compacted(spark, log, log + "-small")
        assert rows_of(sync.synced(spark, log + "-small").fillna("")) == rows_of(got)


def test_equal_stamps_stay_with_the_earliest(spark, tmp_path):
    rows = [("a", "2024", "remote", 1, 0), ("a", "2024", "local", 0, 5), ("b", "2024", "late", 2, 1), ("b", "2024", "early", 2, 0), ("c", None, "none", 0, 0), ("c", "1", "some", 1, 0)]
    frame = spark.createDataFrame(rows, "id string, date_modified string, title string, payload long, place long")
    assert {r.id: r.title for r in sync.winners(frame).collect()} == {"a": "local", "b": "early", "c": "some"}


def test_members_are_united_as_they_come(spark, tmp_path):
    drop, log, state = (tmp_path / n for n in ("drop", "log", "state"))
    drop.mkdir()
    for k, lines in enumerate([[("s", ["x", "y"])], [("s", ["y", "z"]), ("t", [])], [("s", ["z"]), ("t", ["x"])]]):
        (drop / f"{k}.json").write_text("\n".join(json.dumps({"id": i, "ref_ids": refs}) for i, refs in lines))
        rows = spark.readStream.schema("id string, ref_ids array<string>").json(str(drop))
        sync.run_members(rows, str(log), str(state)).awaitTermination()
    assert sorted((r.id, r.ref_id) for r in spark.read.parquet(str(log)).collect()) == [("s", "x"), ("s", "y"), ("s", "z"), ("t", "x")]
