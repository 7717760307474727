"""The pipeline's stages, each against what its input says."""

import corpus_pipeline
from corpus_pipeline import COLUMNS, STAGES

from tests.llm.test_edges import nasty
from tests.llm.test_operators import kept_lines, near_components, pieces_of


def test_stages_follow_one_another(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    steps = dict(STAGES)
    assert list(steps) == ["language_id", "line_dedup", "near_dedup", "pack"]
    named = steps["language_id"](spark, docs, data)
    assert named.columns == list(COLUMNS) and named.count() == docs.count()
    lines = {r.doc_id: r for r in steps["line_dedup"](spark, named, data).collect()}
    want = kept_lines({r.doc_id: r.text for r in named.collect()})
    assert {k: r.text for k, r in lines.items()} == {k: "\n".join(v[0]) for k, v in want.items()}
    assert all(r.n_chars == len(r.text) for r in lines.values())
    cleaned = spark.createDataFrame(list(lines.values()), docs.schema)
    kept = {r.doc_id for r in steps["near_dedup"](spark, cleaned, data).collect()}
    _, component = near_components({k: r.text for k, r in lines.items()})
    assert kept == set(component.values())
    packed = steps["pack"](spark, cleaned.filter(cleaned.doc_id.isin(list(kept))), data).collect()
    by_doc, _ = pieces_of(packed)
    assert set(by_doc) == kept


def test_stages_take_nasty_rows(spark, data):
    docs = nasty(spark)
    for name, stage in STAGES:
        out = stage(spark, docs, data)
        assert out.count() >= 0
        if name != "pack":
            assert out.columns == list(COLUMNS)
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["11", "12", "5", "5", "7", "9", "None"]


def test_stages_take_empty_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in STAGES:
        assert stage(spark, docs, data).count() == 0


def test_run_gives_the_last_stage(spark, data):
    assert set(corpus_pipeline.run(spark, data).columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_language_stage_keeps_unlabelled_documents(spark, data):
    rows = [(k, t) for k, t in enumerate(["some words", "mots", None, "", "1 2 3 !!", "日本", "more words"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "string(null) lang", "'s' source", "1L n_chars")
    want = [k for k, t in rows if t and any(c.isalpha() for c in t)]
    stage = dict(STAGES)["language_id"]
    assert sorted(r.doc_id for r in stage(spark, docs, data).collect()) == want
    assert sorted(r.doc_id for r in stage(spark, docs.selectExpr("doc_id", "text", "'und' lang", "source", "n_chars"), data).collect()) == want
