"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm.queries import vocabulary

LONG = "lorem ipsum dolor sit amet " * 8000
TEXTS = [None, "", " ", "\n\n", "a", "a b c d e f", "a b c d e f", LONG, LONG, "x" * 50_000, "1 2 3 !!", "é 日本 🙂 ☃", "A\tb\r\nC\x0bd"]
#: Names that the operators use inside.
CLASH = [
    "c", "n", "k", "h1", "h2", "key", "range", "place", "ghost", "row", "shard", "slot", "size", "turn", "value", "band", "component",
    "text_hash", "sketch", "ids", "part", "lang_pred", "score", "n_lines", "n_dropped", "doc", "v", "g1", "__p", "__kept_", "ta", "seq",
    "held_out", "id", "__kept", "__drop", "a.b", "x.y"
]


def nasty(spark, texts=TEXTS):
    rows = [(k if k != 4 else None, t, None if k % 3 == 0 else "en", "s", 1) for k, t in enumerate(texts)]
    rows += rows[5:7]  # repeated rows
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", *(F.lit(7).alias(c) for c in CLASH))


def empty(spark):
    return nasty(spark).limit(0)


OPERATORS = {}


def operator(f):
    OPERATORS[f.__name__] = f
    return f


@operator
def op1(docs):
    from docloom.llm import pieces

    return pieces.decode(pieces.encode(docs, vocabulary("piece_bpe_32k.model")), vocabulary("piece_bpe_32k.model"))


@operator
def op2(docs):
    from docloom.llm.htmltext import extract

    return extract(docs, "doc_id", "text")


@operator
def op4(docs):
    from docloom.llm.fingerprints import fingerprints

    return fingerprints(docs)


@operator
def op5(docs):
    from docloom.llm.neardup import near_documents

    return near_documents(docs)


@operator
def op6(docs):
    from docloom.llm.linededup import clean_lines

    return clean_lines(docs)


@operator
def op7(docs):
    from docloom.llm.sharding import assign_shards

    return assign_shards(docs)


@operator
def op8(docs):
    from docloom.llm.packing import pack

    return pack(docs, vocabulary("byte_bpe_50k.json"))


@operator
def op9(docs):
    from docloom.llm.langid import fit, predict

    return predict(docs, fit(docs))


@operator
def op10(docs):
    from docloom.llm.tokenfile import read_digests, write_token_files

    return read_digests(docs.sparkSession, write_token_files(docs, vocabulary("word_bpe_49k.json"), end_id=2))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_has_a_result(spark, name):
    docs = nasty(spark)
    found = OPERATORS[name](docs).collect()
    ids = [r.doc_id for r in found]
    want = [r.doc_id for r in docs.collect()]
    assert sorted(map(str, set(ids))) == sorted(map(str, set(want))) if name == "op8" else sorted(map(str, ids)) == sorted(map(str, want))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_an_empty_table_has_an_empty_result(spark, name):
    assert OPERATORS[name](empty(spark)).collect() == []


@pytest.mark.parametrize("name", ["op6", "op9"])
def test_other_columns_stay_as_they_are(spark, name):
    docs = nasty(spark)
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped", "lang_pred", "score")]
    values = lambda df: sorted(str([r[c] for c in own]) for r in df.collect())
    assert values(OPERATORS[name](docs)) == values(docs)


def test_too_many_labels_are_an_error(spark):
    from docloom.llm.langid import training_rows

    rows = spark.createDataFrame([(k, "some text", f"l{k % 9}") for k in range(200)], "doc_id long, text string, lang string")
    assert training_rows(rows, most_languages=9).count() > 0
    with pytest.raises(ValueError, match="more than 8"):
        training_rows(rows, most_languages=8)


def test_null_and_empty_texts(spark):
    docs = nasty(spark)
    assert [
        r.ids for r in __import__(
            "docloom.llm.pieces", fromlist=["encode"]
        ).encode(docs, vocabulary("piece_bpe_32k.model")).filter("doc_id < 2").collect()
    ] == [[], []]
    four = {r.doc_id: r for r in op4(docs).collect()}
    assert four[0].fingerprint == four[1].fingerprint
    assert four[7].fingerprint == four[8].fingerprint and four[7].n_chars == len(LONG)
    five = {r.doc_id: r for r in op5(docs).collect()}
    assert [(five[k].n_shingles, five[k].component_id, five[k].kept) for k in range(4)] == [(0, k, True) for k in range(4)]
    assert (five[5].n_shingles, five[6].component_id, five[8].component_id) == (2, 5, 7)
    six = {r.doc_id: r for r in op6(docs).collect()}
    assert (six[0].n_lines, six[0].n_dropped, six[0].text) == (1, 0, "") and six[3].text == "\n\n"
    seven = {r.doc_id: r for r in op7(docs).collect()}
    assert (seven[0]["size"], seven[0].text_crc32, seven[1]["size"]) == (1, 0, 1)
    nine = {r.doc_id: r for r in op9(docs).collect()}
    assert all(nine[k].lang_pred == "und" and nine[k].score == 0 for k in (0, 1, 2, 3, 10))
    ten = {r.doc_id: r for r in op10(docs).collect()}
    assert ten[0].n_tokens == ten[1].n_tokens == 1
    assert ten[0].ids_crc32 == zlib.crc32(np.array([2], dtype="<u4").tobytes())
    eight = [r for r in op8(docs).collect() if r.doc_id == 0]
    assert [(r.start, r.length, r.doc_tokens) for r in eight] == [(0, 1, 1)]


def test_repeated_lines_count_by_documents(spark):
    from docloom.llm.linededup import clean_lines

    rows = [(k, f"Shared line \nown {k}\nshared LINE") for k in range(10)] + [(20, "rare\n" * 30)]
    found = {r.doc_id: r for r in clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((found[k].text, found[k].n_dropped) == (f"own {k}", 2) for k in range(10))
    assert found[20].n_dropped == 0 and hashlib.sha256(found[20].text.encode()).digest() == hashlib.sha256(("rare\n" * 30).encode()).digest()


def test_line_runs_settle_early_and_late(spark):
    from docloom.llm.linededup import LineRuns

    runs = LineRuns(3, min_docs=3)
    batch = lambda *keys: spark.createDataFrame([(k, k) for k in keys], "h1 long, h2 long")
    for b in (batch(1, 1, 1, 2, 9), batch(1, 2, 3), batch(2, 3, 4), batch(3, 4), batch(4, 5)):
        runs.add(b)
    assert sorted(r.h1 for r in runs.frequent().collect()) == [1, 2, 3, 4]


def test_line_runs_merge_without_a_shuffle(spark):
    import random

    from docloom.llm.linededup import LineRuns, merge

    random.seed(2)
    runs, counts = LineRuns(3, min_docs=4), {}
    for _ in range(7):
        keys = [random.randint(0, 60) for _ in range(30)]
        for k in keys:
            counts[k] = counts.get(k, 0) + 1
        runs.add(spark.createDataFrame([(k, -k) for k in keys], "h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [1, 1, 1] and len(runs.settled) == 4
    # Merged with each other and anti-joined with the settled ones where they lie.
    plan = merge([run for level in runs.levels for run, _ in level])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "LeftAnti" in plan and plan.count("Bucketed: true") >= 4
    found = sorted(r.h1 for r in runs.frequent().collect())
    assert len(found) == len(set(found)) and set(found) == {k for k, n in counts.items() if n >= 4}


def test_vectors_that_link_with_nothing(spark):
    from docloom.llm.embeddings import near_vectors

    one, near = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0]
    rows = [
        (0, one, 1), (1, one, 1), (2, near, 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1),
        (7, [float("nan"), 1.0, 0.0], 1), (8, [None, 1.0, 0.0], 1), (9, [float("inf"), 0.0, 0.0], 1), (10, [], 1), (11, [1.0, 0.0], 1),
        (12, [-1.0, 0.0, 0.0], 1), (None, [0.0, 1.0, 0.0], 1), (14, [1e300, 0.0, 0.0], 1)
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *(F.lit(3).alias(c) for c in CLASH))
    found = {r.vec_id: r for r in near_vectors(frame).collect()}
    assert len(found) == len(rows)
    for k in (0, 1, 2, 14):
        assert (found[k].n_links, found[k].component_id, found[k].kept) == (3, 0, k == 0)
    for k in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12):
        assert (found[k].n_links, found[k].component_id, found[k].kept) == (0, k, True)
    assert (found[None].n_links, found[None].component_id, found[None].kept) == (0, None, True)
    assert near_vectors(frame.limit(0)).collect() == []


def test_large_buckets_are_cut(spark, monkeypatch):
    from docloom.llm import embeddings

    monkeypatch.setattr(embeddings, "BLOCK", 7)
    rng = np.random.default_rng(0)
    center = rng.normal(size=16)
    x = np.concatenate((center + 0.1 * rng.normal(size=(60, 16)), rng.normal(size=(40, 16))))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = ((u @ u.T) >= 0.98).sum(axis=1) - 1
    frame = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r.n_links for r in embeddings.near_vectors(frame).collect()}
    assert links.sum() > 200
    # A link in 10,000 may be missed; it counts for both its ends.
    assert sum(abs(found[k] - links[k]) for k in found) <= 2


def test_parts_of_a_block_pair_add_up(monkeypatch):
    from docloom.llm import embeddings

    rng = np.random.default_rng(1)
    center = rng.normal(size=(4, 32))
    x = np.concatenate([c + 0.12 * rng.normal(size=(25, 32)) for c in center])
    c = rng.permutation(1000)[:100]
    codes = embeddings.bucket_codes(x / np.linalg.norm(x, axis=1, keepdims=True), 2)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    for key in ((1, 32, 0, int(codes[0, 0, 0]), 0, 0), (1, 32, 1, int(codes[0, 1, 0]), 0, 1)):
        side = (np.arange(100) % 2) * (key[4] != key[5])
        rows = [
            (
                c[a : a + 30], np.full(len(c[a : a + 30]), 2), side[a : a + 30], [v.astype("<f8").tobytes() for v in x[a : a + 30]],
                codes[a : a + 30].reshape(len(c[a : a + 30]), -1)
            ) for a in range(0, 100, 30)
        ]
        found = []
        for part in (7, 512):
            monkeypatch.setattr(embeddings, "PART", part)
            out = embeddings._compare(key, rows, 0.98)
            found.append({} if out is None else {int(k): (int(n), int(r)) for k, n, r in zip(*out, strict=True)})
        assert found[0] == found[1]
        if key[2] == 0:
            # All pairs but those that met in a smaller bucket of the table.
            first = np.array([[not any(v in codes[b, 0] and v < key[3] for v in codes[a, 0]) for b in range(100)] for a in range(100)])
            links = {int(c[a]): 2 * int((near[a] & first[a]).sum() - (near[a, a] & first[a, a])) for a in range(100)}
            assert {k: n for k, (n, _) in found[0].items()} == {k: n for k, n in links.items() if n} and found[0]


def test_rows_without_id_are_dealt_like_others(spark, monkeypatch):
    from docloom.llm import tokenfile

    rows = [(k if k % 2 else None, f"text number {k} of many") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokens = tokenfile.token_table(docs, vocabulary("word_bpe_49k.json"), 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(r["count"] for r in tokens.groupBy("part").count().collect())
    assert len(sizes) == 4 and sizes[-1] < 1.6 * 1000
    # A file ends at a bound, and what is read back is the same.
    want = sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in op10(docs).collect())
    monkeypatch.setattr(tokenfile, "FILE_DOCUMENTS", 100)
    files = tokenfile.write_token_files(docs, vocabulary("word_bpe_49k.json"), end_id=2)
    found = tokenfile.read_digests(spark, files).collect()
    assert sum(f["n_docs"] for f in files) == 4000 == len(want)
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in found) == want
