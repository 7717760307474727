"""The ten operators against brute force, the libraries and their definitions, on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm.queries import QUERIES, table, vocabulary


@pytest.fixture(scope="module")
def docs(spark, data):
    return [(r.doc_id, r.text or "", r.lang) for r in table(spark, data, "documents").orderBy("doc_id").collect()]


def rows(spark, data, name):
    return QUERIES[name](spark, data).collect()


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def test_op1_equals_the_library(spark, data, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    found = {r.doc_id: r for r in rows(spark, data, "op1_sentencepiece")}
    assert len(found) == len(docs)
    for doc_id, text, _ in docs:
        assert found[doc_id].ids == model.encode(text)
        assert found[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op3_equals_brute_force(spark, data):
    v = table(spark, data, "embeddings").collect()
    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in v}
    links = defaultdict(set)
    for a in v:
        for b in v:
            if a.vec_id < b.vec_id and a.label is not None and a.label == b.label:
                p, q = x[a.vec_id], x[b.vec_id]
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.98:
                    links[a.vec_id].add(b.vec_id)
                    links[b.vec_id].add(a.vec_id)
    component = spread({i: links[i] for i in x})
    for r in rows(spark, data, "op3_embedding_near_dedup"):
        assert (r.n_links, r.component_id, r.kept) == (len(links[r.vec_id]), component[r.vec_id], r.vec_id == component[r.vec_id])


def spread(links):
    component = {}
    for start in sorted(links):
        todo = [start] if start not in component else []
        while todo:
            x = todo.pop()
            if x not in component:
                component[x] = start
                todo += links[x]
    return component


def bag(text):
    return Counter(re.split("[ \n]", text))


def test_op4_estimates_generalised_jaccard(spark, data, docs):
    found = {r.doc_id: r for r in rows(spark, data, "op4_fingerprints")}
    ordered = sorted(docs, reverse=True)
    errors, prints = [], {}
    for k, (doc_id, text, _) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        r = found[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        a, b, c = bag(text), bag(edited), bag(following)
        errors.append(r.near_edited - sum((a & b).values()) / sum((a | b).values()))
        errors.append(r.near_next - sum((a & c).values()) / sum((a | c).values()))
    assert len(found) == len(docs)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 0.12


def shingle_set(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def near_components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    links = {i: {j for j, b in sets.items() if i != j and a and b and 100 * len(a & b) >= 75 * len(a | b)} for i, a in sets.items()}
    return sets, spread(links)


def test_op5_equals_brute_force(spark, data, docs):
    sets, component = near_components({d: t for d, t, _ in docs})
    for r in rows(spark, data, "op5_minhash_near_dedup"):
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), component[r.doc_id], r.doc_id == component[r.doc_id])


def near_copies(n, words, changes, seed):
    """Copies of one text, each with some words replaced by its own."""
    rng = np.random.default_rng(seed)
    texts = {}
    for k in range(n):
        own = [f"w{j}" for j in range(words)]
        for at in rng.choice(words, rng.integers(*changes), replace=False):
            own[at] = f"x{k}_{at}"
        texts[k] = " ".join(own)
    return texts


def test_shingle_sets_equal_their_definition(monkeypatch):
    import random

    from docloom.llm import shingles

    random.seed(1)
    texts = [None, "", " ", "a", "A a\tb", "one two three four five", "x" * 9000 + " y " + "X" * 9000]
    texts += ["".join(random.choice("abAB \n\t\x0b\x0c\xa0é日") for _ in range(random.randint(0, 300))) for _ in range(300)]
    found = {}
    for step in (16, 64, 1 << 20):
        monkeypatch.setattr(shingles, "STEP", step)
        for k, (words, x) in enumerate(shingles.shingle_sets(texts)):
            own = (texts[k] or "").encode().lower().split()
            assert len(own) == len(words) and len(x) == len(shingle_set(texts[k] or "")) and (np.diff(x.astype(object)) > 0).all()
            assert all(found.setdefault(w, h) == h for w, h in zip(own, words.tolist(), strict=True))
            assert found.setdefault(k, x.tolist()) == x.tolist()
    words = [h for w, h in found.items() if isinstance(w, bytes)]
    assert len(set(words)) == len(words)


def test_op5_loses_no_link_at_the_threshold(spark):
    """Pairs between 0.72 and 0.80, far beyond a sketch's size."""
    from docloom.llm.neardup import near_documents

    rng = np.random.default_rng(8)
    texts = {}
    for k in range(1000):
        size = int(rng.integers(180, 700))
        words = [f"p{k}_{j}" for j in range(size)]
        texts[k] = " ".join(words)
        # A run at the end is replaced: no shingle but those at its border changes besides.
        shared = size - int(round(size * (1 - 2 * (j := rng.uniform(0.72, 0.80)) / (1 + j))))
        texts[1000 + k] = " ".join([*words[:shared], *(f"q{k}_{j}" for j in range(size - shared))])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_documents(frame).collect()}
    links = 0
    for k in range(1000):
        a, b = shingle_set(texts[k]), shingle_set(texts[1000 + k])
        linked = 100 * len(a & b) >= 75 * len(a | b)
        links += linked
        assert found[k] == k and found[1000 + k] == (k if linked else 1000 + k)
    assert 500 < links < 800


def test_op5_rows_grow_with_members(spark, monkeypatch):
    """Groups of mutual near copies, many blocks each: neither edges nor texts may grow with the group's square."""
    from docloom.llm import neardup, storage

    monkeypatch.setattr(neardup, "BLOCK", 32)
    write, rows = storage.materialise, {}

    def counted(df, name):
        out = write(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(storage, "materialise", counted)
    for n in (128, 1024):
        rows.clear()
        texts = near_copies(n, 300, (2, 7), n)
        found = neardup.near_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
        assert {r.component_id for r in found} == {0}
        # Each class has a text and a link for each of its first lists, about, whatever the group's size.
        # Edges are links in both directions, and written twice.
        for name, share in (("near-told", 2), ("near-links", 2), ("edges", 4)):
            assert rows[name] <= share * neardup.FIRST_LISTS * n, (n, name, rows)


@pytest.mark.parametrize("block", [5, 1024])
def test_op5_blocks_lose_nothing(spark, monkeypatch, block):
    """Most pairs lie near the threshold, many classes stay alone; blocks are far smaller than lists."""
    from docloom.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = near_copies(90, 300, (5, 16), 5)
    sets, component = near_components(texts)
    assert 5 < len(set(component.values())) < 85
    for r in neardup.near_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), component[r.doc_id])


def test_op5_spanning_forest():
    from docloom.llm.neardup import spanning_forest

    a, b, w = np.array([0, 1, 0, 3, 3, 5]), np.array([1, 2, 2, 4, 4, 5]), np.array([0.5, 0.9, 0.8, 0.1, 0.2, 1.0])
    edges, root = spanning_forest(a, b, w, 7)
    assert sorted(edges.tolist()) == [1, 2, 4] and root.tolist() == [0, 0, 0, 3, 3, 5, 6]
    edges, root = spanning_forest(a[:0], b[:0], w[:0], 3)
    assert len(edges) == 0 and root.tolist() == [0, 1, 2]


def test_op5_finds_borderline_links_in_a_crowd(spark):
    """Many texts near one another, and others just beyond: long enough for sketches to be cut."""
    from docloom.llm.neardup import near_documents

    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(400)]
    texts = {}
    for k in range(60):
        words = list(base)
        for at in rng.choice(400, rng.integers(2, 22), replace=False):
            words[at] = f"x{k}_{at}"
        texts[k] = " ".join(words)
    passage = " ".join(f"p{k}" for k in range(60))
    for k in range(60, 110):
        texts[k] = passage + " " + " ".join(f"y{k}_{j}" for j in range(int(rng.integers(1, 120))))
    sets, component = near_components(texts)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in near_documents(frame).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), component[r.doc_id])


def kept_lines(texts, least=10):
    blanks = " \t\n\x0b\x0c\r"
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(blanks).translate(upper)
    n = Counter(k for t in texts.values() for k in {key(line) for line in t.split("\n")} if k)
    return {i: ([line for line in t.split("\n") if n[key(line)] < least], len(t.split("\n"))) for i, t in texts.items()}


def test_op6_equals_brute_force(spark, data, docs):
    want = kept_lines({d: t for d, t, _ in docs})
    for r in rows(spark, data, "op6_line_dedup"):
        lines, n = want[r.doc_id]
        assert (r.n_lines, r.n_dropped) == (n, n - len(lines))
        assert r.kept_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def check_shards(found, texts, shards=8):
    assert len(found) == len(texts)
    counts = Counter(r.shard for r in found)
    assert max(counts.values()) - min(counts.get(k, 0) for k in range(shards)) <= 1
    for k in range(shards):
        assert sorted(r.slot for r in found if r.shard == k) == list(range(counts.get(k, 0)))
    assert {r.law for r in found} <= {"rows"}


def test_op7_balances_and_keeps_equal_texts_together(spark, data, docs):
    found = rows(spark, data, "op7_sharding")
    texts = {d: t for d, t, _ in docs}
    check_shards(found, texts)
    shard_of = defaultdict(set)
    for r in found:
        assert r.size == len(texts[r.doc_id].encode()) + 1
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        shard_of[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in shard_of.values()) == 0


def test_op7_spreads_a_group_beyond_the_quota(spark):
    from docloom.llm.sharding import assign_shards, cut_links

    texts = ["same"] * 70 + [f"t{k}" for k in range(90)] + ["pair"] * 2
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    shards = assign_shards(frame)
    found = shards.collect()
    check_shards(found, texts)
    assert len({r.shard for r in found if texts[r.doc_id] == "same"}) <= 5
    told = cut_links(shards, "text_crc32").first()
    assert told.links == 70 * 69 // 2 + 1 and 0 < told.cut < told.links


def pieces_of(found):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    return by_doc, by_sequence


def test_op8_covers_every_id_once(spark, data, docs):
    encoder = tokenizer("byte_bpe_50k.json")
    by_doc, by_sequence = pieces_of(rows(spark, data, "op8_packing"))
    for doc_id, text, _ in docs:
        ids = np.array([*encoder.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    tokens = 0
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        tokens += at
    assert tokens / (1024 * len(by_sequence)) > 0.98


def test_op9_predicts_held_out_languages(spark, data, docs):
    langs = {d: lang for d, _, lang in docs}
    found = rows(spark, data, "op9_language_id")
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)


def test_op10_reads_back_what_it_wrote(spark, data, docs):
    encoder = tokenizer("word_bpe_49k.json")
    found = {r.doc_id: r for r in rows(spark, data, "op10_token_files")}
    start = 0
    for doc_id, text, _ in docs:
        ids = np.array([*encoder.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        r = found[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(found) == len(docs)


def test_huffman_codes():
    from docloom.llm.huffman import Code, code_lengths, decode

    rng = np.random.default_rng(0)
    for size, longest in ((1, 20), (2, 20), (5, 3), (300, 9), (3000, 12)):
        ids = (rng.zipf(1.5, 20_000) % size).astype(np.uint16)
        counts = np.bincount(ids, minlength=size)
        lengths = code_lengths(counts, longest)
        assert lengths.max() <= longest and (lengths[counts > 0] > 0).all() and (lengths[counts == 0] == 0).all()
        assert sum(2.0 ** -float(n) for n in lengths[lengths > 0]) <= 1
        code = Code(lengths)
        for n in (1, 63, 64, 65, 20_000):
            data, points = code.encode(ids[:n])
            assert (decode(code.tables(), code.bits, data, points, n) == ids[:n]).all()


def test_huffman_without_a_limit_is_optimal():
    import heapq

    from docloom.llm.huffman import code_lengths

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 0, 4])
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((counts * code_lengths(counts)).sum()) == cost


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_encoder_equals_the_library(name):
    from docloom.llm.tokens import WordEncoder

    encoder = WordEncoder(vocabulary(name))
    texts = [
        "", " ", "a  b", "a b ", "\nx", " x", "x\ty", "It's a cát 12 <|endoftext|> b", "a\n b", "\x01 a", "a \x01b", "É I'm A1b2_c ...,! x",
        "a.\nb, c.", "ends.\n", "日本 語", "a b", "İstanbul Straße", "x" * 500, "one, two. three,, four.", "a\r\nb"
    ]
    for text, ids in zip(texts * 2, encoder.encode(texts * 2), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<b>b<p>c</b>d", "ab\n\ncd"),
        ("<ul><li>one<li>two<ol><li>x<li>y</ol><li>three</ul>", "- one\n- two\n  1. x\n  2. y\n- three"),
        ("<table><tr><td>x<td>yyy<tr><th>long cell</th><td>z</table>", "x          yyy\nlong cell  z"),
        ("<div hidden>no</div><p style='display: none'>no<p>yes", "yes"),
        ("<script>var a='</p>'</script><title>t</title>a &amp; b<br>c", "a & b\nc"),
        ("<pre>a  b\n  c</pre>", "a  b\n  c"),
        ("", ""),
        ("plain", "plain"),
        ("<p>un<closed", "un<closed"),
        ("<div>" * 300 + "deep" + "</div>" * 300, "deep"),
    ],
)
def test_op2_renders_visible_text(html, text):
    from docloom.llm.htmltext import visible_text

    assert visible_text(html) == text


def test_op2_keeps_every_visible_word(spark, data):
    pages = {r.page_id: r.html for r in table(spark, data, "pages").collect()}
    for r in rows(spark, data, "op2_html_text"):
        bare = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<!--.*?-->", " ", pages[r.page_id])
        words = re.sub(r"<[^>]*>", " ", bare)
        import html

        assert Counter(re.findall(r"\w+", html.unescape(words))) == Counter(re.findall(r"\w+", r.text))


def test_components(spark):
    from docloom.llm.components import components

    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (103, 101), (200, 200)]
    found = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbered_is_gapless(spark):
    from docloom.llm.ranking import numbered

    frame = spark.range(1000).withColumn("g", F.col("id") % 3)
    found = numbered(frame, ["g"], F.struct("id"), "n").collect()
    for g in range(3):
        assert sorted(r.n for r in found if r.g == g) == list(range(sum(r.g == g for r in found)))


def test_op1_viterbi_of_a_unigram_model():
    """With scores that are no ranks the best path is that of the largest sum."""
    import random

    from docloom.llm.pieces import Pieces

    random.seed(1)
    p = Pieces(vocabulary("piece_bpe_32k.model"))
    p.is_bpe, p.score = False, [-10 * random.random() for _ in p.score]
    p.worst = min(p.score) - 10
    words = sorted({"".join(random.choice("abcdert▁é☃") for _ in range(random.randint(1, 12))) for _ in range(200)})

    def best(w):
        rows = [0.0]
        for end in range(1, len(w) + 1):
            rows.append(max(rows[s] + (p.score[p.id[w[s:end]]] if w[s:end] in p.id else p.worst) for s in range(end) if w[s:end] in p.id or s == end - 1))
        return rows[-1]

    for w, ids in p.encode_words(words).items():
        unknown = sum(c not in p.id for c in w)
        assert sum(p.score[i] for i in ids if i not in p.of_byte) + unknown * p.worst == pytest.approx(best(w))


def test_op1_chunks_equal_the_library():
    import random

    import sentencepiece

    from docloom.llm.pieces import Encoder

    encoder, library = Encoder(vocabulary("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    random.seed(6)
    texts = ["".join(random.choice("abcdeinorst  \n.,;:'\"!?()-_01é日ß▁xX/\\") for _ in range(random.randint(0, 40))) for _ in range(1000)]
    texts += [None, "", " ", "a ", "a b ", "\n", "a\n b"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        ids = np.frombuffer(ids, dtype="<i4").tolist()
        assert ids == library.encode(text or "") and encoder.pieces.decode(ids) == library.decode(ids)


def test_op9_sample_is_the_smallest_hashes_of_each_language(spark):
    from docloom.llm.langid import held_out, sample, training_rows

    # Laid out by language; ids of "it" are all the same but for a few.
    docs = spark.range(0, 9000, 1, 6).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") < 3000, "de").when(F.col("id") < 6000, "en").otherwise("it").alias("lang")
    )
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") >= 6050, 6001).otherwise(F.col("doc_id")))
    hashes = defaultdict(list)
    for r in docs.filter(~held_out(F.col("doc_id"))).select("lang", F.xxhash64(F.lit("langid"), "doc_id").alias("h")).collect():
        hashes[r.lang].append(r.h)
    bound = {k: sorted(v)[99] for k, v in hashes.items()}
    got = defaultdict(list)
    for r in training_rows(docs, 100).collect():
        got[r.lang].append(r.h)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(h for h in v if h <= bound[k]) for k, v in hashes.items()}
    assert Counter(r.lang for r in sample(docs, 100).collect()) == {"de": 100, "en": 100, "it": 100}
    assert sorted(sample(docs, 100).collect()) == sorted(sample(docs.repartition(3), 100).collect())


@pytest.mark.parametrize("opening", ["<div>" * 300, "<div>" + "<span>" * 300, "<div><span>" * 2500])
def test_op2_keeps_its_rules_at_any_depth(opening):
    from docloom.llm.htmltext import visible_text

    below = (
        "a<script>x()</script><style>b {}</style><b hidden>c</b><i style='display:none'>d</i> "
        "e<br>f<div>g</div><ul><li>h<li>i</ul><table><tr><td>jj<td>k<tr><td>l<td>m</table><pre>n  o\n p</pre>"
    )
    assert visible_text(opening + below) == "a e\nf\ng\n\n- h\n- i\n\njj  k\nl   m\n\nn  o\n p"


def test_op2_nests_lists_quotes_and_tables_at_any_depth():
    from docloom.llm.htmltext import visible_text

    assert visible_text("<blockquote>" * 1500 + "deep") == "  " * 1500 + "deep"
    assert visible_text("<table><tr><td>" * 1500 + "deep") == "deep"
    assert visible_text("<ul><li>x" * 1200).split("\n")[-1] == "  " * 1199 + "- x"


@pytest.mark.parametrize(("dim", "polytopes", "n"), [(3, 2, 10000), (64, 2, 10000), (64, 3, 10000), (384, 3, 1500)])
def test_op3_misses_few_pairs_at_the_threshold(dim, polytopes, n):
    from docloom.llm.embeddings import MISSED, meet, pairs_at, tables_for

    met = meet(*pairs_at(0.98, n, dim, 7), polytopes, tables_for(dim, polytopes))
    assert (~met.any(axis=1)).sum() <= max(1, n * MISSED)


def test_op3_links_pairs_at_three_polytopes(spark, monkeypatch):
    from docloom.llm import embeddings

    monkeypatch.setattr(embeddings, "CROWD", 1e-3)
    x, y = embeddings.pairs_at(0.9801, 1000, 64, 3)
    frame = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate([*x, *y])], "vec_id long, embedding array<double>, label long")
    found = embeddings.near_vectors(frame).collect()
    # A pair in 10,000 may be missed.
    assert len(found) == 2000 and sum(r.n_links == 1 and r.component_id == r.vec_id % 1000 for r in found) >= 1998


def test_op8_cuts_only_what_no_sequence_holds():
    from docloom.llm.packing import attention_cost, share_out

    rng = np.random.default_rng(2)
    for lengths in ([100] * 30 + [7] * 3, rng.integers(1, 1024, 400).tolist(), rng.integers(600, 1024, 50).tolist() + [1] * 900, [1023] * 9):
        room = [1024] * -(-sum(lengths) // 1024)
        cost = [0.0] * len(room)
        want = [[] for _ in room]
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            at, left = 0, lengths[i]
            while left:
                fits = [k for k in range(len(room)) if room[k] >= left]
                k = min(fits, key=lambda k: (cost[k], k)) if fits else max(range(len(room)), key=lambda k: (room[k], -k))
                n = min(left, room[k])
                want[k].append((i, at, n, 1024 - room[k]))
                room[k], cost[k], at, left = room[k] - n, cost[k] + attention_cost(n), at + n, left - n
        assert share_out(lengths) == want


def test_op10_reads_one_file_a_task(spark):
    from docloom.llm.tokenfile import read_digests, write_token_files

    docs = spark.range(0, 3000, 1, 7).select(
        (F.col("id") * 3 % 1000 - 500).alias("doc_id"), F.repeat(F.concat(F.lit(" w"), F.col("id").cast("string")), 40).alias("text")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = write_token_files(docs, vocabulary("word_bpe_49k.json"), end_id=2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = read_digests(spark, files)
    assert len(files) > 1 and read.rdd.getNumPartitions() == len(files)
    found = read.withColumn("task", F.spark_partition_id()).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted(r.doc_id for r in docs.collect())
    assert found[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(found, found[1:], strict=False))
    assert sorted(Counter(r.task for r in found).values()) == sorted(f["n_docs"] for f in files)


def test_op10_documents_beyond_a_block(spark, monkeypatch):
    from docloom.llm import tokenfile
    from docloom.llm.huffman import code_lengths
    from docloom.llm.tokenfile import _Run, read_file

    monkeypatch.setattr(tokenfile, "BLOCK", 100)
    import tempfile

    import pyarrow as pa
    from docloom.llm.huffman import Code

    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 50, n).astype("<u2") for n in (5, 0, 730, 100, 99, 1, 250)]
    run = _Run("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"), 0, 0, Code(code_lengths(np.bincount(np.concatenate(docs)))), 2, 1)
    run.add([7, None, 9, 9, 11, 12, 13], [d.tobytes() for d in docs])
    run.close(pa)
    got = list(read_file(run.path))
    assert len(run.blocks) > 10 and [k for k, _ in got] == [7, None, 9, 9, 11, 12, 13]
    assert all((a == b).all() and len(a) == len(b) for (_, a), b in zip(got, docs, strict=True))


def test_op9_family_first_then_pairs():
    """The family's machine decides even where a language of another family is nearer; within it each pair votes."""
    from docloom.llm.langid import DIMENSIONS, Model, features

    x = features("some text")
    toward = lambda sign: np.append(sign * x, 0).astype(np.float32)
    model = Model(
        {"germanic": ["de", "en", "nl"], "romance": ["fr"]}, {"germanic": toward(1), "romance": toward(-1)},
        {("de", "en"): toward(-1), ("de", "nl"): toward(1), ("en", "nl"): toward(1)}
    )
    (lang, score), none, again = model.predict(["some text", "12 ½ Ⅷ ②", "some text"])
    sure = 1 / (1 + np.exp(-4))
    assert lang == "en" and score == pytest.approx(sure * sure, abs=1e-6) and none == ("und", 0.0) and again == (lang, score)
    model.family = {"germanic": toward(-1), "romance": toward(1)}
    assert model.predict(["some text"])[0][0] == "fr" and len(x) == DIMENSIONS


def test_op9_predictions_do_not_depend_on_the_batch():
    from docloom.llm.langid import Model, features

    texts = ["the quick brown fox", "der schnelle braune Fuchs", "le renard brun rapide", "el zorro marrón", None, "", "3½"] * 5
    langs = ["en", "de", "fr", "es"]
    model = Model.train(np.stack([features(t) for t in texts[:4]] * 6), langs * 6)
    together = model.predict(texts)
    assert [x[0] for x in together[:7]] == [*langs, "und", "und", "und"]
    for t, (lang, score) in zip(texts, together, strict=True):
        (alone, own), = model.predict([t])
        assert alone == lang and own == pytest.approx(score, abs=1e-5)


def test_op9_numbers_are_no_letters(spark):
    from docloom.llm.langid import fit, has_letter, predict

    rows = [(k, t) for k, t in enumerate(["½", "² Ⅷ ①", "a½", "日", "_", "٣", "ª", None])]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    want = [bool(t) and any(c.isalpha() for c in t) for _, t in rows]
    assert [r.x for r in docs.select("doc_id", has_letter(F.col("text")).alias("x")).orderBy("doc_id").collect()] == want
    assert [r.lang_pred != "und" for r in predict(docs, fit(docs)).orderBy("doc_id").collect()] == want


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<ol start='--5'><li value='--5'>a<li>b</ol>", "1. a\n2. b"),
        (f"<ol start={'9' * 5000}><li>a</ol><table><tr><td colspan={'9' * 5000}>x<td>y</table>", "1. a\n\nx  y"),
        ("<ol start=5><li>a<li value=9>b<li>c</ol>", "5. a\n9. b\n10. c"),
        ("<ol reversed><li>a<li>b<li value=-3>c<li>d</ol>", "4. a\n3. b\n-3. c\n-4. d"),
        ("<ul><li value=4>a</ul>", "- a"),
        ("<table><tr><td rowspan=2>ab<td>c<tr><td>d<tr><td>e<td>f</table>", "ab  c\n    d\ne   f"),
        ("<table><tr><td>a<td rowspan=0 colspan=2>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b  c\nd     e\nf     g"),
        ("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>cc<td>d</table>", "a   b\ncc  d"),
        ("<table><tr><td>one<td>two</tr><tr><td colspan=2>both, and long<tr><td>x<td>y</table>", "one  two\nboth, and long\nx    y"),
        ("<table><tr><td colspan=2>wide one<td>x<tr><td>a<td>b<td>c</table>", "wide one  x\na  b      c"),
        ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes<b>also</b></p>no</div>after", "yesalso\n\nafter"),
        ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>", "yes"),
        ("<table><tr style='visibility:collapse'><td>no<tr><td>yes</table>", "yes"),
        ("<details>no<summary>more</summary><p>no</details><details open><summary>s</summary>t</details>", "more\ns\nt"),
        ("<p hidden style='display:block'>yes<p hidden>no", "yes"),
        (
            (
                "<style>.x, p.y#z {color: red; display:none} #v {visibility:hidden}</style><p class='a x'>no<p class=y>yes<p class=y "
                "id=z>no</p><i id=v>no<b style='visibility:visible'>!</b></i>"
            ),
            "yes\n\n!"
        ),
        (
            (
                "<style>.x {display:none} b.x {display:inline} @media print {p {display:none}} /* i {display:none} */ u>i "
                "{display:none}</style><i class=x>no</i><b class=x>yes</b><p><u><i>p</i></u>"
            ),
            "yes\n\np"
        ),
        ("<style>p {display:none} p {display:block} .k {display:none}</style><p>a<p class=k style='display:block'>b<p class=k>c", "a\n\nb"),
        ("<style>@import 'x'; .n {display:none} } .m {display:none} .o {display:none</style><p class=n>a<p class=m>b<p class=o>c", "c"),
        ("<noscript>shown</noscript>", "shown"),
    ],
)
def test_op2_numbers_tables_and_visibility(html, text):
    from docloom.llm.htmltext import visible_text

    assert visible_text(html) == text


def test_op2_takes_large_and_malformed_pages():
    import random
    import time

    from docloom.llm.htmltext import visible_text

    began = time.process_time()
    assert visible_text("<table><tr>" + "<td colspan=1000>a" * 500 + "<tr>" + "<td>b" * 3 + "</table>").startswith("a")
    visible_text("<table>" + "<tr>" * 3000 + "<td rowspan=65534>a" * 3000 + "<tr><td>b" * 3000 + "</table>")
    visible_text("<table>" + "".join(f"<tr><td rowspan={k % 7 + 1}>a<td rowspan={k % 5}>b<td>c" for k in range(2000)) + "</table>")
    visible_text("<table>" * 600 + "deep")
    assert time.process_time() - began < 20
    random.seed(3)
    parts = [
        "<table>", "</table>", "<tr>", "<td rowspan=2>", "<td colspan=3>", "</td>", "<ol start=3>", "<li value=x>", "</ol>", "<p>",
        "<b hidden>", "</b>", "<div style='visibility:hidden'>", "</div>", "<pre>", "</pre>", "a", " b\n", "&lt;", "<", ">", "<details>",
        "<style>.a{", "}</style>", "<br>", "<!--", "-->", "<script>", "</script>", "'", '"'
    ]
    for _ in range(1500):
        visible_text("".join(random.choice(parts) for _ in range(random.randint(1, 40))))


def test_op2_places_cells_like_a_grid():
    """Columns around spans against a grid that is filled cell by cell."""
    import random

    from docloom.html.tree import Node
    from docloom.llm.htmltext import _placed

    random.seed(5)
    for _ in range(300):
        rows, group = [], 0
        for _ in range(random.randint(1, 8)):
            group += random.random() < 0.2
            rows.append(
                (
                    group,
                    [
                        (
                            Node("td", {"rowspan": str(random.choice([1, 1, 2, 3, 0])), "colspan": str(random.choice([1, 1, 2, 3]))}), True
                        ) for _ in range(random.randint(0, 4))
                    ]
                )
            )
        taken, want = set(), []
        for at, (own, cells) in enumerate(rows):
            column, places = 0, []
            for cell, _ in cells:
                while (at, column) in taken:
                    column += 1
                span, down = int(cell.attrs["colspan"]), int(cell.attrs["rowspan"])
                places.append((column, span))
                for y in range(at, len(rows) if down == 0 else min(len(rows), at + down)):
                    if rows[y][0] == own and all(rows[z][0] == own for z in range(at, y)):
                        taken.update((y, x) for x in range(column, column + span))
                column += span
            want.append(places)
        assert list(_placed(rows)) == want
