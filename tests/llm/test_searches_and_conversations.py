"""Operators 11 to 13 against brute force, and their edges."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from docloom.llm.queries import QUERIES, table

EXTRA = ["c", "v", "h1", "digest", "depth", "part", "kind", "place", "a.b", "__kept"]


def clashing(frame):
    from pyspark.sql import functions as F

    return frame.select("*", *(F.lit(7).alias(name) for name in EXTRA))


# --- operator 11


def brute(x, ids, k=10):
    return {
        int(ids[i]): [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if j != i][:k]
        for i in np.flatnonzero(ids % 100 == 0) for d in [np.sqrt(((x - x[i]) ** 2).sum(axis=1))]
    }


def test_op11_equals_brute_force(spark, data):
    rows = table(spark, data, "embeddings").collect()
    want = brute(np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows]))
    found = defaultdict(list)
    for r in sorted(QUERIES["op11_nearest_vectors"](spark, data).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(found[r.query_id]) + 1
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == set(want)
    near = [len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(near) >= 0.99
    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows}
    for q, got in found.items():
        assert got == sorted(got, key=lambda p: (p[1], p[0])) and len(got) == 10
        assert all(abs(np.sqrt(((x[q] - x[i]) ** 2).sum()) - d) <= 1e-12 for i, d in got)


@pytest.mark.parametrize("shard", [300, 16384])
def test_op11_recall_and_shards(spark, monkeypatch, shard):
    from docloom.llm import nearest

    monkeypatch.setattr(nearest, "SHARD", shard)
    rng = np.random.default_rng(5)
    center = rng.normal(size=(30, 48))
    x = (center[rng.integers(0, 30, 2500)] + 0.4 * rng.normal(size=(2500, 48))).astype(np.float32)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = nearest.build_index(frame)
    shards = index.select("n", "sizes").collect()
    assert sum(r.n for r in shards) == 2500 and (len(shards) > 5) == (shard == 300)
    found = defaultdict(set)
    for r in nearest.search_index(index, frame.filter("vec_id % 100 = 0")).collect():
        found[r.query_id].add(r.vec_id)
    want = brute(x.astype(float), np.arange(2500))
    assert np.mean([len(found[q] & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.97


def test_op11_queries_in_parts(spark, monkeypatch):
    from docloom.llm import nearest

    monkeypatch.setattr(nearest, "QUERIES", 3)
    monkeypatch.setattr(nearest, "SHARD", 64)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = sorted((r.query_id, r.rank, r.vec_id) for r in nearest.nearest_vectors(frame, frame.filter("vec_id % 20 = 0")).collect())
    want = [(q, k + 1, int(j)) for q in range(0, 400, 20) for k, j in enumerate([j for j in np.argsort(((x - x[q]) ** 2).sum(axis=1)) if j != q][:10])]
    assert found == want


def test_op11_ties_copies_and_unusable_rows(spark):
    from docloom.llm.nearest import nearest_vectors

    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 0.0]) for k in range(95, 130)] + [(200, [0.0, 1.0]), (7, [3.0, 0.0]), (8, [-1.0, 0.0]), (None, [0.0, 1.0]), (None, [0.0, 1.0])]
    rows += [(300, None), (400, [0.0, -0.0]), (500, [nan, 1.0]), (600, [None, 1.0]), (700, [inf, 0.0]), (800, []), (900, [1.0, 0.0, 0.0]), (1000, [1e300, 0.0])]
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = defaultdict(list)
    for r in sorted(nearest_vectors(frame, frame.filter("vec_id % 100 = 0")).collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == {100, 200, 1000}  # 900 has no other vector of its length
    assert found[100] == [(k, 0.0) for k in [*range(95, 100), *range(101, 106)]]
    assert found[200][:2] == [(None, 0.0)] * 2 and [i for i, _ in found[200][2:]] == [8, *range(95, 102)]
    assert {d for _, d in found[1000]} == {inf}
    assert nearest_vectors(frame.limit(0), frame.limit(0)).collect() == []
    twice = spark.createDataFrame([(100, [1.0, 2.0]), (100, [1.0, 2.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in nearest_vectors(twice, twice.filter("vec_id = 100")).collect())
    assert got == [(100, 1, 3), (100, 1, 3), (100, 2, 100), (100, 2, 100)]


def test_op11_graph_is_whole():
    from docloom.llm import smallworld

    rng = np.random.default_rng(0)
    x = smallworld.scaled(np.concatenate([c + 1e-3 * rng.normal(size=(300, 16)) for c in rng.normal(size=(4, 16))])[rng.permutation(1200)])
    graph = smallworld.build(x)
    again = smallworld.from_flat(graph.sizes, graph.flat())
    assert all((a == b).all() for a, b in zip(graph.links, again.links, strict=True))
    for links in graph.links:
        own = np.arange(len(links))[:, None]
        assert not (links == own).any() and links.max() < len(links)
        assert all(len(set(row[row >= 0])) == (row >= 0).sum() for row in links)
    reached, todo = {0}, [0]
    while todo:
        for k in graph.links[0][todo.pop()]:
            if k >= 0 and k not in reached:
                reached.add(int(k))
                todo.append(int(k))
    assert len(reached) >= 0.99 * len(x)


# --- operator 12


def trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    full = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, t in full.items():
        for d in range(len(t) + 1):
            nodes[t[:d]].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    sha = lambda k, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if full[c] == k).encode()).hexdigest()
    return sorted(
        (min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), kids.get(k, 0), leaves[k], saved[k], sha(k, m)) for k, m in nodes.items()
    )


def trie_rows(frame):
    return sorted(
        (r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in frame.collect()
    )


def test_op12_equals_brute_force(spark, data):
    rows = [tuple(r) for r in table(spark, data, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(QUERIES["op12_prefix_trie"](spark, data)) == trie(rows)


@pytest.mark.parametrize("band", [2, 3, 32])
def test_op12_long_conversations(spark, monkeypatch, band):
    from docloom.llm import trie as module

    monkeypatch.setattr(module, "BAND", band)
    random.seed(4)
    rows = [(c, t, random.choice("us"), random.choice(["a b", "a  b c", "", None])) for c in range(18, 45) for t in range(random.choice([1, 2, 5, 21]))]
    rows += [(3, t, "u", "x") for t in range(40)] + [(7, t, "u", "x") for t in range(33)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie_rows(module.prefix_trie(frame)) == trie(rows)


def test_op12_edges(spark):
    from docloom.llm.trie import prefix_trie

    long = "word " * 50_000
    rows = [(20, 0, "user", "one two"), (21, None, None, None), (21, 3, "user", long), (22, 0, "user", ""), (None, 1, "user", "lost"), (-5, 0, "a", "b"), (-5, 1, "ab", "")]
    rows += [(40, t, "user", "same") for t in range(6)] + [(40, 2, "user", "same")] + [(k, 0, "user", "é \U0001f600") for k in range(60, 75)]
    frame = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert trie_rows(prefix_trie(frame)) == trie(rows)
    assert prefix_trie(frame.limit(0)).collect() == []


def test_op12_tells_role_and_text_apart(spark):
    from docloom.llm.trie import turn_digest
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", "b"), ("ab", ""), ("", "ab"), ("1:a", "b"), ("a", "b")], "role string, text string")
    assert rows.select(turn_digest(F.col("role"), F.col("text"))).distinct().count() == 4


# --- operator 13

LAST = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        fault, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        out[c]
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out[c] += [((turn is not None, turn or 0), turn, "user" if fault == 4 else role, text)] * (1 + (fault == 3))
    return out


def faults(turns):
    seen, kinds = set(), []
    for role, text in turns:
        bare = LAST.findall(text)
        kinds.append("b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    return kinds


def cheapest(turns, kinds, most=60):
    """The least (cost, edits), by trying all edits up to a cost."""
    best = (most, "", [])

    def go(i, cost, edits, done):
        nonlocal best
        initials = "".join(r[:1] or "-" for r, _ in done)
        if cost > best[0] or not re.fullmatch(r"(s|s?(ua)*u?)", initials):
            return
        if i == len(turns) and re.fullmatch(r"(s?(ua)+)?", initials):
            best = min(best, (cost, edits, done), key=lambda b: b[:2])
        if not edits.endswith("II"):  # two in a row are enough
            for role in ("user", "assistant"):
                go(i, cost + 3, edits + "I", [*done, (role, "")])
        if i < len(turns):
            (role, text), extra = turns[i], 3 * (kinds[i] == "t")
            go(i + 1, cost + 4, edits + "D", done)
            if kinds[i] not in "bd":
                go(i + 1, cost + extra, edits + "K", [*done, (role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, cost + 3 + extra, edits + "R", [*done, (other, text)])

    go(0, 0, "", [])
    return best


def repaired_by_hand(rows):
    out = []
    for c, found in damage(rows).items():
        found = sorted(found, key=lambda f: (f[0], hashlib.sha256(f"{len(f[2])}:{f[2]}{f[3]}".encode()).digest()))
        turns = [(role, text) for _, _, role, text in found]
        kinds, numbers = faults(turns), [t for _, t, _, _ in found if t is not None]
        cost, edits, done = cheapest(turns, kinds)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out.append((c, gaps, *(kinds.count(f) for f in "bdt"), illegal, cost, edits, sha))
    return sorted(out, key=str)


def repaired_rows(frame):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def test_op13_audits_equal_all_edits():
    from docloom.llm.repair import audit

    for n in range(4):
        for turns in itertools.product("suax", repeat=n):
            for kinds in itertools.product("bt-", repeat=n):
                rows = [(role, "t") for role in turns]
                assert audit([("o" if r == "x" else r) + k for r, k in zip(turns, kinds, strict=True)]) == cheapest(rows, kinds)[:2]


def test_op13_equals_brute_force(spark, data):
    rows = [tuple(r) for r in table(spark, data, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert repaired_rows(QUERIES["op13_conversation_repair"](spark, data)) == repaired_by_hand(rows)


def test_op13_edges(spark):
    from docloom.llm.repair import repaired

    random.seed(9)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u"], ["Yes.", "Yes. ", "no", "", " \t\n", None, "?", " ", "é!"]
    rows = [(c, t, random.choice(roles), random.choice(texts)) for c in range(60) for t in random.sample([None, *range(-2, 9)], random.randint(1, 5))]
    rows += [(None, 1, "user", "lost."), (None, None, "assistant", "found."), (70, 0, "user", "x" * 300_000 + "."), (70, 1, "assistant", "Fine.")]
    rows += [(71, 5, "user", "again.")] * 3
    frame = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert repaired_rows(repaired(frame)) == repaired_by_hand(rows)
    assert repaired(frame.limit(0)).collect() == []
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    only = spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert repaired_rows(repaired(only)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_op13_long_conversations_have_few_steps():
    from docloom.llm import repair

    random.seed(1)
    kinds = [random.choice("suao") + random.choice("bdt-") for _ in range(20_000)]
    repair.step.cache_clear()
    cost, edits = repair.audit(kinds)
    assert repair.step.cache_info().currsize < 2000 and cost > 0 and len(edits) >= len(kinds)
    turns = [({"s": "system", "u": "user", "a": "assistant", "o": "other"}[k[0]], str(i)) for i, k in enumerate(kinds)]
    assert re.fullmatch(r"(s?(ua)+)?", "".join(r[0] for r, _ in repair.repair(turns, edits)))
