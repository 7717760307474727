"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLE = {}

ORACLE["op6_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), hot AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(hot.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN hot USING (k) GROUP BY doc_id
"""

ORACLE["op3_embedding_near_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_sum([x * x for x in e])) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), reach(id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id)::BIGINT AS n_links, min(reach.other)::BIGINT AS component_id, (v.vec_id = min(reach.other)) AS kept
FROM v JOIN reach ON reach.id = v.vec_id GROUP BY v.vec_id
"""

ORACLE["op5_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.other)::BIGINT AS component_id, d.doc_id = min(reach.other) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.id = d.doc_id GROUP BY d.doc_id
"""

ORACLE["op11_nearest_vectors"] = r"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum([(q.e[i] - c.e[i]) * (q.e[i] - c.e[i]) for i in range(1, len(q.e) + 1)])) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM d)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

#: CRC-32 of the text {0}: its bytes, each followed by eight steps of one bit.
CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for ch in string_split({0}, '')])),"
    " lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
)

ORACLE["op12_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT c, list(x ORDER BY i) AS l, CRC % 4 AS h FROM t GROUP BY c),
r AS (SELECT a.c, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l FROM o a LEFT JOIN o b ON b.c = a.c - a.c % 20),
p AS (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM r),
n AS (
  SELECT d, l[1:d] AS k, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = len(l)), '') AS e,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(any_value(l[d].t), '[^\x20\x09-\x0D]+')) END AS saved
  FROM p GROUP BY d, l[1:d]
), m AS (
  SELECT n.*, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.k[1:n.d] = n.k) AS n_children,
         (SELECT x.c FROM n x WHERE x.d = n.d - 1 AND x.k = n.k[1:n.d - 1]) AS parent FROM n
)
SELECT a.c AS conv_id, a.d::BIGINT AS depth, any_value(a.parent) AS parent_conv_id, any_value(a.n)::BIGINT AS n_convs, any_value(a.n_children)::BIGINT AS n_children,
       count(*) FILTER (WHERE b.n_children = 0)::BIGINT AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens, any_value(sha256(a.e)) AS ends_sha256
FROM m a JOIN m b ON b.d >= a.d AND b.k[1:a.d] = a.k GROUP BY a.c, a.d
""".replace("CRC", CRC32.format("c::VARCHAR"))


def _repair_sql() -> str:
    """Costs and edits from the last row back, as texts that sort by cost, then edits; each with the repaired turns."""
    then, role = (2, 2, 3, 2), {2: "user", 3: "assistant"}
    keeps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    more = lambda v, cost, edit, turn: f"{{'k': printf('%08d', {v}.k[1:8]::BIGINT + {cost}) || '{edit}' || {v}.k[9:], 't': list_concat({turn}, {v}.t)}}"
    least = lambda *x: f"list_sort([{', '.join(x)}])[1]"
    inserted = lambda v, s: more(f"{v}{then[s]}", 3, "I", f"['{role[then[s]]}:']")

    def direct(s):
        kept = " ".join(f"WHEN left(y.r, 1) = '{i}' THEN {more(f'p.v{to}', 'y.extra', 'K', '[y.r || chr(58) || y.t]')}" for i, to in keeps[s].items())
        no = "{'k': '99999999', 't': p.v0.t}"
        changed = more(f"p.v{then[s]}", "(3 + y.extra)", "R", f"['{role[then[s]]}:' || y.t]")
        return least(
            more(f"p.v{s}", 4, "D", "[]::VARCHAR[]"), f"CASE WHEN y.blank OR y.again THEN {no} {kept} ELSE {no} END",
            f"CASE WHEN y.blank OR y.again THEN {no} ELSE {changed} END"
        )

    ends = (("00000000", []), ("00000006II", ["user:", "assistant:"]), ("00000003I", ["assistant:"]), ("00000000", []))
    columns = lambda f: ", ".join(f(s) for s in range(4))
    return rf"""
WITH RECURSIVE d AS (
  SELECT conv_id AS c, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t, {CRC32.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS f
  FROM conversations
), x AS (
  SELECT c, turn, CASE f WHEN 4 THEN 'user' ELSE r END AS r, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS t,
         unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d
), z AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, t, copy) AS i, NOT regexp_matches(t, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY c, r, t ORDER BY turn NULLS FIRST, copy) > 1 AS seen, NOT regexp_matches(t, '[.!?][\x20\x09-\x0D]*$') AS cut,
         left(r, 1) AS a, lag(left(r, 1)) OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, t, copy) AS b FROM x
), y AS (
  SELECT *, NOT blank AND seen AS again, CASE WHEN NOT blank AND NOT seen AND cut THEN 3 ELSE 0 END AS extra FROM z
), n AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE again) AS duplicate, count(*) FILTER (WHERE extra > 0) AS truncated,
         count(*) FILTER (WHERE b IS NOT NULL AND b || a NOT IN ('su', 'ua', 'au')) AS illegal FROM y GROUP BY c
), p AS (
  SELECT c, n + 1 AS i, {columns(lambda s: f"{{'k': '{ends[s][0]}', 't': {ends[s][1]}::VARCHAR[]}} AS v{s}")} FROM n
  UNION ALL
  SELECT c, i, {columns(lambda s: f"{least(f'b{s}', inserted('w', s))} AS v{s}")} FROM (
    SELECT *, {columns(lambda s: f"{least(f'b{s}', inserted('b', s))} AS w{s}")} FROM (
      SELECT p.c, p.i - 1 AS i, {columns(lambda s: f"{direct(s)} AS b{s}")} FROM p JOIN y ON y.c IS NOT DISTINCT FROM p.c AND y.i = p.i - 1))
)
SELECT o.c AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0.k[1:8]::BIGINT, 0) AS cost, coalesce(v0.k[9:], '') AS audit,
       sha256(coalesce(array_to_string(v0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT c FROM d) o LEFT JOIN n ON n.c IS NOT DISTINCT FROM o.c LEFT JOIN p ON p.c IS NOT DISTINCT FROM o.c AND p.i = 1
"""


ORACLE["op13_conversation_repair"] = _repair_sql()
