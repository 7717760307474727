"""The queries in DuckDB SQL."""

from __future__ import annotations

#: The library of references, as in ``queries.refs``.
REFS = """refs AS (
  SELECT 'ref-' || doc_id AS id,
    ['Journal Article','Book','Book Chapter','Conference Paper','Thesis','Report','Website','Preprint','Patent'][doc_id % 9 + 1] AS reference_type,
    string_split(text, chr(10))[1] AS title,
    list_transform(range(1, doc_id % 9 + 1), lambda i: coalesce(w[2*i-1], 'X') || CASE WHEN i % 2 = 1 THEN ' ' ELSE ', ' END || coalesce(w[2*i], 'X')) AS authors,
    replace(substr(text, length(string_split(text, chr(10))[1]) + 2), chr(10), ' ') AS abstract_text,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Journal of ' || source END AS journal, CASE WHEN doc_id % 11 = 0 THEN '' ELSE (doc_id % 45 + 1980)::VARCHAR END AS year,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE (doc_id % 40)::VARCHAR END AS volume, CASE WHEN doc_id % 4 = 0 THEN '' ELSE (doc_id % 12)::VARCHAR END AS issue,
    CASE WHEN doc_id % 6 = 0 THEN '' ELSE (doc_id % 300) || '-' || (doc_id % 300 + 9) END AS pages, CASE WHEN doc_id % 7 = 0 THEN 'Press ' || lang ELSE '' END AS publisher,
    CASE WHEN doc_id % 3 = 1 THEN '10.1000/X' || (doc_id % 400) ELSE '' END AS doi, '' AS pmid, CASE WHEN doc_id % 10 = 0 THEN '978' || lpad(doc_id::VARCHAR, 10, '0') ELSE '' END AS isbn, '' AS issn, '' AS url, lang AS language,
    CASE WHEN doc_id % 8 = 0 THEN 'note ' || source ELSE '' END AS notes, [lang, source] AS tags, coalesce(quality = 1, false) AS starred, coalesce(toxic = 1, false) AS read_status,
    strftime(DATE '2024-01-01' + (doc_id % 365)::INT, '%Y-%m-%d') AS date_added, doc_id
  FROM (SELECT *, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents LEFT JOIN labels USING (doc_id)))"""
COLLECTIONS = (
    "collections AS (SELECT source AS id, 'from ' || source AS name, list('ref-' || doc_id ORDER BY 'ref-' || doc_id) AS ref_ids "
    "FROM documents GROUP BY source)"
)
#: Authors with last and first names and initials, as lists of structs.
PARSED = REFS + """, parsed AS (SELECT *, list_transform(authors, lambda a: {'last': trim(CASE WHEN contains(a, ',') THEN string_split(a, ',')[1] ELSE string_split(a, ' ')[-1] END), 'first': trim(CASE WHEN contains(a, ',') THEN string_split(a, ',')[2] ELSE string_split(a, ' ')[1] END)}) AS p FROM refs)"""
MD = (
    "md AS (SELECT conv_id AS doc_id, '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('## ' || coalesce(role, '') || "
    "chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS md FROM conversations "
    "GROUP BY conv_id)"
)
#: Headings of the conversations: the document's, then one for each turn.
HEADS = (
    "heads AS (SELECT DISTINCT conv_id AS doc_id, 1::BIGINT AS pos, 1 AS level, 'Conversation ' || conv_id AS label FROM conversations "
    "UNION ALL SELECT conv_id, 1 + row_number() OVER (PARTITION BY conv_id ORDER BY turn), 2, substr(trim(coalesce(role, '')), 1, 60) "
    "FROM conversations)"
)
TURNS = (
    "turns AS (SELECT conv_id, turn, a, coalesce(lag(a) OVER (PARTITION BY conv_id ORDER BY turn), '') AS b "
    "FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g') AS a FROM conversations))"
)
SPANS = (
    "spans AS (SELECT l_orderkey AS doc_id, (l_linenumber % 2)::INT AS page, l_linenumber::BIGINT AS span_no, l_returnflag AS text, "
    "(l_partkey % 400)::DOUBLE AS x, (l_suppkey % 40)::DOUBLE AS y, (l_quantity * 2)::DOUBLE AS width, (8.0 + l_quantity % 4)::DOUBLE AS "
    "font_size, l_linestatus AS font_name FROM lineitem)"
)
GRAPH = """edges AS (SELECT n_regionkey AS graph_id, 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
nodes AS (SELECT DISTINCT graph_id, id, 'node ' || id AS label FROM (SELECT graph_id, src AS id FROM edges UNION ALL SELECT graph_id, dst FROM edges)),
walk(graph_id, id, rank) AS (SELECT graph_id, id, 0 FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.dst = n.id) UNION ALL SELECT w.graph_id, e.dst, w.rank + 1 FROM walk w JOIN edges e ON w.graph_id = e.graph_id AND w.id = e.src),
ranks AS (SELECT graph_id, id, max(rank) AS rank FROM walk GROUP BY 1, 2)"""
BOXES = GRAPH + """, sized AS (SELECT n.graph_id, n.id, r.rank, length(label) * 8.0 + 20 AS width, 40.0 AS height FROM nodes n JOIN ranks r ON n.graph_id = r.graph_id AND n.id = r.id),
boxes AS (SELECT s.graph_id, s.id, s.rank, coalesce(sum(s.width + 40.0) OVER (PARTITION BY s.graph_id, s.rank ORDER BY s.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS x, (s.rank * 100.0)::DOUBLE AS y, s.width::DOUBLE AS width, s.height::DOUBLE AS height FROM sized s)"""

ASCII_WORD = r"\b[-?a-zA-Z0-9_]+\b"
_documents = lambda value: f"SELECT doc_id, {value} AS value FROM documents"
_pages = lambda value: f"SELECT page_id, {value} AS value FROM pages"


def _replaced(x: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


_XML = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")]
_AUTO = [
    ("(tm)", "™"), ("...", "…"), ("(c)", "©"), ("(r)", "®"), ("<->", "↔"), ("1/2", "½"), ("1/4", "¼"), ("3/4", "¾"), ("--", "—"),
    ("->", "→"), ("<-", "←"), ("!=", "≠"), (">=", "≥"), ("<=", "≤")
]
_LATEX = (
    r"MAP {'&': '\&', '%': '\%', '$': '\$', '#': '\#', '_': '\_', '{': '\{', '}': '\}', '~': '\textasciitilde{}', '^': "
    r"'\textasciicircum{}', '\': '\textbackslash{}', '<': '\textless{}', '>': '\textgreater{}'}"
)

ORACLE = {
    "normalize_whitespace": _documents(r"trim(regexp_replace(text, '\s+', ' ', 'g'))"),
    "cleanup_markdown": _documents(
        (
            r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', "
            r"'', 'g')"
        )
    ),
    "strip_tags": _pages("regexp_replace(html, '<[^>]*(>|$)', '', 'g')"),
    "strip_jats": _pages("trim(regexp_replace(html, '<[^>]+>', '', 'g'))"),
    "xml_escape": _pages(_replaced("html", _XML)),
    "latex_escape": _documents(f"array_to_string(list_transform(string_split(text, ''), lambda c: coalesce(({_LATEX})[c], c)), '')"),
    "typst_escape": _documents(r"regexp_replace(text, '([#$@~_*])', '\\\1', 'g')"),
    "autocorrect": _documents(_replaced("text", _AUTO)),
    "redact": _documents("repeat('█', length(text))"),
    "find_doi": _documents(r"""regexp_replace(regexp_extract(text, '(10\.\d{4,9}/[^\s"<>]+)', 1), '[.,;)]+$', '')"""),
    "case_ops": (
        "SELECT doc_id, upper(substr(text, 1, 1)) || lower(substr(text, 2)) AS sentence, lower(text) AS lower, replace(upper(text), 'ẞ', "
        "'SS') AS upper, array_to_string(list_transform(regexp_extract_all(text, '[a-zA-Z0-9_][^\\t\\n\\f\\r ]*|[^a-zA-Z0-9_]'), lambda "
        "x: CASE WHEN regexp_matches(x, '^[a-zA-Z0-9_]') THEN upper(substr(x, 1, 1)) || lower(substr(x, 2)) ELSE x END), '') AS title, "
        "array_to_string(list_transform(string_split(text, ''), lambda c: CASE "
        "WHEN c = replace(upper(c), 'ẞ', 'SS') THEN lower(c) ELSE replace(upper(c), 'ẞ', 'SS') END), '') AS toggle FROM documents"
    ),
    "word_char_counts": (
        r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS n_words, length(text)::BIGINT "
        r"AS n_chars FROM documents"
    ),
    "readability": f"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '{ASCII_WORD}') AS w, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g')) <> ''))::BIGINT AS found FROM documents),
      b AS (SELECT doc_id, len(w)::BIGINT AS n_words, CASE WHEN found = 0 AND len(w) > 0 THEN 1 ELSE found END::BIGINT AS n_sentences, coalesce(list_sum(list_transform(w, lambda x: CASE WHEN length(x) <= 3 THEN 1 ELSE greatest(len(regexp_extract_all(regexp_replace(regexp_replace(lower(x), '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy]{{1,2}}')), 1) END)), 0)::BIGINT AS n_syllables FROM a)
      SELECT doc_id, n_words, n_sentences, n_syllables, CASE WHEN n_words > 0 AND n_sentences > 0 THEN greatest(206.835::DOUBLE - 1.015::DOUBLE * (n_words / n_sentences) - 84.6::DOUBLE * (n_syllables / n_words), 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS ease, CASE WHEN n_words > 0 AND n_sentences > 0 THEN greatest(0.39::DOUBLE * (n_words / n_sentences) + 11.8::DOUBLE * (n_syllables / n_words) - 15.59::DOUBLE, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS grade FROM b""",
    "authors_parsed": (
        f"WITH {PARSED}, e AS (SELECT id, unnest(p) AS a, generate_subscripts(p, 1) - 1 AS pos FROM parsed) "
        f"SELECT id, pos::INT AS pos, a.last AS last_name, a.first AS first_name, CASE "
        f"WHEN a.first = '' THEN '' ELSE substr(a.first, 1, 1) || '.' END AS initials FROM e"
    ),
    "find_regex": (
        "SELECT doc_id, len(regexp_extract_all(text, '(?i)[a-z]+tion'))::BIGINT AS n, array_to_string(regexp_extract_all(text, "
        "'(?i)[a-z]+tion'), '|') AS matches FROM documents"
    ),
    "replace_literal": _documents(r"regexp_replace(text, '(?i)the', '$1\\the', 'g')"),
    "font_families": "SELECT doc_id, ['Times New Roman', 'Arial', 'Calibri', 'Courier New', 'Georgia'][doc_id % 5 + 1] AS family FROM documents",
    "accept_reject_changes": (
        "SELECT conv_id, turn, role || ' ' || coalesce(text, '') || ' ' AS accepted, ' ' || coalesce(text, '') || ' ' || role AS "
        "rejected FROM conversations"
    ),
    "attribute_blocks": "SELECT doc_id, lang || ',s' AS classes, source AS attr_id FROM documents",
    "library_search": (
        f"WITH {REFS} SELECT id, title, year FROM refs WHERE contains(lower(concat_ws(' ', title, array_to_string(authors, ' '), year, "
        f"journal, doi, pmid, isbn, array_to_string(tags, ' '), notes)), 'tion')"
    ),
    "library_filters": (
        f"WITH {REFS} SELECT 'starred' AS filter_name, id FROM refs WHERE starred UNION ALL SELECT 'unread', id FROM refs "
        f"WHERE NOT read_status UNION ALL SELECT 'thesis', id FROM refs WHERE reference_type = 'Thesis' UNION ALL SELECT 'recent', id "
        f"FROM refs WHERE DATE '2024-12-31' - date_added::DATE < 30"
    ),
    "collection_members": f"WITH {REFS} SELECT id, title FROM refs WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src7')",
    "citation_pickers": (
        f"WITH {REFS} SELECT 'citation' AS picker, id FROM refs WHERE contains(lower(title), '199') OR "
        f"contains(lower(array_to_string(authors, ', ')), '199') OR contains(year, '199') UNION ALL SELECT 'source', id FROM refs "
        f"WHERE contains(lower(array_to_string(authors, ', ') || title || year), '199')"
    ),
    "legacy_append": (
        f"WITH {REFS} SELECT id, title FROM refs UNION ALL SELECT 'ref-' || doc_id * 2, 'legacy' FROM documents "
        f"WHERE 'ref-' || doc_id * 2 NOT IN (SELECT id FROM refs)"
    ),
    "nav_counts": (
        f"WITH {REFS} SELECT count(*) AS n_all, count(*) FILTER (WHERE starred) AS n_starred, count(*) FILTER (WHERE NOT read_status) AS "
        f"n_unread FROM refs"
    ),
    "collection_sizes": f"WITH {COLLECTIONS} SELECT id, name, len(ref_ids)::BIGINT AS n_refs FROM collections",
    "term_index": "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS term FROM documents) GROUP BY term",
    "dedup_first_seen": f"WITH {REFS} SELECT id, doi FROM refs QUALIFY doi = '' OR row_number() OVER (PARTITION BY lower(trim(doi)) ORDER BY doc_id) = 1",
    "library_sorted": f"WITH {REFS} SELECT id, coalesce(authors[1], '') AS first_author FROM refs",
    "csl_sorted_top": (
        f"WITH {REFS} SELECT id, year, title FROM refs ORDER BY nullif(year, '') DESC NULLS LAST, nullif(lower(title), '') ASC NULLS "
        f"FIRST, id LIMIT 50"
    ),
    "lww_merge": """WITH o AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date_modified, o_totalprice AS price, o_orderpriority AS p FROM orders),
      a AS (SELECT id, 'local' AS origin, date_modified, price FROM o WHERE p < '4'), b AS (SELECT id, 'remote' AS origin, CASE WHEN price > 100000 THEN '9999-01-01' ELSE date_modified END AS date_modified, price FROM o WHERE p > '2'),
      u AS (SELECT *, 0 AS k FROM a UNION ALL SELECT *, 1 FROM b) SELECT id, origin, date_modified, price FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY date_modified DESC, k) = 1""",
    "collection_union": (
        f"WITH {COLLECTIONS}, r AS (SELECT 'src' || doc_id % 30 AS id, 'remote' AS name, list('ref-' || doc_id) AS ref_ids FROM documents "
        f"GROUP BY 1) SELECT coalesce(c.id, r.id) AS id, coalesce(c.name, r.name) AS name, "
        f"array_to_string(list_sort(list_distinct(list_concat(coalesce(c.ref_ids, []), coalesce(r.ref_ids, [])))), ',') AS ref_ids "
        f"FROM collections c FULL JOIN r ON c.id = r.id"
    ),
    "resolve_citations": (
        f"WITH {REFS}, f AS (SELECT user_id AS doc_id, 'ref-' || event_id % 3000 AS ref_id, min(event_id) AS first FROM events "
        f"GROUP BY 1, 2), n AS (SELECT doc_id, ref_id, row_number() OVER (PARTITION BY doc_id ORDER BY first, ref_id) AS number FROM f) "
        f"SELECT n.doc_id, number, ref_id, title FROM n JOIN refs ON refs.id = n.ref_id"
    ),
    "update_from_web": f"WITH {REFS} SELECT id, CASE WHEN starred THEN replace(upper(title), 'ẞ', 'SS') ELSE title END AS title, notes, year FROM refs",
    "recent_files": "SELECT event_type || '/' || user_id AS name, max(event_id) AS event_id FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "latest_version": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1",
    "type_badges": (
        f"WITH {REFS} SELECT id, CASE reference_type WHEN 'Journal Article' THEN 'journal' WHEN 'Book' THEN 'book' "
        f"WHEN 'Book Chapter' THEN 'book' WHEN 'Conference Paper' THEN 'conf' WHEN 'Thesis' THEN 'thesis' "
        f"WHEN 'Preprint' THEN 'preprint' ELSE 'other' END AS css, ['J','B','B','C','T','R','W','P','P'][doc_id % 9 + 1] AS letter, "
        f"array_to_string(authors[1:2], ', ') || CASE WHEN len(authors) > 2 THEN ' et al.' ELSE '' END AS authors FROM refs"
    ),
    "cite_apa": f"""WITH {PARSED}, f AS (SELECT *, list_transform(p, lambda a: a.last || ', ' || CASE WHEN a.first = '' THEN '' ELSE substr(a.first, 1, 1) || '.' END) AS f FROM parsed) SELECT id, trim(
      CASE WHEN len(f) = 0 THEN '' WHEN len(f) = 1 THEN f[1] WHEN len(f) <= 7 THEN array_to_string(f[1:len(f)-1], ', ') || ', & ' || f[-1] ELSE array_to_string(f[1:6], ', ') || ', ... ' || f[-1] END
      || ' (' || CASE WHEN year = '' THEN 'n.d.' ELSE year END || ').  ' || title || '. ' || CASE WHEN journal = '' THEN '' ELSE ' *' || journal || '*' || CASE WHEN volume = '' THEN '' WHEN issue = '' THEN ', *' || volume || '*' ELSE ', *' || volume || '*(' || issue || ')' END || CASE WHEN pages = '' THEN '' ELSE ', ' || pages END || '.' END || CASE WHEN doi = '' THEN '' ELSE ' https://doi.org/' || doi END) AS citation FROM f""",
    "cite_mla": f"""WITH {PARSED}, f AS (SELECT *, CASE WHEN p[1].first = '' THEN p[1].last ELSE p[1].last || ', ' || p[1].first END AS a1 FROM parsed) SELECT id, trim(
      CASE WHEN len(p) = 0 THEN '' WHEN len(p) = 1 THEN CASE WHEN a1 = '' THEN '' ELSE a1 || '.' END ELSE a1 || ', et al..' END || ' "' || title || '" *' || journal || '*, ' || CASE WHEN volume = '' THEN '' ELSE 'vol. ' || volume || ', ' END || CASE WHEN issue = '' THEN '' ELSE 'no. ' || issue || ', ' END || year || ', ' || CASE WHEN pages = '' THEN '' ELSE 'pp. ' || pages END || CASE WHEN doi = '' THEN '' ELSE ', doi:' || doi END || '.') AS citation FROM f""",
    "cite_chicago": f"""WITH {PARSED} SELECT id, trim(
      CASE WHEN len(p) = 0 THEN '' WHEN len(p) = 1 THEN CASE WHEN p[1].first = '' THEN p[1].last ELSE p[1].last || ', ' || p[1].first END ELSE p[1].last || ', ' || p[1].first || ', and ' || array_to_string(list_transform(p[2:], lambda a: CASE WHEN a.first = '' THEN a.last ELSE a.first || ' ' || a.last END), ', and ') END
      || ' ' || year || ' "' || title || '" *' || journal || '*' || CASE WHEN volume = '' THEN '' WHEN issue = '' THEN ' ' || volume ELSE ' ' || volume || ' (' || issue || ')' END || CASE WHEN pages = '' THEN '' ELSE ': ' || pages END || '.' || CASE WHEN doi = '' THEN '' ELSE ' https://doi.org/' || doi END) AS citation FROM parsed""",
    "cite_vancouver": f"""WITH {PARSED}, f AS (SELECT *, list_transform(p, lambda a: a.last || ' ' || substr(a.first, 1, 1)) AS f FROM parsed) SELECT id, trim(
      CASE WHEN len(f) > 6 THEN array_to_string(f[1:6], ', ') || ', et al.' ELSE array_to_string(f, ', ') END || '. ' || title || '. ' || journal || '. ' || CASE WHEN volume = '' THEN year WHEN issue = '' THEN year || ';' || volume ELSE year || ';' || volume || '(' || issue || ')' END || CASE WHEN pages = '' THEN '' ELSE ':' || pages END || '.') AS citation FROM f""",
    "cite_ieee": f"""WITH {PARSED}, f AS (SELECT *, list_transform(p, lambda a: CASE WHEN a.first = '' THEN '' ELSE substr(a.first, 1, 1) || '.' END || ' ' || a.last) AS f FROM parsed) SELECT id, trim(
      CASE WHEN len(f) = 0 THEN '' WHEN len(f) = 1 THEN f[1] WHEN len(f) = 2 THEN f[1] || ' and ' || f[2] ELSE f[1] || ' et al.' END || ', "' || title || '", *' || journal || '*' || CASE WHEN volume = '' THEN '' ELSE ', vol. ' || volume END || CASE WHEN issue = '' THEN '' ELSE ', no. ' || issue END || CASE WHEN pages = '' THEN '' ELSE ', pp. ' || pages END || ', ' || year || CASE WHEN doi = '' THEN '' ELSE ', doi: ' || doi END) AS citation FROM f""",
    "export_ris": f"""WITH {REFS} SELECT id, 'TY  - ' || ['JOUR','BOOK','CHAP','CONF','THES','RPRT','ELEC','JOUR','GEN'][doc_id % 9 + 1] || chr(10) || 'T1  - ' || title || chr(10) || array_to_string(list_transform(authors, lambda a: 'AU  - ' || a || chr(10)), '')
      || {" || ".join(f"CASE WHEN {c} = '' THEN '' ELSE '{t}  - ' || {c} || chr(10) END" for t, c in (("AB", "abstract_text"), ("JO", "journal"), ("PY", "year"), ("VL", "volume"), ("IS", "issue"), ("SP", "pages"), ("PB", "publisher"), ("DO", "doi"), ("SN", "isbn"), ("LA", "language")))}
      || array_to_string(list_transform(tags, lambda a: 'KW  - ' || a || chr(10)), '') || CASE WHEN notes = '' THEN '' ELSE 'N1  - ' || notes || chr(10) END || 'ER  - ' || chr(10) || chr(10) AS record FROM refs""",
    "export_bibtex": f"""WITH {REFS} SELECT id, '@' || ['article','book','incollection','inproceedings','phdthesis','techreport','misc','misc','misc'][doc_id % 9 + 1] || '{{' || regexp_replace(trim(string_split(coalesce(authors[1], 'Unknown'), ',')[1]), '[^\\p{{L}}\\p{{N}}]', '', 'g') || year || ',' || chr(10) || '  title     = {{' || title || '}},' || chr(10)
      || {" || ".join(f"CASE WHEN {c} = '' THEN '' ELSE '  {n:<9} = {{{{' || {v} || '}}}},' || chr(10) END" for n, c, v in (("author", "array_to_string(authors, ' and ')", "array_to_string(authors, ' and ')"), ("journal", "journal", "journal"), ("year", "year", "year"), ("volume", "volume", "volume"), ("number", "issue", "issue"), ("pages", "pages", "replace(pages, '-', '--')"), ("publisher", "publisher", "publisher"), ("doi", "doi", "doi"), ("isbn", "isbn", "isbn"), ("abstract", "abstract_text", "abstract_text"), ("keywords", "array_to_string(tags, ', ')", "array_to_string(tags, ', ')"))).replace("{{", "{").replace("}}", "}")} || '}}' || chr(10) || chr(10) AS entry FROM refs""",
    "csl_style": (
        f"WITH {PARSED}, f AS (SELECT *, list_transform(p, lambda a: a.last || CASE "
        f"WHEN a.first = '' THEN '' ELSE ', ' || substr(a.first, 1, 1) || '.' END) AS f FROM parsed) "
        f"SELECT id, concat_ws('. ', nullif(CASE WHEN len(f) > 1 THEN array_to_string(f[1:len(f)-1], ', ') || ' & ' || f[-1] ELSE "
        f"array_to_string(f, '') END, ''), nullif(title, ''), CASE WHEN journal = '' THEN 'no journal' ELSE journal END, CASE "
        f"WHEN year = '' THEN NULL ELSE '(' || year || ')' END) || '.' AS citation FROM f"
    ),
    "ris_round_trip": (
        f"WITH {REFS} SELECT id, CASE doc_id % 9 WHEN 7 THEN 'Journal Article' "
        f"WHEN 8 THEN 'Journal Article' ELSE reference_type END AS reference_type, trim(title) AS title, "
        f"array_to_string(list_transform(authors, lambda a: trim(a)), '|') AS authors, journal, year, doi, pages, array_to_string(tags, "
        f"'|') AS tags FROM refs"
    ),
    "bibtex_round_trip": (
        f"WITH {REFS} SELECT id, CASE WHEN doc_id % 9 >= 6 THEN 'Other' ELSE reference_type END AS reference_type, "
        f"array_to_string(list_filter(list_transform(string_split(array_to_string(authors, ' and '), ' and '), lambda a: trim(a)), lambda "
        f"a: a <> ''), '|') AS authors, year, doi, pages FROM refs"
    ),
    "bibliography_entries": (
        f"WITH {REFS} SELECT id, concat_ws('. ', nullif(array_to_string(authors, ', '), ''), nullif(title, ''), nullif(journal, ''), "
        f"nullif(year, '')) || '.' AS entry FROM refs"
    ),
    "page_metadata": (
        "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, '' AS authors, '' AS journal, '' AS "
        "year, '' AS doi FROM pages"
    ),
    "template_substitution": "SELECT c_custkey, 'Dear ' || c_name || ' of {{name}}' || c_mktsegment || ', {{open' AS value FROM customer",
    "text_similarity": (
        rf"WITH {TURNS}, n AS (SELECT conv_id, turn, trim(regexp_replace(a, '\s+', ' ', 'g')) AS a, trim(regexp_replace(b, '\s+', ' ', "
        rf"'g')) AS b FROM turns) SELECT conv_id, turn, round(CASE WHEN length(a) = 0 AND length(b) = 0 THEN 1.0::DOUBLE "
        rf"WHEN length(a) = 0 OR length(b) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(a, b) / greatest(length(a), length(b)) END, "
        rf"9) AS similarity FROM n"
    ),
    "jaro_winkler": (
        f"WITH {TURNS}, j AS (SELECT conv_id, turn, a, b, jaro_similarity(a, b) AS j, list_sum([CASE "
        f"WHEN substr(a, 1, k) = substr(b, 1, k) AND least(length(a), length(b)) >= k THEN 1 ELSE 0 END for k in [1, 2, 3, 4]]) AS p "
        f"FROM turns) SELECT conv_id, turn, round(CASE WHEN a = b THEN 1.0::DOUBLE "
        f"WHEN j > 0.7 THEN j + 0.1::DOUBLE * p * (1 - j) ELSE j END, 9) AS similarity FROM j"
    ),
    "section_starts": (
        "SELECT conv_id, turn, role, row_number() OVER w = 1 OR lag(role) OVER w IS DISTINCT FROM role AS starts "
        "FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"
    ),
    "run_islands": (
        "WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS DISTINCT "
        "FROM event_type AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id "
        "ORDER BY event_id)), b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a) "
        "SELECT user_id, run::BIGINT AS run, event_type, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM b "
        "GROUP BY 1, 2, 3"
    ),
    "mindmap_parents": (
        "WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) % 4 AS level FROM conversations) "
        "SELECT a.conv_id, a.turn, (SELECT max(b.turn) FROM t b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.level < a.level) "
        "AS parent_turn, (a.level - coalesce(lag(a.level) OVER (PARTITION BY a.conv_id ORDER BY a.turn), 0))::BIGINT AS depth_step "
        "FROM t a"
    ),
    "share_of_total": (
        "SELECT o_orderstatus, o_orderpriority, round(count(*) / greatest(sum(count(*)) OVER (PARTITION BY o_orderstatus), 1), "
        "9)::DOUBLE AS share FROM orders GROUP BY 1, 2"
    ),
    "bar_scale": (
        "SELECT l_orderkey, max(l_linenumber + l_quantity::BIGINT)::BIGINT AS max_end, round(400.0::DOUBLE / greatest(max(l_linenumber + "
        "l_quantity::BIGINT), 1), 9) AS scale FROM lineitem GROUP BY 1"
    ),
    "mode_font_size": f"WITH {SPANS} SELECT doc_id, round(font_size * 2) / 2 AS font_size FROM spans WHERE font_size >= 6 GROUP BY doc_id, round(font_size * 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, round(font_size * 2)) = 1".replace(
        "round(font_size * 2) / 2 AS", "any_value(round(font_size * 2) / 2) AS"
    ),
    "body_font": (
        f"WITH {SPANS} SELECT doc_id, font_name FROM spans GROUP BY doc_id, font_name QUALIFY row_number() OVER (PARTITION BY doc_id "
        f"ORDER BY sum(strlen(text)) DESC, font_name) = 1"
    ),
    "page_bounds": (
        f"WITH {SPANS} SELECT doc_id, page, max(x + width) AS right_end, min(min(x)) OVER (PARTITION BY doc_id) AS left_end FROM spans "
        f"GROUP BY doc_id, page"
    ),
    "rect_overlap": (
        f"WITH {SPANS} SELECT a.doc_id, a.page, a.span_no AS a_no, b.span_no AS b_no FROM spans a "
        f"JOIN spans b ON a.doc_id = b.doc_id AND a.page = b.page AND a.span_no < b.span_no "
        f"WHERE a.x < b.x + b.width AND a.x + a.width > b.x AND a.y < b.y + b.font_size AND a.y + a.font_size > b.y"
    ),
    "rank_longest_path": f"WITH RECURSIVE {GRAPH} SELECT graph_id, id, rank::BIGINT AS node_rank FROM ranks",
    "layout_boxes": f"WITH RECURSIVE {BOXES} SELECT graph_id, id, x, y, width, height FROM boxes",
    "in_degrees": (
        f"WITH RECURSIVE {GRAPH} SELECT n.graph_id, n.id, (SELECT count(*) FROM edges e "
        f"WHERE e.graph_id = n.graph_id AND e.dst = n.id) AS n_in FROM nodes n"
    ),
    "flowchart_edges": f"WITH RECURSIVE {GRAPH} SELECT graph_id, src, dst, 'solid' AS style, dst AS label FROM edges",
    "conversation_outline": f"WITH {HEADS} SELECT doc_id, pos, level, label FROM heads",
    "table_of_contents": f"WITH {HEADS} SELECT doc_id, pos, level, CASE WHEN pos <= 2 THEN '<ul>' ELSE '' END || '<li>' || label || '</li>' AS html FROM heads",
    "slides": f"WITH {HEADS} SELECT doc_id, pos AS slide, label AS title FROM heads",
    "chapters": "SELECT DISTINCT conv_id AS doc_id, 1::BIGINT AS chapter, 'Conversation ' || conv_id AS title FROM conversations",
    "cross_references": f"WITH {HEADS} SELECT doc_id, 'heading' AS kind, pos AS n, label FROM heads",
}

_UNIT = lambda n: rf"'\u' || (CASE WHEN {n} > 32767 THEN {n} - 65536 ELSE {n} END) || '?'"
_HIGH, _LOW = "(((unicode(c) - 65536) // 1024) + 55296)", "((unicode(c) - 65536) % 1024 + 56320)"
_BARE = r"regexp_replace(regexp_extract(w, '((?:https?://|www\.)[^<]*)', 1), '[^\p{L}\p{N}/]+$', '')"
_OF = lambda n: f"SELECT s_nationkey AS chart_id, {n} FROM supplier"
_NAMED = "array_to_string(list_transform(p, lambda a: a.last), '|') AS authors"
_FRONT = "chr(10) || '--- ' || chr(10) || 'title: ' || source || chr(10) || 'lang: ' || lang"

ORACLE |= {
    "rtf_escape": _documents(
        rf"array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c IN ('\', '{{', '}}') THEN '\' || c WHEN c = chr(10) THEN '\line ' WHEN unicode(c) < 128 THEN c "
        rf"WHEN unicode(c) < 65536 THEN {_UNIT('unicode(c)')} ELSE {_UNIT(_HIGH)} || {_UNIT(_LOW)} END), '')"
    ),
    "auto_link": rf"""SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: CASE WHEN {_BARE} = '' OR contains(w, '<a href') THEN w
      ELSE replace(w, {_BARE}, '<a href="' || CASE WHEN starts_with({_BARE}, 'www.') THEN 'https://' ELSE '' END || {_BARE} || '">' || {_BARE} || '</a>') END), ' ') AS value FROM documents""",
    "bullets_and_titles": r"""WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
      l AS (SELECT doc_id, line_no::INT AS line_no, CASE line_no % 6 WHEN 1 THEN '• ' || raw WHEN 4 THEN '12. ' || raw ELSE raw END AS line FROM r),
      b AS (SELECT *, regexp_matches(line, '^[•●▪◆]') AS sign, regexp_extract(line, '^([0-9]+)\. ', 1) AS n, list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '') AS w FROM l)
      SELECT doc_id, line_no, sign OR n <> '' AS is_item, CASE WHEN NOT sign AND n <> '' THEN n || '.' END AS item_number,
        CASE WHEN sign THEN trim(substr(line, 2)) WHEN n <> '' THEN regexp_replace(line, '^[0-9]+\. ', '') ELSE line END AS rest,
        len(w) BETWEEN 1 AND 7 AND NOT regexp_matches(line, '[.,:]$')
          AND len(list_filter(w, lambda x: NOT ((strlen(x) <= 3 AND regexp_matches(x, '^\p{Ll}')) OR regexp_matches(x, '^(?:\p{Lu}|\P{L})')))) = 0 AS is_title FROM b""",
    "lengths_in_twips": """SELECT p_partkey, round((p_size + 0.5::DOUBLE) * [1440 / 25.4::DOUBLE, 1440 / 2.54::DOUBLE, 1440.0::DOUBLE, 20.0::DOUBLE, 15.0::DOUBLE, NULL][p_partkey % 6 + 1])::BIGINT AS twips FROM part""",
    "file_stems": "SELECT doc_id, regexp_replace(source, '[^a-zA-Z0-9_-]', '_', 'g') || '_é_' || doc_id || '__v2' AS stem FROM documents",
    "css_values": "SELECT p_partkey, p_size || 'px' AS margin, 'red' AS color, 'blue' AS background_color, '' AS width, 'n' || p_size AS tag_id FROM part",
    "colours": "SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"round((1 - ({c} % {m}) / {m}::DOUBLE) * (1 - (l_linenumber % 9) / 9::DOUBLE), 9) AS {n}" for n, c,
        m in (("r", "l_partkey", 7), ("g", "l_suppkey", 5), ("b", "l_orderkey", 11))
    )
    + " FROM lineitem",
    "front_matter": rf"""WITH m AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' || {_FRONT} || chr(10) || '---' || chr(10) || text WHEN 2 THEN {_FRONT} || replace(text, '-', '+') ELSE text END AS other, text, source, lang FROM documents)
      SELECT doc_id, CASE WHEN other IS NULL THEN 'title: ' || source || chr(10) || 'lang: ' || lang END AS front, sha256(coalesce(other, regexp_replace(text, '^[\r\n]+', ''))) AS body_sha256 FROM m""",
    "without_media": r"""SELECT doc_id, regexp_replace(regexp_replace(' <i>x</i>' || chr(10) || replace(text, '`', chr(39)), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '<[^>]*(>|$)', '', 'g') AS value FROM documents""",
    "comments": (
        "SELECT doc_id, k || doc_id AS comment_id, lang AS author, 'see ' || source AS body, source || chr(10) || '!' AS anchor "
        "FROM documents, (VALUES ('c'), ('d')) AS v(k)"
    ),
    "pruned_comments": "SELECT doc_id, source AS comment_id FROM documents WHERE doc_id % 3 = 0",
    "lines_sorted": (
        "SELECT doc_id, sha256(array_to_string(list_sort(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')), chr(10))) "
        "AS lines_sha256 FROM documents"
    ),
    "pie_slices": _OF("s_name AS label, s_suppkey + 0.5::DOUBLE AS value"),
    "sequence_messages": _OF(
        (
            "'N' || s_nationkey AS src, CASE WHEN s_suppkey % 2 = 0 THEN '->>' ELSE '-->>' END AS arrow, 'S' || s_suppkey AS dst, s_name "
            "AS text, 0 AS step"
        )
    )
    + " UNION ALL "
    + _OF("'S' || s_suppkey, '', '', '', 1"),
    "gantt_tasks": _OF(
        (
            "'T' || s_suppkey % 3 AS section, s_name AS task, (s_suppkey % 40 - min(s_suppkey % 40) OVER (PARTITION BY "
            "s_nationkey))::INT AS start, s_suppkey::INT AS length"
        )
    ),
    "timeline_events": _OF("'P' || s_suppkey AS period, 'first' AS event")
    + "".join(" UNION ALL " + _OF(f"CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::VARCHAR ELSE 'P' || s_suppkey END, {e}") for e in ("s_name", "'again'")),
    "journey_tasks": _OF(
        (
            "'S' || s_suppkey AS section, s_name AS task, (s_suppkey % 5)::INT AS score, CASE "
            "WHEN s_suppkey % 2 = 0 THEN 'Me|You' ELSE '' END AS actors"
        )
    ),
    "state_transitions": _OF(
        (
            "CASE WHEN s_suppkey % 4 = 0 THEN '[*]' ELSE 'S' || s_suppkey END AS src, 'T' || s_nationkey AS dst, CASE "
            "WHEN s_suppkey % 2 = 0 THEN 'go on' ELSE '' END AS label"
        )
    ),
    "class_relations": _OF(
        (
            "'N' || s_nationkey AS src, ['<|--', '*--', 'o--', '-->', '..>'][s_suppkey % 5 + 1] AS arrow, 'S' || s_suppkey AS dst, 'has' "
            "AS label"
        )
    ),
    "mindmap_lines": _OF("(s_suppkey % 4)::INT AS level, s_name AS label"),
    "styles_of_nodes": """WITH u AS (SELECT s_nationkey AS graph_id, s_suppkey AS k, unnest(['A', 'B' || s_suppkey % 3]) AS node FROM supplier)
      SELECT graph_id, node, p AS property, CASE p WHEN 'fill' THEN '#f' || max(k) ELSE 'red' END AS value FROM u, (VALUES ('fill'), ('stroke')) AS v(p) GROUP BY 1, 2, 3""",
    "graph_nodes": """SELECT user_id AS graph_id, event_type AS id, min(event_id) AS ord, min_by('s' || event_id % 5, event_id) FILTER (WHERE event_id % 4 = 0) AS shape,
      coalesce(min_by(event_type || ' ' || event_id % 7, event_id) FILTER (WHERE event_id % 3 = 0), event_type) AS label FROM events GROUP BY 1, 2""",
    "subgraph_frames": """WITH b AS (SELECT n_name AS nation, r_name AS region, (s_suppkey % 97)::DOUBLE AS x, (s_suppkey % 53)::DOUBLE AS y, s_suppkey % 11 + 1.0::DOUBLE AS w
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
      SELECT 0 AS graph_id, nation AS subgraph, min(x) - 20 AS llx, min(y) - 20 AS lly, max(x + w) + 20 AS urx, max(y) + 24 AS ury FROM b GROUP BY nation
      UNION ALL SELECT 0, region, min(x) - 40, min(y) - 40, max(x + w) + 40, max(y) + 44 FROM b GROUP BY region""",
    "crossref_references": f"""WITH {PARSED} SELECT id, title, journal, volume, issue, pages, publisher, doi, language, year,
      array_to_string(list_transform(p, lambda a: a.last || ', ' || a.first), '|') AS authors, tags[2] AS abstract_text FROM parsed""",
    "pubmed_references": (
        f"WITH {PARSED} SELECT id, title, journal, volume, issue, pages, CASE WHEN year = '' THEN 'Mar' ELSE year END AS year, {_NAMED} "
        f"FROM parsed"
    ),
    "open_library_references": f"WITH {PARSED} SELECT id, title, publisher, year, isbn, 'Book' AS reference_type, {_NAMED} FROM parsed",
    "arxiv_references": (
        f"WITH {REFS} SELECT id, language || ' paper' AS title, doi AS abstract_text, substr(date_added, 1, 4) AS year, 'arXiv' AS "
        f"journal, array_to_string(tags, '|') AS authors FROM refs"
    ),
    "activations": """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS step FROM events), d AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM e),
      k AS (SELECT *, CASE WHEN step > 0 THEN s ELSE s + 1 END AS depth FROM d), f AS (SELECT * FROM k WHERE depth > 0), l AS (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS last_kept FROM f)
      SELECT user_id, depth::BIGINT AS depth, event_id AS start_id, coalesce((SELECT min(c.event_id) FROM f c WHERE c.user_id = l.user_id AND c.depth = l.depth AND c.event_id > l.event_id AND c.step < 0), last_kept) AS end_id
      FROM l WHERE step > 0""",
    "edge_paths": f"""WITH RECURSIVE {BOXES}, p AS (SELECT e.graph_id, e.src, e.dst, a.x + a.width / 2 AS x1, a.y + a.height AS y1, b.x + b.width / 2 AS x2, b.y AS y2
        FROM edges e JOIN boxes a ON a.graph_id = e.graph_id AND a.id = e.src JOIN boxes b ON b.graph_id = e.graph_id AND b.id = e.dst)
      SELECT graph_id, src, dst, printf('%.1f,%.1f ', x1, y1) || CASE WHEN x1 = x2 THEN '' ELSE printf('%.1f,%.1f %.1f,%.1f ', x1, (y1 + y2) / 2, x2, (y1 + y2) / 2) END || printf('%.1f,%.1f', x2, y2) AS path FROM p""",
    "text_under_marks": f"""WITH {SPANS}, q AS (SELECT *, doc_id || '-' || page AS p FROM spans),
      h AS (SELECT DISTINCT p, v.k, span_no, 'n' || span_no AS t FROM q, (VALUES (0), (1)) AS v(k) WHERE x < v.k * 250 + 200 AND x + width > v.k * 250 AND y < 30 AND y + font_size > 0),
      g AS (SELECT p, k, string_agg(t, '' ORDER BY span_no) AS t FROM h GROUP BY p, k) SELECT p AS annotation_id, string_agg(t, ' ' ORDER BY k) AS text FROM g GROUP BY p""",
    "spans_ruled": (
        f"WITH {SPANS} SELECT concat_ws('-', doc_id, span_no, x::INT, y::INT, width::INT) AS page, doc_id % 3 = 0 AND width > 0 AS "
        f"underline, doc_id % 3 <> 0 AND doc_id % 5 = 0 AND width > 0 AS strike FROM spans"
    ),
}

VARIED = """v AS (SELECT conv_id AS doc_id, turn, turn % 5 AS k FROM conversations),
heads AS (SELECT doc_id, turn, CASE k WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 1 END AS level, CASE k WHEN 1 THEN 'A' || turn WHEN 2 THEN 'C' || turn WHEN 3 THEN 'B' || turn || ' & co' ELSE '' END AS label,
  row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS pos FROM v WHERE k > 0)"""
#: How often each kind of part adds to a counter: (kind, times).
_VARIED_COUNTS = {
    "headings": ((1, 1), (2, 1), (3, 1), (4, 1)), "unordered_items": ((2, 2),), "ordered_items": ((2, 1),), "code_blocks": ((3, 1),),
    "table_rows": ((0, 2),), "tables": ((0, 1),), "blockquotes": ((3, 1),),
    "math_blocks": (), "inline_math": ((3, 1),), "bold": ((1, 1),), "italic": ((0, 1), (1, 1)), "strikethrough": (),
    "hyperlinks": ((1, 1),), "footnotes": ((3, 2),), "tasklists": (), "images": ((1, 1),),
    "comments": (), "highlights": (), "insertions": (), "deletions": (),
}
_MERGE_EVENTS = """(0, 'start', ''), (1, 'text', 'Dear ' || c_name), (2, 'end', ''), (3, 'start', ''), (4, 'text', 'Your balance is ' || c_acctbal || ', segment ' || c_mktsegment || ' {{open'), (5, 'end', ''),
  (6, 'start', ''), (7, 'start', ''), (8, 'text', 'site'), (9, 'end', ''), (10, 'text', ' '), (11, 'code', '{{ c_name }}'), (12, 'end', '')"""
_COMMAND_EVENTS = """(0, 'start', '', 'h', ''), (1, 'text', 'Hi ' || c_name, '', ''), (2, 'end', '', '', ''), (3, 'start', '', '', ''), (4, 'start', '', '', 'h'), (5, 'text', 'y', '', ''), (6, 'end', '', '', ''),
  (7, 'text', ' ' || c_name, '', ''), (8, 'end', '', '', '')"""
_PIECES = lambda p: f"regexp_split_to_array(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS m"
_LENGTHS = lambda list_, n: f"coalesce(list_sum(list_transform(list_slice({list_}, 1, {n}), lambda x: length(x))), 0)"


def _found(rules: list[tuple[str, ...]], names: tuple[str, ...]) -> str:
    """Every match of each rule's pattern, and the code points before it."""
    per_rule = (
        f"SELECT doc_id, {_PIECES(p)}, " + ", ".join(
            f"'{v}' AS \"{n}\"" for n, v in zip(names, values, strict=True)
        ) + " FROM documents" for p,
        *values in rules
    )
    listed = ", ".join(f'"{n}"' for n in names)
    return f"""WITH r AS ({" UNION ALL ".join(per_rule)}), k AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM r)
      SELECT doc_id, m[i] AS matched, ({_LENGTHS("g", "i")} + {_LENGTHS("m", "i - 1")})::BIGINT AS at, {listed} FROM k"""


ORACLE |= {
    "varied_metrics": f"WITH {VARIED} SELECT doc_id, " + ", ".join(
        f"({' + '.join(f'{n} * count(*) FILTER (k = {k})' for k, n in parts) or '0'})::BIGINT AS {name}" for name,
        parts in _VARIED_COUNTS.items()
    ) + " FROM v GROUP BY doc_id",
    "varied_outline": f"WITH {VARIED} SELECT doc_id, pos, level, label FROM heads",
    "varied_contents": f"""WITH {VARIED}, d AS (SELECT *, level - coalesce(lag(level) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS step FROM heads)
      SELECT doc_id, pos, level, repeat('<ul>', greatest(step, 0)) || repeat('</ul>', greatest(-step, 0)) || '<li>' || replace(label, '&', '&amp;') || '</li>' AS html FROM d""",
    "varied_chapters": f"""WITH {VARIED}, c AS (SELECT doc_id, turn, CASE k WHEN 0 THEN 'Content' WHEN 1 THEN 'A' || turn END AS title FROM v WHERE turn = 0 OR k IN (1, 4)),
      n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS chapter FROM c) SELECT doc_id, chapter, coalesce(title, 'Chapter ' || chapter) AS title FROM n""",
    "varied_slides": f"""WITH {VARIED} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS slide,
      CASE k WHEN 1 THEN 'A' || turn WHEN 3 THEN 'B' || turn || ' & co' ELSE '' END AS title FROM v WHERE k <> 2""",
    "varied_references": f"""WITH {VARIED}, o AS (SELECT doc_id, 'heading' AS kind, turn, label FROM heads UNION ALL SELECT doc_id, 'figure', turn, 'p' FROM v WHERE k = 1 UNION ALL SELECT doc_id, 'table', turn, '' FROM v WHERE k = 0
        UNION ALL SELECT doc_id, 'footnote', turn, 'f' || turn FROM v WHERE k = 3 UNION ALL SELECT doc_id, 'bookmark', turn, 'm' || turn FROM v WHERE k = 3)
      SELECT doc_id, kind, row_number() OVER (PARTITION BY doc_id, kind ORDER BY turn) AS n, label FROM o""",
    "footnotes_resolved": f"WITH {VARIED} SELECT doc_id, 'f' || turn AS label, 'note ' || turn AS text FROM v WHERE k = 3",
    "mail_merge": (
        f"SELECT c_custkey AS record_id, seq, kind, text, CASE WHEN seq = 7 THEN 'http://x/' || c_custkey ELSE '' END AS dest "
        f"FROM customer, LATERAL (VALUES {_MERGE_EVENTS}) AS e(seq, kind, text)"
    ),
    "merge_command": f"""SELECT c_custkey AS record_id, seq, kind, text, CASE WHEN id = '' THEN '' ELSE 'merge-' || c_custkey || '-' || id END AS id,
        CASE WHEN dest = '' THEN '' ELSE '#merge-' || c_custkey || '-' || dest END AS dest FROM customer, LATERAL (VALUES {_COMMAND_EVENTS}) AS e(seq, kind, text, id, dest)
      UNION ALL SELECT c_custkey, -1, 'page_break', '', '', '' FROM customer WHERE c_custkey > (SELECT min(c_custkey) FROM customer)""",
    "match_positions": _found([("[a-z]+tion", "noun"), ("(?i)the", "article")], ("of",)),
    "grammar_matches": _found([(r"(?i)\bthe the\b", "the", "Repeated word"), (r"(?i)\bof of\b", "of", "Repeated word")], ("correction", "message")),
    "image_sizes": (
        "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_partkey % 5000 + 1 END::BIGINT AS width, CASE "
        "WHEN p_partkey % 3 < 2 THEN p_size END::BIGINT AS height FROM part"
    ),
    "images_fitted": """WITH s AS (SELECT p_partkey, p_size, least(640 / p_partkey::DOUBLE, 24 / p_size::DOUBLE, 1) AS k FROM part)
      SELECT p_partkey, greatest(round(p_partkey * k), 1)::BIGINT AS width, greatest(round(p_size * k), 1)::BIGINT AS height, round(p_partkey * 3 / 1440.0::DOUBLE * 96)::BIGINT AS px FROM s""",
    "points_moved": "SELECT p_partkey, (-p_size * p_size + p_size)::DOUBLE AS x, (2 * p_partkey + 1)::DOUBLE AS y FROM part",
    "tables_sorted": """WITH r AS (SELECT s_nationkey, s_suppkey, s_nationkey || '.' || s_suppkey AS c, '| ' || s_nationkey || '.' || s_suppkey || ' | ' || s_name || ' |' AS line FROM supplier)
      SELECT s_nationkey, '| k | name |' || chr(10) || '|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY c) AS by_text,
        '| k | name |' || chr(10) || '|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY c::DOUBLE DESC, s_suppkey DESC) AS by_number FROM r GROUP BY 1""",
    "newest_versions": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "font_list": "SELECT DISTINCT l_linestatus AS font_name FROM lineitem WHERE l_linestatus IS NOT NULL",
    "style_from_xml": f"""WITH {REFS}, p AS (SELECT id, title, CASE WHEN journal <> '' THEN 'in ' || journal WHEN reference_type = 'book' THEN 'book' ELSE 'no journal' END AS source, concat_ws(', ', nullif(year, ''), nullif(volume, '')) AS g FROM refs)
      SELECT id, concat_ws('. ', nullif(title, ''), source, CASE WHEN g <> '' THEN '(' || g || ')' END) || '.' AS citation FROM p""",
    "line_clusters": f"""WITH RECURSIVE {SPANS}, sizes AS (SELECT doc_id, round(font_size * 2) / 2 AS body, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, round(font_size * 2)) AS r FROM spans WHERE font_size >= 6 GROUP BY doc_id, round(font_size * 2) / 2, round(font_size * 2)),
      ys AS (SELECT s.doc_id, page, y, greatest(coalesce(any_value(body), 10) * 0.5, 2) AS t, row_number() OVER (PARTITION BY s.doc_id, page ORDER BY y DESC) AS n FROM spans s LEFT JOIN sizes z ON s.doc_id = z.doc_id AND z.r = 1 GROUP BY s.doc_id, page, y),
      walk(doc_id, page, y, n, anchor, line) AS (SELECT doc_id, page, y, n, y, 1::BIGINT FROM ys WHERE n = 1 UNION ALL
        SELECT b.doc_id, b.page, b.y, b.n, CASE WHEN abs(b.y - a.anchor) > b.t THEN b.y ELSE a.anchor END, a.line + (abs(b.y - a.anchor) > b.t)::BIGINT FROM walk a JOIN ys b ON a.doc_id = b.doc_id AND a.page = b.page AND b.n = a.n + 1)
      SELECT s.doc_id, s.page, s.span_no, w.line FROM spans s JOIN walk w ON s.doc_id = w.doc_id AND s.page = w.page AND s.y = w.y""",
}
#: What a type comes back as: the one format knows no patents, the other no websites, preprints and patents.
_BACK = (
    "CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 9 >= 7 THEN 'Journal Article' ELSE reference_type END "
    "WHEN doc_id % 9 >= 6 THEN 'Other' ELSE reference_type END"
)
ORACLE["bibliography_files"] = f"WITH {REFS} SELECT id, {_BACK} AS reference_type, year, doi FROM refs"
# Streams ------------------------------------------------------------------------------------------------
ORACLE["debounced_saves"] = """WITH e AS (
    SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 9000 SECOND THEN 0 ELSE 1 END AS begins FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
  ), b AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM e)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts) + INTERVAL 9000 SECOND, '%Y-%m-%d %H:%M:%S.%f') AS saved_at, count(*) AS n_edits, max(event_id) FILTER (WHERE last) AS event_id,
    max(event_type) FILTER (WHERE last) AS event_type, max(value) FILTER (WHERE last) AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, burst ORDER BY ts DESC, event_id DESC) = 1 AS last FROM b) GROUP BY user_id, burst"""
ORACLE["streamed_sync"] = ORACLE["lww_merge"]
ORACLE["streamed_members"] = """SELECT id, count(DISTINCT doc_id) AS n_refs
  FROM (SELECT source AS id, doc_id FROM documents UNION ALL SELECT 'src' || doc_id % 30, doc_id FROM documents) GROUP BY id"""
ORACLE["formats_round_trip"] = f"WITH {REFS} SELECT id, {_BACK} AS reference_type, CASE WHEN doc_id % 2 = 0 THEN array_to_string(authors, '|') ELSE replace(array_to_string(authors, ' and '), ' and ', '|') END AS authors, year, doi FROM refs"
# Pages of spans -----------------------------------------------------------------------------------------
_TEXT14 = ", ".join(
    ["'• the item'", "'3. entry'", "'Words in Title Case'", "'ALL IN CAPITALS'", "'Figure One'", "'see www.example.org/a.'", "' '"] + ["'plain text ' || l_returnflag || o"] * 7
)
_PAGES = f"""li AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS n, l_partkey AS p, l_orderkey AS o FROM lineitem),
  one AS (SELECT l_suppkey AS doc_id, (n // 40)::INT AS page, n * 2 AS span_no, (760 - n % 40 * 14)::DOUBLE AS y, CASE WHEN p % 23 = 0 THEN 16 WHEN p % 19 = 0 THEN 12 ELSE 10 END::DOUBLE AS fs,
    [{_TEXT14}][p % 14 + 1] AS text, (72 + [0, 0, 0, 0, 36, 36, 90, 150, 36][p % 9 + 1])::DOUBLE AS x, (l_quantity * 4 + 60)::DOUBLE AS w, p % 13 = 0 AS b, o % 3 = 0 AS i,
    CASE WHEN l_linestatus = 'F' THEN 'Times New Roman' ELSE 'Arial' END AS font, p, o FROM li),
  sp AS (SELECT * FROM one UNION ALL SELECT doc_id, page, span_no + 1, y, fs, ' and more ', x + w + p % 3 * 4, 80, o % 2 = 0, o % 6 = 0, font, p, o FROM one WHERE p % 2 = 0 AND p % 14 <> 6),
  rc AS (SELECT doc_id, page, x AS l, CASE WHEN o % 5 = 0 THEN y - 1 ELSE y + 3 END AS ry, x + w AS r FROM sp WHERE o % 5 = 0 OR o % 7 = 0
    UNION ALL SELECT doc_id, page, 72, y + fs + 1, 600 FROM one WHERE o % 29 = 0),
  lefts AS (SELECT doc_id, min(x) AS pl FROM sp WHERE trim(text) <> '' GROUP BY doc_id),
  frames AS (SELECT doc_id, page, max(x + w) AS pr, any_value(pl) AS pl FROM sp JOIN lefts USING (doc_id) WHERE trim(text) <> '' GROUP BY doc_id, page),
  m AS (SELECT s.doc_id, s.page, span_no, bool_or(ry > y - fs * 0.6::DOUBLE AND ry < y + fs * 0.2::DOUBLE) AS u, bool_or(ry >= y + fs * 0.2::DOUBLE AND ry <= y + fs * 0.8::DOUBLE) AS s
    FROM sp s JOIN rc c ON s.doc_id = c.doc_id AND s.page = c.page JOIN frames f ON f.doc_id = s.doc_id AND f.page = s.page
    WHERE least(r, x + w) - greatest(l, x) > w * 0.5::DOUBLE AND r - l <= (pr - pl) * 0.5::DOUBLE GROUP BY ALL),
  bodies AS (SELECT doc_id, round(fs * 2) / 2 AS body FROM sp GROUP BY doc_id, round(fs * 2) / 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, round(fs * 2) / 2) = 1),
  marked AS (SELECT sp.*, coalesce(m.s, false) AS s, coalesce(m.u, false) AS u, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY y DESC) AS line, BODY AS body
    FROM sp LEFT JOIN m USING (doc_id, page, span_no) JOIN bodies USING (doc_id)),
  r1 AS (SELECT *, [s, u, b, i] AS f, lag([s, u, b, i]) OVER k AS g, x - lag(x + w) OVER k AS gap FROM marked WINDOW k AS (PARTITION BY doc_id, page, line ORDER BY x, span_no)),
  r2 AS (SELECT *, sum(CASE WHEN f IS NOT DISTINCT FROM g THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page, line ORDER BY x, span_no) AS run FROM r1),
  r3 AS (SELECT *, CASE WHEN gap > greatest(first(w) OVER (PARTITION BY doc_id, page, line, run ORDER BY x, span_no) * 0.6::DOUBLE, body * 0.15::DOUBLE) THEN ' ' ELSE '' END || text AS piece FROM r2),
  runs AS (SELECT doc_id, page, line, run, any_value(f) AS f, string_agg(piece, '' ORDER BY x, span_no) AS t FROM r3 GROUP BY ALL)"""
_PLACE = "PARTITION BY doc_id, page, line ORDER BY run"
_LINKED = "replace(trim(regexp_replace(string_agg(q, '' ORDER BY run), '\\s+', ' ', 'g')), 'www.example.org/a.', '<a href=\"https://www.example.org/a\">www.example.org/a</a>.')"
_NAMES = ("s", "u", "b", "i")


def _open(k: int, other: str, sign: str) -> str:
    return f"CASE WHEN f[{k + 1}] AND coalesce(f[1:{k + 1}] <> {other}[1:{k + 1}], true) THEN '<{sign}{_NAMES[k]}>' ELSE '' END"


# A blank run would show in its spaces only; there is none between the spans of these pages but a line's only one.
ORACLE["marks_nested"] = f"""WITH {_PAGES.replace('BODY', '10.0::DOUBLE')},
  z AS (SELECT *, lag(f) OVER ({_PLACE}) AS was, lead(f) OVER ({_PLACE}) AS will FROM runs),
  q AS (SELECT doc_id, page, line, run, CASE WHEN trim(t) = '' THEN t ELSE regexp_extract(t, '^\\s*') || {' || '.join(_open(k, 'was', '') for k in range(4))} || trim(t)
    || {' || '.join(_open(k, 'will', '/') for k in reversed(range(4)))} || regexp_extract(t, '\\s*$') END AS q FROM z)
  SELECT doc_id, page, line, {_LINKED} AS inline FROM q GROUP BY doc_id, page, line"""
ORACLE["spans_to_md"] = f"""WITH RECURSIVE {_PAGES.replace('BODY', 'body')},
  q AS (SELECT doc_id, page, line, run, CASE WHEN trim(t) = '' THEN t ELSE regexp_extract(t, '^\\s*') || {' || '.join(f"CASE WHEN f[{k + 1}] THEN '<{n}>' ELSE '' END" for k, n in enumerate(_NAMES))} || trim(t)
    || {' || '.join(f"CASE WHEN f[{k + 1}] THEN '</{n}>' ELSE '' END" for k, n in reversed(list(enumerate(_NAMES))))} || regexp_extract(t, '\\s*$') END AS q FROM runs),
  texts AS (SELECT doc_id, page, line, {_LINKED} AS t FROM q GROUP BY doc_id, page, line),
  l1 AS (SELECT doc_id, page, line, any_value(body) AS body, max(y) AS y, max(y) + arg_min(fs, span_no) AS top, arg_min(b, span_no) AS strong, max(fs) AS fs,
    min(x) FILTER (WHERE trim(text) <> '') AS l, max(x + w) FILTER (WHERE trim(text) <> '') AS r FROM marked GROUP BY doc_id, page, line),
  l2 AS (SELECT l1.*, t, regexp_replace(t, '</?[bius]>', '', 'g') AS bare, pr, pr - pl AS wide, l - pl AS lgap, pr - r AS rgap FROM l1 JOIN texts USING (doc_id, page, line) JOIN frames USING (doc_id, page) WHERE t <> ''),
  l3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line) AS n, lag(y) OVER (PARTITION BY doc_id ORDER BY page, line) AS above,
    coalesce(lag(y) OVER (PARTITION BY doc_id, page ORDER BY line) - top, 'Infinity'::DOUBLE) AS gap, r < pr - wide * 0.15::DOUBLE AS short,
    regexp_matches(bare, '^[•●▪◆]') AS sign, regexp_extract(bare, '^([0-9]+)\\. ', 1) AS num, list_filter(string_split(bare, ' '), lambda x: x <> '') AS ws, regexp_replace(bare, '\\P{{L}}', '', 'g') AS ls FROM l2),
  wide AS (SELECT rc.doc_id, rc.page, ry FROM rc JOIN frames USING (doc_id, page) WHERE r - l > (pr - pl) * 0.5::DOUBLE),
  rules AS (SELECT n, a.doc_id, count(ry) AS rules FROM l3 a JOIN wide b ON a.doc_id = b.doc_id AND a.page = b.page AND ry < above AND ry > top
    AND NOT EXISTS (SELECT 1 FROM l3 e WHERE e.doc_id = a.doc_id AND e.page = a.page AND e.n < a.n AND ry < e.above AND ry > e.top) GROUP BY ALL),
  f AS (SELECT l3.*, coalesce(rules, 0) AS rules, sign OR num <> '' AS bullet, fs > body * 1.15::DOUBLE AND NOT (sign OR num <> '') AS big, NOT regexp_matches(bare, '^(Figure|Table)') AND NOT (sign OR num <> '') AS ok,
    len(ws) BETWEEN 1 AND 7 AND NOT regexp_matches(bare, '[.,:]$') AND len(list_filter(ws, lambda x: NOT ((strlen(x) <= 3 AND regexp_matches(x, '^\\p{{Ll}}')) OR regexp_matches(x, '^(?:\\p{{Lu}}|\\P{{L}})')))) = 0 AS title,
    strlen(bare) > 3 AND length(ls) > 3 AND NOT regexp_matches(ls, '[^\\p{{Lu}}]') AS caps FROM l3 LEFT JOIN rules USING (doc_id, n)),
  g AS (SELECT *, CASE WHEN num <> '' THEN regexp_replace(t, '^[0-9. ]+', '') WHEN sign THEN trim(regexp_replace(regexp_replace(t, '[•●▪◆]', ''), '<i></i>|<b></b>|<u></u>', '', 'g'))
      WHEN fs > body * 1.45::DOUBLE THEN '# ' WHEN fs > body * 1.15::DOUBLE THEN '## ' ELSE t END AS c0 FROM f),
  h AS (SELECT *, CASE WHEN bullet THEN CASE WHEN num <> '' THEN num || '.' ELSE '-' END || ' ' ELSE '' END || CASE WHEN big THEN c0 ELSE '' END
      || CASE WHEN abs(fs - body) >= 1 THEN printf('<span style="font-size: %.1fpt">', fs) ELSE '' END || CASE WHEN big THEN bare ELSE c0 END || CASE WHEN abs(fs - body) >= 1 THEN '</span>' ELSE '' END AS content FROM g),
  walk(doc_id, n, centre, indent, item, short, piece) AS (
    SELECT doc_id, 0::BIGINT, NULL::DOUBLE, 0::DOUBLE, false, true, '' FROM lefts
    UNION ALL SELECT doc_id, n, CASE WHEN centred THEN coalesce(c2, l) ELSE c2 END, CASE WHEN NOT centred AND gp > 0 AND i2 = 0 THEN gp ELSE i2 END, CASE WHEN breaks THEN bullet ELSE item END,
      centred OR lshort OR heading, CASE WHEN rules > 0 THEN div || CASE WHEN clean THEN '' ELSE chr(10) || chr(10) END || repeat('---' || chr(10) || chr(10), rules)
        WHEN breaks THEN div || CASE WHEN clean THEN '' WHEN bullet AND NOT far THEN chr(10) ELSE chr(10) || chr(10) END WHEN gap < -body THEN '' WHEN short AND NOT item THEN '  ' || chr(10) ELSE ' ' END
        || CASE WHEN centred THEN CASE WHEN c2 IS NULL THEN '<div align="center">' || chr(10) || chr(10) ELSE '' END WHEN gp > 0 AND i2 = 0 THEN '<div style="margin-left: ' || gp::BIGINT || 'pt">' || chr(10) || chr(10) ELSE '' END || content
    FROM (SELECT *, CASE WHEN shuts THEN NULL ELSE c1 END AS c2, CASE WHEN shuts THEN 0 ELSE i1 END AS i2, shuts OR caps AS breaks, CASE WHEN open AND shuts THEN chr(10) || chr(10) || '</div>' || chr(10) || chr(10) ELSE '' END AS div, (open AND shuts) OR n = 1 AS clean
      FROM (SELECT *, far OR bullet OR heading OR rules > 0 OR (c1 IS NOT NULL AND NOT centred) OR (i1 > 0 AND (gp = 0 OR gp <> i1 OR centred)) AS shuts
        FROM (SELECT *, CASE WHEN centred THEN 0 WHEN item AND NOT bullet AND NOT heading AND NOT far THEN i1 WHEN lgap > body AND NOT (num <> '' AND lgap < body * 5) THEN round(lgap) ELSE 0 END AS gp
          FROM (SELECT *, NOT bullet AND ((lgap > pad AND (off < body * 2 OR (off < body * 10 AND heading))) OR (c1 IS NOT NULL AND ((lgap > pad AND rgap > pad) OR abs(l - c1) < 2))) AS centred
            FROM (SELECT h.* EXCLUDE (short), h.short AS lshort, s.item, s.short, s.centre IS NOT NULL OR s.indent > 0 AS open, CASE WHEN rules > 0 THEN NULL ELSE s.centre END AS c1, CASE WHEN rules > 0 THEN 0 ELSE s.indent END AS i1,
              big OR (ok AND strong) OR (ok AND title AND (NOT s.item OR s.short)) AS heading, gap > body * 1.5::DOUBLE AS far, wide * 0.1::DOUBLE AS pad, abs(lgap - rgap) AS off FROM walk s JOIN h ON h.doc_id = s.doc_id AND h.n = s.n + 1))))) )
  SELECT w.doc_id, rtrim('---' || chr(10) || 'page:' || chr(10) || printf('  font_size: %.1fpt', any_value(body)) || chr(10) || '  font_family: "' || any_value(font) || '"' || chr(10) || '  line_spacing: 0.65em' || chr(10) || '---' || chr(10) || chr(10)
    || string_agg(piece, '' ORDER BY n) || CASE WHEN arg_max(centre IS NOT NULL OR indent > 0, n) THEN chr(10) || chr(10) || '</div>' ELSE '' END, ' ' || chr(10)) AS md
  FROM walk w JOIN bodies USING (doc_id) JOIN (SELECT doc_id, font FROM sp GROUP BY doc_id, font QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sum(strlen(text)) DESC, font) = 1) USING (doc_id) GROUP BY w.doc_id"""
# Running numbers ----------------------------------------------------------------------------------------
ORACLE["formulas_numbered"] = rf"""WITH RECURSIVE d AS (SELECT doc_id, string_split(replace(coalesce(text, ''), '$', 'USD'), chr(10)) AS x FROM documents),
  r AS (SELECT doc_id, i::BIGINT AS i, (doc_id + i - 1) % 9 AS turn, x[i] AS x, len(x) AS n FROM d, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i)),
  l AS (SELECT doc_id, i, CASE turn WHEN 0 THEN '$$' WHEN 1 THEN ' $$ ' || x || '$$ ' WHEN 2 THEN 'a $x$ and $y\$z$ $$ ' || x || ' $w' WHEN 3 THEN '$$' || x WHEN 5 THEN x || '$$' ELSE x END AS line, n FROM r),
  b AS (SELECT *, regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '') AS bare FROM l WHERE NOT (i = n AND line = '')),
  s(doc_id, i, inside, kind) AS (SELECT doc_id, 0::BIGINT, false, '' FROM d UNION ALL
    SELECT b.doc_id, b.i, CASE WHEN s.inside THEN NOT ends_with(bare, '$$') ELSE starts_with(bare, '$$') AND NOT (ends_with(bare, '$$') AND length(bare) > 3) END,
      CASE WHEN s.inside THEN CASE WHEN ends_with(bare, '$$') THEN 'close' ELSE 'body' END WHEN starts_with(bare, '$$') THEN CASE WHEN ends_with(bare, '$$') AND length(bare) > 3 THEN 'alone' ELSE 'open' END ELSE 'text' END
    FROM s JOIN b ON b.doc_id = s.doc_id AND b.i = s.i + 1),
  k AS (SELECT b.*, kind, CASE kind WHEN 'text' THEN 2 * starts_with(line, 'a $x$ and $y\$z$ $$ ')::INT WHEN 'alone' THEN 1 WHEN 'close' THEN 1 ELSE 0 END AS c FROM b JOIN s USING (doc_id, i)),
  m AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM k),
  p AS (SELECT *, CASE WHEN kind IN ('open', 'body') THEN '' WHEN kind <> 'text' THEN '![Equation ' || e || '](diagrams/math/eq_' || e || '.png)' || chr(10)
    WHEN c = 2 THEN 'a ![](diagrams/math/eq_' || e - 1 || '.png) and ![](diagrams/math/eq_' || e || '.png) ' || substr(line, 18) || chr(10) ELSE line || chr(10) END AS piece,
    CASE kind WHEN 'alone' THEN bare[3:-3] WHEN 'open' THEN bare[3:] WHEN 'body' THEN line WHEN 'close' THEN CASE WHEN bare = '$$' THEN '' ELSE line[1:-3] END END AS tex, e + (kind IN ('open', 'body'))::INT AS q FROM m),
  blocks AS (SELECT doc_id, q, regexp_replace(regexp_replace(string_agg(tex, chr(10) ORDER BY i), '^\s+', ''), '\s+$', '') AS tex FROM p WHERE kind <> 'text' GROUP BY doc_id, q HAVING bool_or(c = 1)),
  f AS (SELECT doc_id, q AS e, q || 'D' || tex AS t FROM blocks UNION ALL SELECT doc_id, e - 1, (e - 1) || 'Ix' FROM p WHERE kind = 'text' AND c = 2 UNION ALL SELECT doc_id, e, e || 'Iy\$z' FROM p WHERE kind = 'text' AND c = 2)
  SELECT d.doc_id, coalesce(any_value(t.text), '') AS text, coalesce(any_value(g.formulas), '') AS formulas FROM d LEFT JOIN (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS text FROM p GROUP BY doc_id) t USING (doc_id)
    LEFT JOIN (SELECT doc_id, string_agg(t, '|' ORDER BY e) AS formulas FROM f GROUP BY doc_id) g USING (doc_id) GROUP BY d.doc_id"""
ORACLE["list_counters"] = """WITH RECURSIVE e AS (SELECT user_id AS doc_id, event_id AS seq, (floor(value) % 4)::INT AS level, [0, 1, 2, 2, 2][event_id % 5 + 1] AS list_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  walk(doc_id, n, seq, counters, before, marker) AS (SELECT DISTINCT doc_id, 0::BIGINT, NULL::BIGINT, [0, 0, 0, 0], 0, '' FROM e UNION ALL
    SELECT doc_id, n, seq, counters, CASE WHEN list_id > 0 THEN level ELSE before END, CASE WHEN list_id = 0 THEN '' ELSE repeat('    ', level) || CASE WHEN list_id = 2 THEN counters[level + 1] || '. ' ELSE '- ' END END
    FROM (SELECT e.doc_id, e.n, e.seq, e.level, e.list_id, w.before, CASE WHEN list_id = 2 THEN list_transform(w.counters, lambda c, i: CASE WHEN i = level + 1 THEN CASE WHEN level > w.before THEN 0 ELSE c END + 1 ELSE c END) ELSE w.counters END AS counters
      FROM walk w JOIN e ON e.doc_id = w.doc_id AND e.n = w.n + 1))
  SELECT doc_id, seq, marker FROM walk WHERE n > 0"""
# Differences --------------------------------------------------------------------------------------------
#: A conversation's turns differ from each other, so what stays is what both sides have.
ORACLE["turns_diff"] = """WITH c AS (SELECT conv_id AS doc_id, turn * 2 AS p, coalesce(text, '') AS t, (turn + conv_id) % 7 AS k FROM conversations),
  b AS (SELECT doc_id, p, CASE WHEN k = 1 THEN translate(t, 'aeiou', 'AEIOU') ELSE t END AS t FROM c WHERE k <> 3 UNION ALL SELECT doc_id, p + 1, 'new ' || p FROM c WHERE k IN (5, 6)),
  e AS (SELECT doc_id, c.p AS x, b.p AS y, t FROM c JOIN b USING (doc_id, t)),
  g AS (SELECT c.doc_id, 0 AS s, c.p, c.t, (SELECT count(*) FROM e WHERE e.doc_id = c.doc_id AND e.x < c.p) AS gap FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = c.doc_id AND e.x = c.p)
    UNION ALL SELECT b.doc_id, 1, b.p, b.t, (SELECT count(*) FROM e WHERE e.doc_id = b.doc_id AND e.y < b.p) FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = b.doc_id AND e.y = b.p)),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gap, s ORDER BY p) AS i, count(*) FILTER (WHERE s = 0) OVER (PARTITION BY doc_id, gap) = count(*) FILTER (WHERE s = 1) OVER (PARTITION BY doc_id, gap) AS even FROM g),
  o AS (SELECT doc_id, gap, 0 AS s, i, 'replace' AS op, any_value(t) FILTER (WHERE s = 0) AS old_text, any_value(t) FILTER (WHERE s = 1) AS new_text FROM n WHERE even GROUP BY doc_id, gap, i
    UNION ALL SELECT doc_id, gap, s, i, CASE s WHEN 0 THEN 'delete' ELSE 'insert' END, CASE WHEN s = 0 THEN t END, CASE WHEN s = 1 THEN t END FROM n WHERE NOT even
    UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY x), -1, 0, 'equal', t, t FROM e)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY gap, s, i) - 1 AS pos, op, old_text, new_text FROM o"""
# Packages -----------------------------------------------------------------------------------------------
ORACLE["package_references"] = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(role, '') || turn || ' ' || regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b-\x1f]', '', 'g') AS t FROM conversations)
  SELECT conv_id AS path, 'link' AS kind, ['u0', 'u1', 'u2', 'r3'][turn % 4 + 1] AS a, role || turn AS b, '' AS c FROM c
  UNION ALL SELECT a.conv_id, 'comment', a.turn || ':' || a.role, 'note ' || a.turn, a.t || coalesce((SELECT b.t FROM c b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1), '') FROM c a WHERE a.turn % 4 = 0
  UNION ALL SELECT conv_id, 'note', (turn % 3)::VARCHAR, ['none', 'foot 1', 'foot 2'][any_value(turn % 3) + 1], count(*)::VARCHAR FROM c GROUP BY conv_id, turn % 3"""
# Depth-first walks: a graph's state is its stack, the nodes seen, the edges looked at and those that close a cycle.
ORACLE["cycles_removed"] = """WITH RECURSIVE e AS (SELECT * FROM (SELECT user_id AS g, event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS d, event_id AS o FROM events) WHERE d IS NOT NULL),
  p AS (SELECT g, s, d, min(o) AS o FROM e GROUP BY g, s, d),
  q AS (SELECT g, list({'s': s, 'd': d} ORDER BY o) AS es FROM p GROUP BY g),
  walk(g, es, stack, seen, looked, back, finished) AS (
    SELECT g, es, []::VARCHAR[], []::VARCHAR[], []::BIGINT[], []::BIGINT[], false FROM q
    UNION ALL SELECT g, es,
      CASE WHEN len(stack) = 0 THEN CASE WHEN root IS NULL THEN stack ELSE [root] END WHEN k IS NULL THEN stack[:-2] WHEN list_contains(seen, es[k].d) THEN stack ELSE list_append(stack, es[k].d) END,
      CASE WHEN len(stack) = 0 THEN CASE WHEN root IS NULL THEN seen ELSE list_append(seen, root) END WHEN k IS NULL OR list_contains(seen, es[k].d) THEN seen ELSE list_append(seen, es[k].d) END,
      CASE WHEN k IS NULL THEN looked ELSE list_append(looked, k) END, CASE WHEN k IS NOT NULL AND list_contains(stack, es[k].d) THEN list_append(back, k) ELSE back END, len(stack) = 0 AND root IS NULL
    FROM (SELECT *, CASE WHEN len(stack) > 0 THEN [i for i in range(1, len(es) + 1) if es[i].s = stack[-1] AND NOT list_contains(looked, i)][1] END AS k,
      [x for x in flatten([[y.s, y.d] for y in es]) if NOT list_contains(seen, x)][1] AS root FROM walk WHERE NOT finished)),
  b AS (SELECT g, es[k].s AS s, es[k].d AS d FROM (SELECT g, es, unnest(back) AS k FROM walk WHERE finished))
  SELECT e.g AS graph_id, CASE WHEN b.g IS NULL THEN e.s ELSE e.d END AS src, CASE WHEN b.g IS NULL THEN e.d ELSE e.s END AS dst, o AS ord, b.g IS NOT NULL AS reversed
  FROM e LEFT JOIN b USING (g, s, d) WHERE e.s <> e.d"""
# Citations of several references, notes, pages of comments -----------------------------------------------
ORACLE["cited_together"] = f"""WITH {REFS}, c AS (SELECT DISTINCT l_orderkey AS cite, 'ref-' || l_partkey % 500 AS id FROM lineitem)
  SELECT cite, string_agg(substr(title, 1, 20) || ' (' || year || ')', '; ' ORDER BY id) AS citation FROM c JOIN refs USING (id) GROUP BY cite"""
ORACLE["reference_notes"] = f"""WITH {REFS} SELECT id, '---' || chr(10) || 'title: "' || replace(title, '"', chr(92) || '"') || '"' || chr(10) || 'authors: [' || array_to_string(list_transform(authors, lambda a: '"' || a || '"'), ', ') || ']' || chr(10)
  || 'year: ' || year || chr(10) || 'doi: ' || doi || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || '## Abstract' || chr(10) || chr(10) || abstract_text || chr(10) || chr(10) || '## Notes' || chr(10) || chr(10) || notes || chr(10) AS note FROM refs"""
ORACLE["comment_pages"] = """WITH c AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations),
  o AS (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n AS a, sum(n) OVER (PARTITION BY conv_id) AS t FROM c)
  SELECT conv_id, turn, least(greatest(floor(a * 3 / greatest(t, 1)::DOUBLE), 0), 2)::BIGINT AS page FROM o"""
