"""DuckDB SQL with the results of ``lookup_queries``."""

from __future__ import annotations

from .oracles import _CALLS, _CHUNKS, _EDGES, _LINEAGE, _SENT, _pack

_EXACT = "SELECT * FROM (VALUES ('openai', 'pdf_parsing', 'vision', 'gpt-4.1-mini'), ('openai', 'pdf_parsing', 'text', 'gpt-4.1-mini'), ('groq', 'pdf_parsing', 'vision', 'meta-llama/llama-4-scout-17b-16e-instruct'), ('groq', 'pdf_parsing', 'text', 'llama-3.3-70b-versatile')) AS x(p, t, s, m)"

_NN = "chr(10) || chr(10)"
_START = """CASE WHEN instr(substr(t, acc[len(acc)].e + 1), x[1].c) > 0 THEN acc[len(acc)].e + instr(substr(t, acc[len(acc)].e + 1), x[1].c) - 1
    WHEN instr(t, x[1].c) > 0 THEN instr(t, x[1].c) - 1 ELSE acc[len(acc)].e END"""

ORACLES: dict[str, str] = {
    "chunk_document": rf"""
        WITH d AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '\n(#{{1,6}}\s+[^\n])', chr(1) || chr(10) || '\1', 'g'), chr(1)), lambda y: y <> '') AS hp FROM documents),
        e AS (SELECT doc_id, text, {_pack("hp", 30000, "''", 0)} AS hs, {_pack(f"string_split(text, {_NN})", 30000, _NN, 2)} AS ps FROM d),
        x AS (SELECT doc_id, CASE WHEN length(text) <= 30000 THEN [text] WHEN len(hs) > 1 THEN hs ELSE flatten(list_transform(ps, lambda q:
                CASE WHEN length(q) <= 30000 THEN [q] ELSE list_transform(range(0, greatest(length(q), 1), 15000), lambda o: substr(q, o + 1, 15000)) END)) END AS ss FROM e),
        s1 AS (SELECT doc_id, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS s FROM x),
        p0 AS (SELECT doc_id, i, CASE WHEN length(s) * 2 > 2700 THEN {_pack(f"string_split(s, {_NN})", 900, _NN, 2)} ELSE [s] END AS pp FROM s1),
        p1 AS (SELECT doc_id, i, unnest(range(1, len(pp) + 1)) AS j, unnest(pp) AS text FROM p0),
        c0 AS (SELECT doc_id, i, j, CASE WHEN length(text) <= 900 THEN [text] ELSE {_pack(f"string_split({_SENT}, chr(1))", 900, "' '", 1)} END AS cc FROM p1),
        c1 AS (SELECT doc_id, i, j, unnest(range(1, len(cc) + 1)) AS k, unnest(cc) AS c FROM c0)
        SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j, k) - 1)::INT AS chunk_index, md5(c) AS chunk_hash, length(c)::BIGINT AS n_chars
        FROM c1 WHERE trim(regexp_replace(c, '\s+', ' ', 'g')) <> ''""",
    "chunk_offsets": rf"""
        WITH d AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS text FROM documents),
        p AS (SELECT doc_id, text AS t, list_filter({_pack(f"string_split({_SENT}, chr(1))", 900, "' '", 1)}, lambda y: y <> '') AS cs FROM d),
        o AS (SELECT doc_id, list_reduce(list_transform(list_concat([''], cs), lambda y: [{{'c': y, 's': 0::BIGINT, 'e': 0::BIGINT}}]), lambda acc, x:
                list_concat(acc, [{{'c': x[1].c, 's': ({_START})::BIGINT, 'e': (({_START}) + length(x[1].c))::BIGINT}}])) AS os FROM p)
        SELECT doc_id AS document_id, (i - 2)::INT AS chunk_index, os[i].s::INT AS start_offset, os[i].e::INT AS end_offset FROM (SELECT doc_id, os, unnest(range(2, len(os) + 1)) AS i FROM o)""",
    "document_first_page": """
        SELECT conv_id AS document_id, turn::BIGINT AS page_number, md5(text) AS hash
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations) WHERE n = 1""",
    "documents_by_name": "SELECT doc_id, source FROM documents WHERE contains(source, '1')",
    "page_projection": "SELECT conv_id AS document_id, turn::BIGINT AS page_number, role AS title, md5(text) AS content FROM conversations",
    "document_titles": "SELECT DISTINCT source AS document_id, lang AS title FROM documents",
    "reference_chunks": f"""
        WITH {_CHUNKS}, p AS (SELECT doc_id AS d, doc_id - 1 AS similar_id FROM documents WHERE doc_id % 10 = 0 AND doc_id > 0)
        SELECT d AS document_id, similar_id, chunk_id, chunk_hash FROM p JOIN chunks ON chunks.document_id = similar_id""",
    "existing_requirements": """
        WITH r AS (SELECT 'r' || (doc_id % 300) AS requirement_id, min(doc_id) AS stored_in FROM documents GROUP BY 1)
        SELECT doc_id AS candidate, 'r' || (doc_id % 400) AS requirement_id, stored_in FROM documents LEFT JOIN r ON r.requirement_id = 'r' || (doc_id % 400)""",
    "aligned_examples": f"""
        WITH {_LINEAGE}, e AS (SELECT document_id, min(chunk_id) AS example_id FROM lin GROUP BY 1)
        SELECT chunk_id, lin.document_id, aligned_with_document_id AS other_id, example_id FROM lin LEFT JOIN e ON e.document_id = aligned_with_document_id WHERE aligned_with_document_id <> ''""",
    "relationship_listing": f"WITH {_LINEAGE}, {_EDGES} SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, other_id) AS place FROM edges",
    "hash_members_top": f"""
        WITH {_CHUNKS}, t AS (SELECT chunk_hash, count(*) AS n FROM chunks GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, chunk_hash LIMIT 10)
        SELECT chunk_hash, n, array_to_string((list(chunk_id ORDER BY chunk_id))[:5], ',') AS members FROM chunks JOIN t USING (chunk_hash) GROUP BY 1, 2""",
    "missing_samples": f"""
        WITH {_CHUNKS}, o AS (SELECT document_id % 10 AS key, count(*) AS n, list(substr(chunk_text, 1, 200) ORDER BY chunk_id) AS ts FROM chunks GROUP BY 1)
        SELECT key, n, ts[1] AS sample_1, ts[2] AS sample_2, ts[3] AS sample_3 FROM o""",
    "pair_cosines": """
        SELECT a.vec_id AS id, b.vec_id AS original, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity,
               round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS or_nan
        FROM embeddings a JOIN embeddings b ON a.vec_id // 2 = b.vec_id""",
    "doc_pair_extremes": """
        WITH u AS (SELECT label::BIGINT AS l, embedding::DOUBLE[] AS v FROM embeddings),
        p AS (SELECT a.l AS document, b.l AS other, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.l < b.l)
        SELECT document, other, round(max(s), 6) AS best, round(avg(s), 6) AS average, count(*) AS n FROM p GROUP BY 1, 2 HAVING round(max(s), 6) > 0.40""",
    "usage_today": f"""
        WITH {_CALLS} SELECT model, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(total_tokens)::BIGINT AS total_tokens
        FROM daily WHERE date = DATE '2024-01-05' GROUP BY ROLLUP (model)""",
    "model_selection": f"""
        WITH t AS (SELECT n_nationkey::BIGINT AS n, ['openai', 'groq', 'other'][n_nationkey % 3 + 1] AS provider, ['pdf_parsing', 'chunking', 'naming'][n_nationkey // 3 % 3 + 1] AS task,
                          ['vision', NULL][n_nationkey // 9 % 2 + 1] AS sub_task FROM nation),
        k AS (SELECT *, CASE WHEN provider = 'groq' THEN 'groq' ELSE 'openai' END AS pp FROM t)
        SELECT n, provider, task, sub_task, coalesce(x.m, CASE pp WHEN 'groq' THEN 'llama-3.3-70b-versatile' ELSE 'gpt-4.1-mini' END) AS model
        FROM k LEFT JOIN ({_EXACT}) x ON x.p = pp AND x.t = task AND x.s = sub_task""",
    "scenario_rates": """
        SELECT user_id % 20 AS scenario_id, count(*) AS runs, sum((value > 50)::INT)::BIGINT AS passed, round(sum((value > 50)::INT) / count(*), 6) AS rate FROM events GROUP BY 1""",
    "scenario_table": """
        WITH l AS (SELECT user_id % 50 AS source, event_id AS line_no, event_type AS t, 'd' || (event_id % 7) || '.pdf' AS doc FROM events),
        s AS (SELECT *, max(CASE WHEN t = 'purchase' THEN line_no END) OVER (PARTITION BY source ORDER BY line_no) AS section FROM l),
        f AS (SELECT source, section, doc, min(line_no) AS seen FROM s WHERE t = 'click' GROUP BY 1, 2, 3),
        d AS (SELECT source, section, string_agg(doc, ',' ORDER BY seen) AS documents FROM f GROUP BY 1, 2),
        p AS (SELECT source, section, bool_or(t = 'signup') AND NOT bool_or(t = 'error') AS passed FROM s GROUP BY 1, 2)
        SELECT p.source, p.section, coalesce(documents, '') AS documents, passed FROM p LEFT JOIN d ON p.source = d.source AND p.section IS NOT DISTINCT FROM d.section""",
    "truncated_tokens": "SELECT doc_id AS document_id, length(substr(text, 1, 400)) AS n_chars, md5(substr(text, 1, 400)) AS hash FROM documents",
    "path_parts": r"""
        WITH p AS (SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] AS base_name FROM pages)
        SELECT page_id, base_name, lower(regexp_extract(base_name, '.\.([^.]*)$', 1)) AS extension FROM p""",
    "timestamp_forms": """
        SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS plain, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso_utc FROM events""",
    "text_around": """
        WITH m AS (SELECT doc_id, text, length(text) // 2 AS mid FROM documents)
        SELECT doc_id AS document_id, md5(substr(text, greatest(mid - 100, 0) + 1, mid + 100 - greatest(mid - 100, 0))) AS hash FROM m""",
    "table_operations": """
        SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 2 = 1 THEN source END AS source, 'documents' AS listed FROM documents WHERE doc_id % 10 <> 3""",
    "missing_report": f"""
        WITH {_CHUNKS}, o AS (SELECT document_id % 10 AS key, chunk_id, chunk_hash, chunk_text FROM chunks WHERE document_id % 2 = 0),
        n AS (SELECT DISTINCT (document_id + 9) % 10 AS key, chunk_hash FROM chunks WHERE document_id % 2 = 1),
        g AS (SELECT o.* FROM o LEFT JOIN n USING (key, chunk_hash) WHERE n.key IS NULL),
        l AS (SELECT key, count(*) AS n, list(substr(chunk_text, 1, 200) ORDER BY chunk_id) AS ts FROM g GROUP BY 1)
        SELECT key, n, ts[1] AS sample_1, ts[2] AS sample_2, ts[3] AS sample_3 FROM l""",
    "reviewed_chunks": f"""
        WITH {_LINEAGE} SELECT chunk_id, document_id, CASE WHEN doc_id % 3 <> 0 THEN duplicate_of END AS duplicate_of,
               CASE WHEN doc_id % 4 = 0 THEN 'r' || chunk_id ELSE replaced_by END AS replaced_by FROM lin""",
    "schema_differences": """
        SELECT 'title' AS column, 'missing' AS status, 0::BIGINT AS non_null UNION ALL SELECT 'lang', 'extra', count(lang) FROM documents
        UNION ALL SELECT 'n_chars', 'extra', count(n_chars) FROM documents UNION ALL SELECT 'source', 'type', count(source) FROM documents""",
    "expected_flags": """
        WITH a AS (SELECT doc_id, doc_id <> min(doc_id) OVER (PARTITION BY text) AS d FROM documents)
        SELECT doc_id, 'is_duplicate' AS column, 'false' AS expected, 'true' AS actual FROM a WHERE doc_id % 3 <> 0 AND d
        UNION ALL SELECT doc_id, 'is_even', 'false', 'true' FROM a WHERE doc_id % 10 = 0""",
    "whole_documents": "SELECT vec_id // 25 AS document, count(*) AS pages, bool_and(vec_id % 97 <> 0) AS whole FROM embeddings GROUP BY 1",
    "lineage_cosines": f"""
        WITH {_LINEAGE}, x AS (SELECT lin.*, embedding::DOUBLE[] AS v FROM lin LEFT JOIN embeddings ON vec_id = doc_id),
        l AS (SELECT chunk_id, v, 'replacement' AS relation, replaced_by AS other_id FROM x UNION ALL SELECT chunk_id, v, 'previous', previous_chunk_id FROM x UNION ALL SELECT chunk_id, v, 'original', duplicate_of FROM x)
        SELECT l.chunk_id, relation, other_id, round(list_cosine_similarity(l.v, x.v), 6) AS similarity FROM l JOIN x ON l.other_id = x.chunk_id""",
    "lineage_summaries": f"""
        WITH {_LINEAGE} SELECT chunk_id, concat_ws(' | ', chunk_id, lin.document_id, substr(text, 1, 150), 'duplicate of ' || nullif(duplicate_of, ''), 'replaced by ' || nullif(replaced_by, ''),
               'before ' || nullif(previous_chunk_id, ''), 'aligned with document ' || nullif(aligned_with_document_id, '')) AS line FROM lin JOIN documents USING (doc_id)""",
}
