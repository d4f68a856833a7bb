"""DuckDB SQL with the same results, for the queries that SQL can express."""

from __future__ import annotations

_SENT = r"regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g')"
# Greedy packing as a fold over the parts: finished chunks and the one being filled.
_PACK = """list_reduce(list_transform({parts}, lambda p: [p]), lambda acc, x:
    CASE WHEN acc[len(acc)] <> '' AND length(acc[len(acc)]) + length(x[1]) + {n} <= {limit} THEN list_concat(acc[:len(acc) - 1], [acc[len(acc)] || {sep} || x[1]])
         WHEN acc[len(acc)] = '' THEN list_concat(acc[:len(acc) - 1], x) ELSE list_concat(acc, x) END)"""


def _pack(parts: str, limit: int, sep: str, n: int) -> str:
    return _PACK.format(parts=parts, limit=limit, sep=sep, n=n)


_CHUNKS = f"""
    packed AS (SELECT doc_id AS document_id, {_pack(f"string_split({_SENT}, chr(1))", 900, "' '", 1)} AS cs FROM documents),
    chunks AS (
        SELECT document_id, (i - 1)::INT AS chunk_index, printf('%s_chunk_%04d', document_id::VARCHAR, i) AS chunk_id, cs[i] AS chunk_text, md5(cs[i]) AS chunk_hash
        FROM (SELECT document_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM packed) WHERE cs[i] <> ''
    )"""
_FIRST = """
    marked AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY document_id, chunk_index) > 1 AS dup FROM chunks)"""
_SIM = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
_KNN = f"""
    near AS (
        SELECT a.vec_id AS q_id, b.vec_id AS r_id, {_SIM} AS similarity, a.label AS ql, b.label AS rl
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, r_id) AS rank FROM near
    )"""
_UNITS = """
    units AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
    dims AS (SELECT label, i, avg(u[i]) AS m FROM (SELECT label, u, unnest(range(1, 65)) AS i FROM units) GROUP BY label, i),
    means AS (SELECT label::BIGINT AS document, list(m ORDER BY i) AS v FROM dims GROUP BY label)"""
_LINEAGE = """
    lin AS (
        SELECT 'c' || doc_id AS chunk_id, 'd' || (doc_id % 20) AS document_id, CASE WHEN doc_id % 7 = 0 THEN 'c' || (doc_id + 1) END AS replaced_by,
               CASE WHEN doc_id % 5 = 0 THEN 'c' || (doc_id - 1) ELSE '' END AS previous_chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'c' || (doc_id // 2) END AS duplicate_of,
               CASE WHEN doc_id % 11 = 0 THEN 'd' || ((doc_id + 3) % 20) ELSE '' END AS aligned_with_document_id, doc_id
        FROM documents
    )"""
_EDGES = """
    kinds AS (
        SELECT document_id, nullif(aligned_with_document_id, '') AS other_id, 1 AS kind FROM lin WHERE nullif(aligned_with_document_id, '') IS NOT NULL
        UNION ALL SELECT a.document_id, b.document_id, 2 FROM lin a JOIN lin b ON nullif(a.previous_chunk_id, '') = b.chunk_id WHERE a.document_id <> b.document_id
        UNION ALL SELECT a.document_id, b.document_id, 3 FROM lin a JOIN lin b ON nullif(a.duplicate_of, '') = b.chunk_id WHERE a.document_id <> b.document_id
    ), edges AS (
        SELECT document_id, other_id, ['aligned', 'updated', 'duplicate'][min(kind)] AS type, count(*) AS n FROM kinds GROUP BY 1, 2
    )"""
_CALLS = """
    calls AS (
        SELECT DATE '2024-01-01' + (conv_id % 30)::INT AS date, ['gpt-4o', 'gpt-4o-mini', 'gpt-4.1', 'gpt-4.1-mini', 'o1', 'o1-mini', 'o3', 'o3-mini', 'llama-3.3-70b-versatile', 'meta-llama/llama-4-scout-17b-16e-instruct', 'gpt-4.5-preview', 'unheard-of'][conv_id % 12 + 1] AS model,
               CASE WHEN role = 'user' THEN length(text) // 4 ELSE 0 END AS i, CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END AS o
        FROM conversations
    ), daily AS (
        SELECT date, model, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, (sum(i) + sum(o))::BIGINT AS total_tokens FROM calls GROUP BY 1, 2
    ), prices(model, pin, pout, energy, co2, tier) AS (
        VALUES ('gpt-4o', 2.5::DOUBLE, 10::DOUBLE, 0.0015::DOUBLE, 0.0008::DOUBLE, 'high'), ('gpt-4o-mini', 0.15, 0.6, 0.0008, 0.0004, 'low'), ('gpt-4.1', 3, 12, 0.0016, 0.0009, 'high'),
               ('gpt-4.1-mini', 0.2, 0.8, 0.0009, 0.0005, 'low'), ('o1', 15, 60, 0.0018, 0.001, 'high'), ('o1-mini', 3, 12, 0.0012, 0.0006, 'low'), ('o3', 15, 75, 0.002, 0.0011, 'high'), ('o3-mini', 3.5, 14, 0.0013, 0.0007, 'low'),
               ('llama-3.3-70b-versatile', 0.1, 0.3, 0.001, 0.0005, 'low'), ('meta-llama/llama-4-scout-17b-16e-instruct', 0.4, 0.8, 0.0012, 0.0006, 'low'), ('gpt-4.5-preview', NULL, NULL, NULL, NULL, 'high')
    )"""
_LOG = """
    lines AS (SELECT user_id % 50 AS source, event_id AS line_no, event_type AS text FROM events),
    sec AS (SELECT *, max(CASE WHEN text = 'purchase' THEN line_no END) OVER (PARTITION BY source ORDER BY line_no) AS section FROM lines)"""
_VOTE = f"""
    sample AS (SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 5),
    top AS (SELECT r.* FROM ranked r JOIN sample s ON r.q_id = s.vec_id WHERE rank <= 5 AND ql <> rl),
    pp AS (SELECT ql, q_id, rl, max(similarity) AS s FROM top GROUP BY 1, 2, 3),
    mean AS (SELECT ql, rl, round(avg(s), 6) AS s FROM pp GROUP BY 1, 2),
    vote AS (SELECT ql::BIGINT AS document, rl::BIGINT AS best_document, s AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY ql ORDER BY s DESC, rl) AS n FROM mean) WHERE n = 1)"""
_NEAREST = """
    dn AS (
        SELECT a.document, b.document AS best_document, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM means a JOIN means b ON a.document <> b.document
    ), nd AS (SELECT document, best_document, similarity FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY similarity DESC, best_document) AS n FROM dn) WHERE n = 1)"""
_BAND = "CASE WHEN similarity >= 0.48 THEN 'duplicate' WHEN similarity >= 0.40 THEN 'similar' ELSE 'new' END"

ORACLES: dict[str, str] = {
    "file_hash_dedup": """
        WITH h AS (SELECT doc_id AS path, md5(text) AS md5, sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM documents),
        f AS (SELECT *, min(path) OVER (PARTITION BY sha256) AS first FROM h)
        SELECT path, md5, sha256, size, path <> first AS is_duplicate, CASE WHEN path <> first THEN first END AS duplicate_of FROM f""",
    "file_hash_lookup": """
        WITH h AS (SELECT doc_id AS path, md5(text) AS md5, sha256(text) AS sha256 FROM documents),
        s AS (SELECT sha256, min(path) AS p FROM h WHERE path % 2 = 0 GROUP BY 1), m AS (SELECT md5, min(path) AS p FROM h WHERE path % 2 = 0 GROUP BY 1)
        SELECT h.path, h.md5, h.sha256, coalesce(s.p, m.p) AS existing_path, coalesce(s.p, m.p) IS NOT NULL AS is_duplicate
        FROM h LEFT JOIN s USING (sha256) LEFT JOIN m ON h.md5 = m.md5 WHERE path % 2 = 1""",
    "chunk_sentences": f"WITH {_CHUNKS} SELECT document_id, chunk_index, chunk_id, chunk_hash, length(chunk_text)::BIGINT AS n_chars FROM chunks",
    "chunk_stats": f"""
        WITH {_CHUNKS}, n AS (SELECT length(chunk_text) AS c, length(chunk_text) // 4 AS t FROM chunks)
        SELECT count(*) AS chunks, min(c)::BIGINT AS min_chars, max(c)::BIGINT AS max_chars, round(avg(c), 6) AS avg_chars, min(t)::BIGINT AS min_tokens, max(t)::BIGINT AS max_tokens, round(avg(t), 6) AS avg_tokens FROM n""",
    "chunk_dup_rollup": f"WITH {_CHUNKS}, {_FIRST} SELECT document_id, count(*) AS total, sum(dup::INT)::BIGINT AS duplicate FROM marked GROUP BY 1",
    "document_verdict": f"""
        WITH {_CHUNKS}, {_FIRST}, c AS (SELECT document_id, count(*) AS total, sum(dup::INT)::BIGINT AS duplicate, 0::BIGINT AS "similar", sum((NOT dup)::INT)::BIGINT AS new FROM marked GROUP BY 1)
        SELECT *, CASE WHEN new = 0 AND "similar" = 0 THEN 'identical' WHEN new = 0 THEN 'minor' ELSE 'major' END AS verdict, round((duplicate + "similar") / total, 6) AS rate FROM c""",
    "hash_multiplicity_top": f"WITH {_CHUNKS} SELECT chunk_hash, count(*) AS n, min(chunk_id) AS first_chunk FROM chunks GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, chunk_hash LIMIT 10",
    "chunks_per_document": f"WITH {_CHUNKS} SELECT document_id, count(*) AS n FROM chunks GROUP BY 1",
    "split_by_header": f"""
        WITH d AS (SELECT doc_id AS document_id, list_filter(string_split(regexp_replace(replace(text, chr(10), chr(10) || '# '), '\\n(#{{1,6}}\\s+[^\\n])', chr(1) || chr(10) || '\\1', 'g'), chr(1)), lambda s: s <> '') AS ps FROM documents),
        p AS (SELECT document_id, {_pack("ps", 1500, "''", 0)} AS cs FROM d)
        SELECT document_id, (i - 1)::INT AS section, md5(cs[i]) AS hash, length(cs[i])::BIGINT AS n_chars FROM (SELECT document_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM p)""",
    "split_by_paragraph": f"""
        WITH d AS (SELECT doc_id AS document_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS ps FROM documents),
        p AS (SELECT document_id, {_pack("ps", 1500, "chr(10) || chr(10)", 2)} AS cs FROM d)
        SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY i) - 1)::INT AS section, md5(cs[i]) AS hash, length(cs[i])::BIGINT AS n_chars
        FROM (SELECT document_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM p) WHERE i < len(cs) OR cs[i] <> ''""",
    "slice_oversize": """
        SELECT doc_id AS document_id, i::INT AS section, md5(substr(text, 750 * i + 1, 750)) AS hash, length(substr(text, 750 * i + 1, 750))::BIGINT AS n_chars
        FROM (SELECT doc_id, text, unnest(range(0, greatest((length(text) + 749) // 750, 1))) AS i FROM documents)""",
    "knn_top5": f"WITH {_KNN} SELECT q_id, r_id, similarity, rank::INT AS rank FROM ranked WHERE rank <= 5",
    "page_best_match": f"WITH {_KNN} SELECT q_id, r_id, similarity, similarity >= 0.40 AS is_match FROM ranked WHERE rank = 1",
    "page_classify": f"WITH {_KNN} SELECT q_id AS id, r_id AS match_id, similarity, {_BAND} AS status FROM ranked WHERE rank = 1",
    "version_vote": f"WITH {_KNN}, {_VOTE} SELECT *, similarity >= 0.30 AND similarity < 0.48 AS is_new_version FROM vote",
    "document_vector_similarity": f"WITH {_UNITS}, {_NEAREST} SELECT *, {_BAND} AS status FROM nd",
    "two_stage_verdict": f"""
        WITH {_UNITS}, {_NEAREST}, {_KNN}, {_VOTE}, j AS (
            SELECT nd.*, v.best_document AS pd, v.similarity AS ps, coalesce(nd.similarity <= 0.95 AND v.similarity > nd.similarity, false) AS by_page FROM nd LEFT JOIN vote v USING (document)
        ), s AS (SELECT document, CASE WHEN by_page THEN pd ELSE best_document END AS most_similar, CASE WHEN by_page THEN ps ELSE similarity END AS similarity, CASE WHEN by_page THEN 'page' ELSE 'document' END AS method FROM j)
        SELECT *, similarity > 0.10 AS is_duplicate FROM s""",
    "doc_pair_avg_cosine": "WITH u AS (SELECT label::BIGINT AS l, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.l AS document, b.l AS other, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS avg_similarity FROM u a JOIN u b ON a.l < b.l GROUP BY 1, 2",
    "orphan_suggestions": f"""
        WITH {_KNN}, o AS (SELECT q_id, r_id, similarity, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, r_id) AS rank FROM near WHERE ql <> rl AND q_id % 3 <> 0)
        SELECT q_id, r_id, similarity, rank::INT AS rank FROM o WHERE rank <= 5 AND similarity >= 0.42""",
    "requirement_nearest": f"""
        WITH {_KNN}, o AS (SELECT q_id, r_id, similarity, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, r_id) AS n FROM near WHERE q_id % 2 = 1 AND r_id % 2 = 0)
        SELECT q_id, r_id, similarity FROM o WHERE n = 1""",
    "requirement_dedup_flags": f"""
        WITH {_KNN}, o AS (SELECT q_id, r_id, similarity, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, r_id) AS n FROM near WHERE q_id % 2 = 1 AND r_id % 2 = 0),
        f AS (SELECT *, similarity >= 0.45 OR (similarity >= 0.40 AND q_id % 3 = 0) AS dup FROM o WHERE n = 1)
        SELECT q_id AS requirement_id, r_id AS nearest_id, similarity, dup AS is_duplicate, CASE WHEN dup THEN r_id END AS duplicate_of, similarity >= 0.40 AND similarity < 0.45 AS needs_check FROM f""",
    "word_jaccard_pairs": r"""
        WITH w AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS ws FROM (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text)),
        x AS (SELECT id, len(ws) AS n, unnest(ws) AS w FROM w),
        c AS (SELECT a.id AS id_a, b.id AS id_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2)
        SELECT id_a, id_b, round(k / (na + nb - k), 6) AS jaccard FROM c WHERE round(k / (na + nb - k), 6) >= 0.8""",
    "text_classes": "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS class_id FROM documents",
    "replacement_flatten": f"""
        WITH {_LINEAGE}, r AS (SELECT 'c' || (doc_id + 100000) AS new_id, 'c' || (doc_id // 2) AS old_id, doc_id AS seq FROM documents WHERE doc_id % 4 = 1),
        o AS (SELECT old_id, arg_min(new_id, seq) AS f, arg_max(new_id, seq) AS l FROM r GROUP BY 1)
        SELECT lin.chunk_id, coalesce(a.l, b.f, lin.replaced_by) AS replaced_by, coalesce(a.l, b.f, lin.replaced_by) IS NOT NULL AS is_replaced
        FROM lin LEFT JOIN o a ON lin.chunk_id = a.old_id LEFT JOIN o b ON lin.replaced_by = b.old_id""",
    "lineage_self_join": f"""
        WITH {_LINEAGE} SELECT l.chunk_id, l.document_id, r.document_id AS replacement_document, p.document_id AS previous_document, o.document_id AS original_document
        FROM lin l LEFT JOIN lin r ON l.replaced_by = r.chunk_id LEFT JOIN lin p ON nullif(l.previous_chunk_id, '') = p.chunk_id LEFT JOIN lin o ON l.duplicate_of = o.chunk_id""",
    "relationship_edges": f"WITH {_LINEAGE}, {_EDGES} SELECT * FROM edges",
    "related_documents": f"WITH {_LINEAGE}, {_EDGES} SELECT 'd3' AS document_id UNION SELECT other_id FROM edges WHERE document_id = 'd3' UNION SELECT document_id FROM edges WHERE other_id = 'd3'",
    "requirement_reuse": f"""
        WITH {_LINEAGE} SELECT 'r' || r.chunk_id AS requirement_id, c.chunk_id AS source_chunk_id, r.chunk_id AS copied_from, r.document_id AS description
        FROM lin r JOIN lin c ON c.duplicate_of = r.chunk_id WHERE r.doc_id % 2 = 0""",
    "requirement_pending": f"""
        WITH {_LINEAGE}, q AS (SELECT chunk_id FROM lin WHERE doc_id % 2 = 0)
        SELECT chunk_id FROM lin WHERE chunk_id NOT IN (SELECT chunk_id FROM q) AND (duplicate_of IS NULL OR duplicate_of NOT IN (SELECT chunk_id FROM q))""",
    "usage_daily": f"WITH {_CALLS} SELECT * FROM daily",
    "usage_cost_energy": f"""
        WITH {_CALLS} SELECT d.*, round((input_tokens * pin + output_tokens * pout) / 1e6, 6) AS cost, round(total_tokens * energy, 6) AS energy_wh, round(total_tokens * co2, 6) AS co2_g, coalesce(tier, 'low') AS tier FROM daily d LEFT JOIN prices USING (model)""",
    "usage_tier_limits": f"""
        WITH {_CALLS}, t AS (SELECT date, coalesce(tier, 'low') AS tier, sum(total_tokens)::BIGINT AS used, CASE coalesce(tier, 'low') WHEN 'high' THEN 250000 ELSE 2500000 END::BIGINT AS token_limit FROM daily LEFT JOIN prices USING (model) GROUP BY 1, 2)
        SELECT *, round(100 * used / token_limit, 4) AS percent, round(100 * used / token_limit, 4) > 80 AS warning FROM t""",
    "pages_to_document_text": """
        WITH t AS (SELECT conv_id AS document_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) || chr(10) || chr(10) AS x FROM conversations GROUP BY 1)
        SELECT document_id, md5(x) AS hash, length(x)::BIGINT AS n_chars FROM t""",
    "json_pages_reader": """
        SELECT conv_id AS document_id, turn AS page_number, md5(text) AS hash FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE conv_id % 4 < 3 OR n = 1""",
    "page_field_coalesce": "SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN lang ELSE source END AS content FROM documents",
    "markdown_table": """
        WITH c AS (SELECT n_nationkey::BIGINT AS row_no, n_nationkey::VARCHAR AS a, n_name AS b, n_regionkey::VARCHAR AS c FROM nation),
        w AS (SELECT max(length(a)) AS wa, max(length(b)) AS wb, max(length(c)) AS wc FROM c)
        SELECT row_no, 0::BIGINT AS part, '| ' || rpad(a, wa::INT, ' ') || ' | ' || rpad(b, wb::INT, ' ') || ' | ' || rpad(c, wc::INT, ' ') || ' |' AS line FROM c, w
        UNION ALL SELECT (SELECT min(row_no) FROM c), 1, '| ' || repeat('-', wa) || ' | ' || repeat('-', wb) || ' | ' || repeat('-', wc) || ' |' FROM w""",
    "column_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count({c}) = 0 AS all_null FROM lineitem"
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    ),
    "log_sections": f"WITH {_LOG} SELECT source, section, count(*) AS lines FROM sec GROUP BY 1, 2",
    "log_flags": f"WITH {_LOG} SELECT source, section, bool_or(text LIKE '%click%') AS has_click, bool_or(text LIKE '%view%') AS has_view FROM sec GROUP BY 1, 2",
    "scenario_latest": "SELECT user_id % 20 AS scenario_id, max(event_id) AS ts, arg_max(value > 50, event_id) AS passed FROM events GROUP BY 1",
    "latest_pages": """
        SELECT doc_id % 40 AS document_id, (doc_id // 40) % 5 AS page_number, max(doc_id) AS ts, arg_max(lang, doc_id) AS lang FROM documents GROUP BY 1, 2""",
    "text_scalars": r"""
        SELECT doc_id AS document_id, (length(text) // 4)::BIGINT AS tokens, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')))::BIGINT AS words,
               coalesce(length(text) > 20 AND (regexp_matches(substr(text, 20, 2), '^[.!?]\s') OR regexp_matches(substr(text, 19, 3), '^[.!?]["'')\]]\s')), false) AS boundary,
               repeat('#', length(text) % 10) || repeat('.', 10 - length(text) % 10) AS bar, substr(text, 101, 200) AS slice
        FROM documents""",
    "stream_hash_dedup": "SELECT DISTINCT md5(text) AS md5, sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM documents",
    "doc_max_cosine": f"""
        WITH {_UNITS}, p AS (SELECT vec_id, label::BIGINT AS l, embedding::DOUBLE[] AS v FROM embeddings),
        n AS (SELECT m.document, p.l AS best_document, round(list_cosine_similarity(m.v, p.v), 6) AS similarity, p.vec_id FROM means m JOIN p ON m.document <> p.l)
        SELECT document, best_document, similarity, similarity >= 0.40 AS is_similar FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY similarity DESC, vec_id) AS k FROM n) WHERE k = 1""",
    "page_outcomes": f"""
        WITH {_KNN}, s AS (SELECT ql::BIGINT AS grp, {_BAND} AS status FROM ranked WHERE rank = 1),
        c AS (SELECT grp, count(*) AS total, sum((status = 'duplicate')::INT)::BIGINT AS duplicate, sum((status = 'similar')::INT)::BIGINT AS updated, sum((status = 'new')::INT)::BIGINT AS new FROM s GROUP BY 1)
        SELECT *, CASE WHEN updated > 0 THEN 'new version' WHEN duplicate = total THEN 'complete duplicate' WHEN duplicate > 0 THEN 'partial duplicate' ELSE 'completely new' END AS verdict FROM c""",
    "chunk_classify_vector": f"""
        WITH {_KNN}, hs AS (SELECT vec_id AS id, CASE WHEN vec_id // 2 % 3 = 0 THEN 'p' || (vec_id // 2) ELSE vec_id::VARCHAR END AS h FROM embeddings), q AS (SELECT * FROM hs WHERE id % 2 = 1),
        st AS (SELECT * FROM hs WHERE id % 2 = 0),
        f AS (SELECT h, min(id) AS same FROM st GROUP BY 1),
        v AS (SELECT q_id, r_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, r_id) AS k FROM near WHERE r_id % 2 = 0) WHERE k = 1)
        SELECT q.id, CASE WHEN same IS NOT NULL OR similarity >= 0.48 THEN 'duplicate' WHEN similarity >= 0.40 THEN 'update' ELSE 'new' END AS status, coalesce(same, r_id) AS match_id,
               CASE WHEN same IS NOT NULL THEN 1.0::DOUBLE ELSE similarity END AS similarity
        FROM q LEFT JOIN f USING (h) LEFT JOIN v ON q.id = v.q_id""",
    "page_update_status": f"""
        WITH {_KNN} SELECT q_id, CASE WHEN q_id % 7 = r_id % 7 AND q_id // 100 = r_id // 100 THEN CASE WHEN q_id > r_id THEN 'update' ELSE 'duplicate' END
            WHEN similarity >= 0.48 THEN 'duplicate' ELSE 'new' END AS status FROM ranked WHERE rank = 1""",
    "orphan_candidates": f"WITH {_LINEAGE} SELECT chunk_id, document_id FROM lin WHERE duplicate_of IS NULL AND aligned_with_document_id = ''",
    "missing_chunks": f"""
        WITH {_CHUNKS}, k AS (SELECT *, CASE WHEN document_id % 2 = 0 THEN document_id % 10 ELSE (document_id % 10 - 1) END AS key FROM chunks)
        SELECT key, chunk_id, substr(chunk_text, 1, 200) AS excerpt FROM k a WHERE document_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.document_id % 2 = 1 AND b.key = a.key AND b.chunk_hash = a.chunk_hash)""",
    "word_count_difference": r"""
        WITH c AS (SELECT doc_id AS key, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::BIGINT AS words_a, len(list_filter(string_split_regex(regexp_replace(text, '^[^\n]*\n?', ''), '\s+'), lambda w: w <> ''))::BIGINT AS words_b FROM documents)
        SELECT *, CASE WHEN greatest(words_a, words_b) > 0 THEN round(100 * abs(words_a - words_b) / greatest(words_a, words_b), 4) ELSE 0 END::DOUBLE AS percent FROM c""",
    "required_files": "SELECT doc_id AS name FROM documents EXCEPT SELECT doc_id FROM labels",
    "requirement_batches": "SELECT source AS document_id, doc_id AS requirement_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 3)::BIGINT AS batch FROM documents",
    "requirement_id_offset": """
        SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lpad((doc_id + 5)::VARCHAR, greatest(3, length((doc_id + 5)::VARCHAR))::INT, '0') ELSE 'R' || doc_id || '-5' END AS requirement_id FROM documents""",
    "title_inputs": """
        SELECT conv_id AS document_id, string_agg(substr(text, 1, 100), chr(10) ORDER BY turn) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3 GROUP BY 1""",
    "combined_json": "SELECT conv_id AS document_id, turn AS page_number, md5(text) AS hash FROM conversations",
    "chunk_summaries": f"WITH {_CHUNKS} SELECT chunk_id, chunk_id || ' | ' || document_id || ' | ' || substr(chunk_text, 1, 150) AS line FROM chunks",
    "usage_upsert": f"""
        WITH {_CALLS}, u AS (SELECT date, model, i, o FROM calls WHERE date < DATE '2024-01-16' UNION ALL SELECT date, model, i, o FROM calls WHERE date >= DATE '2024-01-10')
        SELECT date, model, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, (sum(i) + sum(o))::BIGINT AS total_tokens FROM u GROUP BY 1, 2""",
    "log_counts": """
        SELECT event_id AS section, CASE WHEN event_id % 3 = 0 THEN user_id END AS "new", CASE WHEN event_id % 3 = 1 THEN user_id END AS duplicate, NULL::BIGINT AS "similar", NULL::BIGINT AS updated FROM events""",
    "capability_summary": "SELECT bool_or(event_id % 3 = 0 AND user_id > 0) AS any_new, bool_or(event_id % 3 = 1 AND user_id > 0) AS any_duplicate, false AS any_similar, false AS any_updated FROM events",
    "pages_per_document": "SELECT conv_id AS document_id, count(*) AS pages, count(DISTINCT role) AS roles FROM conversations GROUP BY 1",
}

from . import flow_oracles, lookup_oracles, vector_oracles  # noqa: E402  (they use the parts above)

ORACLES |= lookup_oracles.ORACLES | vector_oracles.ORACLES | flow_oracles.ORACLES
