"""DuckDB SQL with the results of ``flow_queries``."""

from __future__ import annotations

from .lookup_oracles import ORACLES as _LOOKUPS


def _chunks_of(text: str) -> str:
    """The splitter's SQL over other texts of the documents."""
    return _LOOKUPS["chunk_document"].replace("FROM documents", f"FROM (SELECT doc_id, {text} AS text FROM documents)")


_FIRST = "text || chr(10) || chr(10) || 'file ' || doc_id"
_SECOND = f"{_FIRST} || CASE WHEN doc_id % 5 = 0 THEN chr(10) || chr(10) || 'One more line.' ELSE '' END"
_VERDICT = """
    SELECT document_id, {n} AS batch, count(*) AS total, sum(d)::BIGINT AS duplicate, 0::BIGINT AS "similar", sum(1 - d)::BIGINT AS new,
           CASE WHEN sum(1 - d) = 0 THEN 'minor' ELSE 'major' END AS verdict, round(sum(d) / count(*), 6) AS rate FROM {t} GROUP BY 1"""

ORACLES: dict[str, str] = {
    "stream_daily_usage": """
        SELECT ts::DATE AS date, event_type AS model, count(*) AS calls, sum(floor(value))::BIGINT AS input_tokens, sum(user_id)::BIGINT AS output_tokens FROM events GROUP BY ALL""",
    "document_vectors_kept": """
        WITH p AS (SELECT vec_id, label::BIGINT AS document, CASE WHEN vec_id % 7 = 0 THEN list_reverse(embedding) ELSE embedding END::DOUBLE[] AS v FROM embeddings WHERE vec_id % 11 <> 3 OR vec_id % 7 = 0),
        u AS (SELECT document, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM p)
        SELECT document, count(*) AS pages, (i - 1)::INT AS dim, round(avg(u[i]), 6) + 0.0 AS value FROM (SELECT document, u, unnest(range(1, 65)) AS i FROM u) GROUP BY document, i""",
    "model_calls_in_batches": """
        SELECT doc_id AS id, CASE WHEN doc_id % 50 <> 7 THEN length(text) END::BIGINT AS size, CASE WHEN doc_id % 50 = 7 THEN 'ConnectionError: refused' END AS error FROM documents""",
    "ingestion_batches": f"""
        WITH a AS ({_chunks_of(_FIRST)}), b AS ({_chunks_of(_SECOND)}),
        x AS (SELECT document_id, 0 AS d FROM a),
        o AS (SELECT chunk_hash, min(document_id::VARCHAR) AS lo, max(document_id::VARCHAR) AS hi FROM a GROUP BY 1),
        y AS (SELECT document_id, coalesce(lo <> document_id::VARCHAR OR hi <> document_id::VARCHAR, false)::INT AS d FROM b LEFT JOIN o USING (chunk_hash) WHERE document_id % 5 = 0)
        {_VERDICT.format(n=1, t="x")} UNION ALL {_VERDICT.format(n=2, t="y")}""",
    "ingestion_watch": f"SELECT document_id, chunk_index::BIGINT AS chunk_index, chunk_hash FROM ({_chunks_of(_SECOND)})",
    "requirement_ingestion": r"""
        WITH r AS (
            SELECT doc_id, unnest(ls) AS src, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '')[1:2] AS ls FROM documents)
        ), q AS (
            SELECT doc_id, doc_id * 10 + i AS number, doc_id || ':' || lpad(i::VARCHAR, 4, '0') AS rid, substr(src, 1, 300) AS de, substr(src, 1, 20) || chr(10) || substr(src, 1, 300) AS tx FROM r
        ), v AS (
            SELECT *, list_transform(['a', 'e', 'i', 'o', 'u', 'd', 'n', 'r', 's', 't'], lambda c: (length(tx) - length(replace(tx, c, '')))::DOUBLE) AS v FROM q
        ), st AS (SELECT * FROM v WHERE doc_id % 2 = 0),
        cp AS (SELECT c.doc_id, s.* EXCLUDE (doc_id), s.doc_id AS od FROM documents c JOIN st s ON s.doc_id = c.doc_id - 1 WHERE c.doc_id % 9 = 0 AND c.doc_id % 2 = 1),
        nw AS (SELECT * FROM v WHERE doc_id % 2 = 1 AND doc_id NOT IN (SELECT doc_id FROM cp)),
        nn AS (
            SELECT n.rid, n.de, s.rid AS old, s.de AS ode, round(list_cosine_similarity(n.v, s.v), 6) AS sim FROM nw n, st s
            WHERE list_dot_product(n.v, n.v) > 0 AND list_dot_product(s.v, s.v) > 0
            QUALIFY row_number() OVER (PARTITION BY n.rid ORDER BY round(list_cosine_similarity(n.v, s.v), 6) DESC, s.number) = 1
        ), j AS (
            SELECT rid, old, sim, CASE WHEN sim >= 0.998 THEN true WHEN lower(de[1]) = 's' THEN false ELSE abs(length(de) - length(ode)) <= 20 END AS dup,
                   CASE WHEN sim >= 0.998 THEN sim WHEN lower(de[1]) = 's' THEN NULL ELSE 0.75 END AS conf FROM nn WHERE sim >= 0.992
        ), a AS (
            SELECT rid, doc_id, NULL::VARCHAR AS cf, de, false AS dup, NULL::VARCHAR AS dof, NULL::DOUBLE AS conf FROM st
            UNION ALL SELECT nw.rid, doc_id, NULL, de, coalesce(dup, false), CASE WHEN dup THEN old END, conf FROM nw LEFT JOIN j USING (rid)
        ), f AS (
            SELECT *, CASE WHEN dup THEN NULL ELSE lower(de[1]) <> 't' AND contains(de, 'x') END AS sw, CASE WHEN dup THEN NULL WHEN lower(de[1]) = 't' THEN 0.5 ELSE 0.75 END AS sc,
                   CASE WHEN NOT dup AND lower(de[1]) = 't' THEN 'ConnectionError: refused' END AS er FROM a
        )
        SELECT rid AS requirement_id, doc_id::VARCHAR AS source_chunk_id, cf AS copied_from, md5(de) AS hash, dup AS is_duplicate, dof AS duplicate_of, conf::DOUBLE AS confidence,
               sw AS is_software_related, sc::DOUBLE AS software_confidence, er AS error FROM f
        UNION ALL
        SELECT c.doc_id || ':' || split_part(c.rid, ':', 2), c.doc_id::VARCHAR, c.od::VARCHAR, md5(c.de), f.dup, f.dof, NULL, f.sw, f.sc, NULL FROM cp c JOIN f ON f.rid = c.rid
    """,
    "page_metadata": r"""
        WITH w AS (SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') ELSE [] END AS w FROM documents)
        SELECT doc_id AS document_id, array_to_string(w[1:6], ' ') AS title, md5(array_to_string(w[1:30], ' ')) AS summary_hash,
               array_to_string(list_transform(w[1:3], lambda x: '#' || lower(x)), ',') AS hashtags, doc_id % 13 = 0 AS error_flag FROM w""",
}
