"""DuckDB SQL with the results of ``vector_queries``."""

from __future__ import annotations

from .oracles import _KNN, _UNITS

_PAIRS = "u AS (SELECT label::BIGINT AS l, embedding::DOUBLE[] AS v FROM embeddings)"

ORACLES: dict[str, str] = {
    "vector_index_search": f"WITH {_KNN} SELECT q_id, r_id, similarity, rank::INT AS rank FROM ranked WHERE rank <= 5 AND q_id % 50 = 0",
    "vector_index_other_documents": f"""
        WITH {_KNN}, o AS (SELECT q_id, r_id, similarity, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, r_id) AS rank FROM near WHERE ql <> rl AND q_id % 50 = 0)
        SELECT q_id, r_id, similarity, rank::INT AS rank FROM o WHERE rank <= 3""",
    "doc_pair_bands": f"""
        WITH {_UNITS}, p AS (SELECT a.document, b.document AS other, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM means a JOIN means b ON a.document < b.document)
        SELECT *, CASE WHEN similarity >= 0.10 THEN 'duplicate' ELSE 'similar' END AS status FROM p WHERE similarity >= 0.02""",
    "doc_pair_average_above": f"""
        WITH {_PAIRS} SELECT a.l AS document, b.l AS other, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS avg_similarity
        FROM u a JOIN u b ON a.l < b.l GROUP BY 1, 2 HAVING round(avg(list_cosine_similarity(a.v, b.v)), 6) >= 0.001""",
}
