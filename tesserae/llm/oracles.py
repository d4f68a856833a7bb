"""DuckDB SQL with the results of those queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "op2_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t FROM documents
        ), w AS (
            SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
                   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
            FROM d
        ), pos AS (
            SELECT row_number() OVER () AS rid, * FROM w
        ), win AS (
            SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
            FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM pos WHERE len(ws) >= 3)
        ), rep AS (
            SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n > 1
        ), cov AS (
            SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY rid
        ), m AS (
            SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                   (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                   len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                   coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
                   (length(t) - length(regexp_replace(t, '\p{L}', '', 'g')))::BIGINT AS n_letters,
                   (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper
            FROM pos LEFT JOIN cov USING (rid)
        ), f AS (
            SELECT *, n_words < 50 AS r0, 100 * n_repeat_words > 50 * n_words AS r1,
                   n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines AS r2, 10 * n_symbols > n_words AND n_words > 0 AS r3,
                   n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS r4,
                   n_words > 0 AND 10 * n_letters < 5 * word_chars AS r5, n_letters >= 100 AND 10 * n_upper > 5 * n_letters AS r6
            FROM m
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (r0 OR r1) AS base_failed,
               (r0::BIGINT + 2 * r1::BIGINT + 4 * r2::BIGINT + 8 * r3::BIGINT + 16 * r4::BIGINT + 32 * r5::BIGINT + 64 * r6::BIGINT)::BIGINT AS fail_bits,
               NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5 OR r6) AS kept, n_lines, n_letters, n_upper
        FROM f
    """,
    "op3_url_filters": r"""
        WITH p AS (
            SELECT row_number() OVER () AS rid, page_id, TIMESTAMP '2024-01-01' + to_hours((page_id % 8760)::INT) AS fetched_at,
                   lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
                   list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)?', 1), '/'), lambda x: x <> '') AS seg
            FROM pages
        ), hk AS (
            SELECT rid, host, seg, string_split(host, '.') AS lab FROM p WHERE host <> ''
        ), k AS (
            SELECT rid, array_to_string(lab[len(lab) - n + 1:], '.') AS key, n AS rank
            FROM (SELECT rid, lab, unnest(range(2, len(lab) + 1)) AS n FROM hk WHERE len(lab) >= 2)
            UNION ALL SELECT rid, host, 1 FROM hk WHERE len(lab) < 2
            UNION ALL SELECT rid, host || '/' || array_to_string(seg[1:n], '/'), 1000 + n
            FROM (SELECT rid, host, seg, unnest(range(1, len(seg) + 1)) AS n FROM hk)
        ), d AS (
            SELECT DISTINCT key, rank, ('0x' || substr(md5(key), 1, 6))::BIGINT AS h FROM k
        ), t AS (
            SELECT key, rank, h, TIMESTAMP '2024-01-01' + to_days((h % 300)::INT) AS since FROM d
        ), ev AS (
            SELECT key, 2 AS a, since FROM t WHERE h % 7 = 0
            UNION ALL SELECT key, 3, since + to_days(60) FROM t WHERE h % 14 = 0
            UNION ALL SELECT key, 1, since FROM t WHERE rank > 1000 AND h % 5 = 0
        ), one AS (
            SELECT key, since, min(a) AS a FROM ev GROUP BY key, since
        ), val AS (
            SELECT key, since, a, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM one
        ), hit AS (
            SELECT k.rid, k.rank, k.key, val.since, CASE val.a WHEN 1 THEN 'allow' ELSE 'block' END AS verdict,
                   row_number() OVER (PARTITION BY k.rid ORDER BY k.rank DESC, k.key DESC) AS rn
            FROM k JOIN p USING (rid) JOIN val ON val.key = k.key AND val.a < 3 AND val.since <= p.fetched_at AND (val.until IS NULL OR p.fetched_at < val.until)
        )
        SELECT page_id, fetched_at, coalesce(verdict, 'pass') AS verdict, key AS matched, since AS listed_since
        FROM p LEFT JOIN (SELECT * FROM hit WHERE rn = 1) USING (rid)
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}

_RULES = "('too_short', 1), ('repeated_windows', 2), ('duplicate_lines', 4), ('symbol_heavy', 8), ('word_length', 16), ('few_letters', 32), ('shouting', 64)"
ORACLES["quality_ablations"] = f"""
    WITH led AS ({ORACLES["op2_quality_rules"]}), r(rule, b) AS (VALUES {_RULES})
    SELECT rule, coalesce(sum((fail_bits & b <> 0)::INT), 0)::BIGINT AS failed, coalesce(sum((fail_bits = b)::INT), 0)::BIGINT AS only_rejected_by,
           coalesce(sum((fail_bits & (127 - b) = 0)::INT), 0)::BIGINT AS kept_without
    FROM r LEFT JOIN led ON true GROUP BY 1
"""

ORACLES["op11_divergence"] = r"""
    WITH d AS (
        SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
    ), w AS (
        SELECT rid, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
        FROM (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d)
    ), kept AS (
        SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 10
    ), g AS (
        SELECT DISTINCT lang, source FROM d
    ), c AS (
        SELECT g.lang, g.source, k.term, count(w.rid) AS n FROM g JOIN kept k USING (lang) LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term GROUP BY ALL
    ), p AS (
        SELECT *, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM c
    ), l AS (
        SELECT *, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q
        FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL)
    ), pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v, 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS o, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS v
                   FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f ON f.lang = a.lang AND f.s = a.source AND f.o = b.source
    ), terms AS (
        SELECT p.lang, p.source, 'term' AS part, term AS item, (p.p - q) * (p.p - q) // (p.p + q) AS value FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p.p > q
    )
    SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
    FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= 10
"""


def _lloyd(rounds: int) -> str:
    """Rounds of assignment and exact means, each a pair of tables."""
    sql = """
        kept AS (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS (
            SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1)::INT AS c, v FROM kept ORDER BY sha256('3:' || vec_id), v LIMIT 8
        )"""
    for r in range(rounds + 1):
        sql += f""", a{r} AS MATERIALIZED (
            SELECT rid, vec_id, min(d) AS d, arg_min(c, d * 8 + c) AS c FROM (
                SELECT rid, vec_id, c, list_sum(list_transform(list_zip(k.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept k, c{r}
            ) GROUP BY ALL
        )"""
        if r < rounds:
            sql += f""", s{r} AS MATERIALIZED (
            SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
                SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.c, unnest(k.v) AS x, generate_subscripts(k.v, 1) AS i FROM a{r} a JOIN kept k USING (rid)) GROUP BY c, i
            ) GROUP BY c
        ), c{r + 1} AS MATERIALIZED (
            SELECT c{r}.c, coalesce(s{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN s{r} USING (c)
        )"""
    return f"""
        WITH {sql}
        SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (c)
    """


ORACLES["op13_delta_lloyd"] = _lloyd(10)
