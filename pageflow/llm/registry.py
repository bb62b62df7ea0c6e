"""Queries of the training-data operators and, where SQL can express one, their DuckDB text."""

from __future__ import annotations

import importlib

#: Query name -> (module, function).
QUERIES = {
    "op1_pii": ("pii", "op1_query"),
    "op2_mix": ("mix", "op2_query"),
    "op3_ngram_jaccard": ("jaccard", "op3_query"),
    "op4_line_dedup": ("line_dedup", "op4_query"),
    "op5_token_count": ("token_count", "op5_query"),
    "op6_lm_score": ("lm", "op6_query"),
    "op7_ann": ("ann", "op7_query"),
    "op8_shard": ("shard", "op8_query"),
    "op9_decontaminate": ("decontaminate", "op9_query"),
    "op10_language_id": ("langid", "op10_query"),
    "op11_quality_rules": ("quality", "op11_query"),
    "op12_source_divergence": ("divergence", "op12_query"),
    "op13_fill_middle": ("fill_middle", "op13_query"),
}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

ORACLE_SQL: dict[str, str] = {
    # All pairs that share a shingle; components by following links.
    "op3_ngram_jaccard": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)""",
    # Exact neighbours: on tables of a few thousand vectors queries open all leaves.
    "op7_ann": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    # Every kept term in every source of its language.
    "op12_source_divergence": f"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWERED}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
        v AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        o AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
        z AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN o USING (lang, source) GROUP BY ALL),
        p AS (SELECT z.lang, z.source, k.term, coalesce(o.c, 0) AS c, 1 + (1000000000 * (coalesce(o.c, 0) + 1)::HUGEINT) // (z.n + v.v) AS p, 1 + (1000000000 * (k.c + 1)::HUGEINT) // (v.n + v.v) AS q
          FROM z JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN o ON o.lang = z.lang AND o.source = z.source AND o.term = k.term),
        s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
        u AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u
        QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200""",
    # All windows of the length of some item window, looked up.
    "op9_decontaminate": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS t FROM i, LATERAL (SELECT unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s) WHERE len(w) > 0),
        pos AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM d, (SELECT DISTINCT n FROM win), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS s)),
        hit AS (SELECT r, s, pos.n, item_id FROM pos JOIN win ON pos.n = win.n AND pos.t = win.t),
        words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS x FROM hit) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256,
          coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), f) for name, (module, f) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
