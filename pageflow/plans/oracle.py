"""DuckDB text for the queries of ``queries``. It works from lines and numbers, never by parsing marked-up text."""

from __future__ import annotations

from pageflow.functions.text import DIGITS, FULL_DIGITS, LINE_START
from pageflow.operators.naming import TYPES
from pageflow.plans.queries import RUN_DATE
from pageflow.sources.fixtures import EXTENSIONS
from pageflow.sources.io import KINDS, MEDIA

WS = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def md(x: str, name: str) -> str:
    return f"length({x})::BIGINT AS {name}_len, md5({x}) AS {name}_md5"


def in_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: Lines of documents: d, p from 1, raw, body, and what the fixtures' rules say of the page.
LINES = f"""lines AS (
  SELECT d, p, raw, {trim("raw")} AS body, p % 5 = 0 AS ec, (p % 8 = 1 AND p > 1) AS bc, (d + p) % 13 = 0 AS failed,
         CASE WHEN p % 7 = 0 THEN NULL WHEN p % 29 = 0 THEN 1 ELSE p + 2 + (p >= 11)::BIGINT END AS pr
  FROM (SELECT doc_id AS d, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS p
        FROM documents WHERE text IS NOT NULL))"""
#: Pages of the faulty documents: d, pos, p, body, failed.
FAULTY = f"""{LINES}, kept AS (
  SELECT d, p, 0 AS g, CASE WHEN failed THEN '' ELSE body END AS body, failed, bc, ec FROM lines WHERE (d + p) % 17 <> 0
  UNION ALL SELECT d, p, 1, {trim("raw || '!'")}, false, bc, ec FROM lines WHERE (d + p) % 17 <> 0 AND (d + p) % 19 = 0
), pages AS (SELECT d, p, body, failed, bc, ec, row_number() OVER (PARTITION BY d ORDER BY g, p) AS pos FROM kept)"""
COUNTS = "counts AS (SELECT doc_id AS d, len(string_split(text, chr(10)))::BIGINT AS n FROM documents WHERE text IS NOT NULL)"
#: Split entries: d, e, lo, hi.
DEFS = f"""{COUNTS}, defs AS (
  SELECT d, k::BIGINT AS e, k * 5 + 1 AS lo, k * 5 + 4 AS hi FROM counts, LATERAL (SELECT unnest(range(0, ceil(n / 5)::BIGINT)) AS k)
  UNION ALL SELECT d, ceil(n / 5)::BIGINT, 2, 6 FROM counts)"""
#: Pending pages in batches of four: d, b, i from 0, p, raw; and the batches.
BATCHES = f"""{LINES}, pend AS (SELECT d, p, raw, row_number() OVER (PARTITION BY d ORDER BY p) - 1 AS r FROM lines WHERE (d + p) % 3 <> 0),
  inb AS (SELECT d, p, raw, r // 4 + 1 AS b, r % 4 AS i FROM pend),
  batches AS (SELECT d, b, count(*) AS n, string_agg(p::VARCHAR, ',' ORDER BY p) AS ps FROM inb GROUP BY ALL)"""
NL = "chr(10)"
#: Answers to the batches: h decides what comes back.
ANSWERS = f"""{BATCHES}, full_text AS (
  SELECT d, b, d + b AS h, count(*) AS n,
    string_agg(CASE WHEN i = 0 AND (d + b) % 17 = 0 THEN '' ELSE '### -- Begin Page ' || (i + 1) || ' --' || {NL} END || raw || {NL} || '### -- End --', {NL} || {NL} ORDER BY i) AS t
  FROM inb GROUP BY d, b), answers AS (
  SELECT *, CASE WHEN h % 11 = 0 THEN 'none' WHEN h % 7 = 0 THEN 'twice' WHEN h % 13 = 0 THEN 'broken' WHEN h % 5 = 0 THEN 'error' ELSE 'good' END AS kind FROM full_text)"""
ALIGNED = f"""{ANSWERS}, aligned AS (
  SELECT d, b, h, n, CASE kind WHEN 'twice' THEN t || '?' WHEN 'good' THEN t END AS t,
    CASE kind WHEN 'none' THEN 'no result for this request' WHEN 'broken' THEN 'no result for this request' WHEN 'error' THEN 'quota' END AS error FROM answers)"""
LOG = """log AS (SELECT event_id, user_id AS j, ts::TIMESTAMP AS ts, event_type AS state, event_type <> 'error' AS ok, floor(epoch(ts::TIMESTAMP))::BIGINT AS s FROM events)"""
FILES = f"files AS (SELECT doc_id, source, '/in/' || source || '/' || doc_id || ({in_list(EXTENSIONS)})[doc_id % 9 + 1] AS path, '/in/' || source || '/' || doc_id AS base FROM documents)"
OUTPUTS = f"""{FILES}, outs AS (
  SELECT base || '_paged.md' AS path FROM files WHERE doc_id % 2 = 0 UNION ALL SELECT base || '_ERROR_paged.md' FROM files WHERE doc_id % 3 = 0
  UNION ALL SELECT base || '_merged.md' FROM files WHERE doc_id % 5 = 0 UNION ALL SELECT base || '_ERROR_merged.md' FROM files WHERE doc_id % 7 = 0)"""
COMPANIONS = f"""{OUTPUTS}, companions AS (
  SELECT doc_id, path, k AS kind, base || (['_paged.md', '_ERROR_paged.md', '_merged.md', '_ERROR_merged.md'])[k + 1] AS output
  FROM files, (SELECT unnest([0, 1, 2, 3])::BIGINT AS k) WHERE doc_id % ([2, 3, 5, 7])[k + 1] = 0)"""


def normal(x: str) -> str:
    return trim(f"regexp_replace(regexp_replace(replace(coalesce({x}, ''), chr(13) || chr(10), chr(10)), '[ \\t\\x{{3000}}]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def sanitized(x: str) -> str:
    a = f"regexp_replace({normal(x)}, '[<>:\"/\\\\|?*\\x00-\\x1F]', ' ', 'g')"
    a = f"regexp_replace(regexp_replace({a}, '_+', ' ', 'g'), '{WS}{{2,}}', ' ', 'g')"
    a = f"regexp_replace(regexp_replace({a}, '^(?:{WS}|\\.)+', ''), '(?:{WS}|\\.)+$', '')"
    return f"coalesce(nullif(CASE WHEN length({a}) > 80 THEN {trim(f'left({a}, 80)')} ELSE {a} END, ''), '表題不明')"


def reflow(source: str, keys: str) -> str:
    """Lines put together by their predecessor; ``source`` gives the keys and text."""
    ends, starts = r"[。．！？!?：:；;」』）)】\]]$", LINE_START
    return f"""WITH l AS (SELECT {keys}, {trim("line")} AS line, i FROM (SELECT {keys}, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line,
        generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS i FROM ({source}))),
      b AS (SELECT *, lag(line) OVER (PARTITION BY {keys} ORDER BY i) AS before FROM l),
      f AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY i) AS r FROM b WHERE line <> ''),
      t AS (SELECT {keys}, string_agg(CASE WHEN r = 1 THEN '' WHEN before = '' THEN chr(10) || chr(10) WHEN regexp_matches(before, '{ends}') OR regexp_matches(line, '{starts}') THEN chr(10) ELSE '' END || line, '' ORDER BY i) AS text FROM f GROUP BY {keys}),
      a AS (SELECT {keys}, coalesce(t.text, '') AS text FROM ({source}) s LEFT JOIN t USING ({keys}))
      SELECT {keys}, {md("text", "text")} FROM a"""


JSON_KIND = f"({in_list([*TYPES, '?', '??'])})[d % 14 + 1]"
ORACLE = {
    "remove_blank": f"WITH {LINES} SELECT d AS doc_id, p AS old_page, row_number() OVER (PARTITION BY d ORDER BY p) AS new_page, {md('body', 'body')} FROM lines WHERE length(body) > 10",
    "parse_pages": f"WITH {FAULTY} SELECT d AS doc_id, pos, p AS page_num, {md('body', 'body')} FROM pages",
    "last_wins": f"WITH {FAULTY} SELECT d AS doc_id, p AS page_num, pos, {md('body', 'body')} FROM pages WHERE NOT failed QUALIFY row_number() OVER (PARTITION BY d, p ORDER BY pos DESC) = 1",
    "page_markers": f"WITH {LINES} SELECT d AS doc_id, p AS pos, p AS page_num, bc AS begin_continues, ec AS end_continues, pr AS printed FROM lines",
    "render_dash": f"WITH {LINES} SELECT d AS doc_id, p AS page_num, {md('body', 'body')} FROM lines",
    "fill_missing": f"WITH {FAULTY}, good AS (SELECT DISTINCT d, p FROM pages WHERE NOT failed) SELECT l.d AS doc_id, l.p AS page_num, g.d IS NULL AS missing, g.d IS NULL AS is_error FROM lines l LEFT JOIN good g ON l.d = g.d AND l.p = g.p",
    "flag_blank": f"WITH {FAULTY} SELECT d AS doc_id, pos, p AS page_num, length(body) <= 10 AS is_blank, failed AS is_error FROM pages",
    "renumber": f"WITH {FAULTY}, m AS (SELECT d, pos, p, '### -- Begin Page ' || pos || CASE WHEN bc AND NOT failed THEN ' (Continuation)' ELSE '' END || ' --' AS marker FROM pages) SELECT d AS doc_id, pos, p AS old_page, pos AS page_num, {md('marker', 'marker')} FROM m",
    "select_pages": f"WITH {LINES} SELECT d AS doc_id, p AS page_num FROM lines WHERE p BETWEEN 3 AND 7",
    "has_text": f"WITH {LINES} SELECT d AS doc_id, p AS page_num FROM lines WHERE body <> ''",
    "page_source": f"WITH {LINES}, s AS (SELECT d, p, CASE WHEN (d + p) % 3 = 0 THEN 'embedded' WHEN (d + p) % 4 <> 1 THEN 'ocr' ELSE 'none' END AS source, raw FROM lines), x AS (SELECT d, p, source, CASE source WHEN 'none' THEN '[未検出]' ELSE raw END AS t FROM s) SELECT d AS doc_id, p AS page_num, source, {md('t', 'text')} FROM x",
    "reflow": reflow("SELECT conv_id AS doc_id, turn + 1 AS page_num, text FROM conversations", "doc_id, page_num"),
    "reflow_documents": reflow("SELECT doc_id, text FROM documents WHERE text IS NOT NULL", "doc_id"),
    "normalize_ws": f"SELECT doc_id, {md(normal('text'), 'text')} FROM documents",
    "normalize_digits": f"WITH {LINES} SELECT d AS doc_id, p AS page_num, CASE WHEN d % 2 = 0 THEN length(regexp_replace(raw, '[^0-9]', '', 'g')) ELSE length(regexp_replace(raw, '[^{FULL_DIGITS}]', '', 'g')) END::BIGINT AS n_wide, {md(f'''translate(raw, '{FULL_DIGITS}', '{DIGITS}')''', 'text')} FROM lines",
    "annotations": f"""WITH {LINES}, notes AS (
        SELECT d, p, 'picture' AS kind, 1 AS n, 'picture ' || p AS t FROM lines WHERE p % 2 = 0 UNION ALL SELECT d, p, 'heading', 1, 'margin' FROM lines WHERE p % 3 = 0
        UNION ALL SELECT d, p, 'note', 1, 'note' FROM lines WHERE p % 4 = 0 UNION ALL SELECT d, p, 'note', 2, 'more' FROM lines WHERE p % 4 = 0
        UNION ALL SELECT d, p, 'as_is', 1, 'as is' FROM lines WHERE p % 5 = 0 UNION ALL SELECT d, p, 'redaction', 1, '■' FROM lines WHERE p % 6 = 0 UNION ALL SELECT d, p, 'redaction', 2, '■' FROM lines WHERE p % 6 = 0)
        SELECT d AS doc_id, kind, count(*) AS n, max(n)::BIGINT AS most, min(t) AS least FROM notes GROUP BY d, kind""",
    "page_stats": f"WITH {FAULTY} SELECT d AS doc_id, count(*) AS n_pages, max(p) AS max_page, count(*) FILTER (length(body) <= 10) AS n_blank, count(*) FILTER (length(body) > 10) AS n_kept, coalesce(string_agg(p::VARCHAR, ',' ORDER BY p) FILTER (length(body) <= 10), '') AS blank_pages FROM pages GROUP BY d",
    "page_ranges": f"WITH {FAULTY}, x AS (SELECT d, p, p - row_number() OVER (PARTITION BY d ORDER BY p) AS i FROM (SELECT DISTINCT d, p FROM pages)) SELECT d AS doc_id, min(p) AS start_page, max(p) AS end_page FROM x GROUP BY d, i",
    "marker_counts": f"WITH {FAULTY} SELECT doc_id, count(p) AS n_begin, count(p) FILTER (NOT failed) AS n_end FROM documents LEFT JOIN pages ON doc_id = d WHERE text IS NOT NULL GROUP BY doc_id",
    "upsert_pages": f"WITH {FAULTY}, b AS (SELECT *, 0 AS g2 FROM pages WHERE (d + p) % 3 = 0 UNION ALL SELECT *, 1 FROM pages WHERE (d + p) % 2 = 0) SELECT d AS doc_id, p AS page_num, pos, {md('body', 'body')} FROM b QUALIFY row_number() OVER (PARTITION BY d, p ORDER BY g2 DESC, pos DESC) = 1",
    "head_tail": f"WITH {FAULTY}, g AS (SELECT d, pos, p, row_number() OVER (PARTITION BY d ORDER BY pos) AS a, row_number() OVER (PARTITION BY d ORDER BY pos DESC) AS z FROM pages WHERE NOT failed) SELECT d AS doc_id, pos, p AS page_num FROM g WHERE a <= 4 OR z <= 4",
    "split_docs": f"WITH {LINES}, {DEFS} SELECT l.d AS doc_id, e AS entry_no, 'part-' || e || '.md' AS filename, p AS old_page, row_number() OVER (PARTITION BY l.d, e ORDER BY p) AS page_num, md5(body) AS body_md5 FROM lines l JOIN defs ON l.d = defs.d AND p BETWEEN lo AND hi",
    "split_missing": f"WITH {FAULTY}, {DEFS}, w AS (SELECT d, e, unnest(range(lo, hi + 1)) AS p FROM defs) SELECT w.d AS doc_id, e AS entry_no, string_agg(w.p::VARCHAR, ',' ORDER BY w.p) AS missing FROM w ANTI JOIN pages ON w.d = pages.d AND w.p = pages.p GROUP BY w.d, e",
    "split_uncovered": f"WITH {LINES}, {DEFS} SELECT d AS doc_id, p AS page_num FROM lines l WHERE NOT EXISTS (SELECT 1 FROM defs WHERE defs.d = l.d AND l.p BETWEEN lo AND hi)",
    "split_manifest": f"WITH {DEFS}, c AS (SELECT defs.d, e, lo, least(hi, n) AS hi FROM defs JOIN counts ON defs.d = counts.d), s AS (SELECT d, e, lo, unnest(range(lo, hi + 1)) AS p FROM c WHERE lo <= hi) SELECT d AS doc_id, e AS entry_no, p AS source_page, p - lo + 1 AS target_page FROM s",
    "coverage": f"WITH {DEFS}, w AS (SELECT d, unnest(range(lo, hi + 1)) AS p FROM defs) SELECT d AS doc_id, count(DISTINCT p) AS covered FROM w GROUP BY d",
    "pending_pages": f"WITH {LINES} SELECT d AS doc_id, p AS page_num FROM lines WHERE (d + p) % 3 <> 0",
    "merge_pages": f"""WITH {LINES}, g AS (SELECT d, p, CASE WHEN p = 1 OR bc OR lag(ec) OVER (PARTITION BY d ORDER BY p) THEN '' ELSE chr(10) || chr(10) END || body AS t FROM lines),
        m AS (SELECT d, regexp_replace(string_agg(t, '' ORDER BY p), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM g GROUP BY d) SELECT d AS doc_id, {md('t', 'merged')} FROM m""",
    "merge_with_head": f"""WITH {LINES}, g AS (SELECT d, p, CASE WHEN p = 1 AND d % 3 = 0 THEN 'Head of ' || d || chr(10) || chr(10) WHEN p = 1 OR bc OR lag(ec) OVER (PARTITION BY d ORDER BY p) THEN '' ELSE chr(10) || chr(10) END || body AS t FROM lines),
        m AS (SELECT d, CASE WHEN d % 3 <> 0 AND d % 7 = 0 THEN 'no marker' ELSE regexp_replace(string_agg(t, '' ORDER BY p), '\\n{{3,}}', chr(10) || chr(10), 'g') END AS t FROM g GROUP BY d) SELECT d AS doc_id, {md('t', 'merged')} FROM m""",
    "without_markers": "SELECT doc_id FROM documents WHERE doc_id % 5 <> 0",
    "strip_legacy": f"""WITH {LINES}, x AS (SELECT d, p, regexp_replace(raw, '^{WS}+', '') AS t, lead(p) OVER (PARTITION BY d ORDER BY p) AS nx FROM lines),
        m AS (SELECT d, string_agg(CASE WHEN nx % 3 = 0 THEN regexp_replace(t, '{WS}+$', '') WHEN nx IS NULL OR t = '' THEN t ELSE t || chr(10) END, '' ORDER BY p) AS t FROM x GROUP BY d) SELECT d AS doc_id, {md('t', 'text')} FROM m""",
    "read_results": f"""WITH {ANSWERS}, r AS (
        SELECT CASE WHEN kind <> 'broken' THEN 'request-' || b END AS key, CASE kind WHEN 'broken' THEN 'JSON parse failed' WHEN 'error' THEN 'quota' END AS error, CASE WHEN kind IN ('good', 'twice') THEN t END AS t FROM answers WHERE kind <> 'none'
        UNION ALL SELECT 'request-' || b, NULL, t || '?' FROM answers WHERE kind = 'twice') SELECT key, error, md5(t) AS text_md5, count(*) AS n FROM r GROUP BY ALL""",
    "split_gaps": f"""WITH {FAULTY}, {DEFS}, w AS (SELECT d, e, unnest(range(lo, hi + 1)) AS p FROM defs), a AS (SELECT w.d, e, w.p, w.p - row_number() OVER (PARTITION BY w.d, e ORDER BY w.p) AS k FROM w ANTI JOIN pages ON w.d = pages.d AND w.p = pages.p),
        far AS (SELECT l.d, -1 AS e, l.p, l.p - row_number() OVER (PARTITION BY l.d ORDER BY l.p) AS k FROM lines l ANTI JOIN pages ON l.d = pages.d AND l.p = pages.p),
        ends AS (SELECT lines.d, max(lines.p) AS last FROM lines GROUP BY 1),
        runs AS (SELECT d, e, min(p) AS s, max(p) AS t FROM a GROUP BY d, e, k UNION ALL SELECT d, e, min(p), max(p) FROM far GROUP BY d, e, k),
        tail AS (SELECT d, last + 1 AS s FROM ends), joined AS (SELECT d, e, s, t FROM runs WHERE e <> -1 UNION ALL
          SELECT r.d, -1, r.s, CASE WHEN r.t = last THEN 2000000000 ELSE r.t END FROM runs r JOIN ends USING (d) WHERE r.e = -1
          UNION ALL SELECT d, -1, s, 2000000000 FROM tail WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.d = tail.d AND r.e = -1 AND r.t = tail.s - 1))
        SELECT d AS doc_id, e::BIGINT AS entry_no, s AS start_page, t AS end_page FROM joined""",
    "audit_sequence": f"WITH {FAULTY}, x AS (SELECT d, pos, p, lag(p) OVER (PARTITION BY d ORDER BY pos) AS b FROM pages) SELECT d AS doc_id, CASE WHEN b IS NULL THEN 'FIRST_NOT_1' ELSE 'JUMP' END AS code, b AS page_prev, p AS page_cur FROM x WHERE (b IS NULL AND p <> 1) OR p <> b + 1",
    "audit_printed": f"WITH {LINES}, x AS (SELECT d, p, pr, lag(p) OVER w AS b, lag(pr) OVER w AS c FROM lines WHERE pr IS NOT NULL WINDOW w AS (PARTITION BY d ORDER BY p)) SELECT d AS doc_id, b AS page_prev, p AS page_cur, c AS printed_prev, pr AS printed_cur, CASE WHEN pr <= c THEN 'REVERSED' ELSE 'SUSPECT_GAP' END AS code FROM x WHERE b IS NOT NULL AND (pr <= c OR pr - c <> p - b)",
    "find_boundaries": f"WITH {LINES}, s AS (SELECT d, p, p = 1 OR ((d + p) % 4 = 0 AND NOT lag(ec) OVER (PARTITION BY d ORDER BY p)) AS st FROM lines), g AS (SELECT d, p, count(*) FILTER (st) OVER (PARTITION BY d ORDER BY p) AS e FROM s) SELECT d AS doc_id, e AS entry_no, min(p) AS start_page, max(p) AS end_page FROM g GROUP BY d, e",
    "outline": f"""WITH {LINES}, o AS (
        SELECT d, p, 0 AS i, CASE p % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'paren' ELSE 'block' END AS level, CASE p % 4 WHEN 0 THEN '第' || p || ' 章' WHEN 1 THEN '(' || p || ') x' ELSE '### --左' END AS t FROM lines WHERE p % 4 <> 3
        UNION ALL SELECT d, p, 1, 'paren', {trim("'(1) ' || raw")} FROM lines WHERE {trim("raw")} = '' UNION ALL SELECT d, p, 1, 'paren', '(1) ' || raw FROM lines WHERE {trim("raw")} <> ''
        UNION ALL SELECT d, p, 2, CASE WHEN regexp_matches(t, '^第[0-9]+') THEN 'article' WHEN regexp_matches(t, '^[0-9]+[ .　]') THEN 'number' WHEN regexp_matches(t, '^\\([0-9]+\\)') THEN 'paren' WHEN regexp_matches(t, '^[ア-ン][ 　]') THEN 'kana'
            WHEN regexp_matches(t, '^\\([ア-ン]\\)') THEN 'paren_kana' WHEN regexp_matches(t, '^[a-z][ .　]') THEN 'letter' WHEN regexp_matches(t, '^\\([a-z]\\)') THEN 'paren_letter' WHEN regexp_matches(t, '^### --') THEN 'block' END, t
          FROM (SELECT d, p, regexp_replace(raw, '{WS}+$', '') AS t FROM lines))
        SELECT d AS doc_id, p AS page_num, i::BIGINT AS line_no, level, {md('t', 'heading')} FROM o WHERE level IS NOT NULL""",
    "pack_pages": f"WITH {BATCHES} SELECT d AS doc_id, b AS batch_no, ps AS pages, n AS num_pages FROM batches",
    "request_text": f"WITH {BATCHES}, t AS (SELECT d, b, string_agg({NL} || '### -- Begin Page ' || (i + 1) || ' --' || {NL} || coalesce(nullif(raw, ''), '[未検出]') || {NL} || '### -- End --' || {NL}, '' ORDER BY i) AS t FROM inb GROUP BY d, b) SELECT d AS doc_id, b AS batch_no, {md('t', 'payload')} FROM t",
    "request_parts": f"WITH {BATCHES} SELECT d AS doc_id, b AS batch_no, true AS same, sum(length(coalesce(nullif(raw, ''), '[未検出]')) + 38 + length((i + 1)::VARCHAR))::BIGINT AS payload_len FROM inb GROUP BY d, b",
    "route_by_size": f"WITH {BATCHES}, s AS (SELECT d, sum(strlen(coalesce(nullif(raw, ''), '[未検出]')) + 38 + length((i + 1)::VARCHAR))::BIGINT + count(DISTINCT b) - 1 AS n FROM inb GROUP BY d) SELECT d AS doc_id, n AS job_bytes, CASE WHEN n < 4000 THEN 'inline' ELSE 'file' END AS route, n > 8000 AS inline_refused FROM s",
    "assign_workers": f"WITH {BATCHES} SELECT d AS doc_id, b AS batch_no, (b - 1 + ('0x' || left(md5(d::VARCHAR), 8))::BIGINT) % 5 AS worker FROM batches",
    "normalize_results": f"""WITH {ANSWERS}, r AS (
        SELECT d, b * 2 AS line_no, CASE WHEN kind <> 'broken' THEN 'request-' || b END AS key, CASE kind WHEN 'broken' THEN 'JSON parse failed' WHEN 'error' THEN 'quota' END AS error, CASE WHEN kind IN ('good', 'twice') THEN t END AS t FROM answers WHERE kind <> 'none'
        UNION ALL SELECT d, b * 2 + 1, 'request-' || b, NULL, t || '?' FROM answers WHERE kind = 'twice') SELECT d AS doc_id, line_no, key, error, {md('t', 'text')} FROM r""",
    "align_results": f"WITH {ALIGNED} SELECT d AS doc_id, b AS request_no, error, {md('t', 'text')} FROM aligned",
    "validate_batch": f"WITH {ALIGNED} SELECT d AS doc_id, b AS request_no, CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN h % 17 = 0 THEN 'BEGIN_COUNT' END AS error_code FROM aligned",
    "to_absolute": f"""WITH {ALIGNED}, x AS (SELECT i.d, p, '### -- Begin Page ' || p || ' --' || {NL} || raw || {NL} || '### -- End --' || CASE WHEN kind2 AND i = n - 1 THEN '?' ELSE '' END AS t
        FROM (SELECT *, h % 11 <> 0 AND h % 7 = 0 AS kind2 FROM aligned) a JOIN inb i ON a.d = i.d AND a.b = i.b WHERE error IS NULL AND h % 17 <> 0) SELECT d AS doc_id, p AS page_num, {md('t', 'content')} FROM x""",
    "doc_status": f"WITH {FAULTY} SELECT d AS doc_id, CASE WHEN bool_or(failed) THEN 'error' ELSE 'complete' END AS status, coalesce(string_agg(p::VARCHAR, ',' ORDER BY p) FILTER (failed), '') AS failed_pages FROM pages GROUP BY d",
    "batch_counts": f"WITH {LOG} SELECT j AS job_id, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, count(*) AS total FROM log GROUP BY j",
    "progress": f"""WITH {LOG}, x AS (SELECT event_id, j, count(*) OVER (PARTITION BY j ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY j) AS total, s - min(s) OVER (PARTITION BY j) AS el FROM log),
        y AS (SELECT *, total - done AS rem, el * (total - done) // done AS eta FROM x)
        SELECT event_id, j AS job_id, done, total, el AS elapsed_s, el // done AS mean_s, rem AS remaining, eta AS eta_s, CASE WHEN eta // 3600 < 100 THEN lpad((eta // 3600)::VARCHAR, 2, '0') ELSE (eta // 3600)::VARCHAR END || ':' || lpad((eta % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((eta % 60)::VARCHAR, 2, '0') AS eta FROM y""",
    "stalled": f"""WITH {LOG}, x AS (SELECT j, s, min(s) OVER (PARTITION BY j) AS f, last_value(CASE WHEN ok THEN s END IGNORE NULLS) OVER (PARTITION BY j ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM log),
        y AS (SELECT j, max(s) - min(s) AS w, max(s - coalesce(l, f)) AS i FROM x GROUP BY j) SELECT j AS job_id, w AS waited_s, i AS longest_idle_s, w > 1728000 AS over_wait, i > 86400 AS over_idle FROM y""",
    "stalled_now": f"""WITH {LOG}, m AS (SELECT floor(epoch(max(ts)))::BIGINT AS now FROM log), x AS (SELECT j, s, ok, min(s) OVER (PARTITION BY j) AS f, last_value(CASE WHEN ok THEN s END IGNORE NULLS) OVER (PARTITION BY j ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM log),
        e AS (SELECT j, arg_max(state, (ts, event_id)) = 'purchase' AS done FROM log GROUP BY j),
        y AS (SELECT j, any_value(done) AS done, max(s) - min(s) AS w, max(s - coalesce(l, f)) AS i, any_value(now) - min(s) AS w2, any_value(now) - coalesce(max(CASE WHEN ok THEN s END), min(s)) AS q FROM x JOIN e USING (j), m GROUP BY j),
        z AS (SELECT j, CASE WHEN done THEN w ELSE w2 END AS w, CASE WHEN done THEN i ELSE greatest(i, q) END AS i FROM y) SELECT j AS job_id, w AS waited_s, i AS longest_idle_s, w > 1728000 AS over_wait, i > 86400 AS over_idle FROM z""",
    "resumable": f"""WITH {LOG}, x AS (SELECT j, count(*) AS n, CASE WHEN j % 2 = 0 THEN count(*) ELSE count(*) FILTER (state <> 'view') END AS m, arg_max(state, (ts, event_id)) AS st FROM log GROUP BY j)
        SELECT j AS job_id, st AS state, n = m AND st NOT IN ('error', 'purchase') AS resumable, n = m AS count_matches FROM x""",
    "parse_decision": f"""WITH {LINES}, x AS (SELECT d, raw, d % 10 = 9 AS bare, {JSON_KIND} AS kind FROM lines WHERE p = 1)
        SELECT d AS doc_id, CASE WHEN NOT bare AND d % 14 <= 12 AND d % 33 <= 31 THEN '2024-' || lpad((d % 14)::VARCHAR, 2, '0') || '-' || lpad((d % 33)::VARCHAR, 2, '0') ELSE '{RUN_DATE}' END AS date,
          CASE WHEN NOT bare AND kind NOT IN ('?', '??') THEN kind ELSE 'その他' END AS document_type, {sanitized("CASE WHEN bare THEN " + trim("raw") + " ELSE raw END")} AS title FROM x""",
    "sanitize_title": f"WITH {LINES} SELECT d AS doc_id, p AS page_num, {sanitized(chr(39) + ' ._' + chr(39) + ' || raw || ' + chr(39) + ':*. ' + chr(39))} AS title FROM lines",
    "is_named": "SELECT doc_id, doc_id % 3 = 0 AS is_named FROM documents",
    "excerpt": f"""WITH {LINES}, g AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY p) AS a, row_number() OVER (PARTITION BY d ORDER BY p DESC) AS z FROM lines),
        m AS (SELECT d, string_agg('### -- Begin Page ' || p || CASE WHEN bc THEN ' (Continuation)' ELSE '' END || ' --' || {NL} || raw || {NL} || '### -- End' || coalesce(' (Printed Page ' || pr || ')', '') || CASE WHEN ec THEN ' (Continuation)' ELSE '' END || ' --', {NL} || {NL} ORDER BY p) AS t FROM g WHERE a <= 4 OR z <= 4 GROUP BY d)
        SELECT d AS doc_id, {md('t', 'excerpt')} FROM m""",
    "head_tail_text": f"WITH x AS (SELECT doc_id, {normal('text')} AS t FROM documents), y AS (SELECT doc_id, CASE WHEN length(t) <= 1000 THEN t ELSE {trim('left(t, 500)')} || {NL} || {NL} || '[中略]' || {NL} || {NL} || {trim('right(t, 500)')} END AS e FROM x) SELECT doc_id, {md('e', 'excerpt')} FROM y",
    "excerpt_source": f"WITH {COMPANIONS}, b AS (SELECT doc_id, -1 AS kind, 'preferred' AS e FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, kind, output FROM companions) SELECT doc_id, arg_min(e, kind) AS excerpt FROM b GROUP BY doc_id",
    "companion_files": f"WITH {COMPANIONS} SELECT doc_id, path, kind, output FROM companions",
    "unique_names": f"""WITH {FILES}, w AS (SELECT doc_id, path, '/in/' || source || '/2024-00-00_x_T' || (doc_id % 23) AS base, regexp_extract(path, '\\.[^.]*$') AS ext FROM files),
        r AS (SELECT *, row_number() OVER (PARTITION BY lower(base || ext) ORDER BY path) AS n FROM w),
        there AS (SELECT lower(base || ' (2)' || ext) AS f FROM w WHERE doc_id % 5 = 0 UNION SELECT lower(base || ' (3)_paged.md') FROM w WHERE doc_id % 7 = 0
          UNION SELECT lower(base || ' (5)' || ext || '.batch_state.txt') FROM w WHERE doc_id % 11 = 0 UNION SELECT lower(base || '_ERROR_merged.md') FROM w WHERE doc_id % 13 = 0),
        g AS (SELECT lower(base) AS b, lower(ext) AS x, count(*) AS m FROM w GROUP BY ALL), c AS (SELECT b, x, unnest(range(1, m + 6)) AS no FROM g), k AS (SELECT *, b || CASE WHEN no = 1 THEN '' ELSE ' (' || no || ')' END AS stem FROM c),
        free AS (SELECT b, x, no, row_number() OVER (PARTITION BY b, x ORDER BY no) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM there WHERE f IN (stem || x, stem || x || '.batch_state.txt', stem || '_paged.md', stem || '_error_paged.md', stem || '_merged.md', stem || '_error_merged.md')))
        SELECT path, base || CASE WHEN no = 1 THEN '' ELSE ' (' || no || ')' END || ext AS target FROM r JOIN free ON lower(base) = b AND lower(ext) = x AND r.n = free.n""",
    "unique_names_free": f"""WITH {FILES}, w AS (SELECT path, '/in/' || source || '/' || '2024-00-00_x_T' || (doc_id % 23) AS base, regexp_extract(path, '\\.[^.]*$') AS ext FROM files),
        r AS (SELECT *, row_number() OVER (PARTITION BY lower(base || ext) ORDER BY path) AS n FROM w) SELECT path, base || CASE WHEN n = 1 THEN '' ELSE ' (' || n || ')' END || ext AS target FROM r""",
    "rename_plan": f"""WITH {OUTPUTS}, pairs AS (SELECT doc_id, path, base, '/out/' || (doc_id % 50) AS t FROM files WHERE doc_id % 4 <> 0),
        x AS (SELECT path AS source, t || '.pdf' AS target FROM pairs UNION ALL
          SELECT base || s, t || s FROM pairs, (SELECT unnest(['_paged.md', '_ERROR_paged.md', '_merged.md', '_ERROR_merged.md']) AS s) WHERE base || s IN (SELECT path FROM outs))
        SELECT source, target, count(*) OVER (PARTITION BY target) > 1 OR (target LIKE '%.pdf' AND regexp_extract(target, '[0-9]+')::INTEGER % 5 = 0) OR (target LIKE '%_merged.md' AND target NOT LIKE '%ERROR%' AND regexp_extract(target, '[0-9]+')::INTEGER % 7 = 0) AS clash FROM x""",
    "classify_inputs": f"WITH {FILES}, e AS (SELECT doc_id, path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS x FROM files) SELECT doc_id, path, coalesce(list_extract(element_at(map {{{', '.join(f'{k!r}: {v!r}' for k, v in KINDS.items())}}}, x), 1), 'unsupported') AS kind, list_extract(element_at(map {{{', '.join(f'{k!r}: {v!r}' for k, v in MEDIA.items())}}}, x), 1) AS media_type FROM e",
    "pending_inputs": f"WITH {FILES} SELECT doc_id, path FROM files WHERE doc_id % 2 <> 0",
    "merged_path": f"WITH {OUTPUTS}, a AS (SELECT path FROM files UNION ALL SELECT path FROM outs) SELECT path, CASE WHEN path LIKE '%\\_paged.md' ESCAPE '\\' THEN path[:-10] || '_merged.md' ELSE regexp_replace(path, '(\\.[^./]*)$', '_merged\\1') END AS merged FROM a",
    "check_split_defs": f"""WITH {DEFS}, x AS (SELECT d, e, CASE WHEN d % 10 = 0 AND e = 1 THEN 'FIELD_MISSING' WHEN d % 10 = 1 AND e = 0 THEN 'NOT_A_NUMBER' WHEN d % 10 = 2 AND e = 0 THEN 'START_AFTER_END' END AS r FROM defs)
        SELECT d AS set_id, e AS entry_no, coalesce(r, CASE WHEN bool_or(r IS NOT NULL) OVER (PARTITION BY d) THEN 'SET_REFUSED' ELSE 'VALID' END) AS reason FROM x""",
    "request_lines": f"""WITH {BATCHES}, t AS (SELECT d, b, string_agg({NL} || '### -- Begin Page ' || (i + 1) || ' --' || {NL} || coalesce(nullif(raw, ''), '[未検出]') || {NL} || '### -- End --' || {NL}, '' ORDER BY i) AS t FROM inb GROUP BY d, b)
        SELECT 'request-' || b AS key, 'Say "yes".' || {NL} || 'Then stop.' AS instruction, md5(t) AS text_md5, false AS broken, count(*) AS n FROM t GROUP BY ALL""",
    "candidate_paths": f"WITH {FILES} SELECT doc_id, concat_ws(',', path, base || '_paged.md', base || '_ERROR_paged.md', base || '_merged.md', base || '_ERROR_merged.md') AS candidates FROM files",
    "order_pages": f"WITH {FAULTY} SELECT d AS doc_id, pos, p AS page_num, row_number() OVER (PARTITION BY d ORDER BY p, pos) AS place FROM pages",
    "infer_valid": f"""WITH {BATCHES}, t AS (SELECT d, b, string_agg({NL} || '### -- Begin Page ' || (i + 1) || ' --' || {NL} || coalesce(nullif(raw, ''), '[未検出]') || {NL} || CASE WHEN i = 0 AND (d + b) % 23 = 0 THEN '' ELSE '### -- End --' END || {NL}, '' ORDER BY i) AS t FROM inb GROUP BY d, b)
        SELECT d AS doc_id, b AS batch_no, CASE WHEN (d + b) % 23 = 0 THEN 'END_COUNT' END AS error, CASE WHEN (d + b) % 23 = 0 THEN 2 ELSE 1 END::BIGINT AS round, {md('t', 'text')} FROM t""",
    "infer": f"""WITH {BATCHES}, t AS (SELECT d, b, string_agg({NL} || '### -- Begin Page ' || (i + 1) || ' --' || {NL} || coalesce(nullif(raw, ''), '[未検出]') || {NL} || '### -- End --' || {NL}, '' ORDER BY i) AS t FROM inb GROUP BY d, b),
        r AS (SELECT d, b, (d + b) % 19 = 0 AS bad, CASE WHEN (d + b) % 19 <> 0 THEN array_to_string(list_reverse(regexp_extract_all(t, '(?s).')), '') END AS t FROM t)
        SELECT d AS doc_id, b AS batch_no, CASE WHEN bad THEN 'unavailable' END AS error, CASE WHEN bad THEN 2 ELSE 1 END::BIGINT AS round, {md('t', 'text')} FROM r""",
    "resumable_sets": f"""WITH {BATCHES}, t AS (SELECT d, b, string_agg({NL} || '### -- Begin Page ' || (i + 1) || ' --' || {NL} || coalesce(nullif(raw, ''), '[未検出]') || {NL} || '### -- End --' || {NL}, '' ORDER BY i) AS t FROM inb GROUP BY d, b),
        s AS (SELECT d, b, ps, t FROM t JOIN batches USING (d, b)),
        n AS (SELECT d, CASE WHEN d % 5 = 0 AND b = 1 THEN ps || '+' ELSE ps END AS ps, CASE WHEN d % 5 = 1 AND b = 1 THEN t || '!' ELSE t END AS t FROM s WHERE NOT (d % 5 = 2 AND b = 1)),
        ls AS (SELECT d, list_sort(list(ps || '#' || t)) AS l FROM s GROUP BY d), ln AS (SELECT d, list_sort(list(ps || '#' || t)) AS l FROM n GROUP BY d),
        x AS (SELECT ls.d, CASE WHEN ls.d % 7 = 0 THEN 'failed' ELSE 'running' END AS state, len(ls.l) = coalesce(len(ln.l), 0) AS c, ls.l = coalesce(ln.l, []) AS e FROM ls LEFT JOIN ln USING (d))
        SELECT d AS job_id, state, e AND state <> 'failed' AS resumable, c AS count_matches, e AS set_matches FROM x""",
    "split_far": f"""WITH {DEFS}, every AS (SELECT * FROM defs UNION ALL SELECT d, -1, 3, 2000000000 FROM counts WHERE d % 3 = 0),
        pg AS (SELECT d, unnest(range(1, n + 1)) AS p FROM counts),
        held AS (SELECT d, e, row_number() OVER (PARTITION BY d, e ORDER BY p) AS r FROM pg JOIN every USING (d) WHERE p BETWEEN lo AND hi),
        h AS (SELECT d, count(*) AS n, sum(r)::BIGINT AS numbers FROM held GROUP BY d),
        free AS (SELECT d, count(*) AS u FROM pg WHERE NOT EXISTS (SELECT 1 FROM every WHERE every.d = pg.d AND pg.p BETWEEN lo AND hi) GROUP BY d),
        w AS (SELECT d, unnest(range(lo, hi + 1)) AS p FROM defs), near AS (SELECT d, count(DISTINCT p) AS c, count(DISTINCT p) FILTER (p < 3) AS c2 FROM w GROUP BY d)
        SELECT d AS doc_id, CASE WHEN d % 3 = 0 THEN c2 + 1999999998 ELSE c END AS covered, coalesce(h.n, 0) AS n, coalesce(numbers, 0) AS numbers, coalesce(u, 0) AS uncovered
        FROM near LEFT JOIN h USING (d) LEFT JOIN free USING (d)""",
    "block_spans": f"""WITH {LINES} SELECT d AS doc_id, p AS page_num, '右' AS kind, 0::BIGINT AS open_line, 5::BIGINT AS close_line, 1::BIGINT AS depth FROM lines WHERE p % 5 = 0 UNION ALL SELECT d, p, '左', 2, 4, 2 FROM lines WHERE p % 5 = 0
        UNION ALL SELECT d, p, '左', 0, NULL, 1 FROM lines WHERE p % 5 = 1 UNION ALL SELECT d, p, '中', 1, 3, 1 FROM lines WHERE p % 5 = 2""",
    "heading_parents": f"""WITH {LINES}, h AS (SELECT d, p, ([1, 2, 3, 6])[p % 5 + 1] AS k, (['article', 'number', 'paren', 'letter'])[p % 5 + 1] AS level, CASE p % 5 WHEN 0 THEN '第' || p || ' 章' WHEN 1 THEN '1 one' WHEN 2 THEN '(' || p || ') x' ELSE 'a b' END AS t FROM lines WHERE p % 5 <> 4)
        SELECT d AS doc_id, p AS page_num, 0::BIGINT AS line_no, level, t AS heading, pp AS parent_page, CASE WHEN pp IS NOT NULL THEN 0::BIGINT END AS parent_line
        FROM (SELECT h.*, (SELECT max(g.p) FROM h g WHERE g.d = h.d AND g.p < h.p AND g.k < h.k) AS pp FROM h)""",
    "write_paged": f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'complete' WHEN doc_id % 3 = 0 THEN 'error' WHEN doc_id % 2 = 0 THEN 'complete' ELSE 'error' END AS status, CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END AS t FROM documents) SELECT doc_id, status, {md('t', 'content')} FROM x""",
    "office_parts": f"""WITH {LINES} SELECT '/in/' || d || '.pptx' AS path, 'ppt/slides/slide' || p || '.xml' AS part_name, 'slide' AS kind, p AS ordinal, 'text/xml' AS mime, md5(raw) AS data_md5 FROM lines WHERE d % 2 <> 0 AND d % 11 <> 0
        UNION ALL SELECT '/in/' || doc_id || '.docx', 'word/document.xml', 'main', 0, 'text/xml', md5(text) FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0 AND doc_id % 11 <> 0
        UNION ALL SELECT '/in/' || doc_id || '.docx', 'word/media/a.png', 'media', 0, 'image/png', md5(doc_id::VARCHAR) FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0 AND doc_id % 11 <> 0
        UNION ALL SELECT '/in/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.docx' ELSE '.pptx' END, NULL, 'broken', 0, NULL, NULL FROM documents WHERE text IS NOT NULL AND doc_id % 11 = 0""",
}
