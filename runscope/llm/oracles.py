"""DuckDB SQL for the queries that SQL can express, with its own patterns and values."""

from __future__ import annotations

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

_EIGHT = "|".join(c * 8 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789/_=-") + r"|\+{8}"


def _matches(kind: str, no: int, pattern: str, condition: str) -> str:
    """Matches with their places: running totals over the text between them and over themselves."""
    return f"""
    SELECT r, '{kind}' AS kind, {no} AS no, m, place AS start, place + length(m) AS stop FROM (
        SELECT r, m, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) - length(m) AS place FROM (
            SELECT r, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM (
                SELECT r, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d)))
    WHERE {condition}"""


OP4 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
base AS ({_matches('assign', 0, _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 1)) >= 8")}
    UNION ALL {_matches('access', 1, 'AKIA[A-Z0-9]+', 'length(m) >= 16')}
    UNION ALL {_matches('hex', 2, '[0-9a-f]+', 'length(m) >= 32')}),
candidate AS (SELECT *, row_number() OVER () AS c FROM ({_matches('entropy', 3, '[A-Za-z0-9+/_=-]{20,}', 'true')})
    WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')
    AND NOT regexp_matches(m, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$')
    AND NOT regexp_matches(m, '(?i)example|placeholder|changeme|dummy|sample|xxxx')
    AND NOT regexp_matches(m, '(?i)0123456789|abcdefghij|qwertyuiop')
    AND NOT regexp_matches(m, '^[A-Za-z]+([-_/=][A-Za-z]+)*[-_/=]?[0-9]{{0,4}}$')
    AND NOT regexp_matches(m, '{_EIGHT}')),
part AS (SELECT c, m, w, substr(m, w, 20) AS s
    FROM (SELECT c, m, unnest(range(1, length(m) - 18)) AS w FROM candidate)),
bits AS (SELECT c, w, sum(-n / 20.0 * log2(n / 20.0)) AS h FROM (
    SELECT c, w, x, count(*) AS n FROM (SELECT c, w, unnest(string_split(s, '')) AS x FROM part) GROUP BY ALL) GROUP BY c, w),
random AS (SELECT r, kind, no, m, start, stop FROM candidate JOIN (SELECT c, max(h) AS h FROM bits GROUP BY c) USING (c)
    WHERE h >= CASE WHEN regexp_matches(m, '^([0-9a-f]+|[0-9A-F]+)$') THEN 3.0
        WHEN regexp_matches(m, '^([^A-Z]+|[^a-z]+)$') THEN 3.55 ELSE 3.9 END
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = candidate.r AND b.start < candidate.stop AND candidate.start < b.stop)),
spans AS (SELECT *, true AS is_base FROM base UNION ALL SELECT *, false FROM random),
joined AS (SELECT r,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no, stop) FILTER (is_base) AS b,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no, stop) AS a
    FROM (SELECT r, kind, no, is_base, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM spans) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN joined USING (r)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
windows AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS five
    FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM windows) WHERE n >= 2),
repeated AS (SELECT r, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM again) GROUP BY r),
line AS (SELECT r, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS ws
    FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)),
counted AS (SELECT r, l, len(ws) AS n, length(array_to_string(ws, '')) AS chars,
    length(regexp_replace(l, '[^\pL\pN]', '', 'g')) AS letters,
    list_sum(list_transform(regexp_extract_all(regexp_replace(l, '[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]', '*', 'g'),
        '[\pL\pN][\p{Mn}\p{Mc}]+'), lambda m: length(m) - 1)) AS marks,
    len(list_filter(ws, lambda x: x IN ('|', '||', '>', '>>', '<', '<<', '»', '«', '›', '‹', '•', '·', '::', '/', '→', '←'))) AS separators
    FROM line WHERE len(ws) > 0),
judged AS (SELECT r, l, chars, letters = 0
    OR (chars >= 20 AND chars - letters - coalesce(marks, 0) > CAST(0.3 AS DOUBLE) * chars)
    OR (separators >= 3 AND separators >= CAST(0.15 AS DOUBLE) * n)
    OR (n <= 40 AND regexp_matches(lower(l), 'all rights reserved|cookie policy|accept cookies|we use cookies|privacy policy|'
        || 'terms of service|terms of use|terms and conditions|enable javascript|javascript is disabled|click here|'
        || 'sign up for our|subscribe to our newsletter|skip to content|back to top|page not found|lorem ipsum')) AS fails
    FROM counted),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines,
    count(*) FILTER (fails) AS n_removed_lines, coalesce(sum(chars) FILTER (fails), 0) AS lost FROM judged GROUP BY r),
whole AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(lost, 0) AS lost
    FROM d JOIN w USING (r) LEFT JOIN repeated USING (r) LEFT JOIN lines USING (r)),
shares AS (SELECT *, CASE WHEN word_chars = 0 THEN 0 ELSE CAST(lost AS DOUBLE) / word_chars END AS lost_share,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM whole)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, n_lines, n_removed_lines,
    CAST(lost_share AS DOUBLE) AS lost_share, base_failed, NOT base_failed AND lost_share <= 0.3 AS kept
FROM shares
"""

OP11 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat_ws(':', doc_id, text)) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w FROM d GROUP BY source),
shares AS (SELECT sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER low, 0) AS words, sum(w) OVER high AS parts FROM s
    WINDOW low AS (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        high AS (ORDER BY source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
best AS (SELECT CAST(words AS BIGINT) AS words, CAST(parts AS BIGINT) AS parts FROM shares
    ORDER BY CAST(words AS DOUBLE) / CAST(parts AS DOUBLE) DESC LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN 3 * source_size * parts < w * words THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(w * words AS DOUBLE) / CAST(parts AS DOUBLE) END AS target,
    CAST('0x' || substr(md5(concat_ws(':', '11', source)), 1, 6) AS BIGINT) AS u FROM s, best),
placed AS (SELECT doc_id, size, source_size, target, u,
    CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target * 16777216.0::DOUBLE / source_size) AS BIGINT) END AS e,
    row_number() OVER (PARTITION BY d.source ORDER BY 8 * length(bin(size)) + ((size >> greatest(length(bin(size)) - 4, 0)) & 7),
        digest) AS i
    FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copied AS (SELECT *, (i * e + u) // 16777216 - ((i - 1) * e + u) // 16777216 AS copies FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies AS BIGINT) AS copies,
    CAST(copies * size AS BIGINT) AS taken FROM copied
"""

OP13 = """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
    CAST(list_inner_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT a, positive_id, b AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY a, positive_id ORDER BY score DESC, b) AS rank
    FROM p JOIN (SELECT a, b, score FROM s WHERE NOT same) USING (a)
    WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT a AS anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
