"""SQL that checks the quality query (DuckDB)."""

QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM w) WHERE n > 1),
r AS (SELECT doc_id, sum(least(8, i - coalesce(before, i - 8))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM t) GROUP BY doc_id),
m AS (SELECT d.doc_id, d.text, ws, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST((SELECT len(l) - list_unique(l) FROM (SELECT list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
        OR (n_dup_lines >= 3 AND 2 * n_dup_lines > len(string_split(text, chr(10))))
        OR 10 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 4 * word_chars OR 10 * length(regexp_replace(text, '[^!?]+', '', 'g')) > 4 * n_words
        OR 10 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) < 7 * n_words
        OR 100 * list_unique(ws) < least(25, 2500 / greatest(n_words, 1)) * n_words) AS kept
FROM b
"""
