"""The quality rules in DuckDB SQL."""

from __future__ import annotations

from . import quality_rules as q


def rules_sql() -> str:
    """Rows of the rules' query, from documents with unique ids."""
    common = ", ".join(f"('{w}', {k})" for k, w in enumerate(q.COMMON))
    n = len(q.COMMON)
    patterns = [p.replace("'", "''") for p in q._CLASSES]
    cuts = ",\n    ".join(f"length(rest) - length(regexp_replace(rest, '{p}', '', 'g')) AS c{k + 1}" for k, p in enumerate(patterns))
    classes = "\n    ".join(f"UNION ALL SELECT doc_id, {k}, c{k} FROM counted" for k in range(1, len(patterns) + 1))
    last = len(patterns) + 1
    return rf"""
WITH bodies AS (SELECT doc_id, lang, coalesce(text, '') AS body FROM documents),
cut AS (SELECT doc_id, lang, body, regexp_replace(body, '{q._SPACE}', '', 'g') AS bare, list_filter(string_split_regex(body, '{q._SPACE}'), lambda x: x <> '') AS w,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM bodies),
rested AS (SELECT *, regexp_replace(bare, '\p{{Ll}}+', '', 'g') AS rest FROM cut),
counted AS (SELECT doc_id, lang, w, len(w) AS n_words, length(bare) AS word_chars, len(l) - len(list_distinct(l)) AS n_dup_lines, length(bare) - length(rest) AS c0,
    {cuts} FROM rested),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM counted)),
again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) r(k) GROUP BY doc_id),
based AS (SELECT c.*, coalesce(v.n, 0) AS n_repeat_words, n_words < {q.LEAST_WORDS} OR 100 * coalesce(v.n, 0) > {q.MOST_REPEATED_PERCENT} * n_words AS base_failed
    FROM counted c LEFT JOIN covered v ON v.doc_id = c.doc_id),
common(word, k) AS (VALUES {common}),
found AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, lower(unnest(w)) AS word FROM counted) JOIN common USING (word) GROUP BY doc_id, k),
class_hist AS (SELECT doc_id, 0 AS k, c0 AS n FROM counted
    {classes}
    UNION ALL SELECT doc_id, {last}, word_chars - {" - ".join(f"c{k}" for k in range(last))} FROM counted),
common_hist AS (SELECT doc_id, k, n FROM found
    UNION ALL SELECT c.doc_id, {n}, n_words - coalesce((SELECT sum(n) FROM found f WHERE f.doc_id = c.doc_id), 0) FROM counted c),
langs AS (SELECT lang FROM based WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= {q.REFERENCE_WORDS}),
class_sums AS (SELECT lang, k, sum(n) AS n FROM class_hist JOIN based USING (doc_id) WHERE NOT base_failed GROUP BY lang, k),
class_refs AS (SELECT lang, k, n / sum(n) OVER (PARTITION BY lang) AS q FROM class_sums JOIN langs USING (lang)
    UNION ALL SELECT NULL, k, sum(n) / sum(sum(n)) OVER () FROM class_sums GROUP BY k),
common_refs AS (SELECT lang, k, n / sum(n) OVER (PARTITION BY lang) AS q FROM (SELECT lang, k, sum(n) AS n FROM common_hist JOIN based USING (doc_id) WHERE NOT base_failed GROUP BY lang, k) JOIN langs USING (lang)),
class_pairs AS (SELECT b.doc_id, coalesce(h.n, 0) / b.word_chars AS p, r.q FROM based b LEFT JOIN langs g ON g.lang = b.lang
    JOIN class_refs r ON r.lang IS NOT DISTINCT FROM g.lang LEFT JOIN class_hist h ON h.doc_id = b.doc_id AND h.k = r.k WHERE b.word_chars > 0),
common_pairs AS (SELECT b.doc_id, coalesce(h.n, 0) / b.n_words AS p, coalesce(r.q, 0) AS q FROM based b JOIN langs g ON g.lang = b.lang, range({n + 1}) ks(k)
    LEFT JOIN common_refs r ON r.lang = g.lang AND r.k = ks.k LEFT JOIN common_hist h ON h.doc_id = b.doc_id AND h.k = ks.k WHERE b.n_words > 0),
class_js AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d FROM class_pairs GROUP BY doc_id),
common_js AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d FROM common_pairs GROUP BY doc_id)
SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(c4 AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND NOT (n_words >= {q.CLASS_WORDS} AND coalesce(x.d, 0) > {q.MOST_CLASS_DISTANCE})
        AND NOT (n_words >= {q.COMMON_WORDS_NEEDED} AND coalesce(y.d, 0) > {q.MOST_COMMON_DISTANCE} + {q.COMMON_NOISE} / sqrt(n_words)) AS kept
FROM based b LEFT JOIN class_js x ON x.doc_id = b.doc_id LEFT JOIN common_js y ON y.doc_id = b.doc_id
"""
