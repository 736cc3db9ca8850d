"""What some of the queries return, in DuckDB's SQL."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"


def quality_rules(coverage: dict[int, float], line_coverage: float) -> str:
    """op7: the counts, and the verdict by the coverage of every window length and of repeated lines."""
    lengths = ", ".join(f"({n}, {limit!r}::DOUBLE)" for n, limit in coverage.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
c AS (SELECT r, doc_id, t, w, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols FROM d),
k(n, most) AS (VALUES {lengths}),
win AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM c, k)),
twice AS (SELECT r, n, i FROM (SELECT r, n, i, count(*) OVER (PARTITION BY r, n, g) AS times FROM win) WHERE times > 1),
marked AS (SELECT DISTINCT r, n, i + o AS p FROM (SELECT r, n, i, unnest(range(0, n)) AS o FROM twice)),
cover AS (SELECT r, n, count(*) AS words, sum(length(w[p])) AS chars FROM marked JOIN c USING (r) GROUP BY r, n),
lines AS (SELECT r, line, count(*) AS times, length(regexp_replace(line, '[ 	-
]', '', 'g')) AS chars FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM c) WHERE regexp_matches(line, '{_WORD}') GROUP BY r, line),
again AS (SELECT r, sum(times - 1) AS n_lines, sum((times - 1) * chars) AS chars FROM lines GROUP BY r),
worst AS (SELECT r, max(cover.chars::DOUBLE / greatest(word_chars, 1) / most) AS x FROM cover JOIN k USING (n) JOIN c USING (r) GROUP BY r),
f AS (SELECT c.*, CAST(coalesce(again.n_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(five.words, 0) AS BIGINT) AS n_repeat_words, greatest(coalesce(worst.x, 0), coalesce(again.chars, 0)::DOUBLE / greatest(word_chars, 1) / {line_coverage!r}::DOUBLE) AS x
      FROM c LEFT JOIN again USING (r) LEFT JOIN worst USING (r) LEFT JOIN (SELECT r, words FROM cover WHERE n = 5) five USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND x <= 1 AS kept FROM f
"""


def jaccard_join(n: int, percent: int) -> str:
    """op4: all pairs that share a shingle, and their components, for tables without repeated ids."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')) END) AS g FROM d),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.id, u.b FROM reach JOIN u ON reach.c = u.a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least_of.component_id FROM d LEFT JOIN z USING (doc_id) JOIN (SELECT id AS doc_id, min(c) AS component_id FROM reach GROUP BY id) least_of USING (doc_id)
"""
