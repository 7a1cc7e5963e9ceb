"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from .quality_rules import BASE_RULES, METHOD_RULES, SEEN_AS, Rule

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in SEEN_AS)
_S = "[\\x20\\x09-\\x0D]"


def _fails(rules: tuple[Rule, ...]) -> str:
    tests = []
    for r in rules:
        whole = f"{r.whole}::DOUBLE" if r.whole else "1.0"
        tests += [f"{r.part}::DOUBLE < {whole} * {float(r.least)}"] if r.least is not None else []
        tests += [f"{r.part}::DOUBLE > {whole} * {float(r.most)}"] if r.most is not None else []
    return "(" + " OR ".join(tests) + ")"


_QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, list_filter(regexp_split_to_array(t, '{_S}+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
words AS (SELECT k, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
grams AS (SELECT k, i, word || ' ' || lead(word, 1) OVER v || ' ' || lead(word, 2) OVER v AS g FROM words WINDOW v AS (PARTITION BY k ORDER BY i)),
twice AS (SELECT k, g FROM grams WHERE g IS NOT NULL GROUP BY k, g HAVING count(*) > 1),
covered AS (SELECT k, count(DISTINCT i + j) AS n FROM grams JOIN twice USING (k, g), (VALUES (0), (1), (2)) o(j) GROUP BY k),
m AS (SELECT w.k, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
  (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaim,
  (length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')))::BIGINT AS n_upper,
  len(list_filter(ws, lambda x: x IN ({_STOP})))::BIGINT AS n_stop,
  len(ls)::BIGINT AS n_lines,
  len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…){_S}*$')))::BIGINT AS n_ellipsis_lines,
  len(list_filter(ls, lambda x: regexp_matches(x, '^{_S}*[-*•]')))::BIGINT AS n_bullet_lines
  FROM w LEFT JOIN covered ON covered.k = w.k),
j AS (SELECT *, {_fails(BASE_RULES)} AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_exclaim, n_upper, n_stop, n_lines,
  n_ellipsis_lines, n_bullet_lines, base_failed, NOT base_failed AND NOT {_fails(METHOD_RULES)} AS kept FROM j
"""

SQL = {"op9_quality_rules": _QUALITY}
