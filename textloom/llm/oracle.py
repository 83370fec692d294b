"""DuckDB SQL of those operators that SQL can express."""

from textloom.llm.quality_rules import RULES, STOP_WORDS


def _rule(name, measure, weight, op, bound, per, offset):
    return f"CASE WHEN {weight} * {measure} {op} {bound}{f' * ({per} - {offset})' if per else ''} THEN '{name}' END"


_STOP = ", ".join(f"'{x}', '{x.capitalize()}'" for x in STOP_WORDS)
QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, w[i:i+4] AS g FROM w, unnest(range(1, greatest(len(w) - 3, 1))) AS u(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(5)) AS v(k) GROUP BY r),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines, len(list_filter(w, lambda x: x IN ({_STOP})))::BIGINT AS n_stop_words
    FROM w LEFT JOIN covered c USING (r)),
v AS (SELECT *, concat_ws(',', {", ".join(_rule(*x) for x in RULES)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, failed_rules = '' AS kept, failed_rules FROM v
"""

_WORDS = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS g FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(k) WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM g),
s AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM d, n, unnest(range(1, len(w) - n + 2)) AS u(k)),
hit AS (SELECT DISTINCT r, s.n, k, item FROM s JOIN g ON s.g = g.g AND s.n = g.n),
words AS (SELECT r, count(DISTINCT k + j)::BIGINT AS n_hit FROM (SELECT DISTINCT r, n, k FROM hit), unnest(range(n)) AS v(j) GROUP BY r),
items AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
