"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from parlance.llm import line_rules

_BLANK = r"[ \t\n\x0B\f\r]"

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), placed AS (
  SELECT *, row_number() OVER w AS place, lag(role) OVER w AS before,
    regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS inside,
    replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|nl|>') AS head
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(11 + sum(length(inside) + CASE WHEN before IS NULL THEN 13 + length(head) WHEN before <> role THEN 24 + length(head) ELSE 10 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""


def _fails(line: str) -> str:
    solid = rf"regexp_replace({line}, '{_BLANK}+', '', 'g')"
    marks = rf"length(regexp_replace({solid}, '[\p{{L}}\p{{N}}\p{{M}}]+', '', 'g'))"
    whole = line_rules.WHOLE.replace("'", "''")
    phrase = f"(length({line}) <= {line_rules.SHORT} AND (contains({line}, '{line_rules.SIGN}') OR regexp_matches(lower({line}), '{whole}')))"
    bars = f"len(regexp_extract_all({line}, '{line_rules.BARS}'))"
    return f"({marks} > {line_rules.MAX_MARKS}::DOUBLE * length({solid}) OR {bars} >= {line_rules.MIN_BARS} OR {phrase})"


def judged(source: str = "documents") -> str:
    """The rows of ``source`` with the counts, the cleaned text and the verdict."""
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS row, *, coalesce(text, '') AS whole,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda w: w <> '') AS words,
    string_split(coalesce(text, ''), chr(10)) AS lines
  FROM {source}
), windows AS (
  SELECT row, unnest(range(1, len(words) - 1)) AS i, words FROM base WHERE len(words) >= 3
), counted AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, words[i], words[i + 1], words[i + 2]) AS n FROM windows
), repeated AS (
  SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM counted WHERE n > 1) GROUP BY row
), measured AS (
  SELECT base.*, len(words) AS n_words,
    length(regexp_replace(whole, '{_BLANK}+', '', 'g')) AS word_chars,
    length(whole) - length(translate(whole, '{line_rules.SYMBOLS}', '')) AS n_symbols,
    len(list_filter(lines, lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]'))) - len(list_distinct(list_filter(lines, lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')))) AS n_dup_lines,
    coalesce(repeated.n, 0) AS n_repeat_words,
    array_to_string(list_filter(lines, lambda l: NOT {_fails("l")}), chr(10)) AS clean_text
  FROM base LEFT JOIN repeated USING (row)
), failed AS (
  SELECT *, n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN 1 - length(regexp_replace(clean_text, '{_BLANK}+', '', 'g'))::DOUBLE / word_chars ELSE 0 END AS lost
  FROM measured
), judged AS (SELECT *, NOT base_failed AND lost <= {line_rules.MAX_LOST} AS kept FROM failed)
"""


LINE_RULES = judged() + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _alnum(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}')"


def contaminated(source: str = "documents") -> str:
    """row, its columns, n_words, n_hit and the sorted item ids of each row of ``source``."""
    return f"""
WITH items AS (
  SELECT item_id, {_alnum("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), base AS (
  SELECT row_number() OVER () AS row, *, {_alnum("text")} AS w FROM {source}
), doc_windows AS (
  SELECT row, size, i, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM base, (SELECT DISTINCT size FROM item_windows) WHERE len(w) >= size)
), hits AS (
  SELECT row, i, size, item_id FROM doc_windows JOIN item_windows USING (size, words)
), marked AS (
  SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS p FROM hits) GROUP BY row
), named AS (
  SELECT row, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY row
), found AS (
  SELECT base.*, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(items, []) AS items
  FROM base LEFT JOIN marked USING (row) LEFT JOIN named USING (row)
)
"""


DECONTAMINATE = contaminated() + """
SELECT doc_id, n_words, n_hit, len(items) AS n_items, sha256(array_to_string(items, ',')) AS items_sha256, n_hit > 0 AS contaminated FROM found
"""
