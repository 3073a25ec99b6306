"""SQL with the same rows, for the operators that SQL can state."""

from __future__ import annotations

from stayline.llm.licenses import PHRASES, TEMPLATES, WINDOW, template_table

#: Words of the word-run operators: A-Z in lower case, then runs of letters, digits and everything above ASCII.
_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
items AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS words
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
),
places AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS words
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
hits AS (SELECT r, item_id, i, p.n FROM places p JOIN windows v ON p.n = v.n AND p.words = v.words),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""



def _places() -> str:
    """Starts of every phrase, as a list of (label, start) structs."""
    parts = []
    for phrase, label in PHRASES:
        words = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words, start=1))
        parts.append(f"[{{'label': '{label}', 'at': i}} for i in range(0, len(w) - {len(words)} + 1) if {same}]")
    return " || ".join(parts)


def _templates() -> str:
    rows = [f"('{t['label']}', {t['words']!r}, {t['need']}, {t['length']})" for t in template_table(TEMPLATES)]
    return "VALUES " + ", ".join(rows)


OP3 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS.format("text")} AS w FROM documents),
base AS (SELECT r, doc_id, text, len(w)::BIGINT AS n_words, {_places()} AS places FROM docs),
lines AS (SELECT r, str_split(text, chr(10)) AS l FROM docs),
blocks AS (
  SELECT r, unnest(l) AS block FROM lines
  UNION ALL SELECT r, unnest([concat_ws(' ', l[i], l[i + 1]) for i in range(1, len(l) + 1)]) FROM lines
),
sets AS (SELECT DISTINCT r, len(b) AS n, list_distinct(b) AS s FROM (SELECT r, {_WORDS.format("block")} AS b FROM blocks)),
templates(label, words, need, length) AS ({_templates()}),
held AS (SELECT * FROM docs, templates WHERE len(list_intersect(list_distinct(w), words)) >= need),
windows AS (
  SELECT DISTINCT r, label, words, need, unnest([list_distinct(w[i + 1 : i + {WINDOW} * length]) for i in range(0, len(w), length)]) AS s
  FROM held
),
compared AS (
  SELECT r, label, words, need, s FROM sets, templates WHERE len(s) >= need AND n <= {WINDOW} * length
  UNION ALL SELECT r, label, words, need, s FROM windows
),
found AS (
  SELECT r, label, len(list_intersect(s, words)) / len(words) AS containment FROM compared WHERE len(list_intersect(s, words)) >= need
),
labels AS (SELECT r, list(DISTINCT label) AS found, max(containment) AS containment FROM found GROUP BY r)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base,
       list_min([p.at for p in places])::BIGINT AS first_word, list_max([p.at for p in places])::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(list_distinct([p.label for p in places])), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct([p.label for p in places] || coalesce(found, []))), ','), '') AS labels,
       greatest(coalesce(containment, 0.0), CASE WHEN len(places) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM base LEFT JOIN labels USING (r)
"""

ORACLE = {"op2_winnowing": OP2, "op3_licenses": OP3}
