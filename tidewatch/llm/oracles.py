"""SQL that must give the queries' rows, where SQL can say it."""

from __future__ import annotations

from tidewatch.llm.chat import CONTROLS, END, TEXT, TURN
from tidewatch.llm.quality import MAX_COVERED, MAX_REPEAT, MIN_REPEAT


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\-{c[1:]}')"
    return out


_CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, '{TURN}' || {_escaped("role")} || '{TEXT}' || {_escaped("text")} || '{END}' AS segment FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(segment)) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

_TOP_K = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

def _gram(n: int) -> str:
    """The words from one on, joined; null where fewer than n are left."""
    return " || ' ' || ".join(f"lead(x, {k}) OVER o" for k in range(n))


_QUALITY = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM texts
), grams AS (
  SELECT doc_id, i, n, count(*) OVER (PARTITION BY doc_id, n, g) > 1 AS again FROM (
    SELECT doc_id, i, 5 AS n, {_gram(5)} AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
    UNION ALL SELECT doc_id, i, {MIN_REPEAT}, {_gram(MIN_REPEAT)} FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
  ) WHERE g IS NOT NULL
), hit AS (
  SELECT doc_id, n, unnest(range(i, i + n)) AS i FROM grams WHERE again
), counted AS (
  SELECT doc_id, count(DISTINCT CASE WHEN n = 5 THEN i END) AS n_repeat, count(DISTINCT CASE WHEN n = {MIN_REPEAT} THEN i END) AS n_covered FROM hit GROUP BY doc_id
), long AS (
  SELECT DISTINCT doc_id FROM (
    SELECT doc_id, list_slice(w, i, i + {MAX_REPEAT}) AS g FROM grams JOIN texts USING (doc_id) WHERE again AND n = {MIN_REPEAT} AND i + {MAX_REPEAT} <= len(w)
  ) GROUP BY doc_id, g HAVING count(*) > 1
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
    coalesce(n_covered, 0) AS n_covered, long.doc_id IS NOT NULL AS too_long
  FROM texts LEFT JOIN counted USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN long USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_covered <= CAST({MAX_COVERED} AS DOUBLE) * n_words AND NOT too_long AS kept
FROM base
"""

ORACLE_SQL = {"op1_chat_formatting": _CHAT, "op2_exact_top_k": _TOP_K, "op4_quality_rules": _QUALITY}
