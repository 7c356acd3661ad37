"""DuckDB twins of the registered queries that SQL can express, written from the definitions."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op4_adaptive_quality"] = r"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc_id, lang, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM words)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id
), counts AS (
  SELECT w.doc_id, lang, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id
), measures AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN least(1000 * n_symbols // word_chars, 1000) ELSE 0 END AS symbols,
         CASE WHEN n_lines > 0 THEN least(1000 * n_dup_lines // n_lines, 1000) ELSE 0 END AS dup_lines,
         CASE WHEN n_words > 0 THEN least(1000 * n_repeat_words // n_words, 1000) ELSE 0 END AS repeats,
         CASE WHEN n_words > 0 THEN least(10 * word_chars // n_words, 1000) ELSE 0 END AS word_length
  FROM counts
), sketch AS (
  SELECT lang, source, measure, bin, count(*) AS n FROM (
    SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS measure, unnest([symbols, dup_lines, repeats, word_length]) AS bin
    FROM measures WHERE NOT base_failed
  ) GROUP BY ALL
), langs AS (
  SELECT lang, measure, bin, sum(n) AS n FROM sketch GROUP BY ALL
), sizes AS (
  SELECT lang, measure, sum(n) AS rows FROM langs GROUP BY ALL
), blended AS (
  SELECT lang, source, measure, bin, sum(w)::HUGEINT AS w FROM (
    SELECT s.lang, source, s.measure, bin, n::HUGEINT * rows AS w FROM sketch s JOIN sizes z ON s.lang IS NOT DISTINCT FROM z.lang AND s.measure = z.measure
    UNION ALL
    SELECT g.lang, g.source, l.measure, l.bin, 10::HUGEINT * l.n FROM (SELECT DISTINCT lang, source FROM sketch) g JOIN langs l ON g.lang IS NOT DISTINCT FROM l.lang
  ) GROUP BY ALL
), reached AS (
  SELECT *, 100 * sum(w) OVER (PARTITION BY lang, source, measure ORDER BY bin) AS seen, sum(w) OVER (PARTITION BY lang, source, measure) AS total FROM blended
), q AS (
  SELECT lang, source, measure, min(bin) FILTER (seen >= 25 * total) AS q25, min(bin) FILTER (seen >= 50 * total) AS q50,
         min(bin) FILTER (seen >= 75 * total) AS q75, min(bin) FILTER (seen >= 99 * total) AS q99
  FROM reached GROUP BY ALL
), bounds AS (
  SELECT lang, source, max(q75 + 5 * (q75 - q25) + 10) FILTER (measure = 'symbols') AS sy, max(q99 + q99 - q50 + 10) FILTER (measure = 'dup_lines') AS du,
         max(q99 + q99 - q50 + 10) FILTER (measure = 'repeats') AS re, max(q75 + 5 * (q75 - q25) + 10) FILTER (measure = 'word_length') AS hi,
         max(q25 - 5 * (q75 - q25) - 10) FILTER (measure = 'word_length') AS lo
  FROM q GROUP BY ALL
)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND symbols <= sy AND dup_lines <= du AND repeats <= re AND word_length BETWEEN lo AND hi AS kept
FROM measures m LEFT JOIN bounds b ON m.lang IS NOT DISTINCT FROM b.lang AND m.source IS NOT DISTINCT FROM b.source
"""

ORACLES["op8_chat_formatting"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)
), sized AS (
  SELECT *, length(role) + length(text) + list_sum(list_transform(
           [chr(9243), '<|', '<s>', '</s>', '[INST]', '[/INST]'],
           lambda c: (length(role || chr(0) || text) - length(replace(role || chr(0) || text, c, ''))) // length(c))) AS escaped
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(escaped + length('<|im_start|>') + 1 + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

ORACLES["op11_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), seen AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM seen GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), counts AS (
  SELECT s.lang, s.source, s.term, count(*) AS n FROM seen s JOIN kept k ON s.lang = k.lang AND s.term = k.term GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * l.v))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (k.n + 2)) // (l.n + 2 * l.v))::BIGINT AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 10
"""
