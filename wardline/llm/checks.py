"""Check SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from wardline.llm.chat_format import BUDGET, HEADER, HISTORY, LEAST_STRIDE
from wardline.llm.queries import BLOCKED_NAMES, SHARDS, TRICKY, URL_RULES
from wardline.llm.sharding import TABLE_SIZE, lookup_table

CHECKS: dict[str, str] = {}

_KEY = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)"
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

# The widths of windows are those of the formatted texts: 4 + role + 2 + text + 8,
# with escapes counted in.
CHECKS["op1_chat_format"] = rf"""
WITH talk AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{TRICKY}'), (-7, 1, 'assistant', '{TRICKY}')
), sized AS (
  SELECT *, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) + {HEADER} AS size,
    14 + length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), ': ', ':\ '))
       + length(replace(replace(replace(body, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth
  FROM talk
), led AS (
  SELECT *, nth = 1 AND role = 'system' AS leads,
    coalesce(max(CASE WHEN nth = 1 AND role = 'system' THEN size END) OVER (PARTITION BY conv_id), 0) AS system_size,
    coalesce(max(CASE WHEN nth = 1 AND role = 'system' THEN chars END) OVER (PARTITION BY conv_id), 0) AS system_chars
  FROM sized
), placed AS (
  SELECT *, greatest(({BUDGET} - {HISTORY} - system_size) // 2, {LEAST_STRIDE}) AS stride,
    coalesce(sum(CASE WHEN leads THEN 0 ELSE size END)
      OVER (PARTITION BY conv_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM led
), windowed AS (
  SELECT *, (before // stride) * 2 + CASE WHEN size > stride AND NOT leads THEN 1 ELSE 0 END AS win FROM placed
), starts AS (
  SELECT conv_id, win, min(nth) AS first, min(before) AS start, sum(chars) AS chars, max(system_chars) AS system_chars
  FROM windowed GROUP BY ALL
), widths AS (
  SELECT s.conv_id, s.chars + CASE WHEN s.first > 1 THEN s.system_chars ELSE 0 END
    + coalesce((SELECT sum(t.chars) FROM windowed t WHERE t.conv_id = s.conv_id AND NOT t.leads AND t.nth < s.first
        AND s.start - t.before <= {HISTORY}), 0) AS chars
  FROM starts s
), whole AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY nth)) AS turns_sha256,
    coalesce(string_agg(body, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '') AS trained
  FROM windowed GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, CAST(length(trained) AS BIGINT) AS loss_chars, sha256(trained) AS loss_sha256,
  CAST((SELECT sum(chars) FROM widths w WHERE w.conv_id = whole.conv_id) AS BIGINT) AS formatted_chars
FROM whole"""

CHECKS["op3_mix_sources"] = rf"""
WITH sized AS (
  SELECT doc_id, source, {_KEY} AS key, CAST({_WORDS} AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, source_size * 3 AS cap, CASE turn % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM totals
), ranked AS (
  SELECT *, row_number() OVER w AS place,
    sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
    sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)
), opened AS (
  SELECT place, words_left, weight_left FROM ranked WHERE cap * weight_left >= weight * words_left ORDER BY place LIMIT 1
), goals AS (
  SELECT r.source, r.source_size, CASE WHEN r.place < o.place THEN CAST(r.cap AS DOUBLE)
    ELSE CAST(r.weight * o.words_left AS DOUBLE) / CAST(o.weight_left AS DOUBLE) END AS target
  FROM ranked r, opened o
), summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized
)
SELECT s.doc_id, s.size, g.source_size, g.target,
  CAST(s.size * (CAST(floor(g.target) AS BIGINT) // greatest(g.source_size, 1))
    + least(greatest(CAST(floor(g.target) AS BIGINT) % greatest(g.source_size, 1) - s.before, 0), s.size) AS BIGINT) AS taken
FROM summed s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source"""

CHECKS["op4_passage_dedup"] = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, words, start, md5(array_to_string(words[start : start + 49], ' ')) AS content
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS start FROM split WHERE len(words) >= 50)
), firsts AS (
  SELECT content, min(doc_id) AS first_id FROM windows GROUP BY content
), gone AS (
  SELECT DISTINCT w.doc_id, unnest(range(w.start, w.start + 50)) AS place
  FROM windows w JOIN firsts f ON w.content = f.content AND f.first_id < w.doc_id
), holes AS (
  SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id
), kept AS (
  SELECT s.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
    CASE WHEN places IS NULL THEN array_to_string(words, ' ') END AS whole
  FROM split s LEFT JOIN holes h ON s.doc_id = h.doc_id
), standing AS (
  SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.place) AS rest
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split
        WHERE doc_id IN (SELECT doc_id FROM holes)) t
  LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.place = t.place
  WHERE g.place IS NULL GROUP BY t.doc_id
)
SELECT k.doc_id, CAST(k.n_words AS BIGINT) AS n_words, CAST(k.n_removed AS BIGINT) AS n_removed,
  sha256(coalesce(k.whole, s.rest, '')) AS kept_sha256
FROM kept k LEFT JOIN standing s ON k.doc_id = s.doc_id"""

_OWNERS = ", ".join(map(str, lookup_table(SHARDS)))
CHECKS["op6_shard_lookup"] = f"""
SELECT doc_id, {_KEY} % {TABLE_SIZE} AS slot,
  'shard-' || lpad(CAST(list_extract([{_OWNERS}], CAST({_KEY} % {TABLE_SIZE} + 1 AS INTEGER)) AS VARCHAR), 3, '0') AS shard
FROM documents"""

CHECKS["op9_exact_dedup"] = r"""
WITH hashed AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM hashed
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked"""

_HOST = r"translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
CHECKS["op11_url_cascade"] = rf"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {_RULES}
), parsed AS (
  SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), fits AS (
  SELECT p.page_id, r.rule_host || r.rule_path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC, r.verdict DESC) AS nth
  FROM parsed p JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
), named AS (
  SELECT *, nullif(regexp_extract(host, '(?:^|\.)((?:{"|".join(BLOCKED_NAMES)})\..*)$', 1), '') AS listed FROM parsed
)
SELECT n.page_id, n.host, n.path, f.rule, n.listed,
  coalesce(f.verdict, CASE WHEN n.listed IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM named n LEFT JOIN fits f ON n.page_id = f.page_id AND f.nth = 1"""

CHECKS["op12_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs) GROUP BY ALL HAVING count(*) >= 30
), counted AS (
  SELECT d.lang, d.source, d.term, count(*) AS n
  FROM (SELECT lang, source, unnest(terms) AS term FROM docs) d JOIN kept k ON d.lang = k.lang AND d.term = k.term GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), langs AS (
  SELECT g.lang, (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS v FROM (SELECT DISTINCT lang FROM groups) g
), sizes AS (
  SELECT g.lang, g.source, l.v, CAST(coalesce((SELECT sum(n) FROM counted c WHERE c.lang = g.lang AND c.source = g.source), 0) AS HUGEINT) AS total
  FROM groups g JOIN langs l ON g.lang = l.lang
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.total + 5 * s.v) AS p
  FROM sizes s JOIN kept k ON s.lang = k.lang LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), q AS (
  SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (coalesce((SELECT sum(n) FROM counted c WHERE c.lang = k.lang AND c.term = k.term), 0) + 5))
    // ((SELECT sum(total) FROM sizes s WHERE s.lang = k.lang) + 5 * (SELECT v FROM langs l WHERE l.lang = k.lang)) AS q
  FROM kept k
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM rows
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank FROM ranked
WHERE part = 'pair' OR place <= 50"""

CHECKS["op13_hard_negatives"] = r"""
WITH clean AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS parts
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_dot_product(a.parts, b.parts) AS BIGINT) AS score
  FROM clean a JOIN clean b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
  n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) <= 10"""
