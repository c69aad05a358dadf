"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from leafquire.llm.bpe import op7_bpe
from leafquire.llm.chat import op1_chat
from leafquire.llm.embeddings import op4_embeddings
from leafquire.llm.html import op5_html
from leafquire.llm.language import op12_language
from leafquire.llm.minhash import op2_minhash
from leafquire.llm.mixing import op10_mixing
from leafquire.llm.phrases import op11_phrases
from leafquire.llm.quality import op8_quality
from leafquire.llm.runs import op13_runs
from leafquire.llm.sharding import op9_sharding
from leafquire.llm.toxicity import op3_toxicity
from leafquire.llm.warc import op6_warc

QUERIES = {
    f.__name__: f
    for f in (op1_chat, op2_minhash, op3_toxicity, op4_embeddings, op5_html, op6_warc, op7_bpe, op8_quality, op9_sharding, op10_mixing, op11_phrases, op12_language, op13_runs)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The 16 steps of the reflected CRC-32 polynomial for four bits at a time.
_CRC = "[" + ", ".join(str(x) for x in (
    0, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
    0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C,
)) + "]::BIGINT[]"

ORACLES = {
    "op1_chat": r"""
WITH RECURSIVE t AS (SELECT *, coalesce(text, '') AS body FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (
  SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id, 'call-' || conv_id || '-' || (turn - 2) AS parent_id,
    ['search', 'lookup', 'note'][length(body) % 3 + 1] AS name, min(body) AS body
  FROM t WHERE role = 'user' GROUP BY ALL),
c1 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY name, body) = 1),
r AS (SELECT conv_id, 'call-' || conv_id || '-' || (turn - 1) AS call_id, turn AS result_turn, min(text) AS content FROM t WHERE role = 'assistant' GROUP BY ALL),
d(call_id, depth) AS (
  SELECT call_id, 0::BIGINT FROM c1 WHERE parent_id NOT IN (SELECT call_id FROM c1)
  UNION ALL SELECT c1.call_id, d.depth + 1 FROM c1 JOIN d ON c1.parent_id = d.call_id),
o AS (SELECT c1.*, d.depth, row_number() OVER (PARTITION BY conv_id ORDER BY turn, d.depth, call_id) - 1 AS position FROM c1 JOIN d USING (call_id)),
e AS (SELECT *, CASE
    WHEN name = 'search' AND length(body) > 400 THEN '$.query: too long'
    WHEN name = 'lookup' AND length(body) < 40 THEN '$.query: too short'
    WHEN name = 'note' AND turn > 4 THEN '$.turn: out of range' ELSE '' END AS errors FROM o)
SELECT coalesce(e.conv_id, r.conv_id) AS conv_id, coalesce(e.call_id, r.call_id) AS call_id, coalesce(e.turn, r.result_turn) AS turn,
  e.name, e.depth, e.position, r.call_id IS NOT NULL AS has_result, CASE WHEN e.call_id IS NOT NULL THEN errors = '' END AS valid, errors,
  '{"arguments":' || coalesce('{"query":' || to_json(body)::VARCHAR || ',"turn":' || e.turn || '}', 'null') || ',"call_id":"' || coalesce(e.call_id, r.call_id)
    || '","conversation":' || coalesce(e.conv_id, r.conv_id) || ',"name":' || coalesce('"' || e.name || '"', 'null') || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS message
FROM e FULL JOIN r ON e.conv_id = r.conv_id AND e.call_id = r.call_id""",
    "op8_quality": rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS k
  FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c >= 2),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(generate_series(i, i + 7)) AS j FROM rep) GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
    length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals, len(ls) AS n_lines,
    coalesce(list_sum(list_transform(ws, lambda x, i: CASE WHEN i > 1 AND ws[i - 1] = x THEN 1 ELSE 0 END)), 0) AS n_same
  FROM w LEFT JOIN cov USING (r)),
b AS (
  SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END + CASE WHEN 100 * n_capitals > 60 * word_chars THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_same > 30 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN word_chars > 30 * n_words THEN 64 ELSE 0 END AS failure_bits
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, failure_bits & 3 <> 0 AS base_failed, failure_bits = 0 AS kept,
  failure_bits::BIGINT AS failure_bits
FROM b""",
    "op9_sharding": rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(
    list_transform(generate_series(1, length(h)), lambda i: strpos('0123456789ABCDEF', h[i + 2 * (i % 2) - 1]) - 1)::BIGINT[],
    lambda a, x: xor(({_CRC})[(xor(a, x) & 15) + 1], a >> 4), 4294967295::BIGINT)) AS crc FROM t),
s(key, k, b, j) AS (
  SELECT DISTINCT doc_id, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END, -1::BIGINT, 0::BIGINT
  FROM documents
  UNION ALL
  SELECT key, n, j, floor((j + 1) * (2147483648::DOUBLE / ((n - n % 8589934592) // 8589934592 + 1)::DOUBLE))::BIGINT
  FROM (SELECT key, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS n FROM s WHERE j < 40)),
p AS (
  SELECT c.*, s.b AS shard, CASE WHEN s.j = 40 THEN 40 ELSE s.b END AS grown,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS part
  FROM c JOIN s ON c.doc_id IS NOT DISTINCT FROM s.key AND s.j >= 40)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, size, crc) - 1)::BIGINT AS slot, grown::INTEGER AS grown_shard
FROM p""",
    "op10_mixing": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0)) || chr(1) || md5(coalesce(text, '')) || chr(1) || 'leafquire-mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / (1.0 - 0.9 * least(1.0, 4.0 * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>!_=~^\{{}}[]@', ''))) / greatest(length(coalesce(text, '')), 1))) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
r(round, source, n, w, capped) AS (
  SELECT 0, source, n, w, false FROM s
  UNION ALL
  SELECT round + 1, source, n, w, capped OR w * level > 2.0 * n FROM (
    SELECT *, (1.5 * sum(n) OVER () - coalesce(sum(2.0 * n) FILTER (capped) OVER (), 0)) / sum(w) FILTER (NOT capped) OVER () AS level FROM r)
  WHERE round < (SELECT count(*) FROM s)),
f AS (SELECT *, (1.5 * sum(n) OVER () - coalesce(sum(2.0 * n) FILTER (capped) OVER (), 0)) / sum(w) FILTER (NOT capped) OVER () AS level
  FROM r WHERE round = (SELECT max(round) FROM r)),
t AS (SELECT source, n, CASE WHEN capped THEN 2.0 * n ELSE least(2.0 * n, w * level) END AS target FROM f),
e AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS epochs FROM t),
q AS (
  SELECT d.*, e.n, e.target, e.epochs, round(e.target - e.epochs * e.n)::BIGINT AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, n AS source_size, target, (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken
FROM q""",
    "op11_phrases": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
g AS (
  SELECT lang, m, phrase, count(*) AS f
  FROM (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
    FROM w, (SELECT unnest([1, 2, 3]) AS m))
  GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE m > 1 AND f >= 10),
k AS (SELECT lang, phrase, ws, f, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.f AS a, k.k, l.f AS l, r.f AS r, (1000000::HUGEINT * k.f * k.f) // (l.f::HUGEINT * r.f) AS score
  FROM k JOIN g l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:k.k], ' ')
  JOIN g r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (
  SELECT lang, phrase, max(f) AS f
  FROM (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, f FROM c WHERE m = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n.n, score::BIGINT AS score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase
WHERE x.f IS NULL OR 100 * x.f < 50 * a
QUALIFY rank <= 2000""",
}
