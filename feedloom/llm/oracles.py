"""SQL counterparts of the operators that SQL can express."""

from __future__ import annotations

WARC_SQL = """
WITH d AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS x FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS first_id FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(x, 1 + 10 * (k // 8), 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31 AS INT) + 1, 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS verified
FROM m
"""

# The mix by sorting whole sources, where the operator finds the same cut through buckets of ranks.
MIXING_SQL = """
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS bound FROM sources),
levels AS (SELECT *, bound / weight AS full_at, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(bound) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
opened AS (SELECT *, min(CASE WHEN full_at >= level THEN full_at END) OVER () AS open_at, arg_min(level, full_at) FILTER (WHERE full_at >= level) OVER () AS open_level FROM levels),
targets AS (SELECT source, source_size, CASE WHEN full_at >= open_at THEN least(bound, weight * open_level) ELSE bound END AS target FROM opened),
rated AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  (CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
odds AS (SELECT *, floor(rate) AS whole, (u / (1 - u)) / ((rate - floor(rate)) / (1 - (rate - floor(rate)))) AS rank_odds FROM rated),
ranked AS (SELECT *, CASE WHEN rate > whole THEN sum(size) OVER (PARTITION BY source ORDER BY rank_odds, doc_id) <= target - whole * source_size ELSE false END AS fits FROM odds),
gaps AS (SELECT *, target - whole * source_size - sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM ranked),
filled AS (SELECT *, CASE WHEN rate > whole AND NOT fits AND size < 2 * gap THEN row_number() OVER (PARTITION BY source
  ORDER BY CASE WHEN rate > whole AND NOT fits AND size < 2 * gap THEN 0 ELSE 1 END, abs(size - gap), rank_odds, doc_id) END AS fill FROM gaps)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN fits OR coalesce(fill, 0) = 1 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM filled
"""

# Pieces by slicing lists of units, where the operator permutes descriptors.
FILL_IN_MIDDLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
units AS (SELECT *, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u,
  [CAST('0x' || substr(x, 1 + 8 * k, 8) AS BIGINT) FOR k IN range(4)] AS h FROM d),
drawn AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
    WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

# Trusted are all labelled documents; the operator takes at most 16,000 of them, more than sf0.01 and sf0.1 have.
QUALITY_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS trusted FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM d),
spans AS (SELECT r, i, w, CASE WHEN lead(i, 4) OVER o IS NOT NULL THEN w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o END AS g
  FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, w, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 THEN 1 ELSE 0 END AS again FROM spans),
covered AS (SELECT r, w, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM twice),
words AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, sum(c) AS n_repeat_words FROM covered GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
tokens AS (SELECT r, trusted, [CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) FOR x IN
  regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+|[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]+')] AS h FROM d),
grams AS (SELECT r, trusted, unnest(list_concat([x % 16384 FOR x IN h], [(h[k] * 31 + h[k + 1] + 7) % 16384 FOR k IN range(1, len(h))])) AS b FROM tokens),
counted AS (SELECT b, count(*) AS raw, count(*) FILTER (WHERE trusted) AS trusted FROM grams GROUP BY b),
buckets AS (SELECT k AS b, coalesce(raw, 0) AS raw, coalesce(trusted, 0) AS trusted FROM range(16384) x(k) LEFT JOIN counted ON b = k),
sums AS (SELECT b, raw, trusted, CAST(sum(raw) OVER () AS DOUBLE) AS all_raw, CAST(sum(trusted) OVER () AS DOUBLE) AS all_trusted FROM buckets),
spread AS (SELECT r, b, trusted AS mine, count(*) AS times, sum(count(*)) OVER (PARTITION BY r) AS n FROM grams GROUP BY r, b, trusted),
weights AS (SELECT r, times, CASE WHEN all_trusted > 0 THEN CAST(round(1000 * (
    ln((trusted - CASE WHEN mine THEN times ELSE 0 END + 1) / (all_trusted - CASE WHEN mine THEN n ELSE 0 END + 16384))
    - ln((raw + 1) / (all_raw + 16384)))) AS BIGINT) ELSE 0 END AS weight FROM spread JOIN sums USING (b)),
totals AS (SELECT r, sum(times) AS n_grams, sum(times * weight) AS total FROM weights GROUP BY r),
scored AS (SELECT doc_id, trusted, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_grams, 0) AS BIGINT) AS n_grams, CAST(coalesce(total, 0) AS BIGINT) AS total,
  CASE WHEN n_grams > 0 THEN CAST(total AS BIGINT) / (n_grams * 1000.0::DOUBLE) ELSE 0.0::DOUBLE END AS score,
  CASE WHEN n_grams > 0 THEN floor(CAST(total AS DOUBLE) / n_grams) ELSE 0 END AS thousandths
  FROM d LEFT JOIN words USING (r) LEFT JOIN lines USING (r) LEFT JOIN totals USING (r)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM scored),
least AS (SELECT list_sort(list(thousandths) FILTER (WHERE trusted))[CAST(count(*) FILTER (WHERE trusted) // 500 + 1 AS BIGINT)] AS threshold FROM scored)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_grams, total, score, base_failed,
  NOT base_failed AND thousandths >= coalesce(threshold, -1e9) AS kept FROM failed, least
"""
