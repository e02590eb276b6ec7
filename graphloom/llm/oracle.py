"""DuckDB SQL for those queries of this subpackage that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {}

ORACLE["op1_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
f AS (
  SELECT rid, doc_id, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g FROM (SELECT rid, w, unnest(range(1, n_words - 3)) AS i FROM f)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
g AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_capitals, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM f LEFT JOIN cov USING (rid)),
h AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_capitals > 5 * word_chars OR word_chars < 2 * n_words
    OR word_chars > 25 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM h
"""

ORACLE["op4_mixing"] = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, (2 * source_size)::DOUBLE AS lim, sum(weight) OVER () AS w_all, sum(source_size) OVER ()::DOUBLE AS size_all,
    coalesce(sum(weight) OVER before, 0)::DOUBLE AS w_before, coalesce(sum(source_size) OVER before, 0)::DOUBLE * 2 AS lim_before
  FROM s WINDOW before AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((size_all * 1.5::DOUBLE - lim_before) / (w_all - w_before), lim / weight) FILTER (lim >= (size_all * 1.5::DOUBLE - lim_before) / (w_all - w_before) * weight) AS level FROM r),
t AS (SELECT source, source_size, least(lim, level * weight) AS target FROM r, l),
p AS (
  SELECT doc_id, size, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - start)))::BIGINT AS taken
FROM p
"""

ORACLE["op10_url_filter"] = r"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM p),
r(verdict, rule) AS (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('block', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')),
rules AS (SELECT verdict, rule, split_part(rule, '/', 1) AS rh, substr(rule, instr(rule, '/')) AS rp FROM r),
best AS (
  SELECT rid, rule, verdict FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC, verdict DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (rid)
"""

ORACLE["op11_ego_join"] = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
v AS MATERIALIZED (
  SELECT * FROM d WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.rid AS a, b.rid AS b FROM v a JOIN v b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98::DOUBLE),
r(a, b) AS (SELECT rid, rid FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS rid, min(d.vec_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY a),
n AS (SELECT a AS rid, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""

ORACLE["op12_collocations"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (
  SELECT lang, phrase, m, count(*) AS f
  FROM (SELECT lang, m, w[i : i + m - 1] AS phrase FROM o, (VALUES (1), (2), (3)) AS ms(m) WHERE i + m - 1 <= len(w))
  GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE m > 1 AND f >= 10),
k AS (SELECT *, unnest(range(1, m)) AS cut FROM c),
s AS (
  SELECT k.lang, k.phrase, k.m, k.f AS a, l.f AS l, r.f AS r, cut, (1000000::HUGEINT * k.f * k.f) // (l.f::HUGEINT * r.f) AS score
  FROM k JOIN g AS l ON l.lang = k.lang AND l.phrase = k.phrase[1 : cut] JOIN g AS r ON r.lang = k.lang AND r.phrase = k.phrase[cut + 1 : ]
  QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, cut) = 1),
inner2 AS (SELECT lang, phrase[i : i + 1] AS phrase, max(f) AS longer FROM (SELECT lang, phrase, f, unnest([1, 2]) AS i FROM c WHERE m = 3) GROUP BY ALL),
kept AS (
  SELECT s.* FROM s LEFT JOIN inner2 AS x ON x.lang = s.lang AND x.phrase = s.phrase WHERE x.longer IS NULL OR 100 * x.longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, array_to_string(phrase, ' ') AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

# CRC-32 of a word's UTF-8 bytes: the table by eight conditional shifts, then one step a byte.
ORACLE["op13_importance"] = r"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS crc FROM range(256) AS r(i)),
words AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 't', NULL, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
o AS (SELECT side, rid, unnest(w) AS word FROM words),
u AS (SELECT side, word, count(*) AS n FROM o GROUP BY ALL),
h AS (
  SELECT word, xor(list_reduce(list_transform(range(length(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
      lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM u), t),
s AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM u JOIN h USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000))::DOUBLE / ((s + 1) * (all_t + 10000))::DOUBLE))::BIGINT AS gain
  FROM s, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM s)),
w AS (SELECT rid, sum(gain)::BIGINT AS weight FROM o JOIN h USING (word) JOIN g USING (bucket) WHERE side = 'd' GROUP BY rid),
v AS (
  SELECT rid, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN w USING (rid) WHERE side = 'd'),
r AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features DESC, weight DESC) AS rank, count(*) OVER () AS n FROM v WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM v LEFT JOIN r USING (rid)
"""
