"""SQL of the registered queries, for an engine that runs ANSI SQL with lists."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len({WORDS}) AS size, md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), '11')) AS draw FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY 1),
weighed AS (
  SELECT source, source_size,
    1.0::DOUBLE + (row_number() OVER (ORDER BY (source IS NULL)::INT, source) - 1) % 3 AS weight
  FROM sizes),
-- one row per turn of the filling: the level, then the number of sources above their cap
turns AS (
  SELECT 1 AS turn, (SELECT sum(source_size)::DOUBLE / sum(weight) FROM weighed) AS level, 0::BIGINT AS clamped
  UNION ALL
  SELECT turn + 1, x.level, x.n
  FROM turns, LATERAL (
    SELECT count(*) FILTER (source_size * 3.0::DOUBLE < weight * turns.level) AS n,
      ((SELECT sum(source_size) FROM weighed) * 1.0::DOUBLE
        - coalesce(sum(source_size * 3.0::DOUBLE) FILTER (source_size * 3.0::DOUBLE < weight * turns.level), 0))
        / sum(weight) FILTER (NOT source_size * 3.0::DOUBLE < weight * turns.level) AS level
    FROM weighed) x
  WHERE x.n > turns.clamped),
level AS (SELECT arg_max(level, turn) AS level FROM turns),
targets AS (
  SELECT source, source_size, least(source_size * 3.0::DOUBLE, weight * level) AS target FROM weighed, level),
parts AS (
  SELECT source, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
    target - (CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END) * source_size AS rest
  FROM targets),
placed AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.whole, p.rest,
    2 * sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.size ROWS UNBOUNDED PRECEDING) - d.size AS middle
  FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
taken AS (
  SELECT *, CASE WHEN size > 0 THEN whole + (middle <= 2 * rest)::INT ELSE 0 END AS copies FROM placed)
SELECT doc_id, source, size::BIGINT AS size, source_size, target, copies::INT AS copies, (size * copies)::BIGINT AS taken
FROM taken"""

_RULES = ("symbols", "dup_lines", "repeats", "capitals", "word_length")
_REACH = "CASE WHEN rule IN ('dup_lines', 'repeats') THEN 3 WHEN rule = 'symbols' THEN 8 WHEN rule = 'capitals' THEN 10 ELSE 6 END"
_FLOOR = "CASE rule WHEN 'symbols' THEN 1000 WHEN 'dup_lines' THEN 3000 WHEN 'repeats' THEN 1500 END"


def _fence(by: str) -> str:
    return f"""SELECT {by}, rule,
      CASE WHEN total >= 20 AND rule = 'word_length' THEN q1 - {_REACH} * greatest(q3 - q1, q3 // 20) END AS low,
      CASE WHEN total >= 20 THEN q3 + {_REACH} * greatest(q3 - q1, q3 // 20) END AS high
    FROM (
      SELECT {by}, rule, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3, max(total) AS total
      FROM (
        SELECT {by}, rule, bucket, sum(n) OVER (PARTITION BY {by}, rule ORDER BY bucket) AS upto,
          sum(n) OVER (PARTITION BY {by}, rule) AS total
        FROM (
          SELECT {by}, rule, bucket, count(*) FILTER (NOT (rule IN ('dup_lines', 'repeats') AND bucket = 0)) AS n FROM buckets GROUP BY ALL))
      GROUP BY {by}, rule)"""


OP8 = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
starts AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS c FROM (
      SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS run
      FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w)))
  WHERE c > 1),
repeats AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM starts) GROUP BY 1),
m AS (
  SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS upper,
    length(regexp_replace(text, '[\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D]', '', 'g')) AS marks
  FROM w LEFT JOIN repeats r ON r.doc_id = w.doc_id),
v AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    marks * 10000 // n_words AS symbols, n_dup_lines * 10000 // n_lines AS dup_lines,
    n_repeat_words * 10000 // n_words AS repeats, upper * 10000 // word_chars AS capitals,
    word_chars * 10000 // n_words AS word_length
  FROM m),
values_ AS (
  {' UNION ALL '.join(f"SELECT lang, source, '{r}' AS rule, {r} AS value FROM v WHERE NOT base_failed" for r in _RULES)}),
buckets AS (
  SELECT lang, source, rule, (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) AS bucket FROM values_),
own AS ({_fence('lang, source')}),
whole AS ({_fence('lang')}),
lim AS (
  SELECT own.lang, own.source, own.rule, least(own.low, whole.low) AS low, greatest(own.high, whole.high, {_FLOOR.replace("rule", "own.rule")}) AS high
  FROM own JOIN whole ON own.rule = whole.rule AND own.lang IS NOT DISTINCT FROM whole.lang),
judged AS (
  SELECT v.*, {', '.join(f"coalesce((SELECT coalesce(v.{r} > l.high, false) OR coalesce(v.{r} < l.low, false) FROM lim l WHERE l.rule = '{r}' AND l.lang IS NOT DISTINCT FROM v.lang AND l.source IS NOT DISTINCT FROM v.source), false) AS f_{r}" for r in _RULES)}
  FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(f'f_{r}' for r in _RULES)}) AS kept,
  concat_ws(',', {', '.join(f"CASE WHEN f_{r} THEN '{r}' END" for r in _RULES)}) AS failed_rules
FROM judged"""

OP5 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (
  SELECT *, regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g') AS erole, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS etext FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(erole) + length(etext) + 12 + 10 + 10)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHARE = "1 + (1000000000::HUGEINT * ({} + 2)) // ({} + 2 * terms)"

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOW} AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS terms, sum(total) AS in_lang FROM k GROUP BY lang),
kept AS (SELECT c.* FROM c JOIN k USING (lang, term)),
g AS (
  SELECT s.lang, s.source, coalesce(x.n, 0) AS in_group, terms, in_lang
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN v USING (lang)
    LEFT JOIN (SELECT lang, source, sum(n) AS n FROM kept GROUP BY ALL) x USING (lang, source)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_SHARE.format('coalesce(c.n, 0)', 'in_group')} AS p,
    {_SHARE.format('k.total', 'in_lang')} AS q
  FROM g JOIN k USING (lang) LEFT JOIN kept c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


OP11 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS grams FROM w),
c AS (SELECT min(doc_id) AS id, len(grams) AS n, any_value(grams) AS grams FROM s WHERE len(grams) > 0 GROUP BY md5(grams::VARCHAR), len(grams)),
g AS MATERIALIZED (SELECT id, n, md5_number(unnest(grams)) AS gram FROM c),
joint AS (
  SELECT a.id AS x, b.id AS y, a.n AS nx, b.n AS ny, count(*) AS n
  FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM joint WHERE 100 * n >= 85 * (nx + ny - n)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
comp AS (SELECT x AS id, least(min(y), x) AS component_id FROM reach GROUP BY x),
ids AS (
  SELECT s.doc_id, len(s.grams) AS n_shingles, coalesce(comp.component_id, c.id, s.doc_id) AS component_id
  FROM s LEFT JOIN c ON md5(s.grams::VARCHAR) = md5(c.grams::VARCHAR) AND len(s.grams) > 0 LEFT JOIN comp ON comp.id = c.id)
SELECT doc_id, n_shingles::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM ids"""
