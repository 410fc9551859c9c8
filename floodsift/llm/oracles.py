"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from floodsift.llm import mix, resampling

_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

PARETO_MIX = f"""
WITH split AS (
  SELECT doc_id, coalesce('s' || source, 'z') AS src,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    ('0x' || substr(md5('{mix.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, {mix.KEY_BITS // 4}))::BIGINT AS u
  FROM documents),
docs AS (
  SELECT doc_id, src, len(w)::BIGINT AS size, u,
    CASE WHEN len(w) = 0 THEN 0
      ELSE least({mix.CLASSES - 1}, {mix.CLASSES} * len(list_distinct(w)) // len(w)) END AS class
  FROM split),
sources AS (
  SELECT src, sum(size)::BIGINT AS s, [5, 2, 1][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS w
  FROM docs GROUP BY src),
lines AS (
  SELECT *, row_number() OVER (ORDER BY s / w, src) AS rank,
    (sum(s) OVER () - {mix.CAP} * coalesce(sum(s) OVER (ORDER BY s / w, src {_BEFORE}), 0))::BIGINT::DOUBLE
      / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY s / w, src {_BEFORE}), 0))::BIGINT AS line
  FROM sources),
targets AS (
  SELECT src, s AS source_size, least({mix.CAP}.0::DOUBLE * s, coalesce(
    (SELECT arg_min(line, rank) FILTER (WHERE {mix.CAP} * s > line * w) FROM lines) * w,
    {mix.CAP}.0::DOUBLE * s)) AS target
  FROM lines),
classes AS (
  SELECT src, class, sum(size)::BIGINT AS words, {mix.CLASSES} + class AS gain FROM docs GROUP BY src, class),
rates AS (
  SELECT c.*, source_size, target,
    (target - ({mix.CAP} * coalesce(sum(words) OVER (PARTITION BY src ORDER BY class DESC {_BEFORE}), 0))::BIGINT)
      / nullif((sum(words * gain) OVER (PARTITION BY src)
        - coalesce(sum(words * gain) OVER (PARTITION BY src ORDER BY class DESC {_BEFORE}), 0))::BIGINT, 0) AS rate
  FROM classes c JOIN targets USING (src)),
copies AS (
  SELECT *, least({mix.CAP}.0::DOUBLE, coalesce(
    (arg_max(rate, class) FILTER (WHERE rate * gain <= {mix.CAP}) OVER (PARTITION BY src)) * gain,
    {mix.CAP}.0::DOUBLE)) AS copies
  FROM rates),
plan AS (
  SELECT src, class, words, source_size, target, floor(copies)::BIGINT AS whole, copies - floor(copies) AS p FROM copies),
missing AS (
  SELECT src, first(target) - sum(words * whole)::BIGINT AS missing FROM plan GROUP BY src),
odds AS (
  SELECT d.*, whole, source_size, target, p,
    ((u::DOUBLE + 0.5::DOUBLE) / {1 << mix.KEY_BITS}::DOUBLE) AS x
  FROM docs d JOIN plan USING (src, class)),
keyed AS (
  SELECT *, CASE WHEN p > 0 THEN floor(ratio / (1.0::DOUBLE + ratio) * {1 << mix.KEY_BITS}::DOUBLE)::BIGINT END AS key
  FROM (SELECT *, CASE WHEN p > 0 THEN (x / (1.0::DOUBLE - x)) / (p / (1.0::DOUBLE - p)) END AS ratio FROM odds)),
sums AS (
  SELECT src, key, sum(size)::BIGINT AS words FROM keyed WHERE key IS NOT NULL AND size > 0 GROUP BY src, key),
ends AS (
  SELECT src, max(key) AS last FROM (
    SELECT src, key, words, sum(words) OVER (PARTITION BY src ORDER BY key)::BIGINT AS upto FROM sums)
  JOIN missing USING (src) WHERE upto * 2 - words <= missing * 2 GROUP BY src)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN key <= last THEN 1 ELSE 0 END))::BIGINT AS taken
FROM keyed LEFT JOIN ends USING (src)"""

_ORDERS = """
filters AS (SELECT chr((64 + k)::INTEGER) AS f, (1 << (k - 1)::INTEGER)::BIGINT AS bit FROM range(1, 6) t(k)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM filters a JOIN filters b ON b.f <> a.f JOIN filters c ON c.f NOT IN (a.f, b.f)
  JOIN filters d ON d.f NOT IN (a.f, b.f, c.f) JOIN filters e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (
  SELECT filter_order, step::INTEGER AS step, bit,
    coalesce((SELECT sum(x.bit) FROM filters x WHERE strpos(filter_order, x.f) < step), 0)::BIGINT AS before
  FROM orders, range(1, 6) t(step), filters WHERE f = substr(filter_order, step, 1))"""

GRAY_CODE_AUDIT = f"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
marks AS (
  SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT doc_id, part,
    (len(w) < 50)::BIGINT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::BIGINT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::BIGINT
    + 8 * regexp_matches(t, '[#$%&*|]')::BIGINT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::BIGINT AS mask
  FROM texts),
cells AS (
  SELECT part, mask, count(*) AS docs, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
{_ORDERS},
found AS (
  SELECT part, filter_order, step, bit,
    sum(docs) FILTER (WHERE mask & (before | bit) = 0) AS kept,
    sum(docs) FILTER (WHERE mask & before = 0 AND mask & bit <> 0) AS removed,
    sum(docs) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0) AS redundant,
    sum(docs) FILTER (WHERE mask = bit) AS unique_fails,
    sum(good) FILTER (WHERE mask & before = 0 AND mask & bit <> 0) AS good_lost,
    sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit <> 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM found"""


def _checksum_steps() -> list[int]:
    """What four bits do to a reflected CRC-32, polynomial 0xEDB88320."""
    out = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


# DuckDB has no crc32: here it goes over the hex digits of a word, the low half of each byte first.
_CRC32 = f"""xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, length(hex(w))),
      lambda k: strpos('0123456789ABCDEF', substr(hex(w), (k + 2 - 2 * (k % 2))::BIGINT, 1)) - 1)),
    lambda c, d: xor(c >> 4, ({_checksum_steps()}::BIGINT[])[(xor(c, d) & 15) + 1])))"""

_K = resampling.BUCKETS
RADIX_RESAMPLING = f"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
targets AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
rows AS (SELECT row_number() OVER () AS r, doc_id, w AS ws, len(w)::BIGINT AS n_features FROM texts),
features AS (SELECT r, unnest(ws) AS w FROM rows),
counted AS (SELECT r, w, count(*) AS n FROM features GROUP BY r, w),
vocabulary AS (
  SELECT w, {_CRC32} % {_K} AS bucket FROM (SELECT w FROM counted UNION SELECT w FROM targets)),
source AS (SELECT bucket, sum(n) AS s FROM counted JOIN vocabulary USING (w) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM targets JOIN vocabulary USING (w) GROUP BY bucket),
sizes AS (
  SELECT coalesce((SELECT sum(s) FROM source), 0)::DOUBLE AS s_all,
    coalesce((SELECT sum(t) FROM target), 0)::DOUBLE AS t_all),
gains AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln(((coalesce(t, 0)::DOUBLE + 1.0::DOUBLE) * (s_all + {_K}.0::DOUBLE))
    / ((s::DOUBLE + 1.0::DOUBLE) * (t_all + {_K}.0::DOUBLE))))::BIGINT AS gain
  FROM source LEFT JOIN target USING (bucket), sizes),
weights AS (
  SELECT r, sum(n * gain)::BIGINT AS weight
  FROM counted JOIN vocabulary USING (w) JOIN gains USING (bucket) GROUP BY r),
noisy AS (
  SELECT r, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9),
      lambda k: strpos('0123456789abcdef', substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), k, 1)) - 1)),
    lambda a, d: a * 16 + d) AS h FROM rows),
scored AS (
  SELECT r, doc_id, n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + floor(
    -1000.0::DOUBLE * ln(-ln((h::DOUBLE + 0.5::DOUBLE) / {1 << 32}::DOUBLE)))::BIGINT)::BIGINT AS score
  FROM rows JOIN noisy USING (r) LEFT JOIN weights USING (r)),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= {resampling.LEAST_WORDS})
SELECT doc_id, n_features, weight, score,
  CASE WHEN rank <= n * {resampling.PERCENT} // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)"""

ORACLES: dict[str, str] = {
    "op1_pareto_mix": PARETO_MIX,
    "op11_gray_code_audit": GRAY_CODE_AUDIT,
    "op12_radix_resampling": RADIX_RESAMPLING,
}
