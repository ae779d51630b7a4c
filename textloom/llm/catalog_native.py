"""Queries of the operators that are plain DataFrame plans, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.runtime import table
from textloom.llm import mixing, quality_rules, sharding


def op4_mix_sources(spark, sf_dir):
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return plan.select("doc_id", "size", "source_size", "target", taken)


def op6_feistel_shards(spark, sf_dir):
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_host_quality(spark, sf_dir):
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


QUERIES = {
    "op4_mix_sources": op4_mix_sources,
    "op6_feistel_shards": op6_feistel_shards,
    "op8_host_quality": op8_host_quality,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_RULES = quality_rules.RULES
_PRIOR = ", ".join(
    f"sum(bad_{k}) / sum(docs) AS m_{k}, greatest(avg((bad_{k} / docs) * (bad_{k} / docs)) - avg(bad_{k} / docs) * avg(bad_{k} / docs), 1e-9) AS v_{k}"
    for k in _RULES
)
_OK = " AND ".join(
    f"(bad_{k} + m_{k} * w_{k}) / (docs + w_{k}) <= 0.5" for k in _RULES
)
_WEIGHTS = ", ".join(
    f"least(greatest(m_{k} * (1 - m_{k}) / v_{k} - 1, 1.0), 1e6) AS w_{k}" for k in _RULES
)

ORACLES = {
    "op4_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight,
  3 * source_size AS cap FROM per),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
  / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM w WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (SELECT arg_min(level, cap::DOUBLE / weight) FROM l WHERE level * weight <= cap) AS final FROM l),
t AS (SELECT source, source_size, least(CASE WHEN level * weight > cap THEN cap::DOUBLE ELSE final * weight END, cap::DOUBLE) AS target FROM f),
c AS (SELECT *, floor(log2(size + 1.0::DOUBLE) * 16)::BIGINT * 256
  + ((coalesce(doc_id, 0) & 2147483647) * 2654435761 % 4294967296) // 16777216 AS chunk FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY chunk, size, doc_id NULLS FIRST) - 1 AS r FROM c),
j AS (SELECT n.*, source_size, target, coalesce(target / nullif(source_size, 0), 0) AS step,
  ('0x' || substr(md5('mix-1:' || coalesce('=' || n.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE least(floor((r + 1) * step + u)::BIGINT - floor(r * step + u)::BIGINT, 3) * size END)::BIGINT AS taken
FROM j""",
    "op6_feistel_shards": f"""
WITH RECURSIVE crc(i, k, v) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM crc WHERE k < 8),
lut AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
hexes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, (length(h) // 2 + 16)::BIGINT AS size,
  [('0x' || substr(h, 2 * x - 1, 2))::BIGINT for x in range(1, length(h) // 2 + 1)] AS b FROM hexes),
summed AS (SELECT doc_id, size, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM bytes, lut),
g AS (SELECT n, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b FROM (SELECT count(*)::BIGINT AS n FROM documents)),
net(r0, x, y, j) AS (
  SELECT r, (r // b), (r % b), 0
  FROM (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS r FROM documents), g
  UNION ALL
  SELECT r0,
    CASE WHEN j % {sharding.ROUNDS} % 2 = 0 THEN (x + ('0x' || substr(md5('shuffle-1:' || (j % {sharding.ROUNDS}) || ':' || y), 1, 8))::BIGINT) % a ELSE x END,
    CASE WHEN j % {sharding.ROUNDS} % 2 = 1 THEN (y + ('0x' || substr(md5('shuffle-1:' || (j % {sharding.ROUNDS}) || ':' || x), 1, 8))::BIGINT) % b ELSE y END,
    j + 1
  FROM net, g WHERE NOT (j > 0 AND j % {sharding.ROUNDS} = 0 AND x * b + y < n)),
p AS (SELECT r0, x * b + y AS p FROM net, g WHERE j > 0 AND j % {sharding.ROUNDS} = 0 AND x * b + y < n),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS r0 FROM summed)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % 40)::INTEGER AS shard, (p // 40)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard FROM o JOIN p USING (r0)""",
    "op8_host_quality": rf"""
WITH w AS (SELECT row_number() OVER () AS id, doc_id, source AS host, {_WORDS} AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
  coalesce(text, '') AS text FROM documents),
win AS (SELECT id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS win FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, win) AS c FROM win) WHERE c > 1),
cov AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY id),
m AS (SELECT w.id, doc_id, host, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (id)),
h AS (SELECT host, count(*) AS docs, {", ".join(f"sum(CASE WHEN {r} THEN 1 ELSE 0 END)::DOUBLE AS bad_{k}" for k, r in _RULES.items())} FROM m GROUP BY host),
pr AS (SELECT *, {_WEIGHTS} FROM (SELECT {_PRIOR} FROM h)),
v AS (SELECT host, {_OK} AS ok FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({" OR ".join(f"({r})" for r in quality_rules.BASE.values())}) AS base_failed,
  NOT ({" OR ".join(f"({r})" for r in quality_rules.BASE.values())}) AND ok AS kept
FROM m JOIN v ON m.host IS NOT DISTINCT FROM v.host""",
}
