"""Queries of the source audit, conversation repair and SimHash groups."""

from __future__ import annotations

from textloom.functions.runtime import table
from textloom.llm import conversations, divergence, simhash


def op11_source_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"), least_docs=3, top=200)


def op12_conversation_repair(spark, sf_dir):
    return conversations.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, bits=3)


QUERIES = {"op11_source_divergence": op11_source_divergence, "op12_conversation_repair": op12_conversation_repair, "op13_simhash": op13_simhash}

ORACLES = {
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS terms FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
full_c AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + terms) AS p
  FROM full_c JOIN v USING (lang)),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + terms) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM full_c GROUP BY ALL) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
best AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM best))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200""",
}
