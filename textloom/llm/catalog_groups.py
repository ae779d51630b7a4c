"""Queries of the operators that compare documents or vectors with one another."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.runtime import table
from textloom.llm import ann, line_dedup, near_dup, resampling


def op1_multiprobe(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_line_dedup(spark, sf_dir):
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_words=50)
    return cut.select(
        "doc_id",
        F.col("_cut.lines").alias("n_lines"),
        F.col("_cut.removed").alias("n_removed"),
        F.col("_cut.removed_words").alias("removed_words"),
        F.md5(F.coalesce("_cut.text", F.lit(""))).alias("text_md5"),
    )


def op5_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=2, similarity=80)


QUERIES = {"op1_multiprobe": op1_multiprobe, "op2_line_dedup": op2_line_dedup, "op5_resampling": op5_resampling, "op10_near_dup": op10_near_dup}

ORACLES = {
    "op2_line_dedup": r"""
WITH raw AS (SELECT doc_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
l AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY p) AS cum FROM (
  SELECT doc_id, p, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))::BIGINT AS nw FROM raw) WHERE nw > 0),
w AS (
  SELECT a.doc_id, a.p AS s, min(b.p) AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.cum - a.cum + a.nw >= 50 GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.p), b.p FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.cum - a.cum + a.nw >= 50 GROUP BY 1, 3),
c AS (SELECT w.doc_id, s, e, string_agg(line, chr(10) ORDER BY p) AS content FROM w JOIN l ON w.doc_id = l.doc_id AND p BETWEEN s AND e GROUP BY 1, 2, 3),
later AS (SELECT doc_id, s, e FROM c QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, s) > 1),
cut AS (SELECT DISTINCT raw.doc_id, p FROM raw JOIN later USING (doc_id) WHERE p BETWEEN s AND e),
r AS (SELECT raw.*, cut.p IS NOT NULL AS gone, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))::BIGINT AS nw
  FROM raw LEFT JOIN cut ON raw.doc_id = cut.doc_id AND raw.p = cut.p)
SELECT doc_id, count(*) FILTER (nw > 0) AS n_lines, count(*) FILTER (nw > 0 AND gone) AS n_removed,
  coalesce(sum(nw) FILTER (gone), 0)::BIGINT AS removed_words,
  md5(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS text_md5
FROM r GROUP BY doc_id""",
}
