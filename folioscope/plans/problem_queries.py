"""Queries of the general training-data problem (N = 1) and their SQL."""

from __future__ import annotations

from folioscope.operators import orphans


def _read(spark, sf_dir, *names):
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def p1_found(spark, sf_dir):
    return orphans.orphan_citations(*_read(spark, sf_dir, "units", "unit_withdrawals")).select("unit_id", "dep_pos", "cause")


def p1_orphan_report(spark, sf_dir):
    return orphans.orphan_report(*_read(spark, sf_dir, "units", "unit_withdrawals"))


QUERIES = {"p1_found": p1_found, "p1_orphan_report": p1_orphan_report}

_CASES = r"""
WITH kinds(word, kind) AS (VALUES ('definition','definition'),('theorem','theorem'),('lemma','lemma'),('proposition','proposition'),
  ('corollary','corollary'),('example','example'),('remark','remark'),('exercise','exercise'),('def','definition'),('defn','definition'),
  ('thm','theorem'),('theor','theorem'),('lem','lemma'),('prop','proposition'),('cor','corollary'),('coroll','corollary'),('ex','example'),
  ('exmp','example'),('exam','example'),('rem','remark'),('rmk','remark'),('exerc','exercise'),('exer','exercise'),('exr','exercise')),
entry AS (SELECT unit_id, _doc_id AS doc, arrived_at, unnest(dependencies) AS cited, unnest(range(len(dependencies))) AS dep_pos FROM units
  WHERE _doc_id IS NOT NULL AND arrived_at IS NOT NULL),
cite AS (SELECT unit_id, CAST(dep_pos AS INTEGER) AS dep_pos, doc, arrived_at, kind,
    regexp_extract(cited, '^[\s\x{a0}]*\pL+\.?[\s\x{a0}]*(\d+(\.\d+)*)', 1) AS number
  FROM entry JOIN kinds ON word = lower(regexp_extract(cited, '^[\s\x{a0}]*(\pL+)\.?[\s\x{a0}]*\d', 1))),
gone AS (SELECT unit_id, min(withdrawn_at) AS gone FROM unit_withdrawals GROUP BY unit_id),
parent AS (SELECT u._doc_id AS doc, kind, regexp_extract(label, '^[\s\x{a0}]*\pL+\.?[\s\x{a0}]*(\d+(\.\d+)*)', 1) AS number, arrived_at AS born, gone
  FROM units u JOIN kinds ON word = lower(regexp_extract(label, '^[\s\x{a0}]*(\pL+)\.?[\s\x{a0}]*\d', 1)) LEFT JOIN gone USING (unit_id)),
found AS (SELECT c.*, CASE WHEN NOT EXISTS (SELECT 1 FROM parent p WHERE p.doc = c.doc AND p.kind = c.kind AND p.number = c.number) THEN 'missing'
    WHEN NOT EXISTS (SELECT 1 FROM parent p WHERE p.doc = c.doc AND p.kind = c.kind AND p.number = c.number AND p.born <= c.arrived_at) THEN 'late'
    ELSE 'withdrawn' END AS cause
  FROM cite c WHERE NOT EXISTS (SELECT 1 FROM parent p WHERE p.doc = c.doc AND p.kind = c.kind AND p.number = c.number AND p.born <= c.arrived_at
    AND (p.gone IS NULL OR p.gone > c.arrived_at)))
"""

ORACLE = {
    "p1_found": _CASES + "SELECT unit_id, dep_pos, cause FROM found",
    "p1_orphan_report": _CASES
    + """, per AS (SELECT strftime(arrived_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS citations FROM cite GROUP BY 1),
bad AS (SELECT strftime(arrived_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) FILTER (cause = 'missing') AS missing,
  count(*) FILTER (cause = 'late') AS late, count(*) FILTER (cause = 'withdrawn') AS withdrawn FROM found GROUP BY 1)
SELECT 'units' AS table_name, month, citations, coalesce(missing, 0) AS missing, coalesce(late, 0) AS late, coalesce(withdrawn, 0) AS withdrawn
FROM per LEFT JOIN bad USING (month)""",
}
