"""The jobs as queries: each runs twice into one new folder and gives what then stands there."""

from __future__ import annotations

from jobs import turn_slices, version_report

from ..sources.views import SEQ
from .storage import fresh_path


def job1_turn_slices(spark, sf_dir):
    at = fresh_path(spark, "job1-turn-slices")
    for _ in range(2):
        out = turn_slices.update(spark, f"{sf_dir.rstrip('/')}/conversations.parquet", f"{at}/out", f"{at}/checkpoint")
    return out


def job2_version_report(spark, sf_dir):
    at = fresh_path(spark, "job2-version-report")
    for _ in range(2):
        out = version_report.report(spark, sf_dir, f"{at}/out")
    return out


QUERIES = {"job1_turn_slices": job1_turn_slices, "job2_version_report": job2_version_report}

ORACLES = {
    "job1_turn_slices": r"""
WITH w AS (
  SELECT turn AS slice, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n_words
  FROM conversations),
l AS (
  SELECT slice, role, n_words, role || '/' || CASE WHEN n_words = 0 THEN 'empty' WHEN rtrim(text, ' ') LIKE '%?' THEN 'question' WHEN n_words >= 40 THEN 'long' ELSE 'short' END AS label
  FROM w),
t AS (SELECT slice, role, label, count(*) AS n, sum(n_words)::BIGINT AS n_words FROM l GROUP BY ALL)
SELECT slice, label, n, n_words, round(n / sum(n) OVER (PARTITION BY slice), 6) AS share,
  row_number() OVER (PARTITION BY slice ORDER BY n DESC, label) = 1 AS is_consensus, role
FROM t""",
    "job2_version_report": f"""
WITH {SEQ},
n AS (SELECT collection, time, symbol, count(*) AS n, min(version) AS seen FROM seq GROUP BY ALL),
c AS (SELECT collection, time, symbol AS consensus FROM n QUALIFY row_number() OVER (PARTITION BY collection, time ORDER BY n DESC, seen DESC, symbol DESC) = 1),
a AS (
  SELECT collection, version, count(*) AS positions, round(avg((symbol = consensus)::INT), 6) AS agreement
  FROM seq JOIN c USING (collection, time) GROUP BY ALL),
s AS (SELECT version, symbol, count(*) AS n, min(time) AS seen FROM seq GROUP BY ALL),
e AS (
  SELECT version, round(-sum(p * ln(p)), 6) AS entropy
  FROM (SELECT version, n / sum(n) OVER (PARTITION BY version) AS p FROM s) GROUP BY version),
m AS (SELECT version, symbol AS label FROM s QUALIFY row_number() OVER (PARTITION BY version ORDER BY n DESC, seen DESC, symbol DESC) = 1)
SELECT version, positions, agreement, entropy, label,
  rank() OVER (PARTITION BY collection ORDER BY agreement DESC) AS place, collection
FROM a JOIN e USING (version) JOIN m USING (version)""",
}
