"""Problem 6: queries and SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.capping import best_first, cap_contributors, contributor_records
from tessera.sources import read_table


def _capped(spark: SparkSession, sf_dir: str, **limits) -> DataFrame:
    return cap_contributors(contributor_records(read_table(spark, sf_dir, "frigate_uploaded_ids")), "person", best_first(), **limits)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped(spark, sf_dir, max_count=12).filter("NOT kept").select("person", "asset_id")


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped(spark, sf_dir, max_count=12).filter("kept").select("person", "asset_id", "score", "frigate_score", "rank")


def p6_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept records per person when no person may hold more than a two-hundredth of what is kept."""
    c = _capped(spark, sf_dir, max_count=None, max_share=0.005)
    return c.groupBy("person").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("bigint")).alias("n_kept"))


QUERIES = {"p6_found": p6_found, "p6_kept": p6_kept, "p6_share": p6_share}

_HEX = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '^urn:uuid:', ''), '^\{{(.*)\}}$', '\1'), '^urn:uuid:|-', '', 'g')"""
_RANKED = rf"""
WITH base AS (SELECT lower(regexp_replace(person, '^\s+|\s+$', '', 'g')) AS person, recorded_ts, run_id, asset_ids, scores, frigate_scores FROM frigate_uploaded_ids),
raw AS (
  SELECT person, recorded_ts, run_id, unnest(asset_ids) AS id, 'l' AS kind, NULL::DOUBLE AS v FROM base
  UNION ALL SELECT person, recorded_ts, run_id, e.key, 's', e.value FROM (SELECT *, unnest(map_entries(scores)) AS e FROM base)
  UNION ALL SELECT person, recorded_ts, run_id, e.key, 'f', e.value FROM (SELECT *, unnest(map_entries(frigate_scores)) AS e FROM base)),
hexed AS (SELECT *, {_HEX.format("id")} AS h FROM raw WHERE person <> '' AND (kind = 'l' OR (v >= 0 AND NOT isnan(v)))),
keyed AS (SELECT *, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS asset_id FROM hexed WHERE regexp_full_match(h, '[0-9a-f]{{32}}')),
newest AS (SELECT *, row_number() OVER (PARTITION BY person, asset_id, kind ORDER BY recorded_ts DESC NULLS LAST, run_id DESC NULLS LAST, v DESC) AS rn FROM keyed),
records AS (
  SELECT person, asset_id, max(v) FILTER (WHERE kind = 's') AS score, max(v) FILTER (WHERE kind = 'f') AS frigate_score
  FROM newest WHERE rn = 1 GROUP BY person, asset_id HAVING count(*) FILTER (WHERE kind = 'l') > 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY person ORDER BY score DESC NULLS LAST, frigate_score ASC NULLS LAST, asset_id) AS rank FROM records)
"""

SQL = {
    "p6_found": _RANKED + "SELECT person, asset_id FROM ranked WHERE rank > 12",
    "p6_kept": _RANKED + "SELECT person, asset_id, score, frigate_score, rank FROM ranked WHERE rank <= 12",
    "p6_share": _RANKED
    + """, n AS (SELECT person, count(*) AS n FROM records GROUP BY person),
lv AS (SELECT t, (SELECT sum(least(n, t)) FROM n) AS k FROM (SELECT unnest(generate_series(1, (SELECT max(n) FROM n))) AS t)),
best AS (SELECT greatest(coalesce(max(t) FILTER (WHERE t <= 0.005 * k + 1e-9), 1), 1) AS level FROM lv)
SELECT person, n, CAST(least(n, level) AS BIGINT) AS n_kept FROM n, best""",
}
