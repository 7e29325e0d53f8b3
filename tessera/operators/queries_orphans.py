"""Queries of the orphan-reference operator and their SQL."""

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.orphans import orphan_references, orphan_report
from tessera.sources import read_table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(read_table(spark, sf_dir, "frigate_uploaded_ids"), read_table(spark, sf_dir, "asset"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("run_id", "field_name", "item", "state").distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}

_HEX = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '^urn:uuid:', ''), '^\{{(.*)\}}$', '\1'), '^urn:uuid:|-', '', 'g')"""
_STATES = rf"""
WITH refs AS (
  SELECT DISTINCT * FROM (
    SELECT run_id, recorded_ts, 'asset_ids' AS field_name, item, item AS ref
    FROM (SELECT run_id, recorded_ts, unnest(asset_ids) AS item FROM frigate_uploaded_ids)
    UNION ALL
    SELECT run_id, recorded_ts, 'frigate_files', e.key, e.value
    FROM (SELECT run_id, recorded_ts, unnest(map_entries(frigate_files)) AS e FROM frigate_uploaded_ids))
  WHERE ref IS NOT NULL AND regexp_matches(ref, '\S')),
keyed AS (SELECT *, {_HEX.format("ref")} AS k FROM refs),
parents AS (SELECT {_HEX.format("asset_id")} AS pk, ingested_ts, deleted_ts FROM asset WHERE asset_id IS NOT NULL),
judged AS (
  SELECT r.run_id, r.recorded_ts, r.field_name, r.item, count(p.pk) AS n,
         count(*) FILTER (WHERE p.ingested_ts <= r.recorded_ts AND (p.deleted_ts IS NULL OR p.deleted_ts > r.recorded_ts)) AS alive,
         count(*) FILTER (WHERE p.ingested_ts > r.recorded_ts) AS later
  FROM keyed r LEFT JOIN parents p ON p.pk = r.k AND regexp_full_match(r.k, '[0-9a-f]{{32}}')
  GROUP BY ALL),
orphans AS (
  SELECT run_id, recorded_ts, field_name, item,
         CASE WHEN n = 0 THEN 'missing' WHEN later = n THEN 'late' ELSE 'deleted' END AS state
  FROM judged WHERE alive = 0)
"""

SQL = {
    "p2_found": _STATES + "SELECT DISTINCT run_id, field_name, item, state FROM orphans",
    "p2_report": _STATES
    + """SELECT field_name, strftime(recorded_ts, '%Y-%m') AS month, state,
       CAST(count(*) AS BIGINT) AS n_references, count(DISTINCT run_id) AS n_runs FROM orphans GROUP BY ALL""",
}
