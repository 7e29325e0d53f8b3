"""Capping records per dominant contributor: water-filled share limits, best records kept."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.ids import canonical_uuid
from tessera.plans.lineage import cut
from tessera.plans.ranking import rank_in_group


def contributor_records(runs: DataFrame) -> DataFrame:
    """Distinct records of each contributor with their newest scores: person, asset_id, score, frigate_score.

    ``person`` is trimmed and lower case; NULL and blank persons contribute nothing. Ids come from ``asset_ids`` in
    canonical form, entries that are not UUIDs are left out. NULL, NaN and negative scores are absent; each score is
    that of the latest run (``recorded_ts``, then ``run_id``, NULLs first; then the larger score) of the person that
    has one for the id. Repeated rows change nothing; NULL lists and maps give nothing.
    """
    person = F.lower(F.regexp_replace("person", r"^\s+|\s+$", "")).alias("person")
    base = runs.select(person, "recorded_ts", "run_id", "asset_ids", "scores", "frigate_scores").filter("person <> ''")
    none = F.lit(None).cast("double")
    listed = base.select("person", "recorded_ts", "run_id", F.explode("asset_ids").alias("id"), F.lit(1).alias("listed"), none.alias("s"), none.alias("f"))
    s = base.select("person", "recorded_ts", "run_id", F.explode("scores").alias("id", "v")).select("person", "recorded_ts", "run_id", "id", F.lit(0).alias("listed"), F.col("v").alias("s"), none.alias("f"))
    f = base.select("person", "recorded_ts", "run_id", F.explode("frigate_scores").alias("id", "v")).select("person", "recorded_ts", "run_id", "id", F.lit(0).alias("listed"), none.alias("s"), F.col("v").alias("f"))
    rows = listed.union(s.filter("s >= 0 AND NOT isnan(s)")).union(f.filter("f >= 0 AND NOT isnan(f)"))
    rows = rows.withColumn("asset_id", canonical_uuid(F.col("id"))).filter("asset_id IS NOT NULL")
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("recorded_ts", "run_id", F.col(c).alias("v"))))["v"]
    got = rows.groupBy("person", "asset_id").agg(F.max("listed").alias("listed"), newest("s").alias("score"), newest("f").alias("frigate_score"))
    return got.filter("listed = 1").drop("listed")


def water_level(counts: DataFrame, max_count: int | None, max_share: float) -> DataFrame:
    """One row ``level``: the largest number of records per contributor that keeps every share within ``max_share``.

    ``counts`` has one row per contributor with its count ``n``. With t records at most from each, the output holds
    K(t) = sum(min(n, t)) records; t is consistent if t <= max_share * K(t), or if no contributor is cut and the
    largest share holds. Contributor counts are sorted once as a histogram of equal counts (at most sqrt(2 * rows)
    entries); between two neighbouring counts K is linear, so the best t of each stretch has a closed form. If not even
    t = 1 is consistent (too few contributors for the share) the level is 1. No contributors: no row.
    """
    h = counts.groupBy("n").agg(F.count("*").alias("m"))
    below = W.orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    h = h.withColumns({"s0": F.coalesce(F.sum(F.col("n") * F.col("m")).over(below), F.lit(0)), "lo": F.coalesce(F.max("n").over(below), F.lit(0))})
    total = h.agg(F.sum("m").alias("all_m"))
    passed = F.coalesce(F.sum("m").over(below), F.lit(0))
    h = h.withColumn("passed", passed).join(F.broadcast(total)).withColumn("above", F.col("all_m") - F.col("passed"))
    # on (lo, n]: K(t) = s0 + t * above; consistent where t * (1 - share * above) <= share * s0
    slope = 1 - F.lit(max_share) * F.col("above")
    best = F.when(slope <= 1e-12, F.col("n")).otherwise(F.least(F.col("n"), F.floor(F.lit(max_share) * F.col("s0") / slope + 1e-9)))
    h = h.withColumn("t", best).filter("t > lo")
    level = F.greatest(F.coalesce(F.max("t"), F.lit(1)), F.lit(1))
    out = h.agg((F.least(level, F.lit(max_count)) if max_count is not None else level).cast("bigint").alias("level"))
    return out


def cap_contributors(records: DataFrame, contributor: str, order: list, max_count: int | None = 12, max_share: float = 1.0) -> DataFrame:
    """All records with ``rank`` (within the contributor by ``order``) and ``kept``.

    Share limits are solved by :func:`water_level`; each contributor's best records up to that level are kept.
    Ranks are computed over range partitions, so one contributor may hold most of the records.
    """
    ranked = cut(rank_in_group(records, contributor, order))
    counts = ranked.groupBy(contributor).agg(F.count("*").alias("n"))
    level = water_level(counts, max_count, max_share)
    return ranked.join(F.broadcast(level)).withColumn("kept", F.col("rank") <= F.col("level")).drop("level")


def best_first() -> list:
    """Score falling, then gallery score rising, absent ones last, then the id."""
    return [F.col("score").desc_nulls_last(), F.col("frigate_score").asc_nulls_last(), F.col("asset_id").asc()]
