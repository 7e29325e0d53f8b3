"""Photo records: shapes, caps, recency, face choice, counts and limits per person."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.ranking import rank_in_group

#: A time stamp counts only with an offset.
OFFSET = r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$"


def created_ts(c: str = "file_created_at") -> Column:
    """The instant of an ISO-8601 text with an offset; NULL for anything else."""
    return F.when(F.col(c).rlike(OFFSET), F.try_to_timestamp(F.col(c)))


def recent_assets(assets: DataFrame, years: int, as_of: datetime) -> DataFrame:
    """Assets created strictly after ``as_of`` less 365 days a year; 0 years keeps all, bad time stamps included."""
    if years == 0:
        return assets
    limit = F.lit(f"{as_of.isoformat()}+00:00").cast("timestamp") - F.make_dt_interval(F.lit(365 * years))
    return assets.filter(created_ts() > limit)


def item_lists(documents: DataFrame, column: str) -> Column:
    """The list of a response in either shape, ``{"assets": [...]}`` or ``{"assets": {"items": [...]}}``."""
    v = F.try_parse_json(F.col(column))
    nested = F.try_variant_get(v, "$.assets.items", "array<string>")
    return F.coalesce(nested, F.try_variant_get(v, "$.assets", "array<string>"))


def capped(assets: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` assets per person, in order of their ids (the order of pages)."""
    return rank_in_group(assets, "person_id", [F.col("asset_id").asc()], "_n").filter(F.col("_n") <= cap).drop("_n")


def first_faces(assets: DataFrame) -> DataFrame:
    """asset_id, person_id and the first face of the first entry of that person that has faces.

    NULL coordinates are 0; persons without faces have no row; NULL lists have none.
    """
    p = assets.select("asset_id", "people", F.explode(F.array_distinct("people.id")).alias("person_id")).filter("person_id IS NOT NULL")
    mine = F.filter("people", lambda x: (x["id"] == F.col("person_id")) & (F.size(x["faces"]) > 0))
    p = p.withColumn("f", F.get(F.get(mine, F.lit(0))["faces"], F.lit(0))).filter("f IS NOT NULL")
    box = [F.coalesce(F.col(f"f.{c}"), F.lit(0)).alias(c) for c in ("x1", "y1", "x2", "y2")]
    return p.select("asset_id", "person_id", *box, F.col("f.score").alias("confidence")).distinct()


def chosen_faces(faces: DataFrame) -> DataFrame:
    """One face per (asset, person): the smallest face_id. Faces of nobody stand for nobody; a NaN confidence is NULL."""
    key = ["asset_id", "person_id"]
    rest = [c for c in faces.columns if c not in key]
    values = [F.when(~F.isnan(c), F.col(c)).alias(c) if c == "confidence" else F.col(c) for c in rest]
    best = faces.filter("person_id IS NOT NULL").groupBy(*key).agg(F.min_by(F.struct(*values), F.struct(F.col("face_id").isNull().alias("n"), "face_id")).alias("f"))
    return best.select(*key, *(F.col(f"f.{c}").alias(c) for c in rest))


def enriched(asset_person: DataFrame, faces: DataFrame) -> DataFrame:
    """asset_id, person_id with the chosen face, NULLs where there is none; zero boxes count as no face."""
    f = chosen_faces(faces.filter(has_box())).select("asset_id", "person_id", "face_id", "x1", "y1", "x2", "y2", "confidence")
    return asset_person.select("asset_id", "person_id").distinct().join(f, ["asset_id", "person_id"], "left")


def has_box() -> Column:
    """A box with a corner away from the origin; NULL coordinates count as 0."""
    return ~((F.coalesce("x1", F.lit(0)) == 0) & (F.coalesce("y1", F.lit(0)) == 0) & (F.coalesce("x2", F.lit(0)) == 0) & (F.coalesce("y2", F.lit(0)) == 0))


def confident(faces: DataFrame, least: float) -> DataFrame:
    """Faces with at least that confidence; an absent one (NULL or NaN) passes."""
    return faces.filter(F.col("confidence").isNull() | F.isnan("confidence") | (F.col("confidence") >= least))


def min_count(assets: DataFrame, least: int) -> DataFrame:
    """person_id, n of the persons with at least ``least`` assets; 0 and below keep all."""
    n = assets.groupBy("person_id").agg(F.count("*").alias("n"))
    return n.filter(F.col("n") >= least) if least > 0 else n


def preview(assets: DataFrame) -> DataFrame:
    """Per person the number of assets and the first and last day of their time stamps (as text), a dash for none."""
    day = F.substring(F.when(F.col("file_created_at").rlike(r"^\d{4}-\d\d-\d\d"), F.col("file_created_at")), 1, 10)
    return assets.groupBy("person_id").agg(F.count("*").alias("n"), F.coalesce(F.min(day), F.lit("—")).alias("first_day"), F.coalesce(F.max(day), F.lit("—")).alias("last_day"))


def capacities(wanted: DataFrame, tracked: DataFrame, most: int, limit: int | None = None) -> DataFrame:
    """person, capacity and effective_limit of every wanted person.

    capacity is ``most`` less the tracked number. The limit of a person at capacity is not capped (replacement only);
    an automatic one (None) is the capacity once something is tracked, an explicit one at most the capacity.
    """
    j = wanted.join(tracked, "person", "left").withColumn("tracked", F.coalesce("tracked", F.lit(0)))
    cap = F.lit(most) - F.col("tracked")
    if limit is None:
        eff = F.when((F.col("tracked") > 0) & (cap > 0), cap)
    else:
        eff = F.when(cap > 0, F.least(F.lit(limit), cap)).otherwise(F.lit(limit))
    return j.select("person", cap.cast("bigint").alias("capacity"), eff.cast("bigint").alias("effective_limit"))


def time_spread(rows: DataFrame, group: str, order: list, limit: int) -> DataFrame:
    """Up to ``limit`` rows per group, evenly spread over its order, both ends included.

    A group not larger than the limit is kept whole. Position i of the sample is floor(i * (n - 1) / (limit - 1)) in
    double arithmetic, the last one exactly n - 1; a limit of 1 takes the first row, 0 or less none.
    """
    if limit <= 0:
        return rows.limit(0)
    r = rank_in_group(rows, group, order, "_at", "_n").withColumn("_at", (F.col("_at") - 1).cast("int"))
    n, at = F.col("_n"), F.col("_at")
    if limit == 1:
        return r.filter(at == 0).drop("_n", "_at")
    step = (n - 1).cast("double") / F.lit(float(limit - 1))
    # the only sample positions that can fall on row `at` are next to at / step
    near = F.floor(at / step)
    hit = F.lit(False)
    for d in (-1, 0, 1, 2):
        i = near + d
        hit = hit | ((i >= 0) & (i < limit) & (F.when(i == limit - 1, n - 1).otherwise(F.floor(i.cast("double") * step)) == at))
    return r.filter((n <= limit) | hit).drop("_n", "_at")
