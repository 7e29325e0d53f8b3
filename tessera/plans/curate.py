"""The whole curation as one plan."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import assets as A
from tessera.operators import selection as S
from tessera.operators.geometry import side
from tessera.operators.people import valid_people
from tessera.operators.state import unseen
from tessera.operators.vectors import norm
from tessera.params import CurationParams
from tessera.plans.lineage import cut



def _in_time() -> list[Column]:
    return [F.coalesce("created", F.lit("")), F.col("asset_id")]


def candidates(people: DataFrame, asset_person: DataFrame, faces: DataFrame, seen: DataFrame, params: CurationParams, as_of: datetime) -> DataFrame:
    """person_id, asset_id, created, confidence, side of the photos that a run may take up.

    Cheap and selective steps come first: valid people, recency, the exclusion of recorded assets; then the faces are
    joined, the confidence gate applied (absent confidences pass), and persons with too few assets drop out. ``side`` is
    the shorter side of the face, NULL without one.
    """
    p = valid_people(people).select("person_id").distinct()
    a = A.recent_assets(asset_person, params.years, as_of).join(p, "person_id", "left_semi")
    a = a.groupBy("person_id", "asset_id").agg(F.max("file_created_at").alias("created"))
    a = unseen(a, seen)
    f = A.chosen_faces(faces.filter(A.has_box())).select("asset_id", "person_id", "confidence", side().alias("side"))
    a = A.confident(a.join(f, ["asset_id", "person_id"], "left"), params.min_confidence)
    if params.min_face_count > 0:
        a = a.join(A.min_count(a, params.min_face_count).select("person_id"), "person_id", "left_semi")
    return a.select("person_id", "asset_id", "created", "confidence", "side")


def curate(people: DataFrame, asset_person: DataFrame, faces: DataFrame, seen: DataFrame, params: CurationParams, as_of: datetime, limit: int) -> DataFrame:
    """person_id, asset_id, confidence of what a run without an embedder takes up: evenly spread over each person's time."""
    a = candidates(people, asset_person, faces, seen, params, as_of)
    return A.time_spread(a, "person_id", _in_time(), limit).select("person_id", "asset_id", "confidence")


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """The rows whose embedding has ``dims`` entries, all finite, and a length of at least 1e-6."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter((F.size("embedding") == dims) & finite).filter(norm(F.col("embedding")) >= 1e-6)


def curate_smart(people: DataFrame, asset_person: DataFrame, faces: DataFrame, seen: DataFrame, vectors: DataFrame, params: CurationParams, as_of: datetime, limit: int | None, dims: int = 512) -> DataFrame:
    """person_id, asset_id, way of what a run with an embedder takes up of each person.

    Persons with no more candidates than ``limit`` keep all (``all``). Of the others a pool evenly spread over time goes
    through the size gate, meets its ``vectors`` (asset_id, embedding, quality; unusable ones are left out, of several
    the best quality counts), loses near duplicates and gives its representatives (``smart``); a person without any
    vector falls back to the spread over time (``time``). ``limit`` None is automatic: every person with vectors gets up
    to ``params.max_auto``, the others are spread over 30. A limit of 0 or less takes nothing.
    """
    a = candidates(people, asset_person, faces, seen, params, as_of)
    if limit is not None and limit <= 0:
        return a.select("person_id", "asset_id", F.lit("all").alias("way")).limit(0)
    a = cut(a)  # read several times
    sizes = a.groupBy("person_id").agg(F.count("*").alias("n"))
    few = sizes.filter(F.col("n") <= (0 if limit is None else limit)).select("person_id")
    whole = a.join(few, "person_id", "left_semi").select("person_id", "asset_id", F.lit("all").alias("way"))
    many = a.join(few, "person_id", "left_anti")
    pool = A.time_spread(many, "person_id", _in_time(), params.pool_cap)
    pool = pool.filter(F.col("side").isNull() | (F.col("side") >= params.min_face_px))
    best = usable(vectors, dims).groupBy("asset_id").agg(F.max_by(F.struct("embedding", "quality"), F.struct("quality", F.hash("embedding"))).alias("v"))
    pool = cut(pool.join(best, "asset_id").select("person_id", "asset_id", "confidence", "v.embedding", "v.quality"))
    smart = S.curated(pool, limit, params.duplicate_distance, params.max_auto).select("person_id", "asset_id", F.lit("smart").alias("way"))
    without = many.join(pool.select("person_id").distinct(), "person_id", "left_anti")
    spread = A.time_spread(without, "person_id", _in_time(), 30 if limit is None else limit).select("person_id", "asset_id", F.lit("time").alias("way"))
    return whole.union(smart).union(spread)
