"""Keyed state of uploads: an append-only log, folded; files, scores and what they point to."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.ranking import rank_in_group


def newest(value: str, seq: str = "seq") -> Column:
    """Aggregate: the last value by ``seq`` that is not NULL."""
    return F.max(F.when(F.col(value).isNotNull(), F.struct(seq, value)))[value].alias(value)


def fold_marks(log: DataFrame, values: list[str]) -> DataFrame:
    """One row per (person, asset_id): each value as last recorded, first and last ``seq``.

    Replaying entries changes nothing. Entries without a person are ignored.
    """
    ok = log.filter("person IS NOT NULL AND person <> ''")
    return ok.groupBy("person", "asset_id").agg(*(newest(v) for v in values), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def fold_files(log: DataFrame) -> DataFrame:
    """One row per (person, file_name): the asset it was last recorded for and when it was first seen."""
    return log.groupBy("person", "file_name").agg(newest("asset_id"), F.min("seq").alias("seq"))


def without_files(files: DataFrame, gone: DataFrame) -> DataFrame:
    """The file map less the (person, file_name) pairs in ``gone``."""
    return files.join(gone.select("person", "file_name").distinct(), ["person", "file_name"], "left_anti")


def scores_after_removal(scores: DataFrame, files: DataFrame, gone: DataFrame) -> DataFrame:
    """Gallery scores less those of assets that lost their last file; assets that never had one keep theirs."""
    g = gone.select("person", "file_name").distinct()
    lost = files.join(g, ["person", "file_name"], "left_semi").select("person", "asset_id").distinct()
    lost = lost.join(without_files(files, gone), ["person", "asset_id"], "left_anti")
    return scores.join(lost, ["person", "asset_id"], "left_anti")


def without_people(state: DataFrame, names: list[str]) -> DataFrame:
    """State less everything of the given persons."""
    return state.filter(~F.coalesce(F.col("person").isin([n.lower() for n in names]), F.lit(False)))


def emptied(state: DataFrame) -> DataFrame:
    """State of the same shape without anything in it."""
    return state.limit(0)


def migrated(entries: DataFrame) -> DataFrame:
    """Entries with empty lists and maps in the place of NULL ones, and whether they had the old form (no map at all)."""
    maps = ["scores", "frigate_scores", "frigate_files", "crop_dims"]
    old = F.lit(True)
    for c in maps:
        old = old & F.col(c).isNull()
    kinds = dict(entries.dtypes)
    filled = {c: F.coalesce(c, F.from_json(F.lit("{}"), kinds[c])) for c in maps}
    return entries.withColumn("legacy", old).withColumns(filled | {"asset_ids": F.coalesce("asset_ids", F.array().cast(kinds["asset_ids"]))})


def unseen(assets: DataFrame, seen: DataFrame) -> DataFrame:
    """Assets whose id was recorded for nobody (the exclusion holds across persons); NULL ids are never seen."""
    return assets.join(seen.filter("asset_id IS NOT NULL").select("asset_id").distinct(), "asset_id", "left_anti")


def seen_again(assets: DataFrame, seen: DataFrame) -> DataFrame:
    """Assets whose id was recorded for somebody."""
    return assets.join(seen.filter("asset_id IS NOT NULL").select("asset_id").distinct(), "asset_id", "left_semi")


def summary(uploaded: DataFrame, rejected: DataFrame) -> DataFrame:
    """person, n_uploaded, n_rejected over everybody in either table."""
    u, r = (t.groupBy("person").agg(F.count("*").alias(n)) for t, n in ((uploaded, "n_uploaded"), (rejected, "n_rejected")))
    j = u.join(r, "person", "full_outer")
    return j.select("person", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_uploaded", "n_rejected")))


def mapped_scores(files: DataFrame, scores: DataFrame) -> DataFrame:
    """person, file_name, asset_id, score, seq of the files whose asset has a score; one file per asset, first seen."""
    j = files.join(scores.select("person", "asset_id", "score"), ["person", "asset_id"])
    w = W.partitionBy("person", "asset_id").orderBy("seq", "file_name")
    return j.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def extreme_file(mapped: DataFrame, largest: bool, exclude: list[str] | None = None) -> DataFrame:
    """Per person the file of the least (or largest) score; ties go to the one seen first, then to the name."""
    m = mapped.filter(~F.col("file_name").isin(exclude)) if exclude else mapped
    score = -F.col("score") if largest else F.col("score")
    pick = F.min_by(F.struct("file_name", "score"), F.struct(score.alias("s"), "seq", "file_name"))
    return m.groupBy("person").agg(pick.alias("p")).select("person", "p.file_name", "p.score")


def file_number(c: str) -> Column:
    """The number after the last underscore of a file name without its ending; infinite if there is none."""
    stem = F.regexp_replace(c, r"\.[^.]*$", "")
    tail = F.when(stem.contains("_"), F.substring_index(stem, "_", -1))
    return F.coalesce(F.try_to_number(tail, F.lit("999999999")).cast("double"), F.lit(float("inf")))


def positional_map(uploads: DataFrame, new_files: DataFrame) -> DataFrame:
    """person, file_name, asset_id: the i-th upload (by ``pos``) with the i-th new file (by number, then name).

    Persons whose counts differ are mapped not at all; uploads without an asset take their place but give no row.
    """
    u = rank_in_group(uploads, "person", [F.col("pos").asc()], "i", "n")
    f = rank_in_group(new_files, "person", [file_number("file_name").asc(), F.col("file_name").asc()], "i", "n")
    return u.join(f, ["person", "i", "n"]).filter("asset_id IS NOT NULL").select("person", "file_name", "asset_id")


def crop_trace(dims: DataFrame, side: int, scores: DataFrame, gallery: DataFrame, files: DataFrame) -> DataFrame:
    """Crops with a side of ``side`` pixels: person, asset_id, w, h, score, gallery_score, file_name (first seen)."""
    first = files.groupBy("person", "asset_id").agg(F.min_by("file_name", F.struct("seq", "file_name")).alias("file_name"))
    hit = dims.filter((F.col("w") == side) | (F.col("h") == side))
    hit = hit.join(scores.select("person", "asset_id", "score"), ["person", "asset_id"], "left")
    hit = hit.join(gallery.select("person", "asset_id", F.col("score").alias("gallery_score")), ["person", "asset_id"], "left")
    return hit.join(first, ["person", "asset_id"], "left").select("person", "asset_id", "w", "h", "score", "gallery_score", "file_name")
