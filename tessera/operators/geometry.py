"""Boxes: scaling to the real image, crop boxes with margins, size gates, the crop cascade."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled(df: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes in pixels of an image of ``width`` x ``height``; an unknown size (NULL or 0) leaves its axis as it is."""
    fx = F.when(F.coalesce("image_width", F.lit(0)) > 0, F.lit(float(width)) / F.col("image_width")).otherwise(1.0)
    fy = F.when(F.coalesce("image_height", F.lit(0)) > 0, F.lit(float(height)) / F.col("image_height")).otherwise(1.0)
    box = {c: (F.coalesce(c, F.lit(0)).cast("double") * f) for c, f in (("x1", fx), ("y1", fy), ("x2", fx), ("y2", fy))}
    return df.withColumns(box)


def crop_box(df: DataFrame, margin: float, width: int, height: int) -> DataFrame:
    """cx1, cy1, cx2, cy2: the box widened by ``margin`` of its sides on each side, inside the image, in whole pixels."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    zero = F.lit(0).cast("bigint")
    return df.withColumns({
        "cx1": F.greatest(zero, F.floor(F.col("x1") - w * margin)),
        "cy1": F.greatest(zero, F.floor(F.col("y1") - h * margin)),
        "cx2": F.least(F.lit(width).cast("bigint"), F.floor(F.col("x2") + w * margin)),
        "cy2": F.least(F.lit(height).cast("bigint"), F.floor(F.col("y2") + h * margin)),
    })


def side() -> Column:
    """The smaller side of the box."""
    return F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))


def crop_outcome(df: DataFrame, min_face: int, min_crop: int = 30) -> Column:
    """What becomes of a face whose crop box is known: a reason to skip it, or ``crop``."""
    no_box = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    small_crop = F.least(F.col("cx2") - F.col("cx1"), F.col("cy2") - F.col("cy1")) < min_crop
    return F.when(no_box, "no face").when(side() < min_face, "face too small").when(small_crop, "crop too small").otherwise("crop")


def in_crop(chosen: DataFrame, detected: DataFrame, margin: float, width: int, height: int, squared: bool) -> DataFrame:
    """asset_id, person_id, face_id of ``chosen`` and ``found``: which detected face of the asset the crop around it shows.

    Both have asset_id, face_id and boxes in pixels of an image of ``width`` x ``height``. The crop is the chosen box widened
    by ``margin`` of its sides, inside the image. Of the detected faces with an extent whose centre lies in it the one
    nearest to its centre is found, by squared distance or by the sum of both axes; ties go to the smallest face_id. Without
    any (or with a NULL coordinate) ``found`` is NULL. A NULL asset_id finds nothing.
    """
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    c = chosen.select(
        "asset_id", "person_id", "face_id",
        F.greatest(F.lit(0.0), F.col("x1") - w * margin).alias("left"), F.least(F.lit(float(width)), F.col("x2") + w * margin).alias("right"),
        F.greatest(F.lit(0.0), F.col("y1") - h * margin).alias("top"), F.least(F.lit(float(height)), F.col("y2") + h * margin).alias("bottom"),
    )
    d = detected.filter("x2 > x1 AND y2 > y1").select("asset_id", F.col("face_id").alias("other"), ((F.col("x1") + F.col("x2")) / 2).alias("u"), ((F.col("y1") + F.col("y2")) / 2).alias("v"))
    dx, dy = F.col("u") - (F.col("left") + F.col("right")) / 2, F.col("v") - (F.col("top") + F.col("bottom")) / 2
    far = F.round(dx * dx + dy * dy if squared else F.abs(dx) + F.abs(dy), 6)
    hits = c.join(d, "asset_id").filter("u BETWEEN left AND right AND v BETWEEN top AND bottom")
    best = hits.groupBy("asset_id", "person_id", "face_id").agg(F.min_by("other", F.struct(far.alias("d"), "other")).alias("found"))
    return chosen.select("asset_id", "person_id", "face_id").join(best, ["asset_id", "person_id", "face_id"], "left")
