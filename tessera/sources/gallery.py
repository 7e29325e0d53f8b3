"""Listings and images as sources."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listed_files(bodies: DataFrame) -> DataFrame:
    """person, file_name from bodies (``value``) such as ``{"person": ["file", ...], "train": [...]}``.

    The key ``train`` and values that are not lists are skipped; a body that is no object gives no rows.
    """
    entries = F.explode(F.from_json("value", "map<string,string>"))
    e = bodies.select(entries.alias("person", "body")).filter("person <> 'train'")
    return e.filter(F.trim("body").startswith("[")).select("person", F.explode(F.from_json("body", "array<string>")).alias("file_name"))


def gallery_listing(spark: SparkSession, path: str) -> DataFrame:
    """The files listed by the JSON files under a path, see :func:`listed_files`."""
    return listed_files(spark.read.text(path, wholetext=True))


def images(spark: SparkSession, path: str) -> DataFrame:
    """origin, height, width, n_channels, data of the images under a path; unreadable files are left out."""
    i = spark.read.format("image").option("dropInvalid", True).load(path)
    return i.select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data")


def photos(wanted: DataFrame, *sources: DataFrame) -> DataFrame:
    """Every row of ``wanted`` (asset_id, file_name) with the first of the ``sources`` that can be read.

    Sources come of :func:`images`, the best (originals) first, previews or thumbnails after them; the last part of
    their origin is the file name. What none of them has comes with NULL pixels and ``source`` NULL; otherwise
    ``source`` is the place of the source in the list, from 0.
    """
    cols = ["height", "width", "n_channels", "data"]
    every = None
    for i, s in enumerate(sources):
        s = s.select(F.substring_index("origin", "/", -1).alias("file_name"), F.struct(F.lit(i).alias("source"), *cols).alias("p"))
        every = s if every is None else every.union(s)
    best = every.groupBy("file_name").agg(F.min_by("p", "p.source").alias("p"))
    return wanted.select("asset_id", "file_name").join(best, "file_name", "left").select("asset_id", "file_name", "p.source", *(f"p.{c}" for c in cols))
