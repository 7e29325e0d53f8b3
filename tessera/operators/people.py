"""Person records: validity, allow and deny lists, duplicate names and their survivors."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def valid_people(people: DataFrame) -> DataFrame:
    """Records with an id and a name that is not blank; NULLs are not valid."""
    return people.filter((F.trim("name") != "") & F.col("person_id").isNotNull() & (F.col("person_id") != ""))


def listed_people(people: DataFrame, names: list[str], keep: bool = True) -> DataFrame:
    """Records whose name, without case, is in the list (or is not). NULL names are in no list.

    An empty list keeps everybody, as a list that is not set does.
    """
    wanted = [n.strip().lower() for n in names if n.strip()]
    if not wanted:
        return people
    inside = F.coalesce(F.lower("name").isin(wanted), F.lit(False))
    return people.filter(inside if keep else ~inside)


def duplicate_names(people: DataFrame) -> DataFrame:
    """name (trimmed), n: names that more than one valid record bears."""
    return valid_people(people).groupBy(F.trim("name").alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


def with_survivor(people: DataFrame) -> DataFrame:
    """Valid records with the ``survivor`` of their trimmed name: most assets (NULL as 0), ties to the smallest id."""
    best = F.max(F.coalesce("asset_count", F.lit(0))).over(W.partitionBy(F.trim("name")))
    p = valid_people(people).withColumn("_best", best)
    survivor = F.min(F.when(F.coalesce("asset_count", F.lit(0)) == F.col("_best"), F.col("person_id"))).over(W.partitionBy(F.trim("name")))
    return p.withColumn("survivor", survivor).drop("_best")


def keep_largest(people: DataFrame) -> DataFrame:
    """One record per name: its survivor; records without a name or id are left as they are."""
    kept = with_survivor(people).filter("person_id = survivor").drop("survivor")
    rest = people.filter(~F.coalesce((F.trim("name") != "") & (F.col("person_id") != ""), F.lit(False)))
    return kept.unionByName(rest)


def merge_map(people: DataFrame) -> DataFrame:
    """survivor, merged: ids to merge into the survivor of their name."""
    return with_survivor(people).filter("person_id <> survivor").select("survivor", F.col("person_id").alias("merged")).distinct()


def rekey(records: DataFrame, merges: DataFrame, column: str = "person_id") -> DataFrame:
    """Records with merged ids replaced by their survivors; NULL ids stay."""
    m = merges.select(F.col("merged").alias("_merged"), F.col("survivor").alias("_survivor"))
    joined = records.join(m, F.col(column) == F.col("_merged"), "left")
    return joined.withColumn(column, F.coalesce("_survivor", column)).select(*records.columns)
