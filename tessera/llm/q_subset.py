"""Problem 4: queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.subset import varied_subsets
from tessera.sources import read_table


def p4_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: read_table(spark, sf_dir, n) for n in ("embedding_cache", "face_data", "subset_requests")}
    return varied_subsets(t["embedding_cache"], t["face_data"], t["subset_requests"])


def p4_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every request got, and the least residual with which a vector was taken."""
    got = p4_subset(spark, sf_dir).groupBy("request_id").agg(F.count("*").alias("n_chosen"), F.min("residual").alias("least_residual"))
    asked = read_table(spark, sf_dir, "subset_requests").distinct()
    return asked.join(got, "request_id", "left").select("request_id", "subset_size", F.coalesce("n_chosen", F.lit(0)).alias("n_chosen"), "least_residual")


QUERIES = {"p4_subset": p4_subset, "p4_sizes": p4_sizes}
SQL: dict[str, str] = {}
