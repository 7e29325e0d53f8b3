"""Problem 9: queries."""

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.abuse import rates, screened
from tessera.sources import read_table


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "review_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter("flagged").select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "language", "score", "category")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(_scored(spark, sf_dir))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
SQL: dict[str, str] = {}
